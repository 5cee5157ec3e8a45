"""Units of page geometry. Fixed values of the file format."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TWIPS_PER_POINT = 20
TWIPS_PER_CHARACTER = 240
EMU_PER_INCH = 914_400
EMU_PER_CM = 360_000
EMU_PER_PIXEL = 9_525


def emu_from_inches(c: Column) -> Column:
    return F.round(c * EMU_PER_INCH).cast("long")


def emu_from_cm(c: Column) -> Column:
    return F.round(c * EMU_PER_CM).cast("long")


def twips_from_points(c: Column) -> Column:
    return F.round(c * TWIPS_PER_POINT).cast("long")


def twips_from_characters(c: Column) -> Column:
    return (c * TWIPS_PER_CHARACTER).cast("long")
