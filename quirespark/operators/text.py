"""Text operators over paragraphs (doc_id, ord, text) and other ordered text rows."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def counts(documents: DataFrame) -> DataFrame:
    """Paragraphs, code points and words of every document; a projection, so only two columns are read and nothing is shuffled."""
    return documents.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("paragraphs"),
        F.length("text").cast("long").alias("characters"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )


def joined_text(rows: DataFrame, keys: list[str], order: str, text: str, glue: str, name: str) -> DataFrame:
    """Texts of each key in order, joined by `glue`, without white space at the ends. A key's rows are one document's."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(*keys).agg(F.regexp_replace(F.array_join(parts, glue), r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias(name))


def nth_match(paragraphs: DataFrame, needle: str, n: int) -> DataFrame:
    """The n-th paragraph of each document that contains the needle; a paragraph counts once however often it does."""
    hits = paragraphs.where(F.contains("text", F.lit(needle)))
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("rn") == n).select("doc_id", "ord")


def any_match(rows: DataFrame, keys: list[str], needle: str) -> DataFrame:
    """Whether any row of a key contains the needle."""
    return rows.groupBy(*keys).agg(F.bool_or(F.contains("text", F.lit(needle))).alias("found"))


def folded(column: str) -> Column:
    """Canonical decomposition without nonspacing marks, sub- and superscripts as plain characters. Spark has no such function, so this is an Arrow UDF."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(_plain(c) for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))

    return fold(column)


def _plain(c: str) -> str:
    kind, _, code = unicodedata.decomposition(c).partition(" ")
    return chr(int(code, 16)) if kind in ("<super>", "<sub>") and " " not in code else c


def replace_literal(documents: DataFrame, find: str, replacement: str) -> DataFrame:
    """Replaces non-overlapping occurrences and counts them; an empty needle replaces nothing."""
    n = (F.length("text") - F.length(F.replace("text", F.lit(find), F.lit("")))) / len(find) if find else F.lit(0)
    new = F.replace("text", F.lit(find), F.lit(replacement)) if find else F.col("text")
    return documents.select("doc_id", n.cast("long").alias("replaced"), F.md5(new).alias("text_md5"))


def replace_pattern(documents: DataFrame, pattern: str, template: str) -> DataFrame:
    """Replaces matches of a pattern by a template with $1, $2 ... and counts them."""
    return documents.select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("long").alias("replaced"), F.md5(F.regexp_replace("text", pattern, template)).alias("text_md5"))


def literal_matches(paragraphs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, ord, lo, hi) of every occurrence: the text is cut at the needle, and the lengths before a cut add up to its place. An empty needle occurs nowhere."""
    size, pieces = len(needle), F.split("text", re.escape(needle))
    parts = paragraphs.where(F.contains("text", F.lit(needle)) if needle else F.lit(False)).select("doc_id", "ord", F.posexplode(pieces).alias("k", "part"), F.size(pieces).alias("n"))
    before = Window.partitionBy("doc_id", "ord").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    lo = F.sum(F.length("part")).over(before) + F.col("k") * size
    return parts.withColumn("lo", lo.cast("long")).where("k < n - 1").select("doc_id", "ord", "lo", (F.col("lo") + size).alias("hi"))


def flagged(matches: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Each match (doc_id, ord, lo, hi) with `hit`: whether a span (doc_id, ord, lo, hi) overlaps it. Half-open intervals meet by an equality join on bins of `width`: no nested loop, and matches are read once."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor((hi - 1) / width)))
    m = matches.withColumn("bin", bins(F.col("lo"), F.col("hi")))
    s = spans.select("doc_id", "ord", F.col("lo").alias("span_lo"), F.col("hi").alias("span_hi")).withColumn("bin", bins(F.col("span_lo"), F.col("span_hi")))
    hit = F.coalesce(F.bool_or((F.col("lo") < F.col("span_hi")) & (F.col("span_lo") < F.col("hi"))), F.lit(False))
    return m.join(s, ["doc_id", "ord", "bin"], "left").groupBy("doc_id", "ord", "lo", "hi").agg(hit.alias("hit"))


def overlapping(matches: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """The matches that a span overlaps."""
    return flagged(matches, spans, width).where("hit").drop("hit")


def run_offsets(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Runs of a text (cut at spaces, each with the space before it) and where each begins in the flat text."""
    runs = rows.select(*keys, F.posexplode(F.split(text, " ")).alias("run_idx", "run"))
    before = Window.partitionBy(*keys).orderBy("run_idx").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start", F.coalesce(F.sum(F.length("run") + 1).over(before), F.lit(0)).cast("long")).select(*keys, F.col("run_idx").cast("long").alias("run_idx"), "start", F.length("run").cast("long").alias("length"))


def escape_xml(c: Column) -> Column:
    """The five characters that mean something in XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def bookmark_name(c: Column) -> Column:
    """Letters, digits and underscores, not a digit first, 40 characters at most."""
    plain = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.substring(F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain), 1, 40)


def valid_bookmark_name(c: Column) -> Column:
    """1 to 40 characters without a space, no digit first."""
    return (F.length(c) > 0) & (F.length(c) <= 40) & ~F.contains(c, F.lit(" ")) & ~c.rlike(r"^\p{N}")


def safe_relative_path(c: Column) -> Column:
    """A package path that stays inside: 1 to 256 characters, not absolute, no parent step, back slash, percent sign or control character."""
    return (F.length(c) > 0) & (F.length(c) <= 256) & ~c.startswith("/") & ~F.contains(c, F.lit("..")) & ~c.rlike(r"[\\%\x00-\x1f]")
