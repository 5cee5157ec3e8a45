"""Text that runs through runs: replacement with formatting kept, splitting of runs, tracked changes at character offsets.

A surface is what reads as one text: the runs of a paragraph, and apart from these those of each link, simple field and
content control in it. Its pieces are w:t elements and the elements that stand for one character (tabs, breaks,
hyphens); deleted text is in no surface. Offsets count characters of a surface's pieces from 0. All work is joins and
array functions over the surfaces of any number of documents; the text of one surface is one value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.packages import ATTRIBUTES
from ..sources.scratch import stored
from . import tree as T
from .text import escape_xml
from .tree import KEY, TREE, element

#: Elements of a run that are one character of its text.
CHARACTERS = {"w:tab": "\t", "w:br": "\n", "w:cr": "\n", "w:noBreakHyphen": "‑"}
SURFACES = ("w:p", "w:hyperlink", "w:fldSimple", "w:sdt")
GONE = ("w:del", "w:moveFrom")


def _up(n: int = 1) -> Column:
    return F.slice("path", 1, F.greatest(F.size("path") - n, F.lit(0)))


def runs(tree: DataFrame) -> DataFrame:
    """(doc_id, part_path, path, surface): the runs that are in a surface, with its path."""
    here = tree.where(F.col("name").isin(*SURFACES, *GONE)).select("doc_id", "part_path", F.col("path").alias("_up"), F.col("name").alias("_name"))
    above = T._prefixes(tree.where("name = 'w:r'").select(*KEY, "path")).join(here, [*KEY, "_up"])
    near = above.groupBy(*KEY, "path").agg(F.max(F.struct(F.size("_up").alias("n"), F.col("_up").alias("surface"), F.col("_name").alias("name"))).alias("x"))
    return near.where(~F.col("x.name").isin(*GONE)).select(*KEY, "path", F.col("x.surface").alias("surface"))


def pieces(tree: DataFrame) -> DataFrame:
    """(doc_id, part_path, surface, run, path, atom, text, start): the pieces of surfaces, with the place of each in its surface's text."""
    texts = tree.where("kind = 'text'").select(*KEY, _up().alias("path"), F.struct("path", "text").alias("t")).groupBy(*KEY, "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "").alias("_text"))
    own = tree.where(F.col("name").isin("w:t", *CHARACTERS)).select(*KEY, "path", "name", _up().alias("run"))
    own = own.join(runs(tree).withColumnRenamed("path", "run"), [*KEY, "run"]).join(texts, [*KEY, "path"], "left")
    atoms = F.create_map(*(F.lit(x) for pair in CHARACTERS.items() for x in pair))
    own = own.withColumn("text", F.when(F.col("name") == "w:t", F.coalesce("_text", F.lit(""))).otherwise(F.element_at(atoms, F.col("name"))))
    before = F.sum(F.length("text")).over(Window.partitionBy(*KEY, "surface").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    return own.select(*KEY, "surface", "run", "path", (F.col("name") != "w:t").alias("atom"), "text", F.coalesce(before, F.lit(0)).cast("int").alias("start"))


def _spliced(text: Column, start: Column, edits: Column) -> Column:
    """A piece's text after edits(s, e, r) of its surface: what they cover goes, and their text comes where they begin."""
    end = start + F.length(text)
    met = F.filter(edits, lambda x: (x["s"] < end) & (x["e"] > start))
    part = lambda a, b: F.substring(text, a - start + 1, F.greatest(b - a, F.lit(0)))
    begin = F.struct(start.cast("int").alias("at"), F.lit("").alias("out"))
    one = lambda acc, x: F.struct(F.least(x["e"], end).cast("int").alias("at"), F.concat(acc["out"], part(acc["at"], F.greatest(x["s"], acc["at"])), F.when(x["s"] >= start, x["r"]).otherwise("")).alias("out"))
    return F.aggregate(met, begin, one, lambda acc: F.concat(acc["out"], part(acc["at"], end)))


def _flat(own: DataFrame) -> DataFrame:
    """(doc_id, part_path, surface, flat): the texts of surfaces, of their pieces."""
    return own.groupBy(*KEY, "surface").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "").alias("flat"))


def matches(tree: DataFrame, find: str, replacement: str, regex: bool = False, match_case: bool = True) -> DataFrame:
    """(doc_id, part_path, surface, edits array<struct<s,e,r>>) of the surfaces in which `find` occurs: from where to where, and what comes instead.

    A literal is found from left to right without overlaps. In a pattern $1 and so on of the replacement stand for its
    groups. A pattern that matches nothing at all is an error; an empty literal is found nowhere.
    """
    return matches_in(_flat(pieces(tree)), find, replacement, regex, match_case)


def matches_in(flat: DataFrame, find: str, replacement: str, regex: bool = False, match_case: bool = True) -> DataFrame:
    """`matches` of flat(doc_id, part_path, surface, flat), the texts themselves."""
    if regex and re.search(find, "") is not None:
        raise ValueError("the pattern matches an empty text")
    if not find:
        return flat.select(*KEY, "surface", F.array().cast("array<struct<s:int,e:int,r:string>>").alias("edits")).limit(0)
    pattern = ("" if match_case else "(?iu)") + (find if regex else "".join(c if c.isalnum() or c.isspace() or ord(c) > 127 else "\\" + c for c in find))
    comes = replacement if regex else re.sub(r"([\\$])", r"\\\1", replacement)
    # the marks are no characters of XML, so what stands between them is what was put in
    parts = F.split(F.regexp_replace("flat", F.lit(pattern), F.lit(f"\x01{comes}\x02")), "[\x01\x02]")
    found = F.regexp_extract_all("flat", F.lit(pattern), F.lit(0))
    rows = flat.withColumns({"parts": parts, "found": found}).where(F.size("found") > 0)
    nth = F.sequence(F.lit(0), F.size("found") - 1)
    lengths = F.transform(nth, lambda k: F.struct(F.length(F.get("parts", 2 * k)).alias("gap"), F.length(F.get("found", k)).alias("n"), F.get("parts", 2 * k + 1).alias("r")))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).cast("int").alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).cast("int").alias("s"), (acc["at"] + x["gap"] + x["n"]).cast("int").alias("e"), x["r"].alias("r"))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,r:string>>").alias("out"))
    return rows.select(*KEY, "surface", F.aggregate(lengths, zero, step, lambda acc: acc["out"]).alias("edits"))


def rewritten(tree: DataFrame, edits: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """The tree after edits(doc_id, part_path, surface, edits array<struct<s,e,r>>), which lie side by side. New text has the formatting of the run in which the old began; other runs lose what was covered, and stay. own: the tree's `pieces`, where they are known. What is changed is changed in one pass."""
    tree = stored(tree, "tree")
    hit = (pieces(tree) if own is None else own).join(edits, [*KEY, "surface"]).withColumn("new", _spliced(F.col("text"), F.col("start"), F.col("edits")))
    hit = hit.where("new <> text").select(*KEY, "path", F.col("atom").alias("_atom"), F.col("new").alias("_text"))
    rows = T._held(tree, hit, "_atom", "_text").where("_at IS NULL OR (path = _at AND NOT (_atom AND _text = ''))")
    rows = rows.withColumn("_new", F.explode(F.when(F.col("_at").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    there, keep = F.exists("attrs", lambda x: x["name"] == "xml:space"), F.lit("preserve").alias("value")
    kept = F.transform("attrs", lambda x: F.when(x["name"] == "xml:space", F.struct(x["name"].alias("name"), keep, x["raw"].alias("raw"))).otherwise(x))
    spaced = F.when(there, kept).otherwise(F.array_append("attrs", F.struct(F.lit("xml:space").alias("name"), keep, F.lit("xml:space").alias("raw"))))
    own_row = {"path": F.col("path"), "kind": F.col("kind"), "name": F.when(F.col("_atom"), "w:t").otherwise(F.col("name")), "attrs": F.when(F.col("_text").rlike(r"^\s|\s$"), spaced).otherwise(F.col("attrs")), "text": F.col("text")}
    new = {"path": F.concat("path", F.array(F.lit(0.0))), "kind": F.lit("text"), "name": F.lit(None).cast("string"), "attrs": F.array().cast(ATTRIBUTES), "text": F.col("_text")}
    return rows.select(*KEY, *(F.when(F.col("_new"), new[c]).otherwise(own_row[c]).cast(tree.schema[c].dataType).alias(c) for c in new))


def replace_in_runs(tree: DataFrame, find: str, replacement: str, regex: bool = False, match_case: bool = True) -> DataFrame:
    """Replaces text in all surfaces, also where it runs over several runs; see `matches` and `rewritten`."""
    tree = stored(tree, "tree")
    own = stored(pieces(tree), "pieces")
    return rewritten(tree, matches_in(_flat(own), find, replacement, regex, match_case), own)


def split_runs(tree: DataFrame, cuts: DataFrame) -> DataFrame:
    """Splits runs at character offsets: cuts(doc_id, part_path, path, at), path being the run's and at the place in its own text. Each part has the run's properties; what is no text stays with the text before it. Offsets at the ends split nothing."""
    tree, cuts = T.roomy(tree, cuts, "path")
    own = pieces(tree).withColumn("path_", F.col("path")).withColumn("path", F.col("run"))
    lengths = own.groupBy(*KEY, "path").agg(F.sum(F.length("text")).alias("n"), F.min("start").alias("first"))
    wanted = cuts.join(lengths, [*KEY, "path"]).where("at > 0 AND at < n").groupBy(*KEY, "path").agg(F.array_sort(F.collect_set(F.col("at").cast("int"))).alias("cuts"), F.max("n").cast("int").alias("n"), F.max("first").alias("first"))
    gaps = T._gaps(tree).select(F.col("_d").alias("doc_id"), F.col("_part").alias("part_path"), F.col("_at").alias("path"), (F.coalesce("_after", F.col("_own") + 1) - F.col("_own")).alias("gap"))
    bounds = F.concat(F.array(F.lit(0)), F.col("cuts"), F.array(F.col("n")))
    wanted = stored(wanted.join(gaps, [*KEY, "path"]).select(*KEY, F.col("path").alias("_run"), "first", "gap", bounds.alias("bounds")), "cuts")
    part = lambda j: F.concat(F.slice("_run", 1, F.size("_run") - 1), F.array(F.element_at("_run", -1) + F.col("gap") * j / (F.size("bounds") - 1)))
    chosen = wanted.select(*KEY, F.col("_run").alias("path"))
    inside = T._prefixes(T.subtrees(tree, chosen)).join(wanted.withColumn("_up", F.col("_run")), [*KEY, "_up"]).drop("_up")
    kid = F.when(F.size("path") > F.size("_run"), F.slice("path", 1, F.size("_run") + 1))
    spans = own.select(*KEY, F.col("path_").alias("_kid"), (F.col("start")).alias("_start"), F.length("text").alias("_n"), "text", "atom").withColumnRenamed("text", "_whole")
    # what is no text stands where the text before it ends
    inside = inside.withColumn("_kid", kid)
    names = tree.select(*KEY, F.col("path").alias("_kid"), F.col("name").alias("_kname"))
    inside = inside.join(names, [*KEY, "_kid"], "left").join(spans, [*KEY, "_kid"], "left")
    ends = F.max(F.col("_start") + F.col("_n")).over(Window.partitionBy(*KEY, "_run").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    a = F.coalesce(F.col("_start"), ends, F.col("first")) - F.col("first")
    inside = inside.withColumn("a", a).withColumn("b", F.col("a") + F.coalesce("_n", F.lit(0)))
    everywhere = F.col("_kid").isNull() | (F.col("_kname") == "w:rPr")
    many = F.size("bounds") - 2  # the last part's number
    low, high = (lambda j: F.get("bounds", j)), (lambda j: F.get("bounds", j + 1))
    held = lambda j: F.when(F.col("a") == F.col("b"), ((low(j) < F.col("a")) | (j == 0)) & (F.col("a") <= high(j))).otherwise((F.col("a") < high(j)) & (F.col("b") > low(j)))
    js = F.filter(F.sequence(F.lit(0), many), lambda j: everywhere | held(j))
    rows = inside.withColumn("_j", F.explode(js))
    cut = F.substring("_whole", F.greatest(low(F.col("_j")) - F.col("a"), F.lit(0)) + 1, F.least(high(F.col("_j")), F.col("a") + F.col("_n")) - F.greatest(low(F.col("_j")), F.col("a")))
    broken = (F.col("_kname") == "w:t") & ~F.col("atom") & ((F.col("a") < low(F.col("_j"))) | (F.col("a") + F.col("_n") > high(F.col("_j"))))
    first_text = F.row_number().over(Window.partitionBy(*KEY, "_kid", "_j", "kind").orderBy("path")) == 1
    rows = rows.withColumn("_broken", F.coalesce(broken, F.lit(False))).withColumn("_1", first_text).where("NOT _broken OR kind = 'element' OR (kind = 'text' AND _1)")
    keep = F.array(F.struct(F.lit("xml:space").alias("name"), F.lit("preserve").alias("value"), F.lit("xml:space").alias("raw"))).cast(ATTRIBUTES)
    others = F.filter("attrs", lambda x: x["name"] != "xml:space")
    new = rows.select(
        *KEY, F.concat(part(F.col("_j")), F.slice("path", F.size("_run") + 1, F.greatest(F.size("path") - F.size("_run"), F.lit(0)))).alias("path"), "kind", "name",
        F.when(F.col("_broken") & (F.col("name") == "w:t"), F.concat(others, keep)).otherwise(F.col("attrs")).alias("attrs"), F.when(F.col("_broken") & (F.col("kind") == "text"), cut).otherwise(F.col("text")).alias("text"),
    )
    return T.remove(tree, chosen).unionByName(new)


def _cut(tree: DataFrame, ranges: DataFrame) -> DataFrame:
    """The tree with runs split at both ends of ranges(doc_id, part_path, surface, start, end); a range that is not inside its surface is an error."""
    own = stored(pieces(tree), "pieces")
    total = own.groupBy(*KEY, "surface").agg(F.max(F.col("start") + F.length("text")).alias("n"))
    checked = ranges.join(total, [*KEY, "surface"], "left")
    wrong = (F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.coalesce("n", F.lit(0)))
    checked = checked.where(F.when(wrong, F.raise_error(F.lit("a range that is not in its text")).cast("boolean")).otherwise(True)).drop("n")
    spans = own.groupBy(*KEY, "surface", "run").agg(F.min("start").alias("_a"), F.max(F.col("start") + F.length("text")).alias("_b"))
    ends = checked.select(*KEY, "surface", F.explode(F.array("start", "end")).alias("_at")).distinct()
    cuts = spans.join(ends, [*KEY, "surface"]).where("_at > _a AND _at < _b").select(*KEY, F.col("run").alias("path"), (F.col("_at") - F.col("_a")).alias("at"))
    return stored(split_runs(tree, cuts), "tree")


def _around(tree: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """Puts an element around neighbouring siblings: chosen(doc_id, part_path, path, id, author, date). What stands next to each other with one id comes into one element."""
    siblings = tree.where(F.size("path") > 1).select(*KEY, "path", _up().alias("_p")).join(chosen.select(*KEY, _up().alias("_p")).distinct(), [*KEY, "_p"], "left_semi")
    place = F.row_number().over(Window.partitionBy(*KEY, "_p").orderBy("path"))
    rows = siblings.withColumn("_n", place).join(chosen, [*KEY, "path"])
    rows = rows.withColumn("_island", F.col("_n") - F.row_number().over(Window.partitionBy(*KEY, "_p", "id").orderBy("path")))
    w = Window.partitionBy(*KEY, "_p", "id", "_island").orderBy("path")
    rows = stored(rows.withColumn("_shell", F.first("path").over(w)).withColumn("_k", (F.row_number().over(w) - 1).cast("double")), "islands")
    shells = rows.where("_k = 0").select(*KEY, "path", F.lit("element").alias("kind"), F.lit(name).alias("name"), T.attribute_list(w_id=F.col("id"), w_author=F.col("author"), w_date=F.col("date")).alias("attrs"), F.lit(None).cast("string").alias("text"))
    moves = rows.select(*KEY, "path", F.concat("_shell", F.array("_k")).alias("new_path"))
    return T._repathed(tree, moves).unionByName(shells)


def delete_text(tree: DataFrame, ranges: DataFrame, kind: str = "w:del") -> DataFrame:
    """Deletes text as a tracked change: ranges(doc_id, part_path, surface, start, end, id, author, date). Runs are split at the ends and keep their properties; neighbours come into one mark. kind w:moveFrom marks text that was moved away. An empty range changes nothing."""
    tree = stored(tree, "tree")
    ranges = stored(ranges, "ranges")
    tree = _cut(tree, ranges)
    spans = pieces(tree).groupBy(*KEY, "surface", "run").agg(F.min("start").alias("_a"), F.max(F.col("start") + F.length("text")).alias("_b"))
    chosen = spans.join(ranges, [*KEY, "surface"]).where("_a >= start AND _b <= end AND _b > _a").select(*KEY, F.col("run").alias("path"), "id", "author", "date")
    chosen = stored(chosen, "chosen")
    texts = T.children(tree, chosen, "w:t").select(*KEY, "path", F.lit(True).alias("_gone"))
    tree = tree.join(texts, [*KEY, "path"], "left").withColumn("name", F.when(F.col("_gone"), "w:delText").otherwise(F.col("name"))).select(*TREE)
    return _around(stored(tree, "tree"), chosen, kind)


def insert_text(tree: DataFrame, places: DataFrame, kind: str = "w:ins") -> DataFrame:
    """Inserts text as a tracked change: places(doc_id, part_path, surface, position, text, id, author, date). The new run stands between the halves of the one it comes into, without properties; in a surface without runs it comes last. kind w:moveTo marks text that was moved here."""
    tree = stored(tree, "tree")
    places = stored(places, "places")
    tree = _cut(tree, places.select(*KEY, "surface", F.col("position").alias("start"), F.col("position").alias("end")))
    spans = pieces(tree).groupBy(*KEY, "surface", "run").agg(F.min("start").alias("_a"), F.max(F.col("start") + F.length("text")).alias("_b"))
    near = places.join(spans, [*KEY, "surface"], "left")
    behind = F.max(F.when(F.col("_b") <= F.col("position"), F.col("run")))
    first = F.min("run")
    spot = near.groupBy(*KEY, "surface", "position", "text", "id", "author", "date").agg(behind.alias("_after"), first.alias("_first"))
    inner = element("w:r", element("w:t", escape_xml(F.col("text")), xml_space="preserve"))
    edits = spot.select(
        *KEY, F.coalesce("_after", "_first", "surface").alias("path"), F.when(F.col("_after").isNotNull(), "after").when(F.col("_first").isNotNull(), "before").otherwise("last").alias("where"), "id",
        element(kind, inner, w_id=F.col("id"), w_author=F.col("author"), w_date=F.col("date")).alias("xml"),
    )
    return T.insert(tree, edits, ["id"])


def move_text(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves text between surfaces as tracked changes: moves(doc_id, part_path, surface, start, end, to, position, id, author, date); `to` is another surface of the part, and the mark there has the id id + 1. A move inside one surface is an error."""
    tree = stored(tree, "tree")
    same = F.when(F.col("to") == F.col("surface"), F.raise_error(F.lit("text can't be moved inside its own surface")).cast("boolean")).otherwise(True)
    moves = stored(moves.where(same), "moves")
    flat = pieces(tree).groupBy(*KEY, "surface").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "").alias("_flat"))
    texts = moves.join(flat, [*KEY, "surface"]).withColumn("text", F.substring("_flat", F.col("start") + 1, F.col("end") - F.col("start")))
    places = stored(texts.select(*KEY, F.col("to").alias("surface"), "position", "text", (F.col("id") + 1).alias("id"), "author", "date"), "places")
    return insert_text(delete_text(tree, moves.drop("to", "position"), "w:moveFrom"), places, "w:moveTo")
