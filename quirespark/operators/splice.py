"""A writer that keeps bytes: subtrees that are as they were come from the part's own bytes, only the rest is written anew.

Every node has a hash of its subtree: a sum over all its rows of hashes of what they are and where they stand in it, so one
aggregation gives all of them. A node of the edited tree whose hash an element of the old part has is taken over as that
element's bytes, wherever it stands now; it is clean, and what stands above a node that is not is dirty. Of dirty
elements that kept their place, name and attributes the start tag is taken over too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import tree as T
from .tree import KEY


def subtree_hashes(tree: DataFrame) -> DataFrame:
    """(doc_id, part_path, path, rows, h1, h2): of every element the number of rows in its subtree and two hashes of it, without its own place. Namespace declarations count as what they are, attributes in their order."""
    what = F.to_json(F.struct("kind", "name", "attrs", "text"))
    inner = F.slice("path", F.size("_up") + 1, F.size("path") - F.size("_up"))
    line = F.concat(F.array_join(F.transform(inner, lambda x: x.cast("string")), ","), F.lit("|"), F.col("_what"))
    rows = T._prefixes(tree.select(*KEY, "path", what.alias("_what")))
    # sums are of decimals: they neither wrap nor overflow below 2^63 rows
    mixed = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(20,0)"))
    return rows.groupBy(*KEY, F.col("_up").alias("path")).agg(F.count("*").alias("rows"), mixed(line).alias("h1"), mixed(F.lit(7), line).alias("h2"))


def _hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def spliced(parts: DataFrame, nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc_id, part_path, content) of the trees. parts are the old ones (doc_id, part_path, content), nodes their node table; a tree of a new part is written whole.

    Bytes of what no edit concerns stay, whatever quotes, spaces, entities or empty tags they are written with: each
    edit changes its own range only. What stands before and behind the root stays too. A part is one row, as large as it is.
    """
    tree = stored(tree.select(*T.TREE), "tree")
    nodes = nodes.join(tree.select(*KEY).distinct(), KEY, "left_semi").hint("merge")
    old = nodes.select(*T.TREE, "src_start", "src_end")
    before = subtree_hashes(old).join(old.where("kind = 'element'").select(*KEY, "path", "src_start", "src_end"), [*KEY, "path"])
    before = before.select(*KEY, "rows", "h1", "h2", F.col("path").alias("_old"), "src_start", "src_end").hint("merge")
    after = subtree_hashes(tree).join(tree.where("kind = 'element'").select(*KEY, "path"), [*KEY, "path"])
    # of several old elements alike, the one at the same place, else the first
    pick = F.min(F.struct((F.col("_old") != F.col("path")).alias("far"), F.col("_old"), F.col("src_start"), F.col("src_end")))
    clean = after.join(before, [*KEY, "rows", "h1", "h2"]).groupBy(*KEY, "path").agg(pick.alias("x"))
    clean = stored(clean.select(*KEY, "path", F.col("x.src_start").alias("src_start"), F.col("x.src_end").alias("src_end")), "clean")
    rest = T._held(tree, clean, "src_start", "src_end").where("_at IS NULL OR path = _at").drop("_at")
    # dirty elements whose start tag is as it was: from their first byte to that of their first child
    kids = old.where(F.size("path") > 1).groupBy(*KEY, F.slice("path", 1, F.size("path") - 1).alias("path")).agg(F.min("src_start").alias("_inner"))
    same = old.where("kind = 'element'").select(*KEY, "path", F.col("name").alias("_name"), F.col("attrs").alias("_attrs"), F.col("src_start").alias("_begin")).join(kids, [*KEY, "path"]).hint("merge")
    rest = stored(rest.join(same, [*KEY, "path"], "left").withColumn("_kept", F.coalesce((F.col("kind") == "element") & F.col("src_start").isNull() & (F.col("name") == F.col("_name")) & (F.to_json("attrs") == F.to_json("_attrs")), F.lit(False))), "dirty")
    root = old.where((F.size("path") == 1) & (F.col("kind") == "element")).select(*KEY, F.col("src_start").alias("_first"), F.col("src_end").alias("_last"), F.transform("attrs", lambda x: x["name"]).alias("_bound"))
    # beside the root stands what the old bytes before and behind it hold
    around = (F.size("path") == 1) & (F.col("kind") != "element")
    made = rest.join(root.select(*KEY, F.lit(True).alias("_known")), KEY, "left").where(F.col("src_start").isNull() & ~F.col("_kept") & ~(around & F.coalesce("_known", F.lit(False)))).select(*T.TREE)
    new = T.pieces_of(made, all_declarations=True)
    # a start tag that stays declares the prefixes that new elements bear
    names = F.create_map(*(F.lit(x) for p, uri in T.USUAL.items() for x in (p, uri)))
    root = root.join(T.used_prefixes(made), KEY, "left").withColumn("_more", F.array_join(F.transform(F.filter(F.coalesce("used", F.array().cast("array<string>")), lambda p: ~F.array_contains("_bound", F.concat(F.lit("xmlns:"), p))), lambda p: F.concat(F.lit(" xmlns:"), p, F.lit('="'), F.element_at(names, p), F.lit('"'))), "")).drop("used", "_bound")
    taken = rest.where("src_start IS NOT NULL").select(*KEY, F.struct("path", F.lit(None).cast("string").alias("s"), F.col("src_start").alias("a"), F.col("src_end").alias("b")).alias("p"))
    end = F.concat("path", F.array(F.lit(float("inf"))))
    tags = rest.where("_kept").select(*KEY, F.explode(F.array(F.struct("path", F.lit(None).cast("string").alias("s"), F.col("_begin").alias("a"), F.col("_inner").alias("b")), F.struct(end.alias("path"), F.lit("</>").alias("s"), F.col("_begin").alias("a"), F.lit(None).cast("long").alias("b")))).alias("p"))
    nothing = F.lit(None).cast("long")
    every = new.select(*KEY, F.struct(F.col("p.path").alias("path"), F.col("p.s").alias("s"), nothing.alias("a"), nothing.alias("b")).alias("p")).unionByName(taken).unionByName(tags)
    rows = every.groupBy(*KEY).agg(F.array_sort(F.collect_list("p")).alias("p")).join(parts.select(*KEY, F.col("content").alias("_content")).hint("merge"), KEY, "left").join(root.hint("merge"), KEY, "left")
    cut = lambda a, b: F.hex(F.substring("_content", (a + 1).cast("int"), (b - a).cast("int")))
    # the end tag bears the name as the start tag writes it
    written = lambda a: F.regexp_extract(F.decode(F.substring("_content", (a + 1).cast("int"), F.lit(300)), "UTF-8"), r"^<([^\s/>]+)", 1)
    opened = lambda x: F.when((F.size(x["path"]) == 1) & (F.col("_more") != "") & (x["b"] < F.col("_last")), F.concat(cut(x["a"], x["b"] - 1), _hex(F.concat("_more", F.lit(">"))))).otherwise(cut(x["a"], x["b"]))
    fresh = lambda x: x["s"].isNotNull() & x["a"].isNull()
    before_end = lambda i: F.coalesce(fresh(F.get("p", i)), F.lit(False))
    own = lambda x, i: F.when(fresh(x) & (before_end(i - 1) | before_end(i + 1)), T.short(x, i)).otherwise(x["s"])
    text = lambda x, i: F.when(x["s"].isNull(), opened(x)).when(x["a"].isNotNull(), _hex(F.concat(F.lit("</"), written(x["a"]), F.lit(">")))).otherwise(_hex(own(x, i)))
    start, stop = F.when(F.col("_first").isNull(), _hex(F.lit(T.DECLARATION))).otherwise(cut(F.lit(0), F.col("_first"))), F.when(F.col("_last").isNull(), "").otherwise(cut(F.col("_last"), F.length("_content")))
    return rows.select(*KEY, F.unhex(F.concat(start, F.array_join(F.transform("p", text), ""), stop)).alias("content"))
