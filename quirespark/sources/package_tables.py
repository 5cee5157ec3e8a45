"""More typed tables from the node table of packages: numbering, hyperlinks, bookmarks, sections, content controls, notes, properties, images, fields, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packages import _inside, attribute, relationships

DOCUMENT = "word/document.xml"


def _own(element: str, name: str) -> Column:
    """An attribute of the one `element` in a group of nodes."""
    return F.max(F.when(F.col("name") == element, attribute(name)))


def _child(element: str, name: str = "w:val") -> Column:
    """An attribute of the first `element` in a group of nodes."""
    return F.min_by(F.when(F.col("name") == element, attribute(name)), F.when(F.col("name") == element, F.col("node_id")))


def _text(condition: Column | None = None) -> Column:
    """The text of a group's text nodes in document order."""
    shown = (F.col("kind") == "text") if condition is None else (F.col("kind") == "text") & condition
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("node_id", "text")))), lambda x: x["text"]), "")


def _grouped(nodes: DataFrame, part: str, element: str):
    return _inside(nodes.where(F.col("part_path") == part), element).where("_of IS NOT NULL").groupBy("doc_id", "_of")


def numbering(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """num(doc_id, num_id, abstract_num_id) and levels(doc_id, abstract_num_id, ilvl, num_fmt, lvl_text, start)."""
    part = "word/numbering.xml"
    num = _grouped(nodes, part, "w:num").agg(_own("w:num", "w:numId").cast("int").alias("num_id"), _child("w:abstractNumId").cast("int").alias("abstract_num_id")).drop("_of")
    n = _inside(nodes.where(F.col("part_path") == part), "w:abstractNum").withColumnRenamed("_of", "_abstract")
    owner = n.where("name = 'w:abstractNum'").select("doc_id", F.col("node_id").alias("_abstract"), attribute("w:abstractNumId").cast("int").alias("abstract_num_id"))
    lvl = _inside(n.where("_abstract IS NOT NULL"), "w:lvl").where("_of IS NOT NULL").groupBy("doc_id", "_abstract", "_of")
    levels = lvl.agg(_own("w:lvl", "w:ilvl").cast("int").alias("ilvl"), _child("w:numFmt").alias("num_fmt"), _child("w:lvlText").alias("lvl_text"), _child("w:start").cast("int").alias("start"))
    return num, levels.join(owner, ["doc_id", "_abstract"]).select("doc_id", "abstract_num_id", "ilvl", "num_fmt", "lvl_text", "start")


#: Characters that make a level's text that of a bullet.
BULLETS = "•○■□◆◇▪▫●\uf0b7\uf0a7"


def bullet_lists(num: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, num_id, is_bullet): by the first level of the abstract definition alone, its format or a bullet in its text."""
    first = levels.groupBy("doc_id", "abstract_num_id").agg(F.min_by(F.struct("num_fmt", "lvl_text"), "ilvl").alias("first"))
    bullet = F.coalesce(F.col("first.num_fmt") == "bullet", F.lit(False)) | F.coalesce(F.col("first.lvl_text").rlike(f"[{BULLETS}]"), F.lit(False))
    return num.join(first, ["doc_id", "abstract_num_id"], "left").select("doc_id", "num_id", bullet.alias("is_bullet"))


def semantics(paragraphs: DataFrame, levels: DataFrame, bullets: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, level) of paragraphs as packages.paragraphs gives them.

    levels is (doc_id, id, level) of operators.styles.heading_levels, bullets that of bullet_lists. A heading's style
    says so, or one that it is based on; then come titles by the style's id (Subtitle is one), list items with their level, page
    breaks, formulas and images.
    """
    p = paragraphs.join(levels.select("doc_id", F.col("id").alias("style"), F.col("level").alias("_heading")), ["doc_id", "style"], "left")
    p = p.join(bullets.select("doc_id", "num_id", "is_bullet"), ["doc_id", "num_id"], "left")
    style = F.lower("style")
    heading = F.coalesce("_heading", heading_number(F.col("style")))  # a style without a definition counts by its id
    kind = (
        F.when(heading.isNotNull(), "heading").when(style.contains("title"), "title")
        .when(F.col("num_id").isNotNull(), F.when(F.coalesce("is_bullet", F.lit(False)), "bulletListItem").otherwise("numberedListItem"))
        .when(F.col("page_break_before"), "pageBreak").when(F.col("has_formula"), "formula").when(F.col("has_drawing"), "image").otherwise("paragraph")
    )
    return p.select("doc_id", "ord", kind.alias("kind"), F.when(heading.isNotNull(), heading).when(kind.isin("bulletListItem", "numberedListItem"), F.coalesce("ilvl", F.lit(0))).cast("int").alias("level"))


def heading_number(name: Column) -> Column:
    """1 to 9 for a name such as Heading1, null for others."""
    return F.nullif(F.regexp_extract(F.lower(name), "^heading([1-9])$", 1), F.lit("")).cast("int")


def unused_numbering(nodes: DataFrame, num: DataFrame) -> DataFrame:
    """Numbering definitions that nothing in the body, headers or footers refers to."""
    parts = F.col("part_path").rlike(r"^word/(document|header[0-9]*|footer[0-9]*)\.xml$")
    used = nodes.where(parts & (F.col("name") == "w:numId")).select("doc_id", attribute("w:val").cast("int").alias("num_id"))
    return num.select("doc_id", "num_id").join(used, ["doc_id", "num_id"], "left_anti")


def hyperlinks(nodes: DataFrame, part: str = DOCUMENT) -> DataFrame:
    """(doc_id, ord, r_id, anchor, text, url, kind): the url by the part's own relationships; links without one are internal."""
    links = _grouped(nodes, part, "w:hyperlink").agg(_own("w:hyperlink", "r:id").alias("r_id"), _own("w:hyperlink", "w:anchor").alias("anchor"), _text().alias("text"))
    rels = relationships(nodes).where(F.col("part") == part).select("doc_id", "r_id", F.col("target").alias("url"))
    rows = links.join(rels, ["doc_id", "r_id"], "left").withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("_of")) - 1)
    return rows.select("doc_id", "ord", "r_id", "anchor", "text", "url", F.when(F.col("r_id").isNotNull(), "external").otherwise("internal").alias("kind"))


def bookmarks(nodes: DataFrame) -> DataFrame:
    """(doc_id, part_path, id, name, paragraph_index) of the marks of the body, headers, footers and notes, without those inside tables.

    The index is the place among the body's own paragraphs; it is -1 for marks that stand in none of these: between
    them, in content controls and in other parts.
    """
    parts = F.col("part_path").rlike(r"^word/(document|header[0-9]*|footer[0-9]*|footnotes|endnotes)\.xml$")
    n = nodes.where(parts)
    own = (F.col("part_path") == DOCUMENT) & (F.col("name") == "w:p") & (F.size("path") == 3)
    so_far = Window.partitionBy("doc_id", "part_path").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("_count", F.sum(own.cast("int")).over(so_far) - 1).withColumn("_last", F.last(F.when(own, F.col("node_id")), ignorenulls=True).over(so_far))
    rows = n.where((F.col("name") == "w:bookmarkStart") & F.try_element_at("within", F.lit("w:tbl")).isNull())
    inside = F.try_element_at("within", F.lit("w:p"))["node_id"] == F.col("_last")
    return rows.select("doc_id", "part_path", attribute("w:id").cast("int").alias("id"), attribute("w:name").alias("name"), F.when(inside, F.col("_count")).otherwise(-1).cast("int").alias("paragraph_index"))


def comment_anchors(nodes: DataFrame, part: str = DOCUMENT) -> DataFrame:
    """(doc_id, id, paragraph_index): the paragraph of the body, those of tables and controls counted, in which each comment's range begins; the last one of a comment that begins twice."""
    n = nodes.where(F.col("part_path") == part)
    place = F.sum(F.when(F.col("name") == "w:p", 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = n.withColumn("_place", place).where((F.col("name") == "w:commentRangeStart") & F.try_element_at("within", F.lit("w:p")).isNotNull())
    return rows.groupBy("doc_id", attribute("w:id").cast("int").alias("id")).agg(F.max("_place").cast("int").alias("paragraph_index"))


def settings(nodes: DataFrame) -> DataFrame:
    """(doc_id, track_changes, even_and_odd_headers) of documents with a settings part."""
    n = nodes.where("part_path = 'word/settings.xml' AND kind = 'element'")
    on = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, ~F.coalesce(attribute("w:val"), F.lit("1")).isin("0", "false", "off"))), F.lit(False))
    return n.groupBy("doc_id").agg(on("w:trackRevisions").alias("track_changes"), on("w:evenAndOddHeaders").alias("even_and_odd_headers"))


def latent_styles(nodes: DataFrame) -> DataFrame:
    """(doc_id, name, ui_priority, semi_hidden, unhide_when_used, q_format) of the exceptions among latent styles."""
    n = nodes.where("part_path = 'word/styles.xml' AND name = 'w:lsdException'")
    on = lambda name: F.coalesce(attribute(name).isin("1", "true", "on"), F.lit(False))
    return n.select("doc_id", attribute("w:name").alias("name"), attribute("w:uiPriority").cast("int").alias("ui_priority"), on("w:semiHidden").alias("semi_hidden"), on("w:unhideWhenUsed").alias("unhide_when_used"), on("w:qFormat").alias("q_format"))


# Kinds of image files by their ending.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp", "emf": "image/x-emf", "wmf": "image/x-wmf"}


def image_type(path: Column) -> Column:
    """The media type of an image file by its ending, application/octet-stream for others."""
    kinds = F.create_map(*(F.lit(x) for pair in IMAGE_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def sections(nodes: DataFrame, part: str = DOCUMENT) -> DataFrame:
    """(doc_id, ord, width, height, landscape, columns, margins, break_type, vertical_alignment, title_page, page_start, page_format, line_numbers, references) of all sections; sizes in twips, references by kind such as header/first."""
    refs = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("name").isin("w:headerReference", "w:footerReference"), F.struct(F.concat(F.regexp_extract("name", "w:(header|footer)", 1), F.lit("/"), F.coalesce(attribute("w:type"), F.lit("default"))), attribute("r:id"))))))
    margin = lambda side: _child("w:pgMar", f"w:{side}").cast("int").alias(side)
    rows = _grouped(nodes, part, "w:sectPr").agg(
        _child("w:pgSz", "w:w").cast("int").alias("width"), _child("w:pgSz", "w:h").cast("int").alias("height"), F.coalesce(_child("w:pgSz", "w:orient") == "landscape", F.lit(False)).alias("landscape"), F.coalesce(_child("w:cols", "w:num").cast("int"), F.lit(1)).alias("columns"),
        F.struct(*(margin(x) for x in ("top", "right", "bottom", "left"))).alias("margins"), F.coalesce(_child("w:type"), F.lit("nextPage")).alias("break_type"), F.coalesce(_child("w:vAlign"), F.lit("top")).alias("vertical_alignment"),
        F.coalesce(F.bool_or(F.when(F.col("name") == "w:titlePg", ~F.coalesce(attribute("w:val"), F.lit("1")).isin("0", "false", "off"))), F.lit(False)).alias("title_page"),
        _child("w:pgNumType", "w:start").cast("int").alias("page_start"), _child("w:pgNumType", "w:fmt").alias("page_format"), _child("w:lnNumType", "w:countBy").cast("int").alias("line_numbers"), refs.alias("references"),
    )
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("_of")) - 1).drop("_of")


def controls(nodes: DataFrame, part: str = DOCUMENT) -> DataFrame:
    """(doc_id, id, tag, alias, kind, text) of content controls; what stands in a control inside another belongs to the inner one."""
    kinds = ("w:text", "w:richText", "w:dropDownList", "w:comboBox", "w:date", "w:picture", "w14:checkbox", "w:group", "w15:repeatingSection")
    kind = F.min(F.when(F.col("name").isin(*kinds), F.regexp_replace("name", "^[^:]+:", "")))
    rows = _grouped(nodes, part, "w:sdt").agg(_child("w:id").cast("int").alias("id"), _child("w:tag").alias("tag"), _child("w:alias").alias("alias"), F.coalesce(kind, F.lit("richText")).alias("kind"), _text().alias("text"))
    return rows.drop("_of")


def notes(nodes: DataFrame) -> DataFrame:
    """(doc_id, kind, id, text) of footnotes and endnotes; separators (negative ids and 0) are left out."""
    out = None
    for kind in ("footnote", "endnote"):
        rows = _grouped(nodes, f"word/{kind}s.xml", f"w:{kind}").agg(F.lit(kind).alias("kind"), _own(f"w:{kind}", "w:id").cast("int").alias("id"), _text().alias("text")).where("id > 0").drop("_of")
        out = rows if out is None else out.unionByName(rows)
    return out


def core_properties(nodes: DataFrame) -> DataFrame:
    """(doc_id, name, value) of docProps/core.xml, without prefixes."""
    n = nodes.where("part_path = 'docProps/core.xml'")
    names = n.where("kind = 'element'").select("doc_id", F.col("node_id").alias("parent_id"), F.regexp_replace("name", "^[^:]+:", "").alias("key"))
    return n.where("kind = 'text'").join(names, ["doc_id", "parent_id"]).where("key <> 'coreProperties'").select("doc_id", F.col("key").alias("name"), F.col("text").alias("value"))


def comment_threads(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, parent_id, done) of comments, by the extended part: it names paragraphs, so each comment's last one stands for it."""
    n = nodes.where("part_path = 'word/comments.xml'")
    last = _inside(n, "w:comment").where("_of IS NOT NULL").groupBy("doc_id", "_of").agg(_own("w:comment", "w:id").cast("int").alias("id"), F.max_by(F.when(F.col("name") == "w:p", attribute("w14:paraId")), F.when(F.col("name") == "w:p", F.col("node_id"))).alias("para"))
    ex = nodes.where("part_path = 'word/commentsExtended.xml' AND name = 'w15:commentEx'").select("doc_id", attribute("w15:paraId").alias("para"), attribute("w15:paraIdParent").alias("above"), (attribute("w15:done") == "1").alias("done"))
    parent = last.select("doc_id", F.col("para").alias("above"), F.col("id").alias("parent_id"))
    return last.join(ex, ["doc_id", "para"], "left").join(parent, ["doc_id", "above"], "left").select("doc_id", "id", "parent_id", F.coalesce("done", F.lit(False)).alias("done"))


def images(nodes: DataFrame, parts: DataFrame, part: str = DOCUMENT) -> DataFrame:
    """(doc_id, r_id, target, width_px, height_px, content): pixel size of the last drawing that uses an image, 0 where none does."""
    rels = relationships(nodes).where((F.col("part") == part) & F.col("type").endswith("/image"))
    n = nodes.where(F.col("part_path") == part)
    drawn = _inside(n, "w:drawing").where("_of IS NOT NULL").groupBy("doc_id", "_of").agg(_child("a:blip", "r:embed").alias("r_id"), _child("wp:extent", "cx").cast("long").alias("cx"), _child("wp:extent", "cy").cast("long").alias("cy"))
    size = drawn.groupBy("doc_id", "r_id").agg(F.max_by(F.struct("cx", "cy"), "_of").alias("s"))
    data = parts.select("doc_id", F.col("part_path").alias("_path"), "content")
    rows = rels.join(size, ["doc_id", "r_id"], "left").withColumn("_path", F.concat(F.lit("word/"), "target")).join(data, ["doc_id", "_path"], "left")
    return rows.select("doc_id", "r_id", "target", *(F.coalesce(F.floor(F.col(f"s.{k}") / 9525), F.lit(0)).cast("int").alias(c) for k, c in (("cx", "width_px"), ("cy", "height_px"))), "content")


def fields(nodes: DataFrame, part: str = DOCUMENT) -> DataFrame:
    """(doc_id, node_id, parent_id, depth, code, result, form, closed): simple fields, and those spread over runs from begin over separate to end, also inside others.

    A begin and its end stand at one depth, counted through the part, so a spread field is what stands at its depth
    between them: text of w:instrText up to its separator is the code, w:t after it the result. What an inner field
    shows belongs to the inner field alone. parent_id is the field around it. An unclosed field has closed = false.
    """
    n = nodes.where(F.col("part_path") == part)
    simple = _inside(n, "w:fldSimple").where("_of IS NOT NULL").groupBy("doc_id", F.col("_of").alias("node_id")).agg(F.trim(_own("w:fldSimple", "w:instr")).alias("code"), _text().alias("result"))
    simple = simple.select("doc_id", "node_id", F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("depth"), "code", "result", F.lit("simple").alias("form"), F.lit(True).alias("closed"))
    mark = F.when(F.col("name") == "w:fldChar", attribute("w:fldCharType"))
    inside = lambda name: F.try_element_at("within", F.lit(name)).isNotNull()
    rows = n.select("doc_id", "node_id", mark.alias("_mark"), F.when(F.col("kind") == "text", F.when(inside("w:instrText"), "code").when(inside("w:t"), "result")).alias("_place"), "text").where("_mark IS NOT NULL OR _place IS NOT NULL")
    so_far = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_d", F.sum(F.when(F.col("_mark") == "begin", 1).when(F.col("_mark") == "end", -1).otherwise(0)).over(so_far) + F.when(F.col("_mark") == "end", 1).otherwise(0)).where("_d > 0")
    level = Window.partitionBy("doc_id", "_d").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_of", F.last(F.when(F.col("_mark") == "begin", F.col("node_id")), ignorenulls=True).over(level)).withColumn("_state", F.last(F.when(F.col("_mark").isin("begin", "separate", "end"), F.col("_mark")), ignorenulls=True).over(level))
    spread = rows.groupBy("doc_id", F.col("_of").alias("node_id"), F.col("_d").alias("_d")).agg(
        F.trim(_words((F.col("_place") == "code") & (F.col("_state") == "begin"))).alias("code"), _words((F.col("_place") == "result") & (F.col("_state") == "separate")).alias("result"), F.coalesce(F.bool_or(F.col("_mark") == "end"), F.lit(False)).alias("closed")
    )
    # the field around one at depth d is the last that began before it at depth d - 1
    both = spread.withColumn("_level", F.col("_d")).withColumn("_around", F.lit(None).cast("long")).unionByName(spread.withColumn("_level", F.col("_d") + 1).withColumn("_around", F.col("node_id")))
    both = both.withColumn("parent_id", F.last("_around", ignorenulls=True).over(Window.partitionBy("doc_id", "_level").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))).where("_around IS NULL")
    spread = both.select("doc_id", "node_id", "parent_id", (F.col("_d") - 1).cast("int").alias("depth"), "code", "result", F.lit("spread").alias("form"), "closed")
    return simple.unionByName(spread)


def _words(condition: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("node_id", "text")))), lambda x: x["text"]), "")


def parsed_code(code: Column) -> Column:
    """struct<kind,argument,format,level> of a field code: SEQ, STYLEREF, REF, PAGEREF or NOTEREF; other codes are null."""
    seq = r"^SEQ\s+(\S+)((?:\s+\\\*\s+(\S+))?(?:\s+\\s\s+(\d+))?)$"
    style = r'^STYLEREF\s+("?)([^"\\]+?)\1(?:\s+\\s)?$'
    ref = r"^(REF|PAGEREF|NOTEREF)\s+(\S+)(?:\s+\\h)?$"
    part = lambda p, k: F.nullif(F.regexp_extract(code, p, k), F.lit(""))
    made = lambda kind, arg, fmt, level: F.struct(kind.alias("kind"), arg.alias("argument"), fmt.alias("format"), level.cast("int").alias("level"))
    none = F.lit(None).cast("string")
    return (
        F.when(code.rlike(seq), made(F.lit("SEQ"), part(seq, 1), part(seq, 3), part(seq, 4)))
        .when(code.rlike(style), made(F.lit("STYLEREF"), part(style, 2), none, none))
        .when(code.rlike(ref), made(part(ref, 1), part(ref, 2), none, none))
    )


def cells(nodes: DataFrame, part: str = DOCUMENT) -> DataFrame:
    """(doc_id, table_id, row, col, grid_span, v_merge, nest_depth, text); nest_depth counts the tables around a table, and text in a table inside a cell belongs to that table's cells."""
    own = lambda name, field: F.max(F.when(F.col("name") == "w:tc", F.try_element_at("within", F.lit(name))[field]))
    rows = _inside(nodes.where(F.col("part_path") == part), "w:tc").where("_of IS NOT NULL").groupBy("doc_id", "_of")
    v = F.max(F.when(F.col("name") == "w:vMerge", F.coalesce(attribute("w:val"), F.lit("continue"))))
    rows = rows.agg(F.coalesce(_child("w:gridSpan").cast("int"), F.lit(1)).alias("grid_span"), v.alias("v_merge"), own("w:tbl", "node_id").alias("table_id"), own("w:tr", "node_id").alias("_tr"), own("w:tbl", "nest").alias("nest_depth"), _text().alias("text"))
    row = (F.dense_rank().over(Window.partitionBy("doc_id", "table_id").orderBy("_tr")) - 1).alias("row")
    spans = Window.partitionBy("doc_id", "table_id", "_tr").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    col = F.coalesce(F.sum("grid_span").over(spans), F.lit(0)).cast("int").alias("col")
    return rows.select("doc_id", "table_id", row, col, "grid_span", "v_merge", "nest_depth", "text")
