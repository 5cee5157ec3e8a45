"""Edits of word-processing packages, as set operations on their trees (see `operators.tree`).

Each edit is a DataFrame with a row for every place it concerns, in any number of documents. Places come from `elements`:
the paragraphs, tables, rows, sections, styles, controls ... of a part with their paths. Whatever is set on an element
(formatting, page sizes, borders, list levels, style links, settings flags ...) is one call of `set_property` with the
element that says it; whatever comes in is an XML column made with `tree.element` and the templates below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import tree as T
from .tree import KEY, element

DOCUMENT = "word/document.xml"

#: Where the format keeps a property: the element it belongs to, the child that holds its properties, and the property's own element.
PROPERTIES = {
    "paragraph_style": ("w:p", "w:pPr", "w:pStyle"), "paragraph_alignment": ("w:p", "w:pPr", "w:jc"), "paragraph_indent": ("w:p", "w:pPr", "w:ind"), "paragraph_spacing": ("w:p", "w:pPr", "w:spacing"),
    "paragraph_borders": ("w:p", "w:pPr", "w:pBdr"), "paragraph_shading": ("w:p", "w:pPr", "w:shd"), "paragraph_numbering": ("w:p", "w:pPr", "w:numPr"), "paragraph_keep_next": ("w:p", "w:pPr", "w:keepNext"),
    "page_break_before": ("w:p", "w:pPr", "w:pageBreakBefore"), "paragraph_section": ("w:p", "w:pPr", "w:sectPr"), "list_level": ("w:numPr", None, "w:ilvl"),
    "run_bold": ("w:r", "w:rPr", "w:b"), "run_italic": ("w:r", "w:rPr", "w:i"), "run_underline": ("w:r", "w:rPr", "w:u"), "run_size": ("w:r", "w:rPr", "w:sz"), "run_color": ("w:r", "w:rPr", "w:color"), "run_font": ("w:r", "w:rPr", "w:rFonts"),
    "run_highlight": ("w:r", "w:rPr", "w:highlight"), "run_spacing": ("w:r", "w:rPr", "w:spacing"), "run_position": ("w:r", "w:rPr", "w:position"), "run_kern": ("w:r", "w:rPr", "w:kern"), "run_effect": ("w:r", "w:rPr", "w:effect"),
    "table_borders": ("w:tbl", "w:tblPr", "w:tblBorders"), "table_layout": ("w:tbl", "w:tblPr", "w:tblLayout"), "table_indent": ("w:tbl", "w:tblPr", "w:tblInd"), "table_style": ("w:tbl", "w:tblPr", "w:tblStyle"), "header_row": ("w:tr", "w:trPr", "w:tblHeader"),
    "cell_shading": ("w:tc", "w:tcPr", "w:shd"), "cell_span": ("w:tc", "w:tcPr", "w:gridSpan"), "cell_merge": ("w:tc", "w:tcPr", "w:vMerge"), "cell_borders": ("w:tc", "w:tcPr", "w:tcBorders"), "cell_width": ("w:tc", "w:tcPr", "w:tcW"),
    "page_size": ("w:sectPr", None, "w:pgSz"), "page_margins": ("w:sectPr", None, "w:pgMar"), "section_type": ("w:sectPr", None, "w:type"), "columns": ("w:sectPr", None, "w:cols"), "line_numbers": ("w:sectPr", None, "w:lnNumType"),
    "vertical_alignment": ("w:sectPr", None, "w:vAlign"), "page_numbers": ("w:sectPr", None, "w:pgNumType"), "title_page": ("w:sectPr", None, "w:titlePg"),
    "style_name": ("w:style", None, "w:name"), "style_aliases": ("w:style", None, "w:aliases"), "style_based_on": ("w:style", None, "w:basedOn"), "style_next": ("w:style", None, "w:next"), "style_link": ("w:style", None, "w:link"),
    "style_run": ("w:style", None, "w:rPr"), "style_paragraph": ("w:style", None, "w:pPr"), "table_condition": ("w:style", None, "w:tblStylePr"), "latent_styles": ("w:styles", None, "w:latentStyles"),
    "track_changes": ("w:settings", None, "w:trackRevisions"), "even_and_odd_headers": ("w:settings", None, "w:evenAndOddHeaders"), "level_override": ("w:num", None, "w:lvlOverride"), "image_line": ("pic:pic", "pic:spPr", "a:ln"), "image_effects": ("pic:pic", "pic:spPr", "a:effectLst"),
}


def elements(tree: DataFrame, name: str, part: str = DOCUMENT, depth: int | None = None) -> DataFrame:
    """(doc_id, part_path, path, ord, attrs): the elements of a name in a part, numbered from 0 in document order; with `depth` only those that stand so deep (3: the body's own)."""
    rows = tree.where((F.col("part_path") == part) & (F.col("name") == name))
    rows = rows if depth is None else rows.where(F.size("path") == depth)
    return rows.select(*KEY, "path", (F.row_number().over(Window.partitionBy(*KEY).orderBy("path")) - 1).alias("ord"), "attrs")


def value_of(name: str) -> Column:
    """The value of an attribute of an `elements` or tree row."""
    return F.get(F.filter("attrs", lambda x: x["name"] == name), 0)["value"]


def set_property(tree: DataFrame, prop: str, changes: DataFrame) -> DataFrame:
    """Sets a property of PROPERTIES: changes(doc_id, part_path, path, xml), path being the owner's and xml the property's element; null takes the property away. Owners that aren't of the right kind are an error."""
    tree = stored(tree, "tree")
    owner, holder, name = PROPERTIES[prop]
    owners = tree.where((F.col("kind") == "element") & (F.col("name") == owner)).select(*KEY, "path", F.lit(True).alias("_right"))
    checked = stored(changes.join(owners, [*KEY, "path"], "left"), "changes")
    right, others = checked.where("_right").drop("_right"), checked.where("_right IS NULL").drop("_right")
    if not others.isEmpty():
        kinds = tree.where("kind = 'element'").select(*KEY, "path", F.col("name").alias("_owner"))
        # told by the fragment's reader: a condition that raises could be asked below the join, of elements that no change names
        wrong = F.concat(F.lit(f"{T.REFUSED}{prop} belongs to {owner}, not to "), "_owner")
        right = right.unionByName(others.join(kinds, [*KEY, "path"]).withColumn("xml", wrong).drop("_owner"))
    return T.set_child(tree, right, holder, name, owner, known=True)


# Templates: XML columns of what is inserted.


def run_xml(text: Column, properties: Column | str | None = None) -> Column:
    inner = element("w:t", T.escape_xml(text), xml_space="preserve")
    return element("w:r", inner if properties is None else F.concat(element("w:rPr", properties), inner))


def paragraph_xml(text: Column, style: Column | None = None, properties: Column | None = None) -> Column:
    """A paragraph; without text it holds no run."""
    head = [F.coalesce(element("w:pStyle", w_val=style), F.lit("")) if style is not None else F.lit(""), properties if properties is not None else F.lit("")]
    head_xml = F.concat(*head)
    body = F.when(F.length(F.coalesce(text, F.lit(""))) > 0, run_xml(text)).otherwise("")
    return element("w:p", F.concat(F.when(head_xml != "", element("w:pPr", head_xml)).otherwise(""), body))


def numbering_xml(num_id: Column | int, level: Column | int = 0) -> Column:
    """The numbering of a list paragraph; levels go from 0 to 8."""
    at = level if isinstance(level, Column) else F.lit(level)
    checked = F.when((at >= 0) & (at <= 8), at).otherwise(F.raise_error(F.lit("list levels go from 0 to 8")).cast("int"))
    return element("w:numPr", F.concat(element("w:ilvl", w_val=checked), element("w:numId", w_val=num_id)))


def table_xml(rows: Column) -> Column:
    """A table of an array of rows, each an array of cell texts."""
    cell = lambda t: element("w:tc", paragraph_xml(t))
    row = lambda r: element("w:tr", F.array_join(F.transform(r, cell), ""))
    grid = F.array_join(F.transform(F.sequence(F.lit(1), F.array_max(F.transform(rows, lambda r: F.greatest(F.size(r), F.lit(1))))), lambda _: element("w:gridCol")), "")
    return element("w:tbl", F.concat(element("w:tblPr"), element("w:tblGrid", grid), F.array_join(F.transform(rows, row), "")))


def field_xml(code: Column, result: Column) -> Column:
    """A field spread over runs, wrapped in one element (unwrap it, or leave it: w:smartTag is transparent)."""
    mark = lambda kind: element("w:r", element("w:fldChar", w_fldCharType=kind))
    return element("w:smartTag", F.concat(mark("begin"), element("w:r", element("w:instrText", T.escape_xml(code), xml_space="preserve")), mark("separate"), run_xml(result), mark("end")))


def simple_field_xml(code: Column, result: Column) -> Column:
    return element("w:fldSimple", run_xml(result), w_instr=code)


def page_break_xml() -> Column:
    return element("w:p", element("w:r", element("w:br", w_type="page")))


def section_break_xml(kind: Column | str = "nextPage") -> Column:
    return element("w:p", element("w:pPr", element("w:sectPr", element("w:type", w_val=kind))))


def control_xml(number: Column, tag: Column, kind: str, content: Column, extra: Column | str = "") -> Column:
    """A content control; kind is the local name of its type element (text, richText, dropDownList, date ...), extra what stands in that."""
    head = F.concat(element("w:id", w_val=number), F.coalesce(element("w:tag", w_val=tag), F.lit("")), element(f"w:{kind}", extra))
    return element("w:sdt", F.concat(element("w:sdtPr", head), element("w:sdtContent", content)))


def checkbox_xml(number: Column, tag: Column, checked: Column) -> Column:
    box = element("w14:checkbox", element("w14:checked", w14_val=F.when(checked, "1").otherwise("0")))
    head = F.concat(element("w:id", w_val=number), element("w:tag", w_val=tag), box)
    return element("w:sdt", F.concat(element("w:sdtPr", head), element("w:sdtContent", run_xml(F.when(checked, "☒").otherwise("☐")))))


def dropdown_xml(number: Column, tag: Column, options: Column, selected: Column) -> Column:
    """A list to choose from; `selected` counts from 0."""
    items = F.array_join(F.transform(options, lambda o: element("w:listItem", w_displayText=o, w_value=o)), "")
    return control_xml(number, tag, "dropDownList", run_xml(F.element_at(options, selected + 1)), items)


def repeating_xml(number: Column, items: Column) -> Column:
    """A repeating section with an item for each text."""
    inner = F.array_join(F.transform(items, lambda t: element("w:sdt", F.concat(element("w:sdtPr", element("w15:repeatingSectionItem")), element("w:sdtContent", paragraph_xml(t))))), "")
    return element("w:sdt", F.concat(element("w:sdtPr", F.concat(element("w:id", w_val=number), element("w15:repeatingSection"))), element("w:sdtContent", inner)))


def drawing_xml(r_id: Column, width_px: Column, height_px: Column, name: Column, description: Column) -> Column:
    """A run with an image in the line; sizes in pixels."""
    cx, cy = width_px * 9525, height_px * 9525
    picture = element("pic:pic", F.concat(element("pic:blipFill", element("a:blip", r_embed=r_id)), element("pic:spPr")))
    inline = F.concat(element("wp:extent", cx=cx, cy=cy), element("wp:docPr", id="1", name=name, descr=description), element("a:graphic", element("a:graphicData", picture, uri="http://schemas.openxmlformats.org/drawingml/2006/picture")))
    return element("w:r", element("w:drawing", element("wp:inline", inline)))


def contents_xml(title: Column, low: int, high: int) -> Column:
    """A table of contents: its heading and the field that makes it."""
    code = F.lit(f'TOC \\o "{low}-{high}" \\h \\z \\u')
    return element("w:sdt", F.concat(element("w:sdtPr", element("w:docPartObj", element("w:docPartGallery", w_val="Table of Contents"))), element("w:sdtContent", F.concat(paragraph_xml(title, F.lit("TOCHeading")), element("w:p", simple_field_xml(code, F.lit("")))))))


def style_xml(style_id: Column, name: Column, based_on: Column | None = None, kind: str = "paragraph") -> Column:
    return element("w:style", F.concat(element("w:name", w_val=name), F.coalesce(element("w:basedOn", w_val=based_on), F.lit("")) if based_on is not None else F.lit("")), w_type=kind, w_styleId=style_id)


def numbering_definition_xml(abstract_id: Column, formats: Column, texts: Column) -> Column:
    """An abstract numbering definition of 1 to 9 levels, given as arrays of formats and level texts."""
    level = lambda x, i: element("w:lvl", F.concat(element("w:start", w_val="1"), element("w:numFmt", w_val=x["f"]), element("w:lvlText", w_val=x["t"])), w_ilvl=i)
    pairs = F.arrays_zip(formats.alias("f"), texts.alias("t"))
    checked = F.when(F.size(formats).between(1, 9), pairs).otherwise(F.raise_error(F.lit("a definition has 1 to 9 levels")))
    return element("w:abstractNum", F.array_join(F.transform(checked, level), ""), w_abstractNumId=abstract_id)


def num_xml(num_id: Column, abstract_id: Column) -> Column:
    return element("w:num", element("w:abstractNumId", w_val=abstract_id), w_numId=num_id)


# Edits that take more than one of the above.


def bookmark(tree: DataFrame, marks: DataFrame) -> DataFrame:
    """Bookmarks whole paragraphs: marks(doc_id, part_path, path, id, name). A name twice in a document, also with one that is there, is an error."""
    tree = stored(tree, "tree")
    names = tree.where("name = 'w:bookmarkStart'").select("doc_id", value_of("w:name").alias("name")).unionByName(marks.select("doc_id", "name"))
    twice = names.groupBy("doc_id", "name").count().where("count > 1").select("doc_id", "name", F.lit(True).alias("_twice"))
    marks = marks.join(twice, ["doc_id", "name"], "left").where(F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("there is a bookmark "), "name")).cast("boolean")).otherwise(True))
    start = marks.select(*KEY, "path", F.lit("first").alias("where"), "id", element("w:bookmarkStart", w_id=F.col("id"), w_name=F.col("name")).alias("xml"))
    end = marks.select(*KEY, "path", F.lit("last").alias("where"), "id", element("w:bookmarkEnd", w_id=F.col("id")).alias("xml"))
    return T.insert(tree, start.unionByName(end), ["id"])


def delete_bookmarks(tree: DataFrame, names: DataFrame) -> DataFrame:
    """Takes both marks of bookmarks away: names(doc_id, name)."""
    tree = stored(tree, "tree")
    starts = tree.where("name = 'w:bookmarkStart'").select(*KEY, "path", value_of("w:id").alias("_id"), value_of("w:name").alias("name")).join(names.select("doc_id", "name"), ["doc_id", "name"], "left_semi")
    ends = tree.where("name = 'w:bookmarkEnd'").select(*KEY, "path", value_of("w:id").alias("_id")).join(starts.select(*KEY, "_id"), [*KEY, "_id"], "left_semi")
    return T.remove(tree, starts.select(*KEY, "path").unionByName(ends.select(*KEY, "path")))


def comment(tree: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments on whole paragraphs: comments(doc_id, part_path, path, id, author, text); the definition goes to the comments part, which must be there."""
    tree = stored(tree, "tree")
    start = comments.select(*KEY, "path", F.lit("first").alias("where"), "id", element("w:commentRangeStart", w_id=F.col("id")).alias("xml"))
    last = F.concat(element("w:commentRangeEnd", w_id=F.col("id")), element("w:r", element("w:commentReference", w_id=F.col("id"))))
    end = comments.select(*KEY, "path", F.lit("last").alias("where"), (F.col("id") * 2).alias("id"), F.split(F.regexp_replace(last, "><w:r>", ">\u0001<w:r>"), "\u0001").alias("_parts")).select("*", F.posexplode("_parts").alias("_k", "xml"))
    end = end.select(*KEY, "path", "where", (F.col("id") + F.col("_k")).alias("id"), "xml")
    body = element("w:comment", paragraph_xml(F.col("text")), w_id=F.col("id"), w_author=F.col("author"))
    definition = comments.select("doc_id", F.lit("word/comments.xml").alias("part_path"), F.array(F.lit(0.0)).alias("path"), F.lit("last").alias("where"), "id", body.alias("xml"))
    return T.insert(tree, start.unionByName(end).unionByName(definition), ["id"])


def by_id(tree: DataFrame, ids: DataFrame, *names: str, attribute: str = "w:id") -> DataFrame:
    """The elements of these names whose id is in ids(doc_id, id): (doc_id, part_path, path, name, id)."""
    rows = tree.where(F.col("name").isin(*names)).select(*KEY, "path", "name", value_of(attribute).cast("long").alias("id"))
    return rows.join(ids.select("doc_id", F.col("id").cast("long").alias("id")).distinct(), ["doc_id", "id"], "left_semi").select(*KEY, "path", "name", "id")


def delete_comments(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """Takes comments, their ranges and references away: ids(doc_id, id)."""
    tree = stored(tree, "tree")
    return T.remove(tree, by_id(tree, ids, "w:comment", "w:commentRangeStart", "w:commentRangeEnd", "w:commentReference"))


def note(tree: DataFrame, notes: DataFrame, kind: str = "footnote") -> DataFrame:
    """Footnotes or endnotes at the end of paragraphs: notes(doc_id, part_path, path, id, text); their part must be there."""
    reference = notes.select(*KEY, "path", F.lit("last").alias("where"), "id", element("w:r", element(f"w:{kind}Reference", w_id=F.col("id"))).alias("xml"))
    body = notes.select("doc_id", F.lit(f"word/{kind}s.xml").alias("part_path"), F.array(F.lit(0.0)).alias("path"), F.lit("last").alias("where"), "id", element(f"w:{kind}", paragraph_xml(F.col("text")), w_id=F.col("id")).alias("xml"))
    return T.insert(tree, reference.unionByName(body), ["id"])


def delete_notes(tree: DataFrame, ids: DataFrame, kind: str = "footnote") -> DataFrame:
    tree = stored(tree, "tree")
    return T.remove(tree, by_id(tree, ids, f"w:{kind}", f"w:{kind}Reference"))


def relate(tree: DataFrame, rows: DataFrame, part: str = DOCUMENT) -> DataFrame:
    """New relationships of a part: rows(doc_id, r_id, type, target, mode); mode null is an internal one. Its relationship part must be there; an id twice is an error."""
    tree = stored(tree, "tree")
    folder, _, file = part.rpartition("/")
    path = f"{folder}/_rels/{file}.rels" if folder else f"_rels/{file}.rels"
    have = tree.where((F.col("part_path") == path) & (F.col("name") == "Relationship")).select("doc_id", value_of("Id").alias("r_id"), F.lit(True).alias("_have"))
    rows = rows.join(have, ["doc_id", "r_id"], "left").where(F.when(F.col("_have"), F.raise_error(F.concat(F.lit("there is a relationship "), "r_id")).cast("boolean")).otherwise(True))
    xml = element("Relationship", Id=F.col("r_id"), Type=F.col("type"), Target=F.col("target"), TargetMode=F.col("mode"))
    return T.insert(tree, rows.select("doc_id", F.lit(path).alias("part_path"), F.array(F.lit(0.0)).alias("path"), F.lit("last").alias("where"), "r_id", xml.alias("xml")), ["r_id"])


def hyperlink_xml(text: Column, r_id: Column | None = None, anchor: Column | None = None, tooltip: Column | None = None) -> Column:
    return element("w:hyperlink", run_xml(text), **{k: v for k, v in {"r_id": r_id, "w_anchor": anchor, "w_tooltip": tooltip}.items() if v is not None})


def retarget(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """New targets of relationships: changes(doc_id, part_path, r_id, target), part_path being that of the relationship part."""
    tree = stored(tree, "tree")
    rows = tree.where("name = 'Relationship'").select(*KEY, "path", value_of("Id").alias("r_id")).join(changes, [*KEY, "r_id"])
    return T.set_attributes(tree, rows.select(*KEY, "path", F.lit("Target").alias("name"), F.col("target").alias("value")))


def delete_drawings(tree: DataFrame, images: DataFrame) -> DataFrame:
    """Takes the drawings of images away: images(doc_id, part_path, r_id). Their relationship and file stay for others that use them."""
    tree = stored(tree, "tree")
    use = tree.where("name = 'a:blip'").select(*KEY, "path", value_of("r:embed").alias("r_id")).join(images.select(*KEY, "r_id"), [*KEY, "r_id"], "left_semi")
    up = use.select(*KEY, F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("path"))
    return T.remove(tree, up.join(tree.where("name = 'w:drawing'").select(*KEY, "path"), [*KEY, "path"], "left_semi"))


def resize_drawings(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """New sizes in pixels of the drawings that use an image: sizes(doc_id, part_path, r_id, width_px, height_px), null leaving one as it is."""
    tree = stored(tree, "tree")
    use = tree.where("name = 'a:blip'").select(*KEY, F.col("path").alias("_blip"), value_of("r:embed").alias("r_id")).join(sizes, [*KEY, "r_id"])
    extent = tree.where("name = 'wp:extent'").select(*KEY, "path", F.slice("path", 1, F.size("path") - 1).alias("_in"))
    up = use.withColumn("_in", F.explode(F.transform(F.sequence(F.lit(1), F.size("_blip")), lambda k: F.slice("_blip", 1, k))))
    rows = extent.join(up, [*KEY, "_in"])
    changes = [rows.select(*KEY, "path", F.lit(a).alias("name"), (F.col(c) * 9525).cast("string").alias("value")).where("value IS NOT NULL") for a, c in (("cx", "width_px"), ("cy", "height_px"))]
    return T.set_attributes(tree, changes[0].unionByName(changes[1]))


def delete_controls(tree: DataFrame, ids: DataFrame, keep_content: bool = True) -> DataFrame:
    """Takes content controls away, by default keeping what they hold: ids(doc_id, id)."""
    tree = stored(tree, "tree")
    numbers = by_id(tree, ids, "w:id", attribute="w:val").withColumn("path", F.slice("path", 1, F.size("path") - 2))
    controls = tree.where("name = 'w:sdt'").select(*KEY, "path").join(numbers.select(*KEY, "path"), [*KEY, "path"], "left_semi")
    if not keep_content:
        return T.remove(tree, controls)
    heads = T.children(tree, controls, "w:sdtPr").unionByName(T.children(tree, controls, "w:sdtEndPr")).select(*KEY, "path")
    shells = T.children(tree, controls, "w:sdtContent").select(*KEY, "path").unionByName(controls)
    return T.unwrap(T.remove(tree, heads), shells)


#: Elements that may not stand in the content of a control.
REFUSED = ("w:sectPr", "w:body", "w:document", "w:sdt")


def set_control_content(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """New content of content controls: changes(doc_id, id, xml), xml being one element that holds none of REFUSED."""
    tree = stored(tree, "tree")
    numbers = by_id(tree, changes, "w:id", attribute="w:val").select(*KEY, F.slice("path", 1, F.size("path") - 2).alias("path"), "id").join(changes.select("doc_id", F.col("id").cast("long").alias("id"), "xml"), ["doc_id", "id"])
    bad = F.col("xml").rlike("<(" + "|".join(REFUSED) + r")[\s/>]")
    checked = numbers.where(F.when(bad, F.raise_error(F.lit("the content holds an element that may not stand in a control")).cast("boolean")).otherwise(True))
    shells = T.children(tree, checked, "w:sdtContent").join(checked.withColumnRenamed("path", "parent"), [*KEY, "parent"])
    inside = T.subtrees(tree, shells).join(shells.select(*KEY, "path"), [*KEY, "path"], "left_anti")
    return T.remove(tree, inside).unionByName(T.fragments(shells.select(*KEY, F.concat("path", F.array(F.lit(0.0))).alias("new_path"), "xml")))


def merge_row_cells(tree: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges cells of a row into the first of them: merges(doc_id, part_path, path, low, high), path being the row's, low and high the numbers of its first and last cell. What the others hold goes."""
    tree = stored(tree, "tree")
    cells = tree.where("name = 'w:tc'").select(*KEY, "path", F.slice("path", 1, F.size("path") - 1).alias("_row"))
    cells = cells.withColumn("_col", F.row_number().over(Window.partitionBy(*KEY, "_row").orderBy("path")) - 1)
    hit = cells.join(merges.select(*KEY, F.col("path").alias("_row"), "low", "high"), [*KEY, "_row"]).where("_col BETWEEN low AND high")
    first = hit.where("_col = low").select(*KEY, "path", element("w:gridSpan", w_val=F.col("high") - F.col("low") + 1).alias("xml"))
    return T.set_child(T.remove(tree, hit.where("_col > low")), first, "w:tcPr", "w:gridSpan")


def merge_column_cells(tree: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges cells of a column: merges(doc_id, part_path, path, col, low, high), path being the table's, low and high its first and last row."""
    tree = stored(tree, "tree")
    rows = tree.where("name = 'w:tr'").select(*KEY, F.col("path").alias("_row"), F.slice("path", 1, F.size("path") - 1).alias("_table"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY, "_table").orderBy("_row")) - 1)
    cells = tree.where("name = 'w:tc'").select(*KEY, "path", F.slice("path", 1, F.size("path") - 1).alias("_row"))
    cells = cells.withColumn("_col", F.row_number().over(Window.partitionBy(*KEY, "_row").orderBy("path")) - 1).join(rows, [*KEY, "_row"])
    hit = cells.join(merges.select(*KEY, F.col("path").alias("_table"), "col", "low", "high"), [*KEY, "_table"]).where("_col = col AND _r BETWEEN low AND high")
    xml = F.when(F.col("_r") == F.col("low"), element("w:vMerge", w_val="restart")).otherwise(element("w:vMerge"))
    return T.set_child(tree, hit.select(*KEY, "path", xml.alias("xml")), "w:tcPr", "w:vMerge")


def _rows_gone(tree: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, part_path, path) of the rows in whose properties one of these marks stands, and of the tables that have only such rows."""
    holders = tree.where("name = 'w:trPr'").select(*KEY, F.col("path").alias("_up"))
    up = lambda n: F.slice("path", 1, F.greatest(F.size("path") - n, F.lit(0)))
    rows = marks.withColumn("_up", up(1)).join(holders, [*KEY, "_up"], "left_semi").select(*KEY, up(2).alias("path")).distinct()
    every = tree.where("name = 'w:tr'").select(*KEY, "path", up(1).alias("_table")).join(rows.withColumn("_gone", F.lit(True)), [*KEY, "path"], "left")
    tables = every.groupBy(*KEY, F.col("_table").alias("path")).agg(F.every(F.coalesce("_gone", F.lit(False))).alias("_all")).where("_all").drop("_all")
    return rows.unionByName(tables)


def settle_revisions(tree: DataFrame, accept: bool, ids: DataFrame | None = None) -> DataFrame:
    """Accepts or rejects tracked changes, all or those of ids(doc_id, id).

    Accepting keeps insertions and what was moved here, and drops deletions and what was moved away; rejecting is the
    reverse, and deleted text becomes text again. A row whose own mark is dropped goes with what is in it, and so does a
    table that has no other row. Accepted changes of formatting leave the new properties, rejected ones
    bring the old back.
    """
    tree = stored(tree, "tree")
    kinds = ("w:ins", "w:del", "w:moveFrom", "w:moveTo", "w:rPrChange", "w:pPrChange", "w:sectPrChange", "w:tblPrChange")
    marks = tree.where(F.col("name").isin(*kinds)).select(*KEY, "path", "name") if ids is None else by_id(tree, ids, *kinds).select(*KEY, "path", "name")
    stays = ("w:ins", "w:moveTo") if accept else ("w:del", "w:moveFrom")
    change = marks.where(F.col("name").endswith("Change"))
    content = marks.where(~F.col("name").endswith("Change"))
    if not accept:
        # the old properties stand in the mark: they take the place of the element around it
        old = tree.where("kind = 'element'").select(*KEY, "path", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("_mark"), F.col("name").alias("_name"))
        old = old.join(change.select(*KEY, F.col("path").alias("_mark")), [*KEY, "_mark"])
        moves = old.select(*KEY, "path", F.slice("_mark", 1, F.size("_mark") - 1).alias("_around"))
        kept = T._repathed(T.subtrees(tree, moves), moves.select(*KEY, "path", F.col("_around").alias("new_path")))
        tree = T.remove(tree, change.select(*KEY, F.slice("path", 1, F.size("path") - 1).alias("path"))).unionByName(kept)
    back = T.subtrees(tree, content.where(F.col("name").isin(*stays))).where("name IN ('w:delText', 'w:delInstrText')").select(*KEY, F.col("path"), F.lit(True).alias("_back")) if not accept else None
    gone = content.where(~F.col("name").isin(*stays)).select(*KEY, "path")
    gone = gone.unionByName(_rows_gone(tree, gone))
    tree = T.remove(tree, gone.unionByName(change.select(*KEY, "path")) if accept else gone)
    if accept and ids is None:  # of every such name: no join has to tell which
        return tree.where(~F.coalesce(F.col("name").isin(*stays), F.lit(False)))
    if back is not None:
        plain = F.when(F.col("name") == "w:delText", "w:t").otherwise("w:instrText")
        tree = tree.join(back, [*KEY, "path"], "left").withColumn("name", F.when(F.col("_back"), plain).otherwise(F.col("name"))).select(*T.TREE)
    return T.unwrap(tree, content.where(F.col("name").isin(*stays)))


def as_revision(tree: DataFrame, runs: DataFrame, kind: str) -> DataFrame:
    """Marks whole runs as deleted (del), inserted (ins) or moved (moveFrom, moveTo): runs(doc_id, part_path, path, id, author). Text of deleted and moved-away runs becomes w:delText."""
    tree = stored(tree, "tree")
    if kind in ("del", "moveFrom"):
        texts = T.children(tree, runs, "w:t").select(*KEY, "path", F.lit(True).alias("_gone"))
        tree = tree.join(texts, [*KEY, "path"], "left").withColumn("name", F.when(F.col("_gone"), "w:delText").otherwise(F.col("name"))).select(*T.TREE)
    return T.wrap(tree, runs.select(*KEY, "path", F.lit(f"w:{kind}").alias("name"), T.attribute_list(w_id=F.col("id"), w_author=F.col("author")).alias("attrs")))


def properties_as_revision(tree: DataFrame, changes: DataFrame, owner: str = "w:r") -> DataFrame:
    """New properties of runs (w:r) or paragraphs (w:p) as a tracked change: changes(doc_id, part_path, path, id, author, xml), xml being the whole new property element, without the change; what was there is kept in it."""
    tree = stored(tree, "tree")
    holder = {"w:r": "w:rPr", "w:p": "w:pPr"}[owner]
    was = T.children(tree, changes, holder)
    old = T.subtrees(tree, was)
    mark = changes.select(*KEY, F.col("path").alias("parent"), T.attribute_list(w_id=F.col("id"), w_author=F.col("author")).alias("_mark"))
    spot = F.concat("parent", F.array(F.lit(-1e9)))
    node = lambda path, name, attrs: (path.alias("path"), F.lit("element").alias("kind"), F.lit(name).alias("name"), attrs.alias("attrs"), F.lit(None).cast("string").alias("text"))
    change = mark.select(*KEY, *node(F.concat(spot, F.array(F.lit(1e9))), f"{holder}Change", F.col("_mark")))
    inner = F.concat(spot, F.array(F.lit(1e9), F.lit(0.0)))
    empty = mark.join(was.select(*KEY, "parent"), [*KEY, "parent"], "left_anti").select(*KEY, *node(inner, holder, F.array().cast("array<struct<name:string,value:string,raw:string>>")))
    moved = T._repathed(old, was.select(*KEY, "path", F.concat("parent", F.array(F.lit(-1e9), F.lit(1e9), F.lit(0.0))).alias("new_path")))
    new = T.fragments(changes.select(*KEY, F.concat("path", F.array(F.lit(-1e9))).alias("new_path"), "xml"))
    return T.remove(tree, was).unionByName(new).unionByName(change.select(*T.TREE)).unionByName(empty.select(*T.TREE)).unionByName(moved)


def new_part(parts: DataFrame, content: Column | str) -> DataFrame:
    """Part rows of (doc_id, part_path, ...) with an XML column: headers, footers, carried parts."""
    xml = content if isinstance(content, Column) else F.col(content)
    return parts.select("doc_id", "part_path", F.encode(F.concat(F.lit(T.DECLARATION), xml), "UTF-8").alias("content"))


def header_xml(text: Column, kind: str = "hdr", page_number: bool = False) -> Column:
    """A header (hdr) or footer (ftr) part of one paragraph, with the page's number behind the text if asked."""
    number = simple_field_xml(F.lit("PAGE"), F.lit("1")) if page_number else F.lit("")
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    return F.concat(F.lit(f'<w:{kind} xmlns:w="{ns}">'), element("w:p", F.concat(run_xml(text), number)), F.lit(f"</w:{kind}>"))


def refer_sections(tree: DataFrame, references: DataFrame) -> DataFrame:
    """Headers and footers of sections: references(doc_id, part_path, path, place, kind, r_id), place being header or footer and kind default, first or even; each takes the place of the section's own of that kind."""
    tree = stored(tree, "tree")
    have = tree.where("name IN ('w:headerReference', 'w:footerReference')").select(*KEY, F.col("path").alias("_old"), F.slice("path", 1, F.size("path") - 1).alias("path"), F.regexp_extract("name", "w:(header|footer)", 1).alias("place"), F.coalesce(value_of("w:type"), F.lit("default")).alias("kind"))
    old = have.join(references.select(*KEY, "path", "place", "kind"), [*KEY, "path", "place", "kind"], "left_semi").select(*KEY, F.col("_old").alias("path"))
    xml = F.when(F.col("place") == "header", element("w:headerReference", w_type=F.col("kind"), r_id=F.col("r_id"))).otherwise(element("w:footerReference", w_type=F.col("kind"), r_id=F.col("r_id")))
    return T.insert(T.remove(tree, old), references.withColumn("xml", xml).withColumn("where", F.lit("first")), ["place", "kind"])


def turned(tree: DataFrame, targets: DataFrame, landscape: bool) -> DataFrame:
    """Pages of sections lie or stand: width and height change places where they do not fit; targets(doc_id, part_path, path) of w:sectPr."""
    tree = stored(tree, "tree")
    sizes = tree.where("name = 'w:pgSz'").select(*KEY, "path", F.slice("path", 1, F.size("path") - 1).alias("_of"), value_of("w:w").cast("long").alias("_w"), value_of("w:h").cast("long").alias("_h"))
    sizes = sizes.join(targets.select(*KEY, F.col("path").alias("_of")), [*KEY, "_of"], "left_semi")
    long, short = F.greatest("_w", "_h"), F.least("_w", "_h")
    w, h = (long, short) if landscape else (short, long)
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in (("w:w", w), ("w:h", h), ("w:orient", F.lit("landscape" if landscape else "portrait")))))
    return T.set_attributes(tree, sizes.select(*KEY, "path", F.explode(pairs).alias("p")).select(*KEY, "path", "p.name", "p.value"))


def free_names(parts: DataFrame, pattern: str, template: str) -> DataFrame:
    """(doc_id, part_path): the first name of `template` (with %d) after the largest number that parts matching `pattern` (one group: the number) have."""
    n = F.coalesce(F.max(F.nullif(F.regexp_extract("part_path", pattern, 1), F.lit("")).cast("int")), F.lit(0)) + 1
    return parts.groupBy("doc_id").agg(F.format_string(template, n).alias("part_path"))
