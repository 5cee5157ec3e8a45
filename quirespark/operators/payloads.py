"""The XML that an operation of a log brings, from its payload, and where among its parent's children it goes."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

#: Properties of runs and paragraphs in the order in which they stand: (element, {payload field: attribute}); an attribute of None is a mark that is there or not.
RUN_PROPERTIES = (
    ("w:rFonts", {"fontAscii": "w:ascii", "fontEastAsia": "w:eastAsia", "fontHAnsi": "w:hAnsi", "fontHint": "w:hint", "fontAsciiTheme": "w:asciiTheme", "fontEastAsiaTheme": "w:eastAsiaTheme", "fontHAnsiTheme": "w:hAnsiTheme"}),
    ("w:b", {"bold": None}), ("w:bCs", {"boldCs": None}), ("w:i", {"italic": None}), ("w:iCs", {"italicCs": None}), ("w:color", {"color": "w:val"}), ("w:sz", {"sizeHalfPoints": "w:val"}), ("w:szCs", {"sizeCsHalfPoints": "w:val"}),
    ("w:u", {"underline": "w:val"}), ("w:vertAlign", {"vertAlign": "w:val"}),
)
PARAGRAPH_PROPERTIES = (
    ("w:spacing", {"spacingBefore": "w:before", "spacingAfter": "w:after", "spacingLine": "w:line", "spacingLineRule": "w:lineRule"}),
    ("w:ind", {"indentLeft": "w:left", "indentRight": "w:right", "indentFirstLineChars": "w:firstLineChars", "indentFirstLine": "w:firstLine", "indentHangingChars": "w:hangingChars", "indentHanging": "w:hanging"}),
    ("w:jc", {"alignment": "w:val"}),
)
SECTION_PROPERTIES = (
    ("w:type", {"sectionType": "w:val"}), ("w:pgSz", {"pageWidth": "w:w", "pageHeight": "w:h", "orientation": "w:orient", "pageSizeCode": "w:code"}),
    ("w:pgMar", {"marginTop": "w:top", "marginRight": "w:right", "marginBottom": "w:bottom", "marginLeft": "w:left", "marginHeader": "w:header", "marginFooter": "w:footer", "marginGutter": "w:gutter"}),
    ("w:cols", {"columnCount": "w:num", "columnSpace": "w:space"}), ("w:docGrid", {"docGridType": "w:type", "docGridLinePitch": "w:linePitch"}),
)
ATOMS = {"insertTab": "w:tab", "insertBreak": "w:br", "insertNoBreakHyphen": "w:noBreakHyphen"}


def tag(name: str, inner: str = "", **attrs: object) -> str:
    """An element; attributes are named with _ for the colon, and those that are None are left out."""
    return _tag(name, inner, {k.replace("_", ":", 1): v for k, v in attrs.items()})


def _tag(name: str, inner: str, attrs: dict) -> str:
    written = "".join(f" {k}={quoteattr(str(v))}" for k, v in attrs.items() if v is not None)
    return f"<{name}{written}>{inner}</{name}>" if inner else f"<{name}{written}/>"


def properties(table: tuple, payload: dict) -> str:
    """The elements of a table for which the payload has a field."""
    out = []
    for name, fields in table:
        values = {a: payload.get(f) for f, a in fields.items()}
        if None in values:
            out.append(f"<{name}/>" if values[None] is True else "")
        elif any(v is not None for v in values.values()):
            out.append(_tag(name, "", values))
    return "".join(out)


def run(r: dict) -> str:
    marks = properties(RUN_PROPERTIES, r)
    text = tag("w:t", escape(r["text"]), xml_space="preserve" if r.get("preserveSpace") else None)
    return tag("w:r", (f"<w:rPr>{marks}</w:rPr>" if marks else "") + text, w_rsidR=r.get("rsidR"), w_rsidRPr=r.get("rsidRPr"))


def marker(m: dict) -> str:
    return _tag(f"w:{m['localName']}", "", {(f"{a['prefix']}:" if a.get("prefix") else "") + a["localName"]: a["value"] for a in m["attributes"]})


def inline(item: dict) -> str:
    """A run, a marker or a hyperlink of a paragraph's content."""
    if item["kind"] != "hyperlink":
        return (run if item["kind"] == "run" else marker)(item[item["kind"]])
    link = item["hyperlink"]
    inner = "".join(map(inline, link["items"])) if link.get("items") is not None else "".join(map(run, link["runs"]))
    return tag("w:hyperlink", inner, r_id=link["relationshipId"]) if link["targetKind"] == "external" else tag("w:hyperlink", inner, w_anchor=link["target"])


def paragraph(p: dict, content: str | None = None, last: str = "") -> str:
    """A paragraph with its text as one run, or with the content given; `last` is what its properties end with."""
    number = properties((("w:ilvl", {"numLevel": "w:val"}), ("w:numId", {"numId": "w:val"})), p)
    marks = properties(RUN_PROPERTIES, p.get("paragraphMarkRun") or {})
    head = (tag("w:pStyle", w_val=p["styleId"]) if p.get("styleId") else "") + (f"<w:numPr>{number}</w:numPr>" if number else "") + properties(PARAGRAPH_PROPERTIES, p) + (f"<w:rPr>{marks}</w:rPr>" if marks else "") + last
    body = tag("w:r", tag("w:t", escape(p.get("text", "")))) if content is None else content
    return tag("w:p", (f"<w:pPr>{head}</w:pPr>" if head else "") + body, w14_paraId=p.get("paraId") or None, w14_textId=p.get("textId"), w_rsidR=p.get("rsidR"), w_rsidRPr=p.get("rsidRPr"), w_rsidRDefault=p.get("rsidRDefault"), w_rsidP=p.get("rsidP"))


def table(t: dict) -> str:
    rows, columns = t["rows"], t["columns"]
    for grid in (t.get("cells"), t.get("richCells"), t.get("cellIds")):
        if grid is not None and (len(grid) != rows or any(len(r) != columns for r in grid)):
            raise ValueError("a table's cells are not rows x columns")

    def cell(r: int, c: int) -> str:
        rich = t["richCells"][r][c] if t.get("richCells") else None
        if not rich:
            return paragraph({"text": t["cells"][r][c] if t.get("cells") else ""})
        content = lambda p: "".join(map(inline, p["items"])) if p.get("items") is not None else "".join(map(run, p["runs"])) if p.get("runs") is not None else None
        return "".join(paragraph(p["paragraph"], content(p)) for p in rich)

    of = lambda ids, *at: (ids[at[0]] if len(at) == 1 else ids[at[0]][at[1]]) or None if ids else None
    body = "".join(tag("w:tr", "".join(tag("w:tc", cell(r, c), w14_textId=of(t.get("cellIds"), r, c)) for c in range(columns)), w14_textId=of(t.get("rowIds"), r)) for r in range(rows))
    return tag("w:tbl", f"<w:tblGrid>{'<w:gridCol/>' * columns}</w:tblGrid>" + body, w14_textId=t.get("tableId") or None)


def section(s: dict) -> str:
    refs = "".join(tag(f"w:{place}Reference", w_type=x["type"], r_id=x["relationshipId"]) for place in ("header", "footer") for x in s.get(f"{place}References") or [])
    return tag("w:sectPr", refs + properties(SECTION_PROPERTIES, s), w_rsidR=s.get("rsidR"), w_rsidRPr=s.get("rsidRPr"), w_rsidSect=s.get("rsidSect"))


def style(s: dict) -> str:
    font = tag("w:rFonts", w_ascii=s["font"], w_eastAsia=s["font"]) if s.get("font") else ""
    size = tag("w:sz", w_val=s["fontSize"] * 2) if s.get("fontSize") is not None else ""
    marks = font + properties(RUN_PROPERTIES[1:6], {k: s.get(k) for k in ("bold", "italic", "color")}) + size
    return tag("w:style", tag("w:name", w_val=s.get("name") or s["styleId"]) + (f"<w:rPr>{marks}</w:rPr>" if marks else ""), w_type="paragraph", w_styleId=s["styleId"])


def brings(kind: str, p: dict, target: str | None) -> list[tuple[str, str, str | None]]:
    """What an operation brings: (parent, how, xml) each; target is the name of the element that it names.

    parent: `self` (the element named), `beside` (its parent), `body`, `styles`, `rels`, `comments`, `cell`, `pPr` or `rPr` (that
    property element of the element named). how is a step of `documents.Document.step`; several of one parent and how go there in
    their order. Without xml only what is there goes.
    """
    if kind in ("insertParagraphAfter", "insertParagraphBefore"):
        return [("beside", "after" if kind.endswith("After") else "before", paragraph(p["paragraph"]))]
    if kind in ("insertTable", "insertSiblingAfter"):
        return [("beside", "after", table(p["table"]) if kind == "insertTable" else p["nodeXML"])]
    if kind in ("appendParagraph", "appendTable", "appendBlockMarker"):
        xml = paragraph(p["paragraph"]) if kind == "appendParagraph" else table(p["table"]) if kind == "appendTable" else marker(p["marker"])
        return [("body" if p.get("in") is None else "self", "append", xml)]
    if kind in ("removeParagraph", "removeTable", "removeNode"):
        if kind == "removeTable" and target != "w:tbl":
            raise ValueError("removeTable names no table")
        return [("beside", "remove", None)]
    if kind == "wrapWithHyperlink":
        return [("beside", "wrap", tag("w:hyperlink", r_id=p["rId"]))]
    if kind == "insertNode":
        return [("self", "at", p["nodeXML"])]
    if kind == "setText":
        text = tag("w:t", escape(p["text"]))
        return [("self", "text of paragraph", tag("w:r", text)) if target == "w:p" else ("self", "text of run", text)]
    if kind == "setCellText":
        return [("cell", "content", run({"text": p["text"]}))]
    if kind in ("setSectionProperties",):
        return [("body", "section", section(p["section"])) if p.get("at") is None else ("pPr", "put w:sectPr", section(p["section"]))]
    if kind == "setParagraphStyle":
        return [("pPr", "put w:pStyle", tag("w:pStyle", w_val=p["styleId"]))] if p.get("styleId") else [("pPr", "drop w:pStyle", None)]
    if kind == "setRunFormat":
        f, out = p["format"], []
        for field, name in (("bold", "w:b"), ("italic", "w:i"), ("underline", "w:u")):
            if f.get(field) is not None:
                out.append(("rPr", f"put {name}", tag(name, w_val="single" if field == "underline" else None)) if f[field] else ("rPr", f"drop {name}", None))
        return out + [("rPr", f"put {name}", tag(name, w_val=f[field])) for field, name in (("fontSizeHalfPoints", "w:sz"), ("color", "w:color")) if f.get(field) is not None]
    if kind in ATOMS and target in ("w:r", "w:p"):
        atom = f"<{ATOMS[kind]}/>"
        return [("self", "end", atom if target == "w:r" else tag("w:r", atom))]
    if kind == "defineStyle":
        return [("styles", "end", style(p["payload"]))]
    if kind == "addRelationship":
        return [("rels", "end", tag("Relationship", Id=p["id"], Type=p["type"], Target=p["target"], TargetMode=p.get("targetMode")))]
    if kind in ("insertRun", "insertBookmark", "insertComment", "setRuns", "setParagraphContent") and target == "w:p":
        if kind == "insertRun":
            return [("self", "run at", run(p["run"]))]
        if kind == "insertBookmark":
            return [("self", "start", tag("w:bookmarkStart", w_id=p["bookmarkId"], w_name=p["name"])), ("self", "end", tag("w:bookmarkEnd", w_id=p["bookmarkId"]))]
        if kind == "insertComment":
            n = p["commentId"]
            definition = tag("w:comment", paragraph({"text": p.get("text", "")}), w_id=n, w_author=p.get("author"))
            return [("self", "start", tag("w:commentRangeStart", w_id=n)), ("self", "end", tag("w:commentRangeEnd", w_id=n)), ("self", "end", tag("w:r", tag("w:commentReference", w_id=n))), ("comments", "end", definition)]
        items = list(map(run, p["runs"])) if kind == "setRuns" else list(map(inline, p["items"]))
        return [("self", "content", x) for x in items] or [("self", "content", None)]
    raise ValueError(f"{kind} can't be done on {target}")
