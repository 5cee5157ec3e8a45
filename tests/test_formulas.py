"""Formulas, against a reading of the tree by recursion."""

import random
from xml.etree import ElementTree

from quirespark.operators import formulas as M
from quirespark.sources import packages as P

W, MATH = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/math"
NS = f'xmlns:w="{W}" xmlns:m="{MATH}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def r(text):
    return f"<m:r><m:rPr><m:sty m:val='p'/></m:rPr><m:t>{text}</m:t></m:r>"


def nodes_of(spark, body):
    data = f"<w:document {NS}><w:body>{body}</w:body></w:document>".encode()
    return P.xml_nodes(spark.createDataFrame([("d", "word/document.xml", data)], "doc_id string, part_path string, content binary"))


def made(rng, depth):
    """A random sequence of components, arguments in any order and with others between."""
    if depth == 0:
        return r(rng.choice("abcxyz"))
    out = ""
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice([*M.ARGUMENTS, "m:r", "m:m", "m:d"])
        if kind == "m:r":
            out += r(rng.choice("abc") + "&lt;")
        elif kind in ("m:m", "m:d"):
            out += f"<{kind}><m:dPr><m:chr m:val='∏'/></m:dPr><m:mr><m:e>{made(rng, depth - 1)}</m:e><m:e>{made(rng, depth - 1)}</m:e></m:mr></{kind}>"
        else:
            held = list(M.ARGUMENTS[kind]) + rng.sample(["m:e", "m:sub", "m:num"], rng.randint(0, 1))
            rng.shuffle(held)
            pr = "".join([rng.choice(["", "<m:degHide m:val='1'/>", "<m:degHide m:val='0'/>"]), rng.choice(["", "<m:chr m:val='∏'/>", "<m:chr m:val='%'/>"])])
            out += f"<{kind}><m:fPr>{pr}</m:fPr>{''.join(f'<{a}>{made(rng, depth - 1)}</{a}>' for a in held)}</{kind}>"
    return out


def read(e):
    """The plain reading of a sequence."""
    out = ""
    for c in e:
        kind = "m:" + c.tag.rpartition("}")[2]
        if kind not in M.ARGUMENTS:
            out += "".join(t.text or "" for t in c.iter(f"{{{MATH}}}t"))
            continue
        child = lambda n, c=c: next((x for x in c if x.tag == f"{{{MATH}}}{n[2:]}"), None)
        pr = {x.tag.rpartition("}")[2]: x.get(f"{{{MATH}}}val") for x in child("m:fPr")} if child("m:fPr") is not None else {}
        if kind == "m:nary":
            out += pr.get("chr") if pr.get("chr") in M.SIGNS else "∑"
        for a in M.ARGUMENTS[kind]:
            if child(a) is not None and not (a == "m:deg" and pr.get("degHide") == "1"):
                out += read(child(a))
    return out


def test_formulas_equal_a_recursive_reading(spark):
    rng = random.Random(7)
    formulas = [made(rng, k % 4) for k in range(60)]
    got = M.formula_texts(nodes_of(spark, "".join(f"<w:p><m:oMath>{f}</m:oMath></w:p>" for f in formulas))).orderBy("formula_id").collect()
    expected = [read(ElementTree.fromstring(f"<x {NS}>{f}</x>")) for f in formulas]
    assert [x["text"] for x in got] == expected


def test_components(spark):
    inner = f"<m:rad><m:radPr><m:degHide m:val='1'/></m:radPr><m:deg>{r('n')}</m:deg><m:e>{r('x')}{r('y')}</m:e></m:rad>"
    nodes = nodes_of(spark, f"<w:p><m:oMath><m:f><m:num>{inner}</m:num><m:den>{r('2')}</m:den></m:f></m:oMath></w:p>")
    rows = M.components(nodes).orderBy("node_id").collect()
    at = {x["node_id"]: x["kind"] for x in rows}
    assert [(x["kind"], at.get(x["parent_id"]), x["depth"], x["text"]) for x in rows] == [("m:f", None, 0, "xy2"), ("m:rad", "m:f", 1, "xy"), ("m:r", "m:rad", 2, "x"), ("m:r", "m:rad", 2, "y"), ("m:r", "m:f", 1, "2")]


def test_paragraphs_with_formulas(spark):
    t = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    math = lambda x: f"<m:oMath>{r(x)}</m:oMath>"
    body = (
        f"<w:p>{t('see ')}{math('d')}{t(' here')}</w:p>"
        f"<w:p><w:hyperlink>{t('link ')}{math('l')}</w:hyperlink>{t('own ')}<m:oMathPara>{math('a')}{math('b')}</m:oMathPara></w:p>"
        f"<w:p><mc:AlternateContent><mc:Choice>{t('no')}{math('no')}</mc:Choice><mc:Fallback>{t('f')}{math('g')}</mc:Fallback></mc:AlternateContent><w:fldSimple>{t('s')}</w:fldSimple></w:p>"
        "<w:p/><w:p><m:oMath/></w:p>"
    )
    rows = M.display_texts(nodes_of(spark, body)).orderBy("node_id").collect()
    assert [x["text"] for x in rows] == ["see d here", "own ablink l", "sfg", "", ""]


def test_nothing(spark):
    nodes = nodes_of(spark, "")
    assert M.formula_texts(nodes).count() == M.components(nodes).count() == M.display_texts(nodes).count() == 0


def test_parts_read_as_node_tables_do(spark):
    """Random formulas, and paragraphs in each other, in links, controls and alternate content, read in one go."""
    rng = random.Random(11)
    t = lambda: f"<w:r><w:t>{rng.choice('abc')}</w:t>{rng.choice(['', '<w:tab/>', '<w:br/>', '<w:noBreakHyphen/>', '<w:delText>gone</w:delText>'])}</w:r>"
    math = lambda: rng.choice(["<m:oMath>{}</m:oMath>", "<m:oMathPara><m:oMath>{}</m:oMath><m:oMath/></m:oMathPara>", "<w:r><m:oMath>{}</m:oMath></w:r>"]).format(made(rng, rng.randint(0, 3)))

    def inner(depth):
        out = rng.choice(["", "<w:pPr><w:tabs><w:tab w:val='left'/></w:tabs></w:pPr>"])
        for _ in range(rng.randint(0, 4)):
            kind = rng.choice(["t", "t", "m", "h", "f", "s", "a", "p"]) if depth else rng.choice("tm")
            out += {
                "t": t, "m": math, "h": lambda: f"<w:hyperlink>{inner(depth - 1)}</w:hyperlink>", "f": lambda: f"<w:fldSimple>{inner(depth - 1)}</w:fldSimple>", "s": lambda: f"<w:sdt><w:sdtContent>{inner(depth - 1)}</w:sdtContent></w:sdt>",
                "a": lambda: f"<mc:AlternateContent><mc:Choice>{inner(depth - 1)}</mc:Choice><mc:Fallback>{inner(depth - 1)}</mc:Fallback></mc:AlternateContent>", "p": lambda: f"<w:r><w:txbxContent><w:p>{inner(depth - 1)}</w:p></w:txbxContent></w:r>",
            }[kind]()
        return out

    data = [(f"d{k}", "word/document.xml", f"<w:document {NS}><w:body>{''.join(f'<w:p>{inner(3)}</w:p>' for _ in range(12))}</w:body></w:document>".encode()) for k in range(8)] + [("d0", "word/media/x.png", b"x")]
    parts = spark.createDataFrame(data, "doc_id string, part_path string, content binary")
    want, got = {}, {}
    for x in M.display_texts(P.xml_nodes(parts)).orderBy("doc_id", "node_id").collect():
        want.setdefault(x["doc_id"], []).append(x["text"])
    for x in M.texts_of_parts(parts).orderBy("doc_id", "ord").collect():
        got.setdefault(x["doc_id"], []).append(x["text"])
    assert got == want and sum(map(len, want.values())) > 96
