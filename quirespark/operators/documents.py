"""One document in a task's memory: its parts as trees, operations done on them one after the other, and the bytes of what became of them.

What a document holds are its trees; operations come and go one by one. An element's list of children is changed in
place, what it was is kept beside it: so the writer knows what is as it came, and takes that from the part's own bytes.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from ..sources.packages import PREFIXES, _Parsed
from .operations import ELEMENT_OF
from .payloads import brings
from .sequence import sequence_of

DOCUMENT = "word/document.xml"
#: Kinds that edit no list of children, or none at all.
APART = ("carryPart", "carryBinaryPart", "beginComponent", "endComponent")
#: Kinds for which the element's name decides what comes.
BY_NAME = ("setText", "insertTab", "insertBreak", "insertNoBreakHyphen", "removeTable")
#: Kinds whose element must be a paragraph, a run or a table.
ON = {"insertRun": "w:p", "insertBookmark": "w:p", "insertComment": "w:p", "setRuns": "w:p", "setParagraphContent": "w:p", "setParagraphStyle": "w:p", "setRunFormat": "w:r", "setCellText": "w:tbl"}
#: Kinds whose new element is known by its operation where it has no id of its own.
NAMED_BY_OPERATION = ("insertParagraphAfter", "insertParagraphBefore", "appendParagraph", "insertTable", "appendTable", "insertRun", "insertNode")
#: Kinds that say no element where they mean the body, or that never name one.
NEEDS_NONE = ("appendParagraph", "appendTable", "appendBlockMarker", "setSectionProperties", "defineStyle", "addRelationship", "setDocumentRoot", "setDocumentProlog")
#: Attributes by which elements are known, the first that is there counts.
IDENTITIES = ("w14:paraId", "w:bookmarkId", "w:id", "r:id", "w14:textId")
_RANKS = {name: k for k, name in enumerate(IDENTITIES)}
#: Children of a paragraph that its text replaces; "" are texts and comments.
CONTENT = frozenset(("w:r", "w:hyperlink", "w:fldSimple", "w:sdt", "w:smartTag", "w:t", ""))
#: Usual prefixes and the first of the namespaces that each stands for.
USUAL = {p: uri for uri, p in reversed(PREFIXES.items()) if p}
_OPEN = "<f " + " ".join(f'xmlns:{p}="{uri}"' for p, uri in USUAL.items()) + ">"
_ORDER = {holder: {name: k for k, name in enumerate(sequence_of(holder))} for holder in ("w:pPr", "w:rPr")}
_TAG = re.compile(rb"""<([^\s/>]+)(?:[^"'>]|"[^"]*"|'[^']*')*>""")
# what stands before the first element, as the JVM's patterns have white space and line ends
_BEFORE = re.compile(r"(<\?[^\n\r\u0085\u2028\u2029]*?\?>|<!--.*?-->|[ \t\n\x0b\f\r]|\ufeff)*", re.S)
_ENCODING = re.compile(rb"""^((?:\xef\xbb\xbf)?<\?xml[^>]*?encoding\s*=\s*["'])([^"']+)""")
_PARSED = ("kind", "name", "attrs", "text", "src_start", "src_end")

#: How many rows, or bytes of parts, are handed on at a time.
_ROWS, _BYTES = 8192, 1 << 22
#: Nodes go when their document does (`Document.drop`), so they need no collector that looks at them again and again.
_COLLECTED = 20_000


@contextmanager
def rarely_collected() -> Iterator[None]:
    before = gc.get_threshold()
    gc.set_threshold(_COLLECTED, *before[1:])
    try:
        yield
    finally:
        gc.set_threshold(*before)


def in_turn(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], done: Callable[[tuple, Iterator[dict]], Iterator[tuple]], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What `done` makes of the rows of one key after the other, in batches; rows come sorted, and `done` takes all of its own."""

    def rows() -> Iterator[tuple[tuple, dict]]:
        for batch in batches:
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                yield tuple([row[k] for k in key]), row

    every = rows()
    ahead = next(every, None)

    def own(of: tuple) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == of:
            row, ahead = ahead[1], None
            yield row
            ahead = next(every, None)

    out: list[tuple] = []
    held = 0
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
    with rarely_collected():
        while ahead is not None:
            for row in done(ahead[0], own(ahead[0])):
                out.append(row)
                held += sum([len(x) for x in row if isinstance(x, (bytes, str))])
                if len(out) >= _ROWS or held >= _BYTES:
                    yield batch_of()
                    out, held = [], 0
        if out:
            yield batch_of()


class Node:
    """A node: `was` and `had` are the children and attributes that it came with, where they have been changed; `part` is None where an operation brought it."""

    __slots__ = ("kind", "name", "attrs", "text", "children", "up", "place", "part", "start", "end", "was", "had", "dirty", "like")

    def __init__(self, kind: str, name: str | None, attrs: list, text: str | None, part: str | None = None, place: float = 0.0, start: int | None = None, end: int | None = None):
        self.kind, self.name, self.attrs, self.text, self.part, self.place, self.start, self.end = kind, name, attrs, text, part, place, start, end
        self.children: list[Node] = []
        self.up = self.was = self.had = self.like = None
        self.dirty = False

    @property
    def class_(self) -> str:
        return self.name if self.kind == "element" else ""

    @property
    def path(self) -> list[float]:
        """The places of a node and those above it, in lists that are as they came."""
        out, node = [], self
        while node is not None:
            out.append(node.place)
            node = node.up
        return out[::-1]


def identity(node: Node) -> str | None:
    """The id by which operations know a node, None if it has none."""
    found, least = None, len(IDENTITIES)
    for name, value, _ in node.attrs:
        rank = _RANKS.get(name, least)
        if rank < least:
            found, least = f"{name}={value}", rank
    return found


def _nodes(doc: str, name: str, data: bytes, placed: bool) -> list[Node]:
    """The nodes of a part in document order."""
    p = _Parsed(doc, name, data, frozenset(), _PARSED if placed else _PARSED[:4])
    attrs = list(zip(p.attribute_names, p.attribute_values, p.attribute_raws, strict=True))
    out: list[Node] = []
    stack: list[Node] = []
    add, part, none = out.append, name if placed else None, [None] * len(p.kind)
    at = 0
    for depth, kind, (called, *_), n, text, start, end in zip(p.depth, p.kind, p.names, p.attributes, p.text, p.start or none, p.end or none, strict=True):
        node = Node(kind, called, attrs[at : at + n] if n else [], text, part, 0.0, start, end)
        at += n
        del stack[depth:]
        if depth:
            node.up = up = stack[-1]
            node.place = float(len(up.children))
            up.children.append(node)
        stack.append(node)
        add(node)
    return out


def _utf8(data: bytes) -> bytes:
    """A part in another encoding as UTF-8, as that is what comes into it."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = data.decode("utf-16")
    elif (said := _ENCODING.match(data)) and said[2].lower() not in (b"utf-8", b"us-ascii"):
        text = data.decode(said[2].decode())
    else:
        return data
    return _ENCODING.sub(rb"\1UTF-8", text.encode(), count=1)


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(node.children)


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _whole(value: object) -> int | None:
    try:
        return None if value is None else int(value)
    except (TypeError, ValueError):
        return None


def _full(prefix: str | None, local: str) -> str:
    return f"{prefix}:{local}" if prefix else local


class Document:
    """A document's trees, and its operations in order: `tops` has the nodes that stand outermost in each part, `data` the parts' bytes."""

    def __init__(self, doc: str | None):
        self.doc = doc
        self.tops: dict[str, list[Node]] = {}
        self.data: dict[str, bytes] = {}
        self.nodes: dict[str, list[Node]] = {}  # of each part, as they came
        self.edited: list[Node] = []
        self.known: dict[str, Node] | None = None
        self.styles: set[str] | None = None
        self.relationships: set[tuple] = set()
        self.words: dict[int, tuple[Node, dict[str, str | None]]] = {}
        self.root_attributes: list | None = None
        self.prolog: str | None = None

    def parse(self, part: str, data: bytes, written: bool = True) -> None:
        """written: the part is to be written again, so that the places of its elements' bytes are asked for."""
        if written:
            data = self.data[part] = _utf8(data)
        self.add(part, _nodes(self.doc, part, data, written))

    def add(self, part: str, nodes: list[Node]) -> None:
        self.nodes[part] = nodes
        self.tops[part] = [n for n in nodes if n.up is None]

    def drop(self) -> None:
        """Lets the nodes go at once: as they refer to each other, they would else wait to be collected."""
        for nodes in self.nodes.values():
            for node in nodes:
                node.up = None

    def root(self, part: str) -> Node | None:
        return next((n for n in self.tops.get(part, ()) if n.kind == "element"), None)

    # names

    def _names(self) -> dict[str, Node]:
        """The nodes by their ids; of several in the trees the first in the document."""
        if self.known is None:
            self.known = {}
            for part in sorted(self.nodes, key=lambda p: (p != DOCUMENT, p)):
                for node in self.nodes[part]:
                    if node.attrs and (i := identity(node)) is not None:
                        self.known.setdefault(i, node)
        return self.known

    def find(self, name: str) -> Node:
        """The node of that id that came last."""
        node = self._names().get(name)
        if node is None:
            raise ValueError(f"no such element: {name}")
        return node

    def _name(self, op_id: str, kind: str, payload: dict, roots: list[tuple[int, Node]]) -> None:
        """New nodes get their names; of several of one operation the first by the text of its place counts."""
        mine: dict[str, Node] = {}
        for sub, root in sorted(roots, key=lambda r: str(r[0])):
            if kind == "setParagraphContent" and (run := _text(payload["items"][sub].get("runID"))) is not None:
                mine.setdefault(f"lib:{run}", root)
            for node in _walk(root):
                i = identity(node) if node.attrs else None
                if i is None and node is root and kind in NAMED_BY_OPERATION:
                    i = f"lib:{op_id}"
                if i is not None:
                    mine.setdefault(i, node)
        self._names().update(mine)

    # lists of children

    def _changes(self, node: Node) -> list[Node]:
        if node.was is None:
            node.was, node.children = node.children, list(node.children)
            self.edited.append(node)
        return node.children

    def _insert(self, node: Node, at: int, items: list[Node]) -> None:
        self._changes(node)[at:at] = items
        for x in items:
            x.up = node

    def replace(self, node: Node, at: int, gone: int, items: list[Node]) -> None:
        """Puts items in the place of so many children."""
        if gone or items:
            for x in node.children[at : at + gone]:
                x.up = None
            del self._changes(node)[at : at + gone]
            self._insert(node, at, items)

    def _set(self, node: Node, children: list[Node]) -> None:
        self._changes(node)
        for x in node.children:
            x.up = None
        node.children = children
        for x in children:
            x.up = node

    def _place(self, x: Node) -> tuple[Node, int]:
        """The element in whose list a node stands, and where."""
        if x.up is None:
            if any(x is top for tops in self.tops.values() for top in tops):
                raise ValueError("a part's root has no neighbours")
            raise ValueError(f"no such element: {x.name} that was taken out")
        return x.up, x.up.children.index(x)

    def _take(self, x: Node) -> None:
        up, at = self._place(x)
        del self._changes(up)[at]
        x.up = None

    def _at(self, node: Node, at: int | None, head: int, items: list[Node]) -> None:
        if at is None or not 0 <= at <= len(node.children) - head:
            raise ValueError("place out of range")
        self._insert(node, head + at, items)

    def step(self, node: Node, how: str, target: Node | None, at: int | None, items: list[Node]) -> None:
        """One edit of a node's children; target is the child that the edit names."""
        kids = node.children
        first = lambda name: next((k for k, x in enumerate(kids) if x.class_ == name), len(kids))
        head = 1 if kids and kids[0].class_ == "w:pPr" else 0
        if how in ("after", "before"):
            self._insert(node, kids.index(target) + (how == "after"), items)
        elif how == "remove":
            self._take(target)
        elif how == "wrap":
            place = kids.index(target)
            self._changes(node)[place : place + 1] = items
            items[0].up, target.up = node, None
            self._insert(items[0], len(items[0].children), [target])
        elif how == "append":
            self._insert(node, first("w:sectPr"), items)
        elif how == "end":
            self._insert(node, len(kids), items)
        elif how == "start":
            self._insert(node, head, items)
        elif how in ("at", "run at"):
            self._at(node, at, head if how == "run at" else 0, items)
        elif how == "text of paragraph":
            # a paragraph's text comes where the first of what it replaces stood, else before a comment's reference
            marks = lambda x: x.class_ == "w:r" and any(y.name == "w:commentReference" for y in _walk(x))
            marked = [marks(x) for x in kids]
            goes = [x.class_ in CONTENT and not m for x, m in zip(kids, marked, strict=True)]
            kept = [x for x, g in zip(kids, goes, strict=True) if not g]
            if True in goes:
                spot = goes.index(True)
            else:
                spot = marked.index(True) if True in marked else len(kept)
            self._set(node, [*kept[:spot], *items, *kept[spot:]])
        elif how == "text of run":
            self._set(node, [x for x in kids if x.class_ != "w:t"] + items)
        elif how == "content":
            self._set(node, [x for x in kids if x.class_ == "w:pPr"] + items)
        elif how == "section":
            self._set(node, [x for x in kids if x.class_ != "w:sectPr"] + items)
        elif how.startswith(("put ", "drop ")):
            # an element of a property element: the old one goes, the new one stands by the sequence
            name, order = how.rpartition(" ")[2], _ORDER[node.name]
            others = [x for x in kids if x.class_ != name]
            spot = next((k for k, x in enumerate(others) if order.get(x.class_, -1) > order.get(name, -1)), len(others))
            self._set(node, [*others[:spot], *items, *others[spot:]])
        else:
            raise ValueError(f"no such step: {how}")

    # operations

    def _fragment(self, seq: int, sub: int, xml: str) -> Node:
        nodes = _nodes(self.doc, f"+{seq}.{sub}", f"{_OPEN}{xml}</f>".encode(), False)[0].children
        if len(nodes) != 1:
            raise ValueError(f"a fragment for +{seq}.{sub} of {self.doc} must be one element")
        nodes[0].up, nodes[0].place = None, 0.0
        return nodes[0]

    def _holder(self, node: Node, name: str, make: bool) -> Node | None:
        holder = next((x for x in node.children if x.class_ == name), None)
        if holder is None and make:
            holder = Node("element", name, [], None)
            self._insert(node, 0, [holder])
        return holder

    def _cell(self, table: Node, row: int | None, column: int | None) -> Node:
        at = table
        for name, which in (("w:tr", row), ("w:tc", column), ("w:p", 0)):
            inner = [x for x in (at.children if at.was is None else at.was) if x.class_ == name]
            if which is None or not 0 <= which < len(inner):
                raise ValueError("no such cell")
            at = inner[which]
        return at

    def _list(self, parent: str, main: Node | None, how: str, payload: dict) -> Node | None:
        """The node whose children an operation edits; None where it has no effect."""
        if parent == "self":
            return main
        if parent == "beside":
            return self._place(main)[0]
        if parent == "cell":
            return self._cell(main, _whole(payload.get("row")), _whole(payload.get("column")))
        if parent in ("pPr", "rPr"):
            return self._holder(main, f"w:{parent}", how.startswith("put "))
        if parent == "body":
            root = self.root(DOCUMENT)
            found = next((x for x in root.children if x.class_ == "w:body"), None) if root else None
        else:
            found = self.root(_text(payload.get("part")) if parent == "rels" else f"word/{parent}.xml")
        if found is None and parent != "comments":
            raise ValueError(f"there is no part for {how}")
        return found

    def apply(self, seq: int, op_id: str, kind: str, payload: dict) -> None:
        """One operation; those of unknown kinds have no effect."""
        if kind not in ELEMENT_OF or kind in APART:
            return
        name = _text(payload.get(ELEMENT_OF[kind])) if ELEMENT_OF[kind] else None
        main = None if name is None else self.find(name)
        if main is None and kind not in NEEDS_NONE:
            return
        if main is not None and kind in ON and main.name != ON[kind]:
            raise ValueError(f"{kind} can't be done on {main.name}")
        if kind == "setDocumentProlog":
            self.prolog = self.prolog if payload.get("prolog") is None else _text(payload["prolog"])
            return
        if kind == "setDocumentRoot":
            self.root_attributes = self.root_attributes if payload.get("attributes") is None else payload["attributes"]
            return
        if kind == "updateAttribute":
            _, words = self.words.setdefault(id(main), (main, {}))
            words[_full(payload.get("prefix"), payload["localName"])] = _text(payload.get("value"))
            return
        if kind == "moveNode":
            self._move(main, _text(payload.get("destinationParent")), _whole(payload.get("destinationIndex") if payload.get("position") is None else payload["position"]))
            return
        if kind == "defineStyle":
            if self.styles is None:
                self.styles = {v for n in self.nodes.get("word/styles.xml", ()) if n.name == "w:style" for a, v, _ in (n.attrs if n.had is None else n.had) if a == "w:styleId"}
            style = _text(payload["payload"]["styleId"])
            if style in self.styles:
                return
            self.styles.add(style)
        if kind == "addRelationship":  # the first of its kind
            key = tuple(_text(payload.get(f)) for f in ("part", "id", "type", "target"))
            if key in self.relationships:
                return
            self.relationships.add(key)
        self._bring(seq, op_id, kind, payload, main)

    def _bring(self, seq: int, op_id: str, kind: str, payload: dict, main: Node | None) -> None:
        rows = brings(kind, payload, main.name if kind in BY_NAME else ON.get(kind))
        items = [None if xml is None else self._fragment(seq, sub, xml) for sub, (_, _, xml) in enumerate(rows)]
        if kind not in BY_NAME:
            self._name(op_id, kind, payload, [(sub, x) for sub, x in enumerate(items) if x is not None])
        at = _whole(payload.get("position"))
        # what one operation does to one list in one way is one step
        steps: dict[tuple[str, str], list[Node]] = {}
        for (parent, how, _), item in zip(rows, items, strict=True):
            steps.setdefault((parent, how), []).extend([] if item is None else [item])
        for (parent, how), new in steps.items():
            node = self._list(parent, main, how, payload)
            if node is not None:
                self.step(node, how, main if parent == "beside" else None, at, new)

    def _move(self, x: Node, to: str | None, at: int | None) -> None:
        if to is None:
            return
        node = self.find(to)
        up = node
        while up is not None:
            if up is x:
                raise ValueError("a node can't be moved into itself")
            up = up.up
        up, place = self._place(x)
        if up is not node:
            self._take(x)
            self._at(node, at, 0, [x])
            return
        # inside its list the place counts what stands there before
        if at is None or not 0 <= at <= len(node.children):
            raise ValueError("place out of range")
        self._take(x)
        self._insert(node, at - 1 if place < at else at, [x])

    # what became of it

    def finish(self) -> None:
        """Property elements that edits left empty go, attributes get the last word on each, and what stands above something that was changed is marked."""
        for node in list(self.edited):
            if node.name == "w:rPr" and not node.children and node.up is not None:
                self._take(node)
        for node, words in self.words.values():
            self._attributes(node, [(a, words.get(a, v), raw) for a, v, raw in node.attrs] + [(a, v, a) for a, v in sorted((a, v) for a, v in words.items() if v is not None and all(a != b for b, _, _ in node.attrs))])
        root = self.root(DOCUMENT)
        if self.root_attributes is not None and root is not None:
            listed = [(_full(a.get("prefix"), a["localName"]), _text(a.get("value"))) for a in self.root_attributes]
            self._attributes(root, [(a, v, a) for a, v in listed])
        for node in self.edited:
            while node is not None and not node.dirty:
                node.dirty, node = True, node.up

    def _attributes(self, node: Node, attrs: list) -> None:
        if node.had is None:
            node.had = node.attrs
            self.edited.append(node)
        node.attrs = [x for x in attrs if x[1] is not None]

    def rows(self) -> Iterator[tuple]:
        """(part_path, path, kind, name, attrs, text) of all nodes; lists that were changed have whole places."""
        for part, tops in self.tops.items():
            stack = [(top, [top.place]) for top in reversed(tops)]
            while stack:
                node, path = stack.pop()
                yield part, path, node.kind, node.name, [{"name": a, "value": v, "raw": r} for a, v, r in node.attrs], node.text
                stack += reversed([(x, [*path, x.place if node.was is None else float(k)]) for k, x in enumerate(node.children)])

    def changed(self, carried: Iterable[str] = (), alike: bool = True) -> Iterator[tuple[str, bytes]]:
        """The parts that are no longer as they came, with their bytes. alike: elements that came in are compared with all old ones, and written as such a one was."""
        likes: dict[tuple, int] = {}
        parts = [p for p in self.tops if (root := self.root(p)) is not None and root.dirty]
        first: dict[str, dict[int, Node]] = {p: {} for p in parts}
        for part in parts if alike else ():
            for node in reversed(self.nodes[part]):
                kids, attrs = node.children if node.was is None else node.was, node.attrs if node.had is None else node.had
                node.like = likes.setdefault((node.kind, node.name, node.text, tuple(attrs), tuple([x.like for x in kids])), len(likes))
                if node.kind == "element":
                    first[part][node.like] = node
        for part in self.tops:
            if part in carried:
                continue
            done = None
            if part in first:
                done = _Writer(self, part, likes, first[part] if alike else None).content()
            if part == DOCUMENT and self.prolog is not None:
                done = (self.prolog + _BEFORE.sub("", (self.data[part] if done is None else done).decode("utf-8", "replace"), count=1)).encode()
            if done is not None:
                yield part, done


class _Writer:
    """A part's bytes: what is as an element of the old part was comes from that one's bytes, wherever it stands now; of others the start tag does, where name and attributes are as they were."""

    def __init__(self, document: Document, part: str, likes: dict[tuple, int], first: dict[int, Node] | None):
        self.part, self.data, self.likes, self.first = part, document.data[part], likes, first
        self.root = document.root(part)
        self.now: dict[int, int] = {}  # what nodes that are not as they came are like now
        self.used: set[str] = set()

    def _as_came(self, node: Node) -> bool:
        return node.part is not None and not node.dirty

    def _compare(self) -> None:
        stack, order = [self.root], []
        while stack:
            node = stack.pop()
            if not self._as_came(node):
                order.append(node)
                stack += node.children
        for node in reversed(order):
            kids = tuple([x.like if self._as_came(x) else self.now[id(x)] for x in node.children])
            self.now[id(node)] = self.likes.setdefault((node.kind, node.name, node.text, tuple(node.attrs), kids), len(self.likes))

    def _source(self, node: Node) -> Node | None:
        """The old element whose bytes a node is written with."""
        if node.kind != "element":
            return None
        if self._as_came(node) and node.part == self.part:
            return node
        if self.first is None:
            return None
        return self.first.get(node.like if self._as_came(node) else self.now[id(node)])

    def content(self) -> bytes | None:
        """None where nothing has changed."""
        root, data = self.root, self.data
        if self.first is not None:
            self._compare()
            if self.now[id(root)] == root.like:
                return None
        out: list[bytes] = []
        stack: list[Node | bytes] = [root]
        while stack:
            node = stack.pop()
            if isinstance(node, bytes):
                out.append(node)
            elif (old := self._source(node)) is not None:
                out.append(data[old.start : old.end])
            elif node.kind == "element":
                was = node.children if node.was is None else node.was
                if node.part == self.part and node.had is None and was:
                    tag = _TAG.match(data, node.start)
                    out.append(tag[0])
                    end = b"</%s>" % tag[1]
                else:
                    _use(node, self.used)
                    out.append(_tag(node).encode())
                    end = f"</{node.name}>".encode() if node.children else b""
                if end:
                    stack.append(end)
                stack += reversed(node.children)
            else:
                if node.kind == "written":
                    self.used.update(node.attrs)
                out.append(_plain(node).encode())
        # a start tag that stays declares the prefixes that new elements bear, a new one those in use
        kept = root.had is None and bool(root.children if root.was is None else root.was)
        bound = {a for a, _, _ in root.attrs}
        more = "".join(f' xmlns:{p}="{USUAL[p]}"' for p in sorted(self.used) if f"xmlns:{p}" not in bound).encode()
        if more:
            at = len(out[0]) - 1 if kept else 1 + len(root.name.encode())
            out[0] = out[0][:at] + more + out[0][at:]
        return data[: root.start] + b"".join(out) + data[root.end :]


def _use(node: Node, used: set[str]) -> None:
    """Notes the usual prefixes in the names of an element and its attributes."""
    for name in (node.name, *[a for a, _, _ in node.attrs]):
        prefix, colon, _ = name.partition(":")
        if colon and prefix in USUAL:
            used.add(prefix)


def _tag(node: Node, empty: bool | None = None) -> str:
    written = "".join([f' {a}="{_quoted(v)}"' for a, v, _ in node.attrs])
    return f"<{node.name}{written}{'>' if node.children and not empty else '/>'}"


def written(node: Node, children: Callable[[Node], list[Node]]) -> tuple[str, list[str]]:
    """A node with what `children` gives of each element in it as text, and the usual prefixes in use there."""
    out: list[str] = []
    used: set[str] = set()
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.kind == "element":
            kids = children(x)
            _use(x, used)
            out.append(_tag(x, not kids))
            if kids:
                stack.append(f"</{x.name}>")
                stack += reversed(kids)
        else:
            out.append(_plain(x))
    return "".join(out), sorted(used)


def as_written(text: str, used: list[str]) -> Node:
    """A node that stands for such a text."""
    return Node("written", None, used, text)


def _quoted(value: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        if a in value:
            value = value.replace(a, b)
    return value


def _plain(node: Node) -> str:
    if node.kind == "written":
        return node.text
    if node.kind == "text":
        return node.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")
    return f"<!--{node.text}-->" if node.kind == "comment" else f"<?{node.name} {node.text or ''}?>"
