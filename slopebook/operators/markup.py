"""One parse per page for all page operators (E22, E23, E24 by elements, E25).

A scan reads a page once and gives, by source offset, the translatable nodes,
the language blocks, the inside of the root element and, where asked, the
elements that rules are about.  ``scanned`` does that for a table in one Arrow
pass, no shuffle; what the operators then cut out or put in are substrings,
done in Spark.

Pages whose tags are all written plainly are cut into tags by one regular
expression (``plain_tags``); the first thing that is not plain (a stray ``<``,
an attribute that only a tolerant parser reads, an unclosed script) sends the
whole page to :class:`PageScan`, the stdlib parser.  Both give the same.
"""

from __future__ import annotations

import functools
import html
import html.parser
import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SKIP_TAGS = {"script", "style", "textarea", "noscript", "code", "svg"}
SKIP_ATTRS = ("data-no-i18n", "data-langblock")
I18N_ATTRS = ("placeholder", "title", "alt", "aria-label")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
JAPANESE = re.compile("[ぁ-ゟ゠-ヿ一-鿿]")


@dataclass(slots=True)
class Element:
    """An element by its offsets: start tag, inside, end; its text is ``texts[text:text_end]`` of the scan."""

    tag: str
    attrs: dict
    start: int
    inside: int
    text: int
    parent: Element | None
    inside_end: int | None = None
    end: int | None = None
    text_end: int | None = None
    classes: frozenset = frozenset()

    def __post_init__(self):
        names = self.attrs.get("class")
        if names:
            self.classes = frozenset(names.split())


class PageScan(html.parser.HTMLParser):
    """Everything the page operators want to know of a page, by source offset."""

    def __init__(self, text: str, root_id: str | None = None, elements: bool = False):
        super().__init__(convert_charrefs=True)
        self.text, self.root_id, self.keep = text, root_id, elements
        self.stack: list[tuple[str, bool, str | None, int, Element | None]] = []  # tag, skipped, language, start, element
        self.nodes: list[tuple[int, int, str, str]] = []  # start, end, kind, raw
        self.blocks: list[tuple[int, int, str]] = []  # start, end, language
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self.root: tuple[int, int] | None = None
        self._root_start: int | None = None
        self._root_open: list[str] = []  # the root and the elements open inside it
        self._pending: tuple[int, str] | None = None
        self.feed(text)
        self.close()

    def updatepos(self, i: int, j: int) -> int:
        """``offset`` counts from the start of the page, not of the line: all that is asked for here."""
        if j > i:
            self.offset += j - i
        return j

    def _pos(self) -> int:
        return self.offset

    def _flush(self):
        if self._pending is not None:
            start, data = self._pending
            end = self._pos()
            if JAPANESE.search(data) and not self._skipped():
                self.nodes.append((start, end, "text", data))
            if self.keep:
                self.texts.append(data)
            self._pending = None

    def _skipped(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def handle_data(self, data):
        if self._pending is None:
            self._pending = (self._pos(), data)
        else:
            self._pending = (self._pending[0], self._pending[1] + data)

    def handle_starttag(self, tag, attrs):
        self._flush()
        start = self._pos()
        raw = self.get_starttag_text() or ""
        a = dict(attrs)
        skip = self._skipped() or tag in SKIP_TAGS or any(x in a for x in SKIP_ATTRS)
        if not skip:
            for name in I18N_ATTRS:
                v = a.get(name)
                if v is not None and JAPANESE.search(v):
                    found = attribute(raw, name)
                    if found:
                        # A bare value has no quotes of its own.
                        self.nodes.append((start + found[0], start + found[1], ("attr:" if found[2] else "bare:") + name, v))
        self._root_tag(tag, a, start + len(raw))
        element = None
        if self.keep:
            element = Element(tag, a, start, start + len(raw), len(self.texts), self.stack[-1][4] if self.stack else None)
            self.elements.append(element)
        if tag not in VOID:
            self.stack.append((tag, skip, a.get("data-langblock"), start, element))
        elif element is not None:
            element.inside_end = element.end = start + len(raw)
            element.text_end = len(self.texts)

    def _root_tag(self, tag: str, attrs: dict, inside: int):
        if self.root_id is None or self.root is not None:
            return
        if self._root_start is not None:
            if tag not in VOID:
                self._root_open.append(tag)
        elif attrs.get("id") == self.root_id:
            self._root_start = inside
            if tag in VOID:
                self.root = (inside, inside)
            else:
                self._root_open = [tag]

    def handle_startendtag(self, tag, attrs):
        # The slash of a non-void element means nothing in HTML, but for text and blocks the element ends there.
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag:
            element = self.stack.pop()[4]
            if element is not None:
                element.inside_end = element.end = element.inside
                element.text_end = len(self.texts)

    def handle_endtag(self, tag):
        self._flush()
        end_start = self._pos()
        # An end tag closes the elements left open inside its own (li, p, td need no
        # end tag); one that matches nothing open is ignored.
        if self._root_start is not None and self.root is None and tag in self._root_open:
            while self._root_open.pop() != tag:
                pass
            if not self._root_open:
                self.root = (self._root_start, end_start)
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                close = self.text.find(">", end_start)
                for t, _skip, lang, start, element in self.stack[i:]:
                    stop = close + 1 if t == tag and close >= 0 else end_start
                    if lang is not None:
                        self.blocks.append((start, stop, lang))
                    if element is not None:
                        element.inside_end, element.end, element.text_end = end_start, stop, len(self.texts)
                del self.stack[i:]
                break

    def handle_comment(self, data):
        self._flush()

    def close(self):
        super().close()
        self._flush()
        if self._root_start is not None and self.root is None:
            self.root = (self._root_start, len(self.text))
        for element in self.elements:
            if element.end is None:
                element.inside_end = element.end = len(self.text)
                element.text_end = len(self.texts)

    def content(self, element: Element) -> str:
        return "".join(self.texts[element.text:element.text_end])


@functools.lru_cache(256)
def _value_of(name: str) -> re.Pattern:
    return re.compile(rf'(?i)\s{re.escape(name)}\s*=\s*("([^"]*)"|\'([^\']*)\'|([^\s>]+))')


def attribute(tag: str, name: str) -> tuple[int, int, bool] | None:
    """(start, end, quoted) of the value of ``name`` in a start tag's source."""
    m = _value_of(name).search(tag)
    if not m:
        return None
    g = 2 if m.group(2) is not None else 3 if m.group(3) is not None else 4
    return m.start(g), m.end(g), g < 4


# ---------------------------------------------------------------------------
# Plainly written pages
# ---------------------------------------------------------------------------

_WS, _NAME, _KEY = r"[ \t\n\r\f]", r"[a-zA-Z][a-zA-Z0-9:_.-]*+", r"[a-zA-Z_:@][a-zA-Z0-9_:.@-]*+"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`]++(?=[ \t\n\r\f>]|\Z))"""
_ATTRIBUTES = rf"((?:{_WS}++{_KEY}(?:{_WS}*+={_WS}*+{_VALUE})?+)*+)"
_ATTRIBUTE = re.compile(rf"{_WS}+({_KEY})(?:{_WS}*={_WS}*({_VALUE}))?")
#: Elements whose content is raw or that must hold nothing but text, up to their end tag; of others the content hangs on the parser's version.
_RAW, _TEXT_ONLY = ("script", "style"), ("title", "textarea")
_WHOLE = "|".join(_RAW + _TEXT_ONLY)
#: The text before a tag, then: a whole start tag (name, attributes, slash), end tag (name) or comment; or start tag
#: (name, attributes), content and end tag of one of ``_WHOLE``; or nothing (the page's end); or ``<`` and all the rest.
_PLAIN = re.compile(
    rf"([^<]*+)(?:(<(?:(?!(?i:{_WHOLE}|iframe|noembed|noframes|plaintext|xmp)(?:{_WS}|[/>]))({_NAME}){_ATTRIBUTES}{_WS}*+(/?)>|/({_NAME}){_WS}*+>"
    rf"|!--(?!-?>)[^-]*+(?:-(?!-)[^-]*+)*+-->))|(<((?i:{_WHOLE})){_ATTRIBUTES}{_WS}*+>)([^<]*+(?:<(?!/\s*+(?i:\8))[^<]*+)*+)(</(?i:\8){_WS}*+>)"
    r"|\Z|(<)[\s\S]*+)")
_DOCTYPE = re.compile("(?i)<!doctype[^>]*>")
#: Attributes without any of these say nothing of nodes and blocks.
_TELLING = re.compile("(?i)[ぁ-ゟ゠-ヿ一-鿿&]|data-(?:no-i18n|langblock)")


class NotPlain(ValueError):
    """A page that only the tolerant parser reads."""


def plain_tags(text: str) -> tuple[int, list[tuple[str, str, str, str, str, str]]]:
    """Where the first starts, and (text before it, source, name, attributes, slash, end tag's name) of all tags and
    comments in turn, the last one empty; :class:`NotPlain` where a page is not plain."""
    doctype = _DOCTYPE.match(text)
    begin = doctype.end() if doctype else 0
    out = []
    for data, source, name, attrs, slash, ender, opening, whole, more, content, closing, rest in _PLAIN.findall(text, begin):
        if rest:
            raise NotPlain
        if whole:
            whole = whole.lower()
            if whole in _TEXT_ONLY and "<" in content:
                raise NotPlain
            out.append((data, opening, whole, more, "", ""))
            out.append((content, closing, "", "", "", whole))
        else:
            out.append((data, source, name.lower(), attrs, slash, ender.lower()))
    return begin, out


def attributes(source: str) -> dict:
    """Attributes of a plain start tag by name; of those named twice the last."""
    out = {}
    for key, value in _ATTRIBUTE.findall(source):
        if not value:
            value = None
        else:
            if value[0] in "\"'":
                value = value[1:-1]
            if "&" in value:
                value = html.unescape(value)
        out[key.lower()] = value
    return out


def plain_scan(text: str, root_id: str | None = None) -> tuple[list, list, tuple[int, int] | None]:
    """(nodes, blocks, root) of a plain page, as :class:`PageScan` has them."""
    nodes, blocks, stack = [], [], []  # of the stack: tag, skipped, language, start
    root = root_start = None
    root_open: list[str] = []
    skip = False
    end, tags = plain_tags(text)
    for data, tag_source, tag, source, slash, ender in tags:
        start = end + len(data)
        if data and not skip:
            raw = html.unescape(data) if "&" in data else data
            if JAPANESE.search(raw):
                nodes.append((end, start, "text", raw))
        end = start + len(tag_source)
        if tag:
            inner, lang, a = skip or tag in SKIP_TAGS, None, None
            if source and (_TELLING.search(source) or (root_id is not None and root_id in source)):
                a = attributes(source)
                lang = a.get("data-langblock")
                inner = inner or any(x in a for x in SKIP_ATTRS)
                if not inner:
                    for name in I18N_ATTRS:
                        v = a.get(name)
                        if v is not None and JAPANESE.search(v):
                            found = attribute(tag_source, name)
                            if found:
                                nodes.append((start + found[0], start + found[1], ("attr:" if found[2] else "bare:") + name, v))
            if root_id is not None and root is None:
                if root_start is not None:
                    if tag not in VOID:
                        root_open.append(tag)
                elif a is not None and a.get("id") == root_id:
                    root_start = end
                    if tag in VOID:
                        root = (end, end)
                    else:
                        root_open = [tag]
            if not slash and tag not in VOID:
                stack.append((tag, inner, lang, start))
                skip = inner
        elif ender:
            if root_start is not None and root is None and ender in root_open:
                while root_open.pop() != ender:
                    pass
                if not root_open:
                    root = (root_start, start)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == ender:
                    blocks += [(begin, end if t == ender else start, lang) for t, _skip, lang, begin in stack[i:] if lang is not None]
                    del stack[i:]
                    skip = bool(stack) and stack[-1][1]
                    break
    if root_start is not None and root is None:
        root = (root_start, len(text))
    return nodes, blocks, root


class PlainElements:
    """The elements of a plain page, as :class:`PageScan` has them."""

    content = PageScan.content

    def __init__(self, text: str):
        self.text = text
        self.elements: list[Element] = []
        self.texts: list[str] = []
        elements, texts = self.elements, self.texts
        stack: list[Element] = []
        end, tags = plain_tags(text)
        for data, tag_source, tag, source, slash, ender in tags:
            start = end + len(data)
            end = start + len(tag_source)
            if data:
                texts.append(html.unescape(data) if "&" in data and not (stack and stack[-1].tag in _RAW) else data)
            if tag:
                e = Element(tag, attributes(source) if source else {}, start, end, len(texts), stack[-1] if stack else None)
                elements.append(e)
                if slash or tag in VOID:
                    e.inside_end = e.end = end
                    e.text_end = len(texts)
                else:
                    stack.append(e)
            elif ender:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == ender:
                        for e in stack[i:]:
                            e.inside_end, e.end, e.text_end = start, end if e.tag == ender else start, len(texts)
                        del stack[i:]
                        break
        for e in stack:
            e.inside_end = e.end = len(text)
            e.text_end = len(texts)


def scan(text: str, root_id: str | None = None) -> tuple[list, list, tuple[int, int] | None]:
    """(nodes, blocks, root) of a page."""
    try:
        return plain_scan(text, root_id)
    except NotPlain:
        s = PageScan(text, root_id)
        return s.nodes, s.blocks, s.root


def elements_of(text: str) -> PlainElements | PageScan:
    """The elements of a page and its text."""
    try:
        return PlainElements(text)
    except NotPlain:
        return PageScan(text, elements=True)


# ---------------------------------------------------------------------------
# The table of scans
# ---------------------------------------------------------------------------

_POS = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
NODES = T.ArrayType(T.StructType([T.StructField("node_no", T.IntegerType()), T.StructField("kind", T.StringType()), *_POS,
                                  T.StructField("raw", T.StringType())]))
BLOCKS = T.ArrayType(T.StructType([*_POS, T.StructField("lang", T.StringType())]))
ROOT = T.StructType(_POS)


def scanned(pages: DataFrame, html_col: str = "html", root_id: str | None = None) -> DataFrame:
    """``pages`` with nodes, blocks and root (offsets, see :class:`PageScan`): one parse of each page.

    A page that cannot hold any of these (no Japanese, no character reference,
    no language block, no root wanted) is not parsed.
    """
    schema = T.StructType([*pages.schema.fields, T.StructField("nodes", NODES), T.StructField("blocks", BLOCKS), T.StructField("root", ROOT)])
    at = pages.columns.index(html_col)
    types = [to_arrow_type(t) for t in (NODES, BLOCKS, ROOT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            nodes, blocks, roots = zip(*[scan_of(v, root_id) for v in batch.column(at).to_pylist()])
            numbered = [[(i, kind, a, b, raw) for i, (a, b, kind, raw) in enumerate(of)] for of in nodes]
            new = [_lists(numbered, types[0]), _lists(blocks, types[1]),
                   pa.array([None if r is None else {"start": r[0], "end": r[1]} for r in roots], type=types[2])]
            yield pa.RecordBatch.from_arrays(batch.columns + new, names=schema.names)

    return pages.mapInArrow(run, schema)


#: Bytes of page text that are Python objects at one time, about; a larger page is alone.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with some ``SLICE_BYTES`` of text in column ``at``; nothing is copied."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
        if i > start and size + (n or 0) > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _lists(rows: Sequence[list[tuple]], kind: pa.DataType) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs, made column by column."""
    ends = list(itertools.accumulate(map(len, rows), initial=0))
    fields = list(kind.value_type)
    columns = zip(*itertools.chain.from_iterable(rows)) if ends[-1] else ((),) * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind)


def scan_of(text: str | None, root_id: str | None) -> tuple[list, list, tuple[int, int] | None]:
    if text is None or not (JAPANESE.search(text) or "&" in text or "data-langblock" in text.lower() or (root_id is not None and root_id in text)):
        return [], [], None
    return scan(text, root_id)


def without(text, cuts):
    """The text without its ``cuts`` (an array of start, end in order; one inside another counts once), as a column."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc, c):
        ahead = F.greatest(c["start"], acc["at"])
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"),
                        F.concat(acc["out"], F.substring(text, acc["at"] + 1, ahead - acc["at"])).alias("out"))
    kept = F.aggregate(cuts, start, cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(cuts) > 0, kept).otherwise(text)


# ---------------------------------------------------------------------------
# Rules about elements
# ---------------------------------------------------------------------------

@dataclass
class Rule:
    """What to do with the elements that match.

    Elements are chosen by tag, class, an ancestor's class and a part of the
    href (not those of class ``without``); ``only_first`` takes the first of the page.  ``cases`` are (pattern,
    actions): the first whose pattern (None: any) is found in the element's text
    - or in that of its first descendant of class ``told_by`` - is done.
    Actions: ("attr", name, value), ("hide",), ("text", text), ("inner", html),
    ("outer", html), ("sub", pattern, replacement) on the element's inner source.
    """

    name: str
    cases: list[tuple[str | None, list[tuple]]]
    tag: str | None = None
    css: str | None = None
    inside: str | None = None
    href: str | None = None
    told_by: str | None = None
    only_first: bool = False
    without: str | None = None
    needle: str = field(init=False)

    def __post_init__(self):
        self.needle = self.css or self.inside or self.href or ""

    def matches(self, e: Element) -> bool:
        if (self.tag and e.tag != self.tag) or (self.css and self.css not in e.classes) or (self.href and self.href not in (e.attrs.get("href") or "")):
            return False
        if self.without and self.without in e.classes:
            return False
        up = e.parent
        while self.inside and up is not None and self.inside not in up.classes:
            up = up.parent
        return not self.inside or up is not None


def _edits(page: PageScan, e: Element, actions: list[tuple]) -> list[tuple[int, int, str]]:
    out, tag = [], page.text[e.start:e.inside]
    for kind, *args in actions:
        if kind in ("attr", "hide"):
            name, value = args if kind == "attr" else ("style", "display: none;")
            if kind == "hide" and (e.attrs.get("style") or "").strip():
                value = e.attrs["style"].rstrip().rstrip(";") + "; " + value
            found, value = attribute(tag, name), html.escape(value, quote=True)
            if found:
                out.append((e.start + found[0], e.start + found[1], value if found[2] else f'"{value}"'))
            else:
                end = e.inside - (2 if tag.endswith("/>") else 1)
                out.append((end, end, f' {name}="{value}"'))
        elif kind == "outer":
            out.append((e.start, e.end, args[0]))
        elif kind in ("text", "inner"):
            out.append((e.inside, e.inside_end, html.escape(args[0], quote=False) if kind == "text" else args[0]))
        elif kind == "sub":
            out += [(e.inside + m.start(), e.inside + m.end(), m.expand(args[1])) for m in re.finditer(args[0], page.text[e.inside:e.inside_end])]
    return out


def apply_rules(text: str | None, rules: list[Rule]) -> tuple[str | None, int]:
    """(new text, rules that found an element): all rules on one parse; of edits inside each other the outer stays."""
    if text is None or not any(r.needle in text for r in rules):
        return text, 0
    page = elements_of(text)
    edits, hit = [], 0
    named: dict[str, list[Element]] = {}
    links = []
    for e in page.elements:
        if e.attrs:
            for name in e.classes:
                named.setdefault(name, []).append(e)
            if e.attrs.get("href") is not None:
                links.append(e)
    for rule in rules:
        done = False
        if rule.needle not in text:
            continue
        for e in named.get(rule.css, []) if rule.css else links if rule.href else [] if rule.inside and rule.inside not in named else page.elements:
            if rule.tag and e.tag != rule.tag or not rule.matches(e):
                continue
            told = e if rule.told_by is None else next((x for x in named.get(rule.told_by, []) if e.inside <= x.start < e.inside_end), None)
            words = None if told is None else page.content(told)
            actions = next((a for pattern, a in rule.cases if words is not None and (pattern is None or re.search(pattern, words))), None)
            found = _edits(page, e, actions) if actions else []
            edits += found
            done = done or bool(found)
            if rule.only_first:
                break
        hit += done
    pieces, pos = [], 0
    for start, end, new in sorted(edits, key=lambda x: (x[0], -x[1])):
        if start < pos:
            continue
        pieces += [text[pos:start], new]
        pos = end
    return "".join([*pieces, text[pos:]]), hit


def rewrite_elements(pages: DataFrame, rules: list[Rule], col: str = "html") -> DataFrame:
    """E24 by elements: ``pages`` with ``col`` rewritten and ``n_rules_hit``."""
    at = pages.columns.index(col)
    schema = T.StructType([T.StructField(col, T.StringType()) if f.name == col else f for f in pages.schema.fields]
                          + [T.StructField("n_rules_hit", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            new, hits = zip(*[apply_rules(v, rules) for v in batch.column(at).to_pylist()])
            columns = [pa.array(new, c.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.int32())], names=schema.names)

    return pages.mapInArrow(run, schema)


# Texts that the repair rules look for and put in.
WEB_BOOKING, PHONE_BOOKING = "WEB予約", "📞 電話で予約する"
BOOKING_TITLE, BADGE = "ご予約・お問い合わせ", "電話でご予約"
PHONE_HOURS = "受付時間 8:00〜17:00（不定休）"


def repair_rules(phone: str, old_handle: str, new_handle: str, button_html: str) -> list[Rule]:
    """The home page's repair hook as rules about elements.

    Shop identity (phone, social handles, the inside of the header button) is given by the caller.
    """
    tel = "tel:" + phone.replace("-", "")
    card = f'<div class="tel-card"><a class="tel-num" href="{tel}">{phone}</a><p class="tel-sub">{PHONE_HOURS}</p></div>'
    return [
        Rule("footer_links", [(r"よくある|質問", [("attr", "href", "pages/faq.html")]), (r"問い合わせ", [("attr", "href", tel)]),
                              (r"プライバシー", [("attr", "href", "pages/privacy.html")])], tag="a", inside="utility-links"),
        Rule("beginner_card", [(r"初心者", [("attr", "href", "pages/beginner-guide.html")])], css="content-card", told_by="content-card-title"),
        # 18:30 becomes 18:00 by the first replacement and 17:00 by the second.
        Rule("opening_hours", [(r"営業時間", [("sub", r"18([:：])[03]0", r"17\g<1>00"), ("sub", r"(?<!1)8([:：])30", r"8\g<1>00")])], css="access-row"),
        Rule("handle", [(None, [("sub", "@?" + re.escape(old_handle), new_handle)])], css="utility-ig", only_first=True),
        Rule("lookup_links", [(None, [("hide",)])], tag="a", href="reserve-lookup"),
        Rule("booking_buttons", [(None, [("attr", "href", tel), ("inner", button_html)])], tag="a", href="reserve.html", css="header-cta-btn"),
        Rule("booking_links", [(None, [("attr", "href", tel), ("text", PHONE_BOOKING)])], tag="a", href="reserve.html", without="header-cta-btn"),
        Rule("booking_title", [(WEB_BOOKING, [("text", BOOKING_TITLE)])], css="booking-card-title"),
        Rule("booking_steps", [(None, [("outer", card)])], css="booking-steps"),
        Rule("badge", [(WEB_BOOKING, [("text", BADGE)])], css="badge-label"),
    ]
