"""Web pages to rows: tables, and the cards of schedules. A small parser over Arrow batches finds elements in one pass over a page; what they mean is
decided by column expressions. Pages never meet, so all of this is narrow."""

from __future__ import annotations

import itertools
import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without an end; elements that an opening one ends, and those that it cannot reach beyond.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "li": {"li"}, "p": {"p"}}
_WALLS = {"table", "ul", "ol"}
# Where a page is cut into texts and tags; a tag whose attributes are quoted and without references, or a comment; and elements whose
# content is not markup.
_SPACE = r"[ \t\n\r\f]"
_COMMENT = r"<!--(?![->])(?:[^-]|-(?!-))*-->"
_TAGS = re.compile(rf"({_COMMENT}|<[^>]*>)")
_PLAIN = re.compile(rf"""<([a-zA-Z][a-zA-Z0-9]*)((?:{_SPACE}+[a-zA-Z][a-zA-Z0-9_-]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'))?)*){_SPACE}*(/?)>|</([a-zA-Z][a-zA-Z0-9]*)>|{_COMMENT}""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*)(?:="([^"]*)"|='([^']*)')?""")
_RAW = {"textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "svg", "math"}
_SCRIPTS = ("script", "style")


_MOST_MET = 8192
# What a plain tag does: nothing (a comment), opens an element that ends no other, closes one, opens one otherwise, opens and closes one.
_NONE, _OPENS, _CLOSES, _STARTS, _BOTH = range(5)


def _tag(written: str) -> tuple | None:
    """What a plain tag does, its element, attributes and names; None for what is not plain."""
    m = _PLAIN.fullmatch(written)
    if m is None:
        return None
    tag, inner, closed, ended = m.groups()
    if tag is None:
        return (_CLOSES, ended.lower(), None, None) if ended else (_NONE, None, None, None)
    tag = tag.lower()
    if tag in _RAW or (closed and tag in _SCRIPTS):
        return None
    attrs = {a[1].lower(): a[2] or a[3] or "" for a in _ATTRIBUTE.finditer(inner)}
    kind = _STARTS if tag in _VOID else _BOTH if closed else _STARTS if tag in _ENDS or tag in _SCRIPTS else _OPENS
    return kind, tag, attrs, _names(attrs)


def _names(attrs: dict[str, str]) -> tuple[str, ...]:
    return (*attrs.get("class", "").split(), *attrs.get("data-test-id", "").split())


# An element: its tag, names, attributes, the wanted element that it lies in (-1: none) and the texts in it.
_ELEMENT, _CALLED, _ATTRS, _UP, _TEXTS = range(5)


class _Elements(HTMLParser):
    """Elements of wanted tags or names in document order. Names are an element's classes and its test id."""

    def __init__(self, tags: set[str], names: set[str]):
        super().__init__(convert_charrefs=True)
        self.tags, self.names = tags, names
        # plain tags met before, and whether their elements are wanted
        self.met = {}
        self._begin()

    def _begin(self):
        self.found, self.open, self.inside, self.silent = [], [], [], 0
        # all texts in order; an element's are those between its beginning and its end
        self.texts = []

    def _meet(self, written):
        if len(self.met) >= _MOST_MET:
            self.met.clear()
        t = _tag(written)
        self.met[written] = t = t and (*t, t[1] in self.tags or not self.names.isdisjoint(t[3] or ()))
        return t

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        self._start(tag, attrs, _names(attrs))

    def _start(self, tag, attrs, names):
        ends = _ENDS.get(tag)
        if ends and self.open:
            cut = None
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in _WALLS:
                    break
                cut = i if self.open[i][0] in ends else cut
            if cut is not None:
                self._close(cut)
        wanted = tag in self.tags or not self.names.isdisjoint(names)
        if wanted:
            self.found.append([tag, names, attrs, self.inside[-1] if self.inside else -1, None])
        if tag not in _VOID:
            self.open.append((tag, len(self.texts) if wanted else -1))
            if wanted:
                self.inside.append(len(self.found) - 1)
            self.silent += tag in _SCRIPTS
        elif wanted:
            self.found[-1][_TEXTS] = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                return self._close(i)
            if self.open[i][0] in _WALLS:
                return None
        return None

    def _close(self, down_to):
        while len(self.open) > down_to:
            tag, since = self.open.pop()
            if tag in _SCRIPTS:
                self.silent -= 1
            if since >= 0:
                self.found[self.inside.pop()][_TEXTS] = self.texts[since:]

    def handle_data(self, data):
        if not self.silent:
            self.texts.append(data)

    def close(self):
        super().close()
        self._close(0)

    def _read_plain(self, html: str) -> bool:
        """Whether the page is plain enough to be cut at its tags and read as the parser would; if not, it is read in part."""
        pieces = _TAGS.split(html)
        if "<" in pieces[-1] or "&" in pieces[-1]:
            return False
        open_, inside, found, texts, met, script = self.open, self.inside, self.found, self.texts, self.met, None
        pairs = iter(pieces)
        for text, written in zip(pairs, pairs):
            t = met[written] if written in met else self._meet(written)
            if script:
                # nothing in it is markup; it must end plainly
                if "</" not in written and "<!" not in written:
                    continue
                if written != script:
                    return False
                script = None
            elif text:
                texts.append(unescape(text) if "&" in text else text)
            if t is None:
                return False
            kind, tag, attrs, names, wanted = t
            if kind == _OPENS:
                # as in _start, without elements that end others
                open_.append((tag, len(texts) if wanted else -1))
                if wanted:
                    found.append([tag, names, attrs, inside[-1] if inside else -1, None])
                    inside.append(len(found) - 1)
            elif kind == _CLOSES:
                # mostly it ends what was opened last
                if open_ and open_[-1][0] == tag:
                    since = open_.pop()[1]
                    if since >= 0:
                        found[inside.pop()][_TEXTS] = texts[since:]
                    self.silent = 0
                else:
                    self.handle_endtag(tag)
            elif kind:
                self._start(tag, attrs, names)
                if kind == _BOTH:
                    self._close(len(open_) - 1)
                elif self.silent:
                    script = f"</{tag}>"
        if script:
            return False
        if pieces[-1]:
            texts.append(pieces[-1])
        self._close(0)
        return True

    def read(self, html: str | None) -> list[list]:
        self._begin()
        if not self._read_plain(html or ""):
            self._begin()
            self.reset()
            self.feed(html or "")
            self.close()
        return self.found


def _text(element: list, between: str) -> str:
    parts = element[_TEXTS]
    return " ".join((parts[0] if len(parts) == 1 else between.join(parts)).split())


def _tables(found: list[list]) -> list[list[list[str]]]:
    rows, tables = {}, {}
    for i, e in enumerate(found):
        tag, up = e[_ELEMENT], e[_UP]
        if tag == "table":
            tables[i] = []
            continue
        within = "tr" if tag in ("td", "th") else "table"
        while up >= 0 and found[up][_ELEMENT] != within:
            up = found[up][_UP]
        if up < 0:
            continue
        if tag == "tr":
            rows[i] = []
            tables[up].append(rows[i])
        elif up in rows:
            rows[up].append(_text(e, ""))
    return list(tables.values())


def tables(html) -> Column:
    """The tables of a page, each as rows of the texts of its cells; a table in a cell is a table of its own. Null and pages without tables have none."""

    @F.arrow_udf("array<array<array<string>>>")
    def read(pages: pa.Array) -> pa.Array:
        elements = _Elements({"table", "tr", "td", "th"}, set())
        return pa.array([_tables(elements.read(h)) for h in pages.to_pylist()], pa.list_(pa.list_(pa.list_(pa.string()))))

    return read(html)


_PART = "struct<tag:string,names:array<string>,within:array<string>,href:string,src:string,text:string>"
CARD = f"struct<id:string,names:array<string>,around:string,parts:array<{_PART}>,first:array<struct<text:string,href:string>>>"
_AT_ONCE = 64
_STRING, _STRINGS = pa.string(), pa.list_(pa.string())


def _cards(found: list[list], root: str, key: str, names: dict[str, int], group: str) -> list[list]:
    """Each card's id, names, around, parts and first, as in CARD."""
    cards, mine, titles, seen = {}, [], {}, set()

    def grouped(i: int) -> int:
        while i >= 0 and group not in found[i][_CALLED]:
            i = found[i][_UP]
        return i

    for i, e in enumerate(found):
        tag, called, attrs, up, _ = e
        if root in called and (not key or key in attrs):
            mine.append(i)
            at = attrs.get(key) if key else None
            if not at or at not in seen:
                cards[i] = [at or None, called, grouped(up) if group else -1, [], [None] * len(names)]
                seen.add(at)
            continue
        of = mine[up] if up >= 0 else -1
        mine.append(of)
        card = cards.get(of)
        titled = group and tag == "p" and up >= 0
        if card or titled:
            text = _text(e, " ")
            if titled:
                titles.setdefault(grouped(up), text)
        if card:
            within = ()
            while up != of:
                within += found[up][_CALLED]
                up = found[up][_UP]
            href = attrs.get("href")
            card[3].append((tag, called, within, href, attrs.get("data-src") or attrs.get("src"), text))
            first = card[4]
            for n in called:
                if n in names and first[names[n]] is None:
                    first[names[n]] = (text, href)
    for card in cards.values():
        card[2] = titles.get(card[2]) or None if card[2] >= 0 else None
    return list(cards.values())


def _nested(lists: list[list], items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, lists))], pa.int32()), items)


def _columns(rows: list, fields: dict[str, pa.DataType]) -> pa.Array:
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], list(fields))


def _card_arrays(pages: list[list[list]]) -> pa.Array:
    cards = list(itertools.chain.from_iterable(pages))
    ids, names, around, parts, first = zip(*cards) if cards else [()] * 5
    part = {"tag": _STRING, "names": _STRINGS, "within": _STRINGS, "href": _STRING, "src": _STRING, "text": _STRING}
    flat = _columns(list(itertools.chain.from_iterable(parts)), part)
    firsts = list(itertools.chain.from_iterable(first))
    said = _columns([f or (None, None) for f in firsts], {"text": _STRING, "href": _STRING})
    said = pa.StructArray.from_arrays(said.flatten(), ["text", "href"], mask=pa.array([f is None for f in firsts], pa.bool_()))
    columns = [pa.array(ids, _STRING), pa.array(names, _STRINGS), pa.array(around, _STRING), _nested(parts, flat), _nested(first, said)]
    return _nested(pages, pa.StructArray.from_arrays(columns, ["id", "names", "around", "parts", "first"]))


def cards(html, root: str, names: list[str], key: str = "", group: str = "") -> Column:
    """The elements of the name `root` (with an attribute `key`, where named: one card a value), as CARD: within each its links, images, paragraphs and the
    elements of `names`, with the names of what they lie in; first are the first elements of each of `names`, null without one; around is the first
    paragraph of the element of the name `group` that the card lies in."""
    at = {n: i for i, n in enumerate(names)}

    @F.arrow_udf(f"array<{CARD}>")
    def read(pages: pa.Array) -> pa.Array:
        # few pages at once, so that few objects are alive
        some = [pages.slice(i, _AT_ONCE).to_pylist() for i in range(0, max(len(pages), 1), _AT_ONCE)]
        elements = _Elements({"a", "img", "p"}, {root, group, *names} - {""})
        return pa.concat_arrays([_card_arrays([_cards(elements.read(h), root, key, at, group) for h in p]) for p in some])

    return read(html)
