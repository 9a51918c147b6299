"""Elements and links of HTML by the standard library's parser, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.schemas import ELEMENT
from quarry.session import ship_package

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements that end where the next of their kind begins, and those inside which they may begin anew.
_ENDS_BEFORE = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "p": (("p",), ("table", "blockquote", "div", "li", "td", "th", "section", "article")),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",)), "option": (("option",), ("select",)), "a": (("a",), ("table",)),
}


class _Text(list):
    """Pieces of a page's text, and their length in code points."""

    size = 0

    def append(self, piece: str) -> None:
        super().append(piece)
        self.size += len(piece)


class Element(dict):
    """tag and attrs, of which repeated ones count by their last; begin and end, where its text, with that of the elements inside, stands in the page's; text itself is put
    together when it is asked for. html and body have no text."""

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]], pieces: _Text):
        super().__init__(tag=tag, attrs={k: v or "" for k, v in attrs})
        self._pieces, self._first, self._end = pieces, len(pieces), None
        self.begin = self.end = pieces.size

    def __missing__(self, key: str) -> str:
        if key != "text":
            raise KeyError(key)
        self["text"] = "" if self["tag"] in ("html", "body") else "".join(self._pieces[self._first : self._end])
        return self["text"]

    def close(self) -> None:
        self._end = len(self._pieces)
        self.end = self.begin if self["tag"] in ("html", "body") else self._pieces.size


class _Tree(HTMLParser):
    """Elements of a page, in time that grows with the page. Text is kept once, in pieces; an element knows its first and last. Open elements are found by their tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.pieces = _Text()
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _shut(self, place: int) -> None:
        """Close the open elements from a place on."""
        while len(self.open) > place:
            element = self.open.pop()
            self.places[element["tag"]].pop()
            element.close()

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_BEFORE:
            before, inside = _ENDS_BEFORE[tag]
            last = self._last(before)
            if last > self._last(inside):
                self._shut(last)
        element = Element(tag, attrs, self.pieces)
        self.elements.append(element)
        if tag in _VOID:
            element.close()
        else:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.elements.append(element := Element(tag, attrs, self.pieces))
        element.close()

    def handle_endtag(self, tag):
        if self.places.get(tag):
            self._shut(self.places[tag][-1])

    def handle_data(self, data):
        self.pieces.append(data)

    def close(self):
        super().close()
        self._shut(0)


def _parsed(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree


def elements(html: str | None) -> list[Element]:
    """The elements of a page in order; of text that is no HTML, none."""
    return _parsed(html).elements


class _References(HTMLParser):
    """Distinct link targets of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, None] = {}

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "link", "script"):
            value = dict(attrs).get("src" if tag == "script" else "href", "\0")
            if value != "\0" and (tag != "script" or (value or "").endswith(".js")):
                self.found[value or ""] = None


def references(html: str | None) -> list[str]:
    """Distinct link targets of a page: href of a and link, src of script that ends in .js."""
    parser = _References()
    parser.feed(html or "")
    parser.close()
    return list(parser.found)


def html_references(df: DataFrame, html: str, out: str = "href") -> DataFrame:
    """df without its html column and with a row for each link target of the page."""
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, target = [], []
            for i, page in enumerate(batch.column(batch.schema.get_field_index(html)).to_pylist()):
                found = references(page)
                row += [i] * len(found)
                target += found
            take = pa.array(row, pa.int64())
            columns = [batch.column(batch.schema.get_field_index(c)).take(take) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(target, pa.string())], [*kept, out])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.StringType())]))


def dom_elements(df: DataFrame, html: str, choose: Callable[[list[Element]], list[Element] | None], out: str = "elements") -> DataFrame:
    """df without its html column, and with the elements that `choose` picks from a page. A page for which it gives None is left out, one for which it
    gives an empty list stays."""
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c != html]
    kind = pa.list_(pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, picked = [], []
            for i, page in enumerate(batch.column(batch.schema.get_field_index(html)).to_pylist()):
                found = choose(elements(page))
                if found is not None:
                    row.append(i)
                    picked.append([{"tag": e["tag"], "attrs": list(e["attrs"].items()), "text": e["text"]} for e in found])
            take = pa.array(row, pa.int64())
            columns = [batch.column(batch.schema.get_field_index(c)).take(take) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(picked, kind)], [*kept, out])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.ArrayType(ELEMENT))]))


class HtmlElements:
    """Table function html_elements(html, tags): a row (n, tag, attrs, begin, end, text) for each element of a page that has one of the tags, in order, n from 1.

    tags: names with commas; empty or null: all; #text: the page's text as well, as the first row, n 0. begin and end are places in the page's text, in code points from 0, end exclusive. text is there
    for rows that hold no part of a later one: so the rows are as long as the page, however its elements stand inside each other. A null page has no rows.
    """

    def eval(self, html: str, tags: str) -> Iterator[tuple]:
        if html is None:
            return
        tree, wanted = _parsed(html), {t.strip() for t in (tags or "").split(",")} - {""}
        text = "".join(tree.pieces)
        if "#text" in wanted:
            yield 0, "#text", {}, 0, len(text), text
        rows = [e for e in tree.elements if not wanted or e["tag"] in wanted]
        for n, e in enumerate(rows, 1):
            alone = n == len(rows) or rows[n].begin >= e.end
            yield n, e["tag"], e["attrs"], e.begin, e.end, text[e.begin : e.end] if alone else None


def register_functions(spark: SparkSession) -> None:
    """Make html_elements known to a session's SQL: SELECT ... FROM pages p, LATERAL html_elements(p.html, 'a') e."""
    ship_package(spark)
    spark.udtf.register("html_elements", F.udtf(HtmlElements, returnType="n: int, tag: string, attrs: map<string,string>, begin: int, end: int, text: string", useArrow=True))
