"""Content and tables of HTML pages."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import collapse_spaces

# Elements that never have content, and elements whose text is not page text.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
HIDDEN = frozenset(["script", "style", "template", "rt", "rp"])
# Elements whose end tag may be left out: the next one closes them unless a new element of this kind lies between.
IMPLIED_ENDS = {"p": "td", "td": "table", "tr": "table"}

# The usual pieces of a page, on which every reader of HTML agrees. Text; end tag; start tag, closed at once or not;
# reference; what shows nothing. The last group is anything else: such a page is left to the parser as a whole.
_SPACE = r"[ \t\n\r\f]"
_ATTRIBUTES = rf"""(?:{_SPACE}+[a-zA-Z][-a-zA-Z0-9_:]*(?:=(?:"[^"<>]*"|'[^'<>]*'))?)*{_SPACE}*"""
_RAW = r"(?:script|style|xmp|iframe|noembed|noframes|noscript|plaintext|title(?!>[^<&]*</title>)|textarea(?!>[^<&]*</textarea>))"
_PIECE = re.compile(
    rf"""([^<&]+)|</([a-zA-Z][a-zA-Z0-9]*)>|<(?!(?i:{_RAW})[^a-zA-Z0-9])([a-zA-Z][a-zA-Z0-9]*){_ATTRIBUTES}(/?)>"""
    r"""|&(#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);"""
    rf"""|(<!--(?!-?>)[^-]*(?:-[^-]+)*-->|<!(?i:doctype)[^<>]*>"""
    rf"""|<(?i:script){_ATTRIBUTES}>[^<]*(?:<(?!/?(?i:script)|!--)[^<]*)*</(?i:script)>"""
    rf"""|<(?i:style){_ATTRIBUTES}>[^<]*(?:<(?!/?(?i:style)|!--)[^<]*)*</(?i:style)>)|(.)""", re.S)


class _Page(HTMLParser):
    """Collects paragraph texts and table cells while the parser runs.

    An unclosed ``<p>`` ends at the next one of its cell, an unclosed cell or row at the next one of its table, so
    text is kept once however many are left open. Text in nested tables belongs to the cells around it too."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.text, self.hidden = [], [], 0
        # Where and with what store each kind of element is open, innermost last.
        self.inside = defaultdict(list)
        self.paragraphs, self.tables = [], []

    def updatepos(self, i, j):
        """Line numbers are not needed, and counting them costs a tenth of the run."""
        return j

    def _flush(self):
        if not self.text:
            return
        text, self.text = "".join(self.text), []
        if not text or self.hidden:
            return
        for _, store in self.inside["p"]:
            store.append(text)
        if text.strip():
            for _, store in self.inside["td"]:
                store.append(text.strip())

    def _innermost(self, tag):
        return self.inside[tag][-1][0] if self.inside[tag] else -1

    def _close(self, depth):
        while len(self.open) > depth:
            tag = self.open.pop()
            self.inside[tag].pop()
            self.hidden -= tag in HIDDEN

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in VOID:
            return
        around = IMPLIED_ENDS.get(tag)
        if around and self._innermost(tag) > self._innermost(around):
            self._close(self._innermost(tag))
        store = []
        if tag == "p":
            self.paragraphs.append(store)
        elif tag == "table":
            self.tables.append(store)
        elif tag in ("tr", "td"):
            for _, rows in self.inside["table" if tag == "tr" else "tr"]:
                rows.append(store)
        self.inside[tag].append((len(self.open), store))
        self.open.append(tag)
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        self._flush()
        if self.inside[tag]:
            self._close(self._innermost(tag))

    def handle_data(self, data):
        self.text.append(data)

    def handle_entityref(self, name):
        text = html.unescape(f"&{name};")
        self.text.append(f"&{name}" if text == f"&{name};" else text)

    def handle_charref(self, name):
        self.text.append(html.unescape(f"&#{name};"))

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def _pieces(self, pieces):
        for text, ended, tag, empty, reference, _, _ in pieces:
            if text:
                self.text.append(text)
            elif ended:
                self.handle_endtag(ended.lower())
            elif tag:
                tag = tag.lower()
                self.handle_starttag(tag, [])
                if empty:
                    self.handle_endtag(tag)
            elif reference:
                self.handle_charref(reference[1:]) if reference[0] == "#" else self.handle_entityref(reference)
            else:
                self._flush()

    def read(self, page: str):
        """Most of a page's time goes into finding tags one character class at a time; a page of usual pieces is split at once."""
        pieces = _PIECE.findall(page)
        if any(p[6] for p in pieces):
            self.feed(page)
            self.close()
        else:
            self._pieces(pieces)
        self._flush()
        texts = ["".join(p).strip() for p in self.paragraphs]
        tables = [[["".join(cell) for cell in row] for row in table] for table in self.tables]
        return " ".join(t for t in texts if t), tables


def extract_pages(df: DataFrame, page_html: str = "html") -> DataFrame:
    """Replace the page's HTML by ``content`` (paragraph texts) and ``tables`` (cells per row per table)."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != page_html]

    # Only the page goes through Python; the other columns keep their types and values. Pages are taken from the batch
    # one by one, and what is read off them is made an Arrow array at once: by way of pandas nested cells cost far more.
    @F.arrow_udf("content string, tables array<array<array<string>>>")
    def read(pages: pa.Array) -> pa.Array:
        found = [(None, None) if h is None else _Page().read(h) for h in (p.as_py() for p in pages)]
        content = pa.array([c for c, _ in found], pa.string())
        tables = pa.array([t for _, t in found], pa.list_(pa.list_(pa.list_(pa.string()))))
        return pa.StructArray.from_arrays([content, tables], ["content", "tables"])

    parsed = df.select(*kept, F.explode(F.array(read(F.col(page_html)))).alias("_page"))
    return parsed.select(*kept, collapse_spaces(F.col("_page.content")).alias("content"), F.col("_page.tables").alias("tables"))
