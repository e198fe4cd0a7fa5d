"""Main text of web pages by site template removal.

A page is read once into blocks of text and the element subtrees (boxes) that hold them.
Each box has a hash of its structure and text, each block one of its text.  Spark counts in how many
different pages of a host each of them occurs, and deletes those that recur across different texts.

What recurs is not yet a template, as a site shows one article at several addresses, with a date
or a line of their own.  So a page speaks for its boxes only by its own text: its blocks that
are in fewer than ``few`` pages of the host, and only if these have at least ``OWN`` words.  A box or block
is template if it is in pages with enough different own texts: a box (div, section, list, table ...) from
``few`` on, a paragraph from ``many`` on, and a heading or a paragraph of fewer than four words, which also recur in
articles ("Ingredients"), from ``many`` and half of the host's on.  Exact copies have one own text, copies with a date
have none, and neither limit depends on the size of a box or page.  The article, the main part and the body are
never template.  Copies that each add more than ``OWN`` words cannot be told from pages under one
template, unless their markup names the article.

What is never an article's text by its element goes too: menus, footers, asides, scripts, hidden
parts.  If the page marks its article (or main part), only that is kept.  Class, id and role words
(adverts, notices, comments ...) and forms only propose what to delete: innermost first, an element goes unless it
holds most of the paragraphs of its article or page.  A word counts as a whole token or, on containers, as part of a compound
("site-nav") that does not deny or describe it ("no-comments", "has-sidebar").

Scale: one plan at every size.  The html is read where it lies, twice, and is in no exchange.  The first pass sends
hashes only: distinct (host, page, hash) rows, equal pages merged map-side, are counted;
those that recur meet their pages' own texts, and the chosen hashes come back for each (host, page).  The second pass
sends each page's live texts, compressed, to its hashes, which is less to store than to write them in the first.
Joins with hashes are salted merge joins, so a hot host, box or group of copies spreads over ``SALTS`` tasks.
A row's arrays hold texts and hashes of its own page only.

Results by case.  A null or empty html gives an empty text; a page without a host shares the empty host; repeated rows
are rows of their own and one page in the counts; an empty table gives an empty result.  Broken or cut markup is
read as far as it goes.  A very long page is one row of its blocks; nothing is cut.  Columns are
renamed inside, so the table's other names cannot clash.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm.common import prepare
from marketml.session import materialize

FEW, MANY, HALF, OWN, SALTS = 3, 8, 0.5, 6, 16
#: Kinds of parts; texts are headings and paragraphs of fewer than LEAST words, items are never template alone.
BOX, PARAGRAPH, TEXT, ITEM = range(4)
LEAST = 4

# Element names of the HTML standard, by how they are read.
_SKIP = frozenset("head script style noscript template iframe object svg math canvas button select textarea datalist nav footer aside dialog menu audio video map title".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption address dt dd li td th tr caption summary".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 caption summary".split())
_WRAP = frozenset("html body main article section div header hgroup ul ol dl table thead tbody tfoot figure details center fieldset form".split())
_ROOT = frozenset("html body main article".split())
#: An opening tag of one of these ends an open element of the listed names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What stops the search for an element to end.
_SCOPE = frozenset("html body table ul ol dl div section article main".split())
# Words of class, id and role that mark what is not article text.
_NOT_TEXT = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar share sharing social related recommended recommendations comment comments disqus discussion replies widget contentinfo complementary search skip print hidden".split())
# Words before such a word in a compound that deny or describe it.
_DENY = frozenset("no non not without with has have is show hide use".split())
_ITEM = frozenset("li td th tr dt dd".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
_MARKED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def _marked(attributes: str, compound: bool) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether its class, id or role proposes that it is no article text."""
    proposed = False
    for m in _MARKED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True, False
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = _PARTS.split(token)
                at = next((k for k, w in enumerate(parts) if w in _NOT_TEXT), None)
                proposed |= at is not None and (token in _NOT_TEXT or compound and not _DENY.intersection(parts[:at]))
    return False, proposed


def _mark(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "replace")))


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


class Page:
    """Blocks as (text, in article, in main, skipped, element) in page order, boxes
    as (hash, first block, end block), and proposed deletions as (first block, end block), innermost first."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool, bool, str]] = []
        self.boxes: list[tuple[int, int, int]] = []
        self.proposed: list[tuple[int, int]] = []
        # Each open element: name, whether it starts a skipped part, whether it is proposed, its first block, hash parts of what it holds.
        self.open: list[tuple[str, bool, bool, int, list]] = [("", False, False, 0, [])]
        self.text: list[str] = []
        self.skipped = self.article = self.main = 0
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if not m:
                self.text.append(source[at:])
                break
            if m.start() > at:
                self.text.append(source[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._end(name)
            elif name in _VOID:
                self.text.append(" ")
                if name == "hr":
                    self._flush()
            elif name in _RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = close.start() if close else n
            else:
                self._start(name, m[3])
        while len(self.open) > 1:
            self._pop()
        self._flush()

    def _flush(self) -> None:
        if self.text:
            words = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            if words:
                self.blocks.append((words, self.article > 0, self.main > 0, self.skipped > 0, self.open[-1][0]))
                self.open[-1][4].append(words)

    def _start(self, name: str, attributes: str) -> None:
        text, skip = name in _TEXT, name in _SKIP
        hidden, proposed = _marked(attributes, not text) if len(attributes) > 6 else (False, False)
        if not (text or skip or name in _WRAP or hidden or proposed):  # else an inline advert or a hidden span
            return
        self._flush()
        if name not in ("span", "a", "b", "i"):
            self._end_open("p")
        for old in _ENDS.get(name, ()):
            self._end_open(old)
        # A page header is none of the article, a heading group within the article is.
        skip = skip or name == "header" and not (self.article or self.main) or name not in _ROOT and hidden
        self.open.append((name, skip, name == "form" or name not in _ROOT and proposed, len(self.blocks), []))
        self.skipped += skip
        self.article += name == "article"
        self.main += name == "main"

    def _end_open(self, name: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == name:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in _SCOPE:
                return

    def _end(self, name: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == name:
                while len(self.open) > k:
                    self._pop()
                return
        if name == "br":
            self.text.append(" ")

    def _pop(self) -> None:
        self._flush()
        name, skip, proposed, first, held = self.open.pop()
        self.skipped -= skip
        self.article -= name == "article"
        self.main -= name == "main"
        if held:
            digest = xxhash.xxh64_intdigest("\x00".join([name, *held]).encode("utf-8", "replace"))
            self.open[-1][4].append(f"\x01{digest:x}")
            if name not in _ROOT and name not in _ITEM and name not in _TEXT:
                self.boxes.append((_signed(digest), first, len(self.blocks)))
            if proposed:
                self.proposed.append((first, len(self.blocks)))

    def live(self) -> np.ndarray:
        """Which blocks the markup lets be text: of the article's, else the main part's, else all that are not
        skipped, those that no accepted proposal deletes."""
        live = np.array([not b[3] for b in self.blocks], bool)
        words = np.array([len(b[0].split()) for b in self.blocks], np.int64)
        paragraph = words * (live & (words >= LEAST) & np.array([b[4] not in _HEADING for b in self.blocks], bool))
        words = paragraph if paragraph.any() else words * live
        within = np.array([b[1] for b in self.blocks], bool)
        upto = np.r_[0, np.cumsum(words)]
        gone = np.zeros(len(live), bool)
        for first, end in self.proposed:
            base = words[within].sum() if within[first:end].any() else upto[-1]
            kept = words[first:end][~gone[first:end]].sum()
            if 2 * kept <= base:
                gone[first:end] = True
        for k in (1, 2):
            marked = live & np.array([b[k] for b in self.blocks], bool)
            if marked.any():
                live = marked
                break
        return live & ~gone

    def row(self) -> dict:
        """The live texts, each with its hash, kind and words, the boxes that hold any, and hashes of the
        page's live parts and of its live text."""
        live = self.live()
        place = np.r_[0, np.cumsum(live)]
        blocks = [b for b, keep in zip(self.blocks, live, strict=True) if keep]
        texts = [b[0] for b in blocks]
        marks = [_mark(t) for t in texts]
        words = [len(t.split()) for t in texts]
        kinds = [TEXT if b[4] in _HEADING else ITEM if b[4] in _ITEM else PARAGRAPH if n >= LEAST else TEXT for b, n in zip(blocks, words, strict=True)]
        boxes = [(d, int(place[first]), int(place[end])) for d, first, end in self.boxes if place[end] > place[first]]
        parts = np.array([*marks, *[d for d, _, _ in boxes]], np.int64)
        return {"page": _signed(xxhash.xxh64_intdigest(parts.tobytes())), "texts": texts, "marks": marks, "kinds": kinds, "words": words,
                "boxes": [d for d, _, _ in boxes], "firsts": [f for _, f, _ in boxes], "ends": [e for _, _, e in boxes]}


def kept_text(texts, marks, boxes, firsts, ends, chosen) -> str:
    """The texts outside chosen boxes and blocks, a line each."""
    gone = np.zeros(len(texts) + 1, np.int64)
    for d, first, end in zip(boxes, firsts, ends, strict=True):
        if d in chosen:
            gone[first] += 1
            gone[end] -= 1
    gone = np.cumsum(gone)
    return "\n".join(t for t, m, g in zip(texts, marks, gone[:-1], strict=True) if not g and m not in chosen)


def main_text(source: str, chosen: frozenset | set = frozenset()) -> str:
    """The page's text without the boxes and blocks whose hashes are chosen."""
    row = Page(source).row()
    return kept_text(row["texts"], row["marks"], row["boxes"], row["firsts"], row["ends"], chosen)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_PARTS_ROW = pa.schema([("page", pa.int64()), ("marks", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("boxes", pa.list_(pa.int64()))])
_PARTS_SQL = "page long, marks array<long>, kinds array<int>, words array<int>, boxes array<long>"
_TEXTS_ROW = pa.schema([("page", pa.int64()), ("texts", pa.binary()), ("boxes", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
_TEXTS_SQL = "page long, texts binary, boxes array<long>, firsts array<int>, ends array<int>"


def _read_pages(schema: pa.Schema):
    """A page's columns before its html, and those of its row that ``schema`` names; its texts are compressed."""

    def run(batches):
        packed = zstandard.ZstdCompressor(9).compress
        for b in batches:
            rows = [Page(source or "").row() for source in b.column(b.num_columns - 1).to_pylist()]
            if "texts" in schema.names:
                rows = [r | {"texts": packed("\n".join(r["texts"]).encode("utf-8", "replace"))} for r in rows]
            rows = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *rows.columns], [*b.schema.names[:-1], *rows.schema.names])

    return run


def read_parts(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, page, digest, kind, words): the distinct parts of every host's distinct pages."""
    rows = pages.select(_host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    read = rows.mapInArrow(_read_pages(_PARTS_ROW), f"host string, {_PARTS_SQL}")
    block = F.transform(F.arrays_zip("marks", "kinds", "words"), lambda b: F.struct(b["marks"].alias("digest"), b["kinds"].alias("kind"), b["words"].alias("words")))
    box = F.transform("boxes", lambda d: F.struct(d.alias("digest"), F.lit(BOX).alias("kind"), F.lit(0).alias("words")))
    # A page's blocks count once each, so sums over distinct rows are its own text's.
    parts = F.array_distinct(F.concat(box, block))
    return read.select("host", "page", F.explode(parts).alias("p")).select("host", "page", "p.*").distinct()


def read_texts(pages: DataFrame, url: str, html: str, keep: tuple[str, ...]) -> DataFrame:
    """One row a page: a struct ``keep``, its ``host``, ``salt``, ``page``, compressed live texts and boxes."""
    kept = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep])
    rows = pages.select(kept.alias("keep"), _host(F.col(f"`{url}`")).alias("host"), F.monotonically_increasing_id().alias("salt"), F.col(f"`{html}`").alias("html"))
    return rows.mapInArrow(_read_pages(_TEXTS_ROW), f"keep {rows.schema['keep'].dataType.simpleString()}, host string, salt long, {_TEXTS_SQL}")


def _merge(left: DataFrame, right: DataFrame, on: list[str], salt) -> DataFrame:
    """Merge join whose right side holds a few rows a key: a hot key's left rows spread over SALTS tasks."""
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread.hint("merge"), [*on, "__salt"]).drop("__salt")


def site_templates(pages: DataFrame, few: int = FEW, many: int = MANY, half: float = HALF, url: str = "url", html: str = "html") -> DataFrame:
    """(host, page, chosen): the template hashes that each page holds, as an array, for pages that hold any."""
    prepare(pages.sparkSession)
    found = materialize(read_parts(pages, url, html), "site-parts")
    seen = found.groupBy("host", "digest", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= few).select("host", "digest", "kind")
    shared = materialize(_merge(found, seen, ["host", "digest", "kind"], F.col("page")), "site-shared")
    # A page's own words, and a sum of their blocks' hashes, are those of all its blocks less the shared ones.
    sums = lambda df, sign: df.where(F.col("kind") != BOX).groupBy("host", "page").agg((F.sum("words") * sign).alias("words"), F.sum(F.xxhash64("digest", "kind").cast("decimal(38,0)") * sign).alias("own"))
    own = sums(found, 1).unionByName(sums(shared, -1)).groupBy("host", "page").agg(F.sum("words").alias("words"), F.sum("own").alias("own"))
    own = materialize(own.where(F.col("words") >= OWN).select("host", "page", "own"), "site-own")
    texts = shared.select("host", "page", "digest", "kind").join(own.hint("merge"), ["host", "page"]).select("host", "digest", "kind", "own").distinct().groupBy("host", "digest", "kind").agg(F.count("*").alias("n"))
    total = own.select("host", "own").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    texts = texts.where(F.col("n") >= F.when(F.col("kind") == BOX, few).otherwise(many)).where(F.col("kind") != ITEM).join(total.hint("merge"), "host")
    template = texts.where((F.col("kind") != TEXT) | (F.col("n") >= half * F.col("pages"))).select("host", "digest", "kind")
    held = _merge(shared, template, ["host", "digest", "kind"], F.col("page"))
    return held.groupBy("host", "page").agg(F.collect_set("digest").alias("chosen"))


@F.arrow_udf(T.StringType())
def _kept_text(texts: pa.Array, boxes: pa.Array, firsts: pa.Array, ends: pa.Array, chosen: pa.Array) -> pa.Array:
    unpacked = zstandard.ZstdDecompressor().decompress
    out = []
    for text, *box, gone in zip(*[c.to_pylist() for c in (texts, boxes, firsts, ends, chosen)], strict=True):
        text = unpacked(text).decode()
        if gone:
            lines = text.split("\n") if text else []
            text = kept_text(lines, [_mark(line) for line in lines], *box, set(gone))
        out.append(text)
    return pa.array(out, pa.string())


def extract(pages: DataFrame, few: int = FEW, many: int = MANY, half: float = HALF, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of ``pages`` with the main ``text`` of every page."""
    if "text" in keep:
        raise ValueError("a kept column is named text")
    templates = materialize(site_templates(pages, few, many, half, url, html), "site-templates")
    spread = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = read_texts(pages, url, html, keep).withColumn("salt", F.pmod("salt", F.lit(SALTS)).cast("int"))
    joined = rows.join(spread.hint("merge"), ["host", "page", "salt"], "left")
    return joined.select("keep.*", _kept_text("texts", "boxes", "firsts", "ends", "chosen").alias("text"))
