"""HTML extraction with removal of site templates.

Every element of a page that holds visible text gets a hash of its subtree: tag, attributes,
text and the hashes of its children. Spark counts on how many pages of a host each hash
occurs, equal pages once. A subtree is part of the site's template if it occurs

- as furniture on at least ``min_pages`` pages and on ``min_share`` of the host's pages: in a
  block like nav, footer, div or ul, outside article and main, with at most half of its page's
  visible text; or
- anywhere on at least ``min_pages`` pages and on ``content_share`` of the host's pages. Headings,
  paragraphs, cells, words in bold and all else inside article and main go only by this, so what
  a few pages quote from each other stays.

Pages lose their outermost template subtrees, and the rest of the visible text is the result,
one line for each block.

``html`` and ``body`` themselves are never removed. Comments, scripts, styles and the head
are no visible text. Missing end tags are implied where HTML allows it; stray ones are ignored.

The template goes to the executors as one sorted array of 8-byte keys while it fits in
``ship_bytes``; beyond that pages are joined with the keys of their host, of which there are at
most as many as subtrees of a page divided by ``min_share``. Hosts of more than ``HOT`` pages
are spread over several keys of that join.

Defined results: a NULL or empty page has NULL or empty text. A page without a host in its
URL loses nothing. Every row has a result; rows that repeat a page count once. Where pages has
a column of the result's name, the result's gets an underscore. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm import _run

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template head title svg math iframe object".split())
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "title", "textarea", "noscript", "iframe")}
_BLOCK = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html"}
_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WALL = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_KEPT = frozenset(("html", "body"))
_FURNITURE = frozenset("nav header footer aside div section ul ol dl li dd dt table tbody tr form fieldset figure address details menu".split())
#: Pages of a host that one key of a join may have.
HOT = 50_000
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


class Page:
    """Visible text of a page in pieces (None ends a block), and its subtrees: (hash, first piece, last piece).

    ``furniture``: for each subtree, whether it may be a template by its tag, place and size.
    """

    def __init__(self, source: str):
        self.pieces: list[str | None] = []
        self.nodes: list[tuple[int, int, int]] = []
        self.furniture: list[bool] = []
        #: Open elements: tag, hashed parts, first piece, whether it holds visible text.
        self._open: list[list] = [["", [], 0, False]]
        self._count: dict[str, int] = {}
        self._hidden = 0
        at, last = 0, source.rfind(">")
        while at < len(source):
            # without this an unclosed "<!" would be looked up to the end of the page each time
            found = _TAG.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
            self._text(source[at : found.start() if found else len(source)])
            if not found:
                break
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
                continue
            self._start(tag, found[3])
            if tag in _RAW:
                close = _RAW[tag].search(source, at)
                end = close.start() if close else len(source)
                self._text(source[at:end])
                at = close.end() if close else end
                self._end(tag)
        while len(self._open) > 1:
            self._pop()
        ends = [0]
        for piece in self.pieces:
            ends.append(ends[-1] + len(piece or ""))
        self.furniture = [f and 2 * (ends[b] - ends[a]) <= ends[-1] for f, (_, a, b) in zip(self.furniture, self.nodes, strict=True)]

    def _text(self, raw: str) -> None:
        if raw and not self._hidden and (text := _SPACE.sub(" ", html.unescape(raw))).strip():
            self._open[-1][1].append("=" + text.strip())
            self._open[-1][3] = True
            self.pieces.append(text)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P and self._count.get("p"):
            self._end("p", ("table", "button"))
        if tag in _SIBLING:
            for other in _SIBLING[tag]:
                if self._count.get(other):
                    self._end(other, _WALL[tag])
        if tag in _BLOCK:
            self.pieces.append(None)
        if tag in _VOID:
            self._open[-1][1].append(f"<{tag}>")
            return
        self._open.append([tag, [f"<{tag} {_SPACE.sub(' ', attributes).strip()}>"], len(self.pieces), False])
        self._count[tag] = self._count.get(tag, 0) + 1
        self._hidden += tag in _HIDDEN

    def _end(self, tag: str, walls: tuple = ()) -> None:
        if not self._count.get(tag):
            return
        if walls:
            for entry in reversed(self._open):
                if entry[0] == tag:
                    break
                if entry[0] in walls:
                    return
        while self._pop() != tag:
            pass

    def _pop(self) -> str:
        tag, parts, first, visible = self._open.pop()
        self._count[tag] -= 1
        self._hidden -= tag in _HIDDEN
        if visible:
            digest = hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            if tag not in _KEPT:
                self.nodes.append((int.from_bytes(digest, "little"), first, len(self.pieces)))
                self.furniture.append(tag in _FURNITURE and not self._count.get("article") and not self._count.get("main"))
            self._open[-1][1].append("+" + digest.hex())
            self._open[-1][3] = True
        if tag in _BLOCK:
            self.pieces.append(None)
        return tag

    def text(self, removed) -> tuple[str, int]:
        """(text, number of subtrees removed) without the outermost subtrees whose hash is in removed."""
        gone = sorted((first, -last) for key, first, last in self.nodes if key in removed)
        keep, at, count = [], 0, 0
        for first, last in gone:
            if first >= at and -last > first:
                keep += self.pieces[at:first]
                keep.append(None)
                at, count = -last, count + 1
        lines, line = [], []
        for piece in [*keep, *self.pieces[at:], None]:
            if piece is not None:
                line.append(piece)
            elif line:
                lines.append(_SPACE.sub(" ", "".join(line)).strip())
                line = []
        return "\n".join(x for x in lines if x), count


def host_key(host: str) -> int:
    return int.from_bytes(hashlib.blake2b(host.encode(), digest_size=8).digest(), "little")


def node_key(host: int, node: int) -> int:
    """One signed 64-bit key of a host and a subtree hash."""
    key = ((node ^ (host * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    key ^= key >> 29
    return key - (1 << 64) if key >> 63 else key


def _counted(batches):
    for batch in batches:
        counts: dict[tuple[int, int], list[float]] = {}
        columns = (batch.column(c).to_pylist() for c in ("html", "host", "weight"))
        for source, host, weight in zip(*columns, strict=True):
            own = host_key(host)
            signed = own - (1 << 64) if own >> 63 else own
            page, seen = Page(source), {}
            for (node, _, _), furniture in zip(page.nodes, page.furniture, strict=True):
                seen[node] = seen.get(node, False) or furniture
            for node, furniture in seen.items():
                both = counts.setdefault((signed, node_key(own, node)), [0.0, 0.0])
                both[0] += weight
                both[1] += weight * furniture
        yield pa.RecordBatch.from_pydict(
            {
                "host": pa.array([h for h, _ in counts], pa.int64()),
                "key": pa.array([k for _, k in counts], pa.int64()),
                "pages": pa.array([n for n, _ in counts.values()], pa.float64()),
                "furniture": pa.array([n for _, n in counts.values()], pa.float64()),
            }
        )


def _keyed(hosts: pa.Array) -> pa.Array:
    return pa.array([None if not x else h - (1 << 64) if (h := host_key(x)) >> 63 else h for x in hosts.to_pylist()], pa.int64())


def with_host(pages: DataFrame, into: str = "host") -> DataFrame:
    return pages.withColumn(into, F.lower(F.regexp_extract("url", HOST, 1)))


def templates(pages: DataFrame, min_pages: int, min_share: float, content_share: float) -> tuple[DataFrame, DataFrame]:
    """(template, hosts): (host, key) of subtrees that recur on pages of a host, by 64-bit keys of both, and (host, name, all_pages)."""
    hosted = with_host(pages.select("url", "html")).where("host <> '' AND html IS NOT NULL").select("host", "html", F.xxhash64("html").alias("page"))
    # of equal pages each counts as a part of one
    times = _run.written(hosted.groupBy("host", "page").agg(F.count("*").alias("times")).where("times > 1"))
    if times.isEmpty():
        hosted = hosted.withColumn("weight", F.lit(1.0))
    else:
        hosted = _run.join_small(hosted, times, ["host", "page"], "left").withColumn("weight", 1 / F.coalesce("times", F.lit(1)))
    hosted = hosted.select("host", "html", "weight")
    counts = hosted.mapInArrow(_counted, "host long, key long, pages double, furniture double")
    counts = counts.groupBy("host", "key").agg(F.sum("pages").alias("pages"), F.sum("furniture").alias("furniture"))
    sizes = hosted.groupBy(F.col("host").alias("name")).agg(F.sum("weight").alias("all_pages"), F.count("*").alias("rows"))
    sizes = _run.written(sizes.withColumn("host", F.arrow_udf(_keyed, "long")("name")))
    frequent = counts.where(F.col("pages") >= min_pages - 1e-6).join(sizes.select("host", "all_pages"), "host")
    enough = (F.col("furniture") >= F.greatest(F.lit(min_pages), F.col("all_pages") * min_share) - 1e-6) | (F.col("pages") >= F.col("all_pages") * content_share - 1e-6)
    return frequent.where(enough).select("host", "key"), sizes


def extract(
    pages: DataFrame, min_pages: int = 3, min_share: float = 0.01, content_share: float = 0.3, ship_bytes: int = _run.SHIP_BYTES, into: str = "extracted"
) -> DataFrame:
    """pages(url, html) with a struct column ``into`` of text and removed (subtrees)."""
    found, sizes = templates(_run.text_batches(pages), min_pages, min_share, content_share)
    found = _run.written(found)
    [into] = _run.fresh(pages, into)
    host, key, keys, salt = _run.fresh(pages, "_host", "_key", "_keys", "_salt")
    hosted = with_host(pages, host)
    kind = "struct<text: string, removed: int>"

    class Known:
        """The hashes of a page's host that belong to its template."""

        def __init__(self, own: int, table: np.ndarray):
            self.own, self.table = own, table

        def __contains__(self, node: int) -> bool:
            key = node_key(self.own, node)
            at = int(np.searchsorted(self.table, key))
            return at < len(self.table) and int(self.table[at]) == key

    def clean(sources: pa.Array, hosts: pa.Array, tables) -> pa.Array:
        texts, removed = [], []
        for source, own, table in zip(sources.to_pylist(), hosts.to_pylist(), tables, strict=True):
            if source is None:
                texts.append(None)
                removed.append(0)
            else:
                text, n = Page(source).text(Known(host_key(own), table) if own else ())
                texts.append(text)
                removed.append(n)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["text", "removed"])

    if found.count() * 8 <= ship_bytes:
        shipped = np.sort(found.select("key").toArrow().column("key").to_numpy().astype(np.int64))

        def cleaned(sources: pa.Array, hosts: pa.Array) -> pa.Array:
            return clean(sources, hosts, [shipped] * len(sources))

        return hosted.withColumn(into, F.arrow_udf(cleaned, kind).asNondeterministic()("html", host)).drop(host)

    def joined(sources: pa.Array, hosts: pa.Array, tables: pa.Array) -> pa.Array:
        return clean(sources, hosts, [np.array(t or [], dtype=np.int64) for t in tables.to_pylist()])

    # at most one row for each HOT pages
    hot = sizes.where(F.col("rows") > HOT).select(F.col("host").alias(key), F.ceil(F.col("rows") / HOT).alias(salt))
    by_host = found.groupBy(F.col("host").alias(key)).agg(F.sort_array(F.collect_list("key")).alias(keys))
    by_host = by_host.join(F.broadcast(hot), key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salt), F.lit(1)) - 1)))
    hosted = hosted.withColumn(key, F.arrow_udf(_keyed, "long")(host)).join(F.broadcast(hot), key, "left")
    hosted = hosted.withColumn(salt, F.pmod(F.xxhash64("url", F.length("html")), F.coalesce(F.col(salt), F.lit(1)))).join(by_host, [key, salt], "left")
    done = hosted.withColumn(into, F.arrow_udf(joined, kind).asNondeterministic()("html", host, keys))
    return done.select(*(F.col(f"`{c}`") for c in pages.columns), into)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "extracted.text", "extracted.removed")
