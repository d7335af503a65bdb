"""Pages to text, links and chunks; incremental re-indexing; near-duplicate questions."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions import text as X
from kbspark.sources.tables import written

#: Words of a chunk, words repeated from the chunk before, and the least that makes a chunk.
CHUNK_WORDS, OVERLAP, LEAST_WORDS = 350, 40, 10
#: Pages or texts that a task has open at once as Python values.
READ_AT_ONCE = CHUNKED_AT_ONCE = 64
_BLOCKS = frozenset("p div section article ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre form header footer nav aside main figure dl dt dd hr address fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    """Collects the text of a page and its links: all of them, and those of the main scope."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, skipped, in scope
        self.all: list[str] = []
        self.scope: list[str] = []
        self.links: list[str] = []
        self.scope_links: list[str] = []

    def _put(self, text: str) -> None:
        skipped, scope = self.stack[-1][1:] if self.stack else (False, False)
        if not skipped:
            self.all.append(text)
            if scope:
                self.scope.append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        skipped, scope = self.stack[-1][1:] if self.stack else (False, False)
        scope = scope or tag in ("main", "article") or a.get("role") == "main" or bool({"content", "main-content"} & {a.get("id"), *(a.get("class") or "").split()})
        skipped = skipped or tag in ("script", "style", "noscript", "nav", "head") or not scope and tag in ("header", "footer", "aside") or bool(re.search(r"breadcrumb|share-buttons", a.get("class") or ""))
        if tag == "a" and a.get("href") and not skipped:
            self.links.append(a["href"])
            if scope:
                self.scope_links.append(a["href"])
        if tag == "br":
            self._put("\n")
        elif tag in _BLOCKS:
            self._put("\n\n")
        if tag not in _VOID:
            self.stack.append((tag, skipped, scope))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
        if tag in _BLOCKS:
            self._put("\n\n")

    def handle_data(self, data):
        self._put(data)


def page_text(page: str | None) -> str:
    """The text of a page's main scope, or of all but its chrome: paragraphs between blank lines."""
    reader = _read(page)
    text = "".join(reader.scope if "".join(reader.scope).strip() else reader.all)
    text = re.sub(r"[ \t\xa0\r\f\v]+", " ", unescape(text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def _read(page: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    return reader


def chunks_of(text: str | None) -> list[str]:
    """Paragraphs gathered up to CHUNK_WORDS words, each chunk starting with the last OVERLAP words of the one before."""
    out, buffer, count = [], [], 0
    for paragraph in re.split(r"\n\s*\n", text or ""):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        words = len(paragraph.split())
        if buffer and count + words > CHUNK_WORDS:
            out.append("\n\n".join(buffer))
            tail = " ".join(" ".join(buffer).split(" ")[-OVERLAP:])
            buffer, count = [tail], len(tail.split())
        buffer.append(paragraph)
        count += words
    if buffer:
        out.append("\n\n".join(buffer))
    return [c for c in out if len(c.split()) >= LEAST_WORDS]


@F.arrow_udf(T.StringType())
def _text(pages: pa.Array) -> pa.Array:
    # a few pages at a time: as Python values a whole batch of them would be several times as large
    parts = [pages.slice(at, READ_AT_ONCE) for at in range(0, len(pages), READ_AT_ONCE)]
    return pa.concat_arrays([pa.array([page_text(p) for p in part.to_pylist()], pa.string()) for part in parts] or [pa.array([], pa.string())])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _links(pages: pd.Series) -> pd.Series:
    def links(page):
        reader = _read(page)
        return list(dict.fromkeys(reader.scope_links or reader.links))

    return pages.map(links)


def _chunk_rows(batches):
    """Chunks of (source_id, text) batches, a few texts at a time: a batch's chunks never lie in memory together."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNKED_AT_ONCE):
            part = batch.slice(at, CHUNKED_AT_ONCE)
            texts = [chunks_of(t) for t in part.column(1).to_pylist()]
            rows = [i for i, t in enumerate(texts) for _ in t]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array([k for t in texts for k in range(len(t))], pa.int32()), pa.array([c for t in texts for c in t], pa.string())], names=["source_id", "chunk_index", "content"])


def html_to_text(html: Column) -> Column:
    return _text(html)


def html_title(html: Column) -> Column:
    return X.squeeze(X.strip_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): the different allowed links of a page's main scope, resolved."""
    rows = pages.select("page_id", "url", F.explode(_links("html")).alias("href"))
    rows = rows.select("page_id", "url", X.resolve_url(F.col("href"), F.col("url")).alias("link"))
    return rows.where(X.is_allowed_url(F.col("link"), F.col("url"))).select("page_id", X.normalise_url(F.col("link")).alias("link")).distinct()


def _by_url(rows: DataFrame) -> DataFrame:
    """rows(url, …) with normalised urls; those that are so already, most as a rule, take a path of their own."""
    done = X.is_normalised_url(F.col("url"))
    return rows.where(done).union(rows.where(~done).withColumn("url", X.normalise_url(F.col("url"))))


def crawl_frontier(links: DataFrame, seeds: DataFrame, pages: DataFrame | None = None, depth: int = 2, most: int = 50) -> DataFrame:
    """(job, url, depth, place): the pages that each crawl of seeds(job, url) finds, in order, at most `most` of a job.

    links(url, link, place): a page's links in their order; pages(url): those that can be had (all if not given), others are passed
    over and their links not followed. Urls are the same if they are the same normalised. A page is found at its least depth; pages of one
    depth come in the order in which they were first linked: by the place of the linking page, then that of the link, then by url.
    Levels are written one by one, and the crawl ends with the first that is empty; a level has at most `most` rows a job.
    """
    same = lambda c: X.normalise_url(F.col(c))
    # links are normalised when their page is reached, not all of them before
    edges = _by_url(links.where("link is not null").select("url", "link", F.col("place").alias("at")))
    known = _by_url(pages.select("url")) if pages is not None else None

    def level(found: DataFrame, before: DataFrame | None, d: int) -> DataFrame:
        """found(job, url, first) as the places after those of before, as far as there is room."""
        if known is not None:  # few urls are found, so the pages go past them
            found = written(found)
            found = found.join(known.join(found.select("url").distinct(), "url", "left_semi"), "url", "left_semi")
        taken = F.lit(0)
        if before is not None:
            found = found.join(before.groupBy("job").agg(F.max("place").alias("taken")), "job")
            taken = F.col("taken")
        place = taken + F.row_number().over(Window.partitionBy("job").orderBy("first", "url"))
        return written(found.withColumn("place", place.cast("int")).where(F.col("place") <= most).select("job", "url", F.lit(d).alias("depth"), "place"))

    out = last = level(seeds.groupBy("job", same("url").alias("url")).agg(F.min("url").alias("first")), None, 0)
    for d in range(1, depth + 1):
        linked = last.join(edges, "url").groupBy("job", same("link").alias("url")).agg(F.min(F.struct("place", "at")).alias("first"))
        last = level(linked.join(out.select("job", "url"), ["job", "url"], "left_anti"), out, d)
        if last.isEmpty():
            break
        out = out.unionByName(last)
    return out


def chunk_text(sources: DataFrame, text: str = "text") -> DataFrame:
    """(source_id, chunk_index, content, word_count) from sources(source_id, text)."""
    schema = T.StructType([T.StructField("source_id", sources.schema["source_id"].dataType), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
    rows = sources.select("source_id", text).mapInArrow(_chunk_rows, schema)
    return rows.withColumn("word_count", F.size(F.split(F.trim("content"), r"\s+")))


def reindex_plan(current: DataFrame, stored: DataFrame, forced: bool = False) -> DataFrame:
    """(source_id, content_hash, action): new, unchanged, changed, rechunked (forced) or error (no text)."""
    trimmed = F.trim(F.coalesce("text", F.lit("")))
    now = current.select("source_id", F.sha2(trimmed, 256).alias("content_hash"), (trimmed == "").alias("empty"))
    rows = now.join(stored.select("source_id", F.col("content_hash").alias("was")), "source_id", "left")
    same = F.lit("rechunked" if forced else "unchanged")
    action = F.when(F.col("empty"), "error").when(F.col("was").isNull(), "new").when(F.col("was") == F.col("content_hash"), same).otherwise("changed")
    return rows.select("source_id", "content_hash", action.alias("action"))


def source_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"), F.sum("word_count").alias("word_count"))


def register_sources(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """(url, action) for the given urls: insert if unknown, reindex if in error or pending, else skip."""
    given = urls.select(X.normalise_url(F.col("url")).alias("url")).distinct()
    known = sources.groupBy(X.normalise_url(F.col("url")).alias("url")).agg(F.max(F.col("status").isin("error", "pending").cast("int")).alias("again"))
    return given.join(known, "url", "left").select("url", F.when(F.col("again").isNull(), "insert").when(F.col("again") == 1, "reindex").otherwise("skip").alias("action"))


def near_duplicate_questions(questions: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, similarity): different question keys whose tokens overlap by `least` or more, both ways round once.

    Exact prefix filter: tokens are ordered from rare to frequent, and two sets that overlap so much share one
    of the first n - ceil(least * n) + 1; only those are joined, so frequent words are hardly ever keys."""
    keys = questions.select(X.dedup_key(F.col("question")).alias("k")).where("k <> ''").distinct()
    sets = keys.select("k", F.array_distinct(X.tokenize(F.col("k"))).alias("t"))
    pairs = sets.select("k", F.explode("t").alias("w"))
    counts = pairs.groupBy("w").agg(F.count("*").alias("df"))
    ranked = pairs.join(counts, "w").withColumn("n", F.count("*").over(Window.partitionBy("k"))).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("df", "w")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("k", "w", "n")
    a, b = prefix.alias("a"), prefix.alias("b")
    found = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.k") < F.col("b.k")) & (F.col("a.n") >= least * F.col("b.n")) & (F.col("b.n") >= least * F.col("a.n")))
    found = found.select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()
    ta, tb = F.array_distinct(X.tokenize(F.col("a"))), F.array_distinct(X.tokenize(F.col("b")))
    return found.withColumn("similarity", F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))).where(F.col("similarity") >= least)
