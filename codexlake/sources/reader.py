"""Reading pages and feeds, turning HTML into articles, chunks, and writing articles."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.cluster import ship
from codexlake.functions.text import collapse_newlines, derive_title, entity_id, preview, snippet

#: Bounds of what is read of a page, and the tags that end a line or hide what they hold.
HEAD_BYTES, TEXT_CHARS = 256 * 1024, 64_000
#: Characters of texts whose chunks a task holds before it sends them on.
CHUNKED = 1 << 20
BLOCK_TAGS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav blockquote pre hr td th title".split())
HIDDEN_TAGS = frozenset(("script", "style", "noscript", "template"))


def read_pages(spark: SparkSession, path: str, mime: str | Column = "text/html") -> DataFrame:
    """Pages of text types; `mime` is one type for all or a column of the table. Upper and lower case are alike; a null type is left out."""
    return spark.read.parquet(path).withColumn("mime", F.lower(F.lit(mime) if isinstance(mime, str) else mime)).where(F.col("mime").startswith("text/"))


_CHARSET = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)|<\?xml[^>]+encoding\s*=\s*["']([A-Za-z0-9_.:-]+)""", re.I)
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def decoded(raw: bytes) -> str | None:
    """The text of a file by its byte order mark, or the encoding that its first 1024 bytes declare, else UTF-8; None if it is no text."""
    charset = next((name for mark, name in _MARKS if raw.startswith(mark)), None)
    if charset is None:
        if b"\0" in raw[:1024]:
            return None
        said = _CHARSET.search(raw[:1024])
        charset = (said[1] or said[2]).decode() if said else "utf-8"
    try:
        return raw.decode(charset, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def read_html_folder(spark: SparkSession, folder: str, files: str = "*") -> DataFrame:
    """(page_id, url, html) of the text files in a folder and those below it; what a file is shows in its content, not in its name.

    page_id is a hash of the path, which is the url. A page is one cell, so files are those of single pages.
    """
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", "true").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decoded(x) for x in b.column(1).to_pylist()], pa.string())], names=["url", "html"])

    return found.select("path", "content").mapInArrow(run, "url string, html string").where("html is not null").select(F.xxhash64("url").alias("page_id"), "url", "html")


def read_snapshot(spark: SparkSession, folder: str, files: str = "*.[zZ][iI][mM]") -> DataFrame:
    """(name, path, mtime, size) of the archives in a folder, without reading them; `files` is the pattern of their names."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


LINK = "array<struct<_rel:string,_href:string,_type:string,_hash:string,_digest:string>>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries (id, title, updated, links) of a feed; those with neither id nor title go."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(f"id string, title string, updated string, link {LINK}").load(path)
    return raw.where("id is not null or title is not null").withColumnRenamed("link", "links")


def write_articles(articles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by archive; an overwrite replaces only the archives that are written."""
    articles.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("archive").parquet(path)


def redact(df: DataFrame, columns: list[str], authorised: bool) -> DataFrame:
    return df if authorised else df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit("[redacted]")) for c in columns})


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.hidden, self.in_title = 0, False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN_TAGS
        self.in_title = self.in_title or tag == "title"
        if tag in BLOCK_TAGS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN_TAGS))
        if tag == "title":
            self.in_title = False
        if tag in BLOCK_TAGS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.out.append(data)


def strip_html(page: str | None) -> tuple[str, str]:
    """(title, text): block tags become line ends, entities are decoded, scripts and styles go."""
    p = _Text()
    p.feed((page or "").encode()[:HEAD_BYTES].decode("utf-8", "ignore"))
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    text = "\n".join(lines).strip()[:TEXT_CHARS]
    return entities.unescape(" ".join("".join(p.title).split())), text


def with_text(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with their title and text."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [strip_html(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["page_id", "url", "html", "title", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, html string, title string, text string")


def pages_to_articles(pages: DataFrame) -> DataFrame:
    """(page_id, path, title, content_preview, snippet, qid) of pages with text."""
    t = with_text(pages).withColumn("text", collapse_newlines("text")).where("text <> ''")
    return t.select("page_id", F.col("url").alias("path"), F.when(F.col("title") != "", F.col("title")).otherwise(derive_title("url")).alias("title"), preview("text").alias("content_preview"), snippet("text").alias("snippet"), entity_id("html").alias("qid"))


def chunk_text(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[int, int, str]]:
    """(start, end, text) of overlapping windows, in bytes: cut after a line, else a blank, else hard, never within a character."""
    size = min(max(size, 10), 100_000)
    overlap = max(0, min(overlap, size - 1, size // 2))
    raw, out, start = text.encode(), [], 0

    def up(i: int) -> int:
        while i < len(raw) and raw[i] & 0xC0 == 0x80:
            i += 1
        return i

    def down(i: int) -> int:
        while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
            i -= 1
        return i

    while start < len(raw):
        end = up(min(len(raw), start + size))
        if end < len(raw):
            cut = raw.rfind(b"\n", start, end)
            cut = cut if cut > start else raw.rfind(b" ", start, end)
            end = cut + 1 if cut > start else end
        body = raw[start:end].decode().strip()
        if body:
            out.append((start, end, body))
        if end >= len(raw):
            break
        start = max(down(end - overlap), up(start + 1))
    return out


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, index, start, end, chunk) of every text; a task sends the chunks on after CHUNKED characters of texts."""
    ship(docs.sparkSession)
    chunk = size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for d, t in zip(b.column(0), b.column(1), strict=True):
                text = t.as_py() or ""
                rows += [(d.as_py(), i, *c) for i, c in enumerate(chunk_text(text, size=chunk, overlap=overlap))]
                size += len(text)
                if size >= CHUNKED:
                    yield batched(rows)
                    rows, size = [], 0
            yield batched(rows)

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "index", "start", "end", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, index int, start bigint, end bigint, chunk string")
