"""Document fingerprints: bottom-k sketches of 5-word shingle hashes.

The k smallest distinct shingle hashes of a text stand for its shingle set. Sketches of parts merge
into the sketch of the whole, and two sketches estimate resemblance, containment and the number of
distinct shingles. With at most k shingles every estimate is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.llm.common import bounds, distinct_by_row, only, prepare, shingles, slices, table, utf8, words

SHINGLE_WORDS, K = 5, 128
#: Bytes kept of each hash.
WIDTH = 5
#: Text bytes that a range of ids should hold, and the most ranges; a range is streamed, not held.
RANGE_BYTES, MOST_RANGES = 20 << 20, 20_000


def sketches(raw: np.ndarray, offsets: np.ndarray, k: int = K, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The k smallest shingle hashes of each text, ascending, cut to WIDTH bytes; a text without words has none."""
    out: list[np.ndarray] = []
    for lo, hi in slices(offsets):
        h, rows = words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        h, rows = shingles(h, rows, n)
        h, rows = distinct_by_row(h >> np.uint64(64 - 8 * WIDTH), rows)
        cut = bounds(rows, hi - lo)
        out += [h[a : min(b, a + k)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :]).tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, WIDTH)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - WIDTH :] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A or B|; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    fresh = np.concatenate([[True], ~twice])
    last = np.flatnonzero(fresh)[:k]
    top = both[last[-1]]
    return float((twice & (both[1:] <= top)).sum() / len(last))


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / 2.0 ** (8 * WIDTH))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A|; an empty A is contained in anything."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint, n_shingles) of every text; null is empty. Rows repeat as their inputs do."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(s) for s in found], pa.string()), pa.array([distinct_count(s) for s in found], pa.float64())], names=["doc_id", "fingerprint", "n_shingles"])

    docs = only(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string, n_shingles double")


def merge_parts(parts: DataFrame, key: str, hashes: str = "hashes", k: int = K) -> DataFrame:
    """Sketches of the wholes from sketches (array of bigint) of their parts; at most k values of a key and task are sorted on."""
    values = parts.select(key, F.explode(hashes).alias("h")).distinct()
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias(hashes))


def _ranges(docs: DataFrame) -> tuple[list[int], int]:
    """Lower bounds of the id ranges after the first, and how many ranges were aimed at."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("b")).first().b or 0
    n = int(min(MOST_RANGES, max(1, -(-size // RANGE_BYTES))))
    cuts = sorted(set(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("d")).approxQuantile("d", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    return [int(c) for c in cuts], n


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id and sorted; each range also gets the first row of the range after it.

    Texts move once. A null doc_id comes before all others; rows of one id are in the order of their texts.
    The last range gets the very first row, so that the row after the last is the first.
    """
    spark = docs.sparkSession
    cuts, n = _ranges(docs)
    edges = np.array(cuts, np.int64)

    def ids_to_range(ids: pa.Array) -> np.ndarray:
        filled = ids.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return np.searchsorted(edges, filled, side="right").astype(np.int32)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ids_to_range(b.column(0))), b.column(0).cast(pa.int64()).fill_null(-(2**63))], names=["r", "d"])

    heads = {x.r: x.d for x in docs.select("doc_id").mapInArrow(firsts, "r int, d bigint").groupBy("r").agg(F.min("d").alias("d")).collect()}  # a row for each range
    order = sorted(heads)
    before = {heads[r]: order[i - 1] for i, r in enumerate(order)}
    head_ids = np.array(sorted(before), np.int64)
    goes_to = np.array([before[h] for h in sorted(before)], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = b.column(0).cast(pa.int64()), b.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids_to_range(ids)), pa.array(np.zeros(len(b), bool)), ids, text], names=["r", "extra", "doc_id", "text"])
            filled = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(head_ids, filled)
            hit = np.flatnonzero((at < len(head_ids)) & (head_ids[np.minimum(at, len(head_ids) - 1)] == filled)) if len(head_ids) else np.zeros(0, np.int64)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(goes_to[at[hit]]), pa.array(np.ones(len(hit), bool)), ids.take(pa.array(hit)), text.take(pa.array(hit))], names=["r", "extra", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "r int, extra boolean, doc_id bigint, text string")
    return dealt.repartition(max(n, 1), "r").sortWithinPartitions("r", "extra", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the start of the following text."""
    n = len(text)
    return text[: n - n // 4] + following[: n // 4]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts are empty; the only row of a table follows itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = only(docs, "doc_id", "text")

    def finish(pairs: list[tuple]) -> pa.RecordBatch:
        own = [p[1] for p in pairs]
        after = [p[2] for p in pairs]
        edited = [edited_text(a, b) for a, b in zip(own, after, strict=True)]
        chain = own + [after[-1]]  # the text after a row is mostly the next row's own
        s = sketches(*utf8(pa.array(chain, pa.large_string())))
        e = sketches(*utf8(pa.array(edited, pa.large_string())))
        follow = [s[i + 1] if after[i] == chain[i + 1] else sketches(*utf8(pa.array([after[i]], pa.large_string())))[0] for i in range(len(pairs))]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([p[0] for p in pairs], pa.int64()), "n_chars": pa.array([len(t) for t in own], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [encode(x) for x in s[:-1]], "edited_fingerprint": [encode(x) for x in e],
            "near_edited": [resemblance(a, b) for a, b in zip(s, e, strict=False)], "near_next": [resemblance(a, b) for a, b in zip(s, follow, strict=False)],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text) that waits for the row after it
        pairs, size = [], 0
        for batch in batches:
            for r, extra, d, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                t = t or ""
                if held is not None and held[0] == r:
                    pairs.append((held[1], held[2], t))
                    size += len(held[2]) + len(t)
                held = None if extra else (r, d, t)
                if size >= 4 << 20:
                    yield finish(pairs)
                    pairs, size = [], 0
        if pairs:
            yield finish(pairs)

    kinds = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, kinds)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all `documents` and of their edited texts. Ids must be whole numbers; null and empty texts, repeats, null ids and an empty table as in `compare_with_edits`."""
    return compare_with_edits(table(spark, sf_dir, "documents"))
