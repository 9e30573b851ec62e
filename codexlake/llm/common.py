"""What the operators share: Arrow batches of texts, vectorised word and shingle hashes.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. All of these bytes are ASCII, so
the work is done on UTF-8 bytes with numpy, a few MB of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.cluster import ship

#: Bytes of text held as numpy arrays at a time.
CHUNK_BYTES = 2 << 20
#: Arrow batches sent to Python workers.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches by rows and bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, matched by exact name first so that columns clashing only in case do no harm."""
    picked = []
    for n in names:
        at = [i for i, c in enumerate(df.columns) if c == n] or [i for i, c in enumerate(df.columns) if c.lower() == n.lower()]
        if not at:
            raise ValueError(f"column {n!r} is missing; there are {df.columns}")
        picked.append(at[0])
    unique = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"c{i}").alias(n) for i, n in zip(picked, names, strict=True)])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values (nulls are empty) and the offset of each value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most about `most` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int, _kept: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(_kept[0]) < n:
        with np.errstate(over="ignore"):
            _kept[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 64) - 1, _BASE, np.uint64)]), dtype=np.uint64)
    return _kept[0]


def word_spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it is in."""
    solid = ~_SPACE[low]
    before = np.empty_like(solid)
    before[:1], before[1:] = False, solid[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(low)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:], after[:-1] = False, solid[1:]
    cuts = inner[(inner > 0) & (inner <= len(low))] - 1
    after[cuts] = False
    ends = np.flatnonzero(solid & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        terms = (low[place + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[place]
        return mix(np.add.reduceat(terms, first) + lens.astype(np.uint64) * _MULT)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the row it is in; the bytes are taken in bounded pieces, cut at white space."""
    hashes, rows = [], []
    for lo, hi in slices(offsets):
        at = int(offsets[lo])
        end = int(offsets[hi])
        while at < end:
            stop = min(end, at + 2 * CHUNK_BYTES)
            if stop < end:
                gap = np.flatnonzero(_SPACE[raw[at:stop]])
                while not len(gap) and stop < end:
                    stop = min(end, stop + CHUNK_BYTES)
                    gap = np.flatnonzero(_SPACE[raw[at:stop]])
                stop = at + int(gap[-1]) + 1 if len(gap) and stop < end else stop
            low = lowered(raw[at:stop])
            own = np.clip(offsets[lo : hi + 1] - at, 0, stop - at)
            s, e, r = word_spans(low, own)
            hashes.append(word_hashes(low, s, e))
            rows.append(r + lo)
            at = stop
    return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words and its row; a row of fewer words has its whole sequence as one."""
    if not len(hashes):
        return hashes, rows
    begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    counts = np.diff(np.concatenate([begins, [len(rows)]]))
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * _MULT) | np.uint64(1)
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for j in range(n):
            total += hashes[j : j + len(total)] * factors[j]
        whole = rows[: len(total)] == rows[n - 1 :] if len(total) else np.zeros(0, bool)
        out, own = [mix(total[whole] + np.uint64(n))], [rows[: len(total)][whole]]
        short = np.flatnonzero(counts < n)
        if len(short):
            acc = np.zeros(len(short), np.uint64)
            for j in range(n - 1):
                on = counts[short] > j
                acc[on] += hashes[begins[short[on]] + j] * factors[j]
            out.append(mix(acc + counts[short].astype(np.uint64)))
            own.append(rows[begins[short]])
    h, r = np.concatenate(out), np.concatenate(own)
    if len(short):
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def distinct_by_row(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending within a row; rows ascend."""
    if not len(h):
        return h, rows
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])
    return h[keep], rows[keep]


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in an ascending array of row numbers; n + 1 values."""
    return np.searchsorted(rows, np.arange(n + 1))


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in parts of bounded text, each with its bytes and offsets."""
    raw, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    for lo, hi in slices(offsets, most):
        yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
