"""A stored index of vectors: cells around centres, short codes of what is left, exact cosines for the best.

Vectors are scaled to length one and lie with the nearest of the cells' centres; what is left of them is cut into
pieces, each named by the nearest of 256 pieces (product quantisation). A query looks into the cells nearest to it and
adds up, for each code there, products from a table that it makes once; only its best few hundred ids are fetched and
compared exactly. Centres and pieces are fitted on a bounded sample, every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.cluster import ship

#: Vectors that centres and pieces are fitted on at most, those of the smallest id hashes, and the rounds of fitting.
SAMPLE, ROUNDS = 100_000, 10
#: Cells at least, pieces of a vector, cells of a stored part, and the share of the cells that a query looks into.
LEAST_CELLS, PIECES, CELLS_A_PART, PROBED = 100, 16, 16, 0.5
#: Ids that a query compares exactly, at least and for each row that it asks for.
RERANKED, RERANKED_EACH = 200, 20
#: Guesses that a task gathers, about, before it keeps each query's best of them.
MOST_PENDING = 1 << 20


@dataclass(frozen=True)
class Cells:
    """Centres (cells, dims) and pieces (pieces, 256, dims of one) of an index at a path. The last piece is filled up with zeros."""

    path: str
    kind: str
    centres: np.ndarray
    pieces: np.ndarray


def fitted(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k means of the rows; a mean that no row is nearest to stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(near[order]) != 0]))
        centres[near[order][at]] = np.add.reduceat(x[order], at) / np.diff(np.append(at, len(x)))[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(half - part @ centres.T).argmin(1) for part in np.array_split(x, max(1, len(x) * len(centres) // (1 << 23)))] or [np.zeros(0, int)])


def units(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors of length one) of the usable values of a column of vectors; others are left out. Of other dimensions than `dims` is an error."""
    values = column.to_pylist()
    at = [i for i, v in enumerate(values) if v is not None and len(v) and None not in v]
    if dims is not None and any(len(values[i]) != dims for i in at):
        raise ValueError(f"the index holds vectors of {dims} dimensions only")
    m = np.array([values[i] for i in at], np.float64) if at else np.zeros((0, dims or 0))
    size = np.linalg.norm(m, axis=1)
    fine = np.isfinite(size) & (size > 0)
    return np.array(at, int)[fine], m[fine] / size[fine, None]


def cut(x: np.ndarray, pieces: int) -> np.ndarray:
    """Rows cut into pieces of one length, (rows, pieces, length)."""
    length = -(-x.shape[1] // pieces)
    return np.pad(x, ((0, 0), (0, length * pieces - x.shape[1]))).reshape(len(x), pieces, length)


def write_cells(vectors: DataFrame, path: str, lists: int | None = None, pieces: int = PIECES, seed: int = 1, sample: int = SAMPLE) -> None:
    """Index the vectors (id, embedding): max(100, floor(sqrt(n))) cells unless given, no more than sampled vectors.

    Null, zero and non-finite vectors are not indexed; vectors of several dimensions are an error. A table without
    usable vectors gives an index that finds nothing.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    _, x = units(some["embedding"].combine_chunks())
    dims = x.shape[1]
    lists = min(lists or max(LEAST_CELLS, int(n**0.5)), len(x))
    centres = fitted(x, lists, seed) if lists else np.zeros((0, dims))
    left = cut(x - centres[nearest(x, centres)], pieces) if lists else np.zeros((0, pieces, 1))
    books = np.stack([fitted(np.ascontiguousarray(left[:, p]), min(256, len(x)), seed + p) for p in range(pieces)]) if lists else np.zeros((pieces, 0, 1))
    model = spark.sparkContext.broadcast((centres, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = model.value
        for b in batches:
            at, v = units(b.column(1), dims if lists else None)
            cell = nearest(v, centres)
            rest = cut(v - centres[cell], len(books))
            code = np.stack([nearest(np.ascontiguousarray(rest[:, p]), books[p]) for p in range(len(books))], axis=1).astype(np.uint8)
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), len(at), [None, pa.py_buffer(np.ascontiguousarray(code).tobytes())]).cast(pa.binary())
            ids = b.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array((cell // CELLS_A_PART).astype(np.int32)), pa.array(cell.astype(np.int32)), ids, codes, pa.array(list(v), pa.list_(pa.float64()))], names=["part", "cell", "id", "code", "unit"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"part int, cell int, id {kind}, code binary, unit array<double>") if lists else spark.createDataFrame([], f"part int, cell int, id {kind}, code binary, unit array<double>")
    found.repartition("part").sortWithinPartitions("part", "cell", "id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    spark.createDataFrame([(kind, centres.tobytes(), books.tobytes(), dims, pieces)], "kind string, centres binary, books binary, dims int, pieces int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def open_cells(spark: SparkSession, path: str) -> Cells:
    a = spark.read.parquet(f"{path}/about").first()
    centres = np.frombuffer(bytes(a.centres)).reshape(-1, max(1, a.dims))
    books = np.frombuffer(bytes(a.books))
    return Cells(path, a.kind, centres, books.reshape(a.pieces, -1, max(1, -(-a.dims // a.pieces))))


def search_cells(queries: DataFrame, index: Cells, k: int, probes: int | None = None, rerank: int | None = None, most_queries: int = 2_000) -> DataFrame:
    """(query_id, id, sim): the k best of each query (query_id, q) among those compared exactly; of equal cosines the smallest ids.

    A query looks into `probes` cells, half of them unless given, and compares `rerank` ids. Queries are broadcast, in parts of
    about `most_queries`; null, zero and non-finite ones find nothing, those of other dimensions are an error.
    """
    spark = queries.sparkSession
    ship(spark)
    probes = probes or max(8, round(len(index.centres) * PROBED))
    rerank = rerank or max(RERANKED, RERANKED_EACH * k)
    parts = max(1, -(-queries.count() // most_queries))
    marked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("_part"))
    return reduce(DataFrame.unionByName, [_searched(marked.where(F.col("_part") == i), index, k, probes, rerank) for i in range(parts)])


def _best(asked: list[np.ndarray], score: list[np.ndarray], row: list[np.ndarray], rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's `rerank` best guesses; of equal ones the first."""
    a, s, r = (np.concatenate(x) for x in (asked, score, row))
    order = np.lexsort((-s, a))
    a, s, r = a[order], s[order], r[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < rerank
    return a[keep], s[keep], r[keep]


def _searched(queries: DataFrame, index: Cells, k: int, probes: int, rerank: int) -> DataFrame:
    spark = queries.sparkSession
    rows = queries.toArrow()
    at, q = units(rows["q"].combine_chunks(), index.centres.shape[1] if len(index.centres) else None)
    names = rows["query_id"].combine_chunks().take(pa.array(at))
    kinds = {"q": queries.schema["query_id"].dataType.simpleString(), "id": index.kind}
    if not len(at) or not len(index.centres):
        return spark.createDataFrame([], f"query_id {kinds['q']}, id {kinds['id']}, sim double")
    to_centre = q @ index.centres.T
    near = np.argsort((index.centres * index.centres).sum(1) - 2 * to_centre, axis=1)[:, :probes]
    probed = np.zeros(to_centre.shape, bool)
    np.put_along_axis(probed, near, True, axis=1)
    # what each piece adds to a query's product, and which cells anyone looks into
    tables = np.einsum("npl,pcl->npc", cut(q, len(index.pieces)), index.pieces).astype(np.float32)
    shared = spark.sparkContext.broadcast((q, to_centre.astype(np.float32), probed, tables))
    wanted = np.unique(np.flatnonzero(probed.any(0)) // CELLS_A_PART).tolist()
    stored = spark.read.parquet(f"{index.path}/rows").where(F.col("part").isin(wanted))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, to_centre, probed, tables = shared.value
        n = len(tables)
        best = (np.zeros(0, np.int64), np.zeros(0, np.float32), [])
        for b in batches:
            cell = b.column(0).to_numpy()
            code = np.frombuffer(b.column(2).cast(pa.binary(tables.shape[1])).buffers()[1], np.uint8)[b.column(2).offset * tables.shape[1] :][: len(b) * tables.shape[1]].reshape(len(b), -1)
            asked, score, row = [best[0]], [best[1]], [np.arange(len(best[0]))]
            for c in np.unique(cell):
                inside, who = np.flatnonzero(cell == c), np.flatnonzero(probed[:, c])
                for part in np.array_split(who, max(1, len(inside) * len(who) // (1 << 20))):
                    s = to_centre[part, c][:, None] + sum(tables[part, p][:, code[inside, p]] for p in range(tables.shape[1]))
                    top = np.argpartition(-s, rerank - 1, axis=1)[:, :rerank] if s.shape[1] > rerank else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                    asked.append(np.repeat(part, top.shape[1]))
                    score.append(np.take_along_axis(s, top, 1).ravel())
                    row.append(inside[top].ravel() + len(best[0]))
                if sum(map(len, asked)) > MOST_PENDING:
                    asked, score, row = ([x] for x in _best(asked, score, row, rerank))
            a, s, r = _best(asked, score, row, rerank)
            ids = pa.concat_arrays([*best[2], b.column(1)]).take(pa.array(r))
            best = (a, s, [ids])
        if n and len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), best[2][0], pa.array(best[1].astype(np.float64))], names=["asked", "id", "guess"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value[0]
        for b in batches:
            x = np.array(b.column(2).to_pylist(), np.float64).reshape(len(b), q.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((q[b.column(0).to_numpy()] * x).sum(1))], names=["asked", "id", "sim"])

    guessed = stored.select("cell", "id", "code").mapInArrow(guess, f"asked bigint, id {kinds['id']}, guess double")
    few = guessed.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("guess"), "id"))).where(F.col("r") <= rerank).select("asked", "id")
    sims = few.join(stored.select("id", "unit"), "id").select("asked", "id", "unit").mapInArrow(exact, f"asked bigint, id {kinds['id']}, sim double")
    best = sims.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc(F.round("sim", 9)), "id"))).where(F.col("r") <= k)
    known = spark.createDataFrame(pa.table({"asked": pa.array(np.arange(len(at))), "query_id": names}))
    return best.join(known, "asked").select(F.col("query_id").cast(kinds["q"]).alias("query_id"), "id", "sim")
