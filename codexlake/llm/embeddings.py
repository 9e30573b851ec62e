"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, connected components.

Random hyperplanes give each vector a long sign signature; each table's code is a run of its bits, and
vectors of one code in any table are candidates. Only ids and signatures are dealt to the tables'
buckets, where the distance of signatures tells which vectors have a partner worth comparing; these
vectors alone follow, and are compared exactly. A pair that meets in several tables counts in the
first of them only: the signature holds the codes of all tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.cluster import settle
from codexlake.llm.common import only, prepare, table
from codexlake.llm.components import components

SEED = 5
COSINE = 0.95
#: Vectors that a bucket should hold on average, and the share of pairs just at the threshold that all tables together may miss.
BUCKET, MISSED = 256, 1e-4
#: Bits of a signature at least, and how many standard deviations beyond the expected distance of a pair at the threshold are still compared.
SIGNATURE_BITS, SLACK = 256, 6.5
#: A bucket is compared in blocks of about so many vectors, so one task never holds a whole hot bucket.
BLOCK = 2048


def layout(rows: int, cosine: float = COSINE, missed: float = MISSED) -> tuple[int, int]:
    """(tables, signs): signs grow with the logarithm of the rows, so that buckets stay small; tables follow from the pairs that may be missed."""
    signs = min(30, max(8, math.ceil(math.log2(max(1, rows) / BUCKET))))
    return max(1, math.ceil(math.log(missed) / math.log1p(-(agreement(cosine) ** signs)))), signs


def agreement(cosine: float) -> float:
    """How likely two vectors of this cosine are on the same side of a random hyperplane."""
    return 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, fine): fine is false for vectors that are null, empty, zero or hold null or non-finite components."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    return only(vectors, "vec_id", "embedding").select("vec_id", v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one without overflow."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def signatures(unit: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """One byte row of signs per vector; the hyperplanes of a dimension are the same in every task."""
    planes = np.random.Generator(np.random.Philox(seed)).standard_normal((unit.shape[1], bits))
    return np.packbits(unit @ planes > 0, axis=1, bitorder="little")


def codes(signs: np.ndarray, tables: int, width: int) -> np.ndarray:
    """Each table's code: the next `width` bits of the signature."""
    bits = np.unpackbits(signs, axis=1, bitorder="little")[:, : tables * width].reshape(len(signs), tables, width)
    return (bits.astype(np.int64) << np.arange(width)).sum(axis=2).astype(np.int32)


def _rows(batch: pa.RecordBatch, column: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each dimension in a batch."""
    lists = batch.column(batch.schema.get_field_index(column))
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()[:-1]
    return [(np.flatnonzero(lens == d), np.stack([flat[s : s + d] for s in starts[lens == d]])) for d in np.unique(lens)]


def bucketed(vectors: DataFrame, tables: int, signs: int, bits: int, seed: int) -> DataFrame:
    """(dim, t, code, node, signature) of every distinct vector (node, v) in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in _rows(batch, "v"):
                raw = signatures(unit_rows(v), bits, seed)
                code = codes(raw, tables, signs)
                ids, body = batch.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in raw], pa.binary())
                dim = pa.array(np.full(len(at), v.shape[1], np.int32))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([dim, pa.array(np.full(len(at), t, np.int32)), pa.array(code[:, t]), ids, body], names=["dim", "t", "code", "node", "signature"])

    return vectors.select("node", "v").mapInArrow(run, "dim int, t int, code int, node bigint, signature binary")


def block_pairs(own: np.ndarray, i: int, j: int, left: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): places whose products are the pairs of blocks i and j, a bounded number of rows on the left at a time."""
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for lo in range(0, len(a), left):
        yield a[lo : lo + left], b


def earlier(code: np.ndarray, p: np.ndarray, q: np.ndarray, t: int) -> np.ndarray:
    """Pairs that meet in a table before t."""
    met = np.zeros(len(p), bool)
    for s in range(0, len(p) if t else 0, 200_000):
        part = slice(s, s + 200_000)
        met[part] = (code[p[part], :t] == code[q[part], :t]).any(axis=1)
    return met


def promising(rows: DataFrame, cosine: float, tables: int, signs: int, bits: int, block: int = BLOCK) -> DataFrame:
    """(dim, t, code, i, j, own, node, signature): the vectors of each block pair that have a partner there, not met in an earlier table, within reach by signature.

    A bucket of s blocks is dealt to s (s + 1) / 2 block pairs; which block a row is in comes from its hash.
    """
    sizes = rows.groupBy("dim", "t", "code").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("s", F.ceil(F.col("size") / block).cast("int"))
    dealt = rows.join(sizes, ["dim", "t", "code"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("s")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("dim", "t", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "signature")
    apart = 1 - agreement(cosine)
    most = math.ceil(bits * apart + SLACK * math.sqrt(bits * apart * (1 - apart)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("node", "ascending")])
        dim, t, code, i, j = (group[c][0].as_py() for c in ("dim", "t", "code", "i", "j"))
        own = group["own"].to_numpy()
        raw = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint8).reshape(len(own), -1)
        wide, code_of, seen = raw.view(np.uint64), codes(raw, tables, signs), np.zeros(len(own), bool)
        for x, y in block_pairs(own, i, j):
            gap = np.zeros((len(x), len(y)), np.int32)
            for w in range(wide.shape[1]):
                gap += np.bitwise_count(wide[x, w][:, None] ^ wide[y, w][None, :])
            p, q = np.nonzero(gap <= most)
            p, q = x[p], y[q]
            ahead = (p != q) if i != j else (p < q)
            p, q = p[ahead], q[ahead]
            new = ~earlier(code_of, p, q, t)
            seen[p[new]] = seen[q[new]] = True
        on, n = np.flatnonzero(seen), int(seen.sum())
        return pa.table({"dim": np.full(n, dim, np.int32), "t": np.full(n, t, np.int32), "code": np.full(n, code, np.int32), "i": np.full(n, i, np.int32), "j": np.full(n, j, np.int32), "own": own[on].astype(np.int32), "node": group["node"].to_numpy()[on], "signature": pa.array([raw[k].tobytes() for k in on], pa.binary())})

    return dealt.groupBy("dim", "t", "code", "i", "j").applyInArrow(run, "dim int, t int, code int, i int, j int, own int, node bigint, signature binary")


def joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The roots (least places) of all nodes after the pairs p, q are joined too; `root` has those before."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return root
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def links(wanted: DataFrame, vectors: DataFrame, cosine: float, tables: int, signs: int) -> DataFrame:
    """(node, other, n): per block a node's number of links found there, weighted by copies, and the least node that the block's links join it to.

    The rows (node, other) of a block are stars, one for each group of nodes that its links join, so
    components lose no link though every node has one row a block.
    """
    wide = wanted.join(vectors.select("node", "weight", "v"), "node")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("node", "ascending")]).combine_chunks()
        dim, t, i, j = (group[c][0].as_py() for c in ("dim", "t", "i", "j"))
        node, weight, own = (group[c].to_numpy() for c in ("node", "weight", "own"))
        unit = unit_rows(group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        # the signatures come along, as signs computed again could fall otherwise in the last bit
        code = codes(np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint8).reshape(len(node), -1), tables, signs)
        count, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for x, y in block_pairs(own, i, j):
            p, q = np.nonzero(unit[x] @ unit[y].T >= cosine)
            p, q = x[p], y[q]
            ahead = (p != q) if i != j else (p < q)
            p, q = p[ahead], q[ahead]
            new = ~earlier(code, p, q, t)
            p, q = p[new], q[new]
            np.add.at(count, p, weight[q])
            np.add.at(count, q, weight[p])
            root = joined(root, p, q)
        on = count > 0
        return pa.table({"node": node[on], "other": node[root[on]], "n": count[on]})

    return wide.groupBy("dim", "t", "code", "i", "j").applyInArrow(run, "node bigint, other bigint, n bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, signs: int | None = None, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null vec_id,
    link with nothing. Exactly equal vectors are compared once and counted with their weight. Rows
    that repeat a vec_id are one vector with several values; their links add up. Vectors of
    different dimensions never link. Other columns are not carried. An empty table gives no rows.
    Tables and signs follow from the number of distinct vectors unless given.
    """
    prepare(vectors.sparkSession)
    # a vector goes by 128 bits of hash, so its copies meet without moving it
    rows = usable(vectors).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(SEED), "v")})
    fine = rows.where("fine and vec_id is not null")
    # exact copies first: the least id stands for them
    copies = settle(fine.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")))
    chosen = layout(copies.count(), cosine)
    tables, signs = tables or chosen[0], signs or chosen[1]
    bits = -(-max(SIGNATURE_BITS, tables * signs) // 64) * 64
    wanted = settle(promising(bucketed(copies, tables, signs, bits, seed), cosine, tables, signs, bits))
    found = settle(links(wanted, copies, cosine, tables, signs))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    reached = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    answer = copies.select("h1", "h2", "node", "weight").join(counts, "node", "left").join(reached, "node", "left")
    answer = answer.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = fine.select("vec_id", "h1", "h2").join(answer, ["h1", "h2"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(out, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all `embeddings`; odd vectors, repeats and empty tables as in `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
