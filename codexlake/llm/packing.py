"""Vector best-fit packing of tokenised documents into sequences.

A sequence is a bin with three capacities: tokens, documents and attention cost (the sum of squared
piece lengths). Pieces go in by decreasing length; among the open bins that have room under every
constraint, the weighted residual norm after placing, or the weighted dot product, picks one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.cluster import settle
from codexlake.llm.common import mix, only, prepare, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Pieces packed by one task; each such group wastes a few bins at most.
GROUP_PIECES = 8192


@dataclass(frozen=True)
class Capacity:
    """A bin's capacities, and the weights of the residuals in the choice of a bin."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    rule: str = "norm"


_ENCODERS: dict[str, object] = {}


def encoder(name: str):
    """ids(text) of a tokenizer file, kept by the worker process.

    The ids are those of the `tokenizers` file. Where a byte-rank file of the same vocabulary lies
    beside it, that faster encoder is used, except for texts that hold an added token's string.
    """
    if name in _ENCODERS:
        return _ENCODERS[name]
    import base64
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    file = name if os.path.sep in name else public_tokenizers.path(name)
    slow = Tokenizer.from_file(file)
    added = [t.content for t in slow.get_added_tokens_decoder().values()]

    def exact(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")

    ranks_file = file.removesuffix(".json") + ".tiktoken"
    ids = exact
    if os.path.exists(ranks_file):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def ids(text: str) -> np.ndarray:
            if any(a in text for a in added):
                return exact(text)
            return np.array(fast.encode_ordinary(text), "<u4")

    _ENCODERS[name] = ids
    return ids


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `most` tokens but the first, which may be shorter."""
    first = length % most or min(length, most)
    out, at = [(0, first)], first
    while at < length:
        out.append((at, most))
        at += most
    return out


def token_pieces(docs: DataFrame, most: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of every document's ids and the end id; null texts are empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, base = encoder(tokenizer), 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(ids_of(t.as_py() or ""), np.array([END_ID], "<u4")).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), most)):
                    rows.append((d.as_py(), k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            salt = mix(np.arange(seen, seen + len(rows), dtype=np.uint64) + np.uint64(base)) >> np.uint64(1)
            seen += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] + [pa.array(salt.astype(np.int64))] if rows else [pa.array([], t) for t in [*_TYPES, pa.int64()]], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint")


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. A piece that breaks a capacity by itself stands alone in a bin."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.zeros(n, np.int64)
    full = lengths >= cap.tokens
    bins[full] = np.arange(int(full.sum()))
    made = int(full.sum())
    order = np.flatnonzero(~full)
    order = order[np.argsort(-lengths[order], kind="stable")]
    if not len(order):
        return bins, offsets
    wt, wd, wc = cap.weights[0] / cap.tokens**2, cap.weights[1] / cap.documents**2, cap.weights[2] / cap.attention**2
    room = np.zeros((3, len(order)))
    name = np.zeros(len(order), np.int64)
    n_open, smallest = 0, int(lengths[order[-1]])
    for step, i in enumerate(order):
        t = float(lengths[i])
        c = t * t
        left = room[:, :n_open] - np.array([[t], [1.0], [c]])
        fits = (left >= 0).all(axis=0)
        if cap.rule == "dot":
            rank = -(wt * t * room[0, :n_open] + wd * room[1, :n_open] + wc * c * room[2, :n_open])
        else:
            rank = wt * left[0] ** 2 + wd * left[1] ** 2 + wc * left[2] ** 2
        rank = np.where(fits, rank, np.inf)
        best = int(rank.argmin()) if n_open else -1
        if best < 0 or rank[best] == np.inf:
            best, n_open = n_open, n_open + 1
            room[:, best] = cap.tokens - t, cap.documents - 1, cap.attention - c
            name[best], offsets[i] = made, 0
            made += 1
        else:
            offsets[i] = cap.tokens - room[0, best]
            room[:, best] = left[:, best]
        bins[i] = name[best]
        if step % 256 == 255:
            alive = np.flatnonzero((room[0, :n_open] >= smallest) & (room[1, :n_open] >= 1) & (room[2, :n_open] >= smallest**2))
            room[:, : len(alive)], name[: len(alive)] = room[:, alive], name[alive]
            n_open = len(alive)
    return bins, offsets


def pack(docs: DataFrame, cap: Capacity = Capacity(), tokenizer: str = TOKENIZER, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than a bin are cut into full pieces, the first of which may be shorter. Null and
    empty texts are their end id alone; repeated rows are packed each; an empty table gives no rows.
    Pieces are dealt at random into groups of about `group_pieces`, whatever the input's size, so no
    task sees more than that, and a source or id with many rows is dealt like any other.
    """
    pieces = settle(token_pieces(docs, cap.tokens, tokenizer))
    groups = max(1, round(pieces.count() / group_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("salt", "ascending")])
        bins, offsets = best_fit(group["length"].to_numpy(), cap)
        g = group["g"][0].as_py()
        out = group.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array((g << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("g", F.col("salt") % groups)
    return dealt.groupBy("g").applyInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all `documents`. Ids must be whole numbers; null, empty and very long texts, repeats and an empty table as in `pack`."""
    return pack(table(spark, sf_dir, "documents"))
