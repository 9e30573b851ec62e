"""Spelling variants: words one inserted, deleted or replaced code point apart, found on dense tiles of words.

A pair of which the longer word has L code points differs by one edit exactly if its common prefix and its
common suffix together reach L - 1. The first difference lies in one of the segments into which L positions
are cut, so both words agree before and behind that segment: words are dealt by (L, segment, what lies
before it, what lies behind it) and compared only within such a group. Segments have two code points, and
words are written in 90 letters, so a group has at most 90 ** 2 + 90 words, whatever the corpus. Within
a group, padded code-point matrices of two blocks are compared at once, from the left and from the right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.cluster import settle, stored
from codexlake.llm.common import as_batch, only, prepare, table

#: A run of letters; all of them are single bytes of Latin-1.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point.
DROPPED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Code points of a segment, and the most segments; words of more than SEGMENT * MOST_SEGMENTS code points have longer ones.
SEGMENT, MOST_SEGMENTS = 2, 24
#: Words of a group of such long words that meet in one task; larger groups are cut into blocks, and each two blocks meet in a task of their own.
LONG_BLOCK = 2048
#: Words on a side of a tile, code points compared at a time, and words and bytes gathered before they are compared.
TILE, CELLS = 64, 8 << 20
CHUNK_ROWS, CHUNK_BYTES = 100_000, 16 << 20

_PAIRS = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])


def vocabulary(docs: DataFrame, dropped: int = DROPPED, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the distinct words of all texts and how often they occur.

    Runs of letters with A-Z lower-cased; a run whose crc32 with its document's id is divisible by `dropped` loses one
    code point. Rows with a null id keep their runs as they are, null and empty texts have none, rows that repeat count
    again. Counts are summed in each task before they are shuffled, so a frequent word is as cheap as any.
    """
    runs = only(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    # a run loses one code point at most
    runs = runs.where(F.char_length("run") >= least_length)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % dropped == 0, shorter).otherwise(F.col("run"))
    counted = runs.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def dealt(words: DataFrame) -> DataFrame:
    """(g, longer, lo, hi, word, n, block, i, j): every word with each group (g) that it may have a partner in.

    `longer` is the length of the longer word of a pair and lo to hi the segment of its first difference. A group has
    one tile (0, 0), but for words of over SEGMENT * MOST_SEGMENTS code points, whose groups have no fixed bound:
    they are counted, and a large one is cut into blocks.
    """
    longer = words.withColumn("longer", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)))
    parts = F.least(F.ceil(F.col("longer") / SEGMENT), F.lit(MOST_SEGMENTS)).cast("int")
    cut = longer.withColumn("parts", parts).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.withColumns({"lo": F.floor(F.col("segment") * F.col("longer") / F.col("parts")).cast("int"), "hi": F.floor((F.col("segment") + 1) * F.col("longer") / F.col("parts")).cast("int")})
    head, tail = F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.char_length("word") - F.col("longer") + F.col("hi") + 1, F.col("longer") - F.col("hi"))
    rows = cut.select(F.xxhash64("longer", "segment", head, tail).alias("g"), "longer", "lo", "hi", "word", "n")
    bounded = F.col("longer") <= SEGMENT * MOST_SEGMENTS
    long = rows.where(~bounded)
    large = long.groupBy("g").count().where(F.col("count") > LONG_BLOCK).select("g", F.ceil(F.col("count") / LONG_BLOCK).cast("int").alias("blocks"))
    long = long.join(large, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    long = long.withColumn("other", other).select(*rows.columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return rows.where(bounded).select("*", *(F.lit(0).alias(c) for c in ("block", "i", "j"))).union(long)


def matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words from the left and from the right, padded with zeros, and their lengths. The last row is an empty word."""
    left = np.array([*words, b""], dtype=bytes)
    left = left.view(np.uint8).reshape(len(left), -1)
    lengths = np.array([len(w) for w in words] + [0])
    place = np.arange(left.shape[1]) - (left.shape[1] - lengths)[:, None]
    return left, np.where(place >= 0, np.take_along_axis(left, np.maximum(place, 0), 1), 0), lengths


def tiles(starts: np.ndarray, ends: np.ndarray, empty: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stacks of tiles (rows of side a, rows of side b), both of shape (tiles, words), for the groups from starts to ends.

    Small groups are filled up to a power of two with the row `empty` and stacked; a larger one is cut into blocks of
    TILE words, of which each two make a tile.
    """
    sizes = ends - starts
    wide = 2
    while wide <= TILE:
        of = np.flatnonzero((sizes > wide // 2) & (sizes <= wide))
        if len(of):
            rows = starts[of][:, None] + np.arange(wide)
            rows = np.where(rows < ends[of][:, None], rows, empty)
            yield rows, rows
        wide *= 2
    for k in np.flatnonzero(sizes > TILE):
        rows = np.arange(starts[k], starts[k] + -(-sizes[k] // TILE) * TILE).reshape(-1, TILE)
        rows = np.where(rows < ends[k], rows, empty)
        for x in range(len(rows)):
            yield np.broadcast_to(rows[x], rows[x:].shape), rows[x:]


def single_edits(left, right, lengths, a: np.ndarray, b: np.ndarray, longer, lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of all pairs across a stack of tiles that are one edit apart, with the first difference in their group's segment."""
    firsts, seconds = [], []
    step = max(1, CELLS // max(1, a.shape[1] * b.shape[1] * left.shape[1]))
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        prefix = (left[x][:, :, None, :] != left[y][:, None, :, :]).argmax(-1)
        suffix = (right[x][:, :, None, :] != right[y][:, None, :, :])[..., ::-1].argmax(-1)
        p, q = np.broadcast_to(x[:, :, None], prefix.shape), np.broadcast_to(y[:, None, :], prefix.shape)
        long, short = np.maximum(lengths[p], lengths[q]), np.minimum(lengths[p], lengths[q])
        near = (p < q) & (short > 0) & (long - short <= 1) & (prefix + suffix >= long - 1)
        # the group that a pair belongs to; it may meet in others, and hashes of groups may be equal
        near &= (longer[p] == long) & (longer[q] == long) & (prefix >= lo[p]) & (prefix < hi[p]) & (lo[p] == lo[q])
        firsts.append(p[near])
        seconds.append(q[near])
    return np.concatenate(firsts), np.concatenate(seconds)


def _compare(rows: pa.Table) -> pa.RecordBatch | None:
    """Pairs of the whole groups in these rows, which are sorted by group and tile."""
    g, i, j, block, longer, lo, hi = (rows.column(c).to_numpy() for c in ("g", "i", "j", "block", "longer", "lo", "hi"))
    fresh = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    ends = np.concatenate([fresh[1:], [len(g)]])
    of = ends - fresh > 1
    if not of.any():
        return None
    words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    left, right, lengths = matrices(words)
    tags = [np.append(t, -1) for t in (longer, lo, hi)]
    found = [single_edits(left, right, lengths, a, b, *tags) for a, b in tiles(fresh[of], ends[of], len(words))]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    # two words of one block meet in the block's own tile only
    once = (i[a] == j[a]) | (block[a] != block[b])
    a, b = pa.array(a[once]), pa.array(b[once])
    word, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
    return as_batch(_PAIRS, word.take(a).cast(pa.string()), n.take(a), word.take(b).cast(pa.string()), n.take(b))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by group are gathered to chunks that end with a group, and compared."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(len(x) for x in kept) < CHUNK_ROWS and sum(x.nbytes for x in kept) < CHUNK_BYTES:
            continue
        rows = pa.Table.from_batches(kept)
        g = rows.column("g").to_numpy()
        # the last group may go on in the next batch
        end = int(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))[-1])
        if end and (out := _compare(rows.slice(0, end))):
            yield out
        kept = rows.slice(end).combine_chunks().to_batches()
    if kept and sum(len(x) for x in kept) and (out := _compare(pa.Table.from_batches(kept))):
        yield out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two of the distinct words that are one edit apart, once. Words have letters of RUN only."""
    prepare(words.sparkSession)
    rows = dealt(words).repartition("g", "i", "j").sortWithinPartitions("longer", "g", "i", "j")
    return rows.mapInArrow(_pairs, "a string, n_a bigint, b string, n_b bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (columns word, form): where following the forms ends.

    Each round doubles the way that a row has gone. A form has at least twice its word's count, so no way is longer
    than the logarithm of the largest count, and the rounds are the logarithm of that.
    """
    at = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settle(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least five code points and three occurrences.

    A word's form is the most frequent word one edit away (ties: the smallest in code-point order) if it is at least
    twice as frequent, else null; its root is where following the forms ends, itself without a form. Texts, repeats
    and null ids as in `vocabulary`. Columns but doc_id and text are not looked at. No words give no rows.
    """
    words = stored(vocabulary(docs), "words")
    found = near_pairs(words)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    # strings are compared by their UTF-8 bytes, which is the order of code points
    best = found.select(sides.alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("below"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.below")).alias("form_n"))
    every = words.join(best, "word", "left")
    has = F.col("form_n") >= 2 * F.col("n")
    every = settle(every.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    out = every.join(roots(every.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all `documents` with their forms and roots. See `spelling_variants`."""
    return spelling_variants(table(spark, sf_dir, "documents"))
