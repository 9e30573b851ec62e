"""Exact set-similarity join of documents by the Jaccard similarity of their word shingles.

An inverted index over set prefixes lists, for each shingle, the sets that have it early in a global
order (rare shingles first). Lists are cut into blocks by set size and position; block pairs whose
best case stays below the threshold are skipped. What a set's pairs answer is then derived from the
answers of its near neighbours, in three rounds. The first tries a forest of nearest pairs in each
list; the second, where the first left groups apart, a forest of nearest pairs of these groups; the
third tries every pair that is then still apart. A link found joins all sets of its two groups.

Sets are arrays of 64-bit shingle hashes. Equal sets are one node, named by a 64-bit hash of the set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.cluster import settle, stored
from codexlake.llm.common import bounds, distinct_by_row, mix, only, prepare, shingles, table, utf8, words
from codexlake.llm.components import components

#: Frequent shingles whose rank is broadcast (16 bytes each); they come last in the global order. The order is all they decide.
FREQUENT = 1 << 16
#: Lists up to this length have all their pairs tried at once; longer ones are joined in two rounds.
SHORT = 16
#: Longer lists are dealt in blocks of about so many sets.
BLOCK = 2048
#: List entries that are compared in one group, about.
BUNDLE = 2000
#: Names of sets that a task remembers (8 bytes each) so that copies enter the index once; older ones are forgotten, and deduplicated later.
REMEMBERED = 1 << 20
#: Up to so many nodes are picked by a broadcast, of their names (8 bytes each) or of a bitmap of MARKS bits; more are joined.
MOST_BROADCAST, MARKS = 1 << 22, 1 << 26


def sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, cuts, names) of each text's distinct shingles, ascending; a name is a hash of the whole set."""
    h, rows = distinct_by_row(*shingles(*words(raw, offsets), n))
    cuts = bounds(rows, len(offsets) - 1)
    size = np.diff(cuts)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(0x51ED270B)), dtype=np.uint64)])
        names = mix(total[cuts[1:]] - total[cuts[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, cuts, names.view(np.int64)


def fresh_rows(cuts: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The first row of each distinct set that is not empty."""
    _, first = np.unique(names, return_index=True)
    first = np.sort(first)
    return first[np.diff(cuts)[first] > 0]


def distinct_sets(n: int):
    """A function of a column of texts that gives (hashes, cuts, names, rows): a batch's sets, and the rows that bring a set to the task first."""
    known = [np.zeros(0, np.int64)]

    def read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h, cuts, names = sets(*utf8(column), n)
        rows = fresh_rows(cuts, names)
        rows = rows[~np.isin(names[rows], known[0])]
        known[0] = np.concatenate([known[0], names[rows]])[-REMEMBERED:]
        return h, cuts, names, rows

    return read


def _take(h: np.ndarray, cuts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of some rows, and the size of each of these."""
    size = np.diff(cuts)[rows]
    begin = np.repeat(cuts[:-1][rows] - (np.cumsum(size) - size), size)
    return h[np.arange(int(size.sum())) + begin], size


def marked(wanted: DataFrame):
    """A broadcast bitmap of the wanted nodes' hashes, which tells most others apart; None beyond MOST_BROADCAST nodes."""
    if wanted.count() > MOST_BROADCAST:
        return None
    slots = wanted.select(F.col("node").bitwiseAND(F.lit(MARKS - 1)).cast("int").alias("s")).distinct().toArrow()["s"].to_numpy()
    bits = np.zeros(MARKS // 8, np.uint8)
    np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return wanted.sparkSession.sparkContext.broadcast(bits)


def _among(marks, names: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if marks is None:
        return rows
    at = names[rows] & (MARKS - 1)
    return rows[(marks.value[at >> 3] >> (at & 7) & 1) == 1]


def document_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, body) of every row; body is the set's bitmap, with the first row that brings a wanted node's set to a task. Some other nodes have one too."""
    marks = marked(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = distinct_sets(n)
        for b in batches:
            h, cuts, names, rows = read(b.column(1))
            rows, size, body = _among(marks, names, rows), np.diff(cuts), np.full(len(names), None, object)
            taken, own = _take(h, cuts, rows)
            body[rows] = bitmaps(taken, np.repeat(np.arange(len(own)), own), own)
            for lo in range(0, len(names), 500):
                part = slice(lo, lo + 500)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(size[part]), pa.array(names[part]), pa.array(body[part], pa.binary())], names=["doc_id", "n_shingles", "node", "body"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, node bigint, body binary")


def frequent_shingles(docs: DataFrame, n: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and their ranks from rarer to more frequent.

    Every text is counted; a batch sends on the shingles that it has in two sets or more, so what is
    shuffled stays small. A shingle missed this way stays among the rare ones, which costs time only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = distinct_sets(n)
        for b in batches:
            h, cuts, _, rows = read(b.column(0))
            u, c = np.unique(_take(h, cuts, rows)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u[c > 1].view(np.int64)), pa.array(c[c > 1])], names=["token", "c"])

    counted = docs.select("text").mapInArrow(run, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c"))
    top = counted.where("c >= 8").orderBy(F.desc("c"), "token").limit(most).toArrow()
    token, count = top["token"].to_numpy().view(np.uint64), top["c"].to_numpy()
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, count))] = np.arange(1, len(token) + 1)
    order = np.argsort(token)
    return token[order], rank[order]


def widths(size: np.ndarray) -> np.ndarray:
    """Bits of a set's parity bitmap: a power of two of at least twice the set's size."""
    return (1 << np.maximum(8, np.ceil(np.log2(np.maximum(size, 1) * 2)).astype(np.int64))).astype(np.int64)


def bitmaps(h: np.ndarray, own: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each set, the parity of how many of its hashes fall on each bit. Two bitmaps differ in no more bits than their sets do in shingles."""
    w = widths(size)
    base = np.concatenate([[0], np.cumsum(w)])
    spot = (h & (w[own].astype(np.uint64) - np.uint64(1))).astype(np.int64) + base[own]
    bits = (np.bincount(spot, minlength=int(base[-1])) & 1).astype(np.uint8)
    packed = np.packbits(bits, bitorder="little")
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)]


def index_entries(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(token, node, size, pos): each distinct set under the shingles of its prefix."""
    token, rank = frequent_shingles(docs, n)
    shared = docs.sparkSession.sparkContext.broadcast((token, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, rank = shared.value
        read = distinct_sets(n)
        for b in batches:
            h, cuts, names, rows = read(b.column(0))
            names = names[rows]
            h, size = _take(h, cuts, rows)
            own = np.repeat(np.arange(len(size)), size)
            order = np.zeros(len(h), np.int64)
            if len(token):
                at = np.minimum(np.searchsorted(token, h), len(token) - 1)
                order = np.where(token[at] == h, rank[at], 0)
            # hashes ascend within a set, so a stable sort leaves those of one rank ascending
            by = np.argsort(own * (len(token) + 1) + order, kind="stable")
            h = h[by]
            begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
            pos = np.arange(len(h)) - begin[own]
            prefix = size - (num * size + den - 1) // den + 1
            on = pos < prefix[own]
            own, pos = own[on], pos[on]
            yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), pa.array(names[own]), pa.array(size[own].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "node", "size", "pos"])

    # dealt by token alone, so that the lists need no second shuffle; a task has sent each of its sets once already
    return docs.select("text").mapInArrow(run, "token bigint, node bigint, size int, pos int").repartition("token").dropDuplicates(["token", "node"])


def node_bodies(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(node, body) of the wanted distinct sets: all their hashes, ascending."""
    marks = marked(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = distinct_sets(n)
        for b in batches:
            h, cuts, names, rows = read(b.column(0))
            rows = _among(marks, names, rows)
            for lo in range(0, len(rows), 500):
                some = rows[lo : lo + 500]
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array([h[cuts[r] : cuts[r + 1]].tobytes() for r in some.tolist()], pa.binary())], names=["node", "body"])

    found = docs.select("text").mapInArrow(run, "node bigint, body binary").join(wanted, "node", "left_semi")
    return found.groupBy("node").agg(F.first("body").alias("body"))


def _fold(words64: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to a smaller width; parity stays what it is."""
    while words64.shape[1] * 64 > width:
        half = words64.shape[1] // 2
        words64 = words64[:, :half] ^ words64[:, half:]
    return words64


class Lists:
    """A bundle of index lists, compared with numpy."""

    def __init__(self, group: pa.Table, num: int, den: int):
        self.num, self.den = num, den
        self.token, self.node, self.size, self.pos, self.home, self.label, self.own, self.i, self.j = (group[c].to_numpy() for c in ("token", "node", "size", "pos", "home", "label", "own", "i", "j"))
        self.size, self.pos = self.size.astype(np.int64), self.pos.astype(np.int64)
        self.body = group["body"].combine_chunks()
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: rows of one label are one unit; pairs tried join units to teams
        _, self.unit = np.unique(self.label, return_inverse=True)
        self.team = np.arange(int(self.unit.max(initial=-1)) + 1)

    def words(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of rows at a width that none of theirs is below."""
        if width not in self.kept:
            self.kept[width] = (np.zeros((len(self.node), width // 64), np.uint64), np.zeros(len(self.node), bool))
        held, done = self.kept[width]
        for r in rows[~done[rows]]:
            held[r] = _fold(np.frombuffer(self.body[int(r)].as_buffer(), np.uint64)[None, :], width)[0]
        done[rows] = True
        return held[rows]

    def possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs that may reach the threshold by size and position, counted in the list of their first common shingle."""
        num, den = self.num, self.den
        sx, sy = self.size[x], self.size[y]
        need = (num * (sx + sy) + num + den - 1) // (num + den)
        best = np.minimum(sx - self.pos[x], sy - self.pos[y])
        elsewhere = (self.home[x] == self.home[y]) & (self.home[x] != self.token[x])
        return (den * np.minimum(sx, sy) >= num * np.maximum(sx, sy)) & (best >= need) & ~elsewhere & (self.label[x] != self.label[y]) & (self.node[x] != self.node[y])

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose bitmaps leave the threshold in reach, as a mask, and in how many bits they differ."""
        most = (self.den - self.num) * (self.size[x] + self.size[y]) // (self.den + self.num)
        width = np.minimum(widths(self.size[x]), widths(self.size[y]))
        apart = np.zeros(len(x), np.int64)
        for w in np.unique(width):
            for at in np.array_split(np.flatnonzero(width == w), max(1, len(x) * int(w) // (1 << 28) + 1)):
                apart[at] = np.bitwise_count(self.words(x[at], int(w)) ^ self.words(y[at], int(w))).sum(axis=1)
        return apart <= most, apart

    def short(self, starts: np.ndarray, lens: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for n in np.unique(lens):
            a, b = np.triu_indices(int(n), 1)
            x = (starts[lens == n][:, None] + a[None, :]).ravel()
            y = (starts[lens == n][:, None] + b[None, :]).ravel()
            on = self.possible(x, y)
            x, y = x[on], y[on]
            on, _ = self.near(x, y)
            out.append((x[on], y[on]))
        return out

    def blocks(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of row blocks, by size and position, whose best case reaches the threshold."""
        code = np.floor(np.log(self.size[rows]) / np.log(max(self.den / self.num, 1.001)) * 2).astype(np.int64) * 64 + np.minimum(63, self.pos[rows] * 64 // self.size[rows])
        kinds, at = np.unique(code, return_inverse=True)
        parts = [rows[at == k] for k in range(len(kinds))]
        lo, hi = np.array([self.size[p].min() for p in parts]), np.array([self.size[p].max() for p in parts])
        best = np.array([(self.size[p] - self.pos[p]).max() for p in parts])
        out = []
        for k in range(len(parts)):
            least = np.maximum(lo[k], lo[k:])
            fits = (self.den * np.minimum(hi[k], hi[k:]) >= self.num * least) & (np.minimum(best[k], best[k:]) * (self.num + self.den) >= self.num * (lo[k] + lo[k:]))
            out += [(parts[k], parts[k + int(m)]) for m in np.flatnonzero(fits)]
        return out

    def forest(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Nearest pairs that join all teams which these pairs can join; each team picks its nearest, until none has another."""
        out, none = [], np.iinfo(np.int64).max
        while True:
            u, v = self.team[self.unit[a]], self.team[self.unit[b]]
            on = u != v
            a, b, apart, u, v = a[on], b[on], apart[on], u[on], v[on]
            if not len(a):
                return out
            order = apart * len(a) + np.arange(len(a))
            best = np.full(len(self.team), none)
            np.minimum.at(best, u, order)
            np.minimum.at(best, v, order)
            pick = np.unique(best[best < none] % len(a))
            out.append((a[pick], b[pick]))
            head = np.arange(len(self.team))
            for x, y in zip(u[pick].tolist(), v[pick].tolist(), strict=True):
                while head[x] != x:
                    x = head[x]
                while head[y] != y:
                    y = head[y]
                head[max(x, y)] = min(x, y)
            while (head[head] != head).any():
                head = head[head]
            self.team = head[self.team]

    def long(self, start: int, end: int, tried: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one long list that are in reach and have different labels.

        tried = "homes": a forest of the sets that have their home here, and the nearest other set of each of these;
        "teams": a forest of all labels; "pairs": every pair.
        """
        rows = np.arange(start, end)
        homes, team = self.home == self.token, self.team[self.unit[start:end]]
        if (tried == "homes" and not homes[rows].any()) or (team == team[0]).all():
            return []
        cross = self.i[start] != self.j[start]
        found = []
        for p, q in self.blocks(rows):
            for lo in range(0, len(p), max(1, 200_000 // max(1, len(q)))):
                x = p[lo : lo + max(1, 200_000 // max(1, len(q)))]
                a, b = np.repeat(x, len(q)), np.tile(q, len(x))
                on = (a < b) if p is q else np.ones(len(a), bool)
                if cross:
                    on &= self.own[a] != self.own[b]
                if tried == "homes":
                    on &= homes[a] | homes[b]
                if tried != "pairs":
                    on &= self.team[self.unit[a]] != self.team[self.unit[b]]
                on[on] = self.possible(a[on], b[on])
                a, b = a[on], b[on]
                on, apart = self.near(a, b)
                found.append((a[on], b[on], apart[on]))
        if not found:
            return []
        a, b, apart = (np.concatenate(c) for c in zip(*found, strict=True))
        if tried == "pairs":
            return [(a, b)]
        if tried == "teams":
            return self.forest(a, b, apart)
        both = homes[a] & homes[b]
        out = self.forest(a[both], b[both], apart[both])
        one, other, apart = np.where(homes[a], a, b)[~both], np.where(homes[a], b, a)[~both], apart[~both]
        order = np.lexsort((other, apart, one))
        first = order[np.concatenate([[True], one[order][1:] != one[order][:-1]])] if len(order) else order
        return [*out, (one[first], other[first])]


def candidate_pairs(entries: DataFrame, num: int, den: int, tried: str) -> DataFrame:
    """Distinct (a, b, la, lb), a > b, of nodes whose list entries leave the threshold in reach, and their labels."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("token", "i", "j", "node")])
        lists = Lists(group, num, den)
        edge = np.flatnonzero(np.concatenate([[True], (lists.token[1:] != lists.token[:-1]) | (lists.i[1:] != lists.i[:-1]) | (lists.j[1:] != lists.j[:-1])]))
        lens = np.diff(np.concatenate([edge, [len(lists.token)]]))
        whole = lists.i[edge] == lists.j[edge]
        short = (lens <= SHORT) & (lens > 1) & whole & (tried != "teams")
        found = lists.short(edge[short], lens[short])
        rest = np.flatnonzero(~short & (lens > 1))
        # the longest first, for what it joins needs no trying in the others
        for k in rest[np.argsort(-lens[rest], kind="stable")]:
            found += lists.long(int(edge[k]), int(edge[k] + lens[k]), tried)
        x, y = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        x, y = np.where(lists.node[x] > lists.node[y], x, y), np.where(lists.node[x] > lists.node[y], y, x)
        _, first = np.unique(np.stack([lists.node[x], lists.node[y]]), axis=1, return_index=True)
        x, y = x[first], y[first]
        return pa.table({"a": lists.node[x], "b": lists.node[y], "la": lists.label[x], "lb": lists.label[y]})

    return entries.groupBy("bundle").applyInArrow(run, "a bigint, b bigint, la bigint, lb bigint").distinct()


def verified(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): the distinct labels la, lb of the pairs whose sets reach the threshold, from the whole sets."""
    nodes = settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    body = settle(node_bodies(docs, n, nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([u, v])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wide = pairs.join(body.toDF("a", "x"), "a").join(body.toDF("b", "y"), "b").select("la", "lb", "x", "y")
    return wide.mapInArrow(run, "a bigint, b bigint").distinct()


def grouped(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, node, component) of every row: the name of its set, and the set that its links lead to.

    Rows whose set is empty have a null component.
    """
    prepare(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    entries = index_entries(docs, n, num, den)
    # one shuffle by token finds the lists of two and more
    by_token = Window.partitionBy("token")
    listed = entries.withColumn("n", F.count(F.lit(1)).over(by_token)).where("n > 1")
    # skipping by position: what an entry's place leaves of its set bounds the size of its partners, so
    # one whose bound stays below the next larger size, and above whose size no smaller one's bound lies, has none
    by_size = by_token.orderBy("size", "node")
    listed = listed.withColumn("most", F.expr(f"(size - pos) * {num + den} div {num} - size"))
    listed = listed.withColumn("below", F.max("most").over(by_size.rowsBetween(Window.unboundedPreceding, -1))).withColumn("above", F.lead("size").over(by_size))
    listed = listed.where("below >= size or above <= most").drop("most", "below", "above")
    listed = listed.withColumn("n", F.count(F.lit(1)).over(by_token)).where("n > 1")
    # lists of the same smallest node hold much the same nodes, so they are compared in one bundle, to which a bitmap
    # comes as repeats that compress; lists too many or too long for one bundle are dealt to several by token
    listed = listed.withColumn("least", F.min(F.struct("node", "size")).over(by_token))
    lists = F.expr(f"least.size - (least.size * {num} + {den - 1}) div {den} + 1")
    listed = listed.withColumn("part", F.xxhash64("least.node", F.pmod(F.xxhash64("token"), F.ceil(lists * F.col("n") / BUNDLE)))).drop("least")
    # one shuffle by node finds its home: the first of its lists
    listed = listed.withColumn("home", F.first("token").over(Window.partitionBy("node").orderBy("pos")))
    # long lists are cut into blocks by size and hash; a set has partners in its own size band and two on either side at most
    listed = listed.withColumn("band", F.when(F.col("n") <= BLOCK, 0).otherwise(F.floor(F.log(F.col("size").cast("double")) * (2 / math.log(max(den / num, 1.001))) + 1e-9)).cast("int"))
    listed = listed.withColumn("s", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("token", "band")) / BLOCK).cast("int"))
    listed = listed.withColumn("own", F.col("band") * (1 << 20) + F.pmod(F.xxhash64("node", F.lit(9)), F.col("s")).cast("int"))
    # as columns on disk: a third of what the rows of a checkpoint take
    listed = stored(listed, "lists")
    rows = listed.count()
    # all rows, and the bitmaps of sets that have a list in common with another
    own = stored(document_sets(docs, n, settle(listed.select("node").distinct())), "sets")
    maps = stored(own.where("body is not null").groupBy("node").agg(F.first("body").alias("body")), "maps")

    def dealt(part: DataFrame) -> DataFrame:
        blocks = part.where(F.col("n") > BLOCK).groupBy("token", "band").agg(F.first("s").alias("s")).groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", "s"))).alias("blocks"))
        out = part.where(F.col("n") <= BLOCK).withColumn("other", F.col("own"))
        near = F.filter(F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda d: F.col("band") + d), lambda b: F.map_contains_key("blocks", b))
        others = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), F.element_at("blocks", b) - 1), lambda k: b * (1 << 20) + k)))
        out = out.unionByName(part.where(F.col("n") > BLOCK).join(blocks, "token").withColumn("other", F.explode(others)).drop("blocks"))
        out = out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        out = out.withColumn("bundle", F.pmod(F.xxhash64("part", "i", "j"), F.lit(max(1, rows // BUNDLE))))
        return out.join(maps, "node").select("bundle", "token", "node", "size", "pos", "home", "label", "own", "i", "j", "body")

    listed = listed.withColumn("label", F.col("node"))
    links = settle(components(verified(docs, settle(candidate_pairs(dealt(listed), num, den, "homes")), n, num, den)))
    long = listed.where(F.col("n") > SHORT)
    for tried in ("teams", "pairs"):
        long = long.drop("label").join(links.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        # lists whose sets are all joined already answer nothing new, in this round and the next
        long = settle(long.withColumn("apart", F.min("label").over(by_token) < F.max("label").over(by_token)).where("apart").drop("apart"))
        pairs = settle(candidate_pairs(dealt(long), num, den, tried))
        if pairs.isEmpty():
            break
        joined = components(verified(docs, pairs, n, num, den)).toDF("component", "wider")
        # a node without a link until now is a group of its own
        links = links.union(pairs.select("a", "la")).union(pairs.select("b", "lb")).distinct()
        links = settle(links.join(joined, "component", "left").select("node", F.coalesce("wider", "component").alias("component")))
    out = own.select("doc_id", "n_shingles", "node").join(links, "node", "left")
    return out.select("doc_id", "n_shingles", "node", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component"))


def similar(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; documents link when den * |A and B| >= num * |A or B|.

    A text's set is its distinct runs of n words; with fewer words, the whole sequence; null texts and
    texts without words have an empty set and link with nothing. component_id is the smallest doc_id
    reached by links. Rows of one text or id repeat in the result as they do in the input; a null
    doc_id is kept and names no component. Other columns are not carried. An empty table gives no rows.
    """
    rows = settle(grouped(docs, n, num, den))
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, with all their columns, but of each group of linked rows only the one of the smallest doc_id.

    Rows, not ids, are decided: of rows that share an id, those of other texts stay unless they are
    linked to a kept row. Of a group's rows of one smallest id, that with the smallest set hash stays,
    then that with the smallest text. Rows with a null id, and those without words, link with nothing
    and stay. Columns may have any names. An empty table gives no rows.
    """
    names = docs.columns
    rows = settle(grouped(docs, n, num, den))
    first = rows.where("component is not null and doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("kept"))
    judged = rows.where("doc_id is not null").join(first, "component", "left").select("doc_id", "node", F.coalesce(F.struct("doc_id", "node") == F.col("kept"), F.lit(True)).alias("stays"), F.col("n_shingles").alias("size"))
    # ids of one row are settled by id alone
    ids = settle(judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("stays").alias("stays")).where("n > 1 or not stays"))
    few = ids.count() <= MOST_BROADCAST // 4
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, body = (plain.columns[next((i for i, c in enumerate(names) if c == x), None) or [c.lower() for c in names].index(x)] for x in ("doc_id", "text"))
    named = ids.select(F.col("doc_id").alias("id_of_row"), "n")
    single = plain.join(F.broadcast(named) if few else named, F.col(at) == F.col("id_of_row"), "left_anti")
    repeated = named.where("n > 1")
    if repeated.isEmpty():
        return single.toDF(*names)
    many = plain.join(F.broadcast(repeated) if few else repeated, F.col(at) == F.col("id_of_row"), "left_semi")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    place = plain.columns.index(body)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sets(*utf8(b.column(place)), n)[2])], names=[*b.schema.names, "set_name"])

    verdict = judged.select(F.col("doc_id").alias("judged_id"), F.col("node").alias("judged_name"), "stays", "size").distinct()
    told = many.mapInArrow(name, f"{kinds}, set_name bigint").join(verdict, (F.col(at) == F.col("judged_id")) & (F.col("set_name") == F.col("judged_name"))).where("stays")
    wordless = told.where("size = 0").select(*plain.columns)
    rest = told.where("size > 0").groupBy("judged_id", "judged_name").agg(F.min_by(F.struct(*plain.columns), F.struct(body, F.to_json(F.struct(*plain.columns)))).alias("row"))
    return single.union(wordless).union(rest.select("row.*")).toDF(*names)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of `documents` alike by 0.9 in words of three; nulls, repeats and empty tables as in `similar`."""
    return similar(table(spark, sf_dir, "documents"), 3, 90, 100)
