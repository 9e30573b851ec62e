"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch (blanks and what follows them) are laid end to end and their
suffixes sorted; every piece is found by binary search as a range of the suffix array. The matches
are the edges of a lattice, sorted by where they end, and relaxed in that order: of the edges that
end at a place, the one stays whose piece may follow the piece before it. For a BPE model that is
the case if merging the two pieces' symbols by rank never joins across their boundary, and then
the path left is the model's own encoding. Symbols outside the vocabulary become their bytes.

A long segment is matched in overlapping windows, side by side. Any two chains of pieces whose
neighbours may follow each other make one such chain if the pieces at the seam may too, so windows are
joined where both have a boundary at which this holds, and the result is the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from codexlake.llm.common import only, prepare, table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Characters of distinct segments that are indexed at a time.
INDEX_CHARS = 400_000
#: Characters of a window, and by how many the next one overlaps it; segments of up to both together are matched whole.
WINDOW, OVERLAP = 256, 64
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Pieces:
    """The vocabulary of a model file, and what decides which piece may follow which."""

    def __init__(self, file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = n
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.byte = np.full(256, sp.unk_id(), np.int64)
        self.bytes: list[bytes] = []
        for i, t in enumerate(self.text):
            if sp.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
                self.bytes.append(bytes([int(t[3:5], 16)]))
            else:
                self.bytes.append(b"" if sp.is_control(i) else t.replace(BLANK, " ").encode())
        self.score = {t: sp.get_score(i) for i, t in enumerate(self.text) if not special[i]}
        self.id = {t: i for i, t in enumerate(self.text) if not special[i]}
        by = sorted(self.id, key=lambda t: (-self.score[t], self.id[t]))
        rank = np.full(n + 1, len(by) + 1, np.int64)
        for r, t in enumerate(by):
            rank[self.id[t]] = -1 if len(t) == 1 else r
        self.rank = rank
        # how each piece comes about; pieces that their own text does not lead to are never used
        up_left, up_right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        made = {i: (-1, -1) for t, i in self.id.items() if len(t) == 1}
        self.usable = dict.fromkeys((t for t in self.id if len(t) == 1), True)
        for t in by:
            if len(t) > 1 and t.strip(BLANK):
                left = self.last_merge(t)
                if left is not None:
                    made[self.id[t]] = (self.id[left], self.id[t[len(left) :]])
                    self.usable[t] = True
        self.left, self.right = up_left, up_right
        for i, (a, b) in made.items():
            self.left[i], self.right[i] = a, b
        joins = sorted((self.id[t[:k]] * (n + 1) + self.id[t[k:]], self.id[t]) for t in self.id for k in range(1, len(t)) if t[:k] in self.id and t[k:] in self.id)
        self.join_key, self.join_id = np.array([j[0] for j in joins]), np.array([j[1] for j in joins])
        names = sorted(self.usable)
        self.longest = max(map(len, names))
        self.names = np.array(names, f"U{self.longest}")
        self.upper = np.array([t + "\U0010ffff" if len(t) < self.longest else t for t in names], f"U{self.longest}")
        self.name_id, self.name_len = np.array([self.id[t] for t in names]), np.array([len(t) for t in names])
        self._spines()

    def merge(self, text: str) -> tuple[list[str], str | None]:
        """Merging by score, leftmost first among equals: symbols, and the left part of the last merge. A heap holds the possible merges."""
        symbols, left = list(text), None
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(k: int) -> None:
            if 0 <= k and after[k] < len(symbols) and symbols[k] + symbols[after[k]] in self.score:
                heapq.heappush(heap, (-self.score[symbols[k] + symbols[after[k]]], k, symbols[k], symbols[after[k]]))

        for k in range(len(symbols) - 1):
            offer(k)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            # a merge is still possible if both its symbols are as they were
            if symbols[k] == x and after[k] < len(symbols) and symbols[after[k]] == y:
                left, gone = x, after[k]
                symbols[k], symbols[gone] = x + y, ""
                after[k] = after[gone]
                if after[k] < len(symbols):
                    before[after[k]] = k
                offer(before[k])
                offer(k)
        return [x for x in symbols if x], left

    def last_merge(self, text: str) -> str | None:
        symbols, left = self.merge(text)
        return left if len(symbols) == 1 else None

    def _spines(self) -> None:
        """For each piece, the pieces along its right edge and its left edge, from the single symbol up."""
        n = len(self.left)

        def spine(child: np.ndarray) -> np.ndarray:
            chains = []
            for i in range(n):
                chain = [i]
                while child[chain[-1]] >= 0:
                    chain.append(int(child[chain[-1]]))
                chains.append(chain[::-1])
            out = np.full((n, max(map(len, chains)) + 1), -1, np.int64)
            for i, c in enumerate(chains):
                out[i, : len(c)] = c
            return out

        self.right_spine, self.left_spine = spine(self.right), spine(self.left)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank keeps the boundary between pieces a and b.

        At any time the boundary lies between one piece of a's right edge and one of b's left edge;
        it is crossed if these two join before either becomes part of the next larger piece.
        """
        n1 = len(self.left)
        far = np.int64(1 << 60)
        ok = np.ones(len(a), bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        on = np.arange(len(a))
        while len(on):
            x, y = self.right_spine[a[on], i[on]], self.left_spine[b[on], j[on]]
            px, py = self.right_spine[a[on], i[on] + 1], self.left_spine[b[on], j[on] + 1]
            tx, ty = np.where(px >= 0, self.rank[px], far), np.where(py >= 0, self.rank[py], far)
            key = x * n1 + y
            at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            when = np.where(self.join_key[at] == key, np.maximum(self.rank[self.join_id[at]], np.maximum(self.rank[x], self.rank[y])), far)
            crossed = (when < tx) & (when <= ty) & (when < far)
            ok[on[crossed]] = False
            first = tx <= ty
            i[on[first]] += 1
            j[on[~first]] += 1
            on = on[~crossed & ((tx < far) | (ty < far))]
        return ok

    def match(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends, cuts) of segments: pieces, where in its segment each ends, and where each segment's pieces begin. A symbol that no piece spells has the id `unknown`."""
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        text = np.array(["".join(segments)]).view(np.uint32) if len(segments) else np.zeros(0, np.uint32)
        ends = np.cumsum(lens)
        starts = ends - lens
        segment = np.repeat(np.arange(len(segments)), lens)
        order, keys = suffixes(text, ends[segment], self.longest)
        lo, hi = np.searchsorted(keys, self.names, "left"), np.searchsorted(keys, self.upper, "right")
        hi = np.maximum(hi, lo)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        place = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        begin, piece = order[place], self.name_id[which]
        end = begin + self.name_len[which]
        # symbols that no piece spells stand alone
        alone = np.ones(len(text), bool)
        alone[begin[self.name_len[which] == 1]] = False
        extra = np.flatnonzero(alone)
        begin, end, piece = np.concatenate([begin, extra]), np.concatenate([end, extra + 1]), np.concatenate([piece, np.full(len(extra), self.unknown)])
        at = end - starts[segment[begin]]
        # whole numbers of 16 bits are sorted by radix
        by = np.argsort(at.astype(np.uint16) if not len(lens) or lens.max() < 1 << 16 else at, kind="stable")
        begin, end, piece, at = begin[by], end[by], piece[by], at[by]
        chosen, back = np.full(len(text) + 1, -1, np.int64), np.full(len(text) + 1, -1, np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            b, t, z = begin[s:e], piece[s:e], end[s:e]
            head = b == starts[segment[b]]
            pair, inverse = np.unique(chosen[b[~head] - 1] * (self.unknown + 1) + t[~head], return_inverse=True)
            ok = head.copy()
            ok[~head] = self.may_follow(pair // (self.unknown + 1), pair % (self.unknown + 1))[inverse]
            chosen[z[ok] - 1], back[z[ok] - 1] = t[ok], b[ok]
        # back along the paths of all segments at once
        found_seg, found_at, found_id = [], [], []
        seg, spot = np.flatnonzero(lens > 0), ends[lens > 0] - 1
        while len(seg):
            found_seg.append(seg)
            found_at.append(spot)
            found_id.append(chosen[spot])
            nxt = back[spot] - 1
            more = nxt >= starts[seg]
            seg, spot = seg[more], nxt[more]
        if not found_seg:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(segments) + 1, np.int64)
        spots = np.concatenate(found_at)
        by = np.argsort(spots)
        ids, own, spots = np.concatenate(found_id)[by], np.concatenate(found_seg)[by], spots[by]
        return ids, spots + 1 - starts[own], np.searchsorted(own, np.arange(len(segments) + 1))

    def spelled(self, ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts) of what `match` found in segments, unknown symbols as their bytes."""
        gone = np.flatnonzero(ids == self.unknown)
        if not len(gone):
            return ids, cuts
        own = np.searchsorted(cuts, gone, "right") - 1
        raw = [segments[k][e - 1].encode() for k, e in zip(own.tolist(), ends[gone].tolist(), strict=True)]
        size = np.ones(len(ids), np.int64)
        size[gone] = list(map(len, raw))
        out = np.repeat(ids, size)
        out[out == self.unknown] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.concatenate([[0], np.cumsum(size)])[cuts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; equal segments of a batch are encoded once."""
        segments, flat, runs = segmented(texts)
        room = WINDOW + OVERLAP
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        blank = np.fromiter((s.startswith(BLANK * 2) for s in segments), bool, len(segments))
        # where each segment's ids are in all of them laid end to end
        start, count = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        laid, total = [np.zeros(0, np.int64)], 0

        def lay(k: int, ids: np.ndarray) -> None:
            nonlocal total
            start[k], count[k] = total, len(ids)
            laid.append(ids)
            total += len(ids)

        for k in np.flatnonzero(blank).tolist():
            # runs of blanks have pieces of equal scores, which only merging itself orders
            lay(k, np.array([i for p in self.merge(segments[k])[0] for i in ([self.id[p]] if p in self.id else self.byte[list(p.encode())])], np.int64))
        short = np.flatnonzero(~blank & (size <= room))
        for batch in np.split(short, np.searchsorted(np.cumsum(size[short]), np.arange(INDEX_CHARS, int(size[short].sum()), INDEX_CHARS))):
            some = [segments[k] for k in batch.tolist()]
            ids, cuts = self.spelled(*self.match(some), some)
            start[batch], count[batch] = total + cuts[:-1], np.diff(cuts)
            laid.append(ids)
            total += len(ids)
        for k in np.flatnonzero(~blank & (size > room)).tolist():
            begins, windows = range(0, len(segments[k]) - OVERLAP, WINDOW), []
            for lo in range(0, len(begins), INDEX_CHARS // room):
                some = begins[lo : lo + INDEX_CHARS // room]
                ids, ends, cuts = self.match([segments[k][at : at + room] for at in some])
                windows += [(at, ids[a:b], ends[a:b] + at) for at, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            ids, ends = self.joined(segments[k], windows)
            lay(k, self.spelled(ids, ends, np.array([0, len(ids)]), [segments[k]])[0])
        every, own = np.concatenate(laid), count[flat]
        place = np.arange(int(own.sum())) + np.repeat(start[flat] - (np.cumsum(own) - own), own)
        last = np.concatenate([[0], np.cumsum(own)])[np.cumsum(runs)]
        return np.split(every[place], last[:-1]) if len(runs) else []

    def seams(self, windows: list[tuple[int, np.ndarray, np.ndarray]]) -> dict[int, tuple[int, int]]:
        """For each window, where its chain and the next one's may be joined: the last piece to keep and the first to go on with; windows without such a place are left out."""
        place, left, right, left_at, right_at = ([np.zeros(0, np.int64)] for _ in range(5))
        for w, ((_, a, a_end), (at, b, b_end)) in enumerate(zip(windows, windows[1:], strict=False)):
            _, x, y = np.intersect1d(a_end, np.concatenate([[at], b_end[:-1]]), return_indices=True)
            for kept, new in ((place, np.full(len(x), w)), (left, a[x]), (right, b[y]), (left_at, x), (right_at, y)):
                kept.append(new)
        place, left, right, left_at, right_at = (np.concatenate(c) for c in (place, left, right, left_at, right_at))
        fits = self.may_follow(left, right)
        out: dict[int, tuple[int, int]] = {}
        for w, x, y in zip(place[fits].tolist(), left_at[fits].tolist(), right_at[fits].tolist(), strict=True):
            # a window is left no earlier than it was entered
            if w not in out and x >= out.get(w - 1, (0, 0))[1]:
                out[w] = (x, y)
        return out

    def joined(self, segment: str, windows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """One chain from the chains of overlapping windows.

        Where windows do not fit, those that follow are matched anew from a boundary of the last one that
        does, twice as many in each round, so that texts with a period fall into step; a window that then
        still does not fit is matched as one with the next.
        """
        shifted: set[int] = set()
        reach = 1
        while True:
            fit = self.seams(windows)
            if len(fit) == len(windows) - 1:
                break
            spans, kept, w = [], {}, 0
            while w < len(windows):
                at, _, ends = windows[w]
                x = w
                while x < len(windows) - 1 and x not in fit:
                    x += 1
                x = x if x == w else max(x, min(w + reach, len(windows) - 1))
                if x == w:
                    kept[len(spans)] = windows[w]
                    spans.append((at, int(ends[-1])))
                    w += 1
                    continue
                stop, near = int(windows[x][2][-1]), ends[ends <= windows[w + 1][0] + OVERLAP // 2]
                if at in shifted or not len(near):
                    spans.append((at, int(windows[w + 1][2][-1])))
                    spans += [(n[0], int(n[2][-1])) for n in windows[w + 2 : x + 1]]
                else:
                    shifted.add(at)
                    kept[len(spans)] = windows[w]
                    spans.append((at, int(ends[-1])))
                    spans += [(b, min(stop, b + WINDOW + OVERLAP)) for b in range(int(near[-1]), max(stop - OVERLAP, int(near[-1]) + 1), WINDOW)]
                w = x + 1
            fresh = [k for k in range(len(spans)) if k not in kept]
            ids, ends, cuts = self.match([segment[slice(*spans[k])] for k in fresh])
            for k, a, b in zip(fresh, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                kept[k] = (spans[k][0], ids[a:b], ends[a:b] + spans[k][0])
            windows, reach = [kept[k] for k in range(len(spans))], 2 * reach
        ids, ends, begin = [], [], 0
        for w, (_, a, a_end) in enumerate(windows):
            stop = fit[w][0] + 1 if w in fit else len(a)
            ids.append(a[begin:stop])
            ends.append(a_end[begin:stop])
            begin = fit[w][1] if w in fit else 0
        return np.concatenate(ids), np.concatenate(ends)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; broken bytes are replaced, and the blank put before the text goes."""
        out = b"".join([self.bytes[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out.removeprefix(" ")


def segmented(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct segments of some texts, which of them follow each other in all texts, and how many there are in each text.

    Every segment begins with a blank. Where no further blank follows that one, the segments are what lies between
    blanks, which Arrow cuts and numbers; texts with blanks at the beginning or side by side are cut by the pattern.
    """
    named = pa.array(texts, pa.large_string())
    named = pc.replace_substring(named, BLANK, " ") if pc.any(pc.match_substring(named, BLANK)).as_py() else named
    odd = pc.or_(pc.starts_with(named, " "), pc.match_substring(named, "  ")).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(named), 0).to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(full & ~odd), np.flatnonzero(odd)
    cut = pc.split_pattern(named.take(pa.array(plain)), " ")
    by_pattern = [[s[1:] for s in _SEGMENT.findall(BLANK + named[k].as_py().replace(" ", BLANK))] for k in rest.tolist()]
    runs = np.zeros(len(texts), np.int64)
    runs[plain], runs[rest] = pc.list_value_length(cut).to_numpy(zero_copy_only=False), list(map(len, by_pattern))
    coded = pa.concat_arrays([cut.flatten(), pa.array([s for found in by_pattern for s in found], pa.large_string())]).dictionary_encode()
    flat = coded.indices.to_numpy().astype(np.int64)
    if len(rest):
        flat = flat[np.argsort(np.repeat(np.concatenate([plain, rest]), runs[np.concatenate([plain, rest])]), kind="stable")]
    return [BLANK + s for s in coded.dictionary.to_pylist()], flat, runs


def suffixes(text: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by the first `depth` characters, by doubling, and these characters in its order; suffixes end at their segment's end.

    As long as the ranks of two halves fit into 64 bits side by side they are set so, and only then ranked anew by a sort.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, f"U{depth}")
    seen = np.unique(text)
    rank, width = np.searchsorted(seen, text).astype(np.uint64) + np.uint64(1), len(seen).bit_length()
    step = 1
    while step < depth:
        if 2 * width > 64:
            order = np.argsort(rank)
            new = np.concatenate([[True], rank[order[1:]] != rank[order[:-1]]])
            rank[order] = np.cumsum(new).astype(np.uint64)
            width = int(new.sum()).bit_length()
        second = np.zeros(n, np.uint64)
        second[:-step] = rank[step:]
        second[np.arange(n) + step >= stop] = 0
        rank = rank << np.uint64(width) | second
        width, step = 2 * width, 2 * step
    order = np.argsort(rank)
    chars = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth - 1, np.uint32)]), depth)[order]
    chars[np.arange(depth) >= (stop[order] - order)[:, None]] = 0
    return order, np.ascontiguousarray(chars).view(f"U{depth}").ravel()


_LOADED: dict[str, Pieces] = {}


def pieces_of(name: str) -> Pieces:
    """A model's tables, kept by the process."""
    if name not in _LOADED:
        import public_tokenizers

        _LOADED[name] = Pieces(name if os.path.sep in name else public_tokenizers.path(name))
    return _LOADED[name]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) of every text; null and empty texts have no ids. Repeated rows repeat; an empty table gives no rows."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pieces_of(model).encode([t or "" for t in b.column(1).to_pylist()])
            cuts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(ids).astype(np.int32)))], names=["doc_id", "ids"])

    docs = only(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids decode to an empty text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [pieces_of(model).decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    encoded = only(encoded, "doc_id", "ids")
    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 and round_trip of every text.

    Null and empty texts have no ids, the crc of nothing and an empty decoded text. Texts of any length and
    without any blank are encoded whole. Rows that repeat an id or text repeat; other columns are not
    carried; an empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables, texts = pieces_of(model), [t or "" for t in b.column(1).to_pylist()]
            ids = tables.encode(texts)
            back = [tables.decode(i) for i in ids]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "n_ids": pa.array([len(i) for i in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back], "round_trip": [x == y for x, y in zip(texts, back, strict=True)],
            })

    docs = only(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` encoded and decoded; nulls, repeats and empty tables as in `digests`."""
    return digests(table(spark, sf_dir, "documents"))
