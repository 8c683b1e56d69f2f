"""Repeated long substrings by sampled suffixes, sorted by comparing hashes.

Every string of ``LENGTH`` bytes has an anchor, the least hashed ``GRAM``-byte
piece inside it, so equal strings have equal anchors at equal offsets.  The
strings with one anchor start at neighbouring places; with the bytes that they
cover they are the anchor's context.

1. Anchors are counted over the corpus by their pieces (combined before the
   shuffle).  An anchor whose piece is nowhere else has no repeated string.
   Pieces that have one context throughout repeat it as a whole.  Contexts are
   told apart by a 128-bit cryptographic digest of their bytes: no polynomial
   hash decides that two contexts of different documents are equal.
2. Pieces with several contexts are where copies begin, end or differ.  One
   sample of each context is fetched, and the suffixes at the anchors are
   sorted: a mergesort whose comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes, log(length) steps
   for a comparison.  Neighbours are then compared byte by byte; a collision
   sorts anew with another base.  The longest extension shared with a neighbour
   bounds the strings that can repeat; those are grouped by hash and every
   group is compared byte by byte, a collision grouping anew with another base.
3. The contexts of a piece with more than ``HOT`` are dealt to tasks by ranges,
   first of the bytes before the anchor, read backwards, then of their suffixes,
   and sorted there in parts of ``SORT_BYTES``.  Both orders bound the strings
   that can repeat.  A part knows the repeats among its own strings; one digest
   for each different string says which others repeat in another part.

The text of a document travels twice, once for samples and once for the result.

Defined results: null text is empty; ids may be null or repeat, and rows that
repeat id and text are separate texts that repeat each other; texts shorter
than LENGTH bytes lose nothing; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import pieces, staged, text_bytes
from korvid.llm.hashing import base, byte_values, mix, powers

LENGTH, GRAM = 400, 32
#: Starts that are looked at together; a longer text is read in overlapping slices.
SLICE = 1 << 20
#: Contexts of one piece that are gathered in a task, and bytes of contexts sorted at a time.
HOT, SORT_BYTES = 512, 1 << 20
_U = np.uint64
_POS = _U((1 << 23) - 1)


class Hashed:
    """Prefix polynomial hashes of bytes; ``seed`` picks the base and the byte values."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        up, self.down = powers(1 << max(20, len(data).bit_length()), base(seed))
        values = byte_values() if not seed else mix(byte_values() + _U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        self.h = np.empty(len(data) + 1, _U)
        self.h[0] = 0
        np.cumsum(values[data] * up[: len(data)], out=self.h[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.h[end] - self.h[start]) * self.down[start])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values: prefix and suffix minima of blocks of w."""
    n = len(a)
    rows = -(-n // w)
    b = np.full(rows * w, np.iinfo(a.dtype).max, a.dtype)
    b[:n] = a
    b = b.reshape(rows, w)
    before = np.minimum.accumulate(b, axis=1).reshape(-1)
    after = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def digests(raw: memoryview, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digest of each raw[first:end], as two 64-bit numbers."""
    flat = b"".join(hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(first.tolist(), end.tolist()))
    return np.frombuffer(flat, np.int64).reshape(-1, 2)


def anchors(data: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray] | None:
    """Anchors of texts laid end to end; text i is data[begin[i]:begin[i + 1]].

    doc, a (place), lo and hi (first and last start), fp (the piece's hash),
    t1 and t2 (digest of the context's bytes, which also fix where its anchor is).
    """
    n = len(data)
    if n < LENGTH:
        return None
    one = Hashed(data)
    at = np.arange(n - GRAM + 1)
    gram = one.of(at, at + GRAM)
    least = sliding_min((gram & ~_POS) | at.astype(_U), LENGTH - GRAM + 1)
    size = np.diff(begin)
    ok = np.zeros(n - LENGTH + 1, bool)
    edge = np.zeros(n + 1, np.int64)
    has = size >= LENGTH
    np.add.at(edge, begin[:-1][has], 1)
    np.add.at(edge, begin[1:][has] - LENGTH + 1, -1)
    ok = np.cumsum(edge)[: len(ok)] > 0
    s = np.flatnonzero(ok)
    if not len(s):
        return None
    a = (least[s] & _POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1))))
    lo, hi, a = s[new], s[np.append(new[1:], len(s)) - 1], a[new]
    own = digests(memoryview(data), lo, hi + LENGTH)
    return {
        "doc": np.searchsorted(begin, lo, "right") - 1, "a": a, "lo": lo, "hi": hi, "fp": gram[a].view(np.int64),
        "t1": own[:, 0], "t2": own[:, 1],
    }


def scan(raws: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, dict[str, np.ndarray]]]:
    """(first text, shift, data, anchors) for texts together, or for the slices of one long text."""
    if len(raws) == 1 and len(raws[0]) > SLICE:
        whole = np.frombuffer(raws[0], np.uint8)
        for x in range(0, len(whole) - LENGTH + 1, SLICE):
            part = whole[x : x + SLICE + LENGTH - 1]
            if (got := anchors(part, np.array([0, len(part)]))) is not None:
                yield 0, x, part, got
        return
    data = np.frombuffer(b"".join(raws), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
    if (got := anchors(data, begin)) is not None:
        yield 0, 0, data, got


def common(h: Hashed, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of the suffixes at p and q, at most ``most``: binary search by hash."""
    low, high = np.zeros(len(p), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) // 2, low)
        same = h.of(p, p + mid) == h.of(q, q + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_sort(data: np.ndarray, group: np.ndarray, place: np.ndarray, end: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[place:end] by (group, bytes), and each one's common length with the next.

    A bottom-up mergesort: in each pass every element finds its rank in the
    neighbouring run by binary search, all elements at once.
    """
    n, h = len(place), Hashed(data, seed)
    order, width = np.argsort(group, kind="stable"), 1

    def before(i: np.ndarray, j: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j; equal ones as ``tie`` says."""
        most = np.where(group[i] == group[j], np.minimum(end[i] - place[i], end[j] - place[j]), 0)
        c = common(h, place[i], place[j], most)
        x, y = place[i] + c, place[j] + c
        stop_i, stop_j = x >= end[i], y >= end[j]
        byte = data[np.minimum(x, len(data) - 1)].astype(int) - data[np.minimum(y, len(data) - 1)]
        inside = np.where(stop_i & stop_j, np.where(tie, -1, 1), np.where(stop_i, -1, np.where(stop_j, 1, byte))) < 0
        return np.where(group[i] == group[j], inside, group[i] < group[j])

    slot = np.arange(n)
    while width < n:
        run = slot // width
        left = run % 2 == 0
        first = np.minimum((run ^ 1) * width, n)
        low, high = first.copy(), np.minimum(first + width, n)
        base = first.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, np.minimum(low, n - 1))
            at = np.flatnonzero(open_)
            # An element of the left run stands before equal ones of the right run.
            less = before(order[mid[at]], order[at], ~left[at])
            low[at] = np.where(less, mid[at] + 1, low[at])
            high[at] = np.where(less, high[at], mid[at])
        target = (run // 2 * 2) * width + slot % width + (low - base)
        merged = np.empty_like(order)
        merged[target] = order
        order, width = merged, width * 2
    i, j = order[:-1], order[1:]
    lcp = common(h, place[i], place[j], np.where(group[i] == group[j], np.minimum(end[i] - place[i], end[j] - place[j]), 0))
    # Verification: the bytes of neighbours must be equal as far as the hashes say.
    flat = np.arange(lcp.sum()) - np.repeat(np.cumsum(lcp) - lcp, lcp)
    if not np.array_equal(data[np.repeat(place[i], lcp) + flat], data[np.repeat(place[j], lcp) + flat]):
        return suffix_sort(data, group, place, end, seed + 2)
    return order, np.append(lcp, 0)


def longest_shared(rows: list[tuple], partial: bool, back: bool = False) -> np.ndarray:
    """For contexts (fp, off, width, n, bytes): how far the suffix at the anchor, or the bytes before it
    read backwards, agree with any other of the piece.

    ``partial``: the first and the last in order may have neighbours elsewhere, so theirs is LENGTH.
    """
    raw = b"".join(r[4][: r[1]][::-1] if back else r[4][r[1] : r[1] + LENGTH] for r in rows)
    size = np.array([r[1] if back else min(len(r[4]) - r[1], LENGTH) for r in rows], np.int64)
    end = np.cumsum(size)
    order, lcp = suffix_sort(np.frombuffer(raw, np.uint8), np.array([r[0] for r in rows], np.int64), end - size, end)
    reach = np.empty(len(rows), np.int64)
    reach[order] = np.maximum(lcp, np.concatenate(([0], lcp[:-1])))
    if partial:
        reach[order[[0, -1]]] = LENGTH
    return reach


class Strings:
    """The strings of some contexts (fp, off, width, n, bytes) that others can have too, in groups of equal ones.

    owner and start of each, its group, and for each group how often its string
    stands in the corpus as far as these contexts tell.
    """

    def __init__(self, rows: list[tuple], right: np.ndarray, left: np.ndarray | None = None):
        self.raw = b"".join(r[4] for r in rows)
        data = np.frombuffer(self.raw, np.uint8)
        off, width, n = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        size = np.array([len(r[4]) for r in rows], np.int64)
        begin = np.cumsum(size) - size
        # A string that starts at s has off - s bytes before the anchor and needs the rest after it.
        low = np.clip(off - left, 0, width) if left is not None else np.zeros(len(rows), np.int64)
        limit = np.maximum(np.clip(off - (LENGTH - right) + 1, 0, width) - low, 0)
        self.owner = np.repeat(np.arange(len(rows)), limit)
        self.start = low[self.owner] + np.arange(limit.sum()) - np.repeat(np.cumsum(limit) - limit, limit)
        self.place = begin[self.owner] + self.start
        seed = 0
        while True:
            key = Hashed(data, seed).of(self.place, self.place + LENGTH)
            _, first, self.group = np.unique(key, return_index=True, return_inverse=True)
            self.first = self.place[first]
            if self._verified():
                break
            seed += 2
        self.times = np.bincount(self.group, weights=n[self.owner], minlength=len(self.first))

    def _verified(self) -> bool:
        """Whether each string has the bytes of its group's first one; neighbouring strings are compared together."""
        p, q = self.place, self.first[self.group]
        at = np.flatnonzero(p != q)
        if not len(at):
            return True
        p, q = p[at], q[at]
        new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1))))
        more = np.diff(np.append(new, len(p))) + LENGTH - 1
        view = memoryview(self.raw)
        return all(view[x : x + m] == view[y : y + m] for x, y, m in zip(p[new].tolist(), q[new].tolist(), more.tolist()))


def intervals(rows: list[tuple], owner: np.ndarray, start: np.ndarray) -> list[list[int]]:
    """For each context the intervals of its starts, flat: first, last, first, last ...; one that is there n times repeats whole."""
    out: list[list[int]] = [[0, r[2] - 1] if r[3] > 1 else [] for r in rows]
    if len(owner):
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
        for k, x, y in zip(owner[new].tolist(), start[new].tolist(), start[np.append(new[1:], len(start)) - 1].tolist()):
            if rows[k][3] == 1:
                out[k] += [x, y]
    return out


def repeated_starts(rows: list[tuple]) -> list[list[int]]:
    """For contexts (fp, off, width, n, bytes) of whole pieces, the intervals of starts whose string repeats."""
    found = Strings(rows, longest_shared(rows, partial=False))
    hit = found.times[found.group] > 1
    return intervals(rows, found.owner[hit], found.start[hit])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, fp, t1, t2, n, width: the distinct contexts of each text and how often it has them."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            ids, keys = batch.column("doc_id"), batch.column("key")
            for _, _, _, g in scan(text_bytes(batch.column("text"))):
                order = np.lexsort((g["t2"], g["t1"], g["doc"]))
                d, t1, t2 = g["doc"][order], g["t1"][order], g["t2"][order]
                new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]))))
                rows = order[new]
                who = pa.array(g["doc"][rows])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(who), keys.take(who), pa.array(g["fp"][rows]), pa.array(t1[new]), pa.array(t2[new]), pa.array(np.diff(np.append(new, len(order)))), pa.array((g["hi"] - g["lo"])[rows] + 1)],
                    ["doc_id", "key", "fp", "t1", "t2", "n", "width"],
                )


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that ``need`` lists, with their bytes."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            raws, need = text_bytes(batch.column("text")), batch.column("need").to_pylist()
            want = [{(x["t1"], x["t2"]): x["n"] for x in w} for w in need]
            rows = []
            for _, _, data, g in scan(raws):
                for d, a, lo, hi, fp, t1, t2 in zip(*(g[k].tolist() for k in ("doc", "a", "lo", "hi", "fp", "t1", "t2"))):
                    if (n := want[d].pop((t1, t2), None)) is not None:
                        rows.append((fp, t1, t2, a - lo, hi - lo + 1, n, data[lo : hi + LENGTH].tobytes()))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["fp", "t1", "t2", "off", "width", "n", "ctx"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t1, t2 and iv of contexts that come sorted by fp, t1, t2; whole pieces at a time."""

    def flush(rows):
        iv = repeated_starts([(r[0], *r[3:]) for r in rows])
        keep = [(r[1], r[2], v) for r, v in zip(rows, iv) if v]
        t1, t2, v = list(zip(*keep)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(v, pa.list_(pa.int32()))], ["t1", "t2", "iv"])

    rows, held, last = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("fp", "t1", "t2", "off", "width", "n", "ctx"))):
            if row[:3] == last:
                continue  # the same sample from a row that repeats
            if rows and row[0] != rows[-1][0] and held > SORT_BYTES:
                yield flush(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[6])
            last = row[:3]
    if rows:
        yield flush(rows)


CONTEXT = ("fp", "t1", "t2", "off", "width", "n", "ctx")


def _parts(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows without neighbours of the same context, in parts of SORT_BYTES."""
    rows, held, last = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[:3] == last:
                continue
            rows.append(row)
            held += len(row[6])
            last = row[:3]
            if held > SORT_BYTES:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts with the bytes before their anchors, read backwards."""
    for batch in batches:
        turned = [c[:o][::-1] for c, o in zip(batch.column("ctx").to_pylist(), batch.column("off").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CONTEXT), pa.array(turned, pa.binary())], [*CONTEXT, "before"])


def _left_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts that come sorted by fp and the bytes before, with how far these agree with others'."""
    for rows in _parts(batches, CONTEXT):
        reach = longest_shared([(r[0], *r[3:]) for r in rows], partial=True, back=True)
        kinds = [pa.int64()] * 6 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), pa.array(reach)], [*CONTEXT, "reach"])


def _sorted_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of contexts that come sorted by fp and suffix, a part at a time.

    t1, t2, iv without h1, h2: starts that repeat within their part.  With both:
    a string that its part has once.  h1, h2, n without t1: one that it has often.
    """
    for own in _parts(batches, (*CONTEXT, "reach")):
        rows = [(r[0], *r[3:7]) for r in own]
        part = Strings(rows, longest_shared(rows, partial=True), np.array([r[7] for r in own], np.int64))
        often = part.times > 1
        known = often[part.group]
        single = np.flatnonzero(~known)
        first = np.concatenate((part.place[single], part.first[often]))
        h = digests(memoryview(part.raw), first, first + LENGTH)
        whole = [(r[1], r[2], iv) for r, iv in zip(own, intervals(rows, part.owner[known], part.start[known])) if iv]
        told = [(own[o][1], own[o][2], [x, x]) for o, x in zip(part.owner[single].tolist(), part.start[single].tolist())]
        t1, t2, iv = zip(*whole, *told, *[(None, None, None)] * int(often.sum())) if whole or told or often.any() else ((), (), ())
        cols = [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(iv, pa.list_(pa.int32()))]
        cols += [pa.concat_arrays([pa.nulls(len(whole), pa.int64()), pa.array(h[:, c])]) for c in (0, 1)]
        n = np.concatenate((np.zeros(len(whole), np.int64), np.ones(len(told), np.int64), np.full(int(often.sum()), 2, np.int64)))
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n)], ["t1", "t2", "iv", "h1", "h2", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result rows, from text and the repeated contexts of each text."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            raws, found = text_bytes(batch.column("text")), batch.column("dup").to_pylist()
            dup = [{(x["t1"], x["t2"]): x["iv"] for x in (f or ())} for f in found]
            edge: list[list[tuple[int, int]]] = [[] for _ in raws]
            begin = np.cumsum([0, *map(len, raws)]).tolist()
            if any(dup):
                for _, shift, _, g in scan(raws):
                    for d, lo, hi, t1, t2 in zip(*(g[k].tolist() for k in ("doc", "lo", "hi", "t1", "t2"))):
                        if dup[d] and (t1, t2) in dup[d]:
                            iv = dup[d][t1, t2]
                            first = lo - begin[d] + shift
                            edge[d] += [(first + x, first + y + LENGTH) for x, y in zip(iv[::2], iv[1::2])] if iv else [(first, first + hi - lo + LENGTH)]
            out = []
            for raw, spans in zip(raws, edge):
                merged: list[list[int]] = []
                for x, y in sorted(spans):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(y, merged[-1][1])
                    else:
                        merged.append([x, y])
                left, at = [], 0
                for x, y in merged:
                    left.append(raw[at:x])
                    at = y
                rest = b"".join([*left, raw[at:]]) if merged else raw
                out.append((len(raw), sum(y - x for x, y in merged), len(merged), hashlib.sha256(rest).hexdigest(), [z for m in merged for z in m], rest.decode("utf-8", "replace")))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (flat byte offsets) and text (what is left) of each row.

    A cut inside a character leaves bytes that are no UTF-8: U+FFFD in ``text``; the digest is of the bytes.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    long_enough = texts.filter(F.octet_length("text") >= LENGTH)
    rows = staged(long_enough.mapInArrow(_anchor_rows, "doc_id long, key long, fp long, t1 long, t2 long, n long, width long"), "suffix-anchors")

    lows = [F.min("t1").alias("a"), F.max("t1").alias("b"), F.min("t2").alias("c"), F.max("t2").alias("d")]
    again = rows.groupBy("fp").agg(F.sum("n").alias("total"), *lows).filter("total > 1").select("fp", ((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).alias("several"))
    active = staged(rows.join(again, "fp").select("doc_id", "key", "fp", "t1", "t2", "n", "several"), "suffix-active")

    who = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    kinds = active.filter("several").groupBy("fp", "t1", "t2").agg(F.sum("n").alias("n"), F.min(who).alias("who"))
    need = kinds.select(F.col("who.doc_id").alias("i"), F.col("who.key").alias("k"), F.struct("t1", "t2", "n").alias("x")).groupBy("i", "k").agg(F.collect_list("x").alias("need"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))
    samples = long_enough.join(need.hint("shuffle_hash"), same).select("text", "need").mapInArrow(_samples, "fp long, t1 long, t2 long, off long, width long, n long, ctx binary")
    samples = staged(samples, "suffix-samples")

    many = staged(samples.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT).select("fp"), "suffix-hot")
    few = samples.join(many, "fp", "left_anti").repartition("fp").sortWithinPartitions("fp", "t1", "t2")
    found = few.mapInArrow(_sorted_groups, "t1 long, t2 long, iv array<int>")
    if not many.isEmpty():
        kind = "fp long, t1 long, t2 long, off long, width long, n long, ctx binary"
        hot = samples.join(many, "fp", "left_semi").select(*CONTEXT).mapInArrow(_before, f"{kind}, before binary")
        back = hot.repartitionByRange("fp", "before", "t1", "t2").sortWithinPartitions("fp", "before", "t1", "t2").select(*CONTEXT)
        bounded = staged(back.mapInArrow(_left_bounds, f"{kind}, reach long"), "suffix-bounds").withColumn("suffix", F.expr(f"substring(ctx, CAST(off AS INT) + 1, {LENGTH})"))
        hot = bounded.repartitionByRange("fp", "suffix", "t1", "t2").sortWithinPartitions("fp", "suffix", "t1", "t2").drop("suffix")
        parts = staged(hot.mapInArrow(_sorted_parts, "t1 long, t2 long, iv array<int>, h1 long, h2 long, n long"), "suffix-parts")
        twice = parts.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.sum("n").alias("c")).filter("c > 1").select("h1", "h2")
        elsewhere = parts.filter("h1 IS NOT NULL AND t1 IS NOT NULL").join(twice, ["h1", "h2"], "left_semi")
        starts = parts.filter("h1 IS NULL").select("t1", "t2", "iv").unionByName(elsewhere.select("t1", "t2", "iv"))
        found = found.unionByName(starts.groupBy("t1", "t2").agg(F.flatten(F.collect_list("iv")).alias("iv")))
    found = staged(found, "suffix-found")

    # An empty interval list stands for all of the context.
    whole = active.filter("NOT several").select("doc_id", "key", "t1", "t2", F.array().cast("array<int>").alias("iv"))
    part = active.filter("several").join(found, ["t1", "t2"]).select("doc_id", "key", "t1", "t2", "iv")
    per_doc = whole.unionByName(part).groupBy("doc_id", "key").agg(F.collect_set(F.struct("t1", "t2", "iv")).alias("dup")).withColumnsRenamed({"doc_id": "i", "key": "k"})
    joined = texts.join(per_doc.hint("shuffle_hash"), same, "left").select("doc_id", "text", "dup")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, text string")
