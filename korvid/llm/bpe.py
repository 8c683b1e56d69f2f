"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

The pattern (``public_tokenizers.PATTERN``)

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is run without a regex engine.  Each code point has a class (letter, number,
space, other).  Inside one class a piece simply goes on, so pieces start where
the class changes, except for three things that need more than the two
neighbouring classes: a space before a word belongs to the word, the last
character of a longer white-space run is a piece of its own unless it ends the
text, and a contraction is cut only where the matcher stands at an apostrophe.
Whether it stands there depends on whether the previous character was the end
of a piece, which is a chain of states along a run of apostrophe contractions;
the chain is resolved by composing transition functions (two states, so a
function is two bits) with a doubling scan.

Nothing but :func:`encode_table`, which applies this to a table, depends on
Spark.

Defined results: null or empty text has 0 tokens and the digests of nothing;
each row is encoded by itself, so repeated rows and ids have a row each and a
null id stays null; texts of any length are encoded whole; other columns,
whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
import types
import unicodedata
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from korvid.llm.common import lean, pieces, text_bytes
from korvid.llm.hashing import powers

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Pieces that the merge cache holds; it starts anew when full.
CACHE_PIECES = 400_000
#: Longer pieces are merged with a heap and not kept.
LONG_PIECE = 64
#: No pair of tokens has this rank.
NONE = 1 << 60
#: Odd multiplier of the piece hash.
MIX = 0xD6E8FEB86659FD93

# The white-space code points of Unicode (property White_Space), and the
# endings of the pattern's contractions.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, from Unicode's general categories."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[WHITE] = SPACE
    return out


def compose_scan(f0: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of functions on {0, 1}: function i sends 0 to f0[i], 1 to f1[i].

    Composition is associative, so doubling gives all prefixes in log n steps.
    """
    f0, f1, step = f0.copy(), f1.copy(), 1
    while step < len(f0):
        a0, a1 = f0[:-step], f1[:-step]  # earlier
        b0, b1 = f0[step:], f1[step:]  # later
        n0, n1 = np.where(a0, b1, b0), np.where(a1, b1, b0)
        f0[step:], f1[step:] = n0, n1
        step *= 2
    return f0, f1


def starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start in code points ``cp``; ``first`` marks the first of each text (true at 0)."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    end = np.empty(n, bool)  # last of its text
    end[:-1], end[-1] = first[1:], True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[first] = 255
    change = kind != before
    blank = cp == 32
    white = kind == SPACE

    # White space: a run's last character splits off if anything follows it in the text.
    tail = np.zeros(n, bool)
    tail[:-1] = white[:-1] & (kind[1:] != SPACE) & ~end[:-1]
    start = change | tail
    # A single blank that ends a run joins the word, number or other run behind it.
    joined = np.zeros(n, bool)
    joined[1:] = tail[:-1] & blank[:-1]
    start[joined] = False

    quote = np.flatnonzero(cp == 39)
    if len(quote):
        start = _contractions(cp, kind, end, start, quote)
    return np.flatnonzero(start)


def _contractions(cp: np.ndarray, kind: np.ndarray, end: np.ndarray, start: np.ndarray, quote: np.ndarray) -> np.ndarray:
    """Cut contractions at the apostrophes where the matcher stands."""
    n = len(cp)
    size = np.zeros(len(quote), np.int64)  # of the ending that follows, 0: none
    for e in ENDINGS:
        ok, at = size == 0, quote
        for ch in e:
            room = ~end[at] & ok
            at = np.where(room, at + 1, at)
            ok = room & (cp[at] == ord(ch))
        size[ok] = len(e)
    has = size > 0
    if not has.any():
        return start
    quote, size = quote[has], size[has]
    # The matcher stands at an apostrophe if a piece starts there by the class rules, or if
    # the contraction before ends right there.  Everything else in a run is never stood at.
    base = start[quote]
    chained = np.zeros(len(quote), bool)
    chained[1:] = quote[:-1] + 1 + size[:-1] == quote[1:]
    # State before: whether the previous contraction was cut.  After: whether this one is.
    f0 = base.copy()
    f1 = base | chained
    cut, _ = compose_scan(f0, f1)
    quote, size = quote[cut], size[cut]
    out = start.copy()
    out[quote] = True
    after = quote + 1 + size
    # Letters inside a contraction start nothing; what follows it does, in the same text.
    out[quote + 1] = False
    follow = after[(after < n)]
    inside = ~end[follow - 1]
    out[follow[inside]] = True
    # A blank after the contraction keeps its own rules: joined words stay joined.
    return out


class Encoder:
    """Ranks of byte strings, with a cache from piece to its ids (little-endian unsigned 32 bit)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.words[v] = k
        self.cache: dict[str, bytes] = {}
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.words), np.uint8)
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # Every pair of tokens whose bytes together are a token; the token's id is its rank.
        pairs = sorted((ranks[w[:i]] << 20 | ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [NONE], np.int64)

    @classmethod
    def from_text(cls, raw: bytes) -> Encoder:
        """From the lines ``base64 rank`` of a ranks file."""
        return cls({b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length: a heap over linked spans, n log n.

        The lowest-ranked adjacent pair merges first, leftmost among equals.
        """
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, stop = [True] * n, list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, last = heapq.heappop(heap)
            if not alive[i] or stop[i] != mid or not alive[mid] or stop[mid] != last:
                continue
            alive[mid] = False
            stop[i], nxt[i] = last, nxt[mid]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(piece[i : stop[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, last, stop[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:last])) is not None:
                heapq.heappush(heap, (r, p, i, last))
        return [ranks[piece[i : stop[i]]] for i in range(n) if alive[i]]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids (as bytes) of many short pieces at once: each round merges one pair in every piece."""
        sizes = np.array([len(w) for w in words], np.int64)
        tok = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        own = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(tok), NONE, np.int64)
        same = own[:-1] == own[1:]
        rank[:-1][same] = self._pair(tok[:-1][same], tok[1:][same])
        out: list[bytes] = [b""] * len(words)
        while len(tok):
            begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            count = np.diff(np.append(begin, len(tok)))
            low = np.minimum.reduceat(rank, begin)
            if (low == NONE).any():  # these are finished
                done = low == NONE
                rows = np.repeat(done, count)
                raw, width = tok[rows].astype("<u4").tobytes(), count[done] * 4
                ends = np.cumsum(width).tolist()
                for w, a, b in zip(own[begin[done]].tolist(), [0, *ends], ends):
                    out[w] = raw[a:b]
                tok, own, rank = tok[~rows], own[~rows], rank[~rows]
                continue
            hit = np.flatnonzero(rank == np.repeat(low, count))
            hit = hit[np.concatenate(([True], own[hit[1:]] != own[hit[:-1]]))]  # leftmost of each piece
            tok[hit] = rank[hit]
            keep = np.ones(len(tok), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged token is once the others are gone
            tok, own, rank = tok[keep], own[keep], rank[keep]
            rank[at] = NONE
            on = at[(at + 1 < len(tok))]
            on = on[own[on] == own[on + 1]]
            rank[on] = self._pair(tok[on], tok[on + 1])
            back = at[at > 0] - 1
            back = back[own[back] == own[back + 1]]
            rank[back] = self._pair(tok[back], tok[back + 1])
        return out

    def pieces_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct pieces, through the cache."""
        out = [self.cache.get(w) for w in words]
        new = [k for k, x in enumerate(out) if x is None]
        raw = [words[k].encode("utf-8", "surrogatepass") for k in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG_PIECE]
        if len(self.cache) + len(short) > CACHE_PIECES:
            self.cache.clear()
        for i, got in zip(short, self.merge_many([raw[i] for i in short]) if short else []):
            out[new[i]] = got
            self.cache[words[new[i]]] = got
        for i, r in enumerate(raw):
            if len(r) > LONG_PIECE:
                out[new[i]] = np.array(self.merge(r), "<u4").tobytes()
        return out

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids as bytes, and where its pieces start, in code points."""
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        if not len(cp):
            return [(b"", np.zeros(0, np.int64))] * len(texts)
        first = np.zeros(len(cp), bool)
        first[begin[:-1][sizes > 0]] = True
        at = starts(cp, first)
        width = np.diff(np.append(at, len(cp)))
        lead, same = _distinct(cp, at, width)
        words = [joined[a:b] for a, b in zip(at[lead].tolist(), (at[lead] + width[lead]).tolist())]
        ids = self.pieces_ids(words)
        pool = np.frombuffer(b"".join(ids), "<u4")
        n = np.array([len(i) // 4 for i in ids], np.int64)
        per = n[same]
        total = np.concatenate(([0], np.cumsum(per)))
        flat = pool[np.repeat((np.cumsum(n) - n)[same] - total[:-1], per) + np.arange(total[-1])]
        edge = np.searchsorted(at, begin)
        return [(flat[total[a] : total[b]].tobytes(), at[a:b] - x) for a, b, x in zip(edge[:-1], edge[1:], begin[:-1])]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0][0], "<u4").tolist()

    def token_offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of each token in the decoded text, and at the end its length."""
        return np.concatenate(([0], np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian ids: each token's bytes are copied to its offset."""
        tok = np.frombuffer(ids, "<u4")
        at = self.token_offsets(ids)
        return self.pool[np.repeat(self.offsets[tok] - at[:-1], self.sizes[tok]) + np.arange(at[-1])].tobytes()


def _distinct(cp: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of distinct pieces, and for each piece which of them it equals.

    Pieces are told apart by a polynomial hash; every piece is then compared
    with the one that stands for it, and any that differs stands for itself.
    """
    n = len(cp)
    up, down = powers(1 << max(16, n.bit_length()))
    v = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
    v ^= v >> np.uint64(29)
    h = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * up[:n], dtype=np.uint64)))
    key = (h[at + width] - h[at]) * down[at] + width.astype(np.uint64) * np.uint64(MIX)
    _, lead, same = np.unique(key, return_index=True, return_inverse=True)
    stands = lead[same]
    other = width[stands] != width
    flat = np.repeat(at[stands] - at, np.where(other, 0, width)) + np.flatnonzero(np.repeat(~other, width))
    differs = np.zeros(n, bool)
    differs[np.repeat(~other, width)] = cp[flat] != cp[np.repeat(~other, width)]
    other |= np.add.reduceat(differs, at) > 0
    alone = np.flatnonzero(other)
    if len(alone):
        same = same.copy()
        same[alone] = len(lead) + np.arange(len(alone))
        lead = np.concatenate((lead, alone))
    return lead, same


def shared_encoder(raw: bytes) -> Encoder:
    """One encoder a process, kept between tasks of a reused worker."""
    home = sys.modules.setdefault("_korvid_encoders", types.ModuleType("_korvid_encoders"))
    key = hashlib.sha256(raw).hexdigest()
    if key not in home.__dict__:
        home.__dict__.clear()
        home.__dict__[key] = Encoder.from_text(raw)
    return home.__dict__[key]


def encode_table(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with ids and piece offsets if asked.

    The driver reads the ranks file (a vocabulary, about 1 MB whatever the
    corpus) and ships it; executors need no file.  Null text is empty text:
    0 tokens and the digests of nothing.  Rows may repeat; other columns are
    not looked at.  Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    with open(ranks_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, piece_starts array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for whole in batches:
            enc = enc or shared_encoder(shared.value)
            for batch in pieces(whole, "text"):
                raw = text_bytes(batch.column("text"))
                got = enc.encode_texts([r.decode("utf-8", "replace") for r in raw])
                cols = [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(i)).hexdigest() for i, _ in got], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array([i for i, _ in got], pa.binary()), pa.array([s for _, s in got], pa.list_(pa.int64()))]
                    names += ["ids", "piece_starts"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(lean(run), schema)
