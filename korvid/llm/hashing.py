"""Vectorised hashing of words and shingles in many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE, M1, M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(M1)
    h = (h ^ (h >> _U(27))) * _U(M2)
    return h ^ (h >> _U(31))


def base(seed: int) -> int:
    """An odd number for each seed; BASE for 0."""
    return BASE if not seed else int(mix(np.array([seed], _U) * _U(M1))[0]) | 1


#: Powers of a base that are kept at most.
KEPT = 1 << 21
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, of: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """``of`` to the powers below n (or more of them), and their inverses, modulo 2**64.

    The longest table of each base is kept, which serves shorter ones too; one
    beyond ``KEPT``, for a single long text, goes with it.
    """
    if of in _kept and len(_kept[of][0]) >= n:
        return _kept[of]
    up, down = np.full(n, of, _U), np.full(n, pow(of, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    np.cumprod(up, out=up), np.cumprod(down, out=down)
    if n <= KEPT:
        _kept[of] = up, down
    return up, down


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A fixed random 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=_U) * _U(BASE))


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """H and inverse powers: (H[e] - H[s]) * down[s] is the hash of data[s:e], wherever it stands."""
    up, down = powers(1 << max(16, len(data).bit_length()))
    h = np.empty(len(data) + 1, _U)
    h[0] = 0
    np.cumsum(byte_values()[data] * up[: len(data)], out=h[1:])
    return h, down


def words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, A-Z lower-cased, and how many words each text has.

    A word is a longest run of bytes other than space and 0x09 to 0x0D.
    """
    data = np.frombuffer((b"\n".join(raws) + b"\n").lower(), np.uint8)
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    s, e = edge[::2], edge[1::2]
    h, down = prefix_hash(data)
    begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    return mix((h[e] - h[s]) * down[s] + (e - s).astype(_U)), np.diff(np.searchsorted(s, begin))


def shingle_sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    With fewer than k words the whole sequence is one shingle; without words there is none.
    """
    w, count = words(raws)
    n = len(w)
    full = w.copy()
    for i in range(1, min(k, n)):
        full[: n - i] = mix(full[: n - i] * _U(BASE) + w[i:])
    out, at = [], 0
    for c in count.tolist():
        if c >= k:
            out.append(np.unique(full[at : at + c - k + 1]))
        elif c:
            h = w[at : at + 1].copy()
            for i in range(1, c):
                h = mix(h * _U(BASE) + w[at + i])
            out.append(mix(h + _U(c)))
        else:
            out.append(np.zeros(0, _U))
        at += c
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches (Dahlgaard, Knudsen and Thorup, 2017), a row of t numbers each.

    Round r sends every element to one of t bins with the value r + fraction;
    rounds t to 2t-1 send them all to bin r - t, so every coordinate of a
    non-empty set fills.  A set leaves after the round that fills its last bin,
    so the work is near |set| + t log t.  Two sketches agree in a coordinate
    with the sets' similarity as probability, with concentration as of
    independent draws.  The row of an empty set is all ones.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    top = np.iinfo(np.uint64).max
    out = np.full(len(sets) * t, top, _U)
    own = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
    for r in range(2 * t):
        if not len(h):
            break
        g = mix(h ^ mix(np.array([r + 1], _U) * _U(BASE)))
        place = ((g >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if r < t else r - t
        np.minimum.at(out, own * t + place, (g & _U(0xFFFFFFFF)) | _U(r << 32))
        open_ = (out.reshape(-1, t) == top).any(1)
        stay = open_[own]
        h, own = h[stay], own[stay]
    return out.reshape(-1, t)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One hash for every ``rows`` neighbouring coordinates, as signed 64-bit numbers."""
    d, t = sketch.shape
    h = np.broadcast_to(np.arange(1, t // rows + 1, dtype=_U) * _U(M1), (d, t // rows)).copy()
    parts = sketch[:, : t // rows * rows].reshape(d, t // rows, rows)
    for i in range(rows):
        h = mix(h * _U(BASE) + parts[:, :, i])
    return h.view(np.int64)
