"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_spans(text):
    out = []
    for m in PATTERNS["assign"].finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in PATTERNS["access"].finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in PATTERNS["hex"].finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def base_sha(text):
    s = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base_spans(text))
    return hashlib.sha256(s.encode()).hexdigest()


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def near_components(rows):
    """rows: [(doc_id, text)] -> {doc_id: (n_shingles, component)}."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    seen = set()
    for members in by.values():
        m = sorted(members)
        for a in range(len(m)):
            for b in range(a + 1, len(m)):
                if (m[a], m[b]) not in seen:
                    seen.add((m[a], m[b]))
                    x, y = sets[m[a]], sets[m[b]]
                    if 100 * len(x & y) >= 80 * len(x | y):
                        p, q = sorted((find(m[a]), find(m[b])))
                        root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeated_bytes(rows, n=400):
    """rows: [(doc_id, text)] -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = defaultdict(int)
    for _, b in raw:
        for p in range(len(b) - n + 1):
            count[b[p : p + n]] += 1
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def edit_distance_within(pattern, text):
    """Least edit distance of ``pattern`` to any substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def quality_features(text):
    """The features of one text by plain counting, in the order of quality.NAMES."""
    raw = (text or "").encode()
    n = len(raw)
    if not n:
        return [0.0] * 20
    chars = [chr(b) if b < 128 else None for b in raw]
    count = lambda ok: sum(1 for c in chars if c is not None and ok(c))
    letters, high = count(str.isalpha), chars.count(None)
    blank = count(lambda c: c in " \t\r\n\x0b\x0c")
    words, lines = raw.split(), raw.split(b"\n")
    w, full = max(1, len(words)), [x for x in lines if x]
    return [
        math.log1p(n),
        math.log1p(len(words)),
        math.log1p(len(lines) - 1),
        (letters + high) / n,
        count(str.isupper) / max(1.0, letters + high),
        count(str.isdigit) / n,
        count(lambda c: "!" <= c <= "~" and not c.isalnum()) / n,
        chars.count("|") / w,
        chars.count("!") / w,
        high / n,
        blank / n,
        (n - blank) / w,
        len([x for x in words if len(x) > 15]) / w,
        math.log1p(n / len(lines)),
        len(set(words)) / w / (1 + math.log1p(w) / 20),
        len([k for k in range(1, len(words)) if words[k] == words[k - 1]]) / w,
        1 - len(set(full)) / max(1, len(full)),
        max(raw.count(bytes([b])) for b in set(raw)) / n,
        count(lambda c: c in ".?;,") / w,
        count(lambda c: c in "#$%&*@~^") / w,
    ]


def quality_score(model, x, cut):
    """The score of one row of features under a fitted model, feature by feature."""
    z = [(min(max(v, lo), hi) - lo) / max(hi - lo, 1e-9) for v, lo, hi in zip(x, model.low, model.high)]
    terms = z + [max(v - k, 0.0) for v, knots in zip(z, model.knots) for k in knots]
    s = (sum(t * w for t, w in zip(terms, model.weights)) - model.centre) / model.scale
    return 1 / (1 + math.exp(-(min(max(s, -30), 30) + math.log(cut / (1 - cut)))))


def bradley_terry(rows, marks, steps=300, rate=2.0):
    """Weights by plain gradient steps over every pair of a better and a worse row."""
    better, worse = [r for r, m in zip(rows, marks) if m], [r for r, m in zip(rows, marks) if not m]
    w = [0.0] * len(rows[0])
    score = lambda r: sum(a * b for a, b in zip(r, w))
    for _ in range(steps):
        up, down = [score(r) for r in better], [score(r) for r in worse]
        lost = [[1 / (1 + math.exp(min(max(a - b, -30), 30))) for b in down] for a in up]
        of_better, of_worse = [sum(x) for x in lost], [sum(x) for x in zip(*lost)]
        pairs = len(better) * len(worse)
        for k in range(len(w)):
            pull = sum(p * r[k] for p, r in zip(of_better, better)) - sum(p * r[k] for p, r in zip(of_worse, worse))
            w[k] += rate * pull / pairs
    return w
