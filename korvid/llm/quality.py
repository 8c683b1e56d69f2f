"""Quality scores by Bradley-Terry pairwise ranking.

Preference pairs (a better, a worse document) are fitted by logistic loss on
their feature differences, so only the order of documents is learned.  The
threshold is a quantile of the scores of the training documents; scores are
mapped to 0..1 so that this quantile falls on ``CUT``.

Features come from the whole text: shares of letters, capitals, digits, symbols
and white space, repeated words and lines, word and line lengths.  Each is
clipped to the range seen in training and expanded at quantile knots, which
lets a linear score bend.  The fit sees at most ``MAX_LABELLED`` different
labels (id and mark), drawn by the hash of the id, each with one document's
features; the bound limits memory at the driver (``MAX_LABELLED`` rows of
``len(NAMES)`` floats), not what is scored.

Defined results: null text is empty text; every row gets a score, repeated rows
the same one; without labels of both kinds every document scores CUT; labels
without a document, null labels and other columns are ignored; a label that is
repeated counts once, an id marked both ways counts as each; of documents that
share a labelled id the least features count; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import CHUNK_BYTES, lean, pieces, staged, text_bytes

#: Score from which a document is accepted.
CUT = 0.7
#: Labelled rows that the fit may use.
MAX_LABELLED = 40_000
PAIRS_PER_ROW, ROUNDS, STEP, RIDGE, KNOTS = 8, 400, 0.5, 1e-4, 6

NAMES = (
    "log_bytes", "log_words", "log_lines", "letters", "capitals", "digits", "ascii_symbols", "pipes", "bangs", "high_bytes",
    "blank", "word_length", "long_words", "line_length", "distinct_words", "repeated_next_word", "repeated_lines", "top_byte",
    "sentence_marks", "hash_dollar_percent",
)

_KIND = np.zeros((256, 11), np.float32)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [
        _c.isascii() and _c.isalpha(), "A" <= _c <= "Z", "0" <= _c <= "9", _c.isascii() and _c.isprintable() and not _c.isalnum() and _c != " ",
        _c == "|", _c == "!", _b >= 128, _c in " \t\r\n\x0b\x0c", _c in ".?;,", _c in "#$%&*@~^", _c == "\n",
    ]


def features(raw: bytes) -> list[float]:
    """The features of one text, ``NAMES`` in order.

    A long text is read in slices of CHUNK_BYTES; words are told apart by hash,
    as only the share of distinct and repeated ones is wanted.
    """
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.zeros(256, np.int64)
    for a in range(0, n, CHUNK_BYTES):
        counts += np.bincount(np.frombuffer(raw, np.uint8, min(CHUNK_BYTES, n - a), a), minlength=256)
    letters, capitals, digits, symbols, pipes, bangs, high, blank, marks, odd, newlines = (counts @ _KIND).tolist()
    words = raw.split()
    w = max(1, len(words))
    lines = raw.split(b"\n")
    full = [x for x in lines if x]
    again = sum(a == b for a, b in zip(words, words[1:]))
    long = sum(len(x) > 15 for x in words)
    body = max(1.0, letters + high)
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(newlines), (letters + high) / n, capitals / body, digits / n, symbols / n,
        pipes / w, bangs / w, high / n, blank / n, (n - blank) / w, long / w, math.log1p(n / len(lines)),
        len(set(words)) / w / (1 + math.log1p(w) / 20), again / w, 1 - len(set(full)) / max(1, len(full)), float(counts.max()) / n, marks / w, odd / w,
    ]


class Ranker:
    """A Bradley-Terry score: linear in features expanded at quantile knots."""

    def __init__(self, low, high, knots, weights, centre=0.0, scale=1.0):
        self.low, self.high, self.knots, self.weights, self.centre, self.scale = low, high, knots, weights, centre, scale

    def expand(self, x: np.ndarray) -> np.ndarray:
        span = np.maximum(self.high - self.low, 1e-9)
        z = (np.clip(x, self.low, self.high) - self.low) / span
        bent = np.maximum(z[:, :, None] - self.knots[None], 0).reshape(len(x), -1)
        return np.hstack([z, bent])

    def raw(self, x: np.ndarray) -> np.ndarray:
        # Row by row: a matrix product may differ in the last bit with the rows around.
        return (self.expand(x) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT exactly at the accepted quantile."""
        z = np.clip((self.raw(x) - self.centre) / self.scale, -30, 30) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ranker | None:
    """Learn from rows ``x`` with labels ``y`` (1 is better); None if one label is missing."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    low, high = np.quantile(x, 0.002, axis=0), np.quantile(x, 0.998, axis=0)
    span = np.maximum(high - low, 1e-9)
    z = (np.clip(x, low, high) - low) / span
    knots = np.quantile(z, np.linspace(0.05, 0.95, KNOTS), axis=0).T
    model = Ranker(low, high, knots, np.zeros(z.shape[1] * (1 + KNOTS)))
    e = model.expand(x)
    rng = np.random.default_rng(seed)
    # Each row takes part in the same number of pairs as others of its label.
    pairs = PAIRS_PER_ROW * max(len(good), len(bad))
    p, q = rng.permutation(np.resize(good, pairs)), rng.permutation(np.resize(bad, pairs))
    gain, square = np.zeros_like(model.weights), np.full_like(model.weights, 1e-8)
    block = 20_000
    for r in range(ROUNDS):
        at = (r * block) % pairs
        i, j = p[at : at + block], q[at : at + block]
        d = e[i] - e[j]
        # Gradient of log(1 + exp(-w.d)), the negative log likelihood that i beats j.
        grad = -(d / (1 + np.exp(np.clip(d @ model.weights, -30, 30)))[:, None]).mean(0) + RIDGE * model.weights
        gain = 0.9 * gain + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        model.weights -= STEP / (1 + r / 50) * gain / (np.sqrt(square) + 1e-8)
    s = model.raw(x)
    model.centre, model.scale = _threshold(s, y)
    return model


def _threshold(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The quantile of the scores that parts the labels best, and the scores' spread.

    Best: the largest sum of both labels' shares on their own side; the cut lies
    midway between the two neighbouring scores.
    """
    order = np.argsort(s, kind="stable")
    bad = np.concatenate(([0], np.cumsum(y[order] == 0))) / max(1, (y == 0).sum())
    good = np.concatenate(([0], np.cumsum(y[order] == 1))) / max(1, (y == 1).sum())
    k = int(np.argmax(bad - good))
    t = s[order]
    centre = (t[k - 1] + t[k]) / 2 if 0 < k < len(t) else float(t[min(k, len(t) - 1)])
    return float(centre), float(max(np.std(s), 1e-6)) / 4


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the features of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                x = [features(r) for r in text_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(lean(run), "doc_id long, x array<float>")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def sample(labels: DataFrame, label_col: str = "quality", held_out: int | None = None, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id and y of at most ``limit`` different labels, those whose ids hash lowest; fold ``held_out`` is left out."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).alias("y")).distinct()
    if held_out is not None:
        rows = rows.filter(fold(F.col("doc_id")) != held_out)
    return staged(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit), "quality-sample")


def train(feats: DataFrame, some: DataFrame) -> Ranker | None:
    """Fit on one row of ``feats`` for each label of ``some``, which :func:`sample` bounds, so it is broadcast."""
    got = feats.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id", "y").select("x", "y").toArrow()
    if not got.num_rows:
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)
    return fit(x, got.column("y").to_numpy())


def _map_scores(docs: DataFrame, model: Ranker | None, source: str) -> DataFrame:
    """``docs`` (whose column ``source`` holds features) with score in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            if model is None:
                s = np.full(len(x), CUT)
            else:
                s = model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col(source).alias("x")).mapInArrow(lean(run), "doc_id long, score double")


def scores(docs: DataFrame, labels: DataFrame, held_out: int | None = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    feats = staged(feature_table(docs), "quality-features")
    out = _map_scores(feats, train(feats, sample(labels, held_out=held_out)), "x")
    inside = F.coalesce(fold(F.col("doc_id")) == (-1 if held_out is None else held_out), F.lit(False))
    return out.select("doc_id", inside.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least CUT, with all their columns.

    The features of labelled rows are read first, for the fit; the model then
    travels to the rows, so no text is shuffled.
    """
    some = sample(labels)
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id", "left_semi")
    model = train(feature_table(known), some)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for whole in batches:
            whole = whole.rename_columns([str(i) for i in range(len(names))])
            for batch in pieces(whole, str(at)):
                if model is not None:
                    x = np.array([features(r) for r in text_bytes(batch.column(at))]).reshape(-1, len(NAMES)).astype(np.float32).astype(np.float64)
                    batch = batch.filter(pa.array(model.score(x) >= CUT))
                yield batch.rename_columns(names)

    return docs.mapInArrow(lean(run), docs.schema)
