"""Benchmark decontamination: pigeonhole edit matching over words.

A test item of n words may be altered by at most k = floor(ERROR * n) word
edits.  Cut into k + 1 pieces, an altered copy still holds one piece unaltered
(pigeonhole), so exact hits of pieces, found by an Aho-Corasick automaton over
word numbers, reach every copy.  Around each hit the least edit distance of the
item to a stretch of the document is computed by Myers' bit-parallel algorithm,
a bit for each word of the item.

Words are longest runs of letters, digits and underscores, lower-cased.  The
benchmark is read in blocks of at most BLOCK_BYTES of text (one pass over the
documents for each), so what is shipped to executors has that bound.

Defined results: null or empty texts and items without words match nothing;
items that repeat are all reported; rows of documents may repeat; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import lean, pieces, staged

#: Share of an item's words that may be edited.
ERROR = 0.2
#: Item text that is matched in one pass.
BLOCK_BYTES = 8 << 20
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def myers(peq: dict[int, int], n: int, text: list[int], k: int) -> tuple[int, int]:
    """Least edit distance of a pattern of n symbols to a stretch of ``text``, and where that ends (exclusive).

    ``peq`` has for each symbol the bits of its places in the pattern.  Without
    a stretch within k the distance is k + 1.
    """
    ones = (1 << n) - 1
    top = 1 << (n - 1)
    pv, mv, score = ones, 0, n
    best, at = (score, 0) if score <= k else (k + 1, 0)
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = mh | ~(xv | ph) & ones
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], error: float):
        import ahocorasick

        self.ids: dict[str, int] = {}
        self.items = []
        held: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            w = [self._id(x) for x in words(text)]
            n = len(w)
            if not n:
                continue
            k = min(int(error * n), n - 1)
            peq: dict[int, int] = {}
            for i, c in enumerate(w):
                peq[c] = peq.get(c, 0) | 1 << i
            for p in range(k + 1):
                a, b = p * n // (k + 1), (p + 1) * n // (k + 1)
                held.setdefault("".join(map(self._char, w[a:b])), []).append((len(self.items), b))
            self.items.append((item_id, n, k, peq))
        self.code = {x: self._char(i) for x, i in self.ids.items()}
        self.tree = None
        if held:
            self.tree = ahocorasick.Automaton()
            for piece, where in held.items():
                self.tree.add_word(piece, where)
            self.tree.make_automaton()

    def _id(self, word: str) -> int:
        return self.ids.setdefault(word, len(self.ids) + 1)

    @staticmethod
    def _char(i: int) -> str:
        return chr(i if i < 0xD800 else i + 0x800)  # past the surrogates

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first word, last word) of each item in ``text``, its best stretch, by item."""
        if self.tree is None or not text:
            return []
        get = self.code.get
        line = "".join([get(w, "\0") for w in WORD.findall(text.lower())])
        spans: dict[int, list[list[int]]] = {}
        for end, where in self.tree.iter(line):
            for item, stop in where:
                _, n, k, _ = self.items[item]
                first = end + 1 - stop
                a, b = max(0, first - k), min(len(line), first + n + k)
                s = spans.setdefault(item, [])
                if s and a <= s[-1][1] and s[-1][0] <= b:
                    s[-1] = [min(a, s[-1][0]), max(b, s[-1][1])]
                else:
                    s.append([a, b])
        out = []
        for item, windows in spans.items():
            item_id, n, k, peq = self.items[item]
            best = (k + 1, 0, 0)
            for a, b in windows:
                d, at = myers(peq, n, [self._number(c) for c in line[a:b]], min(k, best[0] - 1))
                if d < best[0]:
                    best = (d, max(a, a + at - n - d), a + at)
            if best[0] <= k:
                out.append((item_id, *best))
        return sorted(out, key=lambda r: (r[0] is None, r))

    @staticmethod
    def _number(c: str) -> int:
        i = ord(c)
        return i if i < 0xD800 else i - 0x800


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, at most about BLOCK_BYTES of text at a time at the driver."""
    items = staged(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL"), "benchmark")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for i in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, distance, first_word, last_word."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, distance long, first_word long, last_word long"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, error)
            for batch in batches:
                rows = [(d, *r) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for r in m.find(t.as_py())]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in schema.split(", ")])

        found = found.unionByName(texts.mapInArrow(lean(run), schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns.  Nothing is shuffled."""
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema
    at = names.index(text_col)
    for block in _blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, error)
            for whole in batches:
                for batch in pieces(whole.rename_columns([str(i) for i in range(len(names))]), str(at)):
                    yield batch.filter(pa.array([not m.find(t.as_py()) for t in batch.column(at)], pa.bool_())).rename_columns(names)

        docs = docs.mapInArrow(lean(run), schema)
    return docs
