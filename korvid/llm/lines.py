"""Line dedup by winnowing over line hashes.  DataFrame functions only.

A run is any sequence of equal lines that has ``WINDOW`` lines, or ``PASSAGE``
words together, split on all white space.  A run that occurs earlier in the
corpus is deleted where it occurs again.  Order is by doc_id (null last), then
the text's hash, then place.  Blank lines belong to no run and stay.  Longer
runs consist of windows of WINDOW lines, so only shorter ones with enough words
are windows of their own.

1. Each window of line hashes selects its least one: that is its fingerprint.
   Equal windows select the same, so no repeated run of WINDOW lines is missed.
2. Selected positions are counted by fingerprint (combined before the shuffle).
   Windows whose fingerprint has one position repeat nothing and go no further.
3. Positions with equal fingerprints are joined through the lines around them:
   each is compared with the first position that has the same window, never with
   all others, so a passage in a third of all documents costs a row for each
   occurrence.  Windows are equal if a 128-bit cryptographic digest of their
   lines' own digests says so; the 64-bit hashes only select.
4. Matches are extended both ways: those of one document that continue each
   other in the same earlier document make up a run, and runs are deleted.

Defined results: null text is empty; rows that repeat id and text are one
document and get the same result; a document whose lines all go is empty; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import discard, staged

WINDOW, PASSAGE = 3, 50
#: A word: characters other than control and Unicode white space.
WORD = r"[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]+"


def _split(text: str | Column) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def _digest(x: Column) -> Column:
    """The first 16 bytes of SHA-256."""
    return F.unhex(F.substring(F.sha2(x, 256), 1, 32))


def windows(docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """doc_id, key and wins: structs of place i among the lines that are not blank, n lines, p and fp
    (selected position and hash) and w (digest of the window)."""
    numbered = F.filter(
        F.transform(_split("text"), lambda x: F.struct(F.xxhash64(x).alias("h"), _digest(x.cast("binary")).alias("d"), F.regexp_count(x, F.lit(WORD)).alias("words"), (F.length(F.trim(x)) == 0).alias("blank"))),
        lambda s: ~s["blank"],
    )
    # A generated column is computed once; a projected one would be computed anew for each line.
    d = docs.select("doc_id", "key", F.explode(F.array(numbered)).alias("ls")).withColumn("m", F.size("ls"))

    def run(i: Column, n: int = window) -> Column:
        part = F.transform(F.slice("ls", i + 1, n), lambda s: s["h"])
        low = F.array_min(part)
        return F.struct(
            i.alias("i"), F.lit(n).alias("n"), (i + F.array_position(part, low).cast("int") - 1).alias("p"), low.alias("fp"),
            _digest(F.concat(*[F.get("ls", i + k)["d"] for k in range(n)])).alias("w"),
        )

    def short(n: int) -> Column:
        total = lambda i: sum((F.get("ls", i + k)["words"] for k in range(1, n)), F.get("ls", i)["words"])
        return F.filter(F.transform(F.sequence(F.lit(0), F.col("m") - n), lambda i: F.when(total(i) >= passage, run(i, n))), lambda x: x.isNotNull())

    none = F.array().cast("array<struct<i:int,n:int,p:int,fp:bigint,w:binary>>")
    runs = F.when(F.col("m") >= window, F.transform(F.sequence(F.lit(0), F.col("m") - window), lambda i: run(i))).otherwise(none)
    return d.select("doc_id", "key", F.concat(runs, *[F.when(F.col("m") >= n, short(n)).otherwise(none) for n in range(1, window)]).alias("wins"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """doc_id, key and runs of the documents that lose any lines: structs of first and last (places among
    the lines that are not blank), from_doc and from_first (where the run stands first)."""
    wins = staged(windows(docs, window, passage).filter(F.size("wins") > 0), "line-windows")
    selected = wins.select("doc_id", "key", F.explode(F.array_distinct(F.transform("wins", lambda x: F.struct(x["p"].alias("p"), x["fp"].alias("fp"))))).alias("s"))
    # What is joined to rows below is written before, so that the join deals both sides anew and the
    # rows of a common fingerprint or window can be split.
    again = staged(selected.groupBy(F.col("s.fp").alias("fp")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("fp"), "line-fingerprints")
    each = wins.select("doc_id", "key", F.explode("wins").alias("x")).select("doc_id", "key", "x.i", "x.n", "x.fp", "x.w")
    near = staged(each.join(again, "fp", "left_semi").drop("fp"), "line-near")
    discard(wins, again)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "i")
    first = staged(near.groupBy("w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("w", "first"), "line-first")
    later = near.join(first, "w").filter(place != F.col("first"))
    # Matches by where they come from, then by place: those that continue each other are neighbours.
    hit = F.struct("first.none", F.col("first.doc_id").alias("from_doc"), F.col("first.key").alias("from_key"), (F.col("i") - F.col("first.i")).alias("shift"), "n", "i")
    hits = later.select("doc_id", "key", hit.alias("hit")).groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    at = lambda k: F.get("hits", k)
    follows = lambda k: reduce(lambda x, c: x & at(k)[c].eqNullSafe(at(k - 1)[c]), ("from_doc", "from_key", "shift", "n"), at(k)["i"] == at(k - 1)["i"] + 1)
    begins = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda k: (k == 0) | ~follows(k))
    parted = hits.select("doc_id", "key", "hits", F.explode(F.array(begins)).alias("begins"))

    def run(k: Column, j: Column) -> Column:
        end = at(F.coalesce(F.get("begins", j + 1), F.size("hits")) - 1)
        return F.struct(at(k)["i"].alias("first"), (end["i"] + end["n"] - 1).alias("last"), at(k)["from_doc"].alias("from_doc"), (at(k)["i"] - at(k)["shift"]).alias("from_first"))

    return parted.select("doc_id", "key", F.transform("begins", run).alias("runs"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left) and runs (see :func:`repeated_runs`) of each row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    gone = staged(repeated_runs(texts, window, passage), "line-runs").select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "runs")
    joined = texts.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    out = joined.select("doc_id", "text", "runs", F.explode(F.array(_split("text"))).alias("lines"))
    # Numbers of the lines that are not blank, then of those in runs.
    full = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.length(F.trim(F.get("lines", i))) > 0)
    out = out.withColumn("full", F.explode(F.array(F.when(F.col("runs").isNotNull(), full))))
    places = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.slice("full", r["first"] + 1, r["last"] - r["first"] + 1))))
    out = out.withColumn("gone", F.explode(F.array(F.when(F.col("runs").isNotNull(), places))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return out.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(left).alias("text"), "runs",
    )
