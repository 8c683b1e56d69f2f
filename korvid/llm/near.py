"""MinHash near-dedup: fast similarity sketches, banding, exact verification.

Documents with equal shingle sets are one class.  A class has ``BANDS`` band
hashes of ``ROWS`` sketch coordinates each; at similarity 0.8 two classes miss
each other in every band with probability (1 - 0.8**5)**40, about 1e-7.

The rows of all bands are counted by bucket once; the rows of buckets with more
than one class are written, and so are the sets of their classes, once.  In
every such bucket one class, drawn by hash, is the centre, and each other class
is compared with it on full sets, for STARS rounds with other centres.  That
gives components.  A link may still be missing between classes that share a
bucket but not a component; for those buckets, all pairs across components are
compared too, block by block, and only links leave a block.  So nothing is
capped: each link between classes that share a bucket is found or replaced by a
path of found ones.  The blocks of one bucket are compared pair by pair, so that
part grows with the square of the components (not of the documents) in a bucket.

A bucket's rows are dealt by ``SALT``, its centre to each share.  Sets are
compared in groups of one class with at most ``FAN`` others; a class with more
is sent to several groups.

Defined results: null and empty texts and texts of white space have no
shingles, link with nothing and stay; repeated rows are one class; a null id
never names a component unless no other id is in it; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvid.llm import hashing
from korvid.llm.common import discard, fresh, lean, pieces, staged, text_bytes
from korvid.llm.graph import components

BANDS, ROWS = 40, 5
#: Rounds of stars at most.
STARS = 2
#: Classes and shingles of a block at most, one larger class aside.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Rows of a bucket in a share.
SALT = 512
#: Rows (of two numbers) that are broadcast at most; more are joined by shuffles.
BROADCAST_ROWS = 500_000
#: Most classes that one is compared with in a group.
FAN = 64
#: Shingles of a class from which sets are compared.
WORDS, PERCENT = 5, 80


def class_table(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, key (of the text), n_shingles, sid (digest of the set), bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = hashing.shingle_sets(text_bytes(batch.column("text")), words)
                b = hashing.bands(hashing.sketches(sets, BANDS * ROWS), ROWS)
                sid = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                cols = [
                    batch.column("doc_id").cast(pa.int64()), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sid, pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(b.reshape(-1)), BANDS).cast(pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n", "sid", "bands"])

    return docs.mapInArrow(lean(run), "doc_id long, key long, n long, sid binary, bands array<long>")


def _set_table(texts: DataFrame, words: int) -> DataFrame:
    """cid and set (sorted 64-bit hashes, little-endian) from cid and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = hashing.shingle_sets(text_bytes(batch.column("text")), words)
                yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "set"])

    return texts.mapInArrow(lean(run), "cid long, set binary")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y and the sizes of intersection (common) and union (whole) for pairs (x, y) of classes.

    Groups of one x and at most about FAN of its y: x's set comes first in its
    group and the others stream past it.
    """
    wide = staged(pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("long").alias("g")).filter("g > 1"), "near-wide")
    g = F.coalesce("g", F.lit(1).cast("long"))
    many = pairs.join(wide, "x", "left").select("x", F.pmod(F.xxhash64("y"), g).alias("salt"), F.col("y").alias("cid"))
    one = pairs.select("x").distinct().join(wide, "x", "left").select("x", F.explode(F.sequence(F.lit(0).cast("long"), g - 1)).alias("salt"))
    sets = sets.select("cid", "set")
    rows = many.join(sets, "cid").select("x", "salt", F.lit(1).alias("k"), F.col("cid").alias("y"), "set").unionByName(
        one.join(sets, one["x"] == sets["cid"]).select("x", "salt", F.lit(0).alias("k"), F.col("cid").alias("y"), "set")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = None, None
        for batch in batches:
            out = []
            for x, k, y, s in zip(batch.column("x").to_pylist(), batch.column("k").to_pylist(), batch.column("y").to_pylist(), batch.column("set")):
                b = np.frombuffer(s.as_buffer(), np.uint64)
                if not k:
                    own, first = x, b.copy()
                    continue
                assert own == x, "a group without its first set"
                common = int(np.isin(b, first, assume_unique=True).sum()) if len(b) < 8 else len(np.intersect1d(first, b, assume_unique=True))
                out.append((x, y, common, len(first) + len(b) - common))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["x", "y", "common", "whole"])

    return rows.repartition("x", "salt").sortWithinPartitions("x", "salt", "k").select("x", "k", "y", "set").mapInArrow(lean(run), "x long, y long, common long, whole long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and text_key, for each row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    rows = staged(class_table(texts, words), "near-rows")
    grouped = rows.filter("sid IS NOT NULL").groupBy("sid").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("who"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    classes = staged(grouped.select(F.monotonically_increasing_id().alias("cid"), "sid", F.col("who.doc_id").alias("doc_id"), F.col("who.key").alias("key"), "n", "bands"), "near-classes")

    mixed = _mixed(classes)
    sets = _sets_of(mixed, classes, texts, words)

    # Rounds of stars: in every bucket one class, another in each round, is compared with
    # the classes of other components.  A round is linear in the buckets' rows.
    links = tested = roots = None
    for r in range(STARS):
        placed = staged(_placed(mixed, classes, roots), "near-placed")
        centres = _open(placed, F.min_by(F.struct("cid", "n", "comp"), F.xxhash64("cid", "b", F.lit(r))).alias("at"))
        star = _salted(placed, centres).filter(F.col("comp") != F.col("at.comp")).filter(_alike("n", "at.n", percent))
        pairs = star.select(F.least("cid", "at.cid").alias("x"), F.greatest("cid", "at.cid").alias("y")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("x", "y"), ["x", "y"], "left_anti")
        pairs = staged(pairs, "near-star")
        judged = staged(_compare(pairs, sets), "near-judged")
        discard(placed, pairs)
        tested = judged if tested is None else tested.unionByName(judged)
        found = judged.filter(F.col("common") * 100 >= F.col("whole") * percent).select(F.col("x").alias("u"), F.col("y").alias("v"))
        if r and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        roots = staged(components(links), "near-roots")

    # What still shares a bucket across components is compared in blocks; only links come back.
    more = staged(_across(staged(_placed(mixed, classes, roots), "near-placed"), sets, percent), "near-more")
    if not more.isEmpty():
        roots = staged(components(links.unionByName(more)), "near-roots")
    discard(mixed, sets)

    final = classes.join(roots, classes["cid"] == roots["node"], "left").select("sid", F.coalesce("root", "cid").alias("comp"), "doc_id")
    least = final.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = final.join(least, "comp").select("sid", "component_id")
    out = rows.select("doc_id", "n", "sid", "key").join(named, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "key").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document :func:`near_duplicates` keeps, with all their columns."""
    k, i, g = fresh(docs, "key", "gone_id", "gone_key")
    gone = staged(
        near_duplicates(docs, words, percent, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(i), F.col("key").alias(g)).distinct(), "near-dropped"
    )
    same = F.col(id_col).eqNullSafe(F.col(i)) & F.col(k).eqNullSafe(F.col(g))
    return docs.withColumn(k, F.xxhash64(text_col)).join(gone.hint("shuffle_hash"), same, "left_anti").drop(k)


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _small(df: DataFrame) -> DataFrame:
    """``df`` (staged) with a hint to broadcast it where its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _mixed(classes: DataFrame) -> DataFrame:
    """b, cid and c (classes in the bucket) of the buckets with more than one class, staged.

    All bands are shuffled once, as counts by bucket; the least and the largest
    class are all that a bucket of two has.
    """
    each = classes.select("cid", F.explode("bands").alias("b"))
    counted = each.groupBy("b").agg(F.count(F.lit(1)).alias("c"), F.min("cid").alias("lo"), F.max("cid").alias("hi"))
    buckets = staged(counted.filter("lo <> hi"), "near-buckets")
    two = buckets.filter("c = 2").select("b", F.explode(F.array("lo", "hi")).alias("cid"), "c")
    more = each.join(_small(buckets.filter("c > 2").select("b", "c")), "b").select("b", "cid", "c")
    out = staged(two.unionByName(more), "near-mixed")
    discard(buckets)
    return out


def _placed(mixed: DataFrame, classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """b, cid, c and salt of the rows of ``mixed``, with the class's size n and its component so far."""
    own = classes.select("cid", "n", F.col("cid").alias("comp"))
    if roots is not None:
        own = classes.join(roots, classes["cid"] == roots["node"], "left").select("cid", "n", F.coalesce("root", "cid").alias("comp"))
    return mixed.join(own, "cid").select("b", "cid", "c", F.pmod(F.xxhash64("cid"), _shares()).alias("salt"), "n", "comp")


def _shares() -> Column:
    return F.ceil(F.col("c") / SALT).cast("long")


def _open(placed: DataFrame, *more: Column) -> DataFrame:
    """The buckets that hold more than one component: b, c and ``more`` aggregates."""
    return placed.groupBy("b").agg(F.max("c").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *more).filter("lo <> hi").drop("lo", "hi")


def _salted(placed: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows with what ``buckets`` says of their bucket; a large bucket's rows come in shares."""
    to = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), _shares() - 1))).drop("c")
    return placed.join(to, ["b", "salt"])


def _across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between classes of different components that share a bucket.

    A bucket is dealt into blocks of at most BLOCK classes and BLOCK_SHINGLES
    shingles, and each pair of blocks is a group of its own.  A pair of classes
    is compared in the first bucket that the two share.
    """
    dealt = _open(placed, F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("nb"))
    own = _salted(placed, dealt).withColumn("blk", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("nb")))
    spread = own.select("b", "cid", "comp", "blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o"))
    rows = spread.select("b", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "cid", "comp").join(sets, "cid")

    def flush(held: list) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        b, i, j = held[0][:3]
        blk, cid, comp = (np.array([h[k] for h in held], np.int64) for k in (3, 4, 5))
        bands_ = np.array([h[6] for h in held], np.int64)
        size = np.array([len(h[7]) for h in held])
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        band = int(np.flatnonzero(bands_[0] == b)[0])
        tokens = np.concatenate([held[y][7] for y in right])
        owner = np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        out = []
        for x in left.tolist():
            small, large = np.minimum(size[x], size[right]), np.maximum(size[x], size[right])
            ok = (comp[right] != comp[x]) & (small * 100 >= large * percent) & ((cid[right] > cid[x]) | (i != j))
            if ok.any():
                at = np.flatnonzero(ok)
                ok[at] = ~(bands_[right[at], :band] == bands_[x, :band]).any(1)
            if not ok.any():
                continue
            lo, hi = np.searchsorted(tokens, held[x][7], "left"), np.searchsorted(tokens, held[x][7], "right")
            span = hi - lo
            flat = np.repeat(lo - (np.cumsum(span) - span), span) + np.arange(span.sum())
            common = np.bincount(owner[flat], minlength=len(right))
            whole = size[x] + size[right] - common
            out += [(int(cid[x]), int(c)) for c in cid[right[ok & (common * 100 >= whole * percent)]]]
        return out

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("b", "i", "j", "blk", "cid", "comp", "bands")]
            for *row, s in zip(*cols, batch.column("set")):
                if tuple(row[:3]) != key:
                    yield batch_of(flush(held))
                    held, key = [], tuple(row[:3])
                held.append([*row, np.frombuffer(s.as_buffer(), np.uint64).copy()])
        yield batch_of(flush(held))

    ordered = rows.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j").select("b", "i", "j", "blk", "cid", "comp", "bands", "set")
    return ordered.mapInArrow(lean(run), "u long, v long")


def _sets_of(mixed: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """cid, bands and set of the classes in ``mixed``, staged."""
    need = staged(mixed.select("cid").distinct(), "near-need")
    who = classes.join(need, "cid", "left_semi").select("cid", F.col("doc_id").alias("i"), F.col("key").alias("k"))
    who = F.broadcast(who) if need.count() <= BROADCAST_ROWS else who.hint("shuffle_hash")
    found = texts.join(who, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).select("cid", "text")
    sets = _set_table(found, words).dropDuplicates(["cid"])
    out = staged(sets.join(classes.select("cid", "bands"), "cid").select("cid", "bands", "set"), "near-sets")
    discard(need)
    return out
