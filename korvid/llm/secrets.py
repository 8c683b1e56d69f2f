"""Secret scans with corpus-wide ownership: patterns find candidates, owners tell them apart.

DataFrame functions only.  One pass of each pattern sets marks around all
leftmost non-overlapping matches; the text is split at the marks, and the
running sum of the parts' lengths gives every span in code points.

Candidates are hashed where they are found (no value is written or shuffled)
and counted by distinct repository and owner over the whole corpus, combined
before each shuffle.  A value that several owners or many repositories hold is
a copied example; one that a single owner holds in few repositories looks live.
Besides the three base kinds, long mixed tokens are candidates of a fourth
kind, ``opaque``: such a span is reported only if its value looks live.

The corpus names no repositories: each different text is one, so exact copies
count once; ``source`` is the owner.  Other columns may be named.

Defined results: null text is empty and has no spans; a null owner or
repository counts as one of its own; rows may repeat; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import staged

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
#: Shortest value of an assignment.
ASSIGN_CHARS = 6
#: Opaque tokens: a run of 20 or more key characters with lower case, upper case and a digit.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
#: Owners, and repositories, that may hold a value that still looks live.
MAX_OWNERS, MAX_REPOS = 1, 3
#: Marks around a match and before its value; no pattern matches them, so they are OTHER in the text that is searched.
EDGE, INNER, OTHER = "\x01", "\x02", "\x03"
#: Parts whose running sums are made at a time.
STEP = 256


def _marked(text: Column, pattern: str, group: int = 0) -> Column:
    """Parts of the text: between matches, match (with its value after INNER), between, match, ..."""
    value = f"{INNER}${group}" if group else ""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{EDGE}$0{value}{EDGE}")), EDGE, -1)


def _before(sizes: Column) -> Column:
    """For each element the sum of those before it: within steps, then over the steps, so that no long list is copied per element."""
    whole = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STEP).cast("int"))
    none = F.array().cast("array<int>")
    inner = F.transform(
        whole,
        lambda k: F.aggregate(
            F.slice(sizes, k * STEP + 1, STEP), F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        ),
    )
    return F.aggregate(
        inner, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(x["out"], lambda y: y + a["at"]))).alias("out")),
        lambda a: F.flatten(a["out"]),
    )


def _sized(parts: Column) -> Column:
    """Code points of each part, a match's value left out."""
    return F.transform(parts, lambda x: F.length(F.substring_index(x, INNER, 1)))


def _spans(found: Column, kind: int, keep) -> Column:
    """start, end, kind and hash of the value of every match for whose value ``keep`` holds."""
    at = F.filter(F.sequence(F.lit(0), F.size(found["parts"]) - 1), lambda i: i % 2 == 1)

    def one(i: Column) -> Column:
        start = F.get(found["before"], i)
        value = F.substring_index(F.get(found["parts"], i), INNER, -1)
        span = F.struct(start.alias("start"), (start + F.get(found["sizes"], i)).alias("end"), F.lit(kind).alias("kind"), F.sha2(value.cast("binary"), 256).alias("value_hash"))
        return F.when(keep(value), span)

    return F.filter(F.transform(at, one), lambda x: x.isNotNull())


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str | None = "source") -> DataFrame:
    """doc_id, repo, owner and ``found``: the spans of every kind, in order of kind and place."""
    t = F.col("t")
    every = lambda v: F.lit(True)
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    kinds = ((ASSIGN, 2, lambda v: F.length(v) >= ASSIGN_CHARS), (ACCESS, 0, every), (HEX, 0, every), (OPAQUE, 0, mixed))
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.col(repo_col).cast("string") if repo_col else none).alias("repo"),
        (F.col(owner_col).cast("string") if owner_col else none).alias("owner"),
        F.coalesce(F.col(text_col), F.lit("")).alias("raw"),
    ).withColumn("t", F.when(F.contains("raw", F.lit(EDGE)) | F.contains("raw", F.lit(INNER)), F.translate("raw", EDGE + INNER, OTHER * 2)).otherwise(F.col("raw")))
    # A text without a match is left at that; a cheap test keeps most texts away from the pattern of access keys.
    tests = [t.rlike(pattern) for pattern, _, _ in kinds]
    tests[1] = F.contains(t, F.lit("AKIA")) & tests[1]
    parts = [F.when(test, _marked(t, pattern, group)).alias(f"p{k}") for k, (test, (pattern, group, _)) in enumerate(zip(tests, kinds))]
    # Generated columns are computed once for each row; projected ones anew wherever they are named.
    rows = rows.select("doc_id", "repo", "owner", "raw", F.explode(F.array(F.struct(*parts))).alias("m"))
    rows = rows.select("doc_id", "repo", "owner", "raw", "m", F.explode(F.array(F.struct(*[_sized(F.col(f"m.p{k}")).alias(f"z{k}") for k in range(4)]))).alias("z"))
    rows = rows.select("doc_id", "repo", "owner", "raw", "m", "z", F.explode(F.array(F.struct(*[F.when(F.col(f"z.z{k}").isNotNull(), _before(F.col(f"z.z{k}"))).alias(f"b{k}") for k in range(4)]))).alias("b"))
    found = []
    for k, (_, _, keep) in enumerate(kinds):
        one = {"parts": F.col(f"m.p{k}"), "sizes": F.col(f"z.z{k}"), "before": F.col(f"b.b{k}")}
        found.append(F.when(one["parts"].isNotNull(), _spans(one, k, keep)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int,value_hash:string>>")))
    rows = rows.select("doc_id", "repo", "owner", "raw", F.explode(F.array(F.concat(*found))).alias("found"))
    repo = F.col("repo") if repo_col else F.when(F.size("found") > 0, F.sha2(F.col("raw").cast("binary"), 256))
    return rows.select("doc_id", repo.alias("repo"), "owner", "found")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners, n_rows over all candidates: exact distinct counts, combined map-side by value and repository or owner."""
    # In a struct a null counts as one of its own.
    named = found.select(F.explode("found.value_hash").alias("value_hash"), F.struct("repo").alias("repo"), F.struct("owner").alias("owner"))
    return named.groupBy("value_hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.count(F.lit(1)).alias("n_rows"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, **columns: str) -> DataFrame:
    """A row for each document: doc_id and ``spans``, an array of structs
    (start, kind, end, value_hash, n_repos, n_owners, live), by start and kind.

    Base spans always stay; opaque spans stay where they look live.
    """
    rows = staged(candidates(docs, **columns).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    # Written, so that the join deals both sides anew and the rows of a common value can be split.
    owners = staged(ownership(rows), "secret-owners")
    each = rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("s")).select("row", "s.start", "s.end", "s.kind", "s.value_hash")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = each.join(owners, "value_hash").withColumn("live", live).filter((F.col("kind") < 3) | F.col("live"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "value_hash", "n_repos", "n_owners", "live"))).alias("spans"))
    return rows.select("row", "doc_id").join(spans, "row", "left").drop("row")


def digest_columns(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of :func:`scan`'s rows."""
    s = F.coalesce(F.col("spans"), F.array())
    names = F.array(*[F.lit(k) for k in KINDS])

    def count(k: int) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")

    def text(x: Column) -> Column:
        return F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])

    base = F.filter(s, lambda x: x["kind"] < 3)
    joined = lambda a: F.array_join(F.transform(a, text), ",")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(s).alias("spans"),
        F.size(F.filter(s, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(s, lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )
