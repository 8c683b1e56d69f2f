"""The pipeline against the same stages by plain means, on a small table with planted rows."""

import hashlib
import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import frame, prose


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    good = [(i, prose(i, 70)) for i in range(60)]
    junk = [(100 + i, " ".join(["$$$ ### %%%"] * 30 + [str(i)])) for i in range(30)]
    copies = [(200 + i, good[i][1]) for i in range(5)]
    close = [(300 + i, good[10 + i][1] + " end") for i in range(5)]
    item = prose(999, 25)
    leaks = [(400 + i, prose(600 + i, 40) + " " + item + " " + prose(700 + i, 20)) for i in range(3)]
    rows = good + junk + copies + close + leaks
    r.shuffle(rows)
    frame(spark, [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(i, 1, 0) for i, _ in good[:40]] + [(i, 0, 0) for i, _ in junk[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = {i: t for i, t in rows if i < 100 or i >= 200}
    by_text = {}
    for i, t in left.items():
        by_text[t] = max(i, by_text.get(t, i))
    left = {i: t for t, i in by_text.items()}
    comps = {}
    for i in left:
        comps[i] = i
    sets = {i: brute.shingles(t, 5) for i, t in left.items()}
    for a in sorted(left):
        for b in sorted(left):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comps[b] = min(comps[a], comps[b])
    want = {i for i in left if comps[i] == i and i < 400}
    assert set(got) == want and len(want) == 60
    for i in want:
        assert got[i].decoded_sha256 == hashlib.sha256(left[i].encode()).hexdigest()


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
