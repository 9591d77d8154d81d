"""The index on disk against the scan."""

import random

import pytest

from litmill.operators import postings, search

WORDS = "knee café hip repair bone the of naïve x_1 日本".split()


@pytest.mark.parametrize("mode", ["or", "and"])
def test_index_scores_as_the_scan_does(spark, tmp_path, mode):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))) for i in range(80)] + [(900, None), (901, "Café CAFE cafe")]
    df = spark.createDataFrame(rows, "paper_id long, title string")
    index = postings.TextIndex(spark, f"{tmp_path}/{mode}")
    assert not index.ready()
    index.build(df, "paper_id", ["title"])
    assert index.ready()
    for q in ("knee Cafe", "the", "absent", "日本 of x_1", "knee absent"):
        terms = search.query_terms(q)
        want = {r.paper_id: r.score for r in search.bm25(df, "paper_id", ["title"], terms, mode).collect()}
        got = {r.key: r.score for r in index.search(terms, mode, "long").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got), q


def test_an_index_is_built_once_for_its_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "knee repair"), (2, "hip")], "k long, t string")
    df.write.parquet(f"{tmp_path}/a")
    read = spark.read.parquet(f"{tmp_path}/a")
    first = postings.index_of(spark, read.inputFiles(), read, "k", ["t"])
    assert postings.index_of(spark, read.inputFiles(), read.limit(0), "k", ["t"]).search(["knee"], "or", "long").count() == 1 == first.search(["hip"], "or", "long").count()
    df.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/a")
    again = spark.read.parquet(f"{tmp_path}/a")
    assert postings.index_of(spark, again.inputFiles(), again, "k", ["t"]).search(["hip"], "or", "long").count() == 0


def test_an_index_of_nothing(spark, tmp_path):
    index = postings.TextIndex(spark, f"{tmp_path}/none")
    index.build(spark.createDataFrame([], "k long, t string"), "k", ["t"])
    assert index.ready() and index.search(["a"], "or", "long").count() == 0
