"""Tables, scopes and coverage on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from litmill.operators import context, ocr, quality, tables
from litmill.sources.store import VectorStore

BOX = "paper_id long, page int, id long, x1 double, y1 double, x2 double, y2 double"


def test_tables_are_claimed_in_reading_order(spark):
    captions = [(1, 1, 10, 0, 100, 400, 120), (1, 1, 11, 0, 500, 400, 520), (1, 2, 12, 0, 50, 400, 70), (1, 3, 13, 0, 50, 400, 70), (1, 5, 14, 0, 50, 400, 70), (2, 1, 15, 0, 100, 400, 120)]
    assets = [(1, 1, 20, 0, 130, 400, 300), (1, 1, 21, 500, 540, 900, 700), (1, 1, 22, 0, 800, 400, 950), (1, 2, 23, 500, 100, 900, 300), (1, 3, 24, 0, 80, 400, 200), (1, 3, 25, 0, 300, 400, 500)]
    c = spark.createDataFrame([(*r[:3], *map(float, r[3:]), r[2], False) for r in captions], f"{BOX}, number long, continued boolean")
    a = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in assets], BOX)
    got = {(r.paper_id, r.caption_id): (r.asset_id, r.status) for r in tables.inventory(c, a).collect()}
    pairs = {(r.caption_id, r.asset_id): r.score for r in tables.scores(c, a).collect()}
    # by hand: one caption after the other, first on its page, then on the pages beside it
    owner, want = {}, {k: (None, "pending") for k in [(1, 10), (1, 11), (1, 12), (1, 13), (1, 14), (2, 15)]}
    page = {r[2]: r[1] for r in captions + assets}
    for beside in (False, True):
        for paper, caption in want:
            if want[paper, caption][1] != "pending":
                continue
            free = sorted(((-s, x) for (k, x), s in pairs.items() if k == caption and x not in owner and (beside or page[x] == page[caption])))
            if not free or -free[0][0] < 0.4:
                want[paper, caption] = (None, "unmatched" if beside else "pending")
            elif len(free) > 1 and free[1][0] - free[0][0] < 0.15 - 1e-9:
                want[paper, caption] = (None, "ambiguous" if beside else "pending")
            else:
                owner[free[0][1]] = caption
                want[paper, caption] = (free[0][1], "matched" if -free[0][0] >= 0.6 else "matched_low_confidence")
    assert got == want and got[1, 10] != got[1, 11] and got[2, 15] == (None, "unmatched")
    assert {r.status for r in tables.inventory(c, a.limit(0)).collect()} == {"unmatched"}
    assert tables.inventory(c.limit(0), a).count() == 0


def test_scopes(spark):
    p = spark.createDataFrame([(1, "knee", ["a/b"], "indexed"), (2, "hip", ["a/c"], "fulltext_ready"), (3, "hip", [], "indexed")], "paper_id int, domain string, collections array<string>, lifecycle string")
    one = lambda terms: tuple(context.assess_scope(p, terms).first())
    assert one(["HIP"]) == ("domain", "hip", 2, 1, "rg_now")
    assert one(["a/c"]) == ("collection", "a/c", 1, 1, "rg_now")
    assert one([]) == ("library", "full library", 3, 1, "rg_now")
    assert context.context_filter(p, domain="hip").count() == 2 and context.context_filter(p, collection="a/").count() == 2 and context.context_filter(p).count() == 3


def test_policies_merge():
    assert quality.merged({"a": {"x": 1, "y": [1, 2]}, "b": 1}, {"a": {"y": [3]}, "c": {"z": 2}}) == {"a": {"x": 1, "y": [3]}, "b": 1, "c": {"z": 2}}


def test_page_coverage_and_states(spark):
    rows = [(1, 1, 1, "abcdef", "abcdefghij"), (1, 1, 2, "", "klmnopqrst"), (1, 2, 1, "x", ""), (1, 0, 1, "x", "y"), (1, 3, 1, "z", None)]
    got = {r.page: (r.status, r.ratio) for r in ocr.page_coverage(spark.createDataFrame(rows, "paper_id int, page int, ord int, text string, pdf_text string")).collect()}
    assert got == {1: ("low", round(6 / 21, 6)), 2: ("missing_pdf_text", None)}
    files = spark.createDataFrame([("b", b"2"), ("a", b"1")], "path string, content binary")
    again = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    assert ocr.files_digest(files).first() == ocr.files_digest(again).first()


def test_one_writer_at_a_time(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"), 2)
    rows = spark.createDataFrame([(1, 7, "u", [0.0, 1.0]), (2, 8, "", [1.0, 1.0]), (3, 8, "w", [3.0])], "vec_id long, paper_id long, unit_id string, embedding array<float>")
    store.add(rows)
    with store.store.lock(), pytest.raises(BlockingIOError):
        store.add(rows)
    assert tuple(store.health().first()) == (3, 1, 1) and store.capabilities()["query"]
    store.delete_papers(spark.createDataFrame([(8,)], "paper_id long"))
    assert [r.vec_id for r in store.query([0.0, 0.0], 5).collect()] == [1]


def by_all_pairs(captions, assets, pairs):
    """Claims from the scored pairs of all captions and assets. captions: (paper, page, id, y1)."""
    owner, state = set(), {(p, c): (None, "pending") for p, _, c, _ in captions}
    last = lambda v: (v is None or v != v, 0 if v is None or v != v else v)
    order = sorted(captions, key=lambda r: (r[0], r[1], last(r[3]), r[2]))
    for beside in (False, True):
        for paper, page, c, _ in order:
            if state[paper, c][1] != "pending":
                continue
            free = sorted((-s, a) for s, a, at in pairs.get((paper, c), []) if (paper, a) not in owner and (beside or at == page))
            if not free or -free[0][0] < tables.LEAST:
                state[paper, c] = (None, "unmatched" if beside else "pending")
            elif len(free) > 1 and free[1][0] - free[0][0] < tables.AHEAD - 1e-9:
                state[paper, c] = (None, "ambiguous" if beside else "pending")
            else:
                owner.add((paper, free[0][1]))
                state[paper, c] = (free[0][1], "matched" if -free[0][0] >= tables.SURE else "matched_low_confidence")
    return state


def test_claims_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    odd = lambda v: rng.choice([None, math.nan, math.inf, -math.inf, v]) if rng.random() < 0.04 else v

    def boxes(paper, n, start):
        out = []
        for i in range(n):
            x, y = (rng.choice([0.0, 100.0, 450.0]), rng.choice([50.0, 160.0, 500.0])) if paper % 2 else (rng.uniform(0, 2000), rng.uniform(0, 950))
            box = [x, y, x + rng.choice([-10, 0, 50, 200, 400]), y + rng.choice([0, 20, 400])]
            out.append((paper, rng.randint(1, 6), start + i, *(box if paper < 4 else map(odd, box))))
        return out

    captions = [r for p, n in ((0, 40), (1, 12), (2, 150), (3, 60), (4, 150), (5, 60)) for r in boxes(p, n, 1000)]
    assets = [r for p, n in ((0, 60), (1, 8), (2, 900), (3, 30), (4, 300), (5, 40)) for r in boxes(p, n, 5000)]
    c = spark.createDataFrame([(*r, r[2], rng.choice([True, False, None])) for r in captions], f"{BOX}, number long, continued boolean")
    a = spark.createDataFrame(assets, BOX)
    pairs = {}
    for r in tables.scores(c, a).collect():
        pairs.setdefault((r.paper_id, r.caption_id), []).append((r.score, r.asset_id, r.a_page))
    got = {(r.paper_id, r.caption_id): (r.asset_id, r.status) for r in tables.inventory(c, a).collect()}
    want = by_all_pairs([(r[0], r[1], r[2], r[4]) for r in captions], assets, pairs)
    assert got == want and len({s for _, s in got.values()}) == 4


def test_claims_make_no_pairs(spark):
    """4,000 captions and 40,000 assets of one page are 160 million pairs."""
    at = lambda n: (F.lit(1).cast("long").alias("paper_id"), F.lit(1).alias("page"), (F.col("id") + n).alias("id"), (F.col("id") * 37 % 1000).cast("double").alias("x1"), (F.col("id") * 91 % 900).cast("double").alias("y1"))
    box = lambda df, n: df.select(*at(n)).withColumn("x2", F.col("x1") + 60).withColumn("y2", F.col("y1") + 20)
    c = box(spark.range(4000), 100_000).withColumn("number", F.col("id")).withColumn("continued", F.lit(False))
    found = tables.inventory(c, box(spark.range(40_000), 0))
    assert "Join" not in found._jdf.queryExecution().toString()
    assert {r.status: r["count"] for r in found.groupBy("status").count().collect()} == {"ambiguous": 4000}


def test_plans_of_papers_that_share_a_name(spark):
    plans = spark.createDataFrame([(1, "content", "plan", "A"), (2, "locate", "plan", "b"), (3, "content", "plan", None), (4, "content", "plan", "none"), (5, "content", "plan", "A"), (5, "content", "plan", "B"), (6, "content", "plan", "A"), (6, "content", "plan", "C"), (7, "locate", "plan", "d")], "id int, intent string, command string, identifier string")
    papers = spark.createDataFrame([(10, ["a", "a", "c"]), (10, ["a"]), (11, ["b"]), (12, ["b", None]), (13, None), (None, ["d"]), (14, ["d"])], "paper_id int, names array<string>")
    got = sorted((r.id, r.command, r.scope, r.paper_key) for r in context.enrich_plan(plans, papers, False).collect())
    assert got == [(1, "retrieve", "paper", 10), (2, "search", "library", None), (3, "plan", "library", None), (4, "search", "library", None), *[(5, "search", "library", None)] * 2, *[(6, "retrieve", "paper", 10)] * 2, (7, "paper-context", "paper", 14)]


def test_papers_that_share_a_name_are_one_row_of_the_join(spark):
    """2,000 plans and 2,000 papers with one name are 4 million pairs."""
    plans = spark.range(2000).select("id", F.lit("content").alias("intent"), F.lit("plan").alias("command"), F.lit("X").alias("identifier"))
    papers = spark.range(2000).select(F.col("id").alias("paper_id"), F.array(F.lit("x")).alias("names"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = context.enrich_plan(plans, papers, False)
        assert len(found.collect()) == 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    nodes, made = [found._jdf.queryExecution().executedPlan()], []
    while nodes:
        x = nodes.pop()
        nodes += [x.children().apply(i) for i in range(x.children().size())]
        if "Join" in x.nodeName():
            made.append(x.metrics().apply("numOutputRows").value())
    assert made == [2000, 2000]
