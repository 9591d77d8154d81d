"""Operators on small hand-made inputs: edge cases, sources and sinks, grouped assignment, streaming."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from litmill.functions import text as tx
from litmill.operators import aggregate, blocks, derive, diff, lineage, logs, lookup, pairing, quality, search, units, vectors
from litmill.plans import query as planner
from litmill.sources import readers
from litmill.sources.store import Store, verify_vectors
from litmill.streaming import events


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_years_as_sqlite_casts_them(spark):
    assert column(spark, ["", None, "2021-03", "n.d.", " 1999", "+7x", "-3"], tx.sqlite_int) == [0, None, 2021, 0, 1999, 7, -3]
    papers = spark.createDataFrame([(1, ""), (2, None), (3, "2021-03"), (4, "n.d."), (5, "2000")], "paper_id int, year string")
    ids = lambda df: sorted(r.paper_id for r in df.collect())
    assert ids(search.metadata_filters(papers, year_from=2000)) == [3, 5]
    assert ids(search.metadata_filters(papers, year_to=2010)) == [1, 4, 5]
    assert ids(search.metadata_filters(papers)) == [1, 2, 3, 4, 5]


def test_identifiers(spark):
    assert column(spark, ["see 10.1000/AB.c-1 there", "10.12/x", ""], tx.doi) == ["10.1000/AB.c-1", None, None]
    assert column(spark, ["fracture", "abc", " ab12cd34 "], tx.item_key) == ["FRACTURE", None, "AB12CD34"]
    assert column(spark, ["smith2021chain", "smith", "plainword", "a-bcdef"], tx.citation_key) == ["smith2021chain", None, None, "a-bcdef"]
    assert column(spark, ["in 1999 and 2021, not 12021 or 1850", "x2000"], tx.years) == [[1999, 2021], []]
    assert column(spark, ["XIV", "iv", "abc"], tx.roman_to_int) == [14, 4, None]
    assert column(spark, ["(3) x", "[12] y", "7. z", "8) q", "9 r", "none"], tx.leading_number) == [3, 12, 7, 8, 9, None]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("", "empty"), ("Journal Pre-proof", "preproof_marker"), ("(a)", "panel_label"), ("IV. RESULTS", "heading_roman"), ("[3] Smith", "reference_numeric_bracket"), ("2.1 Methods", "heading_numbered"), ("3. Smith AB, title", "reference_numeric_dot"), ("(4) Smith", "reference_numeric_parenthesis"), ("2.1 Setup", "heading_numbered"), ("A. Setup of work", "heading_alpha"), ("• discussion", "none"), ("Discussion", "canonical_section_name"), ("Fig. 3 shows", "figure_number"), ("Table S2", "table_number"), ("tiny bit", "short_fragment")],
)
def test_marker_types(spark, text, kind):
    got = column(spark, [text], tx.marker_type)[0]
    assert got == kind or (kind == "none" and got in ("canonical_section_name", "short_fragment"))


def test_query_signals_and_plans(spark):
    q = spark.createDataFrame([("Smith 2021 chain reaction",), ("10.1000/xyz",), ("dc field",), ("smith2021chain",), ("Smith Jones",), ("",)], "q string")
    got = {r.q: r for r in planner.plans(q, "q", "metadata").collect()}
    assert got["Smith 2021 chain reaction"].query_class == "mixed_query" and got["Smith 2021 chain reaction"].argument == "Smith" and got["Smith 2021 chain reaction"].year_from == 2021
    assert got["10.1000/xyz"].command == "paper-context" and got["smith2021chain"].query_class == "identifier_exact"
    assert planner.plan(spark, "dc field", "content").command == "retrieve"
    assert planner.plan(spark, "dc field", "evidence").argument == "dc field"
    assert planner.expand("ACL and OA") == ["ACL and OA", "anterior cruciate ligament and OA", "ACL and osteoarthritis"]
    assert planner.expand("knee pain") == ["knee pain", "knee joint pain", "genu pain"]
    assert planner.expand("nothing") == ["nothing"]


def test_search_modes(spark):
    papers = spark.createDataFrame([(1, "knee repair", "en", "a"), (2, "knee", "en", "b"), (3, "hip", "en", "c")], "paper_id int, title string, domain string, first_author string")
    assert [r.paper_id for r in search.metadata_search(papers, "knee repair", 5).collect()] == [1]
    assert search.metadata_search(papers, "knee absent", 5).count() == 0
    assert {r.paper_id for r in search.metadata_search(papers, "knee-repair", 5).collect()} == {1, 2}
    assert search.fts_syntax_error("what is knee?") and search.fts_syntax_error("a AND") and not search.fts_syntax_error("two words")


def chunked(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in units.chunks(df, "id", "text", **how).orderBy("id", "chunk_index").collect():
        assert r.chunk_index == len(out[r.id]) + 1 and r.token_estimate == len(r.text) // 4
        out[r.id].append((r.page_number, r.section, r.text))
    return out


def walked(paragraphs, heads, stable):
    """Chunks of one page by a walk over its paragraphs."""
    out, section, i = [], "Text", 0
    while i < len(paragraphs):
        if i in heads:
            section, i = paragraphs[i], i + 1
            continue
        group = [paragraphs[i]]
        while len(group) < 3 and i + len(group) < len(paragraphs) and i + len(group) not in heads:
            group.append(paragraphs[i + len(group)])
        out.append((1, section, "\n\n".join(group)))
        i += len(group) - 1 if len(group) > 1 else 1 if stable else 2
    return out


def test_chunk_strides(spark):
    got = chunked(spark, ["\n\n".join(["p1", "Introduction", "p2", "p3", "p4", "p5"]), "", None])
    assert [c[2] for c in got[0]] == ["p1", "p2\n\np3\n\np4", "p4\n\np5", "p5"] and got[1] == got[2] == []
    assert chunked(spark, ["Methods\n\nbody text\n\nmore"], stable=True)[0][0][1] == "Methods"
    assert [c[0] for c in chunked(spark, ["<!-- page 7 -->a\n\nb<!-- page 9 -->c"], stable=True)[0]] == [2, 2, 3]
    rng = random.Random(5)
    names = ["Methods", "Results", "Discussion"]
    cases = [[rng.choice(names) if rng.random() < 0.3 else f"q{i}" for i in range(rng.randrange(1, 14))] for _ in range(60)]
    for stable in (False, True):
        got = chunked(spark, ["\n\n".join(c) for c in cases], stable=stable)
        for k, c in enumerate(cases):
            assert got[k] == walked(c, {i for i, x in enumerate(c) if x in names}, stable), c


def test_split_oversized(spark):
    rng = random.Random(6)
    long = ("A sentence of words. " * 400).strip()
    texts = [long, "short", None, "", "x" * 5000, "a. " + "b" * 3000, "\n\n".join("w " * rng.randrange(1, 900) for _ in range(12)), " ".join(rng.choice(["aa", "bb.", "ccc"]) for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in units.split_oversized(df, "text", 200).orderBy("id", "part_ordinal").collect():
        assert r.part_ordinal == len(out[r.id]) + 1
        out[r.id].append(r.text)

    def halves(t):  # by the rule, one after the other
        todo, done = [t], []
        while todo:
            x = todo.pop()
            mid = len(x) // 2
            at = x.rfind(". ", 0, mid)
            at = at if at >= mid // 2 else x.rfind(" ", 0, mid)
            at = at if at > 0 else mid
            two = [x[: at + 1].strip(), x[at + 1 :].strip()]
            if len(x) // 4 <= 200 or not all(two):
                done.append(x)
            else:
                todo += reversed(two)
        return done

    for i, t in enumerate(texts):
        if t is None or len(t) // 4 <= 200:
            assert out[i] == [t]
            continue
        groups = [[]]
        for p in t.split("\n\n"):
            if groups[-1] and sum(len(x) // 4 for x in groups[-1]) + len(p) // 4 > 200:
                groups.append([])
            groups[-1].append(p)
        assert out[i] == [h for g in groups for h in halves("\n\n".join(g))], i


def test_full_text_folds_diacritics(spark):
    assert column(spark, ["Café NAÏVE Ångström", "cafe\u0301", "Straße 日本", "x_1"], tx.fts_tokens) == [["cafe", "naive", "angstrom"], ["cafe"], ["straße", "日本"], ["x_1"]]
    assert search.query_terms("Café cafe Über") == ["cafe", "uber"]
    papers = spark.createDataFrame([(1, "Un café", "fr", "a"), (2, "thé", "fr", "b")], "paper_id int, title string, domain string, first_author string")
    assert [r.paper_id for r in search.metadata_search(papers, "CAFE", 5).collect()] == [1]


def test_merging_caps_and_ties(spark):
    hits = spark.createDataFrame([("body", 1, 7, 0.9), ("body", 1, 7, 0.8), ("body", 2, 7, 0.9), ("body", 3, 7, 0.7), ("object", 4, 8, 0.7), ("body", 5, 9, 0.7)], "source string, unit_id int, paper_id int, score double")
    assert [(r.source, r.unit_id) for r in vectors.merge_capped(hits, 3).collect()] == [("body", 1), ("body", 2), ("body", 5)]


def test_fusion_tiers(spark):
    text = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.6)], "unit_id int, paper_id int, bm25_score double")
    vec = spark.createDataFrame([("body", 1, 1, 0.8), ("body", 9, 1, 0.9), ("object", 3, 1, 0.1)], "source string, unit_id int, paper_id int, vec_score double")
    got = [(r.source, r.unit_id) for r in vectors.fuse(text, vec, 10).collect()]
    assert got == [("body", 2), ("body", 1), ("object", 3)]
    assert [r.unit_id for r in vectors.fuse(text.limit(0), vec, 10).collect()] == [9, 1, 3]


def test_main_attachment(spark):
    rows = spark.createDataFrame([(1, "x", 5, 0), (1, "PDF", 1, 1), (2, "aaa", 9, 0), (2, "b", 3, 1), (3, "long title", 4, 0), (3, "short", 4, 1)], "k int, title string, size long, ord int")
    assert {r.k: r.title for r in derive.main_attachment(rows, "k", "title", "size", "ord").collect()} == {1: "PDF", 2: "aaa", 3: "short"}


def test_layout(spark):
    heads = spark.createDataFrame([(1, 0, 1), (1, 3, 2), (1, 5, 2), (1, 8, 1)], "d int, ord long, level int")
    last = spark.createDataFrame([(1, 10)], "d int, last long")
    got = blocks.heading_intervals(heads, "d", last)
    assert [(r.ord, r.end) for r in got.orderBy("ord").collect()] == [(0, 7), (3, 4), (5, 7), (8, 10)]
    owned = blocks.owning_heading(got.withColumn("title", F.concat(F.lit("h"), F.col("ord"))), spark.createDataFrame([(1, 4), (1, 6), (1, 9)], "d int, ord long"), "d")
    assert [(r.ord, r.title) for r in owned.orderBy("ord").collect()] == [(4, "h3"), (6, "h5"), (9, "h8")]
    pages = spark.createDataFrame([(1, p, b, t) for p, b, t in ((1, True, False), (2, True, False), (3, False, True), (4, True, False))], "d int, page int, has_body boolean, has_tail boolean")
    assert blocks.body_end(pages, "d").first().body_end == 2
    figs = spark.createDataFrame([(1, 1, "matched", 1), (1, 2, "ambiguous", 1), (1, 3, "ambiguous", 1)], "d int, number int, status string, n_assets int")
    assert {r.number: r.status for r in blocks.promote_neighbours(figs, "d").collect()} == {1: "matched", 2: "promoted", 3: "ambiguous"}


def test_pairing(spark):
    b = "paper_id long, page long, id long, kind string, x1 double, y1 double, x2 double, y2 double"
    rows = [(1, 1, 1, "legend", 0.0, 100.0, 50.0, 110.0), (1, 1, 2, "asset", 0.0, 0.0, 50.0, 95.0), (1, 2, 3, "legend", 0.0, 0.0, 50.0, 10.0), (1, 1, 4, "asset", 200.0, 0.0, 250.0, 90.0), (1, 9, 5, "legend", 0.0, 0.0, 5.0, 5.0)]
    got = {r.legend_id: (r.asset_id, r.rule) for r in pairing.pair(spark.createDataFrame(rows, b)).collect()}
    assert got == {1: (2, "same_page"), 3: (4, "next_page"), 5: (None, "unmatched")}
    boxes = spark.createDataFrame([(1, i, float(x), 0.0, float(x) + 10, 10.0) for i, x in ((1, 0), (2, 40), (3, 90), (4, 500))], "page long, id long, x1 double, y1 double, x2 double, y2 double")
    assert {r.id: r.cluster for r in pairing.asset_clusters(boxes, "page", 400.0, 600.0).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_quality(spark):
    assert column(spark, [3, 4, 11], lambda c: quality.compare(c, "gt", 3), "int") == [False, True, True]
    assert column(spark, [None], lambda c: quality.compare(c, "lt", 3), "int") == [False]
    marks = spark.createDataFrame([(1, [("correct", "h")], "h"), (2, [("correct", "old")], "h"), (3, [], "h"), (4, [("wrong", "h")], "h")], "id int, marks array<struct<verdict:string,result_hash:string>>, h string")
    got = {r.id: r.v for r in marks.select("id", quality.human_validation(F.col("marks"), F.col("h")).alias("v")).collect()}
    assert got == {1: "confirmed", 2: "stale", 3: "unreviewed", 4: "disputed"}


def test_diffs(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, h string"), spark.createDataFrame([(2, "y"), (3, "q"), (4, "w")], "k int, h string")
    assert {r.k: r.change for r in diff.state_diff(a, b, "k", "h").collect()} == {1: "deleted", 2: "unchanged", 3: "changed", 4: "added"}
    left = diff.delete_cascade({"t": (a, "k")}, b, "k")["t"]
    assert [r.k for r in left.collect()] == [1]
    assert diff.has_duplicates(a.union(a), "k").first()[0] and not diff.has_duplicates(a, "k").first()[0]


def test_digests_ignore_row_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    one = lambda df: lineage.table_digest(df, ["k", "v"]).first()[0]
    assert one(a) == one(a.orderBy(F.desc("k"))) != one(a.filter("k = 1"))


def test_collection_resolution(spark):
    catalog = spark.createDataFrame([("d", "A/B"), ("d", "A/C"), ("d", "X/C")], "domain string, path string")
    choices = spark.createDataFrame([("d", "A/B"), ("d", "a/b"), ("d", "B"), ("d", "C"), ("d", "zzz"), ("d", "")], "domain string, raw string")
    got = {r.raw: (r.resolution, r.path) for r in lookup.resolve_collection(choices, catalog).collect()}
    assert got == {"A/B": ("exact", "A/B"), "a/b": ("exact_ci", "A/B"), "B": ("leaf", "A/B"), "C": ("ambiguous", None), "zzz": ("unresolved", None), "": ("empty", None)}


def test_sources(spark, tmp_path):
    item = {"key": "K1", "itemType": "journalArticle", "title": "T", "date": "May 2020", "creators": [{"creatorType": "author", "firstName": "A", "lastName": "B"}, {"creatorType": "editor", "lastName": "E"}], "extra": "x\nCitation Key: ab2020", "attachments": [{"path": "storage:ABCD1234/f.pdf", "contentType": "application/pdf", "title": "PDF", "size": 3}]}
    (tmp_path / "exports").mkdir()
    (tmp_path / "exports" / "bones.json").write_text(json.dumps({"items": [item, {"key": "N", "itemType": "note"}], "collections": {"C": {"name": "Top", "parent": "", "items": []}}}))
    (tmp_path / "exports" / "bad.json").write_text("{oops")
    files = readers.exports(spark, str(tmp_path / "exports")).cache()
    rows = readers.export_items(files).collect()
    assert [(r.domain, r.key, r.year, r.authors, r.citation_key) for r in rows] == [("bones", "K1", "2020", ["A B"], "ab2020")]
    assert readers.pdf_attachments(readers.export_items(files)).first().path == Row(kind="storage", path="storage:ABCD1234/f.pdf", key="ABCD1234")
    assert files.filter("_corrupt_record is not null").count() == 1
    (tmp_path / "log.jsonl").write_text('{"id":"1","paper_id":"p","excerpt":"e"}\nbroken\n\n{"id":"2","paper_id":"","excerpt":"e"}\n')
    log = readers.jsonl(spark, str(tmp_path / "log.jsonl"), readers.READING_LOG)
    assert [r.id for r in logs.valid_entries(log, ["paper_id", "excerpt"]).collect()] == ["1"]
    (tmp_path / "n.md").write_text('---\nkey: K1\nanalyze: true\ndomain: "d"\n---\ntext')
    assert readers.analyze_queue(readers.notes(spark, str(tmp_path), ["key", "analyze", "domain"])).first().domain == "d"


def test_store_publishes_checked_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read() is None
    good = spark.createDataFrame([(1, [0.0, 1.0])], "vec_id int, embedding array<float>")
    store.publish(good, verify_vectors(2, 1))
    with pytest.raises(ValueError):
        store.publish(good, verify_vectors(2, 5))
    assert store.read().count() == 1
    store.publish(good.union(good))
    assert store.read().count() == 2


def test_stream_windows(spark, tmp_path):
    src = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 3.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    src.write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.read(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double"), late=None)
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_aggregates(spark):
    b = spark.createDataFrame([(1, "f", 9, 100, 5, 1), (1, "f", 9, 100, 5, 2), (1, "g", 9, 100, 5, 1), (1, "g", 9, 100, 5, 1)], "d int, font string, size int, width int, x int, page int")
    assert aggregate.body_anchor(b).first().font == "f"
    rows = spark.createDataFrame([(1, 1), (1, 4), (2, 2)], "g int, n int")
    assert {r.g: r.missing for r in aggregate.missing_numbers(rows, "g", "n").collect()} == {1: "2,3", 2: "1"}
