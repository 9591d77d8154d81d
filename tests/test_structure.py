"""Document structure on a small paper."""

from pyspark.sql import functions as F

from litmill.operators import structure

BLOCK = "paper_id long, page int, block_id string, raw_label string, raw_order int, bbox array<double>, text string, page_width double, page_height double"


def paper(spark):
    rows = [("doc_title", "A Study of Things"), ("text", "J Smith"), ("text", "Abstract We study."), ("title", "1 Introduction"), ("text", "Body text of the paper that runs for a while."), ("text", "Figure 1. A thing."), ("image", ""), ("title", "2.1 Methods used"), ("text", "More body text that says how."), ("text", "Acknowledgements"), ("text", "We thank everyone who helped us with this."), ("title", "References"), ("text", "1. Smith AB. Title. J 2020."), ("footer", "page 3")]
    return spark.createDataFrame([(1, 1 + i // 6, f"b{i % 6}", label, i, [50.0, 100.0 + 40 * (i % 6), 500.0, 120.0 + 40 * (i % 6)], t, 600.0, 800.0) for i, (label, t) in enumerate(rows)], BLOCK)


def test_roles_zones_and_markdown(spark):
    got = structure.structured(paper(spark)).orderBy("ord").collect()
    assert [r.role for r in got] == ["title", "body_paragraph", "abstract", "section_heading", "body_paragraph", "figure_caption", "media_asset", "section_heading", "body_paragraph", "backmatter_heading", "backmatter_body", "reference_heading", "reference_item", "noise"]
    assert [r.zone for r in got][0] == "frontmatter" and got[4].zone == "body" and got[12].zone == "references"
    md = structure.render(structure.structured(paper(spark))).first().markdown
    assert md.startswith("<!-- page 1 -->\n\n# A Study of Things") and "### 2.1 Methods used" in md and "page 3" not in md.split("\n")[-1]
    heads = structure.heading_events(structure.structured(paper(spark))).orderBy("ord").collect()
    assert [(h.title, h.level) for h in heads] == [("1 Introduction", 1), ("2.1 Methods used", 2), ("References", 1)]


def test_audits(spark):
    inv = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "paper_id int, number int, digest string")
    art = spark.createDataFrame([(1, 1, "x"), (1, 3, "c")], "paper_id int, number int, digest string")
    assert {r.number: r.issue for r in structure.render_audit(inv, art, ["paper_id", "number"]).collect()} == {1: "stale", 2: "not_rendered", 3: "not_in_inventory"}
    assert {r.number for r in structure.reconcile_figures(inv, inv, art).collect()} == {2, 3}
    figs = spark.createDataFrame([(1, 1, 0), (1, 1, 2), (1, 2, 0)], "paper_id int, number int, n_assets int")
    assert sorted((r.number, r.n_assets) for r in structure.suppress_ghosts(figs).collect()) == [(1, 2), (2, 0)]


def test_texts(spark):
    df = spark.createDataFrame([("a &lt;b&gt;  exam-\nple", "see \\( x + y \\) and [1,2] **ﬁne**")], "a string, b string")
    r = df.select(structure.clean_text("a").alias("a"), structure.math_text("b").alias("m"), structure.comparable("b").alias("c")).first()
    assert r.a == "a <b> example" and "$x + y$" in r.m and r.c.endswith("and fine")
    xml = spark.createDataFrame([("<PubmedArticle><PMID>7</PMID><Abstract><AbstractText Label='A'>x</AbstractText><AbstractText Label='B'>y</AbstractText></Abstract><ArticleId IdType='doi'>10.1/Z</ArticleId></PubmedArticle>",)], "x string")
    assert tuple(structure.replayed_pubmed(xml, "x").first()) == ("7", "10.1/z", "A: x\nB: y")
    source = spark.createDataFrame([(1, "T", "")], "paper_id int, title string, doi string")
    found = spark.createDataFrame([(1, "t ", "10.1/a")], "paper_id int, title string, doi string")
    m = structure.resolve_metadata(source, found, ["title", "doi"]).first()
    assert (m.title, m.title_from, m.doi_from) == ("T", "both", "document")


def test_adjacent_headings_merge(spark):
    rows = [(1, 1, i, "section_heading", [0.0, 20.0 * i, 1.0, 20.0 * i + 15], f"h{i}") for i in range(3)] + [(1, 1, 3, "body_paragraph", [0.0, 90.0, 1.0, 99.0], "t")]
    df = spark.createDataFrame(rows, "paper_id int, page int, ord int, role string, bbox array<double>, text string")
    assert [r.text for r in structure.merge_headings(df).orderBy("ord").collect()] == ["h0 h1", "h2", "t"]
