"""Structured documents from raw blocks: signatures, seed roles, zones, rendering, and audits of what was rendered.

Page-level context comes from windows; everything else is row expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.functions import text as tx

REFERENCE_ROLES = ("reference_heading", "reference_item")
HEADINGS = ("heading_numbered", "heading_roman", "heading_alpha", "canonical_section_name")
BACKMATTER = r"^(?:acknowledge?ments?|funding|conflicts? of interest|competing interests|author contributions|data availability|supplementary|appendix)"


def signatures(blocks: DataFrame, step: float = 5.0) -> DataFrame:
    """Blocks with marker, layout and font signatures that alike blocks share."""
    size = F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0))
    layout = F.struct(tx.bucket(F.get("bbox", F.lit(0)), step).alias("x"), tx.bucket(size, step).alias("width"), tx.bucket(F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1)), step).alias("height"))
    return blocks.withColumn("marker", tx.marker_type("text")).withColumn("layout", layout)


def seed_role() -> Column:
    """A block's first role from its label, text and place; the first rule that holds decides. Blocks need marker (see signatures)."""
    low, label, m = F.lower(F.trim(F.coalesce("text", F.lit("")))), F.lower(F.coalesce("raw_label", F.lit(""))), F.col("marker")
    top, bottom = F.get("bbox", F.lit(1)) / F.col("page_height"), F.get("bbox", F.lit(3)) / F.col("page_height")
    return (
        F.when(label.isin("header", "footer", "page_number", "number"), "noise")
        .when((bottom < 0.06) | (top > 0.94), "noise")
        .when(m == "preproof_marker", "noise")
        .when(label.isin("image", "figure", "chart"), "media_asset")
        .when(label == "table", "table_asset")
        .when(label.isin("formula", "equation"), "formula")
        .when((m == "figure_number") | (label == "figure_caption"), "figure_caption")
        .when((m == "table_number") | (label == "table_caption"), "table_caption")
        .when(low.rlike(r"^(?:references|bibliography|literature cited)\W*$"), "reference_heading")
        .when(low.rlike(BACKMATTER) & (F.length(low) < 80), "backmatter_heading")
        .when(m.isin("reference_numeric_bracket", "reference_pattern") | label.isin("reference", "reference_content"), "reference_item")
        .when((label == "doc_title") | ((F.col("page") == 1) & (label == "title") & (top < 0.35) & ~m.isin(*HEADINGS)), "title")
        .when(low.rlike(r"^abstract\W*") & (F.col("page") <= 2), "abstract")
        .when(m.isin(*HEADINGS) | label.isin("title", "paragraph_title", "section_title"), "section_heading")
        .when((m == "affiliation_marker") & (F.col("page") == 1), "affiliation")
        .when(m == "panel_label", "panel_label")
        .when(low == "", "empty")
        .otherwise("body_paragraph")
    )


def settled_roles(blocks: DataFrame) -> DataFrame:
    """Roles after context: numbered lines after the reference heading are entries; what follows a backmatter heading before it is backmatter."""
    order = Window.partitionBy("paper_id").orderBy("page", "ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    refs = F.max(F.when(F.col("role") == "reference_heading", 1).otherwise(0)).over(so_far)
    back = F.max(F.when(F.col("role") == "backmatter_heading", 1).otherwise(0)).over(so_far)
    role = (
        F.when((refs == 1) & F.col("role").isin("body_paragraph", "section_heading") & F.col("marker").startswith("reference_"), "reference_item")
        .when((refs == 0) & (back == 1) & (F.col("role") == "body_paragraph"), "backmatter_body")
        .otherwise(F.col("role"))
    )
    return blocks.withColumn("_settled", role).withColumn("role", F.col("_settled")).drop("_settled")


def zones(blocks: DataFrame) -> DataFrame:
    """frontmatter, body, references or tail of each block, from the first body heading and the reference heading."""
    order = Window.partitionBy("paper_id").orderBy("page", "ord").rowsBetween(Window.unboundedPreceding, 0)
    started = F.max(F.when(F.col("role") == "section_heading", 1).otherwise(0)).over(order)
    refs = F.max(F.when(F.col("role").isin(*REFERENCE_ROLES), 1).otherwise(0)).over(order)
    zone = F.when((refs == 1) & F.col("role").isin(*REFERENCE_ROLES), "references").when(refs == 1, "tail").when(started == 1, "body").otherwise("frontmatter")
    return blocks.withColumn("zone", zone)


def structured(raw: DataFrame) -> DataFrame:
    """Raw blocks with ord, signatures, roles and zones."""
    w = Window.partitionBy("paper_id").orderBy("page", F.col("raw_order").isNull(), "raw_order", F.get("bbox", F.lit(1)), F.get("bbox", F.lit(0)), "block_id")
    return zones(settled_roles(signatures(raw).withColumn("ord", F.row_number().over(w)).withColumn("role", seed_role())))


def cross_validate(blocks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Role confidence lowered where a block's size lies far from its role's profile (role, mean_size, spread)."""
    j = blocks.join(F.broadcast(profiles.select("role", "mean_size", "spread")), "role", "left")  # one row for each role
    off = F.abs(F.col("size") - F.col("mean_size")) > 2 * F.greatest(F.col("spread"), F.lit(0.5))
    return j.withColumn("role_confidence", F.when(off, F.col("role_confidence") * 0.7).otherwise(F.col("role_confidence"))).drop("mean_size", "spread")


def render(blocks: DataFrame) -> DataFrame:
    """Markdown of each paper: page marks, headings by level, paragraphs; noise, media and empty blocks left out."""
    kept = blocks.filter(~F.col("role").isin("noise", "empty", "media_asset", "table_asset", "panel_label"))
    depth = F.length(F.regexp_replace(F.regexp_extract(F.trim("text"), r"^([0-9.]*)", 1), "[0-9]", "")) + 2
    line = F.when(F.col("role") == "title", F.concat(F.lit("# "), F.col("text"))).when(F.col("role").isin("section_heading", "reference_heading", "backmatter_heading"), F.concat(F.repeat(F.lit("#"), F.least(depth, F.lit(6))), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    first = F.row_number().over(Window.partitionBy("paper_id", "page").orderBy("ord")) == 1
    marked = F.when(first, F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n\n"), line)).otherwise(line)
    rows = kept.withColumn("_line", marked)
    return rows.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "_line"))), lambda x: x["_line"]), "\n\n").alias("markdown"))


def emitted_pages(spine: DataFrame, attachments: DataFrame) -> DataFrame:
    """Markdown of each page: its mark, its blocks in order (headings with their level), and after each block what is attached to it, once.

    spine: paper_id, page, ord, block_id, text, level (null for prose). attachments: paper_id, block_id, attachment_id, text.
    """
    own = spine.select("paper_id", "page", "ord", F.lit(0).alias("k"), F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).otherwise(F.col("text")).alias("t"))
    anchors = spine.groupBy("paper_id", "block_id").agg(F.min(F.struct("page", "ord")).alias("at"))
    more = attachments.dropDuplicates(["paper_id", "attachment_id"]).join(anchors, ["paper_id", "block_id"])
    rows = own.unionByName(more.select("paper_id", "at.page", "at.ord", F.col("attachment_id").cast("int").alias("k"), F.col("text").alias("t")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "k", "t"))), lambda x: x.t), "\n\n")
    return rows.groupBy("paper_id", "page").agg(F.concat(F.lit("<!-- page "), F.first("page").cast("string"), F.lit(" -->\n\n"), body).alias("markdown"))


def heading_events(blocks: DataFrame) -> DataFrame:
    """Headings in order with their level."""
    level = F.least(F.length(F.regexp_replace(F.regexp_extract(F.trim("text"), r"^([0-9.]*)", 1), "[0-9]", "")) + 1, F.lit(6)).cast("int")
    return blocks.filter(F.col("role").isin("section_heading", "reference_heading")).select("paper_id", "ord", "page", level.alias("level"), F.col("text").alias("title"))


def clean_text(c: Column | str) -> Column:
    """Entities resolved, soft hyphens at line ends joined, runs of blanks made one, trimmed."""
    t = F.col(c) if isinstance(c, str) else c
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"([a-z])-\n([a-z])", "$1$2"), "[ \t]+", " "))


def math_text(c: Column | str) -> Column:
    """LaTeX delimiters made uniform: \\( \\) and \\[ \\] as $ and $$, no blank just inside them."""
    t = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(F.regexp_replace(t, r"\\[\[\]]", r"\$\$"), r"\\[()]", r"\$")
    return F.regexp_replace(t, r"\$ +([^$]*?) +\$", r"\$$1\$")


def comparable(c: Column | str) -> Column:
    """Text for overlap tests: no citations, markup, formulas or ligatures."""
    t = F.lower(F.col(c) if isinstance(c, str) else c)
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, r"\$[^$]*\$|<[^>]*>|\[[0-9,; –-]+\]|[*_`#]", " "), r"[^\p{L}\p{N}]+", " ")
    return F.trim(t)


def page_layout(clusters: DataFrame) -> DataFrame:
    """Columns and regime of each page, from its clusters of x centres (see blocks.gap_clusters)."""
    n = clusters.filter("n >= 2").groupBy("page").agg(F.count("*").alias("columns"))
    return n.withColumn("regime", F.when(F.col("columns") >= 3, "multi_column").when(F.col("columns") == 2, "two_column").otherwise("single_column"))


def usable_content(role: Column, top: Column, bottom: Column, header: Column, footer: Column) -> Column:
    """Whether a block lies between the header and footer bands; references and backmatter headings always count."""
    inside = (header.isNull() | (bottom > header)) & (footer.isNull() | (top < footer))
    return role.isin(*REFERENCE_ROLES, "reference_body", "backmatter_heading", "backmatter_boundary_heading") | inside


def merge_headings(blocks: DataFrame) -> DataFrame:
    """Consecutive headings of a page with a small gap, taken in pairs from the start of each run: the second goes into the first."""
    page = Window.partitionBy("paper_id", "page").orderBy("ord")
    close = (F.col("role") == "section_heading") & (F.lag("role").over(page) == "section_heading") & (F.get("bbox", F.lit(1)) - F.get(F.lag("bbox").over(page), F.lit(3)) <= 30)
    run = F.sum(F.when(F.coalesce(close, F.lit(False)), 0).otherwise(1)).over(page)
    rows = blocks.withColumn("_run", run).withColumn("_at", F.row_number().over(Window.partitionBy("paper_id", "page", "_run").orderBy("ord")) - 1)
    pair = rows.withColumn("_pair", F.floor(F.col("_at") / 2))
    w = Window.partitionBy("paper_id", "page", "_run", "_pair").orderBy("ord")
    joined = F.when(F.lead("ord").over(w).isNotNull(), F.concat_ws(" ", "text", F.lead("text").over(w))).otherwise(F.col("text"))
    return pair.withColumn("text", joined).filter("_at % 2 = 0").drop("_run", "_at", "_pair")


def resolve_metadata(source: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """Per paper and field: the bibliography's value, else the document's, and where it is from."""
    s = source.select("paper_id", *[F.nullif(F.trim(f), F.lit("")).alias(f"s_{f}") for f in fields])
    o = found.select("paper_id", *[F.nullif(F.trim(f), F.lit("")).alias(f"o_{f}") for f in fields])
    origin = lambda f: F.when(F.col(f"s_{f}").isNotNull() & F.col(f"o_{f}").isNotNull(), F.when(tx.folded_title(f"s_{f}") == tx.folded_title(f"o_{f}"), "both").otherwise("source_over_document")).when(F.col(f"s_{f}").isNotNull(), "source").when(F.col(f"o_{f}").isNotNull(), "document")
    return s.join(o, "paper_id", "full_outer").select("paper_id", *[c for f in fields for c in (F.coalesce(f"s_{f}", f"o_{f}").alias(f), origin(f).alias(f"{f}_from"))])


def render_audit(inventory: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Inventory entries and rendered artifacts that miss each other or differ in digest."""
    a = inventory.select(*keys, F.col("digest").alias("expected"))
    b = artifacts.select(*keys, F.col("digest").alias("rendered"))
    issue = F.when(F.col("rendered").isNull(), "not_rendered").when(F.col("expected").isNull(), "not_in_inventory").when(F.col("expected") != F.col("rendered"), "stale")
    return a.join(b, keys, "full_outer").withColumn("issue", issue).filter("issue is not null")


def reconcile_figures(census: DataFrame, figures: DataFrame, media: DataFrame) -> DataFrame:
    """Per paper and number: whether the text mentions it, a figure has it, media exist for it; incomplete ones only."""
    tag = lambda df, c: df.select("paper_id", "number").distinct().withColumn(c, F.lit(True))
    j = tag(census, "in_text").join(tag(figures, "as_figure"), ["paper_id", "number"], "full_outer").join(tag(media, "has_media"), ["paper_id", "number"], "full_outer")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("in_text", "as_figure", "has_media")]
    return j.select("paper_id", "number", *flags).filter("not (in_text and as_figure and has_media)")


def suppress_ghosts(figures: DataFrame) -> DataFrame:
    """Figures without assets go where another figure of the paper with the same number has some."""
    owned = F.max("n_assets").over(Window.partitionBy("paper_id", "number")) > 0
    return figures.withColumn("_owned", owned).filter((F.col("n_assets") > 0) | ~F.col("_owned")).drop("_owned")


def author_bios(blocks: DataFrame) -> DataFrame:
    """Blocks that read like an author's biography, by five signs."""
    low = F.lower("text")
    signs = [low.rlike(r"received (?:his|her|their|the) .{0,40}degree"), low.rlike(r"(?:professor|lecturer|researcher|student) (?:at|in|of)"), low.rlike(r"research interests"), low.rlike(r"(?:born|graduated) in"), F.length("text").between(150, 2000)]
    total = F.lit(0)
    for s in signs:
        total = total + s.cast("int")
    return blocks.withColumn("bio_score", total)


def replayed_pubmed(xml: DataFrame, column: str) -> DataFrame:
    """(pmid, doi, abstract) of replayed PubmedArticle elements, labelled abstract parts on lines of their own."""
    labels = F.xpath(column, F.lit("//Abstract/AbstractText/@Label"))
    parts = F.xpath(column, F.lit("//Abstract/AbstractText/text()"))
    labelled = F.transform(parts, lambda p, i: F.when(F.size(labels) == F.size(parts), F.concat_ws(": ", F.get(labels, i), p)).otherwise(p))
    return xml.select(F.xpath_string(column, F.lit("//PMID")).alias("pmid"), F.lower(F.xpath_string(column, F.lit("//ArticleId[@IdType='doi']"))).alias("doi"), F.array_join(labelled, "\n").alias("abstract"))
