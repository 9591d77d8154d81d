"""Aggregations over papers, units and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.operators import derive


def dashboard(papers: DataFrame) -> DataFrame:
    """One row: papers with and without a healthy pdf, texts done, failed and pending."""
    ocr = F.col("ocr_status")
    return papers.agg(
        F.count("*").alias("papers"), F.count_if("has_pdf").alias("pdf_healthy"), F.count_if(~F.col("has_pdf")).alias("pdf_missing"),
        F.count_if(ocr == "done").alias("ocr_done"), F.count_if(ocr.isin("pending", "processing", "queued")).alias("ocr_pending"), F.count_if(~ocr.isin("done", "pending", "processing", "queued")).alias("ocr_failed"),
    )


def agent_context(papers: DataFrame) -> DataFrame:
    """(dimension, value, n) by domain, text status and deep status, in one pass; and the total."""
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("value")) for d, c in (("total", F.lit("")), ("domain", F.col("domain")), ("lifecycle", derive.lifecycle()), ("ocr_status", F.col("ocr_status")), ("deep_status", F.col("deep_status")))])
    return papers.select(F.explode(dims).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def collection_tree(rows: DataFrame, path: str, sep: str = "|") -> DataFrame:
    """Per root segment: rows, and its distinct last segments in order."""
    parts = F.split(path, f"[{sep}]")
    return rows.groupBy(parts[0].alias("root")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(F.size(parts) > 1, F.element_at(parts, -1)))), ",").alias("subs"))


LIFECYCLES = ("indexed", "pdf_ready", "fulltext_ready", "deep_read_done")


def index_summary(papers: DataFrame) -> DataFrame:
    """(kind, value, n): lifecycle and maturity histograms with their empty classes, and healthy counts."""
    m, h = derive.maturity(), derive.health()
    state = derive.lifecycle()
    facts = F.array(
        F.struct(F.lit("lifecycle").alias("kind"), F.when(state.isin(*LIFECYCLES), state).otherwise("pdf_ready").alias("value")),
        F.struct(F.lit("maturity").alias("kind"), F.least(F.greatest(m.level, F.lit(1)), F.lit(6)).cast("string").alias("value")),
        *[F.struct(F.lit(k).alias("kind"), F.when(h[k] == "healthy", "healthy").otherwise("unhealthy").alias("value")) for k in ("pdf_health", "ocr_health", "note_health", "asset_health")],
    )
    counted = papers.select(F.explode(facts).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    seeds = [("lifecycle", s) for s in LIFECYCLES] + [("maturity", str(i)) for i in range(1, 7)] + [(k, v) for k in ("pdf_health", "ocr_health", "note_health", "asset_health") for v in ("healthy", "unhealthy")]
    seeded = papers.sparkSession.createDataFrame(seeds, "kind string, value string")
    return seeded.join(counted, ["kind", "value"], "left").select("kind", "value", F.coalesce("n", F.lit(0)).alias("n"))


def role_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("paper_id", "role").agg(F.count("*").alias("n"))


def role_index(blocks: DataFrame) -> DataFrame:
    """Per paper and role: ids of its blocks in order. A paper's blocks are bounded by its document."""
    return blocks.groupBy("paper_id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "block_id"))), lambda b: b.block_id).alias("block_ids"))


def evidence_summary(blocks: DataFrame, roles: list[str]) -> DataFrame:
    """Per paper: blocks of each role, and whether there are any."""
    counts = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles]
    return blocks.groupBy("paper_id").agg(*counts).select("*", *[(F.col(f"n_{r}") > 0).alias(f"has_{r}") for r in roles])


def profile(rows: DataFrame, by: str, size: str) -> DataFrame:
    """Mean, range and spread of a size per class, graded by how many rows there are."""
    n = F.count("*")
    return rows.groupBy(by).agg(n.alias("n"), F.round(F.avg(size), 4).alias("mean_size"), F.min(size).alias("least"), F.max(size).alias("most"), F.round(F.stddev_pop(size), 4).alias("spread"), F.when(n >= 10, "strong").when(n >= 3, "moderate").otherwise("weak").alias("grade"))


def weighted_family(profiles: DataFrame, family: Column) -> DataFrame:
    """Profiles merged into families, weighted by their rows."""
    return profiles.groupBy(family.alias("family")).agg((F.sum(F.col("mean_size") * F.col("n")) / F.sum("n")).alias("mean_size"), F.sum("n").alias("n"))


def body_anchor(blocks: DataFrame) -> DataFrame:
    """The commonest (font, size, width, x) style that stands on at least two pages; ties to the earliest page."""
    key = ["font", "size", "width", "x"]
    styles = blocks.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.min("page").alias("first_page")).filter("pages >= 2")
    return styles.orderBy(F.desc("n"), "first_page", *key).limit(1)


def span_coverage(blocks: DataFrame) -> DataFrame:
    share = F.avg(F.col("has_span").cast("double"))
    return blocks.groupBy("paper_id").agg(share.alias("coverage"), F.when(share >= 0.7, "strong").when(share >= 0.3, "moderate").otherwise("weak").alias("grade"))


def missing_numbers(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Per group: entries, the largest number, and the numbers from 1 to it that don't occur."""
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.max(number).alias("most"), F.collect_set(number).alias("seen"))
    missing = F.array_except(F.sequence(F.lit(1), F.greatest(F.col("most"), F.lit(1))), F.col("seen"))
    return g.select(group, "n", "most", F.size(missing).cast("long").alias("n_missing"), F.array_join(F.transform(missing, lambda x: x.cast("string")), ",").alias("missing"))


def figure_completeness(legends: DataFrame) -> DataFrame:
    """Per paper: numbered legends, those accounted for by the first outcome that holds, and gaps."""
    outcome = F.when(F.col("matched"), "matched").when(F.col("held"), "held").when(F.col("ambiguous"), "ambiguous").when(F.col("unmatched"), "unmatched").when(F.col("duplicate"), "deduped_duplicate").otherwise("gap")
    return legends.withColumn("outcome", outcome).groupBy("paper_id").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") != "gap").alias("accounted"), F.count_if(F.col("outcome") == "gap").alias("gaps"))


def facets(rows: DataFrame, layers: list[str]) -> DataFrame:
    """(layer, state, n) over several state columns."""
    long = rows.unpivot([], layers, "layer", "state")
    return long.groupBy("layer", "state").agg(F.count("*").alias("n"))


def flagged(rows: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """(flag, n) of boolean columns; keys stay with the rows."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in flags])).alias("x")).filter("x.on").groupBy("x.flag").agg(F.count("*").alias("n"))


def completeness_histogram(rows: DataFrame, status: Column) -> DataFrame:
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def gap_audit(segments: DataFrame, rendered: str, segment: str, by: str) -> DataFrame:
    """Segments missing from the rendered text, and the first three."""
    w = Window.partitionBy(by).orderBy("ord")
    lost = segments.filter(~F.contains(F.col(rendered), F.col(segment))).withColumn("_r", F.row_number().over(w))
    return lost.groupBy(by).agg(F.count("*").alias("gaps"), F.array_sort(F.collect_list(F.when(F.col("_r") <= 3, F.col(segment)))).alias("examples"))


def eligibility(papers: DataFrame, units: DataFrame) -> DataFrame:
    """paper_id and whether it is eligible for encoding, has no content, or isn't ready."""
    n = units.groupBy("paper_id").agg(F.count("*").alias("n_units"))
    joined = papers.join(n, "paper_id", "left")
    return joined.select("paper_id", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.when(F.col("ocr_status") != "done", "not_ready").when(F.coalesce("n_units", F.lit(0)) == 0, "no_content").otherwise("eligible").alias("state"))
