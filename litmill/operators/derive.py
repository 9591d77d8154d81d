"""Row derivations: lifecycle, health, maturity, next step, readiness; main attachment; collection paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING = "pending"


def _s(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def lifecycle() -> Column:
    ocr, deep = F.coalesce("ocr_status", F.lit(PENDING)), F.coalesce("deep_status", F.lit(PENDING))
    return F.when(~F.coalesce("has_pdf", F.lit(False)), "indexed").when((ocr == "done") & (deep == "done"), "deep_read_done").when(ocr == "done", "fulltext_ready").otherwise("pdf_ready")


def maturity() -> Column:
    """Level 1 to 4 (every check up to it holds), its name and the check that blocks the next."""
    pdf, text, deep = F.coalesce("has_pdf", F.lit(False)), F.coalesce("ocr_status", F.lit(PENDING)) == "done", lifecycle() == "deep_read_done"
    level = F.when(~pdf, 1).when(~text, 2).when(~deep, 3).otherwise(4)
    name = F.element_at(F.array(*[F.lit(x) for x in ("Indexed", "PDF Ready", "Fulltext Ready", "Deep Read")]), level)
    blocking = F.get(F.array(*[F.lit(x) for x in ("pdf", "fulltext", "deep_read")]), level - 1)
    return F.struct(level.alias("level"), name.alias("level_name"), blocking.alias("blocking"))


def next_step() -> Column:
    ocr, deep = F.coalesce("ocr_status", F.lit(PENDING)), F.coalesce("deep_status", F.lit(PENDING))
    return (
        F.when(ocr.isin("failed", "blocked", "done_incomplete"), "ocr")
        .when(~F.coalesce("has_pdf", F.lit(False)), "sync")
        .when(ocr.isin("pending", "nopdf"), "ocr")
        .when(ocr == "processing", "ready")
        .when((_s("note_path") == "") | (_s("fulltext_path") == "") | (_s("main_note_path") == "") | (_s("ai_path") == ""), "sync")
        .when((ocr == "done") & (deep == "pending"), "deep_read")
        .otherwise("ready")
    )


# What an OCR status means for health; wording is this engine's own.
OCR_HEALTH = {
    "done": "healthy",
    "pending": "ocr pending",
    "processing": "ocr in progress",
    "failed": "ocr failed",
    "blocked": "ocr blocked",
    "nopdf": "no pdf for ocr",
    "done_incomplete": "ocr incomplete",
}


def health() -> Column:
    """Findings on pdf, ocr, note and workspace paths; 'healthy' or what is wrong."""
    messages = F.create_map(*[F.lit(x) for pair in OCR_HEALTH.items() for x in pair])
    missing = F.array_compact(F.array(*[F.when(_s(c) == "", c) for c in ("ai_path", "fulltext_path", "main_note_path")]))
    return F.struct(
        F.when(F.coalesce("has_pdf", F.lit(False)) & (_s("pdf_path") == ""), "pdf path missing").otherwise("healthy").alias("pdf_health"),
        F.coalesce(messages[F.coalesce("ocr_status", F.lit(PENDING))], F.lit("ocr pending")).alias("ocr_health"),
        F.when(_s("note_path") == "", "note missing").otherwise("healthy").alias("note_health"),
        F.when(F.size(missing) == 0, "healthy").otherwise(F.concat(F.lit("missing paths: "), F.array_join(missing, ", "))).alias("asset_health"),
    )


def derived(papers: DataFrame) -> DataFrame:
    return papers.withColumns({"lifecycle": lifecycle(), "maturity": maturity(), "health": health(), "next_step": next_step()})


def context(papers: DataFrame) -> DataFrame:
    """What a reader may rely on for each paper, with its reasons."""
    reasons = F.array_compact(F.array(F.when(F.col("has_pdf"), "pdf available"), F.when(F.col("ocr_status") == "done", "text validated"), F.when(F.col("deep_status") == "done", "deep reading done")))
    return papers.select("paper_id", lifecycle().alias("lifecycle"), F.array_join(reasons, "; ").alias("why"))


def main_attachment(rows: DataFrame, owner: str, title: str, size: str, order: str) -> DataFrame:
    """Each owner's main attachment: the one titled PDF, else the strictly largest, else that with the shortest title; ties by order."""
    by = Window.partitionBy(owner)
    largest = F.col(size) == F.max(size).over(by)
    ranked = rows.withColumn("_big", largest & (F.coalesce(size, F.lit(0)) > 0)).withColumn("_bigs", F.count_if("_big").over(by))
    choice = by.orderBy(F.when(F.col(title) == "PDF", 0).otherwise(1), F.when(F.col("_big") & (F.col("_bigs") == 1), 0).otherwise(1), F.length(F.coalesce(title, F.lit(""))), order)
    return ranked.withColumn("_r", F.row_number().over(choice)).filter("_r = 1").drop("_big", "_bigs", "_r")


def tree_paths(spark, nodes: DataFrame, key: str, parent: str, name: str, depth: int = 32) -> DataFrame:  # noqa: ANN001
    """The 'A/B/C' path of every node of a parent-pointer tree, by a recursive query."""
    view = "litmill_tree_nodes"
    nodes.select(F.col(key).alias("k"), F.col(parent).alias("p"), F.col(name).alias("n")).createOrReplaceTempView(view)
    return spark.sql(
        f"""with recursive t(k, path, depth) max recursion level {depth} as (
              select k, cast(n as string), 1 from {view} where p is null
              union all select c.k, concat(t.path, '/', c.n), t.depth + 1 from {view} c join t on c.p = t.k)
            select k as key, path, depth from t"""
    )


def entry_of_row(rows: DataFrame, flags: list[str], lists: list[str]) -> DataFrame:
    """Stored rows as entries: 0 and 1 as booleans, columns of JSON text (name_json) as arrays (name)."""
    out = rows
    for f in flags:
        out = out.withColumn(f, F.coalesce(F.col(f), F.lit(0)) != 0)
    for c in lists:
        out = out.withColumn(c, F.coalesce(F.from_json(f"{c}_json", "array<string>"), F.array().cast("array<string>"))).drop(f"{c}_json")
    return out
