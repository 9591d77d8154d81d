"""State and health of a paper's recognised text: layers, artifacts, integrity, coverage, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def artifact_detail(*layers: Column) -> Column:
    """The first broken artifact's code, of raw, blocks, tree, consistency, role index and published hash in this order; null if none is."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in layers])


def state(exists: Column, lifecycle: Column, raw: Column, publish: Column, derived: Column) -> Column:
    """missing, a lifecycle state, a publish state or incomplete: the first layer that isn't whole; null where all are."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(~F.coalesce(exists, F.lit(False)), "missing").when(some(lifecycle), lifecycle).when(some(raw), "missing").when(some(publish), publish).when(some(derived), "incomplete")


def dangling(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Papers whose tree refers to blocks that don't exist, and how many. nodes: paper_id, keys (array); blocks: paper_id, key.

    Papers without any block are judged elsewhere.
    """
    some = blocks.select("paper_id").distinct()
    refs = nodes.join(some, "paper_id", "left_semi").select("paper_id", F.explode("keys").alias("key")).distinct()
    return refs.join(blocks.select("paper_id", "key").distinct(), ["paper_id", "key"], "left_anti").groupBy("paper_id").agg(F.count("*").alias("dangling"))


def policy_currency(policy: Column, current: str) -> Column:
    return F.when(F.coalesce(policy, F.lit("")) == "", "unknown").when(policy == current, "current").otherwise("old")


def lineage_trust(recorded: Column, identity: Column) -> Column:
    return F.when((F.coalesce(recorded, F.lit("")) == "") | identity.isNull(), "unverified").when(recorded == identity, "verified").otherwise("mismatched")


def raw_integrity(blocks: DataFrame, by: str) -> DataFrame:
    """Per paper: blocks that came without text, how many were filled from the page, and why the others weren't. blocks: status, error."""
    status, layer = F.col("status"), F.coalesce(F.col("error") == "no_pdf_text_layer", F.lit(False))
    lost = status == "missing_text_unrecovered"
    return blocks.groupBy(by).agg(
        F.count_if(status.isin("missing_text_recovered", "missing_text_unrecovered")).alias("empty_text_candidate_count"), F.count_if(status == "missing_text_recovered").alias("pdf_text_backfilled_count"),
        F.count_if(lost).alias("unrecovered_empty_text_count"), F.count_if(lost & layer).alias("no_pdf_text_layer_count"), F.count_if(lost & ~layer).alias("pdf_text_mismatch_count"),
    )


def coverage(ocr: Column, pdf: Column) -> Column:
    """struct(status, ratio): characters recognised over characters of the page's own text; low below 0.6."""
    a, b = F.length(F.trim(F.coalesce(ocr, F.lit("")))), F.length(F.trim(F.coalesce(pdf, F.lit(""))))
    ratio = F.when(b > 0, a / b)
    return F.struct(F.when(b == 0, "missing_pdf_text").when(ratio < 0.6, "low").otherwise("ok").alias("status"), ratio.alias("ratio"))


def page_coverage(blocks: DataFrame) -> DataFrame:
    """Coverage of each page of each paper, over the texts of its blocks joined by blanks. blocks: paper_id, page, ord, text, pdf_text."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim(c) != "", F.struct("ord", F.trim(c).alias("t"))))), lambda x: x.t), " ")
    pages = blocks.filter((F.col("page") > 0) & F.col("pdf_text").isNotNull()).groupBy("paper_id", "page").agg(joined("text").alias("_o"), joined("pdf_text").alias("_p"))
    c = coverage(F.col("_o"), F.col("_p"))
    return pages.select("paper_id", "page", c.status.alias("status"), F.round(c.ratio, 6).alias("ratio"))


def span_profile(spans: Column) -> Column:
    """struct of a block's styles, of its array of spans (size, font, flags, color); null without a size."""
    sizes = F.filter(F.transform(spans, lambda s: s["size"]), lambda x: x.isNotNull())
    flags = F.aggregate(spans, F.lit(0), lambda a, s: a.bitwiseOR(F.coalesce(s["flags"], F.lit(0))))
    mean = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(sizes)
    fonts = F.array_sort(F.array_distinct(F.filter(F.transform(spans, lambda s: s["font"]), lambda x: F.coalesce(x, F.lit("")) != "")))
    profile = F.struct(
        mean.alias("mean_size"), F.array_max(sizes).alias("max_size"), fonts.alias("font_families"), (flags.bitwiseAND(F.lit(16)) != 0).alias("is_bold"), (flags.bitwiseAND(F.lit(4)) != 0).alias("is_italic"),
        F.exists(spans, lambda s: F.coalesce(s["color"], F.lit(0)) != 0).alias("is_colored"),
    )
    return F.when(F.size(sizes) > 0, profile)


def backmatter_start(blocks: DataFrame) -> DataFrame:
    """Per paper the first page with a reference or backmatter heading; no row without one. blocks: paper_id, page, role."""
    sign = F.col("role").isin("reference_heading", "backmatter_heading", "backmatter_boundary_heading")
    return blocks.filter(sign).groupBy("paper_id").agg(F.min("page").alias("backmatter_start"))


def legacy(status: Column, versions: Column) -> Column:
    """Recognised before versions were recorded."""
    return (status == "done") & (F.coalesce(F.size(versions), F.lit(0)) <= 0)


def version_actions(papers: DataFrame) -> DataFrame:
    """One row: papers whose derived text is stale, and whose raw text can be made better."""
    return papers.agg(F.count_if("derived_stale").alias("derived_rebuild_count"), F.count_if("raw_upgradable").alias("raw_upgrade_count"))


def runtime_followups(papers: DataFrame, dirty: bool = False) -> DataFrame:
    """(action, paper_id, mode) of what is left to do: what can be made better from raw isn't rebuilt, and old papers are backfilled."""
    action = F.array_compact(F.array(F.when(F.col("derived_stale") & ~F.col("raw_upgradable"), "derived_rebuild"), F.when(F.col("raw_upgradable"), "raw_upgrade"), F.when(F.col("is_legacy"), "backfill")))
    mode = F.when(F.col("action") == "derived_rebuild", F.lit("suppressed_dirty_runtime" if dirty else "deferred")).otherwise("listed")
    return papers.select("paper_id", F.explode(action).alias("action")).withColumn("mode", mode)


def maintenance(papers: DataFrame, meta: DataFrame, health: DataFrame) -> DataFrame:
    """One line for each paper: title, text state, pages, health, and whether something is to be done."""
    j = papers.select("paper_id", "title", "ocr_status").join(meta, "paper_id", "left").join(health, "paper_id", "left")
    todo = F.when(F.col("ocr_status") == "failed", "retry").when((F.col("ocr_status") == "done") & (F.coalesce("overall", F.lit("unknown")) == "red"), "rebuild").when(F.col("ocr_status") == "pending", "wait").otherwise("none")
    return j.select("paper_id", "title", "ocr_status", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), F.coalesce("overall", F.lit("unknown")).alias("overall"), todo.alias("todo"))


def health(blocks: DataFrame) -> DataFrame:
    """Per paper: blocks, pages and blocks of the main roles, pages without text, and an overall colour. blocks: paper_id, page, role, text."""
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    role = lambda *r: F.count_if(F.col("role").isin(*r))
    g = blocks.groupBy("paper_id").agg(
        F.count("*").alias("blocks"), F.countDistinct("page").alias("pages"), F.countDistinct(F.when(~empty, F.col("page"))).alias("pages_with_text"), F.count_if(empty).alias("empty_blocks"),
        role("section_heading").alias("headings"), role("body_paragraph").alias("paragraphs"), role("figure").alias("figures"), role("table").alias("tables"),
    )
    share = F.col("pages_with_text") / F.col("pages")
    red = (F.col("paragraphs") == 0) | (share < 0.5)
    return g.withColumn("overall", F.when(red, "red").when((share < 1) | (F.col("headings") == 0), "yellow").otherwise("green"))


def memory_status(stored: DataFrame, index: DataFrame, version: int, stored_version: int, columns: list[str]) -> DataFrame:
    """One row: whether the stored papers are those of the index, by schema version, count and digest."""
    from litmill.operators.lineage import table_digest

    a = stored.agg(F.count("*").alias("paper_count_db")).crossJoin(table_digest(stored, columns).withColumnRenamed("digest", "_a"))
    b = index.agg(F.count("*").alias("paper_count_index")).crossJoin(table_digest(index, columns).withColumnRenamed("digest", "_b"))
    j = a.crossJoin(b)  # one row each
    ok, count, same = F.lit(version == stored_version), F.col("paper_count_db") == F.col("paper_count_index"), F.col("_a").eqNullSafe(F.col("_b"))
    return j.select("paper_count_db", "paper_count_index", ok.alias("schema_ok"), count.alias("count_match"), same.alias("hash_match"), (ok & count & same).alias("fresh"), (~(ok & count & same)).alias("needs_rebuild"))


def files_digest(files: DataFrame) -> DataFrame:
    """One digest over the bytes of files in the order of their names. files: path, content (a binaryFile scan)."""
    each = files.select("path", F.sha2("content", 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: x.d), "").cast("binary"), 256).alias("digest"))


def result_hash(artifacts: DataFrame, names: list[str]) -> DataFrame:
    """Per paper one digest over its artifacts in the order of these names; null while one is missing. artifacts: paper_id, name, digest."""
    of = [F.max(F.when(F.col("name") == n, F.col("digest"))) for n in names]
    return artifacts.groupBy("paper_id").agg(*[c.alias(f"_{i}") for i, c in enumerate(of)]).select("paper_id", F.when(F.forall(F.array(*[f"_{i}" for i in range(len(names))]), lambda x: x.isNotNull()), F.sha2(F.concat(*[f"_{i}" for i in range(len(names))]).cast("binary"), 256)).alias("result_hash"))


def progress(vectors: DataFrame, eligible: DataFrame) -> DataFrame:
    """One row: papers with body vectors against those that should have some."""
    a = vectors.agg(F.countDistinct("paper_id").alias("embedded"))
    b = eligible.agg(F.count_if(F.col("state") == "eligible").alias("eligible"))
    return a.crossJoin(b).withColumn("status", F.when(F.col("embedded") < F.col("eligible"), "interrupted").otherwise("completed"))


def dashboard_of_notes(notes: DataFrame) -> DataFrame:
    """One row of counts over notes whose fields are still text: path_error, pdf_path, ocr_status."""
    error, status = F.lower(F.trim(F.coalesce("path_error", F.lit("")))), F.lower(F.trim(F.coalesce("ocr_status", F.lit(""))))
    missing = (error == "not_found") | ((error == "") & (F.trim(F.coalesce("pdf_path", F.lit(""))) == ""))
    pending = status.isin("pending", "processing", "queued", "")
    return notes.agg(
        F.count("*").alias("papers"), F.count_if((error == "") & ~missing).alias("pdf_healthy"), F.count_if(missing).alias("pdf_missing"), F.count_if((error != "") & (error != "not_found")).alias("pdf_broken"),
        F.count_if(status == "done").alias("ocr_done"), F.count_if(pending).alias("ocr_pending"), F.count_if((status != "done") & ~pending).alias("ocr_failed"),
    )


def interleaved(blocks: DataFrame, width: float) -> DataFrame:
    """Blocks with their place when a page's columns are read one after the other, and whether that moved them. blocks: paper_id, page, ord, x, y."""
    w = Window.partitionBy("paper_id", "page").orderBy(F.when(F.col("x") < width / 2, 0).otherwise(1), "y", "x", "ord")
    was = F.row_number().over(Window.partitionBy("paper_id", "page").orderBy("ord"))
    return blocks.withColumn("place", F.row_number().over(w).cast("long")).withColumn("moved", F.col("place") != was)


def obsidian(c: Column | str) -> Column:
    """Markdown made fit for a vault: no blanks inside formula marks, single blanks, correspondence and equal-share notes as footnotes."""
    t = F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\r\n"), F.lit("\n"))
    for pattern, to in (
        (r"[ \t]+\$", r"\$"), (r"\$[ \t]+", r"\$"), (r"\$\s+\^", r"\$^"), (r"\^\{\s+", "^{"), (r"\s+\}", "}"), (r"\$\^\{ID\}\$", ""), (r"[ \t]{2,}", " "),
        (r"(?m)^(?:\*[ \t]*)?Correspondence:[ \t]*(.+)$", "[^correspondence]: $1"), (r"(?m)^†[ \t]*(.+)$", "[^equal]: $1"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return t
