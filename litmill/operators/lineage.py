"""Content digests, manifests, and the state of each layer derived from another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICY = "units.v2"


def digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts as text, nulls as '', joined by a unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), 256)


def manifests(units: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per paper: units, and a digest over its units in order with the policy. Only unit digests are gathered, a paper's worth each."""
    rows = units.select("paper_id", "part", digest("unit_id", "section_path", "unit_text").alias("d"))
    of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x.d), "")
    return rows.groupBy("paper_id").agg(F.count("*").alias("n_units"), F.sha2(F.concat(F.lit(policy), of), 256).alias("units_hash"))


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a table whatever its row order: row digests are hashed in order within buckets by their first digits, then the buckets."""
    d = rows.select(digest(*columns).alias("d")).withColumn("b", F.substring("d", 1, 3))
    part = d.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x.h), ""), 256).alias("digest"))


def retrieval_identity(ocr: Column, policy: Column, tree: Column, body: Column, objects: Column) -> Column:
    return digest(ocr, policy, tree, body, objects)


def embedding_identity(endpoint: str, model: str, dimension: int) -> Column:
    return digest(F.lit(endpoint), F.lit(model), F.lit(dimension))


def vector_identity(retrieval: Column, embedding: Column) -> Column:
    return digest(retrieval, embedding)


def retrieval_state(ocr_state: Column, manifest_ocr: Column, current_ocr: Column, policy: Column, stored: Column, recomputed: Column, current_policy: str = POLICY) -> Column:
    """current, stale, missing, unknown or incomplete; manifest columns are null where there is no manifest."""
    return (
        F.when(ocr_state.isin("missing", "incomplete", "unknown", "stale"), ocr_state)
        .when(policy.isNull() & stored.isNull(), "missing")
        .when(stored.isNull() | recomputed.isNull(), "unknown")
        .when(~manifest_ocr.eqNullSafe(current_ocr) | (policy != current_policy) | (stored != recomputed), "stale")
        .otherwise("current")
    )


def vector_state(has_vectors: Column, retrieval: Column, derived_from: Column, current: Column, stored_embedding: Column, embedding: Column) -> Column:
    return (
        F.when(~has_vectors, "missing")
        .when(retrieval == "incomplete", "incomplete")
        .when(derived_from.isNull() | (retrieval == "unknown"), "unknown")
        .when((retrieval != "current") | (derived_from != current) | ~stored_embedding.eqNullSafe(embedding), "stale")
        .otherwise("current")
    )


def integrity(expected_n: Column, n: Column, expected_hash: Column, hash_: Column) -> Column:
    """absent, unknown, corrupt or verified snapshot of units."""
    return F.when(expected_n.isNull() & n.isNull(), "absent").when(expected_hash.isNull(), "unknown").when(~expected_n.eqNullSafe(n) | ~expected_hash.eqNullSafe(hash_), "corrupt").otherwise("verified")


def intents(rows: DataFrame) -> DataFrame:
    """(paper_id, action): at most one repair for each layer whose inputs are current. rows: paper_id, ocr, retrieval, vector, ocr_detail, vector_detail."""
    detail = F.coalesce("ocr_detail", F.lit(""))
    blocked = detail.isin("queued", "no_pdf", "blocked", "raw_not_file", "raw_permission", "blocks_not_file", "blocks_permission", "tree_not_file", "tree_permission", "role_index_not_file", "role_index_permission")
    ocr = (
        F.when(blocked & F.col("ocr").isin("missing", "incomplete"), None)
        .when((F.col("ocr") == "missing") & detail.startswith("blocks_"), "ocr.rebuild_derived")
        .when(F.col("ocr").isin("missing", "failed"), "ocr.run")
        .when((F.col("ocr") == "stale") & detail.startswith("provenance_"), "ocr.run")
        .when(F.col("ocr").isin("stale", "incomplete"), "ocr.rebuild_derived")
    )
    retrieval = F.when(F.col("retrieval").isin("stale", "missing") & (F.col("ocr") == "current"), "memory.build")
    vector = F.when(F.col("vector").isin("stale", "missing") & (F.col("retrieval") == "current") & (F.coalesce("vector_detail", F.lit("")) != "vector_no_content"), "embed.resume")
    return rows.select("paper_id", F.explode(F.array_compact(F.array(ocr, retrieval, vector))).alias("action"))


def merge_intents(rows: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(action, n_papers) after those whose digest hasn't changed since a failed attempt are left out."""
    if failed is not None:
        rows = rows.join(failed.select("paper_id", "action").distinct(), ["paper_id", "action"], "left_anti")
    return rows.groupBy("action").agg(F.countDistinct("paper_id").alias("n_papers"))


def changed(units: DataFrame, manifests_: DataFrame, policy: str = POLICY) -> DataFrame:
    """Papers whose units differ from their manifest, or were built under another policy, or have none."""
    now = manifests(units, policy).select("paper_id", F.col("units_hash").alias("_now"))
    joined = now.join(manifests_.select("paper_id", F.col("units_hash").alias("_was")), "paper_id", "full_outer")
    return joined.filter(~F.col("_now").eqNullSafe(F.col("_was"))).select("paper_id")


def version_reasons(stored: Column, expected: Column) -> Column:
    """Names of the versions that differ from what is expected, of two maps."""
    return F.array_sort(F.map_keys(F.map_filter(expected, lambda k, v: ~F.coalesce(F.try_element_at(stored, k), F.lit("")).eqNullSafe(v))))
