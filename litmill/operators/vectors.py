"""Vector retrieval: exact nearest neighbours, merging, fusion with text scores, enrichment, gates."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance in double precision."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def score(distance: Column) -> Column:
    """One less the distance; negative for far vectors, never clamped."""
    return 1 - distance


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", scope: Column | None = None) -> DataFrame:
    """The k nearest vectors, nearest first, the scope filtered before the search."""
    rows = vectors if scope is None else vectors.filter(scope)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", l2("embedding", q)).orderBy("distance", id_col).limit(k)


def knn_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query (a bounded table: query_id, query), ranked per query."""
    pairs = vectors.join(F.broadcast(queries)).withColumn("distance", l2("embedding", "query"))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def merge_capped(hits: DataFrame, limit: int, per_paper: int = 2) -> DataFrame:
    """Best first: one hit for each (source, unit_id), at most per_paper for each paper, then the limit."""
    best = ["score", "source", "unit_id"]
    unit = Window.partitionBy("source", "unit_id").orderBy(F.desc("score"), "paper_id")
    paper = Window.partitionBy("paper_id").orderBy(F.desc("score"), "source", "unit_id")
    once = hits.withColumn("_u", F.row_number().over(unit)).filter("_u = 1").drop("_u")
    capped = once.withColumn("_p", F.row_number().over(paper)).filter(F.col("_p") <= per_paper).drop("_p")
    return capped.orderBy(F.desc(best[0]), *best[1:]).limit(limit)


def _norm(vec: Column) -> Column:
    return F.when(vec > 0, 1 - 1 / (1 + vec)).otherwise(0.0)


def fuse(text_hits: DataFrame, vec_hits: DataFrame, limit: int) -> DataFrame:
    """Text hits score 0.3 text + 0.7 vector where a vector hit agrees, else their text score; then object hits of the vectors.

    Without any text hit the vector hits stand alone; vector hits on body units are otherwise dropped.
    """
    vec = vec_hits.groupBy("source", "unit_id").agg(F.max("vec_score").alias("vec_score"), F.min("paper_id").alias("paper_id"))
    body = vec.filter("source = 'body'").select("unit_id", F.col("vec_score").alias("v"))
    hits = text_hits.groupBy("unit_id").agg(F.max("bm25_score").alias("bm25_score"), F.min("paper_id").alias("paper_id")).join(body, "unit_id", "left")
    first = hits.select(F.lit(0).alias("tier"), F.lit("body").alias("source"), "unit_id", "paper_id", F.coalesce("v", F.lit(0.0)).alias("vec_score"), F.when(F.col("v").isNotNull(), 0.3 * F.col("bm25_score") + 0.7 * _norm(F.col("v"))).otherwise(F.col("bm25_score")).alias("score"))
    any_text = text_hits.limit(1).select(F.lit(True).alias("any_text"))
    alone = vec.join(F.broadcast(any_text), F.lit(True), "left").filter((F.col("source") == "object") | F.col("any_text").isNull())
    second = alone.select(F.lit(1).alias("tier"), "source", "unit_id", "paper_id", "vec_score", _norm(F.col("vec_score")).alias("score"))
    return first.unionByName(second).orderBy("tier", F.desc(F.round("score", 6)), "unit_id").limit(limit)


def enrich(hits: DataFrame, body: DataFrame, objects: DataFrame, manifest: DataFrame) -> DataFrame:
    """Hits with their unit's section and text by source, their paper's manifest, and whether the unit was found."""
    of = lambda t, s: t.select("unit_id", "paper_id", F.lit(s).alias("source"), "section_path", "unit_text")
    known = of(body, "body").unionByName(of(objects, "object"))
    out = hits.join(known, ["source", "unit_id", "paper_id"], "left").join(manifest, "paper_id", "left")
    return out.withColumn("unresolved", F.col("unit_text").isNull())


def readable(hits: DataFrame, lineage: DataFrame) -> DataFrame:
    """Hits whose paper's lineage is current or incomplete; unknown papers are dropped."""
    return hits.join(lineage.filter(F.col("state").isin("current", "incomplete")).select("paper_id").distinct(), "paper_id", "left_semi")


def low_confidence(hits: DataFrame, generic: Column, by: str, order: list[Column]) -> DataFrame:
    """Per group of hits: three or more generic ones among the five best, or no score of 0.62."""
    top = hits.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_r <= 5")
    return top.groupBy(by).agg(((F.count_if(generic) >= 3) | (F.max("score") < 0.62)).alias("low"))


def valid_embedding(e: Column | str, size: int) -> Column:
    """Of the right length, without null, NaN or infinity."""
    c = F.col(e) if isinstance(e, str) else e
    return (F.size(c) == size) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def layout(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: vectors, metadata rows, metadata rows without a vector."""
    orphans = meta.join(vectors, "vec_id", "left_anti").agg(F.count("*").alias("orphans"))
    sizes = vectors.agg(F.count("*").alias("n_vectors"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"))
    return sizes.crossJoin(orphans).crossJoin(meta.agg(F.count("*").alias("n_meta")))  # one row each


def body_payload(units: DataFrame) -> DataFrame:
    return units.select(F.concat_ws(":", "paper_id", "unit_id").alias("id"), F.col("unit_text").alias("text"), F.sha2("unit_text", 256).alias("text_hash"))


def object_payload(objects: DataFrame) -> DataFrame:
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("object_label", "caption_text", "nearby_body_text")]
    return objects.select(F.concat_ws(":", "paper_id", "unit_id").alias("id"), F.concat_ws("\n", *parts).alias("text"))


def chunk_payload(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks of whole texts as they were encoded before units: an id of document and chunk index, the text and its place."""
    return chunks.select(F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_index").cast("string")).alias("id"), F.col(key).alias("paper_id"), "text", "section", "page_number", "chunk_index", "token_estimate")


def hash_embedding(text: str, size: int) -> list[float]:
    """A deterministic stand-in for an encoder: the text's SHA-256 bytes, repeated, over 255."""
    digest = hashlib.sha256(text.encode()).digest()
    return [digest[i % len(digest)] / 255 for i in range(size)]


def encode(rows: DataFrame, text: str, size: int, encoder=hash_embedding) -> DataFrame:  # noqa: ANN001
    """rows with an embedding from a plugged-in encoder, in Arrow batches."""
    @pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(x) for x in encoder(t or "", size)])

    return rows.withColumn("embedding", run(text))
