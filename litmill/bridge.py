"""The reference tables expressed over the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """One paper for each document; its states come from labels and remainders of its id."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = d.join(q, "doc_id", "left")
    i = F.col("doc_id")
    year = F.when(i % 6 == 0, "").when(i % 6 == 1, F.lit(None)).when(i % 6 == 2, "n.d.").when(i % 6 == 3, F.concat((F.lit(1990) + i % 35).cast("string"), F.lit("-03"))).otherwise((F.lit(1990) + i % 35).cast("string"))
    ocr = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed").when(i % 4 == 0, "processing").otherwise("pending")
    deep = F.when((F.col("quality") == 1) & (i % 3 == 0), "done").otherwise("pending")
    cols = [
        i.alias("paper_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("domain"), F.col("source").alias("first_author"), year.alias("year"),
        (F.col("n_chars") >= 700).alias("has_pdf"), F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("pdf/"), i.cast("string"))).alias("pdf_path"), ocr.alias("ocr_status"), deep.alias("deep_status"),
        F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("notes/"), i.cast("string"))).alias("note_path"), F.when(F.col("quality") == 1, F.concat(F.lit("text/"), i.cast("string"))).otherwise("").alias("fulltext_path"),
        F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("notes/"), i.cast("string"))).alias("main_note_path"), F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("ai/"), i.cast("string"))).alias("ai_path"), F.col("n_chars"), F.col("toxic"), F.col("quality"),
    ]
    return p.select(*cols, *([F.col("text")] if text else []))


#: The same for DuckDB.
PAPERS_SQL = """papers as (
  select d.doc_id as paper_id, split_part(text, chr(10), 1) as title, lang as domain, source as first_author,
    case d.doc_id % 6 when 0 then '' when 1 then null when 2 then 'n.d.' when 3 then (1990 + d.doc_id % 35)::varchar || '-03' else (1990 + d.doc_id % 35)::varchar end as year,
    n_chars >= 700 as has_pdf, case when d.doc_id % 11 = 0 then '' else 'pdf/' || d.doc_id end as pdf_path,
    case when quality = 1 then 'done' when quality = 0 then 'failed' when d.doc_id % 4 = 0 then 'processing' else 'pending' end as ocr_status,
    case when quality = 1 and d.doc_id % 3 = 0 then 'done' else 'pending' end as deep_status,
    case when d.doc_id % 7 = 0 then '' else 'notes/' || d.doc_id end as note_path,
    case when quality = 1 then 'text/' || d.doc_id else '' end as fulltext_path,
    case when d.doc_id % 7 = 0 then '' else 'notes/' || d.doc_id end as main_note_path,
    case when d.doc_id % 13 = 0 then '' else 'ai/' || d.doc_id end as ai_path, n_chars, toxic, quality, text
  from documents d left join labels using (doc_id))"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body units: one for each line of a document with a word."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("part", "unit_text"))
    d = d.filter(F.trim("unit_text") != "")
    return d.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("body"), F.col("part").cast("string")).alias("unit_id"), F.col("doc_id").alias("paper_id"), F.col("source").alias("section_path"), F.col("part").cast("long").alias("part"), "unit_text")


UNITS_SQL = """units as (
  select doc_id::varchar || ':body:' || (i - 1)::varchar as unit_id, doc_id as paper_id, source as section_path, (i - 1)::bigint as part, parts[i] as unit_text
  from (select doc_id, source, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, source, string_split(text, chr(10)) as parts from documents))
  where trim(parts[i], ' ') <> '')"""
