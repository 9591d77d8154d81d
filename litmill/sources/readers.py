"""Sources and sinks: bibliography exports, index envelopes, line-delimited logs, candidate tables, notes, block results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import text as tx

ITEM = """key string, itemKey string, itemID long, itemType string, title string, date string,
  creators array<struct<creatorType:string,firstName:string,lastName:string,name:string>>, publicationTitle string, DOI string, PMID string,
  abstractNote string, citationKey string, extra string, attachments array<struct<path:string,contentType:string,title:string,size:long>>, collections array<string>"""
EXPORT = f"items array<struct<{ITEM.replace(' string', ':string').replace(' long', ':long').replace(' array', ':array')}>>, collections map<string,struct<name:string,parent:string,items:array<string>>>, _corrupt_record string"
NOT_ITEMS = ("attachment", "note", "annotation")
READING_LOG = "id string, created_at string, paper_id string, section string, excerpt string, usage string, context string, note string, project string, tags array<string>, agent string, verified boolean"
PROJECT_LOG = "id string, created_at string, project string, date string, type string, title string, decisions array<string>, detours array<string>, reusable array<string>, todos array<string>, related_papers array<string>, tags array<string>, agent string"
CORRECTION_LOG = "id string, event_type string, created_at string, paper_id string, original_id string, correction string, reason string, agent string"
BLOCK = "paper_id string, page int, block_id string, raw_label string, raw_order int, bbox array<double>, text string, page_width double, page_height double, role string, role_confidence double, evidence array<string>, render_default boolean, index_default boolean"


def exports(spark: SparkSession, path: str) -> DataFrame:
    """Export files of a folder, one row each, with their domain (the file's stem); files that can't be parsed have _corrupt_record."""
    df = spark.read.schema(EXPORT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*.json").json(path)
    return df.withColumn("file", F.col("_metadata.file_name")).withColumn("domain", F.regexp_extract("file", r"([^/]+)\.json$", 1))


def export_items(files: DataFrame) -> DataFrame:
    """The bibliographic items of exports with year, authors, citation key and collections."""
    rows = files.filter("_corrupt_record is null").select("domain", "file", F.posexplode("items").alias("pos", "item"))
    i = F.col("item")
    cite = F.coalesce(F.nullif(i.citationKey, F.lit("")), F.nullif(F.regexp_extract(i.extra, r"(?im)^\s*citation key:\s*(.*?)\s*$", 1), F.lit("")), F.lit(""))
    return rows.filter(~i.itemType.isin(*NOT_ITEMS)).select(
        "domain", "file", "pos", F.coalesce(i.key, i.itemKey).alias("key"), i.title.alias("title"), tx.year(F.coalesce(i.date, F.lit(""))).alias("year"), i.DOI.alias("doi"), i.PMID.alias("pmid"),
        i.publicationTitle.alias("journal"), tx.authors(i.creators).alias("authors"), cite.alias("citation_key"), i.attachments.alias("attachments"), i.collections.alias("collection_keys"), i.abstractNote.alias("abstract"),
    )


def collection_nodes(files: DataFrame) -> DataFrame:
    """(domain, key, parent, name) of the exports' collections."""
    return files.select("domain", F.explode("collections").alias("key", "c")).select("domain", "key", F.nullif("c.parent", F.lit("")).alias("parent"), F.col("c.name").alias("name"))


def pdf_attachments(items: DataFrame) -> DataFrame:
    return items.select("key", F.posexplode("attachments").alias("ord", "a")).filter("a.contentType = 'application/pdf'").select("key", "ord", "a.title", "a.size", tx.attachment_path(F.col("a.path")).alias("path"))


def envelope(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a versioned index file {schema_version, items: [...]}, with its version."""
    df = spark.read.schema(f"schema_version string, export_hash string, items array<struct<{schema}>>").option("multiLine", True).json(path)
    return df.select("schema_version", "export_hash", F.explode("items").alias("item")).select("schema_version", "export_hash", "item.*")


def build_envelope(items: DataFrame, version: str, export_hash: str = "") -> DataFrame:
    """One row that describes an index; its items stay a table beside it."""
    return items.agg(F.lit(version).alias("schema_version"), F.count("*").alias("paper_count"), F.lit(export_hash).alias("export_hash"))


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A line-delimited log; malformed lines are dropped, or fail the read if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def harvest(spark: SparkSession, path: str, files: str = "*-candidates.csv") -> DataFrame:
    """Candidate tables below a folder; inherited values are blank, a missing source is filled in."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", files).csv(path)
    for c in df.columns:
        df = df.withColumn(c, F.when(F.col(c) == "<inherit-from-task-context>", "").otherwise(F.coalesce(F.col(c), F.lit(""))))
    return df.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("harvest"))) if "source" in df.columns else df


def notes(spark: SparkSession, path: str, fields: list[str], files: str = "*.md") -> DataFrame:
    """Markdown notes with scalar fields of their front matter."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=files).withColumn("file", F.col("_metadata.file_path"))
    front = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---", 1)
    return df.select("file", *[F.regexp_extract(front, rf"(?m)^{f}:\s*[\"']?(.*?)[\"']?\s*$", 1).alias(f) for f in fields], F.col("value").alias("text"))


def analyze_queue(notes_: DataFrame) -> DataFrame:
    return notes_.filter("analyze = 'true'").orderBy("domain", "key")


def raw_blocks(results: DataFrame) -> DataFrame:
    """OCR results (paper_id, payload, pages: array of {width, height, blocks: array of {block_id, label, order, bbox, text}}) as one row a block.

    Pages are numbered through a paper's payloads; a missing block id is made of page and position.
    """
    from pyspark.sql import Window

    pages = results.select("paper_id", "payload", F.posexplode("pages").alias("p", "page"))
    pages = pages.withColumn("page_number", F.row_number().over(Window.partitionBy("paper_id").orderBy("payload", "p")))
    b = pages.select("paper_id", "page_number", "page.width", "page.height", F.posexplode("page.blocks").alias("i", "b"))
    made = F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("_b"), F.col("i").cast("string"))
    return b.select("paper_id", F.col("page_number").alias("page"), F.coalesce("b.block_id", made).alias("block_id"), F.col("b.label").alias("raw_label"), F.coalesce("b.order", "i").alias("raw_order"), F.col("b.bbox").alias("bbox"), F.col("b.text").alias("text"), F.col("width").alias("page_width"), F.col("height").alias("page_height"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Structured blocks without their decision log."""
    blocks.drop("_decision_log").write.mode("overwrite").json(path)


def impact_factors(rows: DataFrame, journals: DataFrame) -> DataFrame:
    """rows with their journal's impact factor from the table, else from their extra field."""
    j = journals.select(F.lower("journal").alias("_j"), F.col("impact_factor").cast("string").alias("_f")).dropDuplicates(["_j"])
    extra = F.regexp_extract(F.coalesce("extra", F.lit("")), r"影响因子[:：]\s*([0-9.]+)", 1)
    return rows.join(j, F.lower("journal") == F.col("_j"), "left").withColumn("impact_factor", F.coalesce(F.nullif("_f", F.lit("")), extra)).drop("_j", "_f")


def candidates(rows: DataFrame, adapter: str) -> DataFrame:
    """Replayed search results of one service as candidate rows."""
    v = tx.candidate_value
    maps = {
        "pubmed": {"doi": "doi", "pmid": "pmid", "title": "title", "year": "year", "journal": "journal"},
        "openalex": {"doi": "doi", "pmid": "pmid", "title": "display_name", "year": "publication_year", "journal": "venue"},
        "arxiv": {"doi": "doi", "pmid": "pmid", "title": "title", "year": "published", "journal": "journal"},
        "scholar": {"doi": "doi", "pmid": "pmid", "title": "title", "year": "year", "journal": "venue"},
    }[adapter]
    col = {k: v(F.col(c).cast("string")) if c in rows.columns else F.lit("") for k, c in maps.items()}
    col["doi"] = F.regexp_replace(col["doi"], "^https?://doi.org/", "")
    if adapter == "arxiv":
        col["year"], col["journal"] = F.substring(col["year"], 1, 4), F.coalesce(F.nullif(col["journal"], F.lit("")), F.lit("arXiv"))
    known = rows.select(*[c.alias(k) for k, c in col.items()]).withColumn("source", F.lit(adapter))
    ident = tx.candidate_id(F.col("source"), F.col("doi"), F.col("pmid"), F.col("title"), F.lit("unknown"))
    return known.withColumn("candidate_id", ident).withColumn("decision", F.lit("")).withColumn("status", F.lit("candidate")).withColumn("import_status", F.lit("pending"))
