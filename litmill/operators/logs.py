"""Append-only logs: validated appends, reading since a time, enrichment, corrections, grouped reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def since(log: DataFrame, stamp: str, key: str, since_: str = "", limit: int = 50) -> DataFrame:
    """Newest first, from a time on (compared as written), at most limit."""
    rows = log.filter(F.col(stamp) >= since_) if since_ else log
    return rows.orderBy(F.desc(stamp), key).limit(limit)


def valid_entries(log: DataFrame, required: list[str]) -> DataFrame:
    """Entries whose required fields aren't blank."""
    for c in required:
        log = log.filter(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return log


def with_ids(log: DataFrame, prefix: str, stamp: str, parts: list[str]) -> DataFrame:
    """Entries with an id of prefix, date and the first digits of a digest of their content."""
    return log.withColumn("id", F.concat_ws("_", F.lit(prefix), F.date_format(stamp, "yyyyMMdd"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 8)))


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def enriched(log: DataFrame, papers: DataFrame, on: str, paper_on: str, label: str) -> DataFrame:
    """Entries with their paper's label, the key itself where the paper is unknown."""
    p = papers.select(F.col(paper_on).alias(on), F.col(label).alias("label"))
    return log.join(p, on, "left").withColumn("label", F.coalesce("label", F.col(on).cast("string")))


def latest_corrections(log: DataFrame, original: str, stamp: str, key: str) -> DataFrame:
    """The newest correction of each original entry."""
    w = Window.partitionBy(original).orderBy(F.desc(stamp), F.desc(key))
    return log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def render_grouped(log: DataFrame, group: str, order: list[str], line: F.Column) -> DataFrame:
    """Per group: its entries as lines in order. A group is one paper's or one conversation's entries."""
    return log.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n").alias("body"), F.count("*").alias("n"))


def existing_only(log: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """Entries whose paper exists, as a declared foreign key demands."""
    return log.join(papers.select(key).distinct(), key, "left_semi")
