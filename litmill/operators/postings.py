"""A full-text index on disk: postings and term statistics, bucketed by term, so that a query reads its own terms' buckets alone.

An index belongs to the files it was made from: its folder is named by their paths, sizes and times, so that changed
tables get a new one. It is published in one step; a query that opened it keeps it. Within a bucket rows are sorted by
term, so row groups of other terms are skipped. A common term's postings are written by SPREAD tasks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import text as tx
from litmill.operators.search import IDF_FLOOR, K1, B
from litmill.sources.store import Store

BUCKETS, SPREAD = 64, 8
#: Of what an index holds; raised when that changes.
VERSION = 1


def _bucket(token: str) -> F.Column:
    return F.pmod(F.crc32(F.encode(token, "UTF-8")), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, key: str, indexed: list[str]) -> DataFrame:
    """(key, token, tf, dl, bucket): how often each term stands in each row, of dl terms."""
    tokens = rows.select(F.col(key).alias("key"), tx.fts_tokens(F.concat_ws(" ", *[F.col(c).cast("string") for c in indexed])).alias("t"))
    each = tokens.select("key", F.size("t").alias("dl"), F.explode("t").alias("token"))
    return each.groupBy("key", "dl", "token").agg(F.count("*").cast("int").alias("tf")).withColumn("bucket", _bucket("token"))


class TextIndex:
    """An index of rows in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.postings, self.terms = Store(spark, f"{folder}/postings"), Store(spark, f"{folder}/terms")

    def build(self, rows: DataFrame, key: str, indexed: list[str]) -> None:
        p = postings(rows, key, indexed)
        dealt = p.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPREAD))).sortWithinPartitions("bucket", "token")
        at = self.postings.publish(dealt, by=["bucket"])
        found = self.spark.read.schema(dealt.schema).parquet(at)
        size = rows.agg(F.count("*").alias("n")).crossJoin(found.agg(F.sum("tf").alias("total")))  # one row each
        terms = found.groupBy("bucket", "token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size.select("n", (F.col("total") / F.col("n")).alias("avgdl"))))
        self.terms.publish(terms.repartition("bucket").sortWithinPartitions("bucket", "token"), by=["bucket"])

    def ready(self) -> bool:
        return self.terms.current() is not None

    def _read(self, store: Store, schema: str, tokens: list[str]) -> DataFrame:
        at = store.current()
        wanted = sorted({_crc_bucket(t) for t in tokens})
        have = [f"{at}/bucket={b}" for b in wanted if store.exists(f"{at}/bucket={b}")]
        none = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*have).filter(F.col("token").isin(tokens)) if have else none

    def search(self, tokens: list[str], mode: str = "or", key: str = "string") -> DataFrame:
        """(key, score) of the rows with any or all of the terms, scored as in search.bm25."""
        p = self._read(self.postings, f"key {key}, dl int, token string, tf int", tokens)
        t = F.broadcast(self._read(self.terms, "token string, df long, n long, avgdl double", tokens))  # a row for each term
        idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        found = p.join(t, "token").groupBy("key").agg(F.sum(part).alias("score"), F.count("*").alias("_n"))
        return (found.filter(F.col("_n") == len(tokens)) if mode == "and" else found).drop("_n")


def _crc_bucket(token: str) -> int:
    import zlib

    return zlib.crc32(token.encode()) % BUCKETS


def index_of(spark: SparkSession, files: list[str], rows: DataFrame, key: str, indexed: list[str]) -> TextIndex:
    """The index of rows that come from these files, built if there is none yet."""
    signs = []
    for f in sorted(files):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        signs.append(f"{f}|{s.getLen()}|{s.getModificationTime()}")
    name = hashlib.sha256("\n".join([str(VERSION), key, *indexed, *signs]).encode()).hexdigest()[:24]
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-work"
    index = TextIndex(spark, f"{base.rstrip('/')}/text-index/{name}")
    if not index.ready():
        index.build(rows, key, indexed)
    return index
