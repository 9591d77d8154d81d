"""Versioned tables: each write is a new directory, a pointer names the current one, readers keep what they opened."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """A folder of immutable versions. One driver writes; any number read."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The published version's folder: the largest published number's."""
        p, fs = self._fs(f"{self.root}/published")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        return f"{self.root}/versions/{names[-1].split('-', 1)[1]}" if names else None

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Held by one writer at a time: a file that only one can create. Raises BlockingIOError while another holds it."""
        p, fs = self._fs(f"{self.root}/writer.lock")
        if not fs.createNewFile(p):
            raise BlockingIOError(f"{self.root} is being written")
        try:
            yield
        finally:
            fs.delete(p, False)

    def read(self) -> DataFrame | None:
        at = self.current()
        return self.spark.read.parquet(at) if at else None

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def publish(self, df: DataFrame, verify=None, by: list[str] | None = None) -> str:  # noqa: ANN001
        """Write a version (in folders by these columns), check it as read back, then name it current in one atomic step."""
        name = uuid.uuid4().hex[:12]
        at = f"{self.root}/versions/{name}"
        df.write.partitionBy(*(by or [])).parquet(at)
        if verify and not verify(self.spark.read.parquet(at)):
            p, fs = self._fs(at)
            fs.delete(p, True)
            raise ValueError("the new version failed its check")
        p, fs = self._fs(f"{self.root}/published")
        n = len(fs.listStatus(p)) if fs.exists(p) else 0
        q, fs = self._fs(f"{self.root}/published/{n:012d}-{name}")
        fs.mkdirs(q)
        return at


def verify_vectors(dimension: int, expected: int):  # noqa: ANN201
    """A check for publish(): the expected number of vectors, all of one dimension and finite."""
    def run(df: DataFrame) -> bool:
        row = df.agg(F.count("*").alias("n"), F.coalesce(F.bool_and((F.size("embedding") == dimension) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))), F.lit(True)).alias("ok")).first()
        return row.n == expected and row.ok

    return run


class VectorStore:
    """Vectors with their paper and unit in versions: add, query, delete, health. Readers keep the version they opened.

    vectors: vec_id, paper_id, unit_id, embedding.
    """

    def __init__(self, spark: SparkSession, root: str, dimension: int) -> None:
        self.store, self.dimension = Store(spark, root), dimension

    def add(self, vectors: DataFrame) -> None:
        """New vectors over old ones of the same vec_id."""
        with self.store.lock():
            old = self.store.read()
            new = vectors.select("vec_id", "paper_id", "unit_id", "embedding")
            both = new if old is None else old.join(new.select("vec_id"), "vec_id", "left_anti").select(*new.columns).unionByName(new)
            self.store.publish(both)

    def delete_papers(self, papers: DataFrame) -> None:
        with self.store.lock():
            old = self.store.read()
            if old is not None:
                self.store.publish(old.join(papers.select("paper_id").distinct(), "paper_id", "left_anti").select("vec_id", "paper_id", "unit_id", "embedding"))

    def query(self, vector: list[float], k: int, scope: Column | None = None) -> DataFrame:
        """The k nearest vectors that name a unit, nearest first."""
        from litmill.operators.vectors import knn

        rows = self.store.read().filter(F.coalesce("unit_id", F.lit("")) != "")
        return knn(rows, vector, k, scope=scope)

    def capabilities(self) -> dict[str, bool]:
        return {"add": True, "query": True, "delete": True, "scoped_query": True, "exact": True}

    def health(self) -> DataFrame:
        """One row: vectors, those without a unit, and those of another dimension."""
        return self.store.read().agg(F.count("*").alias("vectors"), F.count_if(F.coalesce("unit_id", F.lit("")) == "").alias("without_unit"), F.count_if(F.size("embedding") != self.dimension).alias("misshapen"))
