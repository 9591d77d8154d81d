"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch while a table is written to the shared folder.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever else the table has (names that differ only in case included)."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select([F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def held_out(doc_id: Column | str, parts: int, rest: int) -> Column:
    """crc32 of the id's decimal text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), "UTF-8")) % parts == rest, F.lit(False))


class Workspace:
    """Tables written to the folder that spark.checkpoint.dir names, which driver and executors share.

    Reading a written table back cuts the lineage and survives the loss of an executor.
    Where the setting is unset, a folder beside the warehouse is used if all runs in one process, as in tests; on a
    cluster that is an error, as executors might write to disks of their own.
    """

    made: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-work"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.made.append(self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back. Rows go to Python in batches of BATCH_ROWS meanwhile, which bounds its memory."""
        path, key = f"{self.root}/{name}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(BATCH_ROWS))
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_workspaces(spark: SparkSession) -> None:
    """Delete what this process has written to workspaces; results that still read it are gone with it."""
    while Workspace.made:
        _delete(spark, Workspace.made.pop())


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], count: str, least: int = 1000) -> DataFrame:
    """The inner join of many with one, which has each key once and, in the column `count`, how many rows of many have it.

    Keys with more rows than an eighth of a task's share (and than `least`) are few, at most eight for each task: their
    rows are joined by broadcast, where they lie, instead of meeting in one task. many is read twice if there are such
    keys, so it should be a written table.
    """
    spark = many.sparkSession
    s = one.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    limit = max(least, (s.total or 0) // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if (s.most or 0) <= limit:
        return many.join(one, keys)
    hot = one.filter(F.col(count) > limit)
    rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one.filter(F.col(count) <= limit), keys)
    return many.join(F.broadcast(hot), keys).unionByName(rest)


# ---- texts of an Arrow batch as bytes ----


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many rows, with about limit bytes each."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(i + rows, j, n)
        yield i, j
        i = j


def spaced(raw: np.ndarray, off: np.ndarray, i: int, j: int, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows i to j in one array with gap spaces after each, and where each begins."""
    size = np.diff(off[i : j + 1])
    begin = np.concatenate([[0], np.cumsum(size + gap)])
    out = np.full(int(begin[-1]), 32, np.uint8)
    for k in range(j - i):
        out[begin[k] : begin[k] + size[k]] = raw[off[i + k] : off[i + k + 1]]
    return out, begin


# ---- words ----

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * CHUNK_BYTES)
            base = 0x5851F42D4C957F2D
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
                cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _inverse(base), np.uint64)]))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def lowered(word_byte: np.ndarray) -> np.ndarray:
    """Byte table: 0 outside words, else one more than the byte with A-Z lower-cased."""
    t = np.arange(1, 257, dtype=np.uint16)
    t[65:91] += 32
    t[~word_byte] = 0
    return t


def not_space() -> np.ndarray:
    """Bytes of words that end at \\x20 and \\x09 to \\x0D."""
    t = np.ones(256, bool)
    t[[9, 10, 11, 12, 13, 32]] = False
    return t


def letters_digits() -> np.ndarray:
    """Bytes of words made of 0-9, A-Z, a-z and whatever lies beyond ASCII."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


def words(buf: np.ndarray, begin: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the first word of each row (with the total at the end).

    A word's hash depends on its lower-cased bytes and length alone.
    """
    b = low[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], b != 0, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _Powers.upto(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(b * up[: len(buf)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        h = mix(h + (end - start).astype(np.uint64) * _ODD)
    return h, np.searchsorted(start, begin)
