"""Line dedup: a suffix array over line ids by distributed prefix doubling, and its common-prefix intervals.

Lines with a word get ids; a line that occurs once ends every run. Suffixes at the other lines are ranked by
their first 1, 2, 4, ... lines: each doubling ranks the pairs of two neighbouring ranks in one range sort, and
suffixes whose rank is unique drop out. A run is reported from `min_words` words on. Every such run is covered
by its shortest stretches of that many words, read forwards or backwards, so the interval of the suffixes that
share such a stretch (two overlapping ranks name it exactly) shows all its copies. All but the earliest copy,
in the order of doc_id and line, lose these lines; together that deletes exactly the lines inside later copies
of maximal repeated runs. As each line has a word, min_words bounds a stretch's lines and so the
number of doublings.

Ranks are written to the shared folder after each doubling. Counts are pre-aggregated before every shuffle, and the one
row that a very common line, pair or stretch has is broadcast to its occurrences, which don't meet in one task. The array
is sorted as far as an interval's runs reach min_words: a deeper interval lies within one that is known, so it would
delete nothing more.

Defined cases: null and empty texts have no line and stay as they are; lines without a word never take part and
go only when they lie inside a deleted run; rows with equal doc_id and text are one document, so they are treated
alike and not deduplicated against each other; null doc_ids come last; overlapping copies within a document count
(of a line repeated many times the first stays); a very long text's lines are held by one task; an empty table gives no
rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Workspace, chunks, flat, join_hot, lowered, mix, not_space, pick, spaced, words

MIN_WORDS = 50
UNIT = ["doc_id", "text_hash"]


def _not_newline() -> np.ndarray:
    t = np.arange(1, 257, dtype=np.uint16)
    t[10] = 0
    return t


def line_ids(texts: DataFrame) -> DataFrame:
    """Per text: arrays of line number, 128-bit id and words of the lines that have a word."""
    low, whole = lowered(not_space()), _not_newline()
    kinds = [pa.list_(k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat(batch.column(2))
            for i, j in chunks(off):
                out: list[list] = [[], [], [], []]
                buf, begin = spaced(raw, off, i, j)
                buf[begin[1:] - 1] = 10
                word, _ = words(buf, begin, low)
                is_word = (low[buf] != 0).view(np.int8)
                word_at = np.flatnonzero(np.diff(np.concatenate([[0], is_word])) == 1)
                line, _ = words(buf, begin, whole)
                text = (whole[buf] != 0).view(np.int8)
                line_at = np.flatnonzero(np.diff(np.concatenate([[0], text])) == 1)
                first = np.searchsorted(word_at, np.append(line_at, len(buf)))
                count = np.diff(first)
                good = np.flatnonzero(count)
                with np.errstate(over="ignore"):
                    placed = mix(word + np.arange(len(word), dtype=np.uint64) - np.repeat(first[:-1], count).astype(np.uint64))
                    other = np.add.reduceat(placed, first[good]) if len(good) else placed[:0]
                newlines = np.flatnonzero(buf == 10)
                row_of = np.searchsorted(begin, line_at[good], "right") - 1
                number = np.searchsorted(newlines, line_at[good]) - np.searchsorted(newlines, begin[row_of])
                cut = np.searchsorted(row_of, np.arange(j - i + 1))
                values = (number, line[good].view(np.int64), other.view(np.int64), count[good])
                for a, b in zip(cut[:-1], cut[1:]):
                    for c, v in zip(out, values):
                        c.append(v[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=["doc_id", "text_hash", "p", "h", "g", "w"])

    return texts.mapInArrow(run, "doc_id long, text_hash long, p array<int>, h array<long>, g array<long>, w array<int>")


def _ranked(keys: DataFrame) -> DataFrame:
    """Keys (a, b) with ranks from 1 in their order."""
    return keys.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id() + 1)


def _stretches(ranks: DataFrame, levels: int, min_words: int) -> DataFrame:
    """The shortest stretches of min_words words that begin or end at each line, named by length and two ranks."""
    names = ["m", "a", "b", *UNIT, "i", "p0", "p1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for d, t, lines, *rank in zip(*[batch.column(c).to_pylist() for c in range(batch.num_columns)]):
                i = np.array([x["i"] for x in lines])
                p = [x["p"] for x in lines]
                total = np.concatenate([[0], np.cumsum([x["w"] for x in lines])])
                end = np.searchsorted(total, total[:-1] + min_words)  # exclusive
                start = np.searchsorted(total, total[1:] - min_words, "right") - 1
                found = {(s, e) for s, e in enumerate(end.tolist()) if e <= len(i)} | {(s, e + 1) for e, s in enumerate(start.tolist()) if s >= 0}
                for s, e in found:
                    m = e - s
                    if i[e - 1] - i[s] != m - 1:
                        continue
                    k = m.bit_length() - 1
                    if k < levels and (a := rank[k][s]) and (b := rank[k][e - (1 << k)]):
                        rows.append((m, a, b, d, t, int(i[s]), p[s], p[e - 1]))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    return ranks.mapInArrow(run, "m int, a long, b long, doc_id long, text_hash long, i int, p0 int, p1 int")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, Workspace]:
    """(doc_id, text_hash, spans of line numbers to delete) of the documents that lose lines."""
    work = Workspace(docs.sparkSession, "lines")
    texts = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    ids = work.keep(line_ids(texts), "ids")
    zipped = F.arrays_zip("p", "h", "g", "w")
    lines = ids.dropDuplicates(UNIT) if not ids.groupBy(*UNIT).count().filter("count > 1").isEmpty() else ids
    lines = lines.select(*UNIT, F.posexplode(zipped).alias("i", "x")).select(*UNIT, "i", "x.p", "x.w", F.col("x.h").alias("a"), F.col("x.g").alias("b"))
    ranks = work.keep(_ranked(lines.groupBy("a", "b").count().filter("count > 1")), "ranks0")
    line = F.struct("i", "p", "w", F.col("rank").alias("r"))
    runs = join_hot(lines, ranks, ["a", "b"], "count").groupBy(*UNIT).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    runs = work.keep(runs.select(*UNIT, F.transform("lines", lambda x: F.struct(x.i.alias("i"), x.p.alias("p"), x.w.alias("w"))).alias("lines"), F.col("lines.r").alias("r0")), "runs0")

    levels = 1
    while (1 << levels) <= min_words:
        step, r = 1 << (levels - 1), f"r{levels - 1}"
        pair = F.transform(r, lambda x, j: F.when((x > 0) & (F.get("lines", j + step).i == F.get("lines", j).i + step) & (F.get(r, j + step) > 0), F.struct(j.alias("j"), x.alias("a"), F.get(r, j + step).alias("b"))))  # noqa: B023
        pairs = work.keep(runs.select(*UNIT, F.explode(F.array_compact(pair)).alias("x")).select(*UNIT, "x.*"), f"pairs{levels}")
        ranks = work.keep(_ranked(pairs.groupBy("a", "b").count().filter("count > 1")), f"ranks{levels}")
        if ranks.isEmpty():
            break
        placed = join_hot(pairs, ranks, ["a", "b"], "count").groupBy(*[F.col(c).alias(f"_{c}") for c in UNIT]).agg(F.map_from_entries(F.collect_list(F.struct("j", "rank"))).alias("placed"))
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("text_hash").eqNullSafe(F.col("_text_hash"))
        ranks_k = F.transform(r, lambda x, j: F.coalesce(F.try_element_at("placed", j), F.lit(0).cast("long")))
        runs = work.keep(runs.join(placed, same, "left").select(*runs.columns, ranks_k.alias(f"r{levels}")), f"runs{levels}")
        work.drop(f"pairs{levels}", f"runs{levels - 1}")
        levels += 1

    found = work.keep(_stretches(runs.select(*UNIT, "lines", *[f"r{k}" for k in range(levels)]), levels, min_words), "stretches")
    seat = F.struct(F.col("doc_id").isNull().alias("none"), *UNIT, "i")
    earliest = work.keep(found.groupBy("m", "a", "b").agg(F.min(seat).alias("first"), F.count("*").alias("n")).filter("n > 1"), "intervals")
    later = join_hot(found, earliest, ["m", "a", "b"], "n").filter(~F.col("first").eqNullSafe(seat))
    spans = work.keep(later.groupBy(*UNIT).agg(F.collect_set(F.struct("p0", "p1")).alias("spans")), "spans")
    work.drop("ids", "stretches", "intervals", *[f"{t}{k}" for t in ("ranks", "runs", "pairs") for k in range(levels + 1)])
    return spans, work


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs as c0, c1, ... with their lines before and after: _lines, _left (null where nothing is deleted)."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    d, t = F.col(f"c{docs.columns.index('doc_id')}"), F.col(f"c{docs.columns.index('text')}")
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "spans")
    # the same join at every size, so that what it moves follows the input
    joined = plain.join(spans.hint("merge"), d.eqNullSafe(F.col("_d")) & (F.xxhash64(t) == F.col("_t")), "left")
    all_ = F.sequence(F.lit(0), F.size("_lines") - 1)
    gone = F.flatten(F.transform("spans", lambda s: F.sequence(s.p0, s.p1)))
    left = F.transform(F.array_except(all_, gone), lambda k: F.get("_lines", k))
    return joined.withColumn("_lines", F.split(t, "\n", -1)).withColumn("_left", F.when(F.col("spans").isNotNull(), left))


def _emptied(lines: str) -> F.Column:
    return ~F.coalesce(F.exists(lines, lambda x: x.rlike(r"[^ \t-\r]")), F.lit(True))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, of every row."""
    spans, _ = repeated(docs, min_words)
    out = _cut(pick(docs, "doc_id", "text"), spans)
    n = F.when(F.col("c1").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return out.select(F.col("c0").alias("doc_id"), n.alias("n_lines"), F.coalesce(n - F.size("_left"), F.lit(0)).alias("n_removed"), F.coalesce(F.array_join("_left", "\n"), F.col("c1")).alias("text"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with deleted lines cut out (n_chars counted anew); a document all of whose words were in later copies goes."""
    spans, _ = repeated(docs, min_words)
    out = _cut(docs, spans).filter(~_emptied("_left"))
    text = F.coalesce(F.array_join("_left", "\n"), F.col(f"c{docs.columns.index('text')}"))
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    at["text"] = text
    if "n_chars" in at:
        at["n_chars"] = F.when(F.col("_left").isNull(), at["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[c.alias(n) for n, c in at.items()])
