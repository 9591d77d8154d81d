"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A text's distinct word shingles are hashed to a universe of UNIVERSE positions. One permutation (sigma)
breaks up structure; the other (pi) is shifted circularly by 0, 1, ... to give all signature coordinates.
A row of the window table over pi holds all shifts of one position, so a signature is one minimum over
such rows. Coordinates are cut into bands; texts that share a band are candidates.

Equal word sequences form classes first, so a group of copies, however large, is one candidate. Shingles that
only one text of a family of candidates has can't be in any intersection; counting them bounds each
text's similarity with every other, exactly, so most edited copies of one text need no comparison with
each other. In each band bucket the member with the fewest such shingles (the likely original) is
compared with the others; where this leaves a bucket in several components, its members meet across them only where
their prefixes do (rarest shingles first, with the bound that the places in both give), so texts that share no more
than what their whole family shares are never paired. All links are verified on full shingle sets. With BANDS x ROWS = 20 x 4
a pair at Jaccard 0.85 is missed with probability 4e-7, at 0.8 with 2e-5. Keys that many rows have (a class of copies,
the bucket of a family) are joined by broadcast of their one row.

Defined cases: a null text, or one without a word, has the empty set, is linked with nothing and is kept;
fewer words than a shingle are one shingle; repeated rows are a class and all carry its component_id; rows
with a null doc_id take part, but a component's id is its least id that isn't null (null if none is), and
such a row is kept only if its component has no id; a very long text is a step of its own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Workspace, chunks, flat, join_hot, lowered, mix, not_space, pick, spaced, words
from litmill.llm.components import components

BANDS, ROWS = 20, 4
UNIVERSE = 1 << 20
#: Members with one shingle in their prefixes beyond which they meet by size.
HOT = 512

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]


def _tables(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and the window table of pi: row p holds pi at p, p + 1, ... around the circle."""
    rng = np.random.default_rng(20240229)
    sigma = rng.permutation(UNIVERSE)
    pi = rng.permutation(UNIVERSE).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coordinates - 1]]), coordinates)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one text's word hashes."""
    if not len(h):
        return h
    m = min(n, len(h))
    count = len(h) - m + 1
    total = np.full(count, m, np.uint64)
    with np.errstate(over="ignore"):
        for t in range(m):
            total = mix(total + h[t : t + count] * _M[t % len(_M)])
    return np.unique(total)


def signature(s: np.ndarray, sigma: np.ndarray, window: np.ndarray) -> np.ndarray:
    at = sigma[(s >> np.uint64(20)) & np.uint64(UNIVERSE - 1)]
    out = np.full(window.shape[1], UNIVERSE, np.uint32)
    for a in range(0, len(at), 2048):
        np.minimum(out, window[at[a : a + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band, different bands' keys being unrelated."""
    parts = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for t in range(rows):
            key = mix(key * _M[t % len(_M)] + parts[:, t])
    return key.view(np.int64)


def sketches(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (of equal word sequences; null if empty), bands."""
    low = lowered(not_space())
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigma, window = _tables(bands * rows)
        for batch in batches:
            raw, off = flat(batch.column(2))
            count, cls, keys = [], [], []
            for i, j in chunks(off):
                h, first = words(*spaced(raw, off, i, j), low)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    if a == b:
                        count.append(0), cls.append(None), keys.append(None)
                        continue
                    s = shingles(h[a:b], n)
                    count.append(len(s))
                    cls.append(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest())
                    keys.append(band_keys(signature(s, sigma, window), bands, rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, kind)], names=["doc_id", "text_hash", "n_shingles", "class", "bands"])

    return texts.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class binary, bands array<long>")


def shingle_rows(texts: DataFrame, n: int) -> DataFrame:
    """(number, shingle) of every distinct shingle of each numbered text."""
    low = lowered(not_space())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat(batch.column(1))
            number = batch.column(0).to_numpy()
            for i, j in chunks(off):
                h, first = words(*spaced(raw, off, i, j), low)
                sets = [shingles(h[a:b], n) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number[i:j], [len(s) for s in sets])), pa.array(np.concatenate(sets).view(np.int64))], names=["number", "shingle"])

    return texts.mapInArrow(run, "number long, shingle long")


def shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """class and set, the distinct shingles of its text."""
    low = lowered(not_space())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat(batch.column(1))
            for i, j in chunks(off):
                h, first = words(*spaced(raw, off, i, j), low)
                sets = [shingles(h[a:b], n).view(np.int64) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))], names=["class", "set"])

    return texts.mapInArrow(run, "class binary, set array<long>")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose shingle sets have 100 * intersection >= percent * union. texts: class, text."""
    low = lowered(not_space())

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        raw, off = flat(column)
        for i, j in chunks(off):
            h, first = words(*spaced(raw, off, i, j), low)
            for a, b in zip(first[:-1], first[1:]):
                yield shingles(h[a:b], n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(sets(batch.column(2)), sets(batch.column(3))):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    of = lambda end: texts.select(F.col("class").alias(end), F.col("text").alias(f"text_{end}"))
    joined = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "text_u", "text_v")
    return joined.mapInArrow(run, "u binary, v binary")


def across(members: DataFrame, percent: int, work: Workspace, hot: int = HOT) -> DataFrame:
    """Links (u, v) between members of different roots. members: class, n (shingles), root, set.

    Shingles are ordered by how many members have them, rarest first. Two sets whose first common shingle is at place i
    of one and j of the other share at most what is left of either from there, so with A = what its remainder allows as
    the other's size, a pair can be linked only if each one's size is within the other's A; a link always passes at its
    first common shingle. Prefixes beyond which no set can be linked are not compared at all. Where more than `hot`
    members have a shingle in their prefixes, members only meet those of the sizes that they reach, and members of the
    root that is most common there don't meet each other.
    """
    rows = members.select("class", "n", F.explode("set").alias("shingle"))
    count = work.keep(rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"), "df")
    ranked = join_hot(rows, count, ["shingle"], "df").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("by"))
    place = F.expr("transform(by, (x, k) -> struct(x.shingle as shingle, n - size(by) + k as i))")
    seen = members.select("class", "n", "root").join(ranked, "class").select("class", "n", "root", F.explode(place).alias("x")).select("class", "n", "root", "x.*")
    reach = F.floor(((F.col("n") - F.col("i")) * (100 + percent) - percent * F.col("n")) / percent)
    prefix = work.keep(seen.filter((F.col("n") - F.col("i")) * 100 >= F.col("n") * percent).select("class", "n", "root", "shingle", reach.alias("reach")), "prefix")
    groups = prefix.groupBy("shingle").agg(F.count("*").alias("g"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("n").alias("least")).filter("r0 != r1")
    groups = work.keep(groups.select("shingle", "g", "least"), "groups")

    def met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        """Pairs of a smaller set from a and a greater (or equally large) one from b."""
        a = a.select(*keys, F.col("class").alias("u"), F.col("n").alias("un"), F.col("root").alias("ur"), F.col("reach").alias("ua"))
        b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("class").alias("v"), F.col("n").alias("vn"), F.col("root").alias("vr"), F.col("reach").alias("va"))
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        order = (F.col("un") < F.col("vn")) | (F.col("un") == F.col("vn")) & (F.col("u") < F.col("v"))
        return a.join(b, same & order & (F.col("ur") != F.col("vr")) & (F.col("vn") <= F.col("ua")) & (F.col("un") <= F.col("va"))).select("u", "v")

    cold = prefix.join(groups.filter(F.col("g") <= hot).select("shingle"), "shingle")
    pairs = met(cold, cold, ["shingle"])
    many = groups.filter(F.col("g") > hot)
    if not many.isEmpty():
        near = work.keep(join_hot(prefix, many, ["shingle"], "g").filter("reach >= least"), "near")
        sizes = near.groupBy("shingle").agg(F.collect_set("n").alias("sizes"), F.count("*").alias("of"))
        main = near.groupBy("shingle", "root").count().groupBy("shingle").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        near = work.keep(join_hot(near, work.keep(sizes.join(main, "shingle"), "sizes"), ["shingle"], "of"), "reached")
        meets = near.withColumn("size", F.explode(F.filter("sizes", lambda x: (x >= F.col("n")) & (x <= F.col("reach")))))
        met_by = near.withColumn("size", F.col("n"))
        pairs = pairs.unionByName(met(meets.filter("root != main"), met_by, ["shingle", "size"])).unionByName(met(meets.filter("root = main"), met_by.filter("root != main"), ["shingle", "size"]))
    pairs = work.keep(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "met")
    of = lambda c: members.select(F.col("class").alias(c), F.col("n").alias(f"{c}n"), F.col("set").alias(f"{c}s"))
    both = F.size(F.array_intersect("us", "vs"))
    linked = both * 100 >= (F.col("un") + F.col("vn") - both) * percent
    more = work.keep(pairs.join(of("u"), "u").join(of("v"), "v").filter(linked).select("u", "v"), "more")
    work.drop("df", "prefix", "groups", "near", "sizes", "reached", "met")
    return more


def clusters(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, Workspace]:
    """doc_id, text_hash, n_shingles, component_id of every row; and where its inputs are kept."""
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    texts = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sketch = work.keep(sketches(texts, n, bands, rows), "sketch")

    # one row for each class: its least row stands for it; equal word sequences have equal bands
    seat = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = sketch.filter("class is not null").groupBy("class").agg(F.min(seat).alias("seat"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = work.keep(classes.select("class", "seat.doc_id", "seat.text_hash", "n", "bands", "copies"), "classes")
    member = classes.select("class", "n", F.explode("bands").alias("key"))
    buckets = work.keep(member.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    shared = work.keep(join_hot(member, buckets, ["key"], "size"), "shared")

    # texts of all candidates, and how many shingles of each no other candidate of a family has
    wanted = classes.join(shared.groupBy("class").agg(F.max("size").alias("size")), "class").select("class", "doc_id", "text_hash", "size")
    found = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.doc_id) & (texts.text_hash == wanted.text_hash)).select("class", "text", "size").dropDuplicates(["class"])
    found = work.keep(found.withColumn("number", F.monotonically_increasing_id()), "texts")
    lone = shingle_rows(found.filter("size > 2").select("number", "text"), n).groupBy("shingle").agg(F.count("*").alias("c"), F.max("number").alias("number")).filter("c = 1")
    own = work.keep(found.select("class", "number").join(lone.groupBy("number").agg(F.count("*").alias("own")), "number", "left").select("class", F.coalesce("own", F.lit(0)).alias("own")), "own")

    # What is left after its own shingles bounds a text's similarity with any other. In a bucket of two the other text may
    # not have been counted, so nothing is ruled out there.
    bounded = F.when(F.col("size") > 2, F.col("own")).otherwise(0).alias("own")
    able = work.keep(shared.join(own, "class").select("key", "class", "n", "size", bounded).filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent), "able")

    def fits(an: str, ao: str, bn: str, bo: str) -> F.Column:
        most = F.least(F.col(an) - F.col(ao), F.col(bn) - F.col(bo))
        return most * 100 >= (F.col(an) + F.col(bn) - most) * percent

    centre = able.groupBy("key").agg(F.min(F.struct("own", "class", "n")).alias("c"), F.count("*").alias("m"))
    centre = work.keep(centre.select("key", F.col("c.class").alias("u"), F.col("c.own").alias("uo"), F.col("c.n").alias("un"), "m"), "centre")
    pairs = join_hot(able, centre, ["key"], "m").filter((F.col("class") != F.col("u")) & fits("n", "own", "un", "uo"))
    pairs = work.keep(pairs.select(F.least("u", "class").alias("u"), F.greatest("u", "class").alias("v")).distinct(), "pairs")
    edges = work.keep(verified(pairs, found, n, percent), "edges")
    roots = work.keep(components(edges, work), "roots")

    # buckets that still hold several components: their members are compared across components, where prefixes meet
    placed = work.keep(able.join(roots.withColumnRenamed("node", "class"), "class", "left").select("key", "class", "n", F.coalesce("root", "class").alias("root")), "placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")).filter("r0 != r1 and m > 2").select("key", "m")
    member = work.keep(join_hot(placed, work.keep(open_, "open"), ["key"], "m").select("class", "n", "root").distinct(), "member")
    if not member.isEmpty():
        sets = shingle_sets(found.join(member.select("class"), "class", "left_semi").select("class", "text"), n)
        more = across(work.keep(member.join(sets, "class"), "members"), percent, work)
        if not more.isEmpty():
            roots = work.keep(components(edges.unionByName(more), work), "roots2")

    ids = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "doc_id", "copies", F.coalesce("root", "class").alias("root"))
    ids = work.keep(ids, "ids")
    least = work.keep(ids.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m")), "least")
    of_class = work.keep(join_hot(ids, least, ["root"], "m").select("class", "component_id", "copies"), "component")
    work.drop("buckets", "shared", "texts", "own", "able", "centre", "pairs", "edges", "roots", "placed", "open", "member", "members", "more", "roots2", "ids", "least")
    rows = sketch.select("doc_id", "text_hash", "n_shingles", "class")
    out = join_hot(rows, of_class, ["class"], "copies").select("doc_id", "text_hash", "n_shingles", "component_id")
    bare = rows.filter("class is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(bare), work


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    out, _ = clusters(docs, n, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their component, with all their columns; repeated rows of one stay one row."""
    out, work = clusters(docs, n, percent)
    gone = out.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text")).distinct()
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    d, t = F.col(f"c{docs.columns.index('doc_id')}"), F.col(f"c{docs.columns.index('text')}")
    kept = plain.join(gone, d.eqNullSafe(F.col("_gone")) & (F.xxhash64(t) == F.col("_text")), "left_anti")
    again = work.keep(out.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("_again"), F.col("text_hash").alias("_hash")), "again")
    if not again.isEmpty():
        same = d.eqNullSafe(F.col("_again")) & (F.xxhash64(t) == F.col("_hash"))
        once = kept.join(again, same, "left_semi").dropDuplicates([f"c{docs.columns.index(c)}" for c in ("doc_id", "text")])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.toDF(*docs.columns)
