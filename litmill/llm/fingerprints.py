"""Document fingerprints by consistent weighted sampling.

A text is a bag of words with weights 1 + ln(count). For each of SAMPLES seeds a word draws r and c from
Gamma(2, 1) and beta from [0, 1), all by hashing the word and the seed; with t = floor(ln(weight) / r + beta)
the word with the least ln(c) - r * (t - beta + 1) is sampled, together with t. Two texts agree in a
sample with the probability of their generalised Jaccard similarity (sum of lesser over sum of greater
weights), so the share of equal samples estimates it.

All of it is built-in DataFrame functions. The documents are dealt once, by buckets of neighbouring ids, cut at
quantiles of all ids, in which a window finds each one's next document; word counts, samples and the comparison with
the next document's fingerprint stay in that partitioning. An id that many rows have spans several quantiles, and its
rows are dealt among their buckets by text hash. A bucket's last document sees the first of the next
bucket by a copy of that row. A word that a text and its edit have equally often is sampled once for both. A sample's
least value and its word travel as one 64-bit number, so that they are plain hash aggregates.

Defined cases: a null text is empty; a text without a word has the sample of the empty word, so two such
texts are alike and unlike any other; equal doc_ids (and repeated rows) follow each other in the order of a
hash of their texts (rows equal in both meet in one bucket); null doc_ids come last; a single document is its own next
one; a very long text's words are counted in one task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.llm.common import pick

GROUPS, EACH = 8, 8
SAMPLES = GROUPS * EACH
#: Characters that end a word: ASCII without letters and digits.
SEPARATORS = r"[\x00-/:-@\[-`{-\x7f]+"
WORD = r"[^\x00-/:-@\[-`{-\x7f]"
#: Documents in a partition, and buckets for each partition, aimed at; buckets at most.
DOCS, BUCKETS, MOST_BUCKETS = 1024, 4, 100_000


def _packed(j: int) -> Column:
    """Sample j of a word from h (hash of word and group) and lw (ln of its weight): 43 bits of the value, then 20 of a hash of the word and t.

    One 64-bit hash gives the uniform numbers: 12 bits twice for r, 16 twice for c, 8 for beta. The whole is
    one expression, so that the aggregate that takes its least value keeps it in a method of its own, small
    enough to be compiled.
    """
    a = f"xxhash64(h, {j})"
    r = f"(-ln((shiftrightunsigned({a}, 52) + 0.5D) * {2.0**-12!r}D * ((shiftrightunsigned({a}, 40) & 4095) + 0.5D) * {2.0**-12!r}D))"
    c = f"(-ln(((shiftrightunsigned({a}, 24) & 65535) + 0.5D) * {2.0**-16!r}D * ((shiftrightunsigned({a}, 8) & 65535) + 0.5D) * {2.0**-16!r}D))"
    beta = f"(({a} & 255) * {2.0**-8!r}D)"
    t = f"floor(lw / {r} + {beta})"
    return F.expr(f"shiftleft(cast((ln({c}) - {r} * ({t} - {beta} + 1D) + 512D) * 8589934592D as bigint), 20) | (xxhash64({a}, {t}) & 1048575L)")


def _samples(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and group the EACH least packed values."""
    return hashed.groupBy(*keys, "grp").agg(*[F.min(_packed(j)).alias(f"m{j}") for j in range(EACH)])


def word_samples(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, edit (0: `text`, 1: `edited`) and group (column grp) the group's part of the fingerprint, column part."""
    both = F.array(F.struct(F.lit(0).alias("edit"), F.col("text").alias("text")), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")))
    rows = texts.select(*keys, F.explode(both).alias("x")).select(*keys, "x.edit", "x.text")
    words = rows.select(*keys, "edit", (~F.col("text").rlike(WORD)).alias("bare"), F.explode(F.split(F.lower("text"), SEPARATORS, -1)).alias("word"))
    words = words.filter("word != '' or bare").select(*keys, "edit", F.xxhash64("word").alias("word"))
    counted = words.groupBy(*keys, "word").agg(F.count_if(F.col("edit") == 0).alias("n0"), F.count_if(F.col("edit") == 1).alias("n1"))
    # edit 2: as often in both, so sampled once
    use = F.expr("case when n0 = n1 then array(struct(2 as edit, n0 as n)) when n0 = 0 then array(struct(1 as edit, n1 as n)) when n1 = 0 then array(struct(0 as edit, n0 as n)) else array(struct(0 as edit, n0 as n), struct(1 as edit, n1 as n)) end")
    weighed = counted.select(*keys, "word", F.explode(use).alias("x")).select(*keys, "word", "x.edit", F.ln(1 + F.ln("x.n")).alias("lw"))
    grouped = weighed.select(*keys, "edit", "word", "lw", F.explode(F.array(*[F.lit(g) for g in range(GROUPS)])).alias("grp"))
    least = _samples(grouped.select(*keys, "edit", "grp", "lw", F.xxhash64("word", "grp").alias("h")), [*keys, "edit"])
    values = [f"m{j}" for j in range(EACH)]
    least = least.select(*keys, "grp", *values, F.explode(F.when(F.col("edit") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array("edit"))).alias("edit"))
    least = least.groupBy(*keys, "edit", "grp").agg(*[F.min(m).alias(m) for m in values])
    part = F.concat(*[F.lpad(F.lower(F.hex(F.col(m).bitwiseAND(F.lit(1048575)))), 5, "0") for m in values])
    return least.select(*keys, "edit", "grp", part.alias("part"))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [F.when(F.substring(a, 5 * k + 1, 5) == F.substring(b, 5 * k + 1, 5), 1).otherwise(0) for k in range(SAMPLES)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(SAMPLES))


def _bounds(texts: DataFrame, buckets: int) -> str:
    """Quantiles of doc_id that cut the table into so many buckets, as a comma-joined text."""
    if buckets < 2:
        return ""
    shares = F.split(F.lit(",".join(str(k / buckets) for k in range(1, buckets))), ",").cast("array<double>")
    cut = texts.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * buckets)).alias("q")).first().q
    return ",".join(map(str, cut or []))  # at most MOST_BUCKETS numbers


def _bucket(bounds: str, buckets: int) -> Column:
    """Number of a row's bucket; greater for greater (doc_id, text_hash), negative for null ids."""
    n = bounds.count(",") + 1 if bounds else 0
    cuts = F.split(F.lit(bounds), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]) if n else F.array().cast("array<int>")

    def below(or_equal: bool) -> Column:  # by halving: how many cuts lie below
        def step(at: Column, width: Column) -> Column:
            cut = F.get(cuts, at + width - 1)
            return F.when((at + width <= n) & (cut <= F.col("doc_id") if or_equal else cut < F.col("doc_id")), at + width).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    part = F.least((F.col("text_hash").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64), F.lit(1 - 2.0**-53))
    least, most = below(False), below(True)
    found = least + F.floor(part * (most - least + 1)).cast("int")
    none = F.floor(part * buckets).cast("int") - buckets
    return F.when(F.col("doc_id").isNull(), none).otherwise(found)


def _in_order(texts: DataFrame) -> DataFrame:
    """texts with their bucket, and a copy of each bucket's first row at the end of the bucket before (copy = true)."""
    n = texts.count()
    shuffles = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffles, min(n // DOCS, 20_000))
    buckets = max(1, min(parts * BUCKETS, MOST_BUCKETS, n // 64))
    rows = texts.withColumn("bucket", _bucket(_bounds(texts, buckets), buckets))
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "text_hash")).alias("first"))  # at most 2 * MOST_BUCKETS rows
    order = Window.orderBy(F.desc("bucket"))
    before = F.coalesce(F.lag("bucket").over(order), F.first("bucket").over(Window.orderBy("bucket")))
    firsts = firsts.select(before.alias("bucket"), F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("t"))
    copies = texts.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).dropDuplicates(["bucket"])
    return rows.withColumn("copy", F.lit(False)).unionByName(copies.select(*texts.columns, "bucket").withColumn("copy", F.lit(True))).repartition(parts, "bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    order = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("text_hash"))
    rows = _in_order(texts).withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.coalesce(F.substring("next", F.lit(1), cut), F.lit("")))
    rows = rows.select("bucket", "place", "copy", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["bucket", "place", "copy", "doc_id", "n_chars", "digest"]
    parts = word_samples(rows.withColumn("digest", F.unhex(F.sha2(F.col("edited").cast("binary"), 256))), keys)
    of = lambda e: F.concat(*[F.max(F.when((F.col("edit") == e) & (F.col("grp") == g), F.col("part"))) for g in range(GROUPS)])
    out = parts.groupBy(*keys).agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))
    following = Window.partitionBy("bucket").orderBy("place")
    out = out.withColumn("next_fingerprint", F.lead("fingerprint").over(following)).filter(~F.col("copy"))
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
