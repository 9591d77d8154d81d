"""Paper lookup by identifiers, author, year and title words; matching against inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _has(column: str, term: str) -> Column:
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(term.lower()))


def exact(rows: DataFrame, **wanted: str) -> DataFrame:
    """The first row by the first identifier given that matches in any case."""
    arms = [rows.filter(F.lower(F.col(c).cast("string")) == v.lower()).withColumn("arm", F.lit(i)).withColumn("matched_by", F.lit(c)) for i, (c, v) in enumerate(wanted.items()) if v]
    return reduce(DataFrame.unionByName, arms).orderBy("arm", "paper_id").limit(1).drop("arm")


def _covered(rows: DataFrame, by: str, tokens: list[str], author: Column, year: Column) -> DataFrame:
    hits = reduce(lambda a, b: a + b, [_has("title", t).cast("int") for t in tokens], F.lit(0))
    return rows.select("paper_id", F.lit(by).alias("matched_by"), (author.cast("int") + year.cast("int") + hits).cast("long").alias("coverage_score"))


def candidates(papers: DataFrame, author: str = "", year: str = "", tokens: list[str] | None = None) -> list[DataFrame]:
    """The arms of a lookup in order: author+year, author+title, year+title, each title token."""
    tokens = tokens or []
    has_author = _has("first_author", author) if author else F.lit(False)
    has_year = F.coalesce(F.col("year") == year, F.lit(False)) if year else F.lit(False)
    cut = lambda df, n: df.orderBy("paper_id").limit(n)
    arms = []
    if author and year:
        arms.append(_covered(cut(papers.filter(has_author & has_year), 20), "author+year", tokens, F.lit(True), F.lit(True)))
    if author and tokens:
        arms.append(_covered(cut(papers.filter(has_author & _has("title", tokens[0])), 20), "author+title", tokens, F.lit(True), has_year))
    if year and tokens:
        arms.append(_covered(cut(papers.filter(has_year & _has("title", tokens[0])), 20), "year+title", tokens, has_author, F.lit(True)))
    for t in tokens:
        arms.append(_covered(cut(papers.filter(_has("title", t)), 10), "relaxed_title", tokens, has_author, has_year))
    return arms


def lookup(arms: list[DataFrame]) -> DataFrame:
    """One row for each paper, from the first arm that has it; best coverage first."""
    union = reduce(DataFrame.unionByName, [a.withColumn("arm", F.lit(i)) for i, a in enumerate(arms)])
    first = Window.partitionBy("paper_id").orderBy("arm")
    return union.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").orderBy(F.desc("coverage_score"), "arm", "paper_id")


def alias(rows: DataFrame, aliases: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """rows joined with the aliases that contain the query; a row may repeat."""
    hits = aliases.filter(F.contains("alias_norm", F.lit(query.strip().lower())))
    return rows.join(hits, "paper_id").orderBy("paper_id", "alias_norm").limit(limit)


def first_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each non-blank key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.filter(F.coalesce(key, F.lit("")) != "").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def library_match(rows: DataFrame, inventory: DataFrame, keys: list[str], order: list[str], key_col: str) -> DataFrame:
    """rows with the inventory key found by the first of the keys that hits."""
    for k in keys:
        hit = first_by(inventory, k, order).select(F.col(k).alias(f"_k_{k}"), F.col(key_col).alias(f"_hit_{k}"))
        rows = rows.join(hit, F.col(k) == F.col(f"_k_{k}"), "left").drop(f"_k_{k}")
    found = F.coalesce(*[f"_hit_{k}" for k in keys])
    by = reduce(lambda a, k: F.when(F.col(f"_hit_{k}").isNotNull(), k).otherwise(a), reversed(keys), F.lit(None).cast("string"))
    return rows.withColumn("matched_key", found).withColumn("matched_by", by).drop(*[f"_hit_{k}" for k in keys])


def resolver_search(papers: DataFrame, title: str = "", author: str = "", year: str = "", domain: str = "", limit: int = 20) -> DataFrame:
    """Every given field must match; exact titles and domains weigh more than parts of them."""
    tests = []
    if title:
        tests.append(F.when(F.lower("title") == title.lower(), 100).when(_has("title", title), 30).otherwise(0))
    if author:
        tests.append(F.when(_has("first_author", author), 50).otherwise(0))
    if year:
        tests.append(F.when(F.col("year") == year, 40).otherwise(0))
    if domain:
        tests.append(F.when(F.lower("domain") == domain.lower(), 20).when(_has("domain", domain), 10).otherwise(0))
    if not tests:
        return papers.limit(0).withColumn("score", F.lit(0))
    ok = reduce(lambda a, b: a & b, [t > 0 for t in tests])
    return papers.filter(ok).withColumn("score", reduce(lambda a, b: a + b, tests)).orderBy(F.desc("score"), "paper_id").limit(limit)


def resolve_doi(papers: DataFrame, doi: str) -> DataFrame:
    bare = F.regexp_replace(F.lower(F.trim("doi")), r"^https?://(?:dx\.)?doi\.org/", "")
    import re

    return papers.filter(bare == re.sub(r"^https?://(?:dx\.)?doi\.org/", "", doi.strip().lower())).orderBy("paper_id").limit(1)


def resolve_collection(choices: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each raw choice against its domain's collection paths: exact, exact in any case, last segment, suffix; ambiguous if a tier has several."""
    c = catalog.select("domain", "path")
    raw, path = F.trim("raw"), F.col("path")
    tier = F.when(path == raw, 1).when(F.lower(path) == F.lower(raw), 2).when(F.lower(F.element_at(F.split(path, "/"), -1)) == F.lower(raw), 3).when(F.endswith(F.lower(path), F.concat(F.lit("/"), F.lower(raw))), 4)
    pairs = choices.join(c, "domain").withColumn("tier", tier).filter("tier is not null")
    best = pairs.groupBy("domain", "raw", "tier").agg(F.count("*").alias("n"), F.min("path").alias("path")).groupBy("domain", "raw").agg(F.min(F.struct("tier", "n", "path")).alias("b"))
    out = choices.join(best, ["domain", "raw"], "left")
    code = F.when(raw == "", "empty").when(F.col("b").isNull(), "unresolved").when(F.col("b.n") > 1, "ambiguous").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("exact", "exact_ci", "leaf", "suffix")]), F.coalesce("b.tier", F.lit(1))))
    return out.select("domain", "raw", code.alias("resolution"), F.when(F.col("b.n") == 1, F.col("b.path")).alias("path"))
