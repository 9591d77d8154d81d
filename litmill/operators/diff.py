"""Differences between states, residues, upserts and field drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, deleted, changed or unchanged by digest."""
    a = old.select(key, F.col(digest).alias("_old"))
    b = new.select(key, F.col(digest).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def residual_carriers(authority: DataFrame, carriers: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that a carrier has but the authority hasn't, with a flag for each carrier."""
    tagged = [df.select(key).distinct().withColumn("carrier", F.lit(n)) for n, df in carriers.items()]
    flags = [F.bool_or(F.col("carrier") == n).alias(f"in_{n}") for n in carriers]
    return reduce(DataFrame.unionByName, tagged).join(authority.select(key).distinct(), key, "left_anti").groupBy(key).agg(*flags)


def orphans(rows: DataFrame, known: DataFrame, on: str, known_on: str) -> DataFrame:
    return rows.join(known.select(F.col(known_on).alias(on)).distinct(), on, "left_anti")


def duplicate_title_orphans(rows: DataFrame, title: str, exported: str, has_pdf: str) -> DataFrame:
    """Rows that aren't exported and have no pdf, but share the first 20 letters and digits of their title with an exported row."""
    norm = F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), 1, 20)
    keyed = rows.withColumn("title20", norm).filter("title20 != ''")
    shared = keyed.groupBy("title20").agg(F.bool_or(exported).alias("known")).filter("known").select("title20")
    return keyed.filter(~F.col(exported) & ~F.col(has_pdf)).join(shared, "title20", "left_semi")


KEPT_FIELDS = ("decision", "user_note", "collection", "import_status")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """New rows over old ones; of the kept fields the old value stays where it isn't blank."""
    cols = [c for c in new.columns if c != key]
    a = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_old"))
    b = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_new"))
    both = a.join(b, key, "full_outer")

    def value(c: str) -> F.Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in keep:
            return F.coalesce(F.when(F.trim(o.cast("string")) != "", o), n, o)
        return F.when(F.col("_new"), n).otherwise(o)

    return both.select(key, *[value(c).alias(c) for c in cols])


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the keys gone. tables: name to (table, its key column)."""
    return {n: df.join(gone.select(F.col(key).alias(c)).distinct(), c, "left_anti") for n, (df, c) in tables.items()}


def field_drift(rows: DataFrame, fields: str, required: list[str], optional: list[str]) -> DataFrame:
    """(code, field, n): required and optional fields missing, and fields that the registry doesn't know, of rows with an array of field names."""
    known = required + optional
    have = F.col(fields)
    of = lambda code, names: F.transform(names, lambda f: F.struct(F.lit(code).alias("code"), f.alias("field")))
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    issues = F.concat(of("missing_required", F.array_except(arr(required), have)), of("missing_optional", F.array_except(arr(optional), have)), of("unknown_field", F.array_except(have, arr(known))))
    return rows.select(F.explode(issues).alias("x")).groupBy("x.code", "x.field").agg(F.count("*").alias("n"))


def key_union(tables: list[DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.union, [t.select(key) for t in tables]).distinct()


def has_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """One row: whether any key occurs twice."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("duplicates"))


def writeback(candidates: DataFrame, queue: DataFrame) -> DataFrame:
    """The writeback queue: accepted candidates that aren't imported, each with its action, and the processed rows that were there."""
    action = F.when(F.coalesce("existing_key", F.lit("")) != "", "attach_existing").when(F.coalesce("doi", F.lit("")) != "", "add_by_doi").when(F.coalesce("pmid", F.lit("")) != "", "add_by_pmid").otherwise("add_by_metadata")
    wanted = candidates.filter((F.col("decision") == "accept") & (F.col("import_status") != "imported")).select("candidate_id", action.alias("action"), F.lit("queued").alias("status"))
    kept = queue.filter("status = 'processed'").select("candidate_id", "action", "status")
    return kept.unionByName(wanted.join(kept.select("candidate_id"), "candidate_id", "left_anti"))
