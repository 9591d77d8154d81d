"""Full-text retrieval: BM25 over units or papers, substring fallback, metadata filters, literal search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import text as tx

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in order, in lower case and without diacritics."""
    import unicodedata

    import regex

    plain = "".join(x for x in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(x))
    return list(dict.fromkeys(regex.findall(tx.WORDS, unicodedata.normalize("NFC", plain))))


def bm25(rows: DataFrame, key: str, indexed: list[str], terms: list[str], mode: str = "or") -> DataFrame:
    """rows that match the terms, with score (larger is better) and rank (its negative).

    Only the query's terms are counted, in the scan; the collection's statistics are one row. mode 'and' wants every term.
    """
    tokens = rows.withColumn("_tokens", tx.fts_tokens(F.concat_ws(" ", *[F.col(c).cast("string") for c in indexed])))
    tf = [F.size(F.filter("_tokens", _is(t))).alias(f"_tf{i}") for i, t in enumerate(terms)]
    counted = tokens.select(*rows.columns, F.size("_tokens").alias("_dl"), *tf)
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    hit = [F.col(f"_tf{i}") > 0 for i in range(len(terms))]
    wanted = reduce(lambda a, b: a & b if mode == "and" else a | b, hit, F.lit(mode == "and" and bool(terms)))
    parts = []
    for i in range(len(terms)):
        tf_, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.greatest(F.ln((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
        parts.append(idf * tf_ * (K1 + 1) / (tf_ + K1 * (1 - B + B * F.col("_dl") / F.col("_avg"))))
    score = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    found = counted.filter(wanted).crossJoin(F.broadcast(stats))  # one row
    return found.select(*rows.columns, score.alias("score"), (-score).alias("rank"))


def _is(term: str):  # noqa: ANN202
    return lambda x: x == term


def bm25_norm(score: Column) -> Column:
    return 1 - 1 / (1 + F.abs(score))


def content_discovery(units: DataFrame, query: str, limit: int) -> DataFrame:
    """The best units for any of a query's terms."""
    found = bm25(units, "unit_id", ["unit_id", "paper_id", "section_path", "unit_text"], query_terms(query))
    return found.orderBy(F.desc(F.round("score", 6)), "unit_id").limit(limit)


def fts_syntax_error(query: str) -> bool:
    """Whether a raw full-text query would be refused, so that its terms are OR-ed instead."""
    import re

    words = query.split()
    return bool(re.search(r"[^\w\s\"*^:+一-鿿]", query)) or bool(words and (words[-1] in ("AND", "OR", "NOT") or words[0] in ("AND", "OR", "NOT")))


def metadata_search(papers: DataFrame, query: str, limit: int) -> DataFrame:
    """All terms must match, unless the query can't be parsed: then any. No hit stays no hit."""
    found = bm25(papers, "paper_id", ["title", "domain", "first_author"], query_terms(query), "or" if fts_syntax_error(query) else "and")
    return found.orderBy(F.desc(F.round("score", 6)), "paper_id").limit(limit)


def like_search(papers: DataFrame, query: str, fields: list[str], limit: int, newest: str = "year") -> DataFrame:
    """Every token is a substring of one field; newest first by text."""
    tokens = [t.lower() for t in query.split()]
    ok = [reduce(lambda a, b: a & b, [F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(t)) for t in tokens], F.lit(True)) for f in fields]
    return papers.filter(reduce(lambda a, b: a | b, ok)).orderBy(F.desc_nulls_last(newest), "paper_id").limit(limit)


def metadata_filters(papers: DataFrame, domain: str = "", year_from: int = 0, year_to: int = 0, **equal: str) -> DataFrame:
    """Falsy arguments filter nothing; years compare as SQLite casts them, so '' is 0."""
    if domain:
        papers = papers.filter(F.col("domain") == domain)
    if year_from:
        papers = papers.filter(tx.sqlite_int("year") >= year_from)
    if year_to:
        papers = papers.filter(tx.sqlite_int("year") <= year_to)
    for name, value in equal.items():
        if value:
            papers = papers.filter(F.col(name) == value)
    return papers


def literal_lines(rows: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """(key, line, text) of the lines that hold a term in any case."""
    lines = rows.filter(F.contains(F.lower(text), F.lit(term.lower()))).select(key, F.posexplode(F.split(text, r"\r\n|\n|\r", -1)).alias("line", "text"))
    return lines.filter(F.contains(F.lower("text"), F.lit(term.lower()))).select(key, (F.col("line") + 1).cast("long").alias("line"), "text")


def read_local(fulltext: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Matches of both carriers, the first of each (source, text)."""
    both = fulltext.select(key, F.lit("fulltext").alias("source"), "line", "text").unionByName(pages.select(key, F.lit("page").alias("source"), "line", "text"))
    return both.groupBy(key, "source", "text").agg(F.min("line").alias("line"))


def body_coverage(papers: DataFrame, units: DataFrame) -> DataFrame:
    """Papers with units, papers whose text is done, all papers; one row."""
    covered = papers.join(units.select("paper_id").distinct().withColumn("has_units", F.lit(True)), "paper_id", "left")
    return covered.agg(F.count_if(F.coalesce("has_units", F.lit(False))).alias("indexed"), F.count_if(F.col("ocr_status") == "done").alias("done"), F.count("*").alias("total"))


def with_unit_counts(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Hits with the number of their paper's units."""
    return hits.join(units.groupBy("paper_id").agg(F.count("*").alias("n_units")), "paper_id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)).cast("long"))
