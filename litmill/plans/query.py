"""Query analysis: signals of a query, routing, expansion. Python for one query, columns for a table of queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import text as tx

# Words that speak of content, and words that say nothing.
CONTENT_WORDS = ("hz", "v/cm", "v", "ma", "mv", "galvanotaxis", "electrotaxis", "dc", "ac", "cc", "pemf", "field", "scaffold", "stimulation", "migration", "chondrocyte", "cartilage", "method", "parameter")
EMPTY_WORDS = ("doi", "pmid", "title", "paper", "article")

# Abbreviations and synonyms of the subject.
ABBREVIATIONS = {
    "ACL": "anterior cruciate ligament",
    "PCL": "posterior cruciate ligament",
    "MCL": "medial collateral ligament",
    "LCL": "lateral collateral ligament",
    "VTE": "venous thromboembolism",
    "DVT": "deep vein thrombosis",
    "RCT": "rotator cuff",
    "OA": "osteoarthritis",
    "THA": "total hip arthroplasty",
    "TKA": "total knee arthroplasty",
    "ROM": "range of motion",
    "BMI": "body mass index",
    "NSAID": "nonsteroidal anti-inflammatory drug",
    "RSA": "reverse shoulder arthroplasty",
    "TSA": "total shoulder arthroplasty",
    "ORIF": "open reduction internal fixation",
    "TFCC": "triangular fibrocartilage complex",
    "CCI": "charlson comorbidity index",
    "ASA": "american society of anesthesiologists",
    "PROM": "patient reported outcome measure",
    "PROMIS": "patient reported outcomes measurement information system",
}
SYNONYMS = {
    "knee": ["knee joint", "genu"],
    "shoulder": ["glenohumeral joint", "shoulder joint"],
    "hip": ["hip joint", "acetabulofemoral joint"],
    "elbow": ["elbow joint"],
    "ankle": ["ankle joint", "talocrural joint"],
    "wrist": ["wrist joint", "radiocarpal joint"],
    "spine": ["vertebral column", "spinal column"],
    "fracture": ["fracture", "break"],
    "repair": ["repair", "reconstruction", "fixation"],
    "replacement": ["arthroplasty", "replacement"],
    "complication": ["complication", "adverse event", "comorbidity"],
    "pain": ["pain", "analgesia", "pain management"],
}


def signals(query: Column | str) -> Column:
    """struct(doi, item_key, citation_key, years, authors, titles, content) of a column of queries."""
    q = F.col(query) if isinstance(query, str) else query
    doi, key = tx.doi(q), tx.item_key(q)
    tokens, years = tx.query_tokens(q), tx.years(q)
    digit = lambda t: t.rlike("[0-9]")
    word = lambda t: F.lower(t).isin(*CONTENT_WORDS)
    plain = F.filter(tokens, lambda t: ~digit(t) & ~F.lower(t).isin(*EMPTY_WORDS))
    named = F.filter(plain, lambda t: ~word(t) & t.rlike("^[A-Z]") & (F.length(t) >= 3))
    has_year = F.size(years) > 0
    # with a year only the first capitalised word is an author, the others belong to the title
    authors = F.when(has_year, F.slice(named, 1, 1)).otherwise(named)
    spare = F.slice(F.filter(tokens, lambda t: ~word(t) & (F.length(t) >= 3)), 1, 1)
    first_named = F.coalesce(F.array_position(plain, F.get(named, F.lit(0))), F.lit(0))
    titles = F.when(has_year, F.filter(plain, lambda t, i: (i + 1) != first_named)).otherwise(F.filter(plain, lambda t: word(t) | ~(t.rlike("^[A-Z]") & (F.length(t) >= 3))))
    content = F.filter(tokens, lambda t: digit(t) | (word(t) & ~F.lower(t).isin(*EMPTY_WORDS)))
    return F.struct(
        doi.alias("doi"), key.alias("item_key"), F.when(doi.isNull() & key.isNull(), tx.citation_key(q)).alias("citation_key"), years.alias("years"),
        tx.distinct_folded(F.when(has_year & (F.size(authors) == 0), spare).otherwise(authors)).alias("authors"), tx.distinct_folded(titles).alias("titles"), tx.distinct_folded(content).alias("content"),
    )


def query_class(s: Column, intent: str) -> Column:
    """Which kind of query these signals make for an intent (metadata, content or evidence)."""
    exact = F.coalesce(s.doi, s.item_key, s.citation_key).isNotNull()
    dated = (F.size(s.authors) > 0) & (F.size(s.years) > 0)
    out = F.when(exact, "identifier_exact")
    if intent == "evidence":
        return out.otherwise("evidence_query")
    if intent == "content":
        return out.when(dated, "mixed_query").otherwise("content_term")
    return out.when(dated & (F.size(s.titles) == 0), "author_year").when(dated, "mixed_query").otherwise("metadata_topic")


def plans(queries: DataFrame, query: str, intent: str) -> DataFrame:
    """queries with their class, the command to run first and its main argument."""
    rows = queries.withColumn("_s", signals(query))
    s, kind = F.col("_s"), F.col("query_class")
    rows = rows.withColumn("query_class", query_class(s, intent))
    dated = (F.size(s.authors) > 0) & (F.size(s.years) > 0)
    command = F.when(kind == "identifier_exact", "paper-context").when((kind == "content_term"), "retrieve").otherwise("search")
    evidence = F.coalesce(F.nullif(F.array_join(F.when(F.size(s.content) > 0, s.content).when(F.size(s.titles) > 0, s.titles).otherwise(F.slice(tx.query_tokens(query), 1, 6)), " "), F.lit("")), F.trim(query))
    argument = F.when(kind == "identifier_exact", F.coalesce(s.doi, s.item_key, s.citation_key)).when(kind == "evidence_query", evidence).when(dated, F.get(s.authors, F.lit(0))).otherwise(F.trim(query))
    return rows.withColumn("command", command).withColumn("argument", argument).withColumn("year_from", F.when(dated & command.eqNullSafe("search"), F.array_min(s.years))).withColumn("year_to", F.when(dated & command.eqNullSafe("search"), F.array_max(s.years))).drop("_s")


@dataclass
class Plan:
    query_class: str
    command: str
    argument: str


def plan(spark, query: str, intent: str) -> Plan:  # noqa: ANN001
    """The plan of one query."""
    row = plans(spark.createDataFrame([(query,)], "q string"), "q", intent).first()
    return Plan(row.query_class, row.command, row.argument)


def expand(query: str) -> list[str]:
    """The query, then a variant for each abbreviation in it; without one, variants by the first synonym group that matches.

    Each variant is made from the original query.
    """
    def swap(word: str, by: str) -> str:
        return re.sub(rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])", by, query, flags=re.I)

    variants = [query, *(swap(a, full) for a, full in ABBREVIATIONS.items())]
    if all(v == query for v in variants):
        for word, others in SYNONYMS.items():
            if swap(word, "") != query:
                variants += [swap(word, o) for o in others]
                break
    return list(dict.fromkeys(variants))


def expansions(query: Column | str) -> Column:
    """The same for a column of queries, the abbreviation arm only."""
    q = F.col(query) if isinstance(query, str) else query
    swapped = [F.trim(F.regexp_replace(F.concat(F.lit(" "), q, F.lit(" ")), rf"(?i)([^A-Za-z0-9_]){a}([^A-Za-z0-9_])", f"$1{full}$2")) for a, full in ABBREVIATIONS.items()]
    return F.array_distinct(F.array(q, *swapped))
