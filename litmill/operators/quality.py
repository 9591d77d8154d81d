"""Quality indicators, hard failures, readiness and use-case gates from a policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The readiness policy.
WEIGHTS = {"text": 0.35, "structure": 0.25, "figures": 0.20, "metadata": 0.10, "confidence": 0.10}
STATUS_SCORE = {"green": 1.0, "yellow": 0.6, "red": 0.2, "unknown": 0.5}
RANK = {"red": 0, "unknown": 1, "yellow": 2, "green": 3}
USE_CASES = {
    "reading": {"text": "yellow", "structure": "yellow"},
    "qa": {"text": "yellow", "structure": "yellow"},
    "figure_table_reasoning": {"figures": "yellow"},
    "section_chunking": {"structure": "green", "text": "yellow"},
}
CUT_GREEN, CUT_YELLOW, RED_CAP = 0.75, 0.40, 0.3


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def text_integrity(gaps: str = "gap_count", spine: str = "spine") -> Column:
    return F.when(_n(gaps) > 10, "red").when((_n(gaps) >= 4) | F.coalesce(F.col(spine) == "weak", F.lit(False)), "yellow").otherwise("green")


def structure(profile: str = "profile", refs: str = "refs_found", headings: str = "headings", layout: str = "layout", spine: str = "spine", anomalies: str = "anomalies") -> Column:
    found = F.coalesce(F.col(refs), F.lit(False))
    return (
        F.when((F.coalesce(profile, F.lit("standard")) == "standard") & ~found & (_n(headings) < 2), "red")
        .when((F.coalesce(layout, F.lit("pass")) == "fail") & F.coalesce(F.col(spine) == "weak", F.lit(False)), "red")
        .when((_n(anomalies) > 0) | F.coalesce(F.col(spine) == "partial", F.lit(False)), "yellow")
        .otherwise("green")
    )


def figures(captions: str = "captions", assets: str = "assets", unresolved: str = "unresolved") -> Column:
    """not_applicable, red or green; never yellow."""
    return F.when((_n(captions) == 0) & (_n(assets) == 0), "not_applicable").when((_n(unresolved) > 0) | (_n(captions) > _n(assets)), "red").otherwise("green")


def metadata(title: str = "title", authors: str = "authors") -> Column:
    return F.when((F.coalesce(title, F.lit("")) == "") | (F.coalesce(authors, F.lit("")) == ""), "yellow").otherwise("green")


def confidence(degraded: str = "degraded", coverage: str = "coverage") -> Column:
    return F.when(F.coalesce(F.col(degraded), F.lit(False)) | ~F.coalesce(coverage, F.lit("unknown")).isin("good", "acceptable", "strong"), "yellow").otherwise("green")


def figure_status(numbered: Column, accounted: Column, gaps: Column) -> Column:
    share = accounted / F.when(numbered > 0, numbered)
    return F.when(numbered == 0, "green").when((share >= 0.9) & (gaps == 0), "green").when(share >= 0.6, "yellow").otherwise("red")


def table_status(formal: Column, assets: Column, ambiguous: Column) -> Column:
    share = F.least(assets, formal) / F.when(formal > 0, formal)
    return F.when(formal == 0, "green").when(assets == 0, "red").when((share >= 0.9) & (ambiguous == 0), "green").when(share >= 0.6, "yellow").otherwise("red")


def compare(value: Column, op: str, limit: object) -> Column:
    """A policy condition; a missing value fulfils none."""
    test = {"gt": value > F.lit(limit), "lt": value < F.lit(limit), "eq": value == F.lit(limit)}[op]
    return F.coalesce(test, F.lit(False))


def hard_red(rules: list[dict]) -> Column:
    """Names of the rules that hold. A rule: name, and one or two of {field, op, value}, all of which must hold."""
    tests = [(r["rule"], reduce(lambda a, b: a & b, [compare(F.col(c["field"]), c["op"], c["value"]) for c in r["all"]])) for r in rules]
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))


def readiness(status: dict[str, str], triggered: Column) -> Column:
    """struct(score, status): weighted mean over the indicators that apply, capped if a hard rule holds."""
    points = F.create_map(*[F.lit(x) for pair in STATUS_SCORE.items() for x in pair])
    applies = {d: F.coalesce(F.col(c), F.lit("unknown")) != "not_applicable" for d, c in status.items()}
    total = reduce(lambda a, b: a + b, [F.when(applies[d], WEIGHTS[d]).otherwise(0.0) for d in status])
    got = reduce(lambda a, b: a + b, [F.when(applies[d], WEIGHTS[d] * F.coalesce(points[F.coalesce(F.col(c), F.lit("unknown"))], F.lit(0.5))).otherwise(0.0) for d, c in status.items()])
    mean = F.when(total > 0, got / total).otherwise(0.0)
    red = F.size(triggered) > 0
    score = F.when(red, F.least(mean, F.lit(RED_CAP))).otherwise(mean)
    return F.struct(F.round(score, 4).alias("score"), F.when(red, "red").when(mean >= CUT_GREEN, "green").when(mean >= CUT_YELLOW, "yellow").otherwise("red").alias("status"))


def use_case(name: str, status: dict[str, str]) -> Column:
    """recommended, blocked, or not_applicable where figures are asked for and there are none."""
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    gates = [F.coalesce(rank[F.coalesce(F.col(status[d]), F.lit("unknown"))], F.lit(1)) >= RANK[least] for d, least in USE_CASES[name].items()]
    passed = F.when(reduce(lambda a, b: a & b, gates), "recommended").otherwise("blocked")
    return F.when(F.col(status["figures"]) == "not_applicable", "not_applicable").otherwise(passed) if name.startswith("figure") else passed


def human_validation(marks: Column, current: Column) -> Column:
    """What the last of an array of marks (struct of verdict and result_hash) says about the current result."""
    last = F.try_element_at(marks, F.lit(-1))
    return F.when(F.coalesce(F.size(marks), F.lit(0)) <= 0, "unreviewed").when(~last.result_hash.eqNullSafe(current), "stale").when(last.verdict.isin("correct", "usable_with_minor_issues"), "confirmed").otherwise("disputed")


def health_profile(pages: Column) -> Column:
    return F.when(pages <= 2, "short_form").otherwise("standard")


def abstract_structure(islands: Column) -> Column:
    """More than one abstract is worth a look, whether one was chosen or not."""
    return F.when(F.coalesce(islands, F.lit(1)) > 1, "yellow").otherwise("green")


def merged(base: dict, over: dict) -> dict:
    """A policy over another: tables merge key by key, anything else, lists too, is replaced."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return {**base, **both}
