"""Column functions on strings: normalisation, identifiers, tokens, rule classifiers.

Expressions avoid look-around and Unicode word boundaries so that other SQL engines read them alike.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"((?:19|20)[0-9]{2})"
WORDS = r"[\p{L}\p{N}_]+"
QUERY_TOKENS = r"[A-Za-z][A-Za-z0-9.+-]*|[\x{4e00}-\x{9fff}]{2,}"
DOI = r"(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sqlite_int(c: Column | str) -> Column:
    """A text's leading integer as SQLite casts it: 0 where there is none, null for null."""
    c = _c(c)
    number = F.expr("bigint(null)") if c is None else F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")
    return F.when(c.isNotNull(), F.coalesce(number, F.lit(0).cast("bigint")))


def year(c: Column | str) -> Column:
    """First year from 1900 to 2099 in a date text, or ''."""
    return F.regexp_extract(_c(c), YEAR, 1)


def loose_year(c: Column | str) -> Column:
    """First four digits in a row, or ''."""
    return F.regexp_extract(_c(c), "([0-9]{4})", 1)


def doi(c: Column | str) -> Column:
    """The DOI in a text, or null."""
    return F.nullif(F.regexp_extract(_c(c), DOI, 1), F.lit(""))


def item_key(c: Column | str) -> Column:
    """The trimmed upper-cased text if it has the form of an item key (any eight ASCII letters or digits), or null."""
    t = F.upper(F.trim(_c(c)))
    return F.when(t.rlike("^[A-Z0-9]{8}$"), t)


def citation_key(c: Column | str) -> Column:
    """The trimmed text if it has the form of a citation key, or null."""
    t = F.trim(_c(c))
    return F.when(t.rlike("^[A-Za-z][A-Za-z0-9_-]{5,}$") & t.rlike("[0-9_-]"), t)


def years(c: Column | str) -> Column:
    """All years that stand alone, in order."""
    found = F.regexp_extract_all(F.regexp_replace(_c(c), "([^A-Za-z0-9_])", " $1 "), F.lit(r"(?:^| )((?:19|20)[0-9]{2})(?: |$)"), F.lit(1))
    return F.transform(found, lambda y: y.cast("int"))


def query_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(QUERY_TOKENS), F.lit(0))


@cache
def _diacritics() -> tuple[str, str]:
    """Letters that decompose into a letter and combining marks, and the letters without; the marks follow, with nothing."""
    marked, plain = [], []
    for point in range(0xC0, 0x2000):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(point)) if not unicodedata.combining(x))
        if base != chr(point) and len(base) == 1:
            marked.append(chr(point))
            plain.append(base)
    marks = [chr(point) for point in range(0x300, 0x370)]
    return "".join(marked + marks), "".join(plain)


def folded(c: Column | str) -> Column:
    """Lower case without diacritics, as the full-text index folds words."""
    low = F.lower(_c(c))
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, *_diacritics())).otherwise(low)


def fts_tokens(c: Column | str) -> Column:
    """Runs of letters, digits and underscores in lower case, without diacritics."""
    return F.regexp_extract_all(folded(c), F.lit(WORDS), F.lit(0))


def distinct_folded(tokens: Column) -> Column:
    """The first of each token regardless of case, in order."""
    lowered = F.transform(tokens, lambda t: F.lower(t))
    return F.filter(tokens, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


def slug(c: Column | str, most: int = 120) -> Column:
    """A file name: characters that file systems refuse removed, cut, without trailing blank or dot; never empty."""
    t = F.trim(F.regexp_replace(_c(c), r'[<>:"/\\|?*]+', ""))
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(t, 1, most), r"[ .]+$", ""), F.lit("")), F.lit("untitled"))


def folded_title(c: Column | str) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(_c(c), r"\s+", " ")))


def identity_keys(doi_: Column | str, pmid: Column | str, title: Column | str) -> list[Column]:
    return [F.lower(F.trim(_c(doi_))).alias("doi_key"), F.trim(_c(pmid)).alias("pmid_key"), folded_title(title).alias("title_key")]


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.length(_c(c)) / 4).cast("long")


def candidate_value(c: Column | str) -> Column:
    """Null as '', otherwise trimmed."""
    return F.coalesce(F.trim(_c(c)), F.lit(""))


def candidate_id(source: Column, doi_: Column, pmid: Column, title: Column, stamp: Column) -> Column:
    """source-(doi slug, else pmid digits, else title slug of at most 80 characters, else a timestamp)."""
    dash = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    tail = F.coalesce(F.nullif(dash(F.coalesce(doi_, F.lit(""))), F.lit("")), F.nullif(F.regexp_replace(F.coalesce(pmid, F.lit("")), "[^0-9]", ""), F.lit("")), F.nullif(F.substring(dash(F.coalesce(title, F.lit(""))), 1, 80), F.lit("")), stamp)
    return F.concat_ws("-", source, tail)


def inverted_index_text(positions: Column) -> Column:
    """map<word, array<position>> back to its text."""
    pairs = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x.w), " ")


def authors(creators: Column) -> Column:
    """'first last' (else the single name) of the creators who are authors."""
    named = F.transform(F.filter(creators, lambda c: c.creatorType == "author"), lambda c: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", F.nullif(c.firstName, F.lit("")), F.nullif(c.lastName, F.lit("")))), F.lit("")), c["name"]))
    return F.filter(named, lambda n: F.coalesce(n, F.lit("")) != "")


def collection_fields(paths: Column) -> Column:
    """Primary path (deepest, then longest, then last by text) and the distinct segments in order of appearance."""
    good = F.filter(paths, lambda p: F.coalesce(p, F.lit("")) != "")
    depth = F.transform(good, lambda p: F.struct((F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).alias("d"), F.length(p).alias("n"), p.alias("p")))
    tags = F.array_distinct(F.filter(F.flatten(F.transform(good, lambda p: F.transform(F.split(p, "/"), lambda s: F.trim(s)))), lambda s: s != ""))
    return F.struct(F.coalesce(F.array_max(depth).p, F.lit("")).alias("primary"), tags.alias("tags"))


def attachment_path(path: Column) -> Column:
    """struct(kind, path, key) of an attachment: 'storage:KEY/file', an absolute path or a bare relative one."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    stored = F.regexp_extract(unix, r"(?:^storage:|/storage/|^)([A-Z0-9]{8})/(.+)$", 1)
    made = lambda kind, p, key: F.struct(F.lit(kind).alias("kind"), p.alias("path"), key.alias("key"))
    rest = F.regexp_extract(unix, r"(?:^storage:|/storage/|^)([A-Z0-9]{8})/(.+)$", 2)
    none = F.lit("")
    return (
        F.when(F.coalesce(path, none) == "", made("missing", none, none))
        .when(stored != "", made("storage", F.concat(F.lit("storage:"), stored, F.lit("/"), rest), stored))
        .otherwise(made("absolute", F.concat(F.lit("absolute:"), unix), none))
    )


def object_label(label: Column, caption: Column) -> Column:
    """Internal 'figure:p…' and 'table:p…' ids give way to the caption's first label."""
    shown = F.nullif(F.regexp_extract(caption, r"(?i)((?:Supplementary |Extended Data )?(?:Figure|Fig\.?|Table) ?S?[0-9]+[A-Za-z]?)", 1), F.lit(""))
    return F.when(label.rlike("^(figure|table):p"), F.coalesce(shown, label)).otherwise(label)


def plain_html(c: Column | str) -> Column:
    """Text of an HTML page: scripts and tags out, the five named entities and blanks resolved."""
    t = F.regexp_replace(_c(c), r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def folded_gap(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(c), r"\s+", " ")))


# Phrases that say nothing about a passage.
GENERIC = ("introduction", "abstract", "conclusion", "conclusions", "discussion", "results", "references", "keywords")
SHORTEST = 12


def generic_chunk(c: Column | str) -> Column:
    """Blank, one of the generic phrases, or at most twelve characters."""
    t = F.trim(F.coalesce(_c(c), F.lit("")))
    return F.lower(t).isin(*GENERIC) | (F.length(t) <= SHORTEST)


# Section names.
SECTIONS = ("introduction", "materials and methods", "methods", "results", "results and discussion", "discussion", "conclusion", "conclusions")
NUMBERED = r"^[0-9]+(?:\.[0-9]+)*\.?\s+[A-Z]"


def marker_type(c: Column | str) -> Column:
    """What a block's first characters mark it as; the first rule that holds decides."""
    t = F.trim(_c(c))
    low = F.lower(t)
    named = F.regexp_replace(low, "^[*•·–—-]+", "")
    return (
        F.when(F.coalesce(_c(c), F.lit("")) == "", "empty")
        .when(low.rlike(r"^(?:journal\s+)?pre-?proof(?:[^a-z0-9_]|$)"), "preproof_marker")
        .when(t.rlike(r"^\(?[A-Za-z]\)?[.:]?$"), "panel_label")
        .when(t.rlike(r"^(?i:[IVXLCDM]+\.\s+[A-Z][A-Z0-9 ,;:/()-]+)$"), "heading_roman")
        .when(t.rlike(r"^\[[0-9]+\]"), "reference_numeric_bracket")
        .when(t.rlike(NUMBERED) & low.rlike("introduction|methods|results|discussion|conclusion"), "heading_numbered")
        .when(t.rlike(r"^[0-9]+\.?\s"), "reference_numeric_dot")
        .when(t.rlike(r"^(?:\([0-9]+\)|[0-9]+\))\s"), "reference_numeric_parenthesis")
        .when(t.rlike(NUMBERED), "heading_numbered")
        .when(t.rlike(r"^[A-Z]\.\s+[A-Z][A-Za-z0-9 ,;:/()-]+$"), "heading_alpha")
        .when(named.isin(*SECTIONS), "canonical_section_name")
        .when(low.rlike(r"^(?:supplementary\s+|extended\s+data\s+)?fig(?:ure|\.)?\s*s?[0-9]+"), "figure_number")
        .when(low.rlike(r"^(?:supplementary\s+|extended\s+data\s+)?table\s*s?[0-9]+"), "table_number")
        .when(t.rlike(r"^[A-Z][A-Za-z'’-]+\s+et al\.\s*\([0-9]{4}[a-z]?\)|^\([A-Z][A-Za-z'’-]+\s+et al\.,\s*[0-9]{4}[a-z]?\)"), "reference_pattern")
        .when(t.rlike(r"^[A-Z][a-z]+'?[a-z]* [A-Z](?:\.[, ]|[A-Z]\.?,|[,\s])"), "citation_line")
        .when(t.rlike(r"\$\s*\^\{"), "affiliation_marker")
        .when(F.length(t) < 20, "short_fragment")
        .otherwise("none")
    )


def roman_to_int(c: Column | str) -> Column:
    """Value of a Roman numeral, null for anything else."""
    s = F.upper(F.trim(_c(c)))
    value = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    digits = F.transform(F.reverse(F.split(s, "")), lambda d: value[d])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    total = F.aggregate(digits, start, lambda z, d: F.struct((z.total + F.when(d < z.last, -d).otherwise(d)).alias("total"), d.alias("last")), lambda z: z.total)
    return F.when(s.rlike("^[IVXLCDM]+$"), total)


def bucket(c: Column, step: float = 1.0) -> Column:
    """Nearest multiple of step, halves to even."""
    return F.round(F.bround(c / step) * step, 2)


def leading_number(c: Column | str) -> Column:
    """A reference entry's number: (n), [n], n. or n), or a bare n, tried in this order."""
    t = _c(c)
    tries = [r"^\s*\(([0-9]+)\)", r"^\s*\[([0-9]+)\]", r"^\s*([0-9]+)[.)]", r"^\s*([0-9]+)\s"]
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in tries]).try_cast("int")


def reference_family(c: Column | str) -> Column:
    """struct(family, confidence) of a reference entry, without a journal lexicon."""
    t = F.trim(F.coalesce(_c(c), F.lit("")))
    low = F.lower(t)
    signed = t.rlike(r"(?:^|[^A-Za-z])[A-Z][a-zA-Z'-]+\s+[A-Z]{1,3}(?:,|[^A-Za-z0-9_]|$)")
    dated = t.rlike(r"(?:^|[^0-9A-Za-z_])(?:19|20)[0-9]{2}(?:[^0-9A-Za-z_]|$)")
    paged = t.rlike(r"[0-9]+\s*(?:\([0-9]+\)\s*)?:\s*[A-Za-z0-9-]+")
    numbered = t.rlike(r"^(?:\([0-9]+\)|\[[0-9]+\]|[0-9]+[.)]?)(?:\s+|$)")
    report = low.rlike(r"guideline|organization|committee|available from|\[internet\]")
    family = F.when(signed & dated & paged & numbered, "vancouver_structured_numbered").when(signed & dated & paged, "vancouver_structured_unnumbered").when(report & dated, "book_or_report").when(t.rlike(r"[A-Z][a-zA-Z'-]+\s+[A-Z].*\((?:19|20)[0-9]{2}\)"), "author_year").otherwise("unknown")
    confidence = F.when(family.startswith("vancouver"), 0.65).when(family == "book_or_report", 0.7).when(family == "author_year", 0.6).otherwise(0.0)
    return F.struct(family.alias("family"), confidence.alias("confidence"))


def author_match(block: Column, known: Column) -> Column:
    """Whether the names in a block are a paper's authors: Jaccard above one half, or all known names present."""
    names = F.array_distinct(F.regexp_extract_all(F.lower(block), F.lit(r"\p{L}{2,}"), F.lit(0)))
    wanted = F.array_distinct(F.flatten(F.transform(known, lambda n: F.regexp_extract_all(F.lower(n), F.lit(r"\p{L}{2,}"), F.lit(0)))))
    both = F.size(F.array_intersect(names, wanted))
    return (2 * both > F.size(F.array_union(names, wanted))) | ((both == F.size(wanted)) & (F.size(wanted) > 0))


def text_completeness(ocr: Column, pdf: Column) -> Column:
    """What was recognised against the page's own text: pdf_unavailable, empty_vs_pdf, short_vs_pdf (below 45 %), likely_missing_tail (by more than 24 characters) or complete."""
    a, b = F.trim(F.coalesce(ocr, F.lit(""))), F.trim(F.coalesce(pdf, F.lit("")))
    tail = F.startswith(b, a) & (F.length(b) > F.length(a) + 24)
    return F.when(b == "", "pdf_unavailable").when(a == "", "empty_vs_pdf").when(F.length(a) < 0.45 * F.length(b), "short_vs_pdf").when(tail, "likely_missing_tail").otherwise("complete")
