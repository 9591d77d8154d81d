"""What is known about a paper in one place: scoped text, navigation, notes and corrections, scope checks, saved views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped_fetch(units: DataFrame, paper: DataFrame, section: str = "", node: str = "") -> DataFrame:
    """The units of the papers in `paper` (paper_id), by unit_id; of the sections or nodes that hold a text, if one is given."""
    found = units.join(paper.select("paper_id").distinct(), "paper_id", "left_semi")
    if section:
        found = found.filter(F.contains(F.lower("section_path"), F.lit(section.lower())))
    elif node:
        found = found.filter(F.contains(F.lower("unit_id"), F.lit(node.lower())))
    return found.orderBy("unit_id")


def navigation(papers: DataFrame, nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per paper what can be navigated: its structure tree, else a summary of its roles, else nothing; and how much there is."""
    tree = nodes.groupBy("paper_id").agg(F.count("*").alias("_nodes"))
    roles = blocks.groupBy("paper_id").agg(F.countDistinct("role").alias("_roles"))
    j = papers.select("paper_id").join(tree, "paper_id", "left").join(roles, "paper_id", "left")
    mode = F.when(F.col("_nodes").isNotNull(), "structure_tree").when(F.col("_roles").isNotNull(), "role_index_summary").otherwise("no_index")
    return j.select("paper_id", mode.alias("mode"), F.coalesce("_nodes", "_roles", F.lit(0)).cast("long").alias("entries"))


def compact_tree(nodes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Headings in document order with parent, depth and number of children.

    nodes: paper_id, ord, level, title; intervals: the same with `end`. A heading's parent is the last one before it
    whose interval holds it: the nearest with a lower level, found by a window for each of the six levels.
    """
    order = Window.partitionBy("paper_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") == k, F.col("ord"))).over(order) for k in range(1, 7)]
    rows = intervals.withColumn("_a", F.array(*above))
    # a heading of level k is still open if none of a lower or equal level came after it
    chain = F.transform(F.filter(F.transform("_a", lambda o, k: F.struct((k + 1).alias("k"), o.alias("o"))), lambda x: x.o.isNotNull() & (x.k < F.col("level"))), lambda x: x)
    open_ = F.filter(chain, lambda x: ~F.exists(chain, lambda y: (y.k < x.k) & (y.o > x.o)))
    rows = rows.withColumn("_open", F.transform(F.array_sort(F.transform(open_, lambda x: F.struct(x.o.alias("o"), x.k.alias("k")))), lambda x: x.o))
    tree = rows.select("paper_id", "ord", "level", "end", F.try_element_at("_open", F.lit(-1)).alias("parent"), (F.size("_open") + 1).alias("depth"))
    children = tree.filter("parent is not null").groupBy("paper_id", F.col("parent").alias("ord")).agg(F.count("*").alias("children"))
    numbered = tree.join(children, ["paper_id", "ord"], "left").withColumn("document_order", F.row_number().over(Window.partitionBy("paper_id").orderBy("ord")).cast("long"))
    return numbered.select("paper_id", "ord", "parent", "depth", F.coalesce("children", F.lit(0)).cast("long").alias("children"), (F.col("end") - F.col("ord")).alias("subtree_blocks"), "document_order")


def paper_context(papers: DataFrame, notes: DataFrame, corrections: DataFrame, units: DataFrame) -> DataFrame:
    """Per paper: notes, notes to check again, corrections and units.

    notes: paper_id, note_id, section, excerpt, verified. corrections: paper_id, original_id, created_at, event_id; of
    several to one note the newest stands, those without an original_id all do.
    """
    again = F.transform(F.array_sort(F.collect_list(F.when(~F.coalesce("verified", F.lit(False)), F.struct("note_id", F.concat(F.coalesce("section", F.lit("unknown")), F.lit(": "), F.substring(F.coalesce("excerpt", F.lit("")), 1, 80), F.lit("...")).alias("t"))))), lambda x: x.t)
    n = notes.groupBy("paper_id").agg(F.count("*").alias("n_notes"), F.array_join(again, "\n").alias("recheck"))
    newest = Window.partitionBy("paper_id", "original_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    once = corrections.withColumn("_r", F.row_number().over(newest)).filter((F.col("_r") == 1) | (F.coalesce("original_id", F.lit("")) == ""))
    c = once.groupBy("paper_id").agg(F.count("*").alias("n_corrections"), F.max("created_at").alias("last_correction"))
    u = units.groupBy("paper_id").agg(F.count("*").alias("body_units_count"))
    j = papers.select("paper_id").join(n, "paper_id", "left").join(c, "paper_id", "left").join(u, "paper_id", "left")
    count = lambda c_: F.coalesce(c_, F.lit(0)).cast("long").alias(c_)
    return j.select("paper_id", count("n_notes"), F.coalesce("recheck", F.lit("")).alias("recheck"), count("n_corrections"), "last_correction", count("body_units_count"), (F.coalesce("body_units_count", F.lit(0)) > 0).alias("fulltext_available"))


def context_filter(items: DataFrame, key: str = "", domain: str = "", collection: str = "") -> DataFrame:
    """Entries by key, else by domain, else by the beginning of any of their collections; all without any of these."""
    if key:
        return items.filter(F.col("paper_id").cast("string") == key)
    if domain:
        return items.filter(F.col("domain") == domain)
    return items.filter(F.exists("collections", lambda c: c.startswith(collection))) if collection else items


def matches(hits: DataFrame, source: str = "") -> DataFrame:
    """Hits of any arm in one shape: blank texts and zero scores where an arm has none."""
    have = set(hits.columns)
    blank = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(""))
    kind = F.lit(source) if source else blank("source")
    score = F.coalesce("score", F.lit(0.0)) if "score" in have else F.lit(0.0)
    return hits.select(
        "paper_id", blank("unit_id").alias("unit_id"), blank("source_kind", "source").alias("source_kind"), (kind if source else F.lit("standard")).alias("retrieval_mode"), score.alias("score"),
        blank("chunk_text", "unit_text", "text").alias("text"), blank("section_path", "heading").alias("heading"), blank("title").alias("title"), blank("year").alias("year"),
    )


def paper_scope(papers: DataFrame, units: DataFrame, vectors: DataFrame, text_only: bool = False) -> DataFrame:
    """Per paper whether it can be searched: ok, fulltext_unavailable, stale (vectors without a unit) or not_built. vectors: paper_id, unit_id."""
    u = units.select("paper_id").distinct().withColumn("_u", F.lit(True))
    v = vectors.groupBy("paper_id").agg(F.count_if(F.coalesce("unit_id", F.lit("")) != "").alias("_valid"), F.count("*").alias("_any"))
    j = papers.select("paper_id").join(u, "paper_id", "left").join(v, "paper_id", "left")
    built = (F.coalesce("_valid", F.lit(0)) > 0) | F.lit(text_only)
    return j.select("paper_id", F.when(F.col("_u").isNull(), "fulltext_unavailable").when(built, "ok").when(F.coalesce("_any", F.lit(0)) > 0, "stale").otherwise("not_built").alias("state"))


def base_views(papers: DataFrame) -> dict[str, DataFrame]:
    """The saved views of a library: everything, texts to be read by OCR, papers to be read in depth. papers also: do_ocr, analyze."""
    return {
        "all": papers,
        "ocr_pending": papers.filter(F.col("do_ocr") & (F.col("ocr_status") == "pending")),
        "deep_pending": papers.filter(F.col("analyze") & (F.col("ocr_status") == "done") & (F.col("deep_status") == "pending")),
    }


def object_kind(figure_id: Column, role: Column) -> Column:
    return F.when(figure_id.isNotNull() | F.coalesce(role == "figure_caption", F.lit(False)), "figure").otherwise("table")


# Up to how many papers a literal search is run at once, or with a warning.
SEARCH_NOW, SEARCH_WARNED = 20, 60


def assess_scope(papers: DataFrame, terms: list[str]) -> DataFrame:
    """One row: the papers that a literal search would go through.

    The first domain (by name) that one of the terms is part of narrows it, else the first such collection, else the
    library counts whole. papers: domain, collections, lifecycle.
    """
    wanted = [t.strip().lower() for t in terms if t.strip()]
    has = lambda c: F.exists(F.array(*[F.lit(t) for t in wanted]).cast("array<string>"), lambda t: F.contains(F.lower(F.trim(c)), t))
    domain = papers.filter((F.col("domain") != "") & has(F.col("domain"))).agg(F.min("domain").alias("d"))
    found = papers.select(F.explode("collections").alias("c")).filter((F.col("c") != "") & has(F.col("c"))).agg(F.min("c").alias("c"))
    j = papers.crossJoin(F.broadcast(domain.crossJoin(found)))  # one row
    inside = F.when(F.col("d").isNotNull(), F.col("domain") == F.col("d")).when(F.col("c").isNotNull(), F.exists("collections", lambda x: x.startswith(F.col("c")))).otherwise(F.lit(True))
    ready = F.col("lifecycle").isin("fulltext_ready", "deep_read_done", "ai_context_ready")
    one = j.agg(F.first("d").alias("_d"), F.first("c").alias("_c"), F.count_if(inside).alias("n"), F.count_if(inside & ready).alias("ready"))
    mode = F.when(F.col("n") <= SEARCH_NOW, "rg_now").when(F.col("n") <= SEARCH_WARNED, "rg_with_warning").otherwise("ask_user_before_broad_grep")
    source = F.when(F.col("_d").isNotNull(), "domain").when(F.col("_c").isNotNull(), "collection").otherwise("library")
    return one.select(source.alias("source"), F.coalesce("_d", "_c", F.lit("full library")).alias("label"), F.col("n").alias("estimated_paper_count"), F.col("ready").alias("fulltext_ready_count"), mode.alias("recommended_mode"))


def enrich_plan(plans: DataFrame, papers: DataFrame, vectors_available: bool) -> DataFrame:
    """Plans whose identifier names exactly one paper are scoped to it; others with an identifier become an exact search.

    plans: id, intent, command, identifier. papers: paper_id and names (array of lower-cased identifiers).
    """
    # papers of a name are one row before the join: the ids met are one where the least is the greatest
    known = papers.select("paper_id", F.explode("names").alias("_name")).groupBy("_name").agg(F.min("paper_id").alias("_p"), F.max("paper_id").alias("_q"))
    hits = plans.filter("identifier is not null").join(known, F.lower("identifier") == F.col("_name")).groupBy("id").agg(F.min("_p").alias("_p"), F.max("_q").alias("_q"))
    j = plans.join(hits, "id", "left")
    one = F.coalesce(F.col("_p") == F.col("_q"), F.lit(False))
    command = F.when(one & (F.col("intent") == "content"), "retrieve").when(one & (F.col("intent") == "locate"), "paper-context").when(F.col("identifier").isNotNull() & ~one, "search").otherwise(F.col("command"))
    lacking = (F.col("intent") == "content") & F.lit(not vectors_available)
    return j.select("id", "intent", command.alias("command"), F.when(one, "paper").otherwise("library").alias("scope"), F.when(one, F.col("_p")).alias("paper_key"), lacking.alias("retrieve_unavailable"))


def existing_candidate(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming with the known candidate it is: the one of its candidate_id, else the first (by id) with its doi, pmid or title.

    Blank keys match nothing. Both: candidate_id, doi, pmid, title.
    """
    keys = lambda p: F.array(*[F.struct(F.lit(n).alias("kind"), F.nullif(F.trim(F.regexp_replace(F.lower(F.col(n)), r"\s+", " ")), F.lit("")).alias("value")) for n in ("doi", "pmid", "title")])
    have = known.select(F.col("candidate_id").alias("_id"), F.explode(keys("k")).alias("_k")).filter("_k.value is not null")
    first = have.groupBy("_k").agg(F.min("_id").alias("_id"))
    asked = incoming.select("candidate_id", F.explode(keys("i")).alias("_k")).filter("_k.value is not null")
    by_key = asked.join(first, "_k").groupBy("candidate_id").agg(F.min("_id").alias("_by_key"))
    same = known.select("candidate_id").distinct().withColumn("_same", F.col("candidate_id"))
    return incoming.join(same, "candidate_id", "left").join(by_key, "candidate_id", "left").withColumn("existing_id", F.coalesce("_same", "_by_key")).drop("_same", "_by_key")


def candidate_payload(rows: DataFrame) -> DataFrame:
    """Candidate rows with their defaults: source, confidence, import status, status."""
    or_ = lambda c, d: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(d) if isinstance(d, str) else d)
    out = rows.withColumn("title", or_("title", "")).withColumn("source", or_("source", "candidate_ingest"))
    return out.withColumn("source_type", or_("source_type", F.col("source"))).withColumn("import_status", or_("import_status", "pending")).withColumn("confidence", or_("confidence", "0")).withColumn("status", F.lit("candidate"))


def writeback_command(collection: Column, existing: Column, doi: Column, pmid: Column) -> Column:
    """What is done with an accepted candidate: struct(action, identifier_type, identifier); null without a collection."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    made = lambda a, kind, c: F.struct(F.lit(a).alias("action"), F.lit(kind).alias("identifier_type"), F.trim(c).alias("identifier"))
    none = F.lit("")
    return F.when(has(collection), F.when(has(existing), made("attach_existing_item_to_collection", "item", existing)).when(has(doi), made("create_item_from_identifier", "doi", doi)).when(has(pmid), made("create_item_from_identifier", "pmid", pmid)).otherwise(made("create_item_from_metadata", "", none)))
