"""Page geometry: clusters, bands, columns, captions and assets, headings, tail boundaries.

Ordered scans are windows (gaps and islands) wherever their state is a running flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(rows: DataFrame, by: str, value: str, tolerance: Column | float, tie: str) -> DataFrame:
    """rows with their cluster in the group: values further than tolerance from the one before begin a new one."""
    order = Window.partitionBy(by).orderBy(value, tie)
    tol = F.lit(tolerance) if isinstance(tolerance, (int, float)) else tolerance
    new = F.coalesce((F.col(value) - F.lag(value).over(order) > tol).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def cluster_stats(clustered: DataFrame, by: str, value: str) -> DataFrame:
    """Per cluster: size, range, and the upper middle value."""
    g = clustered.groupBy(by, "cluster").agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.array_sort(F.collect_list(value)).alias("_v"))
    return g.withColumn("middle", F.get("_v", F.floor(F.size("_v") / 2).cast("int"))).drop("_v")


def header_band(edges: DataFrame, by: str, page: str, edge: str, tolerance: float) -> DataFrame:
    """Per document: the header's lower edge, from the largest cluster of its pages' edges if at least two pages and a fifth of all share it.

    edges: one row for each candidate block; a page's edge is its lowest.
    """
    pages = edges.groupBy(by, page).agg(F.max(edge).alias("v"))
    c = gap_clusters(pages, by, "v", tolerance, page)
    g = c.groupBy(by, "cluster").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.array_sort(F.collect_list("v")).alias("vs"))
    total = pages.groupBy(by).agg(F.count("*").alias("pages"))
    best = g.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "least"))).filter("_r = 1").join(total, by)
    enough = F.col("n") >= F.greatest(F.lit(2), F.ceil(0.2 * F.col("pages")))
    return best.select(by, "pages", "n", F.when(enough, F.get("vs", F.ceil(0.9 * (F.col("n") - 1)).cast("int"))).alias("band"), F.when(enough, "accept").otherwise("hold").alias("status"))


def column_order(blocks: DataFrame, page: str, x: str, y: str, width: float, key: str) -> DataFrame:
    """Reading order on each page: by column (left or right half), then from top to bottom."""
    column = F.when(F.col(x) < width / 2, 0).otherwise(1)
    return blocks.withColumn("col", column).withColumn("ord", F.row_number().over(Window.partitionBy(page).orderBy("col", y, x, key)).cast("long"))


def reading_segments(blocks: DataFrame, page: str, column: str, order: str) -> DataFrame:
    """Runs of blocks that are read one after the other in the same column, numbered on each page."""
    w = Window.partitionBy(page).orderBy(order)
    new = F.coalesce((F.col(column) != F.lag(column).over(w)).cast("int"), F.lit(0))
    return blocks.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w)).drop("_new")


def block_order(blocks: DataFrame, page: str, key: str) -> DataFrame:
    """Blocks with an order first, by it; the others by y, then x."""
    w = Window.partitionBy(page).orderBy(F.col("block_order").isNull(), "block_order", "y", "x", key)
    return blocks.withColumn("ord", F.row_number().over(w))


def x_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Shared width over the narrower one's width."""
    width = F.least(a2 - a1, b2 - b1)
    return F.when(width > 0, F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1)) / width).otherwise(0.0)


def caption_score(text: Column, nearby: Column, styled: Column, prose: Column) -> Column:
    numbered = F.lower(text).rlike(r"(?:^|[^a-z])fig(?:ure|\.)?\s*s?[0-9]+")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(numbered, 0.4).otherwise(0.0) + F.when(nearby, 0.3).otherwise(0.0) + F.when(styled, 0.2).otherwise(0.0) - F.when(prose, 0.5).otherwise(0.0)))


def caption_decision(score: Column) -> Column:
    return F.when(score >= 0.7, "figure_caption").when(score >= 0.4, "figure_caption_candidate").otherwise("rejected")


def figure_match(legends: DataFrame, assets: DataFrame, page: str) -> DataFrame:
    """Every legend and asset of a page with a match score and decision. Both: id, x1, y1, x2, y2; legends also caption (their score)."""
    a = legends.select(page, *[F.col(c).alias(f"l_{c}") for c in ("id", "x1", "y1", "x2", "y2", "caption")])
    b = assets.select(page, *[F.col(c).alias(f"a_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    p = a.join(b, page)
    c = F.col
    over = x_overlap(c("l_x1"), c("l_x2"), c("a_x1"), c("a_x2")) >= 0.4
    gap = F.greatest(F.lit(0.0), c("a_x1") - c("l_x2"), c("l_x1") - c("a_x2"))
    beside = ~over & (gap < 0.3 * F.least(c("l_x2") - c("l_x1"), c("a_x2") - c("a_x1"))) & (gap < 80)
    near = F.least(F.abs(c("l_y1") - c("a_y2")), F.abs(c("a_y1") - c("l_y2"))) <= 300
    apart = (c("a_y2") <= c("l_y1")) | (c("a_y1") >= c("l_y2"))
    raw = 0.3 + F.when(over, 0.25).when(beside, 0.2).otherwise(0.0) + F.when(near, 0.2).otherwise(0.0) + F.when(apart, 0.1).otherwise(0.0) + F.least(F.lit(0.15), c("l_caption") * 0.15)
    score = F.when(c("l_caption") < 0.4, c("l_caption")).otherwise(F.least(F.lit(1.0), raw))
    decision = F.when(c("l_caption") < 0.4, "rejected").when((score >= 0.6) & (over | beside), "matched").when(score >= 0.4, "ambiguous").otherwise("rejected")
    return p.select(page, c("l_id").alias("legend_id"), c("a_id").alias("asset_id"), F.round(score, 4).alias("score"), decision.alias("decision"))


def insert_score(text: Column, container: Column, width: Column, page_width: Column, coherent: Column, spine: Column) -> Column:
    t = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    boxed = t.rlike(r"^box\s*\.?\s*[0-9]+") | F.contains(t, F.lit("key point")) | t.startswith("highlights") | t.startswith("sections")
    side = t.rlike("available with this article|supplementary data|supporting information")
    parts = ((container, 0.45), (boxed, 0.3), (side, 0.2), (width < 0.45 * page_width, 0.15), (coherent, 0.15), (spine, -0.25))
    total = F.lit(0.0)
    for c, w in parts:
        total = total + F.when(c, w).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def tail_boundary(forward: Column, backward: Column, reference: Column) -> Column:
    return F.when(forward < backward, 0.4).otherwise(0.0) + F.when(backward - forward <= 2, 0.2).otherwise(0.0) + F.when(reference >= forward, 0.3).otherwise(0.0)


def heading_intervals(headings: DataFrame, by: str, last: DataFrame) -> DataFrame:
    """Each heading's end: just before the next heading of the same or a higher level, else the document's last position.

    headings: by, ord, level. For each of the (at most 6) levels a window finds the next heading at or above it.
    """
    order = Window.partitionBy(by).orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") <= k, F.col("ord"))).over(order) for k in range(1, 7)]
    rows = headings.withColumn("_next", F.element_at(F.array(*nexts), F.col("level"))).join(last, by)
    return rows.withColumn("end", F.coalesce(F.col("_next") - 1, F.col("last"))).drop("_next", "last")


def owning_heading(intervals: DataFrame, blocks: DataFrame, by: str) -> DataFrame:
    """Each block with the last heading whose interval holds it ('' before any).

    Headings and blocks are one sequence. The last heading of each of the (at most 6) levels so far is a window; of
    those whose interval reaches the block the last one owns it.
    """
    heads = intervals.select(by, "ord", "level", "end", "title", F.lit(True).alias("_head"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = blocks.withColumn("_block", F.struct(*blocks.columns)).select(by, "ord", none("int").alias("level"), none("long").alias("end"), none("string").alias("title"), F.lit(False).alias("_head"), "_block")
    both = rows.unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("ord", F.desc("_head")).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("_head") & (F.col("level") == k), F.struct(F.col("ord").alias("o"), F.col("end").alias("e"), F.col("title").alias("t"))), ignorenulls=True).over(w) for k in range(1, 7)]
    holds = F.filter(F.array(*last), lambda x: x.isNotNull() & (x.e >= F.col("ord")))
    owned = both.withColumn("_own", F.array_max(holds)).filter(~F.col("_head"))
    return owned.select("_block.*", F.coalesce("_own.t", F.lit("")).alias("title"))


def nearby(blocks: DataFrame, anchors: DataFrame, page: str, distance: float) -> DataFrame:
    """Pairs of an anchor and a block of its page whose boxes are at most distance apart."""
    a = anchors.select(page, *[F.col(c).alias(f"a_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    dx = F.greatest(F.lit(0.0), F.col("x1") - F.col("a_x2"), F.col("a_x1") - F.col("x2"))
    dy = F.greatest(F.lit(0.0), F.col("y1") - F.col("a_y2"), F.col("a_y1") - F.col("y2"))
    return blocks.join(a, page).filter((F.col("id") != F.col("a_id")) & (F.sqrt(dx * dx + dy * dy) <= distance))


def drop_cover(blocks: DataFrame, by: str) -> DataFrame:
    """Without the first page of documents where it holds a cover marker and no body or heading."""
    first = F.col("page") == 1
    cover = blocks.groupBy(by).agg((F.bool_or(first & F.lower("text").rlike("pre-?proof|accepted manuscript")) & ~F.bool_or(first & F.col("role").isin("body_paragraph", "section_heading"))).alias("cover"))
    return blocks.join(cover, by).filter(~(F.col("cover") & first)).drop("cover")


def body_end(pages: DataFrame, by: str) -> DataFrame:
    """The last body page before the first tail page that follows a body page. pages: by, page, has_body, has_tail."""
    order = Window.partitionBy(by).orderBy("page")
    w = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumn("_before", F.max(F.when(F.col("has_body"), F.col("page"))).over(w))
    stop = rows.filter(F.col("has_tail") & F.col("_before").isNotNull()).groupBy(by).agg(F.min("page").alias("_stop"))
    body = pages.filter("has_body").join(stop, by, "left").filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop")))
    return body.groupBy(by).agg(F.max("page").alias("body_end"))


def islands(rows: DataFrame, by: str, page: str) -> DataFrame:
    """Runs of seeds on consecutive pages."""
    order = Window.partitionBy(by).orderBy(page)
    new = F.coalesce((F.col(page) - F.lag(page).over(order) > 1).cast("int"), F.lit(0))
    return rows.withColumn("_n", new).withColumn("island", F.sum("_n").over(order)).drop("_n")


def fill_between(blocks: DataFrame, by: str, anchor: str) -> DataFrame:
    """Blocks strictly between two anchors, with the numbers of both."""
    order = Window.partitionBy(by).orderBy("ord")
    before = F.last(F.when(F.col(anchor).isNotNull(), F.col(anchor)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.col(anchor).isNotNull(), F.col(anchor)), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return blocks.withColumn("before", before).withColumn("after", after).filter(F.col(anchor).isNull() & F.col("before").isNotNull() & F.col("after").isNotNull())


def promote_neighbours(figures: DataFrame, by: str) -> DataFrame:
    """Ambiguous figures with assets whose number is next to a matched one's; no chains."""
    near = figures.filter("status = 'matched'").select(by, F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("number")).distinct()
    promoted = figures.filter("status = 'ambiguous' and n_assets > 0").join(near, [by, "number"], "left_semi").select(by, "number", F.lit(True).alias("_p"))
    return figures.join(promoted, [by, "number"], "left").withColumn("status", F.when(F.col("_p"), "promoted").otherwise(F.col("status"))).drop("_p")


def resolve_conflicts(figures: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Assets claimed as figure and as table: the stronger claim wins, ties keep both."""
    both = figures.select(*keys, F.col("strength").alias("f")).join(tables.select(*keys, F.col("strength").alias("t")), keys, "full_outer")
    return both.withColumn("winner", F.when(F.col("t").isNull() | (F.col("f") > F.col("t")), "figure").when(F.col("f").isNull() | (F.col("t") > F.col("f")), "table").otherwise("both"))
