"""Registered queries of document structure, pages, tables, layers' states, identities, sources and sinks, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.bridge import PAPERS_SQL, UNITS_SQL, papers, table, units
from litmill.functions import text as tx
from litmill.operators import aggregate, blocks, context, derive, diff, lineage, logs, ocr, quality, structure, tables, vectors
from litmill.operators import units as un
from litmill.queries import _BOX_SQL, _L2, _ROLE_SQL, _TAGS_SQL, SQL, _rects, _tags, _vector, chunk_fulltext, query
from litmill.sources import readers
from litmill.sources.store import Store, VectorStore, verify_vectors

# ---- blocks ----


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of pages with page numbers of twelve blocks each and a text."""
    t = _tags(spark, sf)
    return t.withColumn("page", (F.floor(F.col("ord") / 12) + 1).cast("int")).withColumn("text", F.concat_ws(" ", "tag", F.col("ord").cast("string")))


_ROLES_SQL = f"{_TAGS_SQL}, roles as (select paper_id, ord, tag, {_ROLE_SQL} as role, (ord // 12 + 1)::int as page, tag || ' ' || ord as text, ord::varchar as block_id from tags)"


@query(f"with {_ROLES_SQL} select paper_id, role, string_agg(block_id, ',' order by page, ord) as ids from roles group by 1, 2")
def role_index(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.role_index(_roles(spark, sf)).select("paper_id", "role", F.array_join("block_ids", ",").alias("ids"))


@query(f"with {_ROLES_SQL} select paper_id, count(*) filter (role = 'section_heading') as n_section_heading, count(*) filter (role = 'table') as n_table, count(*) filter (role = 'section_heading') > 0 as has_section_heading, count(*) filter (role = 'table') > 0 as has_table from roles group by 1")
def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.evidence_summary(_roles(spark, sf), ["section_heading", "table"])


@query(f"""with {_ROLES_SQL}, z as (select *, max(case when role = 'section_heading' then 1 else 0 end) over w as started, max(case when tag = 'li' then 1 else 0 end) over w as refs from roles window w as (partition by paper_id order by page, ord))
  select paper_id, ord, case when refs = 1 and tag = 'li' then 'references' when refs = 1 then 'tail' when started = 1 then 'body' else 'frontmatter' end as zone from z""")
def zones(spark: SparkSession, sf: str) -> DataFrame:
    b = _roles(spark, sf).withColumn("role", F.when(F.col("tag") == "li", "reference_item").otherwise(F.col("role")))
    return structure.zones(b).select("paper_id", "ord", "zone")


@query(f"""with {_ROLES_SQL}, k as (select *, row_number() over (partition by paper_id, page order by ord) = 1 as first from roles where role <> 'other'),
  l as (select *, case when role = 'section_heading' then '## ' || text else text end as line from k) select paper_id, md5(string_agg(case when first then '<!-- page ' || page || ' -->' || chr(10) || chr(10) || line else line end, chr(10) || chr(10) order by page, ord)) as digest from l group by 1""")
def rendered(spark: SparkSession, sf: str) -> DataFrame:
    b = _roles(spark, sf).withColumn("role", F.when(F.col("role") == "other", "noise").when(F.col("role") == "table", "body_paragraph").otherwise(F.col("role")))
    return structure.render(b).select("paper_id", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query(f"with {_ROLES_SQL} select paper_id, ord, page, 1 as level, text as title from roles where role = 'section_heading'")
def heading_events(spark: SparkSession, sf: str) -> DataFrame:
    return structure.heading_events(_roles(spark, sf))


def _heads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = _tags(spark, sf)
    heads = t.filter("role = 'section_heading'").select("paper_id", "ord", F.substring("tag", 2, 1).cast("int").alias("level"), F.concat(F.lit("h"), F.col("ord").cast("string")).alias("title"))
    return t, blocks.heading_intervals(heads, "paper_id", t.groupBy("paper_id").agg(F.max("ord").alias("last")))


_HEADS_SQL = f"""{_TAGS_SQL}, h as (select paper_id, ord, tag[2]::int as level from tags where tag[1] = 'h'), m as (select paper_id, max(ord) as last from tags group by 1),
  iv as (select h.paper_id, h.ord, h.level, coalesce((select min(n.ord) - 1 from h n where n.paper_id = h.paper_id and n.ord > h.ord and n.level <= h.level), m.last) as e from h join m using (paper_id))"""


@query(f"""with {_HEADS_SQL}, p as (select a.paper_id, a.ord, a.level, a.e, (select max(b.ord) from iv b where b.paper_id = a.paper_id and b.ord < a.ord and b.e >= a.ord and b.level < a.level) as parent, (select count(*) from iv b where b.paper_id = a.paper_id and b.ord < a.ord and b.e >= a.ord and b.level < a.level)::int + 1 as depth from iv a)
  select paper_id, ord, parent, depth, (select count(*) from p c where c.paper_id = p.paper_id and c.parent = p.ord) as children, e - ord as subtree_blocks, row_number() over (partition by paper_id order by ord) as document_order from p""")
def compact_tree(spark: SparkSession, sf: str) -> DataFrame:
    _, intervals = _heads(spark, sf)
    return context.compact_tree(intervals.select("paper_id", "ord", "level"), intervals)


@query(f"with {_HEADS_SQL} select t.paper_id, t.ord, coalesce('h' || (select max(iv.ord) from iv where iv.paper_id = t.paper_id and iv.ord <= t.ord and t.ord <= iv.e), '') as title from tags t")
def owning_section(spark: SparkSession, sf: str) -> DataFrame:
    t, intervals = _heads(spark, sf)
    return blocks.owning_heading(intervals, t.select("paper_id", "ord"), "paper_id").select("paper_id", "ord", "title")


@query(f"""with {_ROLES_SQL}, p as (select paper_id, page, bool_or(role = 'body_paragraph') as b, bool_or(tag = 'li') as t from roles group by 1, 2), s as (select paper_id, min(page) as stop from p x where t and exists (select 1 from p y where y.paper_id = x.paper_id and y.page < x.page and y.b) group by 1)
  select paper_id, max(page) as body_end from p left join s using (paper_id) where b and (stop is null or page < stop) group by 1""")
def body_end(spark: SparkSession, sf: str) -> DataFrame:
    pages = _roles(spark, sf).groupBy("paper_id", "page").agg(F.bool_or(F.col("role") == "body_paragraph").alias("has_body"), F.bool_or(F.col("tag") == "li").alias("has_tail"))
    return blocks.body_end(pages, "paper_id")


@query(f"with {_ROLES_SQL} select paper_id, min(page) as backmatter_start from roles where ord % 17 = 16 group by 1")
def backmatter_start(spark: SparkSession, sf: str) -> DataFrame:
    b = _roles(spark, sf).withColumn("role", F.when(F.col("ord") % 17 == 16, "reference_heading").otherwise("body_paragraph"))
    return ocr.backmatter_start(b)


@query("with s as (select p_partkey as k, p_size % 9 as f, p_size % 11 as b, p_size % 10 as r from part) select k, round(case when f < b then 0.4 else 0 end + case when b - f <= 2 then 0.2 else 0 end + case when r >= f then 0.3 else 0 end, 4)::double as score from s")
def tail_boundary(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_size")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.round(blocks.tail_boundary(p % 9, p % 11, p % 10), 4).alias("score"))


@query("with s as (select distinct user_id, (event_id % 50)::int as page from events where event_type = 'error'), n as (select *, case when page - lag(page) over (partition by user_id order by page) > 1 then 1 else 0 end as new from s) select user_id, page, (sum(new) over (partition by user_id order by page))::bigint as island from n")
def abstract_islands(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").filter("event_type = 'error'").select("user_id", (F.col("event_id") % 50).cast("int").alias("page")).distinct()
    return blocks.islands(s, "user_id", "page")


@query("""with b as (select l_orderkey as k, l_linenumber as ord, case when l_linenumber % 3 = 1 then l_linenumber end as number from lineitem), w as (select *, last_value(number ignore nulls) over (partition by k order by ord rows between unbounded preceding and 1 preceding) as before, first_value(number ignore nulls) over (partition by k order by ord rows between 1 following and unbounded following) as after from b)
  select k, ord, before, after from w where number is null and before is not null and after is not null""")
def reference_fill(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("ord"), F.when(n % 3 == 1, n).alias("number"))
    return blocks.fill_between(b, "k", "number").select("k", "ord", "before", "after")


_FIGURES_SQL = "figs as (select l_orderkey as paper_id, l_linenumber as number, case l_returnflag when 'A' then 'matched' when 'R' then 'ambiguous' else 'unmatched' end as status, (l_partkey % 3)::bigint as n_assets from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey))"


def _figures(spark: SparkSession, sf: str) -> DataFrame:
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("x")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("number")).agg(first)
    return rows.select("paper_id", "number", F.when(F.col("x.l_returnflag") == "A", "matched").when(F.col("x.l_returnflag") == "R", "ambiguous").otherwise("unmatched").alias("status"), (F.col("x.l_partkey") % 3).cast("long").alias("n_assets"))


@query(f"with {_FIGURES_SQL} select paper_id, number, case when status = 'ambiguous' and n_assets > 0 and exists (select 1 from figs m where m.paper_id = f.paper_id and m.status = 'matched' and abs(m.number - f.number) = 1) then 'promoted' else status end as status from figs f")
def sequence_promotion(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.promote_neighbours(_figures(spark, sf), "paper_id").select("paper_id", "number", "status")


@query(f"with {_FIGURES_SQL}, g as (select paper_id, number % 3 as number, n_assets from figs) select paper_id, number, n_assets, count(*) as n from g a where n_assets > 0 or not exists (select 1 from g b where b.paper_id = a.paper_id and b.number = a.number and b.n_assets > 0) group by 1, 2, 3")
def ghost_suppression(spark: SparkSession, sf: str) -> DataFrame:
    f = _figures(spark, sf).withColumn("number", F.col("number") % 3)
    return structure.suppress_ghosts(f).groupBy("paper_id", "number", "n_assets").agg(F.count("*").alias("n"))


@query(f"with {_FIGURES_SQL} select paper_id, count(*) as total, count(*) filter (status = 'matched' or status = 'ambiguous' or n_assets = 0) as accounted, count(*) filter (status = 'unmatched' and n_assets > 0) as gaps from figs group by 1")
def figure_completeness(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("status")
    f = _figures(spark, sf).select("paper_id", (s == "matched").alias("matched"), F.lit(False).alias("held"), (s == "ambiguous").alias("ambiguous"), ((s == "unmatched") & (F.col("n_assets") == 0)).alias("unmatched"), F.lit(False).alias("duplicate"))
    return aggregate.figure_completeness(f)


@query(f"""with {_FIGURES_SQL}, a as (select paper_id, number from figs where status <> 'unmatched'), b as (select paper_id, number from figs where n_assets > 0), c as (select paper_id, number from figs where number <> 2), k as (select * from a union select * from b union select * from c)
  select * from (select paper_id, number, exists (select 1 from a where a.paper_id = k.paper_id and a.number = k.number) as in_text, exists (select 1 from b where b.paper_id = k.paper_id and b.number = k.number) as as_figure, exists (select 1 from c where c.paper_id = k.paper_id and c.number = k.number) as has_media from k) where not (in_text and as_figure and has_media)""")
def figure_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    f = _figures(spark, sf)
    return structure.reconcile_figures(f.filter("status != 'unmatched'"), f.filter("n_assets > 0"), f.filter("number != 2"))


@query(f"with {_FIGURES_SQL}, a as (select paper_id, number, n_assets::varchar as d from figs where number <> 3), b as (select paper_id, number, (case when paper_id % 5 = 0 then 9 else n_assets end)::varchar as d from figs where status <> 'unmatched') select paper_id, number, case when b.d is null then 'not_rendered' when a.d is null then 'not_in_inventory' else 'stale' end as issue from a full join b using (paper_id, number) where a.d is null or b.d is null or a.d <> b.d")
def render_audit(spark: SparkSession, sf: str) -> DataFrame:
    f = _figures(spark, sf)
    a = f.filter("number != 3").select("paper_id", "number", F.col("n_assets").cast("string").alias("digest"))
    b = f.filter("status != 'unmatched'").select("paper_id", "number", F.when(F.col("paper_id") % 5 == 0, "9").otherwise(F.col("n_assets").cast("string")).alias("digest"))
    return structure.render_audit(a, b, ["paper_id", "number"]).select("paper_id", "number", "issue")


@query("""with f as (select l_orderkey as page, l_linenumber as asset, max(l_quantity) as f from lineitem where l_returnflag <> 'N' group by 1, 2), t as (select l_orderkey as page, l_linenumber as asset, max(l_discount * 400) as t from lineitem where l_returnflag <> 'R' group by 1, 2)
  select page, asset, case when t is null or f > t then 'figure' when f is null or t > f then 'table' else 'both' end as winner from f full join t using (page, asset)""")
def media_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "page", "l_linenumber": "asset"})
    f = rows.filter("l_returnflag != 'N'").groupBy("page", "asset").agg(F.max("l_quantity").alias("strength"))
    t = rows.filter("l_returnflag != 'R'").groupBy("page", "asset").agg(F.max(F.col("l_discount") * 400).alias("strength"))
    return blocks.resolve_conflicts(f, t, ["page", "asset"]).select("page", "asset", "winner")


@query(f"""with {_BOX_SQL} select b.page, b.id, a.id as a_id from boxes b join boxes a on a.page = b.page and a.id <> b.id and a.id % 10 = 0
  where sqrt(greatest(0, b.x1 - a.x2, a.x1 - b.x2) ** 2 + greatest(0, b.y1 - a.y2, a.y1 - b.y2) ** 2) <= 30""")
def nearby_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = _rects(spark, sf)
    return blocks.nearby(b, b.filter("id % 10 = 0"), "page", 30.0).select("page", "id", "a_id")


@query(f"with {_BOX_SQL}, o as (select *, case when id % 3 = 0 then id % 7 end as bo from boxes) select page, id, (row_number() over (partition by page order by bo is null, bo, y1, x1, id))::int as ord from o")
def block_order(spark: SparkSession, sf: str) -> DataFrame:
    b = _rects(spark, sf).withColumn("block_order", F.when(F.col("id") % 3 == 0, F.col("id") % 7)).withColumnsRenamed({"x1": "x", "y1": "y"})
    return blocks.block_order(b, "page", "id").select("page", "id", "ord")


@query(f"with {_BOX_SQL}, p as (select page as paper_id, id % 5 as page, id as ord, x1 as x, y1 as y from boxes), r as (select *, row_number() over (partition by paper_id, page order by case when x < 0 then 0 else 1 end, y, x, ord) as place, row_number() over (partition by paper_id, page order by ord) as was from p) select paper_id, page, ord, place, place <> was as moved from r")
def column_interleaving(spark: SparkSession, sf: str) -> DataFrame:
    b = _rects(spark, sf).select(F.col("page").alias("paper_id"), (F.col("id") % 5).alias("page"), F.col("id").alias("ord"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return ocr.interleaved(b, 0.0).select("paper_id", "page", "ord", "place", "moved")


@query("with c as (select label as page, count(*) as n from embeddings group by label, floor(embedding[1]::double * 4)) select page, count(*) as columns, case when count(*) >= 3 then 'multi_column' when count(*) = 2 then 'two_column' else 'single_column' end as regime from c where n >= 2 group by 1")
def page_layouts(spark: SparkSession, sf: str) -> DataFrame:
    x = F.floor(F.get("embedding", F.lit(0)).cast("double") * 4)
    return structure.page_layout(table(spark, sf, "embeddings").groupBy(F.col("label").alias("page"), x.alias("c")).agg(F.count("*").alias("n")))


@query(f"with {_BOX_SQL} select page, id, case when id % 4 = 0 then true else not (y2 <= -20 or y1 >= 60) end as usable from boxes")
def usable_content(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("id") % 4 == 0, "reference_item").otherwise("body_paragraph")
    return _rects(spark, sf).select("page", "id", structure.usable_content(role, F.col("y1"), F.col("y2"), F.lit(-20.0), F.lit(60.0)).alias("usable"))


@query("with s as (select p_partkey as k, p_size, 'Figure ' || p_size || '. x' as t from part) select k, round(greatest(0, least(1, (case when k % 2 = 0 then 0.4 else 0 end) + (case when p_size > 20 then 0.3 else 0 end) + (case when p_size % 2 = 0 then 0.2 else 0 end) - (case when p_size % 5 = 0 then 0.5 else 0 end))), 4)::double as score from s")
def caption_scores(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("p_partkey"), F.col("p_size")
    t = F.when(k % 2 == 0, F.concat(F.lit("See Fig. "), p.cast("string"))).otherwise("A plain sentence")
    return table(spark, sf, "part").select(k.alias("k"), F.round(blocks.caption_score(t, p > 20, p % 2 == 0, p % 5 == 0), 4).alias("score"))


@query("with s as (select p_partkey as k, p_size from part) select k, round(greatest(0, least(1, (case when k % 2 = 0 then 0.45 else 0 end) + (case when k % 3 = 0 then 0.3 else 0 end) + (case when p_size < 22.5 then 0.15 else 0 end) + (case when k % 5 = 0 then 0.15 else 0 end) - (case when k % 7 = 0 then 0.25 else 0 end))), 4)::double as score from s")
def insert_scores(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("p_partkey"), F.col("p_size")
    t = F.when(k % 3 == 0, "Box 1. Key point").otherwise("Plain")
    return table(spark, sf, "part").select(k.alias("k"), F.round(blocks.insert_score(t, k % 2 == 0, p, F.lit(50), k % 5 == 0, k % 7 == 0), 4).alias("score"))


@query(r"""with l as (select doc_id as paper_id, 1 as page, case when doc_id % 3 = 0 then 'Journal Pre-proof' else 'x' end as text, case when doc_id % 2 = 0 then 'noise' else 'body_paragraph' end as role from documents union all select doc_id, 2, 'y', 'body_paragraph' from documents),
  c as (select paper_id, bool_or(page = 1 and regexp_matches(lower(text), 'pre-?proof|accepted manuscript')) and not bool_or(page = 1 and role = 'body_paragraph') as cover from l group by 1) select paper_id, page, role from l join c using (paper_id) where not (cover and page = 1)""")
def cover_drop(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf, "documents")
    first = d.select(i.alias("paper_id"), F.lit(1).alias("page"), F.when(i % 3 == 0, "Journal Pre-proof").otherwise("x").alias("text"), F.when(i % 2 == 0, "noise").otherwise("body_paragraph").alias("role"))
    second = d.select(i.alias("paper_id"), F.lit(2).alias("page"), F.lit("y").alias("text"), F.lit("body_paragraph").alias("role"))
    return blocks.drop_cover(first.unionByName(second), "paper_id").select("paper_id", "page", "role")


@query("with r as (select p_partkey as k, p_brand as role, p_size as size, 0.9::double as c from part), p as (select p_brand as role, round(avg(p_size), 4) as m, round(stddev_pop(p_size), 4) as s from part group by 1) select k, round(case when abs(size - m) > 1.0 * greatest(s, 0.5) * 2 then c * 0.7 else c end, 4) as confidence from r join p using (role)")
def second_pass(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("role"), F.col("p_size").alias("size"), F.lit(0.9).alias("role_confidence"))
    profiles = aggregate.profile(p, "p_brand", "p_size").withColumnRenamed("p_brand", "role")
    return structure.cross_validate(rows, profiles).select("k", F.round("role_confidence", 4).alias("confidence"))


@query("with p as (select p_brand, count(*) as n, round(avg(p_size), 4) as m from part group by 1) select p_brand[1:7] as family, round(sum(m * n) / sum(n), 4) as mean_size, sum(n)::bigint as n from p group by 1")
def family_profiles(spark: SparkSession, sf: str) -> DataFrame:
    f = aggregate.weighted_family(aggregate.profile(table(spark, sf, "part"), "p_brand", "p_size"), F.substring("p_brand", 1, 7))
    return f.select("family", F.round("mean_size", 4).alias("mean_size"), "n")


@query("with s as (select l_returnflag as font, l_linenumber as size, l_linestatus as width, l_linenumber % 2 as x, (l_orderkey % 9)::int as page from lineitem) select font, size, width, x, count(*) as n, count(distinct page) as pages, min(page) as first_page from s group by 1, 2, 3, 4 having count(distinct page) >= 2 order by n desc, first_page, font, size, width, x limit 1")
def body_anchor(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("font"), F.col("l_linenumber").alias("size"), F.col("l_linestatus").alias("width"), (F.col("l_linenumber") % 2).alias("x"), (F.col("l_orderkey") % 9).cast("int").alias("page"))
    return aggregate.body_anchor(s)


@query("select l_orderkey as paper_id, avg((l_quantity > 25)::int) as coverage, case when avg((l_quantity > 25)::int) >= 0.7 then 'strong' when avg((l_quantity > 25)::int) >= 0.3 then 'moderate' else 'weak' end as grade from lineitem group by 1")
def span_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.span_coverage(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), (F.col("l_quantity") > 25).alias("has_span")))


@query("with s as (select l_orderkey as k, list({'size': l_linenumber, 'flags': case when l_returnflag = 'R' then 16 when l_returnflag = 'A' then 4 else 0 end, 'font': l_returnflag || l_linestatus, 'color': case when l_discount > 0.09 then 1 else 0 end}) as v from lineitem group by 1) select k, round(list_avg(list_transform(v, lambda s: s.size)), 6) as mean_size, list_max(list_transform(v, lambda s: s.size))::double as max_size, array_to_string(list_sort(list_distinct(list_transform(v, lambda s: s.font))), ',') as fonts, list_max(list_transform(v, lambda s: (s.flags = 16)::int)) = 1 as is_bold, list_max(list_transform(v, lambda s: (s.flags = 4)::int)) = 1 as is_italic, list_max(list_transform(v, lambda s: s.color)) = 1 as is_colored from s")
def span_profiles(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", 16).when(F.col("l_returnflag") == "A", 4).otherwise(0)
    span = F.struct(F.col("l_linenumber").cast("double").alias("size"), flag.alias("flags"), F.concat("l_returnflag", "l_linestatus").alias("font"), F.when(F.col("l_discount") > 0.09, 1).otherwise(0).alias("color"))
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(span).alias("v")).select("k", ocr.span_profile(F.col("v")).alias("p"))
    return s.select("k", F.round("p.mean_size", 6).alias("mean_size"), "p.max_size", F.array_join("p.font_families", ",").alias("fonts"), "p.is_bold", "p.is_italic", "p.is_colored")


@query("select 'returned' as flag, count(*) as n from lineitem where l_returnflag = 'R' union all select 'open', count(*) from lineitem where l_linestatus = 'O'")
def decision_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "O").alias("open"))
    return aggregate.flagged(rows, "l_orderkey", ["returned", "open"])


@query("with s as (select doc_id as paper_id, text as markdown, unnest(['the', 'zzz qqq', 'de', 'yyy']) as seg, unnest([1, 2, 3, 4]) as ord from documents), l as (select *, row_number() over (partition by paper_id order by ord) as r from s where not contains(markdown, seg)) select paper_id, count(*) as gaps, array_to_string(list_sort(list(seg) filter (r <= 3)), '|') as examples from l group by 1")
def gap_audit(spark: SparkSession, sf: str) -> DataFrame:
    segs = F.posexplode(F.array(*[F.lit(x) for x in ("the", "zzz qqq", "de", "yyy")])).alias("ord", "seg")
    s = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("markdown"), segs)
    return aggregate.gap_audit(s, "markdown", "seg", "paper_id").select("paper_id", "gaps", F.array_join("examples", "|").alias("examples"))


_BIO = "She received her degree. He is a professor at X. Research interests include y. Born in Z."


@query(f"select conv_id, turn, case when role = 'user' then {4} else 0 end + (case when length(case when role = 'user' then '{_BIO}' else text end) between 150 and 2000 then 1 else 0 end) + 0 as bio_score from conversations".replace("else text end)", "else '' end)"))
def author_bios(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", _BIO).otherwise("").alias("text"))
    return structure.author_bios(rows).select("conv_id", "turn", "bio_score")


@query("""with s as (select c_custkey as paper_id, case when c_custkey % 3 = 0 then '' else c_name end as a from customer), o as (select c_custkey as paper_id, case when c_custkey % 4 = 0 then null when c_custkey % 5 = 0 then ' other ' else upper(c_name) end as b from customer where c_custkey % 7 <> 0), j as (select paper_id, nullif(trim(a), '') as a, nullif(trim(b), '') as b from s full join o using (paper_id))
  select paper_id, coalesce(a, b) as title, case when a is not null and b is not null then case when lower(a) = lower(b) then 'both' else 'source_over_document' end when a is not null then 'source' when b is not null then 'document' end as title_from from j""")
def metadata_resolution(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    source = c.select(k.alias("paper_id"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("title"))
    found = c.filter("c_custkey % 7 != 0").select(k.alias("paper_id"), F.when(k % 4 == 0, None).when(k % 5 == 0, " other ").otherwise(F.upper("c_name")).alias("title"))
    return structure.resolve_metadata(source, found, ["title"])


@query(f"""with {_TAGS_SQL}, r as (select paper_id, ord, case when tag[1] = 'h' then 'section_heading' else 'body_paragraph' end as role, tag || ord as text from tags), n as (select *, case when role = 'section_heading' and lag(role) over (partition by paper_id order by ord) = 'section_heading' then 0 else 1 end as new from r),
  g as (select *, sum(new) over (partition by paper_id order by ord) as run from n), p as (select *, row_number() over (partition by paper_id, run order by ord) - 1 as at from g) select a.paper_id, a.ord, case when b.ord is null then a.text else a.text || ' ' || b.text end as text from p a left join p b on b.paper_id = a.paper_id and b.run = a.run and b.at = a.at + 1 where a.at % 2 = 0""")
def merged_headings(spark: SparkSession, sf: str) -> DataFrame:
    b = _tags(spark, sf).select("paper_id", "page", "ord", F.when(F.col("tag").startswith("h"), "section_heading").otherwise("body_paragraph").alias("role"), F.concat("tag", F.col("ord").cast("string")).alias("text"), F.array(*[F.lit(0.0)] * 4).alias("bbox"))
    return structure.merge_headings(b).select("paper_id", "ord", "text")


# ---- tables ----


def _table_boxes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = _rects(spark, sf).select(F.col("page").cast("long").alias("paper_id"), (F.col("id") % 4 + 1).cast("int").alias("page"), "id", "x1", "y1", "x2", "y2")
    captions = b.filter("id % 6 = 0").withColumn("number", F.col("id")).withColumn("continued", F.col("id") % 4 == 0)
    return captions, b.filter("id % 6 != 0")


@query(f"""with {_BOX_SQL}, b as (select page::bigint as paper_id, (id % 4 + 1)::int as page, id, x1, y1, x2, y2 from boxes), p as (select c.*, a.id as asset_id, a.page as a_page, a.x1 as ax1, a.x2 as ax2, a.y1 as ay1, a.y2 as ay2 from b c join b a on c.paper_id = a.paper_id and a.id % 6 <> 0 and abs(a.page - c.page) <= 1 where c.id % 6 = 0),
  s as (select *, case when a_page = page then 0.35 when a_page = page - 1 then 0.2 else 0 end + case when greatest(0, least(x2, ax2) - greatest(x1, ax1)) / least(x2 - x1, ax2 - ax1) >= 0.5 then 0.25 else 0 end + case when a_page = page and ay1 >= y2 then 0.25 when a_page = page - 1 then (case when y1 <= 160 then 0.1 else 0 end) + (case when ay2 >= 900 then 0.1 else 0 end) else 0 end + case when id % 4 = 0 and a_page = page then 0.15 else 0 end as raw from p)
  select paper_id, id as caption_id, asset_id, round(least(1.0, raw), 4)::double as score, case when id % 4 = 0 and round(least(1.0, raw), 4) >= 0.6 then 'continuation' when round(least(1.0, raw), 4) >= 0.6 then 'matched' else 'ambiguous' end as decision from s""")
def table_scores(spark: SparkSession, sf: str) -> DataFrame:
    return tables.scores(*_table_boxes(spark, sf)).select("paper_id", "caption_id", "asset_id", "score", "decision")


@query()
def table_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return tables.inventory(*_table_boxes(spark, sf))


@query(f"""with {_BOX_SQL}, t as (select page, id as asset_id, x1, x2, y2 from boxes where id % 6 = 1), n as (select page, id, x1, x2, y1 from boxes where id % 6 = 2)
  select t.page as paper_id, asset_id, min_by(n.id, {{'g': n.y1 - t.y2, 'i': n.id}}) as note_id from t join n using (page) where n.y1 - t.y2 between 0 and 60 and greatest(0, least(n.x2, t.x2) - greatest(n.x1, t.x1)) / least(n.x2 - n.x1, t.x2 - t.x1) >= 0.5 group by 1, 2""")
def table_notes(spark: SparkSession, sf: str) -> DataFrame:
    b = _rects(spark, sf).withColumn("paper_id", F.col("page")).withColumn("page", F.lit(1))
    return tables.notes(b.filter("id % 6 = 1").withColumnRenamed("id", "asset_id"), b.filter("id % 6 = 2 or id % 6 = 3").withColumn("text", F.when(F.col("id") % 6 == 2, "Note: values").otherwise("Prose")))


@query("select l_orderkey as paper_id, count(*) as captions, count(*) filter (l_returnflag = 'A') as matched, count(*) filter (l_returnflag = 'R') as ambiguous, count(*) filter (l_returnflag = 'N') as unmatched from lineitem group by 1")
def table_accounting(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("l_returnflag")
    return tables.accounting(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.when(s == "A", "matched").when(s == "R", "ambiguous").otherwise("unmatched").alias("status")))


# ---- states, identities, health ----


@query("""with s as (select o_orderkey as k, o_orderkey % 11 <> 0 as ex, case when o_orderkey % 7 = 0 then 'running' else '' end as lc, case when o_orderkey % 5 = 0 then 'raw_missing' end as raw, case when o_orderkey % 13 = 0 then 'incomplete' end as pub, case when o_orderkey % 3 = 0 then 'tree_inconsistent' end as tree, case when o_orderkey % 2 = 0 then 'role_index_missing' end as role from orders)
  select k, case when not ex then 'missing' when lc <> '' then lc when raw is not null then 'missing' when pub is not null then pub when coalesce(raw, tree, role) is not null then 'incomplete' end as state, coalesce(raw, tree, role) as detail from s""")
def ocr_states(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw, tree, role = F.when(k % 5 == 0, "raw_missing"), F.when(k % 3 == 0, "tree_inconsistent"), F.when(k % 2 == 0, "role_index_missing")
    detail = ocr.artifact_detail(raw, F.lit(""), F.lit(None).cast("string"), tree, role, F.lit(""))
    state = ocr.state(k % 11 != 0, F.when(k % 7 == 0, "running").otherwise(""), raw, F.when(k % 13 == 0, "incomplete"), detail)
    return table(spark, sf, "orders").select(k.alias("k"), state.alias("state"), detail.alias("detail"))


@query("with n as (select l_orderkey as paper_id, 'p1:' || l_linenumber as key from lineitem), b as (select l_orderkey as paper_id, 'p1:' || l_linenumber as key from lineitem where l_linenumber <> 3 and l_orderkey % 4 <> 0), d as (select distinct paper_id, key from n where paper_id in (select paper_id from b) and (paper_id, key) not in (select paper_id, key from b)) select paper_id, count(*) as dangling from d group by 1")
def tree_consistency(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.concat(F.lit("p1:"), F.col("l_linenumber").cast("string")).alias("key"), "l_linenumber")
    return ocr.dangling(rows.groupBy("paper_id").agg(F.collect_list("key").alias("keys")), rows.filter("l_linenumber != 3 and paper_id % 4 != 0"))


@query("select o_orderkey as k, case when o_orderkey % 3 = 0 then 'unknown' when o_orderkey % 3 = 1 then 'current' else 'old' end as currency, case when o_orderkey % 4 = 0 or o_orderkey % 5 = 0 then 'unverified' when o_orderkey % 2 = 0 then 'verified' else 'mismatched' end as trust, case when o_orderkey % 6 = 0 then 'absent' when o_orderkey % 6 = 1 then 'unknown' when o_orderkey % 6 = 2 then 'corrupt' else 'verified' end as integrity from orders")
def trust_states(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    currency = ocr.policy_currency(F.when(k % 3 == 0, "").when(k % 3 == 1, "units.v2").otherwise("units.v1"), "units.v2")
    trust = ocr.lineage_trust(F.when(k % 4 != 0, F.when(k % 2 == 0, "a").otherwise("b")), F.when(k % 5 != 0, "a"))
    n, h = F.when(k % 6 != 0, k), F.when(k % 6 > 1, "h")
    whole = lineage.integrity(n, F.when(k % 6 != 0, F.when(k % 6 == 2, k + 1).otherwise(k)), h, F.lit("h"))
    return table(spark, sf, "orders").select(k.alias("k"), currency.alias("currency"), trust.alias("trust"), whole.alias("integrity"))


@query("select l_orderkey as paper_id, count(*) filter (l_returnflag in ('A', 'R')) as empty_text_candidate_count, count(*) filter (l_returnflag = 'A') as pdf_text_backfilled_count, count(*) filter (l_returnflag = 'R') as unrecovered_empty_text_count, count(*) filter (l_returnflag = 'R' and l_linenumber = 1) as no_pdf_text_layer_count, count(*) filter (l_returnflag = 'R' and l_linenumber <> 1) as pdf_text_mismatch_count from lineitem group by 1")
def raw_integrity(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("l_returnflag")
    return ocr.raw_integrity(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.when(s == "A", "missing_text_recovered").when(s == "R", "missing_text_unrecovered").otherwise("").alias("status"), F.when(F.col("l_linenumber") == 1, "no_pdf_text_layer").alias("error")), "paper_id")


@query(f"""with {_ROLES_SQL}, b as (select *, case when ord % 5 = 0 then ' ' else text end as t from roles), g as (select paper_id, count(*) as blocks, count(distinct page) as pages, count(distinct case when trim(t) <> '' then page end) as pages_with_text, count(*) filter (trim(t) = '') as empty_blocks, count(*) filter (role = 'section_heading') as headings, count(*) filter (role = 'body_paragraph') as paragraphs, count(*) filter (role = 'figure') as figures, count(*) filter (role = 'table') as tables from b group by 1)
  select *, case when paragraphs = 0 or pages_with_text / pages < 0.5 then 'red' when pages_with_text < pages or headings = 0 then 'yellow' else 'green' end as overall from g""")
def ocr_health(spark: SparkSession, sf: str) -> DataFrame:
    return ocr.health(_roles(spark, sf).withColumn("text", F.when(F.col("ord") % 5 == 0, " ").otherwise(F.col("text"))))


@query(f"""with {PAPERS_SQL}, h as (select doc_id as paper_id, case quality when 1 then 'red' else 'green' end as overall from labels) select paper_id, title, ocr_status, case when paper_id % 3 = 0 then 0 else paper_id % 9 end as pages, coalesce(overall, 'unknown') as overall,
  case when ocr_status = 'failed' then 'retry' when ocr_status = 'done' and overall = 'red' then 'rebuild' when ocr_status = 'pending' then 'wait' else 'none' end as todo from papers left join h using (paper_id)""")
def maintenance_rows(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    meta = table(spark, sf, "documents").filter("doc_id % 3 != 0").select(i.alias("paper_id"), (i % 9).alias("pages"))
    h = table(spark, sf, "labels").select(i.alias("paper_id"), F.when(F.col("quality") == 1, "red").otherwise("green").alias("overall"))
    return ocr.maintenance(papers(spark, sf), meta, h)


_VERSIONS_SQL = "v as (select doc_id as paper_id, doc_id % 2 = 0 as derived_stale, doc_id % 3 = 0 as raw_upgradable, doc_id % 5 = 0 as is_legacy from documents)"


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    versions = F.when(i % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("raw"), F.lit("1")))
    return table(spark, sf, "documents").select(i.alias("paper_id"), (i % 2 == 0).alias("derived_stale"), (i % 3 == 0).alias("raw_upgradable"), ocr.legacy(F.lit("done"), versions).alias("is_legacy"))


@query(f"with {_VERSIONS_SQL} select count(*) filter (derived_stale) as derived_rebuild_count, count(*) filter (raw_upgradable) as raw_upgrade_count from v")
def version_actions(spark: SparkSession, sf: str) -> DataFrame:
    return ocr.version_actions(_versions(spark, sf))


@query(f"with {_VERSIONS_SQL} select paper_id, 'derived_rebuild' as action, 'deferred' as mode from v where derived_stale and not raw_upgradable union all select paper_id, 'raw_upgrade', 'listed' from v where raw_upgradable union all select paper_id, 'backfill', 'listed' from v where is_legacy")
def runtime_followups(spark: SparkSession, sf: str) -> DataFrame:
    return ocr.runtime_followups(_versions(spark, sf))


@query("select doc_id as paper_id, array_to_string(list_filter(['derived', 'raw'], lambda x: (x = 'raw' and doc_id % 2 = 0) or (x = 'derived' and doc_id % 3 <> 0)), ',') as reasons from documents")
def version_reasons(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    stored = F.map_concat(F.create_map(F.lit("raw"), F.when(i % 2 == 0, "1").otherwise("2")), F.when(i % 3 == 0, F.create_map(F.lit("derived"), F.lit("5"))).otherwise(F.create_map().cast("map<string,string>")))
    expected = F.create_map(F.lit("raw"), F.lit("2"), F.lit("derived"), F.lit("5"))
    return table(spark, sf, "documents").select(i.alias("paper_id"), F.array_join(lineage.version_reasons(stored, expected), ",").alias("reasons"))


@query("select p_partkey as k, case when p_size % 4 = 0 then 'green' when p_size % 10 >= 9 and p_size % 3 = 0 then 'green' when p_size % 10 >= 6 then 'yellow' else 'red' end as figures, case when p_size % 4 = 0 then 'green' when p_size % 5 = 0 then 'red' when least(p_size % 5, p_size % 4) / (p_size % 4) >= 0.9 and p_size % 2 = 0 then 'green' when least(p_size % 5, p_size % 4) / (p_size % 4) >= 0.6 then 'yellow' else 'red' end as tables, case when p_size <= 2 then 'short_form' else 'standard' end as profile, case when p_size % 3 > 1 then 'yellow' else 'green' end as abstract from part")
def page_statuses(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_size")
    fig = quality.figure_status(F.when(p % 4 == 0, 0).otherwise(10), p % 10, p % 3)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), fig.alias("figures"), quality.table_status(p % 4, p % 5, p % 2).alias("tables"), quality.health_profile(p).alias("profile"), quality.abstract_structure(p % 3).alias("abstract"))


@query("select o_orderkey as k, case when o_orderkey % 4 = 0 then 'unreviewed' when o_orderkey % 4 = 1 then 'stale' when o_orderkey % 4 = 2 then 'confirmed' else 'disputed' end as validation from orders")
def human_validation(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    mark = F.struct(F.when(k % 4 == 3, "wrong").otherwise("correct").alias("verdict"), F.when(k % 4 == 1, "old").otherwise("now").alias("result_hash"))
    marks = F.when(k % 4 == 0, F.array().cast("array<struct<verdict:string,result_hash:string>>")).otherwise(F.array(F.struct(F.lit("wrong").alias("verdict"), F.lit("old").alias("result_hash")), mark))
    return table(spark, sf, "orders").select(k.alias("k"), quality.human_validation(marks, F.lit("now")).alias("validation"))


@query("with i as (select o_orderkey as k, sha256(concat_ws(chr(31), o_orderkey::varchar, 'units.v2', o_orderstatus, '', 'x')) as r, sha256(concat_ws(chr(31), 'http://e', 'm', '64')) as e from orders) select k, r as retrieval, sha256(r || chr(31) || e) as vector from i")
def identities(spark: SparkSession, sf: str) -> DataFrame:
    r = lineage.retrieval_identity(F.col("o_orderkey"), F.lit("units.v2"), F.col("o_orderstatus"), F.lit(None).cast("string"), F.lit("x"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), r.alias("retrieval"))
    return rows.withColumn("vector", lineage.vector_identity(F.col("retrieval"), lineage.embedding_identity("http://e", "m", 64)))


@query("with d as (select sha256(concat_ws(chr(31), n_nationkey::varchar, n_name)) as d from nation), b as (select substr(d, 1, 3) as b, sha256(string_agg(d, '' order by d)) as h from d group by 1) select sha256(string_agg(h, '' order by b)) as digest from b")
def index_digest(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.table_digest(table(spark, sf, "nation"), ["n_nationkey", "n_name"])


@query("select (select count(*) from customer) as paper_count_db, (select count(*) from customer where c_custkey % 10 <> 0) as paper_count_index, true as schema_ok, false as count_match, false as hash_match, false as fresh, true as needs_rebuild")
def memory_status(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return ocr.memory_status(c, c.filter("c_custkey % 10 != 0"), 7, 7, ["c_custkey", "c_name"])


@query("with a as (select l_orderkey as paper_id, case l_linenumber when 1 then 'raw' when 2 then 'blocks' when 3 then 'tree' end as name, max(l_returnflag) as d from lineitem where l_linenumber <= 3 group by 1, 2), w as (select paper_id, max(d) filter (name = 'raw') as r, max(d) filter (name = 'blocks') as b, max(d) filter (name = 'tree') as t from a group by 1) select paper_id, case when r is not null and b is not null and t is not null then sha256(r || b || t) end as result_hash from w")
def ocr_result_hash(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    a = table(spark, sf, "lineitem").filter(n <= 3).groupBy(F.col("l_orderkey").alias("paper_id"), F.when(n == 1, "raw").when(n == 2, "blocks").otherwise("tree").alias("name")).agg(F.max("l_returnflag").alias("digest"))
    return ocr.result_hash(a, ["raw", "blocks", "tree"])


@query("select (select count(distinct label) from embeddings) as embedded, (select count(*) from documents where doc_id % 2 = 0) as eligible, case when (select count(distinct label) from embeddings) < (select count(*) from documents where doc_id % 2 = 0) then 'interrupted' else 'completed' end as status")
def embed_progress(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, "eligible").otherwise("not_ready").alias("state"))
    return ocr.progress(table(spark, sf, "embeddings").select(F.col("label").alias("paper_id")), e)


@query("""with n as (select doc_id, case doc_id % 5 when 0 then 'not_found' when 1 then 'bad' else '' end as e, case when doc_id % 7 = 0 then '' else 'x.pdf' end as p, case doc_id % 4 when 0 then 'done' when 1 then 'Pending' when 2 then '' else 'failed' end as s from documents)
  select count(*) as papers, count(*) filter (e = '' and p <> '') as pdf_healthy, count(*) filter (e = 'not_found' or (e = '' and p = '')) as pdf_missing, count(*) filter (e = 'bad') as pdf_broken, count(*) filter (s = 'done') as ocr_done, count(*) filter (s in ('Pending', '')) as ocr_pending, count(*) filter (s = 'failed') as ocr_failed from n""")
def dashboard_of_notes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    notes = table(spark, sf, "documents").select(F.when(i % 5 == 0, "not_found").when(i % 5 == 1, "bad").otherwise("").alias("path_error"), F.when(i % 7 == 0, "").otherwise("x.pdf").alias("pdf_path"), F.when(i % 4 == 0, "done").when(i % 4 == 1, "Pending").when(i % 4 == 2, "").otherwise("failed").alias("ocr_status"))
    return ocr.dashboard_of_notes(notes)


@query(f"with {UNITS_SQL} select distinct paper_id from units where part = 1")
def changed_units(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    old = lineage.manifests(u.withColumn("unit_text", F.when(F.col("part") == 1, F.concat("unit_text", F.lit("!"))).otherwise(F.col("unit_text"))))
    return lineage.changed(u, old)


@query("select (select count(*) from embeddings) as n_vectors, 64 as least_dim, 64 as most_dim, (select count(*) from documents) as n_meta, (select count(*) from documents where doc_id not in (select vec_id from embeddings)) as orphans")
def vector_layout(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.layout(table(spark, sf, "embeddings"), table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")))


@query("select vec_id, vec_id % 10 <> 0 as valid from embeddings")
def valid_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.when(F.col("vec_id") % 20 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 10 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", vectors.valid_embedding(broken, 64).alias("valid"))


@query(f"with {UNITS_SQL} select paper_id || ':' || unit_id as id, sha256(unit_text) as text_hash from units")
def body_payload(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.body_payload(units(spark, sf)).select("id", "text_hash")


@query("select vec_id % 9 || ':' || vec_id as id, concat_ws(chr(10), 'Figure ' || vec_id, nullif(case when vec_id % 2 = 0 then 'cap' else '' end, ''), nullif(case when vec_id % 3 = 0 then 'near' else '' end, '')) as text from embeddings")
def object_payload(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    o = table(spark, sf, "embeddings").select((i % 9).alias("paper_id"), i.alias("unit_id"), F.concat(F.lit("Figure "), i.cast("string")).alias("object_label"), F.when(i % 2 == 0, "cap").otherwise("").alias("caption_text"), F.when(i % 3 == 0, "near").otherwise("").alias("nearby_body_text"))
    return vectors.object_payload(o)


@query("select item_id, round(('0x' || substr(sha256(text), 1, 2))::int / 255.0, 4)::double as first, round(('0x' || substr(sha256(text), 3, 2))::int / 255.0, 4)::double as second from benchmark")
def encoded(spark: SparkSession, sf: str) -> DataFrame:
    e = vectors.encode(table(spark, sf, "benchmark"), "text", 40)
    at = lambda k: F.round(F.get("embedding", F.lit(k)).cast("double"), 4)
    return e.select("item_id", at(0).alias("first"), at(1).alias("second"))


@query("select doc_id as k from labels union select page_id from pages union select vec_id from embeddings")
def key_union(spark: SparkSession, sf: str) -> DataFrame:
    k = lambda t, c: table(spark, sf, t).select(F.col(c).alias("k"))
    return diff.key_union([k("labels", "doc_id"), k("pages", "page_id"), k("embeddings", "vec_id")], "k")


@query("select 'orders' as name, true as duplicates union all select 'customer', false")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    a = diff.has_duplicates(table(spark, sf, "orders"), "o_custkey").withColumn("name", F.lit("orders"))
    return a.unionByName(diff.has_duplicates(table(spark, sf, "customer"), "c_custkey").withColumn("name", F.lit("customer"))).select("name", "duplicates")


@query("select 'orders' as name, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING') union all select 'customer', count(*) from customer where c_mktsegment <> 'BUILDING'")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    left = diff.delete_cascade({"orders": (table(spark, sf, "orders"), "o_custkey"), "customer": (c, "c_custkey")}, c.filter("c_mktsegment = 'BUILDING'"), "c_custkey")
    return left["orders"].agg(F.count("*").alias("n")).withColumn("name", F.lit("orders")).unionByName(left["customer"].agg(F.count("*").alias("n")).withColumn("name", F.lit("customer"))).select("name", "n")


# ---- sources and sinks: tables written in each format, read back ----


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-work"
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex[:12]}"


@query("select conv_id || '-' || turn as id, conv_id::varchar as paper_id, role as section, md5(text) as excerpt, turn % 2 = 0 as verified from conversations")
def jsonl_log(spark: SparkSession, sf: str) -> DataFrame:
    at = _folder(spark)
    rows = table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("paper_id"), F.col("role").alias("section"), F.col("text").alias("excerpt"), (F.col("turn") % 2 == 0).alias("verified"))
    logs.append(rows, at)
    return readers.jsonl(spark, at, readers.READING_LOG, strict=True).select("id", "paper_id", "section", F.md5(F.col("excerpt").cast("binary")).alias("excerpt"), "verified")


@query("select p_partkey::varchar as key, p_name as title, case when p_partkey % 2 = 0 then '2021' else '' end as year, 'Ann Lee' as author, p_brand as citation_key, 'storage:ABCD1234/f.pdf' as pdf from part where p_partkey % 3 <> 0")
def export_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    at, k = _folder(spark), F.col("p_partkey")
    creator = F.struct(F.lit("author").alias("creatorType"), F.lit("Ann").alias("firstName"), F.lit("Lee").alias("lastName"))
    attached = F.struct(F.lit("storage:ABCD1234/f.pdf").alias("path"), F.lit("application/pdf").alias("contentType"), F.lit("PDF").alias("title"), F.lit(1).alias("size"))
    item = F.struct(k.cast("string").alias("key"), F.when(k % 3 == 0, "note").otherwise("journalArticle").alias("itemType"), F.col("p_name").alias("title"), F.when(k % 2 == 0, "May 2021").otherwise("").alias("date"), F.array(creator).alias("creators"), F.concat(F.lit("x\nCitation Key: "), "p_brand").alias("extra"), F.array(attached).alias("attachments"))
    files = table(spark, sf, "part").groupBy((k % 5).alias("f")).agg(F.collect_list(item).alias("items")).select("items")
    files.repartition(1).write.json(at)  # one export a line
    items = readers.export_items(spark.read.schema(readers.EXPORT).option("columnNameOfCorruptRecord", "_corrupt_record").json(at).withColumn("domain", F.lit("d")).withColumn("file", F.lit("f")))
    pdf = readers.pdf_attachments(items).select("key", F.col("path.path").alias("pdf"))
    return items.join(pdf, "key").select("key", "title", "year", F.get("authors", F.lit(0)).alias("author"), "citation_key", "pdf")


@query("select 'v7' as schema_version, count(*) as paper_count, 'abc' as export_hash from documents")
def index_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return readers.build_envelope(table(spark, sf, "documents"), "v7", "abc")


@query("select c_custkey::varchar as id, c_name as title, case when c_custkey % 2 = 0 then 'harvest' else 'web' end as source, case when c_custkey % 3 = 0 then '' else c_mktsegment end as domain from customer")
def harvest_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    at, k = _folder(spark), F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.cast("string").alias("id"), F.col("c_name").alias("title"), F.when(k % 2 == 0, "").otherwise("web").alias("source"), F.when(k % 3 == 0, "<inherit-from-task-context>").otherwise(F.col("c_mktsegment")).alias("domain"))
    rows.write.option("header", True).csv(at)
    return readers.harvest(spark, at, "*.csv")


@query("select n_nationkey::varchar as key, n_name as title, case when n_nationkey % 2 = 0 then 'true' else 'false' end as an from nation where n_nationkey % 2 = 0")
def notes_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    at, k = _folder(spark), F.col("n_nationkey")
    text = F.concat(F.lit("---\nkey: "), k.cast("string"), F.lit('\ntitle: "'), "n_name", F.lit('"\nanalyze: '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("\ndomain: d\n---\nbody"))
    table(spark, sf, "nation").select(text.alias("value"), k.alias("n")).repartition(25, "n").select("value", "n").write.partitionBy("n").text(at, lineSep="\n")
    found = readers.notes(spark, at, ["key", "title", "analyze", "domain"], "*.txt")
    return readers.analyze_queue(found).select("key", "title", F.col("analyze").alias("an"))


@query(f"with {_ROLES_SQL} select paper_id::varchar as paper_id, page, 'p' || page || '_b' || (ord % 12) as block_id, role as raw_label, text from roles")
def raw_blocks(spark: SparkSession, sf: str) -> DataFrame:
    at = _folder(spark)
    block = F.struct(F.lit(None).cast("string").alias("block_id"), F.col("role").alias("label"), F.lit(None).cast("int").alias("order"), F.array(*[F.lit(0.0)] * 4).alias("bbox"), "text")
    pages = _roles(spark, sf).groupBy(F.col("paper_id").cast("string").alias("paper_id"), "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x.b).alias("blocks"))
    results = pages.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "blocks"))), lambda p: F.struct(F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), p.blocks.alias("blocks"))).alias("pages")).withColumn("payload", F.lit(1))
    readers.write_blocks(readers.raw_blocks(results), at)
    return readers.jsonl(spark, at, readers.BLOCK, strict=True).select("paper_id", "page", "block_id", "raw_label", "text")


@query("select count(*) as n, sum(vec_id)::bigint as s from embeddings")
def published_vectors(spark: SparkSession, sf: str) -> DataFrame:
    store, e = Store(spark, _folder(spark)), table(spark, sf, "embeddings")
    store.publish(e.filter("vec_id < 0"))
    store.publish(e, verify_vectors(64, e.count()))
    return store.read().agg(F.count("*").alias("n"), F.sum("vec_id").alias("s"))


@query("select item_id::varchar as pmid, '10.1/' || item_id as doi, 'AIM: x' || chr(10) || 'END: y' as abstract from benchmark")
def pubmed_replay(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id").cast("string")
    xml = F.concat(F.lit("<PubmedArticle><PMID>"), i, F.lit('</PMID><ArticleIdList><ArticleId IdType="doi">10.1/'), i, F.lit('</ArticleId></ArticleIdList><Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText Label="END">y</AbstractText></Abstract></PubmedArticle>'))
    return structure.replayed_pubmed(table(spark, sf, "benchmark").select(xml.alias("xml")), "xml")


@query("""with r as (select item_id, '10.1/A' || item_id as doi, split_part(text, ' ', 1) as t from benchmark) select 'pubmed-10-1-a' || item_id as candidate_id, doi, t as title, 'J' as journal, '2020' as year, 'pubmed' as source from r
  union all select 'arxiv-10-1-a' || item_id, doi, t, 'arXiv', '2019', 'arxiv' from r union all select 'openalex-10-1-a' || item_id, doi, t, 'V', '2018', 'openalex' from r union all select 'scholar-10-1-a' || item_id, doi, t, 'W', '2017', 'scholar' from r""")
def adapted_candidates(spark: SparkSession, sf: str) -> DataFrame:
    doi = F.concat(F.lit("10.1/A"), F.col("item_id").cast("string"))
    b = table(spark, sf, "benchmark").select(doi.alias("doi"), F.substring_index("text", " ", 1).alias("title"))
    p = readers.candidates(b.withColumn("journal", F.lit("J")).withColumn("year", F.lit(2020)), "pubmed")
    a = readers.candidates(b.withColumn("published", F.lit("2019-02-03")).withColumn("journal", F.lit("")), "arxiv")
    o = readers.candidates(b.withColumn("doi", F.concat(F.lit("https://doi.org/"), "doi")).withColumnRenamed("title", "display_name").withColumn("publication_year", F.lit(2018)).withColumn("venue", F.lit(" V ")), "openalex")
    s = readers.candidates(b.withColumn("year", F.lit("2017")).withColumn("venue", F.lit("W")), "scholar")
    return p.unionByName(a).unionByName(o).unionByName(s).select("candidate_id", "doi", "title", "journal", "year", "source")


@query("select p_partkey as k, case when p_partkey % 2 = 0 then '3.5' else '1.25' end as impact_factor from part")
def impact_factors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("k"), F.when(k % 2 == 0, "Bone J").otherwise("Other").alias("journal"), F.lit("影响因子: 1.25").alias("extra"))
    return readers.impact_factors(rows, spark.createDataFrame([("bone j", 3.5)], "journal string, impact_factor double")).select("k", "impact_factor")


@query(f"""with {_HEADS_SQL}, o as (select t.paper_id, t.ord, t.tag, (select max(iv.ord) from iv where iv.paper_id = t.paper_id and iv.ord <= t.ord and t.ord <= iv.e) as node from tags t)
  select paper_id || ':body:n' || node as unit_id, paper_id, string_agg(tag || ord, chr(10) || chr(10) order by ord) as unit_text from o where node is not null and ord <> node group by 2, node""")
def section_units(spark: SparkSession, sf: str) -> DataFrame:
    t, intervals = _heads(spark, sf)
    b = t.select("paper_id", F.lit(1).alias("page"), F.col("ord").cast("string").alias("block_id"), "ord", F.lit("body_paragraph").alias("role"), F.concat("tag", F.col("ord").cast("string")).alias("text"))
    own = blocks.owning_heading(intervals, b.select("paper_id", "ord"), "paper_id").filter("title != ''").withColumn("node", F.substring("title", 2, 9).cast("long")).filter("ord != node")
    nodes = own.groupBy("paper_id", "node").agg(F.transform(F.array_sort(F.collect_list("ord")), lambda o: F.concat(F.lit("p1:"), o.cast("string"))).alias("own_block_ids"))
    made = un.body_units(nodes.select("paper_id", F.concat(F.lit("n"), F.col("node").cast("string")).alias("node_id"), F.lit("").alias("title"), F.lit(1).alias("level"), "own_block_ids"), b.drop("ord"))
    return made.select("unit_id", "paper_id", "unit_text")


@query(f"with {_HEADS_SQL} select t.paper_id, t.ord, coalesce((select max_by('n' || iv.ord, iv.level) from iv where iv.paper_id = t.paper_id and iv.ord <= t.ord and t.ord <= iv.e), '') as node_id from tags t where tag = 'li'")
def object_units(spark: SparkSession, sf: str) -> DataFrame:
    t, intervals = _heads(spark, sf)
    captions = t.filter("tag = 'li'").select("paper_id", F.col("ord").cast("string").alias("key"), F.col("tag").alias("kind"), F.lit("c").alias("text"))
    inside = intervals.select("paper_id", F.concat(F.lit("n"), F.col("ord").cast("string")).alias("node_id"), F.col("level").alias("depth"), F.explode(F.transform(F.sequence("ord", "end"), lambda o: o.cast("string"))).alias("key"))
    return un.object_units(captions, inside).select("paper_id", F.col("key").cast("long").alias("ord"), "node_id")


@query(f"select v.vec_id, round(1 - {_L2}, 4) as score from embeddings v, (select embedding from embeddings where vec_id = 0) q where v.label <> 3 and v.vec_id % 5 <> 1 order by {_L2}, v.vec_id limit 15")
def vector_store(spark: SparkSession, sf: str) -> DataFrame:
    i, e = F.col("vec_id"), table(spark, sf, "embeddings")
    rows = e.select(i, F.col("label").alias("paper_id"), F.when(i % 5 == 1, "").otherwise(i.cast("string")).alias("unit_id"), "embedding")
    store = VectorStore(spark, _folder(spark), 64)
    store.add(rows.filter("vec_id % 2 = 0").withColumn("unit_id", F.lit("old")))
    store.add(rows)
    store.delete_papers(rows.filter("paper_id = 3"))
    return store.query(_vector(spark, sf), 15).select("vec_id", F.round(vectors.score(F.col("distance")), 4).alias("score"))


@query(f"select doc_id || '_' || chunk_index as id, section, page_number, token_estimate from ({SQL['chunk_fulltext']}) c")
def chunk_payload(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.chunk_payload(chunk_fulltext(spark, sf), "doc_id").select("id", "section", "page_number", "token_estimate")


@query(f"""with {_ROLES_SQL}, a as (select paper_id, page, ord, 0 as k, case when role = 'section_heading' then '## ' || text else text end as t from roles where tag <> 'li' union all select paper_id, page, ord, 1, '[att ' || ord || ']' from roles where tag = 'p' and ord % 3 = 0)
  select paper_id, page, md5('<!-- page ' || page || ' -->' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) order by ord, k)) as digest from a group by 1, 2""")
def emitted_pages(spark: SparkSession, sf: str) -> DataFrame:
    r = _roles(spark, sf).filter("tag != 'li'")
    spine = r.select("paper_id", "page", "ord", "block_id", "text", F.when(F.col("role") == "section_heading", 2).alias("level"))
    a = r.filter("tag = 'p' and ord % 3 = 0").select("paper_id", "block_id", F.concat(F.lit("[att "), F.col("ord").cast("string"), F.lit("]")).alias("text"), F.col("ord").alias("o"))
    a = a.withColumn("attachment_id", F.col("o") + 1).drop("o")
    return structure.emitted_pages(spine, a.unionByName(a)).select("paper_id", "page", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query(f"with {_BOX_SQL}, c as (select page, id, case when x1 < 0 then 0 else 1 end as col from boxes), n as (select *, case when col <> lag(col) over (partition by page order by id) then 1 else 0 end as new from c) select page, id, (sum(new) over (partition by page order by id))::bigint as segment from n")
def reading_segments(spark: SparkSession, sf: str) -> DataFrame:
    b = _rects(spark, sf).withColumn("col", F.when(F.col("x1") < 0, 0).otherwise(1))
    return blocks.reading_segments(b, "page", "col", "id").select("page", "id", "segment")


@query("select p_partkey as k, p_size % 2 <> 0 as has_pdf, p_brand || '|' || p_name as authors from part where p_partkey % 4 <> 0 union all select p_partkey, p_size % 2 <> 0, '' from part where p_partkey % 4 = 0")
def entries_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 2).alias("has_pdf"), F.when(F.col("p_partkey") % 4 != 0, F.to_json(F.array("p_brand", "p_name"))).alias("authors_json"))
    return derive.entry_of_row(p, ["has_pdf"], ["authors"]).select("k", "has_pdf", F.array_join("authors", "|").alias("authors"))
