"""Registered queries of row-level derivations, states, contexts and document structure, each with DuckDB SQL for the same rows.

They register themselves beside those of litmill.queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.bridge import PAPERS_SQL, UNITS_SQL, papers, table, units
from litmill.functions import text as tx
from litmill.operators import aggregate, context, diff, lookup, ocr, structure
from litmill.queries import _ROLE_SQL, _TAGS_SQL, _tags, query

# ---- strings ----


@query(r"select doc_id, regexp_extract(text, '((?:19|20)[0-9]{2})', 1) as year, regexp_extract(text, '([0-9]{4})', 1) as loose from documents")
def year_forms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.year("text").alias("year"), tx.loose_year("text").alias("loose"))


@query(r"""select page_id, coalesce(nullif(regexp_replace(substr(trim(regexp_replace(url, '[<>:"/\\|?*]+', '', 'g'), ' '), 1, 40), '[ .]+$', ''), ''), 'untitled') as slug, lower(trim(regexp_replace(url, '\s+', ' ', 'g'), ' ')) as folded from pages""")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.slug("url", 40).alias("slug"), tx.folded_title("url").alias("folded"))


_CANDIDATES_SQL = """cands as (select item_id, case item_id % 3 when 0 then '10.1000/AB.' || item_id else '' end as doi, case item_id % 3 when 1 then 'PMID ' || item_id else '' end as pmid, split_part(text, '.', 1) as title from benchmark)"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(i, F.when(i % 3 == 0, F.concat(F.lit("10.1000/AB."), i.cast("string"))).otherwise("").alias("doi"), F.when(i % 3 == 1, F.concat(F.lit("PMID "), i.cast("string"))).otherwise("").alias("pmid"), F.substring_index("text", ".", 1).alias("title"))


@query(rf"""with {_CANDIDATES_SQL}, d as (select *, regexp_replace(regexp_replace(lower(doi), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as ds, regexp_replace(pmid, '[^0-9]', '', 'g') as ps, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) as ts from cands)
  select item_id, 'pubmed-' || coalesce(nullif(ds, ''), nullif(ps, ''), nullif(ts, ''), 'unknown') as candidate_id, lower(trim(doi)) as doi_key, trim(pmid) as pmid_key, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) as title_key from d""")
def candidate_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf)
    ident = tx.candidate_id(F.lit("pubmed"), F.col("doi"), F.col("pmid"), F.col("title"), F.lit("unknown"))
    return c.select("item_id", ident.alias("candidate_id"), *tx.identity_keys("doi", "pmid", "title"))


@query(r"""with p as (select c_custkey as k, case c_custkey % 5 when 0 then 'storage:ABCD' || lpad((c_custkey % 10000)::varchar, 4, '0') || '/a b.pdf' when 1 then 'C:\papers\x.pdf' when 2 then 'ABCD' || lpad((c_custkey % 10000)::varchar, 4, '0') || '/y.pdf' when 3 then '' else '/home/z/storage/ABCD' || lpad((c_custkey % 10000)::varchar, 4, '0') || '/z.pdf' end as path from customer),
  u as (select k, replace(path, '\', '/') as u from p), e as (select *, regexp_extract(u, '(?:^storage:|/storage/|^)([A-Z0-9]{8})/(.+)$', 1) as key, regexp_extract(u, '(?:^storage:|/storage/|^)([A-Z0-9]{8})/(.+)$', 2) as rest from u)
  select k, case when u = '' then 'missing' when key <> '' then 'storage' else 'absolute' end as kind, case when u = '' then '' when key <> '' then 'storage:' || key || '/' || rest else 'absolute:' || u end as path, key from e""")
def attachment_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    key = F.concat(F.lit("ABCD"), F.lpad((k % 10000).cast("string"), 4, "0"))
    path = F.when(k % 5 == 0, F.concat(F.lit("storage:"), key, F.lit("/a b.pdf"))).when(k % 5 == 1, "C:\\papers\\x.pdf").when(k % 5 == 2, F.concat(key, F.lit("/y.pdf"))).when(k % 5 == 3, "").otherwise(F.concat(F.lit("/home/z/storage/"), key, F.lit("/z.pdf")))
    return table(spark, sf, "customer").select(k.alias("k"), tx.attachment_path(path).alias("a")).select("k", "a.kind", "a.path", "a.key")


@query("""with p as (select p_partkey as k, [replace(p_type, ' ', '/'), p_brand, 'a/' || p_brand] as ps from part), f as (select k, unnest(ps) as p from p),
  b as (select k, max_by(p, {'d': length(p) - length(replace(p, '/', '')), 'n': length(p), 'p': p}) as primary_path from f group by 1), t as (select k, string_split(array_to_string(ps, '/'), '/') as s from p)
  select k, primary_path, len(list_distinct(s))::int as n_tags, s[1] as first_tag from b join t using (k)""")
def collection_fields(spark: SparkSession, sf: str) -> DataFrame:
    c = tx.collection_fields(F.array(F.replace("p_type", F.lit(" "), F.lit("/")), F.col("p_brand"), F.concat(F.lit("a/"), "p_brand")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), c.alias("c")).select("k", F.col("c.primary").alias("primary_path"), F.size("c.tags").alias("n_tags"), F.get("c.tags", F.lit(0)).alias("first_tag"))


@query(r"""select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'), ' ')) as digest from pages""")
def plain_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(tx.plain_html("html").cast("binary")).alias("digest"))


_LINES_SQL = "lines as (select doc_id, (i - 1)::bigint as ord, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)))"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))


@query(rf"""with {_LINES_SQL}, x as (select doc_id, ord, '  \( ' || line || ' \) &lt;b&gt; 12&nbsp;3  and [1, 2] *so* $x$ ﬁn' as t from lines),
  c as (select doc_id, ord, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '([a-z])-\n([a-z])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' ') as clean, t from x)
  select doc_id, ord, md5(clean) as clean, md5(lower(trim(regexp_replace(t, '\s+', ' ', 'g'), ' '))) as gap from c""")
def cleaned_lines(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("  \\( "), "line", F.lit(" \\) &lt;b&gt; 12&nbsp;3  and [1, 2] *so* $x$ ﬁn"))
    return _lines(spark, sf).select("doc_id", "ord", F.md5(structure.clean_text(t).cast("binary")).alias("clean"), F.md5(tx.folded_gap(t).cast("binary")).alias("gap"))


@query(rf"""with {_LINES_SQL}, m as (select doc_id, ord, '\( ' || line || ' \) [1, 2] *so* <b>ﬁn</b>' as t from lines), r as (select *, regexp_replace(regexp_replace(t, '\\[\[\]]', '$$$$', 'g'), '\\[()]', '$', 'g') as u, lower(t) as l from m)
  select doc_id, ord, md5(regexp_replace(u, '\$ +([^$]*?) +\$', '$\1$', 'g')) as math, trim(regexp_replace(regexp_replace(replace(replace(replace(l, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '\$[^$]*\$|<[^>]*>|\[[0-9,; –-]+\]|[*_`#]', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') as comparable from r""")
def math_and_comparable(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("\\( "), "line", F.lit(" \\) [1, 2] *so* <b>ﬁn</b>"))
    return _lines(spark, sf).select("doc_id", "ord", F.md5(structure.math_text(t).cast("binary")).alias("math"), structure.comparable(t).alias("comparable"))


@query("""with r as (select p_partkey as k, case p_partkey % 4 when 0 then 'XIV' when 1 then 'mcmxc' when 2 then 'iv' else 'abc' end as r, p_size / 2.0 as v from part)
  select k, case r when 'XIV' then 14 when 'mcmxc' then 1990 when 'iv' then 4 end as value, round(round_even(v / 5, 0) * 5, 2)::double as bucket from r""")
def numerals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    r = F.when(k % 4 == 0, "XIV").when(k % 4 == 1, "mcmxc").when(k % 4 == 2, "iv").otherwise("abc")
    return table(spark, sf, "part").select(k.alias("k"), tx.roman_to_int(r).alias("value"), tx.bucket(F.col("p_size") / 2.0, 5.0).alias("bucket"))


@query(r"""with f as (select item_id, case item_id % 4 when 0 then '[3] Smith AB, Jones C. Title. J Bone 2019;12(3): 45-9.' when 1 then 'Smith AB. Title. 2019;12:45' when 2 then 'World Health Organization guideline 2020' else text end as t from benchmark),
  s as (select item_id, trim(t) as t, lower(trim(t)) as low from f),
  g as (select *, regexp_matches(t, '(?:^|[^A-Za-z])[A-Z][a-zA-Z''-]+\s+[A-Z]{1,3}(?:,|[^A-Za-z0-9_]|$)') as signed, regexp_matches(t, '(?:^|[^0-9A-Za-z_])(?:19|20)[0-9]{2}(?:[^0-9A-Za-z_]|$)') as dated, regexp_matches(t, '[0-9]+\s*(?:\([0-9]+\)\s*)?:\s*[A-Za-z0-9-]+') as paged,
    regexp_matches(t, '^(?:\([0-9]+\)|\[[0-9]+\]|[0-9]+[.)]?)(?:\s+|$)') as numbered, regexp_matches(low, 'guideline|organization|committee|available from|\[internet\]') as report from s)
  select item_id, case when signed and dated and paged and numbered then 'vancouver_structured_numbered' when signed and dated and paged then 'vancouver_structured_unnumbered' when report and dated then 'book_or_report' when regexp_matches(t, '[A-Z][a-zA-Z''-]+\s+[A-Z].*\((?:19|20)[0-9]{2}\)') then 'author_year' else 'unknown' end as family from g""")
def reference_family(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id") % 4
    t = F.when(i == 0, "[3] Smith AB, Jones C. Title. J Bone 2019;12(3): 45-9.").when(i == 1, "Smith AB. Title. 2019;12:45").when(i == 2, "World Health Organization guideline 2020").otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", tx.reference_family(t).family.alias("family"))


@query("""with p as (select doc_id, trim(text) as pdf, case doc_id % 5 when 0 then '' when 1 then substr(text, 1, (length(text) * 3) // 10) when 2 then substr(text, 1, (length(text) * 8) // 10) when 3 then text else 'x' || text end as t from documents), o as (select *, trim(t) as ocr from p)
  select case when pdf = '' then 'pdf_unavailable' when ocr = '' then 'empty_vs_pdf' when length(ocr) < 0.45 * length(pdf) then 'short_vs_pdf' when starts_with(pdf, ocr) and length(pdf) > length(ocr) + 24 then 'likely_missing_tail' else 'complete' end as status, count(*) as n from o group by 1""")
def text_completeness(spark: SparkSession, sf: str) -> DataFrame:
    i, t = F.col("doc_id") % 5, F.col("text")
    part = lambda k: F.substring(t, F.lit(1), F.floor(F.length(t) * k / 10).cast("int"))
    cut = F.when(i == 0, "").when(i == 1, part(3)).when(i == 2, part(8)).when(i == 3, t).otherwise(F.concat(F.lit("x"), t))
    return aggregate.completeness_histogram(table(spark, sf, "documents"), tx.text_completeness(cut, t))


@query(rf"""with {_LINES_SQL}, b as (select doc_id as paper_id, ord // 4 + 1 as page, ord, case when ord % 3 = 0 then '' else line end as text, line as pdf_text from lines),
  p as (select paper_id, page, coalesce(string_agg(trim(text), ' ' order by ord) filter (trim(text) <> ''), '') as o, coalesce(string_agg(trim(pdf_text), ' ' order by ord) filter (trim(pdf_text) <> ''), '') as p from b group by 1, 2)
  select paper_id, page, case when p = '' then 'missing_pdf_text' when length(o) / length(p) < 0.6 then 'low' else 'ok' end as status, case when p <> '' then round(length(o) / length(p), 6) end as ratio from p""")
def page_coverage(spark: SparkSession, sf: str) -> DataFrame:
    b = _lines(spark, sf).select(F.col("doc_id").alias("paper_id"), (F.floor(F.col("ord") / 4) + 1).alias("page"), "ord", F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("line")).alias("text"), F.col("line").alias("pdf_text"))
    return ocr.page_coverage(b)


@query(r"""with t as (select conv_id, turn, 'a  b  $ x$ and $ ^{ y }$' || chr(10) || '* Correspondence: ' || role || chr(10) || '†  equal' as t from conversations)
  select conv_id, turn, 'a b$x$and$^{y}$' || chr(10) || '[^correspondence]: ' || role || chr(10) || '[^equal]: equal' as markdown from t join conversations using (conv_id, turn)""")
def obsidian_markdown(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("a  b  $ x$ and $ ^{ y }$\n* Correspondence: "), "role", F.lit("\n†  equal"))
    return table(spark, sf, "conversations").select("conv_id", "turn", ocr.obsidian(t).alias("markdown"))


@query("""select conv_id, turn, role in ('user') as match from conversations""")
def author_match(spark: SparkSession, sf: str) -> DataFrame:
    block = F.when(F.col("role") == "user", "Anna Jones and Peter Smith").otherwise("Someone Else entirely different here")
    known = F.array(F.lit("Smith, Peter"), F.lit("Jones Anna"))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.author_match(block, known).alias("match"))


@query("""with l as (select vec_id, case vec_id % 4 when 0 then 'figure:p3_1' when 1 then 'table:p1' when 2 then 'Figure 9' else 'figure:p4' end as label, case vec_id % 2 when 0 then 'see Figure 3 here' else 'Supplementary Table S2. text' end as caption from embeddings)
  select vec_id, case when label like 'figure:p%' or label like 'table:p%' then case when vec_id % 2 = 0 then 'Figure 3' else 'Supplementary Table S2' end else label end as label, case when vec_id % 3 = 0 or vec_id % 5 = 1 then 'figure' else 'table' end as kind from l""")
def object_labels(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    label = F.when(i % 4 == 0, "figure:p3_1").when(i % 4 == 1, "table:p1").when(i % 4 == 2, "Figure 9").otherwise("figure:p4")
    caption = F.when(i % 2 == 0, "see Figure 3 here").otherwise("Supplementary Table S2. text")
    kind = context.object_kind(F.when(i % 3 == 0, i), F.when(i % 5 == 1, "figure_caption").otherwise("table_caption"))
    return table(spark, sf, "embeddings").select("vec_id", tx.object_label(label, caption).alias("label"), kind.alias("kind"))


# ---- contexts ----


@query(f"""with {UNITS_SQL}, p as (select min(doc_id) as paper_id from documents where contains(lower(split_part(text, chr(10), 1)), 'the'))
  select unit_id, u.paper_id, section_path, unit_text from units u join p using (paper_id) where contains(lower(section_path), 's')""")
def scoped_fetch(spark: SparkSession, sf: str) -> DataFrame:
    one = papers(spark, sf).filter(F.contains(F.lower("title"), F.lit("the"))).orderBy("paper_id").limit(1)
    return context.scoped_fetch(units(spark, sf), one, section="S").select("unit_id", "paper_id", "section_path", "unit_text")


@query(f"""with {_TAGS_SQL}, t as (select paper_id, ord, tag, {_ROLE_SQL} as role from tags), n as (select paper_id, count(*) as n from t where tag = 'h2' group by 1), r as (select paper_id, count(distinct role) as r from t where paper_id % 3 <> 0 group by 1)
  select page_id as paper_id, case when n is not null then 'structure_tree' when r is not null then 'role_index_summary' else 'no_index' end as mode, coalesce(n, r, 0) as entries from pages left join n on n.paper_id = page_id left join r on r.paper_id = page_id""")
def paper_navigation(spark: SparkSession, sf: str) -> DataFrame:
    t = _tags(spark, sf)
    return context.navigation(table(spark, sf, "pages").select(F.col("page_id").alias("paper_id")), t.filter("tag = 'h2'"), t.filter("paper_id % 3 <> 0"))


@query(f"""with {UNITS_SQL}, n as (select conv_id as paper_id, turn as note_id, role as section, substr(text, 1, 80) as e, turn % 2 = 0 as verified from conversations),
  a as (select paper_id, count(*) as n_notes, coalesce(string_agg(section || ': ' || e || '...', chr(10) order by note_id) filter (not verified), '') as recheck from n group by 1),
  c as (select user_id as paper_id, ts as created_at, event_id, case when event_type = 'view' then '' else event_type end as original_id from events),
  o as (select * from c qualify original_id = '' or row_number() over (partition by paper_id, original_id order by created_at desc, event_id desc) = 1),
  b as (select paper_id, count(*) as n_corrections, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_correction from o group by 1), u as (select paper_id, count(*) as n from units group by 1)
  select doc_id as paper_id, coalesce(n_notes, 0) as n_notes, coalesce(recheck, '') as recheck, coalesce(n_corrections, 0) as n_corrections, last_correction, coalesce(u.n, 0) as body_units_count, u.n is not null as fulltext_available
  from documents left join a on a.paper_id = doc_id left join b on b.paper_id = doc_id left join u on u.paper_id = doc_id""")
def paper_context(spark: SparkSession, sf: str) -> DataFrame:
    notes = table(spark, sf, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("note_id"), F.col("role").alias("section"), F.col("text").alias("excerpt"), (F.col("turn") % 2 == 0).alias("verified"))
    fixes = table(spark, sf, "events").select(F.col("user_id").alias("paper_id"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("original_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "event_id")
    return context.paper_context(papers(spark, sf), notes, fixes, units(spark, sf))


@query("select doc_id as paper_id, source as domain from documents where doc_id % 2 = 0 and lang in ('en', 'es')")
def context_filters(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("domain"), F.array(F.concat(F.lit("top/"), "lang"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("side/e"), F.col("lang"))).otherwise("none")).alias("collections"))
    return context.context_filter(items, collection="side/een").unionByName(context.context_filter(items, collection="side/ees")).select("paper_id", "domain")


@query(f"""with {UNITS_SQL}, h as (select unit_id, paper_id, section_path, unit_text, round(length(unit_text) / 100.0, 4) as score from units)
  select paper_id, unit_id, '' as source_kind, 'bm25' as retrieval_mode, score::double as score, unit_text as text, section_path as heading, '' as title, '' as year from h""")
def normalized_matches(spark: SparkSession, sf: str) -> DataFrame:
    hits = units(spark, sf).select("unit_id", "paper_id", "section_path", "unit_text", F.round(F.length("unit_text") / 100, 4).alias("score"))
    return context.matches(hits, "bm25")


@query(f"""with {UNITS_SQL}, u as (select distinct paper_id from units where paper_id % 7 <> 0), v as (select vec_id as paper_id, case when vec_id % 3 = 0 then '' else 'u' end as unit_id from embeddings where vec_id % 2 = 0)
  select doc_id as paper_id, case when u.paper_id is null then 'fulltext_unavailable' when v.unit_id = 'u' then 'ok' when v.unit_id = '' then 'stale' else 'not_built' end as state from documents left join u on u.paper_id = doc_id left join v on v.paper_id = doc_id""")
def paper_scope(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    v = table(spark, sf, "embeddings").filter(i % 2 == 0).select(i.alias("paper_id"), F.when(i % 3 == 0, "").otherwise("u").alias("unit_id"))
    return context.paper_scope(papers(spark, sf), units(spark, sf).filter("paper_id % 7 <> 0"), v)


@query(f"""with {PAPERS_SQL}, v as (select *, paper_id % 3 <> 0 as do_ocr, paper_id % 4 = 0 as an from papers) select 'all' as view, count(*) as n from v union all select 'ocr_pending', count(*) from v where do_ocr and ocr_status = 'pending' union all select 'deep_pending', count(*) from v where an and ocr_status = 'done' and deep_status = 'pending'""")
def base_views(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf).withColumn("do_ocr", F.col("paper_id") % 3 != 0).withColumn("analyze", F.col("paper_id") % 4 == 0)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n") for name, df in context.base_views(p).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""with p as (select doc_id, lang as domain, source as collection, doc_id % 2 = 0 as ready from documents), c as (select min(collection) as c from p where contains(lower(collection), 'sr'))
  select 'collection' as source, c as label, count(*) filter (starts_with(collection, c)) as estimated_paper_count, count(*) filter (starts_with(collection, c) and ready) as fulltext_ready_count,
    case when count(*) filter (starts_with(collection, c)) <= 20 then 'rg_now' when count(*) filter (starts_with(collection, c)) <= 60 then 'rg_with_warning' else 'ask_user_before_broad_grep' end as recommended_mode from p, c group by c""")
def scope_assessment(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "documents").select(F.col("lang").alias("domain"), F.array("source").alias("collections"), F.when(F.col("doc_id") % 2 == 0, "fulltext_ready").otherwise("indexed").alias("lifecycle"))
    return context.assess_scope(p, ["SR", " "])


@query("""with q as (select c_custkey as id, case c_custkey % 3 when 0 then 'content' when 1 then 'locate' else 'metadata' end as intent, case when c_custkey % 4 <> 0 then lower(c_mktsegment) || (c_custkey % 50) end as identifier from customer),
  k as (select p_partkey as paper_id, ['building' || (p_partkey % 50), 'machinery' || (p_partkey % 7)] as names from part), n as (select distinct paper_id, unnest(names) as name from k), h as (select id, count(distinct paper_id) as n, min(paper_id) as p from q join n on lower(identifier) = name group by 1)
  select q.id, intent, case when n = 1 and intent = 'content' then 'retrieve' when n = 1 and intent = 'locate' then 'paper-context' when identifier is not null and coalesce(n, 0) <> 1 then 'search' else 'plan' end as command, case when n = 1 then 'paper' else 'library' end as scope, case when n = 1 then p end as paper_key, intent = 'content' as retrieve_unavailable from q left join h using (id)""")
def enriched_plans(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("c_custkey"), F.col("p_partkey")
    plans = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, "content").when(k % 3 == 1, "locate").otherwise("metadata").alias("intent"), F.lit("plan").alias("command"), F.when(k % 4 != 0, F.concat(F.col("c_mktsegment"), (k % 50).cast("string"))).alias("identifier"))
    known = table(spark, sf, "part").select(p.alias("paper_id"), F.array(F.concat(F.lit("building"), (p % 50).cast("string")), F.concat(F.lit("machinery"), (p % 7).cast("string"))).alias("names"))
    return context.enrich_plan(plans, known, False)


_KNOWN_SQL = """k as (select s_suppkey as candidate_id, 'd' || (s_suppkey % 40) as doi, case when s_suppkey % 2 = 0 then 'p' || s_suppkey else '' end as pmid, s_name as title from supplier),
  n as (select p_partkey + 20 as candidate_id, case when p_partkey % 3 = 0 then 'D' || (p_partkey % 60) else '' end as doi, case when p_partkey % 5 = 0 then ' p' || p_partkey else '' end as pmid, p_name as title from part)"""


@query(f"""with {_KNOWN_SQL}, kk as (select candidate_id, 'doi' as kind, lower(doi) as v from k where doi <> '' union all select candidate_id, 'pmid', pmid from k where pmid <> '' union all select candidate_id, 'title', lower(title) from k), f as (select kind, v, min(candidate_id) as id from kk group by 1, 2),
  nk as (select candidate_id, 'doi' as kind, lower(doi) as v from n where doi <> '' union all select candidate_id, 'pmid', trim(pmid) from n where pmid <> '' union all select candidate_id, 'title', lower(title) from n), b as (select nk.candidate_id, min(id) as id from nk join f using (kind, v) group by 1)
  select n.candidate_id, coalesce(k.candidate_id, b.id) as existing_id from n left join k using (candidate_id) left join b on b.candidate_id = n.candidate_id""")
def existing_candidates(spark: SparkSession, sf: str) -> DataFrame:
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    known = table(spark, sf, "supplier").select(s.alias("candidate_id"), F.concat(F.lit("d"), (s % 40).cast("string")).alias("doi"), F.when(s % 2 == 0, F.concat(F.lit("p"), s.cast("string"))).otherwise("").alias("pmid"), F.col("s_name").alias("title"))
    new = table(spark, sf, "part").select((p + 20).alias("candidate_id"), F.when(p % 3 == 0, F.concat(F.lit("D"), (p % 60).cast("string"))).otherwise("").alias("doi"), F.when(p % 5 == 0, F.concat(F.lit(" p"), p.cast("string"))).otherwise("").alias("pmid"), F.col("p_name").alias("title"))
    return context.existing_candidate(new, known).select("candidate_id", "existing_id")


@query("""select item_id, trim(split_part(text, '.', 1)) as title, case when item_id % 2 = 0 then 'web' else 'candidate_ingest' end as source, case when item_id % 2 = 0 then 'web' else 'candidate_ingest' end as source_type, 'pending' as import_status, case when item_id % 3 = 0 then '0.5' else '0' end as confidence, 'candidate' as status from benchmark""")
def candidate_payloads(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    rows = table(spark, sf, "benchmark").select(i, F.substring_index("text", ".", 1).alias("title"), F.when(i % 2 == 0, " web ").otherwise(" ").alias("source"), F.lit(None).cast("string").alias("source_type"), F.lit("").alias("import_status"), F.when(i % 3 == 0, "0.5").alias("confidence"))
    return context.candidate_payload(rows)


@query("""with c as (select p_partkey as k, case when p_partkey % 6 = 0 then ' ' else p_brand end as collection, case when p_partkey % 4 = 0 then 'K' || p_partkey end as existing, case when p_partkey % 3 = 0 then ' 10.1/' || p_partkey end as doi, case when p_partkey % 2 = 0 then 'p' || p_partkey else '' end as pmid from part)
  select k, case when trim(collection) = '' then null when existing is not null then 'attach_existing_item_to_collection' when doi is not null or pmid <> '' then 'create_item_from_identifier' else 'create_item_from_metadata' end as action,
    case when trim(collection) = '' then null when existing is not null then existing when doi is not null then trim(doi) else pmid end as identifier from c""")
def writeback_commands(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda p: F.concat(F.lit(p), k.cast("string"))
    c = context.writeback_command(F.when(k % 6 == 0, " ").otherwise(F.col("p_brand")), F.when(k % 4 == 0, s("K")), F.when(k % 3 == 0, s(" 10.1/")), F.when(k % 2 == 0, s("p")).otherwise(""))
    return table(spark, sf, "part").select(k.alias("k"), c.alias("c")).select("k", "c.action", "c.identifier")


@query("""with q as (select p_partkey as candidate_id, case when p_partkey % 2 = 0 then 'accept' else 'reject' end as decision, case when p_partkey % 5 = 0 then 'imported' else 'pending' end as import_status, case when p_partkey % 3 = 0 then '10.1/x' else '' end as doi from part), o as (select s_suppkey as candidate_id, 'add_by_doi' as action, case when s_suppkey % 2 = 0 then 'processed' else 'queued' end as status from supplier)
  select candidate_id, action, status from o where status = 'processed' union all select candidate_id, case when doi <> '' then 'add_by_doi' else 'add_by_metadata' end, 'queued' from q where decision = 'accept' and import_status <> 'imported' and candidate_id not in (select candidate_id from o where status = 'processed')""")
def writeback_queue(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    c = table(spark, sf, "part").select(k.alias("candidate_id"), F.when(k % 2 == 0, "accept").otherwise("reject").alias("decision"), F.when(k % 5 == 0, "imported").otherwise("pending").alias("import_status"), F.lit("").alias("existing_key"), F.when(k % 3 == 0, "10.1/x").otherwise("").alias("doi"), F.lit("").alias("pmid"))
    return diff.writeback(c, table(spark, sf, "supplier").select(s.alias("candidate_id"), F.lit("add_by_doi").alias("action"), F.when(s % 2 == 0, "processed").otherwise("queued").alias("status")))


@query(f"with {PAPERS_SQL} select paper_id, title from papers where paper_id = 7")
def resolver_doi(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf).withColumn("doi", F.concat(F.lit("https://doi.org/10.1000/P"), F.col("paper_id").cast("string")))
    return lookup.resolve_doi(p, " http://dx.doi.org/10.1000/p7 ").select("paper_id", "title")


@query("""with c as (select r_name as domain, r_name || '/' || n_name as path from nation join region on r_regionkey = n_regionkey), q as (select r_name as domain, unnest(['', 'nowhere', 'china', 'AFRICA/KENYA', 'asia/india', 'a']) as raw from region),
  t as (select q.domain, raw, path, case when path = raw then 1 when lower(path) = lower(raw) then 2 when lower(split_part(path, '/', 2)) = lower(raw) then 3 when ends_with(lower(path), '/' || lower(raw)) then 4 end as tier from q join c using (domain)), g as (select domain, raw, tier, count(*) as n, min(path) as path from t where tier is not null group by 1, 2, 3 qualify row_number() over (partition by domain, raw order by tier) = 1)
  select q.domain, q.raw, case when q.raw = '' then 'empty' when g.n is null then 'unresolved' when g.n > 1 then 'ambiguous' else ['exact', 'exact_ci', 'leaf', 'suffix'][tier] end as resolution, case when n = 1 then path end as path from q left join g on g.domain = q.domain and g.raw = q.raw""".replace("then path end as path from q", "and q.raw <> '' then path end as path from q"))
def collection_resolution(spark: SparkSession, sf: str) -> DataFrame:
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    catalog = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("domain"), F.concat_ws("/", "r_name", "n_name").alias("path"))
    raws = ["", "nowhere", "china", "AFRICA/KENYA", "asia/india", "a"]
    return lookup.resolve_collection(r.select(F.col("r_name").alias("domain"), F.explode(F.array(*[F.lit(x) for x in raws])).alias("raw")), catalog)
