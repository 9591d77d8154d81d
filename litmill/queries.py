"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.bridge import PAPERS_SQL, UNITS_SQL, papers, table, units
from litmill.functions import text as tx
from litmill.operators import aggregate, blocks, derive, diff, lineage, logs, lookup, pairing, postings, quality, search, vectors
from litmill.operators import units as un
from litmill.plans import query as planner
from litmill.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _terms_sql(column: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({column})), '[\p{{L}}\p{{N}}_]+')"


def _bm25_sql(source: str, key: str, indexed: str, terms: list[str], mode: str, limit: int) -> str:
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = (" or " if mode == "or" else " and ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""with {source}, t as (select {key}, {_terms_sql(indexed)} as tokens from {source.split(' as')[0]}),
      c as (select {key}, len(tokens) as dl, {tf} from t), s as (select count(*) as n, avg(dl) as avgdl, {df} from c)
      select {key}, round({score}, 6) as score from c, s where {hit} order by score desc, {key} limit {limit}"""


TERMS = ["the", "tion", "ther"]
UNIT_COLUMNS = "unit_id || ' ' || paper_id || ' ' || section_path || ' ' || unit_text"


@query(_bm25_sql(UNITS_SQL, "unit_id", UNIT_COLUMNS, TERMS, "or", 25))
def content_discovery_or(spark: SparkSession, sf: str) -> DataFrame:
    u, docs = units(spark, sf), table(spark, sf, "documents")
    index = postings.index_of(spark, docs.inputFiles(), u, "unit_id", ["unit_id", "paper_id", "section_path", "unit_text"])
    score = F.round("score", 6).alias("score")
    return index.search(search.query_terms("the tion ther")).select(F.col("key").alias("unit_id"), score).orderBy(F.desc("score"), "unit_id").limit(25)


@query(_bm25_sql(UNITS_SQL, "unit_id", UNIT_COLUMNS, TERMS, "or", 25))
def content_discovery_scan(spark: SparkSession, sf: str) -> DataFrame:
    return search.content_discovery(units(spark, sf), "the tion ther", 25).select("unit_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(PAPERS_SQL, "paper_id", "title || ' ' || domain || ' ' || first_author", ["the", "of"], "and", 20))
def metadata_search_and(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").inputFiles() + table(spark, sf, "labels").inputFiles()
    index = postings.index_of(spark, files, papers(spark, sf), "paper_id", ["title", "domain", "first_author"])
    score = F.round("score", 6).alias("score")
    return index.search(search.query_terms("the of"), "and", "long").select(F.col("key").alias("paper_id"), score).orderBy(F.desc("score"), "paper_id").limit(20)


@query(f"with {PAPERS_SQL} select paper_id, title, year from papers where (contains(lower(title), 'the') and contains(lower(title), 'an')) or (contains(lower(first_author), 'the') and contains(lower(first_author), 'an')) order by year desc nulls last, paper_id limit 30")
def like_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return search.like_search(papers(spark, sf), "The an", ["title", "first_author"], 30).select("paper_id", "title", "year")


@query(rf"""with {PAPERS_SQL}, c as (select paper_id, year, case when year is null then null else coalesce(try_cast(nullif(regexp_extract(year, '^\s*([+-]?[0-9]+)', 1), '') as bigint), 0) end as y from papers)
  select paper_id, year, y as year_number from c where y >= 0 and y <= 2005""")
def metadata_filters_year(spark: SparkSession, sf: str) -> DataFrame:
    return search.metadata_filters(papers(spark, sf), year_to=2005).filter(tx.sqlite_int("year") >= 0).select("paper_id", "year", tx.sqlite_int("year").alias("year_number"))


@query(f"with {PAPERS_SQL}, {UNITS_SQL} select count(*) filter (paper_id in (select paper_id from units)) as indexed, count(*) filter (ocr_status = 'done') as done, count(*) as total from papers")
def body_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return search.body_coverage(papers(spark, sf), units(spark, sf))


@query(f"with {UNITS_SQL} select paper_id, count(*) as n_units, sum(length(unit_text))::bigint as n_chars, min(unit_id) as first_unit from units group by 1")
def unit_explode_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).groupBy("paper_id").agg(F.count("*").alias("n_units"), F.sum(F.length("unit_text")).alias("n_chars"), F.min("unit_id").alias("first_unit"))


@query()
def unit_split_oversized(spark: SparkSession, sf: str) -> DataFrame:
    return un.split_oversized(table(spark, sf, "documents").select("doc_id", "text"), "text", 500)


@query(r"""with p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ps from documents),
  e as (select doc_id, i, ps[i] as t, case when length(ps[i]) < 80 then nullif(regexp_extract(ps[i], '(?i)^#{0,4}\s*(?:\d+(?:\.\d+)*\.?\s*)?(Introduction|Methods?|Materials and Methods|Results?|Discussion|Conclusions?|Abstract|Background|References|Supplementary|Figure\s+\d+|Fig\.?\s*\d+|Table\s+\d+)', 1), '') end as h
    from (select doc_id, ps, unnest(range(1, len(ps) + 1)) as i from p)),
  r as (select *, count(h) over w as run, lag(h) over w as before, row_number() over w as k from e window w as (partition by doc_id order by i)),
  s as (select *, last_value(case when h is not null and (k = 1 or before is not null) then h end ignore nulls) over (partition by doc_id order by i) as section from r),
  g as (select doc_id, run, list(t order by i) as ts, min(i) as a, coalesce(any_value(section), 'Text') as section, count(*) as n from s where h is null group by 1, 2),
  o as (select *, unnest(list_concat(range(0, n, 2), case when n % 2 = 0 then [n - 1] else [] end)) as o from g),
  c as (select doc_id, row_number() over (partition by doc_id order by a + o) as chunk_index, section, array_to_string(ts[o + 1:least(o + 3, n)], chr(10) || chr(10)) as text from o)
  select doc_id, chunk_index, 1::bigint as page_number, section, text, (length(text) // 4)::bigint as token_estimate from c""")
def chunk_fulltext(spark: SparkSession, sf: str) -> DataFrame:
    return un.chunks(table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "doc_id", "text")


@query("select (length(text) // 4 // 100)::bigint as bucket, count(*) as n from documents group by 1")
def token_estimate_hist(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.floor(tx.token_estimate("text") / 100).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("select c_custkey as paper_id, c_name, 'c_name' as matched_by from customer where lower(c_name) = 'customer#000000007' order by 1 limit 1")
def lookup_exact_identifier(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").withColumnRenamed("c_custkey", "paper_id")
    return lookup.exact(rows, c_name="CUSTOMER#000000007").select("paper_id", "c_name", "matched_by")


_LOOKUP_SQL = f"""with {PAPERS_SQL}, c as (select *, (case when contains(lower(title), 'the') then 1 else 0 end + case when contains(lower(title), 'of') then 1 else 0 end) as hits,
    contains(lower(first_author), 'src1') as a, coalesce(year = '2003', false) as y from papers),
  arms as (select * from (select paper_id, 'author+year' as matched_by, 2 + hits as coverage_score, 0 as arm from c where a and y order by paper_id limit 20)
    union all select * from (select paper_id, 'author+title', 1 + y::int + hits, 1 from c where a and contains(lower(title), 'the') order by paper_id limit 20)
    union all select * from (select paper_id, 'year+title', a::int + 1 + hits, 2 from c where y and contains(lower(title), 'the') order by paper_id limit 20)
    union all select * from (select paper_id, 'relaxed_title', a::int + y::int + hits, 3 from c where contains(lower(title), 'the') order by paper_id limit 10)
    union all select * from (select paper_id, 'relaxed_title', a::int + y::int + hits, 4 from c where contains(lower(title), 'of') order by paper_id limit 10))
  select paper_id, matched_by, coverage_score::bigint as coverage_score from (select *, row_number() over (partition by paper_id order by arm) as r from arms) where r = 1"""


@query(_LOOKUP_SQL)
def lookup_arms(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.lookup(lookup.candidates(papers(spark, sf), "src1", "2003", ["the", "of"])).select("paper_id", "matched_by", "coverage_score")


@query(f"with {PAPERS_SQL} select paper_id, 2::bigint as coverage_score from papers where contains(lower(first_author), 'src1') and year = '2003' order by paper_id limit 20")
def lookup_author_year(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.candidates(papers(spark, sf), "src1", "2003")[0].select("paper_id", "coverage_score")


@query("""with c as (select p_partkey as paper_id, p_name as title, contains(lower(p_name), 'small')::int + contains(lower(p_name), 'ring')::int as hits from part),
  arms as (select *, 0 as arm from (select * from c where contains(lower(title), 'small') order by paper_id limit 10) union all select *, 1 from (select * from c where contains(lower(title), 'ring') order by paper_id limit 10))
  select paper_id, hits::bigint as coverage_score from (select *, row_number() over (partition by paper_id order by arm) as r from arms) where r = 1""")
def lookup_relaxed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.lit("").alias("first_author"), F.lit(None).cast("string").alias("year"))
    return lookup.lookup(lookup.candidates(rows, tokens=["small", "ring"])).select("paper_id", "coverage_score")


@query("select s_suppkey as paper_id, s_name, lower(p_name) as alias_norm from supplier join part on p_partkey = s_suppkey where contains(lower(p_name), 'ring') order by 1, 3 limit 20")
def lookup_alias(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("paper_id"), "s_name")
    aliases = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.lower("p_name").alias("alias_norm"))
    return lookup.alias(rows, aliases, " Ring ")


@query("""with q as (select item_id, case item_id % 5 when 0 then 'Smith 2021 chain' when 1 then '10.1000/ab.cd' when 2 then 'dc field stimulation' when 3 then 'smith2021chain' else split_part(text, '.', 1) end as q from benchmark),
  t as (select item_id, q, regexp_extract_all(q, '[A-Za-z][A-Za-z0-9.+-]*|[\\x{4e00}-\\x{9fff}]{2,}') as tokens from q)
  select item_id, nullif(regexp_extract(q, '(10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '') as doi, case when regexp_full_match(upper(trim(q)), '[A-Z0-9]{8}') then upper(trim(q)) end as item_key,
    case when nullif(regexp_extract(q, '(10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '') is null and not regexp_full_match(upper(trim(q)), '[A-Z0-9]{8}') and regexp_full_match(trim(q), '[A-Za-z][A-Za-z0-9_-]{5,}') and regexp_matches(trim(q), '[0-9_-]') then trim(q) end as citation_key,
    len(tokens)::bigint as n_tokens from t""".replace("\\\\", "\\"))
def classify_signals_batch(spark: SparkSession, sf: str) -> DataFrame:
    s = planner.signals("q")
    return _queries(spark, sf).select("item_id", s.doi.alias("doi"), s.item_key.alias("item_key"), s.citation_key.alias("citation_key"), F.size(tx.query_tokens("q")).cast("long").alias("n_tokens"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id") % 5
    q = F.when(i == 0, "Smith 2021 chain").when(i == 1, "10.1000/ab.cd").when(i == 2, "dc field stimulation").when(i == 3, "smith2021chain").otherwise(F.substring_index("text", ".", 1))
    return table(spark, sf, "benchmark").select("item_id", q.alias("q"))


@query("""with q as (select item_id, case item_id % 5 when 0 then 'Smith 2021 chain' when 1 then '10.1000/ab.cd' when 2 then 'dc field stimulation' when 3 then 'smith2021chain' else split_part(text, '.', 1) end as q from benchmark)
  select item_id, case item_id % 5 when 0 then 'mixed_query' when 1 then 'identifier_exact' when 2 then 'content_term' when 3 then 'identifier_exact' else case when regexp_full_match(upper(trim(q)), '[A-Z0-9]{8}') then 'identifier_exact' else 'content_term' end end as query_class,
    case item_id % 5 when 0 then 'search' when 1 then 'paper-context' when 2 then 'retrieve' when 3 then 'paper-context' else case when regexp_full_match(upper(trim(q)), '[A-Z0-9]{8}') then 'paper-context' else 'retrieve' end end as command,
    case item_id % 5 when 0 then 'Smith' when 4 then case when regexp_full_match(upper(trim(q)), '[A-Z0-9]{8}') then upper(trim(q)) else trim(q) end else q end as argument, case when item_id % 5 = 0 then 2021 end as year_from from q""")
def query_plan_batch(spark: SparkSession, sf: str) -> DataFrame:
    return planner.plans(_queries(spark, sf), "q", "content").select("item_id", "query_class", "command", "argument", "year_from")


@query("""select item_id, case item_id % 3 when 0 then 'ACL repair|anterior cruciate ligament repair' when 1 then 'bmi and rom|bmi and range of motion|body mass index and rom' else 'nothing here' end as variants from benchmark""")
def expand_query_batch(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id") % 3
    q = table(spark, sf, "benchmark").select("item_id", F.when(i == 0, "ACL repair").when(i == 1, "bmi and rom").otherwise("nothing here").alias("q"))
    return q.select("item_id", F.array_join(planner.expansions("q"), "|").alias("variants"))


_L2 = "sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))))"


def _vector(spark: SparkSession, sf: str) -> list[float]:
    return list(table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


@query(f"select v.vec_id, round(1 - {_L2}, 4) as score from embeddings v, (select embedding from embeddings where vec_id = 0) q order by {_L2}, v.vec_id limit 20")
def knn_l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.knn(table(spark, sf, "embeddings"), _vector(spark, sf), 20).select("vec_id", F.round(vectors.score(F.col("distance")), 4).alias("score"))


@query(f"select v.vec_id, v.label, round(1 - {_L2}, 4) as score from embeddings v, (select embedding from embeddings where vec_id = 0) q where v.label = 3 order by {_L2}, v.vec_id limit 10")
def knn_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.knn(table(spark, sf, "embeddings"), _vector(spark, sf), 10, scope=F.col("label") == 3).select("vec_id", "label", F.round(vectors.score(F.col("distance")), 4).alias("score"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf)])
    return rows.select(F.when(F.col("vec_id") % 4 == 0, "object").otherwise("body").alias("source"), (F.floor(F.col("vec_id") / 2) * 2).cast("long").alias("unit_id"), F.col("label").alias("paper_id"), F.round(1 - vectors.l2("embedding", q), 6).alias("score"))


_HITS_SQL = f"hits as (select case when v.vec_id % 4 = 0 then 'object' else 'body' end as source, (v.vec_id // 2 * 2)::bigint as unit_id, v.label as paper_id, round(1 - {_L2}, 6) as score from embeddings v, (select embedding from embeddings where vec_id = 0) q)"


@query(f"""with {_HITS_SQL}, u as (select * from hits qualify row_number() over (partition by source, unit_id order by score desc, paper_id) = 1),
  p as (select * from u qualify row_number() over (partition by paper_id order by score desc, source, unit_id) <= 2) select source, unit_id, paper_id, score from p order by score desc, source, unit_id limit 12""")
def merge_retrieve_cap2(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.merge_capped(_hits(spark, sf), 12).select("source", "unit_id", "paper_id", "score")


@query(f"""with {_HITS_SQL}, t as (select doc_id as unit_id, doc_id % 7 as paper_id, round(1 - 1.0::double / (1 + n_chars / 1000.0::double), 6) as bm25_score from documents),
  v as (select source, unit_id, max(score) as s, min(paper_id) as paper_id from hits group by 1, 2), w as (select *, case when s > 0 then 1 - 1 / (1 + s) else 0 end as nv from v),
  r as (select 0 as tier, 'body' as source, t.unit_id, t.paper_id, case when w.s is not null then 0.3 * bm25_score + 0.7 * w.nv else bm25_score end as score from t left join w on w.source = 'body' and w.unit_id = t.unit_id
    union all select 1, source, unit_id, paper_id, nv from w where source = 'object')
  select tier, source, unit_id::bigint as unit_id, round(score, 4) as score from r order by tier, round(score, 6) desc, unit_id limit 80""")
def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = d.select(F.col("doc_id").alias("unit_id"), (F.col("doc_id") % 7).alias("paper_id"), F.round(1 - 1 / (1 + F.col("n_chars") / 1000), 6).alias("bm25_score"))
    return vectors.fuse(text, _hits(spark, sf).withColumnRenamed("score", "vec_score"), 80).select("tier", "source", "unit_id", F.round("score", 4).alias("score"))


@query("""with h as (select case when vec_id % 4 = 0 then 'object' else 'body' end as source, vec_id as unit_id, vec_id as paper_id from embeddings),
  b as (select doc_id as unit_id, source as section_path, text from documents), o as (select page_id as unit_id, url as section_path, html as text from pages)
  select h.source, h.unit_id, coalesce(case when h.source = 'body' then b.section_path end, case when h.source = 'object' then o.section_path end) as section_path, l.quality, coalesce(case when h.source = 'body' then b.text end, case when h.source = 'object' then o.text end) is null as unresolved
  from h left join b using (unit_id) left join o using (unit_id) left join labels l on l.doc_id = h.paper_id""")
def hit_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "embeddings").select(F.when(F.col("vec_id") % 4 == 0, "object").otherwise("body").alias("source"), F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("paper_id"))
    b = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("paper_id"), F.col("source").alias("section_path"), F.col("text").alias("unit_text"))
    o = table(spark, sf, "pages").select(F.col("page_id").alias("unit_id"), F.col("page_id").alias("paper_id"), F.col("url").alias("section_path"), F.col("html").alias("unit_text"))
    m = table(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"), "quality")
    return vectors.enrich(h, b, o, m).select("source", "unit_id", "section_path", "quality", "unresolved")


@query("select doc_id as paper_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def reader_gate(spark: SparkSession, sf: str) -> DataFrame:
    state = table(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"), F.when(F.col("quality") == 1, "current").otherwise("stale").alias("state"))
    return vectors.readable(table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "lang"), state)


@query("""with h as (select source, doc_id, text, round(n_chars / 10000.0, 4) as score from documents), t as (select *, row_number() over (partition by source order by score desc, doc_id) as r from h)
  select source, (count(*) filter (length(trim(text)) <= 12) >= 3 or max(score) < 0.62) as low from t where r <= 5 group by 1""")
def low_confidence_flag(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "documents").select("source", "doc_id", "text", F.round(F.col("n_chars") / 10000, 4).alias("score"))
    return vectors.low_confidence(h, tx.generic_chunk("text"), "source", [F.desc("score"), F.col("doc_id")])


@query("select doc_id, i as line, parts[i] as text from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, string_split(text, chr(10)) as parts from documents)) where contains(lower(parts[i]), 'worthless')")
def literal_grep_lines(spark: SparkSession, sf: str) -> DataFrame:
    return search.literal_lines(table(spark, sf, "documents"), "doc_id", "text", "Worthless")


@query("select page_id, i as line from (select page_id, parts, unnest(range(1, len(parts) + 1)) as i from (select page_id, string_split(html, chr(10)) as parts from pages)) where contains(lower(parts[i]), '<h1>')")
def html_literal_grep(spark: SparkSession, sf: str) -> DataFrame:
    return search.literal_lines(table(spark, sf, "pages"), "page_id", "html", "<H1>").select("page_id", "line")


_STATE_SQL = """states as (select *, case when not has_pdf then 'indexed' when ocr_status = 'done' and deep_status = 'done' then 'deep_read_done' when ocr_status = 'done' then 'fulltext_ready' else 'pdf_ready' end as lifecycle,
  case when not has_pdf then 1 when ocr_status <> 'done' then 2 when deep_status <> 'done' then 3 else 4 end as level from papers),
  health as (select *, case when has_pdf and pdf_path = '' then 'pdf path missing' else 'healthy' end as pdf_health,
    case ocr_status when 'done' then 'healthy' when 'failed' then 'ocr failed' when 'processing' then 'ocr in progress' else 'ocr pending' end as ocr_health,
    case when note_path = '' then 'note missing' else 'healthy' end as note_health,
    case when ai_path = '' or fulltext_path = '' or main_note_path = '' then 'missing paths: ' || concat_ws(', ', case when ai_path = '' then 'ai_path' end, case when fulltext_path = '' then 'fulltext_path' end, case when main_note_path = '' then 'main_note_path' end) else 'healthy' end as asset_health from states)"""


@query(f"""with {PAPERS_SQL}, {_STATE_SQL} select paper_id, lifecycle, level, case level when 1 then 'pdf' when 2 then 'fulltext' when 3 then 'deep_read' end as blocking,
  case when ocr_status = 'failed' then 'ocr' when not has_pdf then 'sync' when ocr_status = 'pending' then 'ocr' when ocr_status = 'processing' then 'ready'
    when note_path = '' or fulltext_path = '' or main_note_path = '' or ai_path = '' then 'sync' when ocr_status = 'done' and deep_status = 'pending' then 'deep_read' else 'ready' end as next_step from states""")
def lifecycle_derive(spark: SparkSession, sf: str) -> DataFrame:
    return derive.derived(papers(spark, sf)).select("paper_id", "lifecycle", "maturity.level", "maturity.blocking", "next_step")


@query(f"with {PAPERS_SQL}, {_STATE_SQL} select paper_id, pdf_health, ocr_health, note_health, asset_health from health")
def health_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return derive.derived(papers(spark, sf)).select("paper_id", "health.*")


@query(f"""with {PAPERS_SQL} select count(*) as papers, count(*) filter (has_pdf) as pdf_healthy, count(*) filter (not has_pdf) as pdf_missing, count(*) filter (ocr_status = 'done') as ocr_done,
  count(*) filter (ocr_status in ('pending', 'processing')) as ocr_pending, count(*) filter (ocr_status = 'failed') as ocr_failed from papers""")
def dashboard_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.dashboard(papers(spark, sf))


@query(f"""with {PAPERS_SQL}, {_STATE_SQL} select 'total' as dimension, '' as value, count(*) as n from states union all select 'domain', domain, count(*) from states group by 2
  union all select 'lifecycle', lifecycle, count(*) from states group by 2 union all select 'ocr_status', ocr_status, count(*) from states group by 2 union all select 'deep_status', deep_status, count(*) from states group by 2""")
def agent_context_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.agent_context(papers(spark, sf))


@query("select r_name as root, count(*) as n, string_agg(distinct n_name, ',' order by n_name) as subs from region join nation on r_regionkey = n_regionkey group by 1")
def collection_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat_ws("|", "r_name", "n_name").alias("path"))
    return aggregate.collection_tree(rows, "path")


_NODES_SQL = "nodes as (select 'r' || r_regionkey as k, null as p, r_name as n from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation union all select 'c' || c_custkey, 'n' || c_nationkey, c_name from customer)"


@query(f"with recursive {_NODES_SQL}, t as (select k, n::varchar as path, 1 as depth from nodes where p is null union all select c.k, t.path || '/' || c.n, t.depth + 1 from nodes c join t on c.p = t.k) select k as key, path, depth from t")
def collection_paths_recursive(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf, "region").select(s("r", "r_regionkey").alias("k"), F.lit(None).cast("string").alias("p"), F.col("r_name").alias("n"))
    n = table(spark, sf, "nation").select(s("n", "n_nationkey").alias("k"), s("r", "n_regionkey").alias("p"), F.col("n_name").alias("n"))
    c = table(spark, sf, "customer").select(s("c", "c_custkey").alias("k"), s("n", "c_nationkey").alias("p"), F.col("c_name").alias("n"))
    return derive.tree_paths(spark, r.unionByName(n).unionByName(c), "k", "p", "n")


@query(f"""with {PAPERS_SQL}, {_STATE_SQL}, seeds as (select * from (values ('lifecycle', 'indexed'), ('lifecycle', 'pdf_ready'), ('lifecycle', 'fulltext_ready'), ('lifecycle', 'deep_read_done'),
  ('maturity', '1'), ('maturity', '2'), ('maturity', '3'), ('maturity', '4'), ('maturity', '5'), ('maturity', '6'), ('pdf_health', 'healthy'), ('pdf_health', 'unhealthy'), ('ocr_health', 'healthy'), ('ocr_health', 'unhealthy'),
  ('note_health', 'healthy'), ('note_health', 'unhealthy'), ('asset_health', 'healthy'), ('asset_health', 'unhealthy')) s(kind, value)),
  f as (select 'lifecycle' as kind, lifecycle as value from health union all select 'maturity', level::varchar from health union all select 'pdf_health', case when pdf_health = 'healthy' then 'healthy' else 'unhealthy' end from health
    union all select 'ocr_health', case when ocr_health = 'healthy' then 'healthy' else 'unhealthy' end from health union all select 'note_health', case when note_health = 'healthy' then 'healthy' else 'unhealthy' end from health
    union all select 'asset_health', case when asset_health = 'healthy' then 'healthy' else 'unhealthy' end from health)
  select kind, value, count(f.kind) as n from seeds left join f using (kind, value) group by 1, 2""".replace("count(f.kind)", "count(*) filter (f.x)").replace("f as (select", "g as (select").replace("seeds left join f using", "seeds left join (select *, true as x from g) f using"))
def index_summary(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.index_summary(papers(spark, sf))


@query("""with a as (select l_orderkey as owner, case when l_linenumber = 3 then 'PDF' else l_returnflag || l_linenumber end as title, l_quantity::bigint as size, l_linenumber as ord, l_partkey, l_suppkey from lineitem),
  b as (select *, size = max(size) over (partition by owner) and size > 0 as big from a), c as (select *, count(*) filter (big) over (partition by owner) as bigs from b)
  select owner, title, size, ord from c qualify row_number() over (partition by owner order by case when title = 'PDF' then 0 else 1 end, case when big and bigs = 1 then 0 else 1 end, length(title), ord, l_partkey, l_suppkey) = 1""".replace("ord, l_partkey, l_suppkey) = 1", "ord) = 1").replace(", l_partkey, l_suppkey from lineitem", " from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey)"))
def main_attachment_pick(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))).filter("r = 1")
    rows = rows.select(F.col("l_orderkey").alias("owner"), F.when(F.col("l_linenumber") == 3, "PDF").otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("title"), F.col("l_quantity").cast("long").alias("size"), F.col("l_linenumber").alias("ord"))
    return derive.main_attachment(rows, "owner", "title", "size", "ord").select("owner", "title", "size", "ord")


@query("select conv_id, string_agg('turn ' || turn, ';' order by turn) as authors from conversations where role = 'user' group by 1")
def authors_concat(spark: SparkSession, sf: str) -> DataFrame:
    c = F.struct(F.when(F.col("role") == "user", "author").otherwise("editor").alias("creatorType"), F.lit("turn").alias("firstName"), F.col("turn").cast("string").alias("lastName"), F.lit(None).cast("string").alias("name"), "turn")
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", c.alias("c")))).alias("cs")).withColumn("creators", F.transform("cs", lambda x: x.c))
    return rows.select("conv_id", F.array_join(tx.authors(F.col("creators")), ";").alias("authors")).filter("authors != ''")


@query("""with o as (select c_custkey as k, c_name || c_mktsegment as h from customer where c_custkey % 5 <> 0), n as (select c_custkey as k, case when c_custkey % 7 = 0 then c_name || 'x' else c_name || c_mktsegment end as h from customer where c_custkey % 3 <> 0)
  select k, case when o.h is null then 'added' when n.h is null then 'deleted' when o.h <> n.h then 'changed' else 'unchanged' end as change from o full join n using (k)""")
def state_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "k")
    old = c.filter("k % 5 <> 0").select("k", lineage.digest("c_name", "c_mktsegment").alias("h"))
    new = c.filter("k % 3 <> 0").select("k", F.when(F.col("k") % 7 == 0, lineage.digest(F.concat("c_name", F.lit("x")))).otherwise(lineage.digest("c_name", "c_mktsegment")).alias("h"))
    return diff.state_diff(old, new, "k", "h")


@query("""select k, bool_or(c = 'l') as in_labels, bool_or(c = 'p') as in_pages, bool_or(c = 'e') as in_vectors from (select doc_id as k, 'l' as c from labels union all select page_id, 'p' from pages union all select vec_id, 'e' from embeddings)
  where k not in (select doc_id from documents where lang = 'en') group by 1""")
def residual_carriers(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda t, c: table(spark, sf, t).select(F.col(c).alias("k"))
    authority = table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("k"))
    return diff.residual_carriers(authority, {"labels": key("labels", "doc_id"), "pages": key("pages", "page_id"), "vectors": key("embeddings", "vec_id")}, "k")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def orphan_anti(spark: SparkSession, sf: str) -> DataFrame:
    return diff.orphans(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey")


@query("""with r as (select p_partkey as id, case when p_partkey % 3 = 0 then lower(p_name) else '' end as doi, case when p_partkey % 2 = 0 then p_brand else '' end as pmid, p_type as title from part),
  i as (select s_suppkey as key, case s_suppkey % 4 when 0 then 'small ring' else 'none' || s_suppkey end as doi, 'Brand#' || (s_suppkey % 30) as pmid, case when s_suppkey % 9 = 0 then 'ECONOMY' else '' end as title from supplier),
  d as (select doi, min(key) as k from i group by 1), p as (select pmid, min(key) as k from i group by 1), t as (select title, min(key) as k from i where title <> '' group by 1)
  select id, coalesce(d.k, p.k, t.k) as matched_key, case when d.k is not null then 'doi' when p.k is not null then 'pmid' when t.k is not null then 'title' end as matched_by from r left join d using (doi) left join p using (pmid) left join t using (title)""")
def multi_key_match(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    r = table(spark, sf, "part").select(k.alias("id"), F.when(k % 3 == 0, F.lower("p_name")).otherwise("").alias("doi"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("pmid"), F.col("p_type").alias("title"))
    s = F.col("s_suppkey")
    i = table(spark, sf, "supplier").select(s.alias("key"), F.when(s % 4 == 0, "small ring").otherwise(F.concat(F.lit("none"), s.cast("string"))).alias("doi"), F.concat(F.lit("Brand#"), (s % 30).cast("string")).alias("pmid"), F.when(s % 9 == 0, "ECONOMY").otherwise("").alias("title"))
    return lookup.library_match(r, i, ["doi", "pmid", "title"], ["key"], "key").select("id", "matched_key", "matched_by")


@query("""with o as (select c_custkey as k, c_name as title, case when c_custkey % 2 = 0 then c_mktsegment else ' ' end as decision from customer where c_custkey % 5 <> 0), n as (select c_custkey as k, upper(c_name) as title, 'NEW' as decision from customer where c_custkey % 3 <> 0)
  select k, coalesce(n.title, o.title) as title, coalesce(case when trim(o.decision) <> '' then o.decision end, n.decision, o.decision) as decision from o full join n using (k)""")
def candidate_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "k")
    old = c.filter("k % 5 <> 0").select("k", F.col("c_name").alias("title"), F.when(F.col("k") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("decision"))
    new = c.filter("k % 3 <> 0").select("k", F.upper("c_name").alias("title"), F.lit("NEW").alias("decision"))
    return diff.upsert(old, new, "k", ["decision"])


@query("""with r as (select doc_id, substr(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]', '', 'g'), 1, 20) as title20, doc_id % 2 = 0 as exported, doc_id % 5 = 0 as has_pdf from documents)
  select doc_id, title20 from r where title20 <> '' and not exported and not has_pdf and title20 in (select title20 from r where exported)""")
def duplicate_title_orphans(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), (F.col("doc_id") % 2 == 0).alias("exported"), (F.col("doc_id") % 5 == 0).alias("has_pdf"))
    return diff.duplicate_title_orphans(rows, "title", "exported", "has_pdf").select("doc_id", "title20")


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as created_at, event_type from events where strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-02' order by 2 desc, 1 limit 50")
def events_since_limit(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "event_type")
    return logs.since(log, "created_at", "event_id", "2024-01-02")


@query("select event_id, user_id, coalesce(c_name, user_id::varchar) as label from events left join customer on c_custkey = user_id * 3")
def event_log_enriched(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("event_id", "user_id", (F.col("user_id") * 3).alias("customer"))
    out = logs.enriched(log, table(spark, sf, "customer"), "customer", "c_custkey", "c_name")
    return out.select("event_id", "user_id", F.when(F.col("label") == F.col("customer").cast("string"), F.col("user_id").cast("string")).otherwise(F.col("label")).alias("label"))


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def corrections_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return logs.latest_corrections(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("select conv_id, string_agg(role || ': ' || length(text), chr(10) order by turn) as body, count(*) as n from conversations group by 1")
def render_log_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return logs.render_grouped(table(spark, sf, "conversations"), "conv_id", ["turn"], F.concat("role", F.lit(": "), F.length("text").cast("string")))


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of pages: opening tags that carry content, in order."""
    tag = F.regexp_extract_all("html", F.lit(r"<(h[1-6]|p|li|table|img|a)[ >/]"), F.lit(1))
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("paper_id"), F.posexplode(tag).alias("ord", "tag"))
    role = F.when(F.col("tag").startswith("h"), "section_heading").when(F.col("tag") == "p", "body_paragraph").when(F.col("tag") == "table", "table").when(F.col("tag") == "img", "figure").otherwise("other")
    return rows.select("paper_id", F.col("ord").cast("long").alias("ord"), "tag", role.alias("role"), F.lit(1).alias("page"), F.col("ord").cast("string").alias("block_id"))


_TAGS_SQL = "tags as (select page_id as paper_id, (i - 1)::bigint as ord, l[i] as tag from (select page_id, l, unnest(range(1, len(l) + 1)) as i from (select page_id, regexp_extract_all(html, '<(h[1-6]|p|li|table|img|a)[ >/]', 1) as l from pages)))"
_ROLE_SQL = "case when tag[1] = 'h' then 'section_heading' when tag = 'p' then 'body_paragraph' when tag = 'table' then 'table' when tag = 'img' then 'figure' else 'other' end"


@query(f"with {_TAGS_SQL} select paper_id, {_ROLE_SQL} as role, count(*) as n from tags group by 1, 2")
def role_index_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.role_counts(_tags(spark, sf))


@query(r"""with l as (select item_id, case item_id % 8 when 0 then 'Figure 3. ' || text when 1 then '[12] Smith AB.' when 2 then '3.1 Methods of work' when 3 then 'IV. RESULTS' when 4 then '(a)' when 5 then 'Discussion' when 6 then '12. ' || text else text end as t, text from benchmark)
  select item_id, case item_id % 8 when 0 then 'figure_number' when 1 then 'reference_numeric_bracket' when 2 then 'heading_numbered' when 3 then 'heading_roman' when 4 then 'panel_label' when 5 then 'canonical_section_name'
    when 6 then 'reference_numeric_dot' else case when regexp_matches(trim(text), '^[A-Z][a-z]+''?[a-z]* [A-Z](?:\.[, ]|[A-Z]\.?,|[,\s])') then 'citation_line' when length(trim(text)) < 20 then 'short_fragment' else 'none' end end as marker from l""")
def marker_type_classify(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id") % 8
    t = F.when(i == 0, F.concat(F.lit("Figure 3. "), F.col("text"))).when(i == 1, "[12] Smith AB.").when(i == 2, "3.1 Methods of work").when(i == 3, "IV. RESULTS").when(i == 4, "(a)").when(i == 5, "Discussion").when(i == 6, F.concat(F.lit("12. "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", tx.marker_type(t).alias("marker"))


@query(f"""with {_TAGS_SQL}, h as (select paper_id, ord, tag[2]::int as level from tags where tag[1] = 'h'), m as (select paper_id, max(ord) as last from tags group by 1)
  select h.paper_id, h.ord, h.level, coalesce((select min(n.ord) - 1 from h n where n.paper_id = h.paper_id and n.ord > h.ord and n.level <= h.level), m.last) as end from h join m using (paper_id)""".replace(" as end from", ' as "end" from'))
def heading_intervals(spark: SparkSession, sf: str) -> DataFrame:
    t = _tags(spark, sf)
    heads = t.filter("role = 'section_heading'").select("paper_id", "ord", F.substring("tag", 2, 1).cast("int").alias("level"))
    return blocks.heading_intervals(heads, "paper_id", t.groupBy("paper_id").agg(F.max("ord").alias("last"))).select("paper_id", "ord", "level", "end")


@query("""with d as (select event_id, user_id, value from events), n as (select *, case when value - lag(value) over (partition by user_id order by value, event_id) > 2.5 then 1 else 0 end as new from d),
  c as (select *, (sum(new) over (partition by user_id order by value, event_id rows unbounded preceding))::bigint as cluster from n)
  select user_id, cluster, count(*) as n, min(value) as least, max(value) as most, list_sort(list(value))[count(*) // 2 + 1] as middle from c group by 1, 2""")
def gap_clusters_1d(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.cluster_stats(blocks.gap_clusters(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value", 2.5, "event_id"), "user_id", "value")


@query("""with e as (select label as doc, vec_id // 4 as page, round(abs(embedding[1]::double) * 1000, 2) as edge from embeddings), p as (select doc, page, max(edge) as v from e group by 1, 2),
  n as (select *, case when v - lag(v) over (partition by doc order by v, page) > 25 then 1 else 0 end as new from p), c as (select *, sum(new) over (partition by doc order by v, page rows unbounded preceding) as cluster from n),
  g as (select doc, cluster, count(*) as n, min(v) as least, list_sort(list(v)) as vs from c group by 1, 2), t as (select doc, count(*) as pages from p group by 1)
  select doc, pages, n, case when n >= greatest(2, ceil(0.2 * pages)) then vs[ceil(0.9 * (n - 1))::int + 1] end as band, case when n >= greatest(2, ceil(0.2 * pages)) then 'accept' else 'hold' end as status
  from g join t using (doc) qualify row_number() over (partition by doc order by n desc, least) = 1""")
def layout_bands(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("label").alias("doc"), F.floor(F.col("vec_id") / 4).alias("page"), F.round(F.abs(F.get("embedding", F.lit(0)).cast("double")) * 1000, 2).alias("edge"))
    return blocks.header_band(e, "doc", "page", "edge", 25.0)


@query("""with b as (select label as page, vec_id, round(embedding[1]::double * 1000, 1) as x, round(embedding[2]::double * 1000, 1) as y from embeddings)
  select page, vec_id, case when x < 0 then 0 else 1 end as col, row_number() over (partition by page order by case when x < 0 then 0 else 1 end, y, x, vec_id) as ord from b""")
def column_order(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.column_order(_boxes(spark, sf), "page", "x", "y", 0.0, "vec_id").select("page", "vec_id", "col", "ord")


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double") * 1000, 1)
    return table(spark, sf, "embeddings").select(F.col("label").alias("page"), "vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("w"), at(3).alias("h"))


_BOX_SQL = """boxes as (select label as page, vec_id as id, round(embedding[1]::double * 1000, 1) as x1, round(embedding[2]::double * 1000, 1) as y1, round(embedding[1]::double * 1000, 1) + 50 + abs(round(embedding[3]::double * 1000, 1)) as x2,
  round(embedding[2]::double * 1000, 1) + 50 + abs(round(embedding[4]::double * 1000, 1)) as y2 from embeddings)"""


def _rects(spark: SparkSession, sf: str) -> DataFrame:
    b = _boxes(spark, sf)
    return b.select("page", F.col("vec_id").alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 50 + F.abs("w")).alias("x2"), (F.col("y") + 50 + F.abs("h")).alias("y2"))


@query(f"""with {_BOX_SQL}, l as (select *, 0.3 + id % 3 * 0.2 as caption from boxes where id % 5 = 0), p as (select l.page, l.id as lid, a.id as aid, l.x1 as lx1, l.x2 as lx2, l.y1 as ly1, l.y2 as ly2, a.x1 as ax1, a.x2 as ax2, a.y1 as ay1, a.y2 as ay2, caption::double as caption from l join boxes a on a.page = l.page and a.id % 5 <> 0),
  s as (select *, greatest(0, least(lx2, ax2) - greatest(lx1, ax1)) / least(lx2 - lx1, ax2 - ax1) >= 0.4 as over, greatest(0, ax1 - lx2, lx1 - ax2) as gap from p),
  t as (select *, not over and gap < 0.3 * least(lx2 - lx1, ax2 - ax1) and gap < 80 as beside from s),
  u as (select *, case when caption < 0.4 then caption else least(1.0, 0.3 + case when over then 0.25 when beside then 0.2 else 0 end + case when least(abs(ly1 - ay2), abs(ay1 - ly2)) <= 300 then 0.2 else 0 end + case when ay2 <= ly1 or ay1 >= ly2 then 0.1 else 0 end + least(0.15, caption * 0.15))::double end as sc from t)
  select page, lid as legend_id, aid as asset_id, round(sc, 4) as score, case when caption < 0.4 then 'rejected' when sc >= 0.6 and (over or beside) then 'matched' when sc >= 0.4 then 'ambiguous' else 'rejected' end as decision from u""".replace("0.3 + id % 3 * 0.2 as caption", "(30 + id % 3 * 20) / 100.0::double as caption").replace("else 0 end", "else 0.0::double end").replace("then 0.25 when beside then 0.2", "then 0.25::double when beside then 0.2::double").replace("then 0.2 else", "then 0.2::double else").replace("then 0.1 else", "then 0.1::double else").replace("least(1.0, 0.3 +", "least(1.0::double, 0.3::double +").replace("least(0.15, caption * 0.15)", "least(0.15::double, caption * 0.15::double)"))
def caption_asset_score(spark: SparkSession, sf: str) -> DataFrame:
    r = _rects(spark, sf)
    return blocks.figure_match(r.filter("id % 5 = 0").withColumn("caption", (F.lit(30) + F.col("id") % 3 * 20) / 100.0), r.filter("id % 5 <> 0"), "page")


@query(f"""with recursive {_BOX_SQL}, e as (select a.page, a.id as a, b.id as b from boxes a join boxes b on a.page = b.page and greatest(a.x1 - b.x2, b.x1 - a.x2) <= 72 and greatest(a.y1 - b.y2, b.y1 - a.y2) <= 48),
  reach as (select page, a, b from e union select r.page, r.a, e.b from reach r join e on e.page = r.page and e.a = r.b) select page::bigint as page, a as id, min(b) as cluster from reach group by 1, 2""")
def asset_components(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.asset_clusters(_rects(spark, sf).withColumn("page", F.col("page").cast("long")), "page", 600.0, 800.0)


@query()
def pairing_greedy(spark: SparkSession, sf: str) -> DataFrame:
    b = _rects(spark, sf).withColumn("paper_id", F.col("page").cast("long")).withColumn("page", (F.col("id") % 3).cast("long")).withColumn("kind", F.when(F.col("id") % 5 == 0, "legend").otherwise("asset"))
    return pairing.pair(b)


@query("""with g as (select l_orderkey as o, count(*) as n, max(l_linenumber) as most, list(distinct l_linenumber) as seen from lineitem where l_linenumber <> 2 group by 1)
  select o, n, most, len(list_filter(range(1, most + 1), lambda x: not list_contains(seen, x::int)))::bigint as n_missing, array_to_string(list_filter(range(1, most + 1), lambda x: not list_contains(seen, x::int)), ',') as missing from g""")
def reference_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.missing_numbers(table(spark, sf, "lineitem").filter("l_linenumber <> 2").withColumnRenamed("l_orderkey", "o"), "o", "l_linenumber")


@query("select p_brand, count(*) as n, round(avg(p_size), 4) as mean_size, min(p_size) as least, max(p_size) as most, round(stddev_pop(p_size), 4) as spread, case when count(*) >= 10 then 'strong' when count(*) >= 3 then 'moderate' else 'weak' end as grade from part group by 1")
def profile_stats(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.profile(table(spark, sf, "part"), "p_brand", "p_size")


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("paper_id")
    p = papers(spark, sf).select("paper_id", "title", F.col("first_author").alias("authors"), "n_chars", (i % 14).alias("gap_count"), F.when(i % 9 == 0, "weak").when(i % 9 == 1, "partial").otherwise("strong").alias("spine"), (i % 4 != 0).alias("refs_found"), (i % 5).alias("headings"), F.when(i % 6 == 0, "fail").otherwise("pass").alias("layout"), F.when(i % 10 == 0, 1).otherwise(0).alias("anomalies"), F.when(i % 8 == 0, "short_form").otherwise("standard").alias("profile"), (i % 3).alias("captions"), (i % 4).alias("assets"), F.lit(0).alias("unresolved"), (i % 12 == 0).alias("degraded"), F.lit("strong").alias("coverage"))
    return p.withColumns({"q_text": quality.text_integrity(), "q_structure": quality.structure(), "q_figures": quality.figures(), "q_metadata": quality.metadata(), "q_confidence": quality.confidence()})


_RULES = [{"rule": "rendered_text_gap_excessive", "all": [{"field": "gap_count", "op": "gt", "value": 10}]}, {"rule": "body_weak_and_no_refs", "all": [{"field": "spine", "op": "eq", "value": "weak"}, {"field": "refs_found", "op": "eq", "value": False}]}, {"rule": "fulltext_too_short", "all": [{"field": "n_chars", "op": "lt", "value": 2000}]}]
_DIMS = {"text": "q_text", "structure": "q_structure", "figures": "q_figures", "metadata": "q_metadata", "confidence": "q_confidence"}
_QUALITY_SQL = f"""{PAPERS_SQL}, i as (select paper_id, title, first_author as authors, n_chars, paper_id % 14 as gap_count, case paper_id % 9 when 0 then 'weak' when 1 then 'partial' else 'strong' end as spine, paper_id % 4 <> 0 as refs_found, paper_id % 5 as headings,
    paper_id % 6 = 0 as failed, paper_id % 10 = 0 as anomaly, paper_id % 8 <> 0 as standard, paper_id % 3 as captions, paper_id % 4 as assets, paper_id % 12 = 0 as degraded from papers),
  q as (select *, case when gap_count > 10 then 'red' when gap_count >= 4 or spine = 'weak' then 'yellow' else 'green' end as q_text,
    case when standard and not refs_found and headings < 2 then 'red' when failed and spine = 'weak' then 'red' when anomaly or spine = 'partial' then 'yellow' else 'green' end as q_structure,
    case when captions = 0 and assets = 0 then 'not_applicable' when captions > assets then 'red' else 'green' end as q_figures, case when title = '' or authors = '' then 'yellow' else 'green' end as q_metadata, case when degraded then 'yellow' else 'green' end as q_confidence,
    concat_ws(',', case when gap_count > 10 then 'rendered_text_gap_excessive' end, case when spine = 'weak' and not refs_found then 'body_weak_and_no_refs' end, case when n_chars < 2000 then 'fulltext_too_short' end) as triggers from i),
  w as (select *, 0.35::double * case q_text when 'green' then 1 when 'yellow' then 0.6::double else 0.2::double end + 0.25::double * case q_structure when 'green' then 1 when 'yellow' then 0.6::double else 0.2::double end
    + case q_figures when 'not_applicable' then 0 when 'green' then 0.2::double else 0.2::double * 0.2::double end + 0.1::double * case q_metadata when 'green' then 1 else 0.6::double end + 0.1::double * case q_confidence when 'green' then 1 else 0.6::double end as got, case when q_figures = 'not_applicable' then 0.8::double else 1.0::double end as total from q),
  r as (select *, got / total as mean from w)"""


@query(f"with {_QUALITY_SQL} select paper_id, round(case when triggers <> '' then least(mean, 0.3) else mean end, 3) as score, case when triggers <> '' then 'red' when mean >= 0.75 then 'green' when mean >= 0.4 then 'yellow' else 'red' end as status, case when q_figures = 'not_applicable' then 'not_applicable' when q_figures = 'red' then 'blocked' else 'recommended' end as figure_use, case when q_structure = 'green' and q_text <> 'red' then 'recommended' else 'blocked' end as chunk_use from r")
def quality_readiness(spark: SparkSession, sf: str) -> DataFrame:
    r = _quality(spark, sf).withColumn("t", quality.hard_red(_RULES)).withColumn("r", quality.readiness(_DIMS, F.col("t")))
    return r.select("paper_id", F.round("r.score", 3).alias("score"), "r.status", quality.use_case("figure_table_reasoning", _DIMS).alias("figure_use"), quality.use_case("section_chunking", _DIMS).alias("chunk_use"))


@query(f"with {_QUALITY_SQL} select paper_id, triggers from r where triggers <> ''")
def hard_red_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).select("paper_id", F.array_join(quality.hard_red(_RULES), ",").alias("triggers")).filter("triggers != ''")


@query(f"""with {UNITS_SQL}, d as (select paper_id, part, sha256(unit_id || chr(31) || section_path || chr(31) || unit_text) as d from units) select paper_id, count(*) as n_units, sha256('{lineage.POLICY}' || string_agg(d, '' order by part)) as units_hash from d group by 1""")
def manifest_hash(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.manifests(units(spark, sf))


def _lineage(spark: SparkSession, sf: str) -> DataFrame:
    i, q = F.col("paper_id"), F.col("quality")
    p = papers(spark, sf)
    ocr = F.when(q == 1, "current").when(q == 0, "failed").when(i % 4 == 0, "stale").when(i % 4 == 1, "incomplete").otherwise("missing")
    p = p.withColumn("ocr", ocr).withColumn("m_ocr", F.when(i % 5 != 0, F.lit("h"))).withColumn("policy", F.when(i % 5 != 0, F.when(i % 6 == 0, "units.v1").otherwise(lineage.POLICY))).withColumn("stored", F.when(i % 5 != 0, F.lit("r")))
    p = p.withColumn("retrieval", F.when(F.col("ocr") == "failed", "missing").otherwise(lineage.retrieval_state(F.col("ocr"), F.col("m_ocr"), F.lit("h"), F.col("policy"), F.col("stored"), F.lit("r"))))
    return p.withColumn("vector", lineage.vector_state(i % 3 != 0, F.col("retrieval"), F.when(i % 7 != 0, F.when(i % 8 == 0, "old").otherwise("r")), F.lit("r"), F.lit("e"), F.lit("e")))


_LINEAGE_SQL = f"""{PAPERS_SQL}, o as (select paper_id, case when quality = 1 then 'current' when quality = 0 then 'failed' when paper_id % 4 = 0 then 'stale' when paper_id % 4 = 1 then 'incomplete' else 'missing' end as ocr from papers),
  r as (select *, case when ocr = 'failed' then 'missing' when ocr <> 'current' then ocr when paper_id % 5 = 0 then 'missing' when paper_id % 6 = 0 then 'stale' else 'current' end as retrieval from o),
  v as (select *, case when paper_id % 3 = 0 then 'missing' when retrieval = 'incomplete' then 'incomplete' when paper_id % 7 = 0 then 'unknown' when retrieval <> 'current' or paper_id % 8 = 0 then 'stale' else 'current' end as vector from r)"""


@query(f"with {_LINEAGE_SQL} select paper_id, ocr, retrieval, vector from v")
def lineage_states(spark: SparkSession, sf: str) -> DataFrame:
    return _lineage(spark, sf).select("paper_id", "ocr", "retrieval", "vector")


@query(f"""with {_LINEAGE_SQL}, a as (select paper_id, case when ocr in ('missing', 'failed') then 'ocr.run' when ocr in ('stale', 'incomplete') then 'ocr.rebuild_derived' end as action from v
  union all select paper_id, 'memory.build' from v where retrieval in ('stale', 'missing') and ocr = 'current' union all select paper_id, 'embed.resume' from v where vector in ('stale', 'missing') and retrieval = 'current')
  select action, count(distinct paper_id) as n_papers from a where action is not null group by 1""")
def reconcile_intents(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lineage(spark, sf).select("paper_id", "ocr", "retrieval", "vector", F.lit(None).cast("string").alias("ocr_detail"), F.lit(None).cast("string").alias("vector_detail"))
    return lineage.merge_intents(lineage.intents(rows))


@query(f"with {PAPERS_SQL}, {UNITS_SQL}, n as (select paper_id, count(*) as n_units from units where paper_id % 4 <> 0 group by 1) select paper_id, coalesce(n_units, 0) as n_units, case when ocr_status <> 'done' then 'not_ready' when n_units is null then 'no_content' else 'eligible' end as state from papers left join n using (paper_id)")
def embed_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.eligibility(papers(spark, sf), units(spark, sf).filter("paper_id % 4 <> 0"))


@query("""with e as (select list_distinct(json_keys(props)) || case when event_id % 3 = 0 then ['extra'] else []::varchar[] end as f from events), i as (select 'missing_required' as code, 'k' as field from e where not list_contains(f, 'k') union all select 'missing_required', 'need' from e where not list_contains(f, 'need')
  union all select 'missing_optional', 'note' from e where not list_contains(f, 'note') union all select 'unknown_field', x from (select unnest(f) as x from e) where x not in ('k', 'need', 'note')) select code, field, count(*) as n from i group by 1, 2""")
def field_drift(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    rows = table(spark, sf, "events").select(F.concat(keys, F.when(F.col("event_id") % 3 == 0, F.array(F.lit("extra"))).otherwise(F.array().cast("array<string>"))).alias("f"))
    return diff.field_drift(rows, "f", ["k", "need"], ["note"])


@query("select item_id, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ') as text from benchmark")
def inverted_index_text(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.filter(F.split("text", " ", -1), lambda x: x != "")).alias("p", "w"))
    m = w.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return m.select("item_id", tx.inverted_index_text(F.col("m")).alias("text"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.tumbling(table(spark, sf, "events")).select(F.col("start").cast("timestamp").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from e)
  select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(table(spark, sf, "events")).select("user_id", F.col("start").cast("timestamp").alias("start"), "n")


@query(f"with {PAPERS_SQL} select 'ocr_status' as layer, ocr_status as state, count(*) as n from papers group by 2 union all select 'deep_status', deep_status, count(*) from papers group by 2")
def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.facets(papers(spark, sf).select("ocr_status", "deep_status"), ["ocr_status", "deep_status"])


@query(f"""with {PAPERS_SQL} select paper_id, case when lower(title) = 'les.' then 100 else 30 end + 50 as score from papers where contains(lower(title), 'les.') and contains(lower(first_author), 'src') order by score desc, paper_id limit 20""")
def resolver_search(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.resolver_search(papers(spark, sf), title="les.", author="src").select("paper_id", "score")
