"""Queries of the text, page and address operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import chunks, html, text, urls
from lexiloom.operators import answers, ingest, rollup
from lexiloom.operators.understanding import checked_citations, question_type, variations
from lexiloom.plans import sql
from lexiloom.sources.store import table

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return put


def _token_rows(tokens) -> list:
    return [F.size(tokens).cast("long").alias("n_tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("tokens_hash")]


@query(f"select doc_id, len(w) as n_tokens, sha256(array_to_string(w, ' ')) as tokens_hash from (select doc_id, {sql.bm25('text')} as w from documents)")
def bm25_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *_token_rows(text.bm25_tokens(F.col("text"))))


@query(f"select doc_id, len(w) as n_tokens, sha256(array_to_string(w, ' ')) as tokens_hash from (select doc_id, {sql.general('text')} as w from documents)")
def general_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *_token_rows(text.general_tokens(F.col("text"))))


@query(f"select conv_id, turn, array_to_string({sql.key_terms('text')}, ' ') as terms from conversations")
def key_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.key_terms(F.col("text")), " ").alias("terms"))


_MARKS = "[" + "".join("\\" + c for c in sql.MARKS).replace("'", "''") + "]"


@query(rf"""
with w as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as w from documents),
c as (select doc_id, length(w) as n, length(regexp_replace(w, '^{_MARKS}+|{_MARKS}+$', '', 'g')) as core from w)
select d.doc_id, coalesce(sum(case when core = 0 then 1 when core is null then 0 else 1 + n - core + greatest(0, core - 10) // 5 end), 0)::bigint as n_estimated from documents d left join c on c.doc_id = d.doc_id group by 1
""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("n_estimated"))


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _rfind(mark: str) -> str:
    return f"(case when strpos(reverse(c), reverse({mark})) = 0 then -1 else length(c) - strpos(reverse(c), reverse({mark})) - (length({mark}) - 1) end)"


@query(f"""
with recursive w as (
  select doc_id, text, length(text) as n, 0::bigint as s, ''::varchar as piece, 0 as i from documents where text <> ''
  union all
  select doc_id, text, n, case when n <= 500 or e >= n then n else e - 100 end, case when n <= 500 then text else trim(substr(text, s + 1, e - s), {_WS}) end, i + 1
  from (select *, case when s + 500 >= n then s + 500 when k > 250 then s + k + 1 when sp > 250 then s + sp else s + 500 end as e
    from (select *, greatest({', '.join(_rfind(m) for m in ("'. '", "'! '", "'? '", "'.' || chr(10)", "'!' || chr(10)", "'?' || chr(10)"))}) as k, {_rfind("' '")} as sp
      from (select *, substr(text, s + 1, 500) as c from w where s < n)))
)
select doc_id, row_number() over (partition by doc_id order by i) - 1 as chunk_index, piece as content from w where i > 0 and piece <> ''
""")
def chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", chunks.chunk_chars()(F.col("text")).alias("c"))
    return rows.select("doc_id", F.posexplode("c").alias("chunk_index", "content"))


@query()
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", chunks.chunk_tokens()(F.col("text")).alias("c"))
    return rows.select("doc_id", F.posexplode("c").alias("chunk_index", "content"))


@query("select doc_id, sha256(coalesce(text, '')) as content_hash from documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("select conv_id, turn, sha256(lower(trim(text))) as query_hash from conversations")
def query_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.query_hash(F.col("text")).alias("query_hash"))


@query(r"""
select doc_id, c as clean, case when length(c) <= 80 then c else substr(c, 1, 77) || '...' end as short
from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as c from documents)
""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    c = text.clean_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", c.alias("clean"), text.truncate_text(c, 80).alias("short"))


def _chain(expr: str) -> str:
    for p in sql.UNSAFE:
        flags, body = p[2 : p.index(")")], p[p.index(")") + 1 :].replace("'", "''")
        expr = f"regexp_replace({expr}, '(?{flags}){body}', '', 'g')"
    return expr


@query(f"select page_id, sha256(h) as hash, length(h) as n_chars from (select page_id, {_chain('html')} as h from pages)")
def sanitize_html(spark: SparkSession, d: str) -> DataFrame:
    h = text.sanitize_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.sha2(h, 256).alias("hash"), F.length(h).cast("long").alias("n_chars"))


@query("select page_id, case " + " ".join(f"when regexp_matches(html, '{p}') then '{why}'" for p, why in sql.SUSPECT) + " end as reason from pages")
def suspicious_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.suspicious_reason(F.col("html")).alias("reason"))


@query(r"""
select doc_id, regexp_replace(regexp_replace(case when length(text) <= 200 then text else substr(text, 1, 200) || '...[truncated]' end,
  '(?i)(password|secret|token|key|auth)\s*[:=]\s*\S+', '\1=[REDACTED]', 'g'), '[A-Za-z0-9]{32,}', '[REDACTED]', 'g') as logged from documents
""")
def log_redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("logged"))


_PATH = r"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_BARE = "regexp_replace(url, '#.*$', '')"


@query(f"""
select page_id, case when {_PATH.format(u=_BARE)} = '/' then {_BARE} else rtrim({_BARE}, '/') end as normal,
  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') as host, {_PATH.format(u='url')} as path from pages
""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.normalize_url(u).alias("normal"), urls.host(u).alias("host"), urls.path(u).alias("path"))


@query(f"""
select page_id, url from (select page_id, url, {_PATH.format(u='url')} as p from pages)
where not regexp_matches(lower(p), '\\.({'|'.join(urls.NON_HTML)})$') and not starts_with(p, '/fr/') and (starts_with(p, '/en/7') or not (starts_with(p, '/en/') or starts_with(p, '/de/')))
  and regexp_matches(lower(url), '^https?://')
""")
def url_filter(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    rules = urls.robots_rules("User-agent: *\nDisallow: /en/\nDisallow: /de/\nAllow: /en/7\n")
    keep = urls.html_like(u) & ~urls.excluded(u, ["/fr/"]) & urls.may_fetch(urls.path(u), rules["allow"], rules["disallow"]) & urls.url_error(u).isNull()
    return table(spark, d, "pages").filter(keep).select("page_id", "url")


_SYSTEM = rf"""
select page_id, url, html, list_filter(string_split({_PATH.format(u='url')}, '/'), lambda s: s <> '') as seg,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as h from pages
"""
_NAME = f"translate(case when len(seg) = 0 then h when seg[1] in ({sql.SECTION_NAMES}) then coalesce(seg[2], h) else seg[1] end, '-_', '  ')"
_TITLE = r"array_to_string(list_transform(regexp_extract_all(lower({n}), '(\p{{L}}+|[^\p{{L}}]+)'), lambda p: upper(p[1:1]) || p[2:]), '')"
_SYSTEMS = f"(select page_id, url, html, {_TITLE.format(n=_NAME)} as system from ({_SYSTEM}))"


@query(f"select page_id, system from {_SYSTEMS}")
def system_detect(spark: SparkSession, d: str) -> DataFrame:
    return rollup.detect_systems(table(spark, d, "pages")).select("page_id", "system")


# Pages of the tables at hand have few kinds of tags and references; the SQL reads them by patterns.
_REFS = "replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_UNSEEN = "regexp_replace(html, '<!--.*?-->|<(style|script)>.*?</(style|script)>', '', 'gs')"
_BARE = lambda x: r"trim(regexp_replace(" + _REFS.format(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')") + r", '[\s\x{85}\x{a0}]+', ' ', 'g'))"


def _markdown_sql() -> str:
    x = r"regexp_replace(regexp_replace(html, '<!--.*?-->|<(style|script|nav|footer)>.*?</(style|script|nav|footer)>', '', 'gs'), '\s+', ' ', 'g')"
    for tags, mark in (("<h1>", "chr(10) || chr(10) || '# '"), ("</?p>|</h1>", "chr(10) || chr(10)"), ("</?b>", "'**'"), ("<br>|<article>|<div[^>]*>", "chr(10)"), ("<[^>]*>", "''")):
        x = f"regexp_replace({x}, '{tags}', {mark}, 'g')"
    return r"trim(regexp_replace(regexp_replace(" + _REFS.format(x) + r", '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), chr(10) || ' ')"


@query(f"""
with c as (select page_id, url, {_UNSEEN} as h from pages)
select page_id, trim({_REFS.format("regexp_extract(h, '<title>(.*?)</title>', 1)")}) as title, {_BARE('h')} as text, len(regexp_extract_all(h, '<h[1-6]>\\s*[^<\\s]'))::bigint as n_headings,
  case when contains(h, '<article>') then 'article' end as main_selector, {_BARE("regexp_extract(h, '<article>(.*?)</article>', 1, 's')")} as main_content,
  array_to_string(list_transform(regexp_extract_all(h, '<a href="([^"]*)"', 1), lambda x: regexp_extract(url, '^https?://[^/]*') || x), chr(10)) as links, '{{}}' as metadata
from c""")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").withColumn("p", html.parse_page(F.col("html"), F.col("url")))
    return rows.select(
        "page_id", "p.title", "p.text", F.size("p.headings").cast("long").alias("n_headings"), "p.main_selector", "p.main_content",
        F.array_join("p.links", "\n").alias("links"), F.to_json("p.metadata").alias("metadata"),
    )


@query(f"select page_id, {_markdown_sql()} as markdown from pages")
def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.html_to_markdown(F.col("html")).alias("markdown"))


@query(rf"""
with m as (select page_id, {_markdown_sql()} as md from pages), h as (select page_id, md, regexp_extract(md, '(?m)^(#{{1,6}}\s+[^\n]+)', 1) as line from m)
select page_id, 0 as section, trim(regexp_replace(regexp_replace(line, '\s*#*$', ''), '^#+\s+', '')) as heading, length(regexp_extract(line, '^#+'))::bigint as level,
  trim(regexp_replace(regexp_replace(line, '\s*#*$', ''), '^#+\s+', '')) as heading_path, trim(substr(md, position(chr(10) || line in chr(10) || md)), chr(10) || ' ') as content from h""")
def md_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", chunks.split_markdown(html.html_to_markdown(F.col("html"))).alias("s"))
    return rows.select("page_id", F.posexplode("s").alias("section", "_s")).select("page_id", "section", "_s.heading", "_s.level", "_s.heading_path", "_s.content")


@query()
def small_large_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunked(ingest.parsed(ingest.prepared(table(spark, d, "pages"))))


@query("""
with p as (select page_id, html, (page_id % 3)::int as k from pages), o as (select page_id, case when k = 1 then html else html || '<!-- old -->' end as h from p where k <> 0)
select p.page_id, case when o.page_id is null then 'new' when sha256(o.h) = sha256(p.html) then 'same' else 'changed' end as change from p left join o on o.page_id = p.page_id
""")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("url"), "html").withColumn("content_hash", text.content_hash(F.col("html")))
    k = F.col("page_id") % 3
    old = pages.filter(k != 0).select("url", text.content_hash(F.when(k == 1, F.col("html")).otherwise(F.concat("html", F.lit("<!-- old -->")))).alias("content_hash"))
    return ingest.changes(pages, old).select("page_id", "change")


@query("""
select doc_id, case when length(source) > 0 or length(lang) > 0 then
  concat_ws(chr(10), case when source <> '' then 'Document: ' || source end, case when lang <> '' then 'Section: ' || lang end) || chr(10) || chr(10) || text else text end as contextual from documents
""")
def contextual_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.contextual_text(F.col("text"), F.col("lang"), F.col("source")).alias("contextual"))


_CITED = "text || ' [CHUNK:' || doc_id || '] see [ chunk : ' || (doc_id + 1) || ' ] and [CHUNK:' || doc_id || ']'"


@query(rf"""
with c as (select doc_id, list_transform(regexp_extract_all({_CITED}, '(?i)\[\s*CHUNK\s*:\s*(\d+)\s*\]', 1), lambda x: x::bigint) as cited from documents)
select doc_id, array_to_string(cited, ',') as cited, array_to_string(list_filter(cited, lambda x: x = doc_id), ',') as valid_citations,
  array_to_string(list_filter(cited, lambda x: x <> doc_id), ',') as invalid_citations, len(list_filter(cited, lambda x: x <> doc_id)) = 0 as is_valid from c
""")
def validate_citations(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    answer = F.concat("text", F.lit(" [CHUNK:"), n, F.lit("] see [ chunk : "), n + 1, F.lit(" ] and [CHUNK:"), n, F.lit("]"))
    rows = checked_citations(table(spark, d, "documents").select("doc_id", answer.alias("answer"), F.array(n).alias("chunk_ids")))
    return rows.select("doc_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("cited", "valid_citations", "invalid_citations")], "is_valid")


def _answer(expr: str) -> str:
    out = f"trim({expr})"
    for p in sql.STOCK_OPENINGS:
        out = f"trim(regexp_replace({out}, '(?i)^{p}', ''))"
    return out


@query(f"select item_id, {_answer(chr(39) + ' Answer: Sure, ' + chr(39) + ' || text')} || chr(10) || chr(10) || 'Sources:' || chr(10) || '- item ' || item_id as answer from benchmark")
def answer_format(spark: SparkSession, d: str) -> DataFrame:
    a = F.concat(F.lit(" Answer: Sure, "), "text")
    return table(spark, d, "benchmark").select("item_id", text.format_answer(a, F.array(F.concat(F.lit("item "), F.col("item_id").cast("string")))).alias("answer"))


#: User turns, and fixed questions that reach every rule.
PHRASED = (
    "How are the nightly backups rotated?", "What is a tombstone?", "Why does the replica lag behind?", "Where are the audit trails kept?", "Crash while loading the second shard", "Tell me about leader election",
    "Please find the glossary", "snapshot isolation levels", "  ", "set up the mirror and get the update log", "Locate the shard with the problem", "overview of the write path",
    "explain quorum reads", "how to delete or create a topic", "start, stop and connect",
)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    fixed = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(PHRASED)], "query_id long, text string")
    return said.unionByName(fixed)


_ASKED = "(select conv_id * 1000 + turn as query_id, text from conversations where role = 'user' union all select * from (values " + ", ".join(f"({-1 - i}, '{t}')" for i, t in enumerate(PHRASED)) + ") as v(query_id, text))"
_TROUBLE = (" or ".join("contains(t, '" + w.replace("'", "''") + "')" for w in ("error", "fail", "failing", "failed", "broken", "not working", "issue", "problem", "bug", "crash", "exception", "timeout", "unable", "cannot", "can't", "couldn't", "won't")))


@query(rf"""
select query_id, case when {_TROUBLE} or regexp_matches(t, '^why\b') then 'troubleshooting' when regexp_matches(t, '^how\b') then 'procedural' when regexp_matches(t, '^what\b') then 'factual'
  when regexp_matches(t, '^where\b') then 'navigational' when regexp_matches(t, '^(tell me about|explain|describe|overview)\b') then 'exploratory'
  when regexp_matches(t, '\b(find|locate|location)\b') then 'navigational' else 'factual' end as query_type
from (select query_id, lower(trim(text)) as t from {_ASKED})
""")
def classify_questions(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("query_id", question_type(F.col("text")).alias("query_type"))


def _expansion_sql() -> str:
    swaps = ", ".join(f"case when contains(low, '{w}') then replace(low, '{w}', '{s}') end" for w, s in sql.SWAPS)
    return f"""
with q as (select query_id, text, lower(text) as low, array_to_string({sql.key_terms('text')}, ' ') as terms from {_ASKED}),
v as (select query_id, text, list_concat([text], list_filter([{swaps}], lambda x: x is not null and x <> low), list_filter([terms], lambda x: x <> '')) as every from q),
u as (select query_id, text, list_filter(every, lambda x, i: list_position(every, x) = i) as every from v)
select query_id, variation_id, variation from (select query_id, unnest(range(0, len(kept))) as variation_id, unnest(kept) as variation from (select query_id, case when trim(text) = '' then [text] else every[1:5] end as kept from u))
"""


@query(_expansion_sql())
def expand_questions(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("query_id", F.posexplode(variations(F.col("text"))).alias("variation_id", "variation"))


_SUMMARY = r"substr(trim(regexp_replace(substr(coalesce(text, ''), 1, 5000), '\s+', ' ', 'g')), 1, 120)"


@query(f"select doc_id, {_SUMMARY} as summary from documents")
def page_summaries(spark: SparkSession, d: str) -> DataFrame:
    return rollup.page_summaries(table(spark, d, "documents")).select("doc_id", "summary")


_ROLL = f"""
with p as (select doc_id as page_id, source as system, lang as title, {_SUMMARY} as summary from documents),
r as (select system, page_id // 1000 as part, count(*) as n_pages, count(*) filter (summary <> '') as n_lines,
  coalesce(string_agg('- ' || title || ': ' || summary, chr(10) order by page_id) filter (summary <> ''), '') as content from p group by 1, 2),
s as (select system, sum(n_pages)::bigint as n_pages, sum(n_lines)::bigint as n_lines,
  coalesce(string_agg(substr(trim(regexp_replace(substr(content, 1, 5000), '\\s+', ' ', 'g')), 1, 120), chr(10) order by part) filter (content <> ''), '') as summary from r group by 1)
"""


def _system_parts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("system"), F.col("lang").alias("title"), "text")
    return rollup.system_rollup(rollup.page_summaries(docs))


@query(_ROLL + " select system, part, n_pages, n_lines, content from r")
def system_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _system_parts(spark, d)


@query(_ROLL + " select system, n_pages, n_lines, summary from s")
def system_summaries(spark: SparkSession, d: str) -> DataFrame:
    return rollup.system_summaries(_system_parts(spark, d))


@query(_ROLL + " select count(*) as n_systems, sum(n_pages)::bigint as n_pages, coalesce(string_agg('- ' || system || ': ' || summary, chr(10) order by system) filter (summary <> ''), '') as content from s")
def global_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.global_rollup(rollup.system_summaries(_system_parts(spark, d)))


# -- answers: questions are the benchmark passages, chunks the documents whose ids follow the question's

_CHUNKS = "select item_id as query_id, text as question, item_id % 11 / 10.0::double as confidence, (select list({'id': doc_id, 'content': d.text, 'source': source} order by doc_id) from documents d where d.doc_id between item_id and item_id + item_id % 5 - 1) as chunks from benchmark"


def _answerable(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), (F.col("item_id") % 11 / F.lit(10.0)).alias("confidence"))
    wanted = items.select("query_id", F.explode(F.when(F.col("query_id") % 5 > 0, F.sequence(F.col("query_id"), F.col("query_id") + F.col("query_id") % 5 - 1))).alias("doc_id"))
    found = wanted.join(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source"))).alias("chunks"))
    return items.join(lists, "query_id", "left")


_SHOWN = "list_transform(chunks[1:3], lambda c: '[CHUNK:' || c.id || '] \"' || case when length(c.content) > 200 then substr(c.content, 1, 200) || '...' else coalesce(c.content, '') end || '\"' || chr(10) || 'Source: ' || coalesce(nullif(c.source, ''), 'unknown'))"
_PASSAGES = f"case when coalesce(len(chunks), 0) > 0 then 'There is no exact answer, but these passages come closest:' || chr(10) || chr(10) || array_to_string({_SHOWN}, chr(10) || chr(10)) || chr(10) || chr(10) || 'The answer may stand in one of these sections.' else 'Nothing relevant was found. Try other words, or look into the documentation itself.' end"


@query(f"select query_id, {_PASSAGES} as answer from ({_CHUNKS})")
def answer_passages(spark: SparkSession, d: str) -> DataFrame:
    return _answerable(spark, d).select("query_id", answers.passages_answer(F.col("chunks")).alias("answer"))


@query(r"""
with w as (select query_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]{3,}'), lambda x: lower(x) not in ('what', 'how', 'where', 'when', 'why', 'the', 'and', 'for')) as w from """ + _ASKED + r""")
select query_id, case when len(w) > 0 then 'There is not enough information about ' || array_to_string(w[1:2], ' ') || '. Try other or more specific words.' else 'There is not enough information. Try asking about a specific topic.' end as answer from w
""")
def answer_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("query_id", answers.fallback_answer(F.col("text")).alias("answer"))


class _Citing:
    """A stand-in for a model: cites the first chunk it is shown and one that there is not."""

    def complete(self, prompt: str, system: str | None = None) -> str:
        return f" see {prompt[prompt.index('[CHUNK:'):].split(']')[0]}] and [CHUNK:-5], [CHUNK:999999999] "


@query(f"""
with c as ({_CHUNKS}), p as (select *, confidence < 0.3 or coalesce(len(chunks), 0) = 0 as used_fallback from c)
select query_id, used_fallback, case when used_fallback then {_PASSAGES} else 'see [CHUNK:' || chunks[1].id || '] and [CHUNK:-5], [CHUNK:999999999]' end as answer,
  case when used_fallback then 0 else 1 end as n_valid, case when used_fallback then 0 else 1 end as n_invalid, used_fallback as is_valid from p""")
def answers_grounded(spark: SparkSession, d: str) -> DataFrame:
    out = answers.grounded(_answerable(spark, d), _Citing())
    return out.select("query_id", "used_fallback", "answer", F.size("valid_citations").alias("n_valid"), F.size("invalid_citations").alias("n_invalid"), "is_valid")


@query("""
select item_id as query_id, case item_id % 6 when 0 then 'State the fact asked for, briefly.' when 1 then 'Give the steps in order, numbered.' when 2 then 'Name the likely cause, then how to mend it.'
  when 3 then 'Say where it is to be found, with the section or address.' when 4 then 'Give an overview of the main points.' else 'Answer clearly and completely.' end as style,
  sha256('Use only the context below. ' || style || chr(10) || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: q' || chr(10) || chr(10) || 'Answer:') as prompt_hash from benchmark""")
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in answers.TYPES], F.lit("other"))
    kind = F.element_at(kinds, (F.col("item_id") % 6 + 1).cast("int"))
    styles = F.element_at(F.array(*[F.lit(answers.STYLES.get(t, answers.STYLES["default"])) for t in (*answers.TYPES, "other")]), (F.col("item_id") % 6 + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), styles.alias("style"), F.sha2(answers.answer_prompt(F.lit("q"), F.col("text"), kind), 256).alias("prompt_hash"))


@query("select conv_id, turn, case when length(text) = 0 then 'The question is empty' when length(text) > 100 then 'The question is longer than 100 characters' end as problem from conversations")
def query_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.query_problem(F.col("text"), 100).alias("problem"))
