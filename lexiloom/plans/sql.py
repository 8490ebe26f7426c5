"""Fragments of DuckDB SQL that the oracles share; each says what a function of this library computes, in other words."""

from __future__ import annotations

# Fixed values, written out here again, so that an oracle does not take them from what it checks.
INDEX_STOPWORDS = """
    'a', 'all', 'also', 'an', 'and', 'are', 'as', 'at', 'be', 'been', 'both', 'but', 'by', 'can', 'could', 'did', 'do', 'does', 'each', 'every', 'few', 'for', 'from', 'had', 'has',
    'have', 'he', 'here', 'how', 'i', 'in', 'is', 'it', 'its', 'just', 'may', 'might', 'more', 'most', 'must', 'need', 'no', 'nor', 'not', 'now', 'of', 'on', 'only', 'or', 'other',
    'own', 'same', 'shall', 'she', 'should', 'so', 'some', 'such', 'than', 'that', 'the', 'there', 'these', 'they', 'this', 'those', 'to', 'too', 'very', 'was', 'we', 'were',
    'what', 'when', 'where', 'which', 'who', 'why', 'will', 'with', 'would', 'you'
"""
TERM_STOPWORDS = """
    'a', 'about', 'above', 'after', 'again', 'against', 'all', 'although', 'an', 'and', 'are', 'as', 'at', 'be', 'because', 'been', 'before', 'being', 'below', 'best', 'between',
    'both', 'but', 'by', 'can', 'could', 'did', 'do', 'does', 'down', 'during', 'each', 'every', 'few', 'for', 'from', 'had', 'has', 'have', 'he', 'her', 'him', 'his', 'how', 'i',
    'if', 'in', 'into', 'is', 'it', 'its', 'just', 'may', 'me', 'might', 'more', 'most', 'must', 'my', 'need', 'no', 'not', 'of', 'off', 'on', 'only', 'or', 'other', 'our', 'out',
    'over', 'same', 'shall', 'she', 'should', 'so', 'some', 'such', 'than', 'that', 'the', 'their', 'them', 'these', 'they', 'this', 'those', 'through', 'to', 'too', 'under', 'up',
    'very', 'was', 'way', 'we', 'were', 'what', 'when', 'where', 'which', 'while', 'who', 'whom', 'why', 'will', 'with', 'without', 'would', 'you', 'your'
"""
SECTION_NAMES = "'docs', 'api', 'en', 'latest', 'stable'"
STOCK_OPENINGS = (
    "Answer:", "Response:", "Here is", "Sure,", "Based on the context,", "According to the documentation,", "Steps:", "Explanation:", "Analysis:", "Location:",
)
MARKS = '.,!?;:\'"()[]{}/<>-_@#$%^&*+=~`|'
UNSAFE = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"""(?i)\s+on\w+\s*=\s*[\"'][^\"']*[\"']""",
    r"(?i)\s+on\w+\s*=\s*\S+",
    r"(?i)javascript:",
    r"""(?i)data:text/html[^\"'>\s]*""",
)
SUSPECT = (
    (r"(?is)<script[^>]*>.*?</script>", "script block"),
    (r"(?is)javascript:", "javascript url"),
    (r"(?is)on\w+\s*=", "event handler"),
    (r"(?is)data:text/html", "html data url"),
)
SWAPS = (
    ("configure", "setup"), ("configure", "set up"),
    ("setup", "configure"), ("setup", "set up"),
    ("set up", "configure"), ("set up", "setup"),
    ("install", "set up"), ("install", "deploy"),
    ("error", "issue"), ("error", "problem"),
    ("issue", "error"), ("issue", "problem"),
    ("problem", "error"), ("problem", "issue"),
    ("connect", "connection"), ("connect", "link"),
    ("connection", "connect"), ("connection", "link"),
    ("start", "begin"), ("start", "launch"),
    ("stop", "halt"), ("stop", "terminate"),
    ("create", "make"), ("create", "build"),
    ("delete", "remove"), ("delete", "destroy"),
    ("update", "modify"), ("update", "change"),
    ("get", "retrieve"), ("get", "fetch"),
)


def bm25(text: str, stop: bool = True) -> str:
    keep = f" and x not in ({INDEX_STOPWORDS})" if stop else ""
    split = rf"regexp_split_to_array(regexp_replace(lower(regexp_replace(regexp_replace(coalesce({text}, ''), '([a-z])([A-Z])', '\1 \2', 'g'), '[_-]', ' ', 'g')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+')"
    return f"list_filter({split}, lambda x: x <> ''{keep})"


def general(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace({text}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')), '\s+'), lambda x: x <> '')"


def key_terms(text: str) -> str:
    return f"list_filter({general(text)}, lambda x: x not in ({TERM_STOPWORDS}) and length(x) > 1)"


DOCS = "select doc_id, text from documents"
ITEMS = "select item_id as query_id, text from benchmark"


def search_ctes(docs: str = DOCS, questions: str = ITEMS) -> str:
    """CTEs up to s(query_id, doc_id, score), unranked."""
    return f"""
d as ({docs}), tw as (select doc_id, {bm25('text')} as w from d), dl as (select doc_id, len(w) as dl from tw),
st as (select count(*) as n, sum(dl) / count(*) as avgdl from dl),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from tw) group by all),
df as (select term, count(*) as df from tf group by all),
q as (select query_id, term, count(*) as qtf from (select query_id, unnest({bm25('text')}) as term from ({questions})) group by all),
s as (select query_id, doc_id, round(sum(round(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5::double) / (tf + 1.5::double * (0.25::double + 0.75::double * (dl / avgdl))), 9)::decimal(18, 9))::double, 6) as score
  from q join tf using (term) join df using (term) join dl using (doc_id), st group by 1, 2)"""


def ranked(source: str, k: int, by: str = "query_id", item: str = "doc_id", extra: str = "") -> str:
    return f"select {by}, {item}, {extra} score, row_number() over (partition by {by} order by score desc, {item}) as rank from {source} qualify row_number() over (partition by {by} order by score desc, {item}) <= {k}"


def search(docs: str = DOCS, questions: str = ITEMS, k: int = 10) -> str:
    return f"with {search_ctes(docs, questions)} {ranked('(select * from s where score > 0)', k)}"
