"""Column expressions over text: tokenizers, cleaning, hashing, redaction, citations. All of them stay in the JVM.

Python's Unicode classes are what the semantics are defined by; where Java's differ (``\\w`` and ``\\s`` are ASCII in
Java), explicit classes are used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists, patterns and weights below define results.
BM25_STOPWORDS = (
    "a", "all", "also", "an", "and", "are", "as", "at", "be", "been", "both", "but", "by", "can", "could", "did", "do", "does", "each", "every", "few", "for", "from", "had", "has",
    "have", "he", "here", "how", "i", "in", "is", "it", "its", "just", "may", "might", "more", "most", "must", "need", "no", "nor", "not", "now", "of", "on", "only", "or", "other",
    "own", "same", "shall", "she", "should", "so", "some", "such", "than", "that", "the", "there", "these", "they", "this", "those", "to", "too", "very", "was", "we", "were",
    "what", "when", "where", "which", "who", "why", "will", "with", "would", "you",
)
KEY_TERM_STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "although", "an", "and", "are", "as", "at", "be", "because", "been", "before", "being", "below", "best", "between",
    "both", "but", "by", "can", "could", "did", "do", "does", "down", "during", "each", "every", "few", "for", "from", "had", "has", "have", "he", "her", "him", "his", "how", "i",
    "if", "in", "into", "is", "it", "its", "just", "may", "me", "might", "more", "most", "must", "my", "need", "no", "not", "of", "off", "on", "only", "or", "other", "our", "out",
    "over", "same", "shall", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "these", "they", "this", "those", "through", "to", "too", "under", "up",
    "very", "was", "way", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "without", "would", "you", "your",
)
ESTIMATE_PUNCTUATION = ".,!?;:'\"()[]{}/<>-_@#$%^&*+=~`|"
ANSWER_PREFIXES = (
    "Answer:", "Response:", "Here is", "Sure,", "Based on the context,", "According to the documentation,", "Steps:", "Explanation:", "Analysis:", "Location:",
)
SUSPICIOUS = (
    (r"(?is)<script[^>]*>.*?</script>", "script block"),
    (r"(?is)javascript:", "javascript url"),
    (r"(?is)on\w+\s*=", "event handler"),
    (r"(?is)data:text/html", "html data url"),
)
SANITIZE = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?i)\s+on\w+\s*=\s*[\"'][^\"']*[\"']",
    r"(?i)\s+on\w+\s*=\s*\S+",
    r"(?i)javascript:",
    r"(?i)data:text/html[^\"'>\s]*",
)
CITATION = r"(?i)\[\s*CHUNK\s*:\s*(\d+)\s*\]"
#: White space as Python's ``str.split`` and ``\s`` know it.
SPACE = "\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+", -1), lambda w: w != "")


def general_tokens(c: Column) -> Column:
    """Lower-case words, punctuation deleted: "can't" is "cant"."""
    return _words(F.lower(F.regexp_replace(F.regexp_replace(c, f"[{SPACE}]+", " "), r"[^\p{L}\p{N}_\s]", "")))


def bm25_tokens(c: Column, remove_stopwords: bool = True) -> Column:
    """Words for the inverted index: camel case, underscores and hyphens split; punctuation separates."""
    x = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "[_-]", " ")
    words = _words(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", " "))
    return F.filter(words, lambda w: ~w.isin(*BM25_STOPWORDS)) if remove_stopwords else words


def key_terms(c: Column) -> Column:
    """The words of a question that carry its meaning."""
    return F.filter(general_tokens(c), lambda w: ~w.isin(*KEY_TERM_STOPWORDS) & (F.length(w) > 1))


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def truncate_text(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - len(suffix))), F.lit(suffix)))


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def query_problem(c: Column, most: int = 10_000) -> Column:
    """Why a question is not taken: empty, or too long; null if it is."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "The question is empty").when(F.length(c) > most, f"The question is longer than {most} characters")


def query_hash(c: Column) -> Column:
    return F.sha2(F.lower(F.trim(c)), 256)


def normalize_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def sanitize_html(c: Column) -> Column:
    """Deletes scripts, styles, event handlers and script URLs, pattern after pattern. The unquoted handler pattern also
    reaches text outside tags; that is part of the definition."""
    for p in SANITIZE:
        c = F.regexp_replace(c, p, "")
    return c


def suspicious_reason(c: Column) -> Column:
    """The first suspicious pattern found, or null."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(why)) for p, why in SUSPICIOUS])


def redact(c: Column, most: int = 200) -> Column:
    """For logs: shortened, secrets after a name and long runs of letters and digits masked."""
    short = F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("...[truncated]")))
    named = F.regexp_replace(short, r"(?i)(password|secret|token|key|auth)\s*[:=]\s*\S+", "$1=[REDACTED]")
    return F.regexp_replace(named, "[A-Za-z0-9]{32,}", "[REDACTED]")


def estimate_tokens(c: Column) -> Column:
    """A word counts 1, 1 for each mark before and after it, and a fifth of what its core exceeds ten characters by; a
    word of marks alone counts 1."""
    marks = "[" + "".join("\\" + ch for ch in ESTIMATE_PUNCTUATION) + "]"
    words = F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SPACE}]+", " "), " ", -1), lambda w: w != "")

    def cost(w: Column) -> Column:
        core = F.length(F.regexp_replace(w, f"^{marks}+|{marks}+$", ""))
        extra = F.when(core > 10, F.floor((core - 10) / 5)).otherwise(0)
        return F.when(core == 0, 1).otherwise(1 + (F.length(w) - core) + extra).cast("long")

    return F.aggregate(F.transform(words, cost), F.lit(0).cast("long"), lambda a, x: a + x)


def citations(c: Column) -> Column:
    """Cited chunk ids in order, repeats kept; digits beyond a long are dropped."""
    found = F.regexp_extract_all(c, F.lit(CITATION), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("long")), lambda x: x.isNotNull())


def format_answer(c: Column, sources: Column | None = None) -> Column:
    """Without stock openings; with the list of sources, if any."""
    out = F.trim(c)
    for p in ANSWER_PREFIXES:
        out = F.trim(F.regexp_replace(out, "(?i)^" + p.replace(".", r"\."), ""))
    if sources is None:
        return out
    lines = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("- "), s)), "\n")
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.concat(out, F.lit("\n\nSources:\n"), lines)).otherwise(out)


def contextual_text(content: Column, heading_path: Column, title: Column) -> Column:
    """What is embedded for a chunk: its document and section, then its content; absent parts are left out."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    head = F.concat_ws("\n", part("Document", title), part("Section", heading_path))
    return F.when(head == "", content).otherwise(F.concat(head, F.lit("\n\n"), content))


def python_title(c: Column) -> Column:
    """Python's ``str.title``: every letter after a non-letter is upper case, others lower (``initcap`` knows blanks only)."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")
