"""Column expressions over URLs: normal form, domain, path and safety filters of a crawl."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import python_title

# Fixed values.
NON_HTML = "pdf doc docx xls xlsx ppt pptx zip tar gz rar 7z jpg jpeg png gif svg ico mp3 mp4 wav avi mov css js json xml csv".split()
PAGE_EXTENSIONS = "html htm php asp aspx jsp".split()
SECTION_NAMES = ("docs", "api", "en", "latest", "stable")
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "metadata.google.internal", "169.254.169.254")
PRIVATE_PREFIXES = ("10.", "127.", "169.254.", "192.168.", *[f"172.{i}." for i in range(16, 32)], "0.", "::1", "fc", "fd", "fe80")


def host(u: Column) -> Column:
    """Authority, port included; null for what is no URL."""
    return F.nullif(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalize_url(u: Column, preserve_trailing_slash: bool = False) -> Column:
    """Without fragment, and without trailing slashes unless the path is '/'. With ``preserve_trailing_slash``, the slash
    of a path whose last segment has no extension stays."""
    bare = F.regexp_replace(u, "#.*$", "")
    short = F.when(path(bare) == "/", bare).otherwise(F.regexp_replace(bare, "/+$", ""))
    if preserve_trailing_slash:
        keep = bare.endswith("/") & ~F.regexp_extract(path(bare), r"([^/]*)/*$", 1).contains(".")
        return F.when(keep, bare).otherwise(short)
    return short


def same_domain(u: Column, allowed: list[str]) -> Column:
    return F.coalesce(host(u).isin(allowed), F.lit(False)) if allowed else F.lit(False)


def excluded(u: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path(u).startswith(p)
    return out


def included(u: Column, prefixes: list[str] | None) -> Column:
    return F.lit(True) if prefixes is None else excluded(u, prefixes)


def html_like(u: Column) -> Column:
    return ~F.lower(path(u)).rlike(rf"\.({'|'.join(NON_HTML)})$")


def directory_slash(u: Column) -> Column:
    """With a slash at the end of the path, unless its last segment is a file."""
    file = F.lower(path(u)).rlike(rf"\.({'|'.join([*PAGE_EXTENSIONS, *NON_HTML])})$")
    return F.when(file | u.endswith("/"), u).otherwise(F.concat(u, F.lit("/")))


def url_error(u: Column, allow_private: bool = False) -> Column:
    """Why a URL may not be fetched, or null. Addresses are judged as written; names are not resolved."""
    name = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(host(u), F.lit("")), "^[^@]*@", ""), r":\d+$", ""))
    err = (
        F.when(u.isNull() | (u == ""), "empty url")
        .when(u.contains(" "), "space in url")
        .when(u.rlike(r"[\x00-\x1f]"), "control character in url")
        .when(~F.lower(u).rlike("^https?://"), "scheme not allowed")
        .when(name == "", "no host")
    )
    if not allow_private:
        private = name.isin(*BLOCKED_HOSTS)
        literal = name.rlike(r"^[0-9.]+$|:")
        for p in PRIVATE_PREFIXES:
            private = private | (literal & name.startswith(p))
        err = err.when(private, "private address")
    return err


def may_fetch(p: Column, allow: list[str], disallow: list[str]) -> Column:
    """Robots rules over a path: an allowed prefix wins over a disallowed one."""
    yes, no = F.lit(False), F.lit(False)
    for x in filter(None, allow):
        yes = yes | p.startswith(x)
    for x in filter(None, disallow):
        no = no | p.startswith(x)
    return yes | ~no


def robots_rules(text: str) -> dict:
    """allow and disallow prefixes and crawl delay of the blocks for every agent ('*')."""
    rules: dict = {"allow": [], "disallow": [], "delay": None}
    ours = False
    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            ours = value == "*"
        elif ours and value and key in ("allow", "disallow"):
            rules[key].append(value)
        elif ours and key == "crawl-delay":
            try:
                rules["delay"] = float(value)
            except ValueError:
                pass
    return rules


def system_name(u: Column) -> Column:
    """The product a page belongs to: its first path segment that is no section name, or else its host."""
    segments = F.filter(F.split(path(u), "/"), lambda s: s != "")
    first, second = F.get(segments, F.lit(0)), F.get(segments, F.lit(1))
    name = F.when(first.isNull(), host(u)).when(first.isin(*SECTION_NAMES), F.coalesce(second, host(u))).otherwise(first)
    return python_title(F.translate(name, "-_", "  "))
