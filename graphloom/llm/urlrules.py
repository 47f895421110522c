"""URL filtering by pattern rules that are found through their rarest literal token.

Every rule names literal tokens that any URL it fits must hold. A first pass counts how many URLs hold each of those
tokens; a rule is then filed under the one that fewest URLs hold. The tokens of a URL fetch their rules by a hash join,
and only the regular expressions of those are run. The index is as large as the rule list, never as the URLs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules at most are sent to every executor; longer lists are joined as Spark sees fit.
SENT_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """pattern: Java regular expression over the lower-cased URL, or, for listed rules, over host and path together.
    tokens: runs of a-z and 0-9, bounded by other characters, that each fitting URL holds."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    listed: bool = False


def listed(name: str, verdict: str) -> Rule:
    """A rule host/path: fits that host and its subdomains where the URL's path starts with the rule's."""
    host, _, path = name.partition("/")
    return Rule(name, rf"^(?:[^/]*\.)?\Q{host}\E\Q/{path}\E", _tokens(f"{host}/{path}"), verdict, True)


def _tokens(text: str) -> tuple[str, ...]:
    """Whole tokens; the last one of a path counts only where the path ends it."""
    found = re.findall(r"[a-z0-9]+", text.lower())
    open_end = bool(re.search(r"/.*[A-Za-z0-9]$", text))
    return tuple(found[:-1] if open_end else found)


LISTED = (listed("net/", "block"), listed("example.net/en/", "allow"), listed("example.com/de/", "block"), listed("org/fr/", "allow"))
PATTERNS = tuple(
    [Rule(f"path:{w}", rf"^[^?#]*/{w}(?:[/.?#]|$)", (w,), "block") for w in ("login", "signin", "signup", "logout", "cart", "checkout", "register", "wpadmin")]
    + [Rule(f"file:{w}", rf"^[^?#]*\.{w}(?:[?#]|$)", (w,), "block") for w in ("exe", "zip", "rar", "dmg", "apk", "iso", "jpg", "jpeg", "png", "gif", "mp3", "mp4", "avi")]
    + [Rule(f"word:{w}", rf"(?<![a-z0-9]){w}(?![a-z0-9])", (w,), "block") for w in ("casino", "porn", "xxx", "viagra", "poker", "torrent", "warez")]
)


def lowered(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://` or for a null URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _held(url: Column) -> Column:
    return F.array_distinct(F.split(F.coalesce(lowered(url), F.lit("")), "[^a-z0-9]+"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SENT_RULES else table


def filed(urls: DataFrame, rules: Iterable[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token in urls(url); ties go to the token first in the alphabet."""
    rules = list(rules)
    wanted = sorted({t for r in rules for t in r.tokens})
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    if not rules:
        return {}
    asked = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
    seen = urls.select(F.explode(_held(F.col("url"))).alias("t")).join(_small(asked, len(wanted)), "t")
    count = {r["t"]: r["n"] for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()}  # at most one row a token
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (count.get(t, 0), t)), []).append(r)
    return index


def judged(pages: DataFrame, rules: Iterable[Rule] = LISTED + PATTERNS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url).

    rule is the longest listed rule that fits (ties: first by name), and its verdict stands; else rule is null and the
    verdict is `block` if any blocking pattern fits, `allow` if only allowing ones do, and `default` if none does. A
    null or malformed URL has an empty host and path. Rows that agree in page_id and url are judged once and returned as
    often as they occur; an empty table gives an empty one. A URL costs its tokens and the rules these fetch, however
    long it is and however many rules there are. Rows are shuffled once, by page_id and url.
    """
    index = filed(pages.select("url"), rules)
    flat = [(t, -len(r.name), r.name, r.pattern, r.verdict, r.listed) for t, rs in sorted(index.items()) for r in rs]
    book = pages.sparkSession.createDataFrame(flat, "token string, shorter int, name string, pattern string, says string, listed boolean")
    once = pages.groupBy("page_id", "url").agg(F.count("*").alias("times"))
    asked = once.select("*", F.explode(_held(F.col("url"))).alias("token")).join(_small(book, len(flat)), "token", "left")
    host, path = host_and_path(F.col("url"))
    fit = F.when(F.col("listed"), F.regexp_like(F.concat(host, path), F.col("pattern"))).otherwise(F.regexp_like(lowered(F.col("url")), F.col("pattern")))
    pattern = lambda says: F.max(fit & ~F.col("listed") & (F.col("says") == says))
    found = asked.groupBy("page_id", "url").agg(
        F.first("times").alias("times"),
        F.min(F.when(fit & F.col("listed"), F.struct("shorter", "name", "says"))).alias("best"),
        pattern("block").alias("blocks"),
        pattern("allow").alias("allows"),
    )
    other = F.when(F.col("blocks"), "block").when(F.col("allows"), "allow").otherwise(default)
    return found.select(
        "page_id", host.alias("host"), path.alias("path"), F.col("best.name").alias("rule"), F.coalesce("best.says", other).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("__copy"),
    ).drop("__copy")


ORACLE = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS low,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(low, '^[^?#]*/(login|signin|signup|logout|cart|checkout|register|wpadmin)([/.?#]|$)')
         OR regexp_matches(low, '^[^?#]*\.(exe|zip|rar|dmg|apk|iso|jpg|jpeg|png|gif|mp3|mp4|avi)([?#]|$)')
         OR regexp_matches(low, '(^|[^a-z0-9])(casino|porn|xxx|viagra|poker|torrent|warez)([^a-z0-9]|$)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""
