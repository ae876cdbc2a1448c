"""URL filters: pattern rules indexed by their rarest literal token.

Every rule has a regular expression and the literal tokens that any URL it matches must contain. It is
filed under the token that the fewest rules share. The tokens of a URL fetch the rules filed under them, and only
those run their regular expression; rules without a literal token are always run. The longest
matching host rule decides, and otherwise the first matching pattern rule, and otherwise the URL is allowed.

A null URL, or one without `://`, has an empty host and path; only rules without tokens could fit it. Hosts are
lower-cased A-Z only. Each row is answered by itself: copies, other columns and order play no part.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import in_arrow, slices, table

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Rule:
    """verdict for URLs that regex matches, on host + path; text names the rule; weight is the length of a host rule, else 0."""

    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    weight: int = 0
    compiled: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.regex, re.DOTALL))


def host_rule(text: str, verdict: str) -> Rule:
    """`host/path` fits the host, all its subdomains, and paths that begin with the path."""
    host, _, path = text.partition("/")
    whole = _TOKEN.findall(host)  # a host ends at a dot, colon or slash on either side, so its tokens are whole ones
    return Rule(text, verdict, rf"(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(whole), len(text))


def pattern_rule(text: str, verdict: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    """A regular expression on host + path; tokens must be whole tokens of every URL it matches."""
    return Rule(text, verdict, regex, tokens)


# fixed values: the rules of the query's contract
CONTRACT_RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]


#: Pages of no use to a corpus, by host and path. Host rules come before them, and the first of them that fits decides.
PATTERN_RULES = [
    pattern_rule("mobile mirror", "block", r"m\.[^/]+/.*", ("m",)),
    pattern_rule("blog page as a file", "block", r"blog\.[^/]+/(?:.*/)?[0-9]+\.html$", ("blog", "html")),
    *(pattern_rule(f"{word} page", "block", rf"[^/]+/(?:.*/)?{word}(?:[/.].*)?$", (word,)) for word in ("login", "signup", "cart", "search")),
]


class RuleIndex:
    """Rules by their rarest token. Its size is that of the rule list."""

    def __init__(self, rules: list[Rule]):
        often = Counter(t for r in rules for t in set(r.tokens))
        self.filed: dict[str, list[tuple[int, Rule]]] = {}
        self.always: list[tuple[int, Rule]] = []
        for n, r in enumerate(rules):
            if r.tokens:
                self.filed.setdefault(min(r.tokens, key=lambda t: (often[t], -len(t), t)), []).append((n, r))
            else:
                self.always.append((n, r))

    def judge(self, host: str, path: str) -> Rule | None:
        """The deciding rule."""
        url = host + path
        found = list(self.always)
        for token in set(_TOKEN.findall(url)):
            found += self.filed.get(token, ())
        fits = [(-r.weight, n, r) for n, r in found if r.compiled.match(url)]
        return min(fits, key=lambda x: x[:2])[2] if fits else None


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty for null or without `://`."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(_LOWER), path


def _judged(index: RuleIndex):
    def run(batches):
        for b in slices(batches, 8192):
            parts = [host_and_path(u) for u in b.column("url").to_pylist()]
            rules = [index.judge(*p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                 pa.array([r.text if r and r.weight else None for r in rules], pa.string()), pa.array([r.verdict if r else "allow" for r in rules], pa.string()),
                 pa.array([r.text if r and not r.weight else None for r in rules], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

    return run


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, pattern), one for each row of pages, in one pass without a shuffle.

    rule is the longest host rule that fits, pattern the first pattern rule where none does.
    """
    p = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url")
    kind = dict(p.dtypes)["page_id"]
    return in_arrow(p, _judged(RuleIndex(rules)), f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), CONTRACT_RULES + PATTERN_RULES)


_WORDS = " ".join(f"WHEN regexp_matches(host || path, '^[^/]+/(.*/)?{w}([/.].*)?$', 's') THEN '{w} page'" for w in ("login", "signup", "cart", "search"))
ORACLE = rf"""
WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
u AS (SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule, verdict, rhost, rpath) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
f AS (SELECT u.page_id, u.host, u.path, r.rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS n
  FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)),
g AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(host || path, '^m\.[^/]+/') THEN 'mobile mirror'
    WHEN regexp_matches(host || path, '^blog\.[^/]+/(.*/)?[0-9]+\.html$', 's') THEN 'blog page as a file'
    {_WORDS} END AS pattern FROM f WHERE n = 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern FROM g
"""
