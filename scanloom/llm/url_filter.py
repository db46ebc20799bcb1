"""URL rules found through their rarest literal token; DataFrame functions only.

A rule is a host and a path prefix: it fits that host and all its subdomains if the url's path starts with
the rule's path; the longest rule that fits decides. Each rule is a regular expression over host and path,
filed under that one of its literal tokens which the fewest urls have. The tokens of a url fetch the rules
filed under them, and only those run their expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many travel inside the plan as a map; more are joined as a table.
INLINE_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        quoted = "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in self.host)
        end = "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in self.path) if self.path else "(?:/|$)"
        return rf"^(?:[^/]*\.)?{quoted}{end}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every fitting url has whole: the path's last one may go on in the url, so it counts only before a delimiter."""
        inside = re.findall(TOKEN, self.path.lower())
        if inside and re.search(r"[a-z0-9]$", self.path.lower()):
            inside.pop()
        return re.findall(TOKEN, self.host) + inside or [""]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(found, pattern, 1), UPPER, LOWER), F.regexp_extract(found, pattern, 2)


def url_tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of host and path, and the empty one, under which rules without a literal are filed."""
    found = F.regexp_extract_all(F.lower(F.concat(host, path)), F.lit(f"({TOKEN})"), F.lit(1))
    return F.array_distinct(F.concat(found, F.array(F.lit(""))))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; columns of these names in ``pages`` are replaced.

    ``rule`` is null and ``verdict`` is ``default`` where no rule fits, also for null and empty urls and urls
    without ``://``. No rules at all: every url has the default. Rows that repeat are judged each; one
    row comes out for each row in.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_tokens")]
    host, path = host_and_path(F.col(url))
    parsed = pages.select(*own, host.alias("host"), path.alias("path"))
    if not rules:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    with_tokens = parsed.withColumn("_tokens", url_tokens(F.col("host"), F.col("path")))
    filed = rarest_tokens(with_tokens, rules)
    if len(rules) <= INLINE_RULES:
        return judged_inline(with_tokens, rules, filed, default, own)
    return judged_by_join(with_tokens, rules, filed, default, own)


def rarest_tokens(with_tokens: DataFrame, rules: list[Rule]) -> dict[Rule, str]:
    """For each rule the token that the fewest of all urls have; ties go to the longer, then the first in order."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = with_tokens.select(F.explode("_tokens").alias("token"))
    if len(wanted) <= INLINE_RULES:
        tokens = tokens.where(F.col("token").isin(wanted))
    else:
        tokens = tokens.join(with_tokens.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
    count = dict(tokens.groupBy("token").count().collect())  # at most a row for each token of the rules
    return {r: min(r.tokens, key=lambda t: (count.get(t, 0), -len(t), t)) for r in rules}


def judged_inline(with_tokens: DataFrame, rules: list[Rule], filed: dict[Rule, str], default: str, own: list[str]) -> DataFrame:
    by_token: dict[str, list[Rule]] = {}
    for r in rules:
        by_token.setdefault(filed[r], []).append(r)
    as_struct = lambda r: F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
    index = F.create_map(*[x for t, found in by_token.items() for x in (F.lit(t), F.array(*[as_struct(r) for r in found]))])
    key = F.concat("host", "path")
    fetched = F.flatten(F.filter(F.transform("_tokens", lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull()))
    fitting = F.filter(fetched, lambda r: F.regexp_like(key, r["pattern"]))
    best = F.array_max(fitting)  # the longest; of equally long ones the last in order
    return with_tokens.withColumn("_best", best).select(
        *own, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )


def judged_by_join(with_tokens: DataFrame, rules: list[Rule], filed: dict[Rule, str], default: str, own: list[str]) -> DataFrame:
    """For rule sets that are too large for a plan: distinct host and path, exploded to tokens and joined."""
    spark = with_tokens.sparkSession
    table = spark.createDataFrame([(filed[r], len(r.text), r.text, r.verdict, r.pattern) for r in rules], "token string, size int, rule string, verdict string, pattern string")
    keys = with_tokens.select("host", "path", "_tokens").distinct().select("host", "path", F.explode("_tokens").alias("token"))
    best = (
        keys.join(table, "token")
        .where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
        .groupBy("host", "path")
        .agg(F.max(F.struct("size", "rule", "verdict")).alias("_best"))
    )
    joined = with_tokens.join(best, ["host", "path"], "left")
    return joined.select(*own, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query op6_url_filter.
RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), keyed AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), fits AS (
  SELECT k.page_id, k.host, k.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY k.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
  FROM keyed k LEFT JOIN rules r
    ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""
