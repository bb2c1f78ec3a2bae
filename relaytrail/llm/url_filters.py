"""URL filters: pattern rules indexed by their rarest literal token.

Rules are a table (rule, kind, verdict, priority) of any length:

* ``prefix``: a host and a path prefix like ``example.org/es/``; fits the host and its subdomains and every
  path that starts so. The longest wins, before all rules of other kinds; ``priority`` is not used.
* ``word``: a run of letters and digits that stands alone in host or path, in any ASCII case.
* ``regex``: a regular expression searched for in host + path.

Each rule's literal tokens (runs of ASCII letters and digits that every URL it fits holds as a whole run) are
taken from it by expressions. A token at the open end of a prefix may go on in the URL and is none. Of
a regular expression only runs between literal separators count, and none where it has groups, classes,
alternatives or escaped backslashes. The tokens' frequencies over all distinct URLs pick the rarest of each
rule; a URL's tokens fetch the rules indexed under them, and only those rules run their expression. Rules
without a literal token are candidates of every URL.

Defined results: a null URL or one without ``://`` has an empty host and path, which no prefix rule
fits; URLs of any length are read whole; repeated URLs are judged once; rules with a null rule, kind or verdict
fit nothing and repeated rules count once; of rules of one length (prefixes) or priority (others) the
greatest by name wins, then the greatest verdict; without rules all get the default; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relaytrail.llm.common import LOWER, UPPER, inline_rows

_EVERY = "*"
RULE_SCHEMA = "rule string, kind string, verdict string, priority int"
HOST_RULES = (
    ("org/", "prefix", "allow", 0), ("example.org/es/", "prefix", "block", 0), ("example.org/en/1", "prefix", "block", 0),
    ("com/fr/", "prefix", "allow", 0), ("com/de/", "prefix", "block", 0),
)
PATTERN_RULES = tuple(
    (word, "word", "block", 1) for word in ("casino", "poker", "porn", "xxx", "viagra", "torrent", "warez", "escort")
) + ((r"^\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?(?:/|$)", "regex", "block", 1),)
DEFAULT_VERDICT = "allow"


def default_rules(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, list(HOST_RULES + PATTERN_RULES), RULE_SCHEMA)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def compiled(rules: DataFrame) -> DataFrame:
    """(rule, verdict, pattern, tokens, listed, priority) of every usable rule, once."""
    rule, kind = F.col("rule"), F.col("kind")
    folded = F.translate(rule, UPPER, LOWER)
    runs = F.lit("[a-z0-9]+")
    between = F.lit(r"(?:(?<=[/_=-])|(?<=\\\.)|(?<=^\^))([a-z0-9]+)(?=(?:[/_=-]|\\\.)(?![?*+{])|\$$)")
    return (
        rules.filter("rule IS NOT NULL AND verdict IS NOT NULL AND kind IN ('prefix', 'word', 'regex')")
        .select("rule", "kind", "verdict", "priority").distinct()
        .select(
            "rule", "verdict",
            F.when(kind == "prefix", F.concat(F.lit(r"^(?:[^/]*\.)?"), _quoted(rule)))
            .when(kind == "word", F.concat(F.lit("(?i)(?:^|[^a-z0-9])"), _quoted(rule), F.lit("(?:[^a-z0-9]|$)")))
            .otherwise(rule).alias("pattern"),
            F.when(kind == "prefix", F.regexp_extract_all(F.regexp_replace(folded, "[a-z0-9]+$", ""), runs, F.lit(0)))
            .when(kind == "word", F.regexp_extract_all(folded, runs, F.lit(0)))
            .when(rule.rlike(r"[(\[|]|\\\\"), F.array().cast("array<string>"))
            .otherwise(F.regexp_extract_all(folded, between, F.lit(1))).alias("tokens"),
            (kind == "prefix").alias("listed"),
            F.when(kind == "prefix", F.length("rule")).otherwise(F.coalesce("priority", F.lit(0))).alias("priority"),
        )
    )


def candidates(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(target, rule, verdict, pattern, listed, priority): the rules whose rarest token a target holds."""
    every = F.array(F.lit(_EVERY))
    listed = compiled(rules)
    runs = F.filter(F.split(F.translate("target", UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != "")
    seen = targets.select("target", F.explode(F.array_distinct(F.concat(runs, every))).alias("token"))
    literal = listed.select("pattern", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(every)).alias("token"))
    counts = seen.join(literal.select("token").distinct(), "token").groupBy("token").count()
    rarest = (
        literal.join(counts, "token", "left").groupBy("pattern")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("rarest"))
        .select("pattern", F.col("rarest.token").alias("token"))
    )
    return seen.join(rarest.join(listed.drop("tokens"), "pattern"), "token").drop("token")


def judge(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(target, rule, verdict) of the distinct ``target`` strings that some rule fits."""
    return (
        candidates(targets, rules).filter(F.expr("target rlike pattern")).groupBy("target")
        .agg(F.max(F.struct("listed", "priority", "rule", "verdict")).alias("best"))
        .select("target", F.when(F.col("best.listed"), F.col("best.rule")).alias("rule"), F.col("best.verdict").alias("verdict"))
    )


def url_verdicts(
    pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``rule`` is null unless a prefix rule decides."""
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"),
        F.coalesce(path_of(url), F.lit("")).alias("path"),
    )
    rows = rows.withColumn("target", F.concat("host", "path"))
    verdicts = judge(rows.select("target").distinct(), default_rules(pages.sparkSession) if rules is None else rules)
    return rows.join(verdicts, "target", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), rules(rule, rh, rp, v) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
         ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM (SELECT DISTINCT host, path FROM q) JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path
)
SELECT q.page_id, q.host, q.path, best.rule AS rule,
       CASE WHEN best.v IS NOT NULL THEN best.v
            WHEN regexp_matches(q.host || q.path, '(?i)(^|[^a-z0-9])(casino|poker|porn|xxx|viagra|torrent|warez|escort)([^a-z0-9]|$)') THEN 'block'
            WHEN regexp_matches(q.host || q.path, '^\d{1,3}(\.\d{1,3}){3}(:\d+)?(/|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM q LEFT JOIN best ON q.host = best.host AND q.path = best.path
"""
