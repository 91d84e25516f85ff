"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is an action, a host and a path; it fits its host and all subdomains, where the URL's
path starts with the rule's. Each distinct URL is expanded into the expressions (host suffix +
path prefix) that a rule could have. Host suffixes are joined with the rules' hosts first, so that
a suffix gets only prefixes as long as some rule of that very host has. Suffixes and expressions
meet hosts and rules by equi-joins on the first 4 bytes of their SHA-256 digests, whole digests
confirm, and the longest rule (then the one with the longer host) wins.

Scale: only the URL column is read. Copies of a URL are merged before the expansion, so a hot
URL is one row. Rules are broadcast only if they are at most ``BROADCAST_RULES``, else the joins
shuffle both sides by the short digest. Rows come back by a join on the URL that adaptive
execution can split.

Defined cases: a null URL and one without ``://`` have an empty host and path and fit no rule;
a rule's path of no characters fits every path; rules that repeat with different actions block;
rules with a null part are left out. Any other column is kept, whatever its name; ``host``,
``path``, ``rule`` and ``verdict`` are replaced. No rules: every verdict is the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
PREFIX_HEX = 8

Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_table(rules: DataFrame) -> DataFrame:
    """__uf_h, __uf_p and __uf_action of the distinct rules (action, host, path)."""
    known = rules.select(F.col("action").alias("__uf_action"), F.col("host").alias("__uf_h"), F.col("path").alias("__uf_p")).dropna()
    odd = known.where(~F.col("__uf_action").isin("allow", "block")).select("__uf_action").first()
    if odd:
        raise ValueError(f"no such action: {odd[0]}")
    return known.groupBy("__uf_h", "__uf_p").agg(F.max("__uf_action").alias("__uf_action"))  # block comes after allow


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns with host, path, rule (host and path of the winner, else null) and verdict."""
    spark = pages.sparkSession
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(f"`{url_col}`"))
    parts = pages.select(*kept, F.col(f"`{url_col}`").alias("__uf_url"), host.alias("__uf_host"), path.alias("__uf_path"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, host string, path string")
    table = rule_table(rules)
    known = table.agg(F.count("*").alias("n"), F.max(F.size(F.split("__uf_h", r"\."))).alias("labels")).first()
    few = known["n"] <= BROADCAST_RULES
    sized = lambda df: F.broadcast(df) if few else df

    def short(digest: str) -> Column:
        return F.substring(digest, 1, PREFIX_HEX).alias("__uf_short")

    table = table.withColumn("__uf_rule_digest", F.sha2(F.concat("__uf_h", F.lit("\0"), "__uf_p"), 256)).select("*", short("__uf_rule_digest"))
    hosts = table.groupBy("__uf_h").agg(F.collect_set(F.length("__uf_p")).alias("__uf_lengths"))
    hosts = hosts.select(F.sha2("__uf_h", 256).alias("__uf_host_digest"), "__uf_lengths").select("*", short("__uf_host_digest"))

    urls = parts.where(F.col("__uf_url").contains("://")).select("__uf_url", "__uf_host", "__uf_path").distinct()
    labels = F.split("__uf_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(known["labels"] or 1))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    hosted = urls.select("__uf_url", "__uf_path", F.explode(suffixes).alias("__uf_suffix")).withColumn("__uf_digest", F.sha2("__uf_suffix", 256)).select("*", short("__uf_digest"))
    hosted = hosted.join(sized(hosts), "__uf_short").where(F.col("__uf_digest") == F.col("__uf_host_digest"))
    lengths = F.filter("__uf_lengths", lambda n: n <= F.length("__uf_path"))
    prefixes = F.transform(lengths, lambda n: F.sha2(F.concat("__uf_suffix", F.lit("\0"), F.substring(F.col("__uf_path"), F.lit(1), n)), 256))
    expanded = hosted.select("__uf_url", F.explode(prefixes).alias("__uf_digest")).select("*", short("__uf_digest"))
    fits = expanded.join(sized(table), "__uf_short").where(F.col("__uf_digest") == F.col("__uf_rule_digest"))
    name = F.concat("__uf_h", "__uf_p")
    rank = F.struct(F.length(name).alias("n"), F.length("__uf_h").alias("h"), name.alias("rule"), F.col("__uf_action").alias("action"))
    won = fits.groupBy("__uf_url").agg(F.max(rank).alias("__uf_won"))
    judged = parts.join(won, "__uf_url", "left")
    return judged.select(*kept, F.col("__uf_host").alias("host"), F.col("__uf_path").alias("path"), F.col("__uf_won.rule").alias("rule"), F.coalesce("__uf_won.action", F.lit(default)).alias("verdict"))
