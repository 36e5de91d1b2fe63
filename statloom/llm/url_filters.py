"""URL allow and block rules by host suffix and path prefix, as a hashed equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a SHA-256 digest that the join compares first; the whole digest is compared after it.
PREFIX_BYTES = 4


def url_host(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def url_filters(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each row's URL: the rule that fits and reaches furthest decides, or else ``default``.

    ``rules`` has host, path and action (allow or block). A rule fits its host and all hosts below it when the
    URL's path starts with the rule's path. The longest host + path wins, then the longer host; of equal rules
    with different actions, block. A rule with a null host, path or action never fits.

    Every URL is expanded into its host suffixes times those path prefixes whose lengths occur among the rules
    (no other prefix can equal a rule), so the expansion is bounded by host labels x rule path lengths. The
    expressions meet the rules on the first bytes of their digests; whole digests are compared next. A URL's own
    expressions lie side by side, so the final aggregation combines before it shuffles. Spark broadcasts the rules
    only while their size stays under its threshold, and else joins by shuffle, splitting hot expressions.

    Null URLs and those without ``://`` have an empty host and path, and the default verdict. Rows that repeat
    are judged one by one. Returns the id, host, path, rule and verdict of each row.
    """
    r = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action")).dropna()
    r = r.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, 2 * PREFIX_BYTES))
    lengths = sorted(x[0] for x in r.select(F.length("r_path")).distinct().collect())  # a few integers, bounded by the longest rule
    host, path = F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.struct(s.alias("s"), F.substring(path, F.lit(1), n).alias("p")))))
    rows = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).withColumn("row", F.monotonically_increasing_id())
    spread = rows.select("row", "id", "host", "path", F.explode_outer(expressions).alias("e")).select("row", "id", "host", "path", _digest(F.col("e.s"), F.col("e.p")).alias("digest"))
    spread = spread.withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
    met = spread.join(r, (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")), "left")
    rule = F.concat("r_host", "r_path")
    best = F.max(F.when(rule.isNotNull(), F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), F.col("r_action").alias("a"), rule.alias("rule")))).alias("best")
    out = met.groupBy("row", "id", "host", "path").agg(best)
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.a", F.lit(default)).alias("verdict"))
