"""URL filter lists in the manner of safe-browsing lists, in DataFrame operations.

A rule is (verdict, host, path).  It fits a URL on its host or any subdomain
whose path starts with the rule's.  Each URL is expanded into host-suffix times
path-prefix expressions (suffixes at dots, prefixes at slashes); a rule is keyed
by its host and its path up to the last slash, which is one of the expressions
of every URL it fits.  Expressions of more labels or slashes than any rule has are not
made, so a long URL has no more of them than a short one.  Expressions meet rule keys by an equi-join on the first
``prefix_bits`` bits of SHA-256; the full digest and the whole rule path then
confirm the match.  The longest rule wins (host and path length, then the longer
host; a block beats an allow of the same rule); without a rule the verdict is
``default``.

The rule side is broadcast only when it is counted to be at most
``max_broadcast_rules``; beyond that it is repeated ``salts`` times and the
expressions are salted, so one host that holds a third of all URLs is dealt over
``salts`` tasks.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
no rule; repeated rows are judged each; empty tables give empty results; other
columns are ignored.  A rule with an empty host fits no URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, bind, pin_splits


def url_parts(url: Column) -> tuple[Column, Column]:
    """``(host, path)``: host after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z lower-cased; path from there up to ``?``, ``#`` or the end."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _host_suffixes(host: Column, most: int) -> Column:
    """A host and what is left of it after each dot, of at most ``most`` labels."""
    return bind(F.split(host, r"\."), lambda labels: F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit(most - 1)), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def _path_prefixes(path: Column, most: int) -> Column:
    """The empty prefix and the parts of a path up to each of its first ``most`` slashes."""
    def prefixes(pieces):
        return F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.concat(
            F.array_join(F.slice(pieces, F.lit(1), i - 1), "/"), F.when(i > 1, F.lit("/")).otherwise("")))
    return bind(F.split(path, "/", most + 1), prefixes)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column, bits: int) -> Column:
    return F.substring(digest, 1, bits // 4)


def judge(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
          default: str = "allow", prefix_bits: int = 32, max_broadcast_rules: int = 200_000,
          salts: int = 64) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``urls``; ``rules`` has
    ``verdict`` (allow or block), ``host`` and ``path``."""
    host, path = url_parts(F.col(url_column))
    pin_splits(urls.sparkSession)
    base = urls.select(F.monotonically_increasing_id().alias(ROW), F.col(id_column).alias("id"),
                       F.col(url_column).alias("url")).select(ROW, "id", host.alias("host"), path.alias("path"))
    key = F.concat("host", F.regexp_extract("path", r"^(.*/)?", 1))
    listed = (rules.where(F.length("host") > 0).select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .select(_digest(key).alias("r_digest"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"),
                F.concat("host", "path").alias("r_rule"), F.length("host").alias("r_host")))
    listed = listed.withColumn("r_short", _short(F.col("r_digest"), prefix_bits))
    # no expression with more labels or slashes than any rule can meet one
    slashes = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    count, labels, cuts = rules.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)),
                                    F.coalesce(F.max(slashes), F.lit(0))).first()
    small = count <= max_broadcast_rules

    asked = base.select(ROW, "path", F.explode(_host_suffixes(F.col("host"), labels)).alias("suffix"))
    # a rule path without any slash is keyed by its host alone
    asked = asked.select(ROW, "path", "suffix", F.explode(_path_prefixes(F.col("path"), cuts)).alias("prefix"))
    asked = asked.select(ROW, "path", F.concat("suffix", "prefix").alias("expression"))
    asked = asked.select(ROW, "path", _digest(F.col("expression")).alias("digest"))
    asked = asked.withColumn("short", _short(F.col("digest"), prefix_bits))
    on = [F.col("short") == F.col("r_short")]
    if small:
        listed = F.broadcast(listed)
    else:
        asked = asked.withColumn("salt", F.pmod(F.col(ROW), F.lit(salts)))
        listed = listed.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append(F.col("salt") == F.col("r_salt"))
    hits = asked.join(listed, on).where((F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path")))
    rank = F.struct(F.length("r_rule").alias("a"), F.col("r_host").alias("b"),
                    (F.col("r_verdict") == "block").cast("int").alias("c"), F.col("r_rule").alias("d"))
    won = hits.groupBy(ROW).agg(F.max(F.struct(rank.alias("rank"), F.col("r_verdict").alias("verdict"))).alias("w"))
    won = won.select(F.col(ROW).alias("w_row"), F.col("w.rank.d").alias("rule"), F.col("w.verdict").alias("won"))
    return (base.join(won, F.col(ROW) == F.col("w_row"), "left")
            .select("id", "host", "path", "rule", F.coalesce("won", F.lit(default)).alias("verdict")))


def rules_frame(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, "host/path") pairs."""
    rows = [(v, r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "") for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")
