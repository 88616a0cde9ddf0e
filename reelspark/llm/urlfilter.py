"""URL filters whose lists change over time.

A list is a table of dated entries: from ``since`` on a key is blocked, allowed, or no longer
listed (action remove). The entries of a key become validity intervals, each ending where
the key's next entry begins. Every capture is joined to the intervals that hold at its
fetch time, and the most specific of them decides: the longest path, then the host, then
the closest domain.

The as-of join is an equality of key and time bucket, intervals being laid out over the
buckets they touch, so a key with many entries meets each capture with those of one
bucket only. DataFrame functions only; a list of up to ``SENT`` laid-out intervals goes to
every executor, a longer one is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import Scratch, typed

SENT = 1_000_000
BUCKET = 30 * 86400
KINDS = ("domain", "host", "path")
_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a last dot; empty where the URL has none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, action, since, until): until is null for the last; times are seconds.

    Entries of a key at the same time: the greatest action by name counts. Entries with a
    null, an unknown kind or an unknown action say nothing.
    """
    e = typed(entries, kind="string", value="string", action="string", since="timestamp").dropna()
    e = e.where(F.col("kind").isin(*KINDS) & F.col("action").isin("allow", "block", "remove"))
    # a host or domain is compared in lower case, of a path only its host
    value = F.when(F.col("kind") == "path", F.concat(F.lower(F.regexp_extract("value", "^[^/]*", 0)), F.regexp_replace(F.regexp_extract("value", "^[^/]*(.*)$", 1), "/+$", ""))).otherwise(F.lower("value"))
    e = e.select("kind", value.alias("value"), "action", F.unix_seconds("since").alias("since"))
    e = e.groupBy("kind", "value", "since").agg(F.max("action").alias("action"))
    until = F.lead("since").over(Window.partitionBy("kind", "value").orderBy("since"))
    return e.withColumn("until", until).where("action <> 'remove'")


def _keys(labels: int, depth: int) -> Column:
    """(kind, value, rank) of all that may be listed for a host and a path, as deep as the list goes."""
    parts = F.split("host", r"\.")
    steps = F.split(F.regexp_replace("path", "/+$", ""), "/")
    n, m = F.size(parts), F.size(steps)
    domain = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(labels))) if labels else F.array().cast("array<int>"),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, n - i + 1, i), ".").alias("value"), i.alias("rank")),
    )
    host = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value"), F.lit(1 << 20).alias("rank")))
    path = F.transform(
        F.sequence(F.lit(1), F.least(m, F.lit(depth))) if depth else F.array().cast("array<int>"),
        lambda i: F.struct(F.lit("path").alias("kind"), F.concat(F.col("host"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("value"), (i + (1 << 20)).alias("rank")),
    )
    return F.concat(domain, host, path)


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, host, fetched, blocked, rule_kind, rule_value, rule_action, rule_since: one row for each row of ``captures``.

    captures: page_id, url, fetched. entries: kind (domain, host or path), value, action, since.
    The rule columns are null, and blocked false, where no entry holds: so for null URLs,
    URLs without a host, null fetch times and empty lists. Repeated rows are kept, other
    columns ignored. An empty table gives an empty result.
    """
    scratch = Scratch(captures.sparkSession)
    c = typed(captures, page_id="long", url="string", fetched="timestamp")
    c = scratch.save(c.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.unix_seconds("fetched").alias("at"), F.monotonically_increasing_id().alias("row")))
    listed = scratch.save(intervals(entries))
    bucket = lambda x: F.floor(x / F.lit(BUCKET)).cast("long")
    low, high = c.agg(F.min(bucket(F.col("at"))), F.max(bucket(F.col("at")))).first()
    row = listed.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))), F.max(F.when(F.col("kind") == "path", F.size(F.split("value", "/"))))
    ).first()
    rule = [F.col(x).alias(f"rule_{x}") for x in ("kind", "value", "action")]
    nothing = [F.lit(None).cast("string").alias(f"rule_{x}") for x in ("kind", "value", "action")]
    out = c.select("row", "page_id", "url", "host", "fetched")
    if low is None:
        return out.select("page_id", "url", "host", "fetched", F.lit(False).alias("blocked"), *nothing, F.lit(None).cast("timestamp").alias("rule_since"))
    # only buckets in which something was fetched
    first, last = F.greatest(bucket(F.col("since")), F.lit(low)), F.least(F.coalesce(bucket(F.col("until") - 1), F.lit(high)), F.lit(high))
    laid = listed.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("bucket"))
    laid = scratch.save(laid)
    keyed = c.where("host <> '' AND at IS NOT NULL").select("row", "at", bucket(F.col("at")).alias("bucket"), F.explode(_keys(row[0] or 0, row[1] or 0)).alias("k")).select("row", "at", "bucket", "k.*")
    side = F.broadcast(laid) if laid.count() <= SENT else laid
    hits = keyed.join(side, ["kind", "value", "bucket"]).where("since <= at AND (until IS NULL OR at < until)")
    best = F.max(F.struct("rank", "kind", "value", "action", "since")).alias("b")
    best = hits.groupBy("row").agg(best).select("row", "b.kind", "b.value", "b.action", "b.since")
    joined = out.join(best, "row", "left")
    return joined.select("page_id", "url", "host", "fetched", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"), *rule, F.timestamp_seconds("since").alias("rule_since"))


def capture_days(pages: DataFrame, first: str = "2024-01-01", days: int = 730) -> DataFrame:
    """page_id, url, fetched for pages that came without a fetch time: a day that follows from page_id."""
    p = typed(pages, page_id="long", url="string")
    return p.withColumn("fetched", F.timestamp_seconds(F.unix_seconds(F.lit(first).cast("timestamp")) + F.pmod(F.col("page_id") * 7919, F.lit(days)) * 86400))


def sample_list(pages: DataFrame, first: str = "2024-01-01") -> DataFrame:
    """A dated list by a rule on the pages' hosts: k is a number from the host's MD5.

    Every third host's parent domain is blocked for good; every fourth host is blocked for
    120 days; every fifth host is allowed for 200 days; every other host's /en is blocked.
    """
    hosts = typed(pages, url="string").select(host_of(F.col("url")).alias("h")).where("h <> ''").distinct()
    k = F.conv(F.substring(F.md5("h"), 1, 4), 16, 10).cast("long")
    start = F.unix_seconds(F.lit(first).cast("timestamp"))
    day = lambda d: F.timestamp_seconds(start + d * 86400)
    parent = F.regexp_replace("h", r"^[^.]*\.", "")
    rows = [
        (k % 3 == 0, "domain", parent, "block", k % 400),
        (k % 4 == 1, "host", F.col("h"), "block", k % 500),
        (k % 4 == 1, "host", F.col("h"), "remove", k % 500 + 120),
        (k % 5 == 2, "host", F.col("h"), "allow", k % 450),
        (k % 5 == 2, "host", F.col("h"), "remove", k % 450 + 200),
        (k % 2 == 0, "path", F.concat(F.col("h"), F.lit("/en")), "block", k % 600),
    ]
    each = F.array(*[F.when(c, F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(a).alias("action"), day(d).alias("since"))) for c, kind, v, a, d in rows])
    return hosts.select(F.explode(F.array_compact(each)).alias("e")).select("e.*").distinct()
