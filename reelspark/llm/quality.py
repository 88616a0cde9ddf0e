"""Host-level quality rules.

Each document gets counts and a handful of rule failures. Failures are added up by
host, each host's failure rate is pulled towards the corpus rate by a beta prior that
is itself fitted to the hosts (method of moments), and a host whose shrunken rate of
any rule is above ``max_rate`` is rejected with all its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, beside, column, fingerprint, typed, unpacked

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
RULES = ("short", "repeats", "symbols", "lines", "length")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_OUT = "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text; a null text has none."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines), len(lines) - len(set(lines)), repeat_words(words)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t) for t in b.column(2).to_pylist()]
        cols = list(zip(*rows)) or [()] * len(COUNTS)
        more = [b.column(i) for i in range(3, b.num_columns)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols), *more], ["doc_id", "host", *COUNTS, *b.schema.names[3:]])


def with_rules(df: DataFrame) -> DataFrame:
    """One boolean column for each of ``RULES``; base_failed is short or repeats."""
    return df.select(
        "*",
        (F.col("n_words") < 50).alias("short"),
        (100 * F.col("n_repeat_words") > 50 * F.col("n_words")).alias("repeats"),
        (10 * F.col("n_symbols") > F.col("word_chars")).alias("symbols"),
        (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")).alias("lines"),
        (F.col("word_chars") > 15 * F.col("n_words")).alias("length"),
    ).withColumn("base_failed", F.col("short") | F.col("repeats"))


def host_verdicts(measured: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, n_docs, one shrunken rate for each rule, rejected.

    The prior of a rule has mean m = all failures / all documents and strength
    s = m(1-m)/v - 1, v being what the hosts' rates vary beyond chance. Without
    such variance the prior is as strong as the whole corpus.
    """
    key = "host"
    hosts = measured.groupBy(key).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    sums = [F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("h")]
    for r in RULES:
        sums += [F.sum(r).alias(f"f_{r}"), F.sum(F.col(r) * F.col(r) / F.col("n_docs")).alias(f"q_{r}")]
    row = hosts.agg(*sums).first()  # one row of sums
    n, h = row["n"] or 0, row["h"] or 0
    rates = []
    for r in RULES:
        m = (row[f"f_{r}"] or 0) / n if n else 0.0
        chance = m * (1 - m) * h / n if n else 0.0
        v = ((row[f"q_{r}"] or 0.0) / n - m * m if n else 0.0) - chance
        s = min(float(n), max(0.0, m * (1 - m) / v - 1)) if v > 0 else float(n)
        rates.append(((F.col(r) + F.lit(m * s)) / (F.col("n_docs") + F.lit(s))).alias(f"rate_{r}"))
    hosts = hosts.select(key, "n_docs", *rates)
    return hosts.withColumn("rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_rate)


def _host(name):
    return F.coalesce(F.concat(F.lit("="), name), F.lit("-"))


def _judged(docs: DataFrame, host: str, max_rate: float, *more) -> DataFrame:
    """doc_id, host, the counts, the rules, host_rejected, kept and ``more``, columns of longs: one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    rows = typed(docs, doc_id="long", **{host: "string"}, text="string")
    rows = rows.select("doc_id", _host(F.col(host)).alias("host"), "text", *more)
    measured = with_rules(scratch.save(rows.mapInArrow(_measure, ", ".join([_OUT, *(f"{c} long" for c in rows.columns[3:])]))))
    verdicts = scratch.save(host_verdicts(measured, max_rate).select("host", F.col("rejected").alias("host_rejected")))
    return measured.join(verdicts, "host", "left").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, host_rejected, kept: one row for each row of ``docs``.

    Null or empty text has no words and fails as short. Rows without a host share one.
    Repeated rows and equal ids are kept as they are; other columns are ignored.
    An empty table gives an empty result.
    """
    return _judged(docs, host, max_rate).select("doc_id", *COUNTS, "base_failed", "host_rejected", "kept")


def reject_low_quality(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows that pass, with all their columns.

    Each row is judged by its own text and host, whatever its id: ids may repeat or be null.
    Null and empty texts fail as short, so a table without a text has no row that passes. Repeated
    rows pass or fail together; other columns may have any names. An empty table gives an empty result.
    """
    judged = _judged(docs, host, max_rate, *fingerprint("text"))
    # text and host tell the verdict; the id only deals copies of a text over the tasks
    keys = ["id", "host", "h1", "h2"]
    passed = judged.where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("id"), "host", "h1", "h2").distinct()
    h1, h2 = fingerprint(column(docs, "text", "string"))
    own = beside(docs, id=F.coalesce(column(docs, "doc_id", "long"), F.lit(0)), host=_host(column(docs, host, "string")), h1=h1, h2=h2)
    return unpacked(own.join(passed, keys, "left_semi"), docs.columns)
