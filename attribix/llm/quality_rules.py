"""Quality rules with host verdicts.

Every document is measured once, in one pass over its whole text. The failures of each rule are counted per host, the
host's failure rates are shrunk by a beta prior fitted to all hosts, and the host's verdict goes back to its documents:

* ``rejected``: for some rule the posterior rate is above ``HOST_RATE`` beyond doubt (mean less ``Z`` deviations). All
  documents of the host go.
* ``trusted``: for every rule the posterior rate is below ``TRUST_RATE`` beyond doubt. Its few failures of the method's
  own rules are forgiven.
* ``neutral``: documents that fail one of the method's own rules go, the others stay.

Documents that fail the base rules always go.

Defined results: a null or empty text has no words and fails the base rules. A null source is a host of its own.
Repeated rows are measured and counted one by one. An empty table gives an empty result. Other columns of the table
are not touched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .shared import ascii_words, fresh, staged, takes_over

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50
SYMBOLS = b"#*$%&|<>"
MAX_SYMBOLS_PER_100_WORDS = 20
MAX_DUP_LINE_SHARE, MIN_DUP_LINES = 30, 3
MIN_MEAN_CHARS, MAX_MEAN_CHARS = 2, 25

#: Own rules of the method, next to the base: each is one column, true where the document fails.
RULES = {
    "fail_base": f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_SHARE} * n_words",
    "fail_symbols": f"100 * n_symbols > {MAX_SYMBOLS_PER_100_WORDS} * n_words",
    "fail_dup_lines": f"n_dup_lines >= {MIN_DUP_LINES} and 100 * n_dup_lines > {MAX_DUP_LINE_SHARE} * n_lines",
    "fail_word_length": f"word_chars < {MIN_MEAN_CHARS} * n_words or word_chars > {MAX_MEAN_CHARS} * n_words",
}
OWN = [r for r in RULES if r != "fail_base"]

HOST_RATE = 0.5
TRUST_RATE = 0.01
Z = 3.0
#: Bounds of the prior's weight in documents; the moments of few or equal hosts can give any.
WEIGHT_MIN, WEIGHT_MAX = 2.0, 10_000.0

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode()
    words = ascii_words(data)
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\v\f\r")))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n - 2:
            seen, twice = set(), set()
            for w in windows:
                (twice if w in seen else seen).add(w)
            end = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def _columns(texts: Iterable) -> list[pa.Array]:
    rows = [measures(t.as_py()) for t in texts]
    return [pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * len(NAMES))]


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    takes_over("rules", lambda: None)
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), *_columns(batch.column("text"))], names=["doc_id", "source", *NAMES])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures and rule columns, a row for each document."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    ).mapInArrow(_measured, f"doc_id long, source string, {MEASURES}")
    return rows.withColumns({name: F.expr(rule) for name, rule in RULES.items()})


def _failures(text: Column) -> Column:
    """Struct of the rule columns of each text; texts alone go through Python, the rest of the row stays where it is."""

    @F.arrow_udf(f"struct<{MEASURES.replace(' ', ':').replace(',:', ',')}>")
    def measure(texts: pa.Array) -> pa.Array:
        takes_over("rules", lambda: None)
        return pa.StructArray.from_arrays(_columns(texts), NAMES)

    return measure.asNondeterministic()(text)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """One row per host: documents, shrunk rate and verdict, from :func:`measured` rows.

    The prior of a rule has the mean and the spread of the hosts' own rates (each host counts once, so a host with a
    third of all rows doesn't set it): weight = mean (1 - mean) / variance - 1.
    """
    hosts = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    hosts = checkpointed(hosts)
    moments = hosts.agg(*[x for r in RULES for x in (
        F.avg(F.col(r) / F.col("n")).alias(f"m_{r}"), F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}"))])
    prior = moments.select(F.struct("*")).scalar()
    out = hosts.withColumn("__p", prior)
    for r in RULES:
        m, v = F.col(f"__p.m_{r}"), F.col(f"__p.v_{r}")
        weight = F.when(v <= 0, F.lit(WEIGHT_MAX)).otherwise(
            F.least(F.greatest(m * (1 - m) / v - 1, F.lit(WEIGHT_MIN)), F.lit(WEIGHT_MAX)))
        out = out.withColumn(f"__w_{r}", weight)
        rate = (F.col(r) + F.col(f"__w_{r}") * m) / (F.col("n") + F.col(f"__w_{r}"))
        out = out.withColumn(f"rate_{r}", rate)
        out = out.withColumn(f"__sd_{r}", F.sqrt(
            F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (F.col("n") + F.col(f"__w_{r}") + 1)))
    bad = F.greatest(*[F.col(f"rate_{r}") - Z * F.col(f"__sd_{r}") for r in RULES])
    worst = F.greatest(*[F.col(f"rate_{r}") + Z * F.col(f"__sd_{r}") for r in RULES])
    return out.select(
        "source", F.col("n").alias("host_docs"), *[f"rate_{r}" for r in RULES],
        F.when(bad > HOST_RATE, "rejected").when(worst < TRUST_RATE, "trusted").otherwise("neutral").alias("host_verdict"),
    )


def judged(docs: DataFrame) -> DataFrame:
    """Every document with its measures, rule columns, host verdict, ``base_failed`` and ``kept``."""
    rows = checkpointed(measured(docs))
    hosts = checkpointed(host_verdicts(rows).select(F.col("source").alias("__host"), "host_verdict"))
    own = F.greatest(*[F.col(r) for r in OWN])
    return (
        rows.join(hosts, F.col("source").eqNullSafe(F.col("__host")))
        .withColumn("base_failed", F.col("fail_base"))
        .withColumn("kept", ~F.col("fail_base") & (F.col("host_verdict") != "rejected")
                    & (~own | (F.col("host_verdict") == "trusted")))
        .drop("__host")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows the rules reject, all columns as they were.

    The rows are written once with their measures beside them. Only the verdicts of hosts that are not neutral are joined
    to them, so no text is shuffled while adaptive execution finds these few.
    """
    m, host, verdict = fresh(docs, "__m", "__host", "__verdict")
    rows = staged(docs.withColumn(m, _failures(F.col("text").cast("string"))), "rules")
    rules = {r: F.expr(_over(rule, m)) for r, rule in RULES.items()}
    hosts = host_verdicts(rows.select(F.col("source").cast("string").alias("source"), *[c.alias(r) for r, c in rules.items()]))
    hosts = checkpointed(hosts.where("host_verdict <> 'neutral'").select(F.col("source").alias(host), F.col("host_verdict").alias(verdict)))
    named = rows.join(hosts, rows["source"].cast("string").eqNullSafe(hosts[host]), "left")
    said, own = F.coalesce(verdict, F.lit("neutral")), F.greatest(*[rules[r] for r in OWN])
    return named.where(~rules["fail_base"] & (said != "rejected") & (~own | (said == "trusted"))).select(*docs.columns)


def _over(rule: str, column: str) -> str:
    """The rule over the fields of a struct column."""
    return re.sub("|".join(rf"\b{n}\b" for n in NAMES), lambda found: f"{column}.{found[0]}", rule)
