"""Checks against an independent review log, and the name matching it needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attribix.functions.numeric import ratio

# Review outcomes (correct call, incorrect no-call, incorrect call, correct no-call).
DECISIONS = ("CC", "INC", "IC", "CNC")
ADJUDICATED_ACTOR = ("CC", "INC", "IC")
ADJUDICATED_EVENT = ("CC", "INC")
GRAM = 3
HEAD = 10


def decision_counts(events: DataFrame, session: str, decision: str, adjudicated: Sequence[str] = ADJUDICATED_ACTOR) -> DataFrame:
    """Counts of each outcome per session; an outcome that never occurs still has its column."""
    wide = events.groupBy(session).pivot(decision, list(DECISIONS)).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select(
        session,
        *[F.col(d).alias(d.lower()) for d in DECISIONS],
        sum((F.col(d) for d in adjudicated), F.lit(0)).alias("n_adjudicated"),
        (F.col("CC") + F.col("INC")).alias("n_cc_inc"),
    )


def actor_audit_rates(counts: DataFrame, team: DataFrame, session: str, actor: str) -> DataFrame:
    """Review outcomes of the sessions an actor worked, as rates; empty denominators count as 1."""
    s = (
        team.join(counts, session)
        .groupBy(actor)
        .agg(
            F.count(F.lit(1)).alias("n_sessions"),
            *[F.sum(c).alias(c) for c in ("cc", "inc", "ic", "cnc", "n_adjudicated", "n_cc_inc")],
        )
    )
    return (
        s.withColumn("inc_rate", ratio("inc", "n_cc_inc", "floor1"))
        .withColumn("ic_rate", ratio("ic", F.col("ic") + F.col("cc"), "floor1"))
        .withColumn("cc_share", ratio("cc", "n_cc_inc", "floor1"))
        .withColumn("cnc_rate", ratio("cnc", F.col("cc") + F.col("inc") + F.col("ic") + F.col("cnc"), "floor1"))
    )


def decision_flags(decision: str | Column, adjudicated: Sequence[str] = ADJUDICATED_EVENT) -> list[Column]:
    d = F.coalesce(F.col(decision) if isinstance(decision, str) else decision, F.lit(""))
    return [
        (d == "INC").cast("int").alias("is_inc"),
        (d == "CC").cast("int").alias("is_cc"),
        (d == "IC").cast("int").alias("is_ic"),
        d.isin(*adjudicated).cast("int").alias("is_adjudicated"),
    ]


def pair_audit_rate(events: DataFrame, team: DataFrame, subject: str, session: str, actor: str, decision: str, min_n: int = 5) -> DataFrame:
    """Share of missed calls among adjudicated events of a subject in sessions the actor worked."""
    per_session = (
        events.filter(F.col(decision).isin(*ADJUDICATED_EVENT))
        .groupBy(subject, session)
        .agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(decision) == "INC").alias("__inc"))
    )
    return (
        per_session.join(team, session)
        .groupBy(subject, actor)
        .agg(F.sum("__n").alias("n_adjudicated"), F.sum("__inc").alias("__i"))
        .filter(F.col("n_adjudicated") >= min_n)
        .select(subject, actor, "n_adjudicated", ratio("__i", "n_adjudicated").alias("inc_rate"))
    )


def _pieces(text: Column, lengths: Column) -> Column:
    """Distinct substrings of each of the lengths."""
    none = F.array().cast("array<string>")

    def of(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, n))).otherwise(none)

    return F.array_distinct(F.flatten(F.transform(lengths, of)))


def _holding(names: DataFrame, name: str, text: Column, targets: DataFrame, last: str) -> DataFrame:
    """Distinct names with each target whose surname ``text`` contains.

    The whole surname is the join key against the substrings of the lengths that occur among the surnames, so unrelated
    targets share no key.
    """
    lengths = targets.agg(F.collect_set(F.length(last))).scalar()
    pieces = names.select(name).distinct().withColumn("__lengths", lengths).select(name, F.explode(_pieces(text, F.col("__lengths"))).alias("__p"))
    return pieces.join(targets, F.col("__p") == F.col(last))


def match_prefix(names: DataFrame, name: str, targets: DataFrame, first: str, last: str, order: str, target: str) -> DataFrame:
    """Names matched to the first target whose surname they contain and whose first
    three first-name letters stand within their first ten characters."""
    wanted = targets.select(F.substring(first, 1, GRAM).alias("__g"), F.col(last).alias("__last"), order, target)
    hits = _holding(names, name, F.col(name), wanted, "__last").filter(F.contains(F.substring(name, 1, HEAD), F.col("__g")))
    return hits.groupBy(name).agg(F.min_by(target, order).alias(target))


def match_contains(
    names: DataFrame, name: str, targets: DataFrame, last: str, order: str, target: str, first: str | None = None
) -> DataFrame:
    """Names matched, case-insensitively, to the first target whose surname (and first name) they contain."""
    cols = [F.lower(last).alias("__last"), *([F.lower(first).alias("__first")] if first else [])]
    hits = _holding(names, name, F.lower(name), targets.select(*cols, order, target), "__last")
    if first:
        hits = hits.filter(F.contains(F.lower(name), F.col("__first")))
    return hits.groupBy(name).agg(F.min_by(target, order).alias(target))
