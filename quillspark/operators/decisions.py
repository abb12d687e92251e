"""Duplicate decisions made in order: an ordered fold over the references they share, in parallel rounds.

A decision reads and writes the state of its subject, reads whether its canonical is one, and changes how
many duplicates that one and the subject's canonical so far have. So two decisions depend on each other only
where one's subject is any of the three references of the other. A round makes all decisions
that no earlier one waits in front of; decisions on one canonical by many subjects are one round, however
many they are, and the number of rounds is the length of the longest chain of dependent decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import lineage
from quillspark.operators.linkage import TERMINAL, map_decision

_ROLES = ("reference_id", "canonical_id", "active_canonical")


def _involved(active: DataFrame, decisions: DataFrame) -> DataFrame:
    """State of every reference that a decision may read: ref, determination, canonical_id, authority, n_duplicates."""
    subjects = decisions.select(F.col("reference_id").alias("ref")).distinct()
    held = active.join(subjects, F.col("reference_id") == F.col("ref"), "left_semi")
    refs = subjects.unionByName(decisions.select(F.col("canonical_id").alias("ref"))).unionByName(held.select(F.col("canonical_id").alias("ref"))).where("ref is not null").distinct()
    led = active.where("canonical_id is not null").groupBy(F.col("canonical_id").alias("ref")).agg(F.count(F.lit(1)).alias("n_duplicates"))
    known = refs.join(active.withColumnRenamed("reference_id", "ref"), "ref", "left").join(led, "ref", "left")
    return known.select("ref", "determination", "canonical_id", "authority", F.coalesce("n_duplicates", F.lit(0).cast("long")).alias("n_duplicates"))


def _ready(waiting: DataFrame) -> DataFrame:
    """The decisions that depend on no earlier one that still waits."""
    touched = waiting.select("place", F.explode(F.array_distinct(F.array_compact(F.array(*_ROLES)))).alias("ref")).groupBy("ref").agg(F.min("place").alias("first"))
    decided = waiting.groupBy(F.col("reference_id").alias("ref")).agg(F.min("place").alias("first"))
    named = lambda df, role: df.select(F.col("ref").alias(role), F.col("first").alias(f"first_{role}"))
    out = waiting.join(named(touched, "reference_id"), "reference_id")
    for role in _ROLES[1:]:
        out = out.join(named(decided, role), role, "left")
    free = F.col("first_reference_id") == F.col("place")
    for role in _ROLES[1:]:
        free = free & (F.coalesce(f"first_{role}", F.col("place")) >= F.col("place"))
    return out.where(free).drop(*(f"first_{r}" for r in _ROLES))


def _judged(ready: DataFrame, state: DataFrame, force: bool) -> DataFrame:
    """Ready decisions with determination, activate and changed, or with a reason for which they can't be made."""
    target = state.select(F.col("ref").alias("canonical_id"), (F.col("determination") == "canonical").alias("to_canonical"))
    rows = ready.join(target, "canonical_id", "left")
    linked = F.col("new_determination").isin("duplicate", "exact_duplicate")
    reason = (
        F.when(~F.coalesce(F.col("new_determination").isin(*TERMINAL), F.lit(False)), "only terminal determinations can be decided")
        .when(F.col("canonical_id") == F.col("reference_id"), "a reference duplicates itself")
        .when(linked & F.col("canonical_id").isNull(), "a duplicate needs a canonical")
        .when(F.col("canonical_id").isNotNull() & ~F.coalesce("to_canonical", F.lit(False)), "the canonical is none")
    )
    rows = rows.withColumns({"reason": reason, "new_canonical": F.col("canonical_id"), "has_duplicates": F.col("n_duplicates") > 0})
    mapped = map_decision(rows, force)
    done = F.col("reason").isNull()
    return mapped.withColumns({"determination": F.when(done, F.col("determination")), "activate": done & F.col("activate"), "changed": done & F.col("changed")})


def decide_in_turn(active: DataFrame, decisions: DataFrame, force: bool = True) -> tuple[DataFrame, DataFrame]:
    """(active decisions afterwards, outcome of every decision), made in the order of ``place``.

    ``active``: reference_id (unique), determination, canonical_id, authority; ``decisions``: the same and a
    unique place. A decision that would make a duplicate of something that isn't canonical when its turn comes fails
    with a reason; a subject with duplicates is decoupled instead of becoming one, which leaves its active decision as it
    is; without ``force`` the rest of :func:`linkage.map_decision` holds too. Outcomes: place, reference_id,
    determination, activate, changed, reason.
    """
    columns = ["reference_id", "determination", "canonical_id", "authority"]
    state = lineage.cut(_involved(active, decisions))
    new = decisions.select("place", "reference_id", F.col("determination").alias("new_determination"), "canonical_id", F.col("authority").alias("new_authority"))
    waiting, outcomes = lineage.cut(new), []
    while not waiting.isEmpty():
        held = state.select(F.col("ref").alias("reference_id"), F.col("determination").alias("active_determination"), F.col("canonical_id").alias("active_canonical"), F.col("authority").alias("active_authority"), "n_duplicates")
        judged = lineage.cut(_judged(_ready(waiting.join(held, "reference_id", "left")), state, force))
        outcomes.append(judged.select("place", "reference_id", "determination", "activate", "changed", "reason"))
        made = judged.where("activate")
        after = made.select(F.col("reference_id").alias("ref"), F.struct(F.col("determination").alias("determination"), "canonical_id", F.col("new_authority").alias("authority")).alias("made"))
        moves = made.select(F.col("canonical_id").alias("ref"), F.lit(1).alias("more")).unionByName(made.select(F.col("active_canonical").alias("ref"), F.lit(-1).alias("more")))
        more = moves.where("ref is not null").groupBy("ref").agg(F.sum("more").alias("more"))
        was = lambda c: F.when(F.col("made").isNotNull(), F.col(f"made.{c}")).otherwise(F.col(c)).alias(c)
        state = lineage.cut(state.join(after, "ref", "left").join(more, "ref", "left").select("ref", was("determination"), was("canonical_id"), was("authority"), (F.col("n_duplicates") + F.coalesce("more", F.lit(0))).alias("n_duplicates")))
        waiting = lineage.cut(waiting.join(judged.select("place"), "place", "left_anti"))
    subjects = state.where("determination is not null").join(decisions.select(F.col("reference_id").alias("ref")).distinct(), "ref", "left_semi").withColumnRenamed("ref", "reference_id")
    whole = active.select(columns).join(subjects.select("reference_id"), "reference_id", "left_anti").unionByName(subjects.select(columns))
    none = new.limit(0).select("place", "reference_id", F.lit("").alias("determination"), F.lit(True).alias("activate"), F.lit(True).alias("changed"), F.lit("").alias("reason"))
    for o in outcomes:
        none = none.unionByName(o)
    return whole, none
