"""Decisions made in order against a plain fold over them, one after the other."""

from __future__ import annotations

import random

import pytest

from quillspark.operators import decisions
from quillspark.operators.linkage import TERMINAL

ACTIVE = "reference_id long, determination string, canonical_id long, authority string"
SCHEMA = f"{ACTIVE}, place long"


def folded(active, made, force):
    """State and outcomes after each decision in turn."""
    state, out = {r: (d, c, a) for r, d, c, a in active}, []
    for ref, new, canonical, authority, place in sorted(made, key=lambda m: m[4]):
        was = state.get(ref, (None, None, None))
        linked = new in ("duplicate", "exact_duplicate")
        if new not in TERMINAL:
            reason = "only terminal determinations can be decided"
        elif canonical == ref:
            reason = "a reference duplicates itself"
        elif linked and canonical is None:
            reason = "a duplicate needs a canonical"
        elif canonical is not None and state.get(canonical, (None,))[0] != "canonical":
            reason = "the canonical is none"
        else:
            reason = None
        if reason:
            out.append((place, ref, None, False, False, reason))
        elif not force and was[2] == "person" and authority == "system":
            out.append((place, ref, "decoupled", False, False, None))
        elif not force and was[0] == "duplicate" and (new == "canonical" or (new == "duplicate" and was[1] != canonical)):
            out.append((place, ref, "decoupled", False, True, None))
        elif new == "duplicate" and any(c == ref for _, c, _ in state.values()):
            out.append((place, ref, "decoupled", False, True, None))
        else:
            out.append((place, ref, new, True, (was[0], was[1]) != (new, canonical), None))
            state[ref] = (new, canonical, authority)
    return {(r, *s) for r, s in state.items()}, set(out)


def run(spark, active, made, force=True):
    state, outcomes = decisions.decide_in_turn(spark.createDataFrame(active, ACTIVE), spark.createDataFrame(made, SCHEMA), force)
    return {tuple(r) for r in state.collect()}, {tuple(r) for r in outcomes.select("place", "reference_id", "determination", "activate", "changed", "reason").collect()}


@pytest.mark.parametrize("force", [True, False])
def test_random_decisions_are_the_fold(spark, force):
    rng = random.Random(31)
    active = [(i, "canonical", None, rng.choice(["person", "system"])) for i in range(8)] + [(i, "duplicate", rng.randrange(8), rng.choice(["person", "system"])) for i in range(8, 16)]
    kinds = ["duplicate"] * 6 + ["canonical"] * 3 + ["unsearchable", "exact_duplicate", "pending"]
    made = []
    for place in range(45):
        kind = rng.choice(kinds)
        canonical = rng.randrange(20) if kind.endswith("duplicate") and rng.random() < 0.95 else None
        made.append((rng.randrange(18), kind, canonical, rng.choice(["person", "system"]), place))
    rng.shuffle(made)
    assert run(spark, active, made, force) == folded(active, made, force)


def test_a_canonical_with_duplicates_is_decoupled(spark):
    active = [(1, "canonical", None, "system"), (2, "canonical", None, "system"), (3, "canonical", None, "system"), (4, "duplicate", 1, "system")]
    # Once 4 is moved away, 1 may become a duplicate; before, it is decoupled.
    made = [(1, "duplicate", 2, "person", 1), (2, "duplicate", 3, "person", 2), (4, "duplicate", 3, "person", 3), (1, "duplicate", 3, "person", 4)]
    state, outcomes = run(spark, active, made)
    assert state == {(1, "duplicate", 3, "person"), (2, "duplicate", 3, "person"), (3, "canonical", None, "system"), (4, "duplicate", 3, "person")}
    assert {(o[0], o[2]) for o in outcomes} == {(1, "decoupled"), (2, "duplicate"), (3, "duplicate"), (4, "duplicate")}


def test_many_duplicates_of_one_canonical_are_one_round(spark, monkeypatch):
    rounds = []
    real = decisions._ready
    monkeypatch.setattr(decisions, "_ready", lambda waiting: rounds.append(1) or real(waiting))
    active = [(i, "canonical", None, "system") for i in range(60)]
    made = [(i, "duplicate", 0, "person", i) for i in range(1, 60)]
    state, outcomes = run(spark, active, made)
    assert len(rounds) == 1 and len(outcomes) == 59 and sum(s[2] == 0 for s in state) == 59
    assert run(spark, active, []) == ({(i, "canonical", None, "system") for i in range(60)}, set())
