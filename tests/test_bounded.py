"""Operators whose tasks must not take a whole group or file."""

from __future__ import annotations

from quillspark.operators import standing
from quillspark.sources import lines


def test_dispatch_in_bounded_batches(spark):
    rows = [("a", i) for i in range(1000)] + [("a", 5), ("a", None), ("b", 3), ("c", 1)]
    sent = standing.dispatch(spark.createDataFrame(rows, "robot string, id long"), "id", skip_robot="c", size=64).collect()
    assert all(0 < len(r["references"]) <= 64 and r["references"] == sorted(r["references"]) for r in sent)
    assert len({(r["robot"], r["batch"]) for r in sent}) == len(sent)
    assert sorted((r["robot"], i) for r in sent for i in r["references"]) == [("a", i) for i in range(1000)] + [("b", 3)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for name, n in (("x.txt", 900), ("y.txt", 433)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" if i % 7 else "\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = lines.read_lines(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["line"], r["line_no"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f"{name} {i}", i) for name, n in (("x.txt", 900), ("y.txt", 433)) for i in range(1, n + 1) if i % 7)
    numbering = [line for line in plan.split("\n") if "row_number()" in line and "Window" in line]
    assert numbering and all("start#" in line for line in numbering)
