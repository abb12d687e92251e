"""A local session for all tests, and the comparison with DuckDB that the correctness gate makes."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else None if value is None else str(value).removesuffix(" 00:00:00")


def same_rows(got: DataFrame, sql: str, sf_dir: str) -> None:
    """The frame and DuckDB's result have the same columns and the same bag of rows."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    run = con.execute(sql)
    names = [d[0] for d in run.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in run.fetchall())
    have = Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])


@pytest.fixture(scope="session")
def compare():
    return same_rows
