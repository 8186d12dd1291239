"""Each query with an oracle against DuckDB at the smallest scale; the others for rows and schema."""

from __future__ import annotations

import math

import duckdb
import pytest

from graphprop.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(clean, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = con.execute(f"DESCRIBE SELECT * FROM ({ORACLES[name]})").fetchall()
    assert sorted(c[0] for c in got) == columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    own = normal(df.select(*columns).collect())
    want = normal(want)
    assert len(own) == len(want)
    bad = [(a, b) for a, b in zip(own, want, strict=True) if a != b]
    assert not bad, bad[:5]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_push_and_walk_takes_every_dimension(spark):
    out = QUERIES["push_and_walk"](spark, SF)
    assert {r.dim for r in out.select("dim").distinct().collect()} == {0, 1, 2, 3}
