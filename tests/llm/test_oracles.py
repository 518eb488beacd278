"""The operators that SQL can express against their DuckDB oracles, on whole small tables."""

import duckdb
import pytest

from factframe.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents pages benchmark labels conversations".split()


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_equals_its_oracle(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert mine == theirs
