"""Every query of the catalogue against its SQL, in DuckDB."""

import math

import duckdb
import pytest

from tessella.plans import catalog
from tessella.plans.oracle import ORACLE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    return v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, sf, duck, name):
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    df = catalog.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert order(tuple(r[n] for n in names) for r in df.collect()) == order(want.fetchall())


def test_every_query_of_the_catalogue_has_sql():
    assert set(catalog.queries()) == set(ORACLE)


def test_prompts_match_their_sql_at_halves_of_a_thousandth(spark, tmp_path):
    c = duckdb.connect()
    c.execute("create table events as select k as event_id, k % 40 as user_id, 'view' as event_type, k / 100 as value from range(-2000, 60000) r(k)")
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = catalog.queries()["prompt_text"](spark, str(tmp_path)).select("event_id", "prompt").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(f"select event_id, prompt from ({ORACLE['prompt_text']})").fetchall())
