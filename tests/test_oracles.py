"""One representative query per family against its DuckDB oracle (sf0.001)."""

import os

import pytest

from tests.conftest import SF001
from tools.compare import TABLES, digest

NAMES = ["t_replay_full", "t_merge_collision", "k_dense_id_nested", "o_relabel", "p_nested_project",
         "v_fid_extract", "v_str_jaccard", "a_ranking", "c_fk_orphans", "s_record_bag", "a_fingerprint", "t_replay_customer_detail", "c_waves"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_partition_is_replayed():
    from migrata.plans import catalog_transforms as c
    names = {f"t_replay_{x}_event" for x in ("click", "view", "purchase", "signup")}
    assert names <= set(c.queries()) and names <= set(c.oracles())
