"""Property trio: forward replay scores 100, empty is low, a verbatim copy is below perfect."""

import pytest

from migrata.operators.transforms import apply_log
from migrata.plans.verify import grade
from migrata.sources.generate import generate
from migrata.spec import check_preconditions, validate_schema
from tests.specs import BLOCKS, LOG, SCHEMA


@pytest.fixture(scope="module")
def source(spark):
    return {k: v.cache() for k, v in generate(spark, SCHEMA, n=12, seed=7).items()}


def test_spec_is_valid():
    assert validate_schema(SCHEMA) == []
    assert check_preconditions(SCHEMA, LOG) == []


def test_perfect_replay_scores_100(source):
    dest = apply_log(source, LOG, blocks=BLOCKS)
    r = grade(SCHEMA, LOG, source, dest)
    assert r["total"] == pytest.approx(100.0, abs=1e-6), r


def test_empty_scores_low(source):
    r = grade(SCHEMA, LOG, source, {})
    assert r["total"] <= 25


def test_verbatim_below_perfect(source):
    r = grade(SCHEMA, LOG, source, dict(source))
    assert r["total"] < 100


def test_scores_invariant_to_partitioning(spark, source):
    dest = apply_log(source, LOG, blocks=BLOCKS)
    dest["DryParcel"] = dest["DryParcel"].unionByName(dest["WetParcel"])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = grade(SCHEMA, LOG, source, dest)
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        shuffled_src = {k: v.repartition(7) for k, v in source.items()}
        shuffled_dst = {k: v.repartition(5) for k, v in dest.items()}
        b = grade(SCHEMA, LOG, shuffled_src, shuffled_dst)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == pytest.approx(b, abs=1e-12)
    assert a["total"] < 100
