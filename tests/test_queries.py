"""Registered queries: checked answers and plan shapes."""

import pytest

import __spark_entry__ as entry
from rolesift.plans import QUERIES
from tools.check import compare, oracle

SF = "/root/testdata/sf0.001"
QUICK = [
    "F2_url_quality_gate", "F5_title_prefilter", "W2_distinct_in_order", "W3_discovery_state", "A5_source_yield",
    "J4_resolve_company", "M1_upsert_matches", "M2_mark_applied", "S2_endpoint_contract", "W7_capped_scan", "W12_page", "W12_last_page", "A13_calibration_report", "X6_refresh_diff", "J15_effective_titles",
]


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).fetchdf()) == "" and len(got) > 0


@pytest.mark.parametrize("name", ["C1_qualify", "F6_seed_title_prefilter", "W1_dedupe_batch", "A7_build_source_registry", "X4_flatten_feed"])
def test_plans_stay_native_and_keyed(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_every_query_has_an_answer():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
