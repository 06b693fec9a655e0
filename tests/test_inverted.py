"""Inverted indexes against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from rolesift.operators import inverted, matching
from rolesift.operators.profiles import prepare

SETTINGS = """profile_id int, target_titles string, preferred_locations string, include_keywords string, exclude_keywords string, remote_only string, include_remote string,
 search_strategy string, preferred_job_levels string"""
WORDS = ["vp", "of", "it", "director", "platform", "head", "data", "analyst", "digital", "a", "engineering", "cloud", "sr"]
PLACES = ["Dallas, TX", "Texas", "New York, NY", "United States", "Canada", "London, UK", "Paris", "TX", "Toronto, Ontario, Canada", "Plano - TX", "Remote", "", "York", "New Delhi India", "Fort Worth, Texas"]


def profiles(spark, rnd, n=25):
    title = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4)))
    rows = [(k, "; ".join(title() for _ in range(rnd.randint(0, 3))), "; ".join(rnd.sample(PLACES, rnd.randint(0, 9))), "", "", "false", "true", "balanced", "") for k in range(n)]
    return spark.createDataFrame(rows, SETTINGS)


@pytest.mark.parametrize("seed,k", [(1, 3), (3, 100)])
def test_top_profiles_equal_all_pairs(spark, seed, k):
    rnd = random.Random(seed)
    owners = profiles(spark, rnd)
    rows = [(i, " ".join(rnd.choice(WORDS + ["VP,", "Head/of", "digitally"]) for _ in range(rnd.randint(0, 6)))) for i in range(40)]
    postings = spark.createDataFrame(rows, "posting_id long, title string")
    pairs = postings.crossJoin(prepare(owners).drop("title"))
    scored = matching.match_titles(pairs).filter("title_score > 0").select("posting_id", "profile_id", "title_score").collect()
    want = []
    for i, _ in rows:
        own = sorted((-r.title_score, r.profile_id) for r in scored if r.posting_id == i)[:k]
        want += [(i, p, -s, n + 1) for n, (s, p) in enumerate(own)]
    got = [(r.posting_id, r.profile_id, r.title_score, r.place) for r in inverted.top_profiles(postings, owners, k).collect()]
    assert sorted(got) == sorted(want) and len(want) > 30


@pytest.mark.parametrize("seed", [1])
def test_places_equal_the_walk_over_the_list(spark, seed):
    rnd = random.Random(seed)
    owners = profiles(spark, rnd)
    rows = [(i, rnd.randrange(25), rnd.choice([*PLACES, "Dallas", "Greater New York City, United States", "Worth Fort Texas", "in Texas", "NY York New"])) for i in range(200)]
    postings = spark.createDataFrame(rows, "posting_id long, profile_id int, location string")
    walked = matching.match_location(matching.with_profile(postings, owners)).select("posting_id", "profile_id", "place_match", "place_match_reason")
    keyed = inverted.match_locations(postings, owners)
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    assert rows_of(keyed) == rows_of(walked)
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert keyed.filter("place_match_reason LIKE 'matched%'").count() > 20 and F
