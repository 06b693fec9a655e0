"""Endpoint selection against a greedy pass over sorted rows."""

import random

from rolesift.operators.ranking import select_endpoints, vendor_quotas

VENDORS = ["workday", "icims", "sap successfactors", "taleo / oracle recruiting", "greenhouse", "lever", "unknown"]
SCHEMA = "profile_id int, endpoint_id long, company_name string, endpoint_url string, vendor string, score int, seedable boolean, supported boolean, shape_priority int, vendor_priority int, preferred boolean, senior_tech boolean"


def endpoints(seed, preferred_share, senior):
    rnd = random.Random(seed)
    rows = []
    for i in range(120):
        vendor = rnd.choice(VENDORS)
        seedable = vendor != "unknown" and rnd.random() < 0.8
        # One URL belongs to one vendor and, as a pool is kept per URL, one class.
        url = f"https://{vendor[:4]}.com/{rnd.randrange(40)}-{int(seedable)}"
        preferred = seedable and hash_share(url) < preferred_share
        rows.append((0, i, f"c{rnd.randrange(30)}", url, vendor, rnd.randrange(100), seedable, vendor != "unknown", rnd.randrange(4), 0, preferred, senior))
    return rows


def hash_share(url):
    return random.Random(url).random()


def greedy(rows, cap):
    """Passes over rows in rank order, one row at a time."""
    key = lambda r: (-r[6], -r[8], -r[9], -r[7], -r[5], r[2], r[3], r[1])
    rows = sorted(rows, key=key)
    pool = {r[3] for r in rows if r[10]}
    senior = rows[0][11]
    picked, urls = [], set()

    def quotas(limit, allowed):
        taken = []
        for vendor, quota in vendor_quotas(limit):
            n = 0
            for r in rows:
                if n >= quota or len(taken) >= limit:
                    break
                if r[4] == vendor and r[6] and r[3] not in urls and allowed(r):
                    urls.add(r[3])
                    taken.append(r)
                    n += 1
        return taken

    if senior:
        picked = quotas(cap, lambda r: not pool or r[3] in pool)
    else:
        picked = [r for r in rows if not pool or r[3] in pool][:cap]
        urls.update(r[3] for r in picked)
    left = cap - len(picked)
    if left > 0 and (pool or not senior):
        picked += quotas(left, lambda r: True)
    for want_seedable in (True, False):
        for r in rows:
            if len(picked) < cap and r[3] not in urls and (r[6] or not want_seedable):
                urls.add(r[3])
                picked.append(r)
    return [r[1] for r in picked]


def test_selection_matches_greedy_passes(spark):
    for seed, share, senior, cap in [(1, 0.3, True, 12), (2, 0.05, True, 12), (3, 0.0, True, 25), (4, 0.1, False, 12), (5, 0.0, False, 12), (6, 0.02, False, 25)]:
        rows = endpoints(seed, share, senior)
        df = spark.createDataFrame(rows, SCHEMA).repartition(6)
        got = [r.endpoint_id for r in select_endpoints(df, cap).orderBy("position").collect()]
        assert got == greedy(rows, cap), (seed, share, senior)
