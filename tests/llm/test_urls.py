from rolesift.llm import urls

ROWS = [
    ("http://a.net/x", "net/", "block"), ("http://net", None, None), ("http://NET/", "net/", "block"), ("https://www.example.net/en/1?q=2#f", "example.net/en/", "allow"),
    ("https://example.net/english", "net/", "block"), ("http://m.example.com/de/9", "example.com/de/", "block"), ("http://badexample.com/de/9", None, None),
    ("ftp://x.org/fr/", "org/fr/", "allow"), ("http://x.org/fr", None, None), (None, None, None), ("", None, None), ("no scheme.net/", None, None),
    ("a://b.org?c://d.net/", None, None), ("http://x.net\n/y", None, None), ("http://" + "a" * 50_000 + ".org/fr/" + "b" * 50_000, "org/fr/", "allow"), ("x://://net/", None, None),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[at:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), path[:end]


def test_parts_and_rules(spark):
    rows = [(k, u, "x", 1.0) for k, (u, *_) in enumerate(ROWS)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows + rows[:1], "page_id long, url string, host string, score double")).collect()}
    for k, (u, rule, verdict) in enumerate(ROWS):
        assert (got[k].host, got[k].path) == parts(u), k
        assert got[k].rule == rule and got[k].verdict in ([verdict] if verdict else ["allow", "block"]), k


def test_trees_learn_from_labelled_urls(spark):
    good = [(k, f"https://site{k % 40}.example.org/en/page-{k}") for k in range(300)]
    bad = [(1000 + k, f"http://x-{k}-win-{k * 7919 % 100003}.example.org/?a={k}&b=1&c=2") for k in range(300)]
    rows = urls.parts(spark.createDataFrame(good + bad, "page_id long, url string"))
    labelled = rows.withColumn("label", (rows.page_id >= 1000).cast("int")).where("page_id % 2 = 0")
    got = urls.judge(rows.select("page_id", "url").where("page_id % 2 = 1"), labelled, rules=[], n_trees=3).collect()
    assert all((r.verdict == "block") == (r.page_id >= 1000) for r in got)


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_learns_from_all_labelled_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(urls.trees, "fit", lambda rows, *_: seen.append(rows.count()))
    rows = spark.range(25_000).selectExpr("id AS page_id", "concat('https://h', id, '.example.org/', id) AS url")
    _, suffixes, _ = urls.train(urls.parts(rows).selectExpr("*", "CAST(page_id % 2 AS INT) AS label"))
    assert seen == [25_000]
    assert suffixes.where("labels = 1").agg({"n": "sum"}).first()[0] == 25_000
