"""Files in and out."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rolesift.sources import files, json_lists


def test_url_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n https://b.com \n\nhttps://a.com\n")
    assert [r.url for r in files.read_url_list(spark, str(tmp_path / "a.txt")).orderBy("pos").collect()] == ["https://b.com", "https://a.com"]


def test_contract(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"schema_version": "1.0", "records": [{"company_name": "A"}, {"company_name": "B", "odd": 1}]}))
    assert [(r.pos, r.company_name) for r in files.read_endpoint_contract(spark, str(path)).orderBy("pos").collect()] == [(0, "A"), (1, "B")]
    for bad in ({"records": []}, {"schema_version": "2.0", "records": []}, {"schema_version": "1.0", "records": None}):
        path.write_text(json.dumps(bad))
        with pytest.raises(Exception, match="schema_version|records list"):
            files.read_endpoint_contract(spark, str(path)).collect()


@pytest.mark.parametrize("size", [64, 200, 1 << 20])
def test_lists_are_read_by_byte_ranges(spark, tmp_path, size):
    rnd = random.Random(size)
    word = lambda: "".join(rnd.choice('ab"\\{}[],: é\n') for _ in range(rnd.randint(0, 30)))
    files_, want = {}, []
    for name in ("a", "b"):
        records = [{"company_name": word(), "notes": word(), "odd": {"deep": [word(), {"x": word()}]}, "confidence_score": rnd.random()} for _ in range(40)]
        records += [{"company_name": "long", "notes": word() * 60}]
        body = {"schema_version": "1.0", "meta": {"records": [word()], "x": {}}, "records": records, "after": {"y": ["}"]}}
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=rnd.choice([None, 1]), ensure_ascii=False))
        (tmp_path / f"{name}_cases.json").write_text(json.dumps([1, "}{", *[{"id": word(), "notes": word()} for _ in range(30)], [{"no": 1}]]) + "\n")
        want += records
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        paths = [str(tmp_path / f"{n}.json") for n in ("a", "b")]
        got = files.read_endpoint_contract(spark, paths).orderBy("pos").collect()
        assert [r.pos for r in got] == list(range(82))
        assert [(r.company_name, r.notes) for r in got] == [(r["company_name"], r["notes"]) for r in want]
        assert [float(r.confidence_score) for r in got if r.confidence_score] == [r["confidence_score"] for r in want if "confidence_score" in r]
        if size < 1000:
            assert json_lists._parts(spark, paths).rdd.getNumPartitions() > 20
        for path in [str(tmp_path / f"{n}_cases.json") for n in ("a", "b")]:
            cases = [c for c in json.loads(open(path).read()) if isinstance(c, dict)]
            rows = files.read_labelled_cases(spark, path).collect()
            assert sorted((r.id, r.notes) for r in rows) == sorted((c["id"], c["notes"]) for c in cases)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_labelled_cases(spark, tmp_path):
    lines = tmp_path / "c.jsonl"
    lines.write_text('# x\n{"id": "1", "expected_label": "yes"}\n\n[1]\n{"id": "2"}\n')
    assert [r.id for r in files.read_labelled_cases(spark, str(lines)).orderBy("id").collect()] == ["1", "2"]
    listed = tmp_path / "c.json"
    listed.write_text('[{"id": "3"}, {"id": "4"}]')
    assert sorted(r.id for r in files.read_labelled_cases(spark, str(listed)).collect()) == ["3", "4"]


def test_run_reports(spark, tmp_path):
    for name, n in (("r1", 2), ("r2", 1)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "summary.json").write_text(json.dumps({"label": name, "url_count": n, "drop_summary": {"s": {"blocked_domain": 3}}}))
        (folder / "effective_settings.json").write_text('{"target_titles": "VP"}')
        (folder / "urls.txt").write_text("".join(f"https://a.com/{i}\n" for i in range(n)) + "\n")
    rows, urls = files.read_run_reports(spark, str(tmp_path))
    assert {(r.report_id, r.url_count, r.target_titles) for r in rows.collect()} == {("r1", 2, "VP"), ("r2", 1, "VP")}
    assert urls.groupBy("report_id").count().filter("report_id = 'r1'").first()["count"] == 2


def test_ledger_and_details(spark, tmp_path):
    summary = spark.createDataFrame([(1, 5, "x")], "run_id int, total_seen int, source_name string")
    items = spark.createDataFrame([(1, "u", "inserted")], "run_id int, item_value string, status string")
    files.append_run_ledger(summary, items, str(tmp_path), ["source_name"])
    files.append_run_ledger(summary.withColumn("run_id", F.lit(2)), items.withColumn("run_id", F.lit(2)), str(tmp_path), ["source_name"])
    runs = spark.read.parquet(f"{tmp_path}/runs")
    extra = spark.createDataFrame([(1, "seconds", "3"), (1, "source_name", "y")], "run_id int, key string, value string")
    merged = {r.run_id: json.loads(r.details_json) for r in files.merge_run_details(runs, extra).collect()}
    assert merged == {1: {"source_name": "y", "seconds": "3"}, 2: {"source_name": "x"}}
    assert spark.read.parquet(f"{tmp_path}/run_items").count() == 2


def test_lists_and_reports_are_written(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "")], "n int, url string")
    files.write_ranked_list(df, "url", [F.desc("n")], str(tmp_path / "list"))
    parts = sorted((tmp_path / "list").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == ["b", "a"]
    files.write_report(df, ["url", "n"], str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["url", "n"]
    with pytest.raises(ValueError):
        files.write_report(df, ["url"], str(tmp_path / "x"), "xml")
