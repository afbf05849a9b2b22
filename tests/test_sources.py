import gzip
import json

import pytest

from granary.sources import readers, writers


def test_shapes_of_exports(spark, tmp_path):
    docs = [{"id": "a", "n": 1}, {"id": "b", "n": 2}]
    files = {"array.json": json.dumps(docs), "wrapped.json": json.dumps({"meta": {"x": 1}, "docs": docs}), "one.json": json.dumps(docs[0]), "lines.jsonl": "\n".join(map(json.dumps, docs)) + "\nnot json\n"}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    with gzip.open(tmp_path / "z.ndjson.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, docs)))
    count = lambda n: readers.read_records(spark, str(tmp_path / n)).count()
    assert [count(n) for n in ("array.json", "wrapped.json", "one.json", "z.ndjson.gz")] == [2, 2, 1, 2]
    assert readers.read_records(spark, str(tmp_path / "lines.jsonl"), "id STRING, n INT").where("id IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.read_records(spark, str(tmp_path / "lines.jsonl"), "id STRING, n INT", strict=True).collect()
    wanted = spark.createDataFrame([("b",)], "id string")
    assert readers.read_wanted(spark, str(tmp_path / "lines.jsonl"), "id", wanted).count() == 1
    assert readers.newest(spark, str(tmp_path)).rsplit("/", 1)[1] in {*files, "z.ndjson.gz"} and readers.newest(spark, str(tmp_path / "none")) is None


def test_tables_and_caches(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", ["x", "y"]), (2, None, [])], "k int, t string, xs array<string>")
    writers.write_delimited(df, str(tmp_path / "t"))
    back = readers.read_delimited(spark, str(tmp_path / "t"), numbers=["k"], required=["t"]).orderBy("k").collect()
    assert back[0].t == "a\tb" and back[0].xs == "x | y" and back[1].k == 2.0
    with pytest.raises(ValueError, match="nope"):
        readers.read_delimited(spark, str(tmp_path / "t"), required=["nope"])
    print_ = writers.fingerprint(df, "k", "t")
    assert print_ == writers.fingerprint(df.repartition(5), "k", "t") != writers.fingerprint(df.limit(1), "k", "t")
    made = []
    for _ in range(2):
        assert writers.cached(spark, str(tmp_path / "c"), "x", print_, lambda: made.append(1) or df).count() == 2
    assert made == [1]
    assert [r.k for r in writers.pending(df, df.where("k = 1"), "k").collect()] == [2]


def test_judgments_and_vocabulary(spark, tmp_path):
    (tmp_path / "j.json").write_text(json.dumps([{"query": "a", "relevant": {"x": 3, "y": 0}}, {"query": " ", "relevant": {"x": 1}}]))
    assert {(r["query"], r["doc"], r["grade"]) for r in readers.read_judgments(spark, str(tmp_path / "j.json")).collect()} == {("a", "x", 3), ("a", "y", 0)}
    (tmp_path / "data_model.topics.json").write_text(json.dumps([{"name": "Soil", "parent_category": ["A"]}, {"label": "Rain"}, {"name": " "}]))
    assert {(r.field_name, r.term) for r in readers.read_vocabulary(spark, str(tmp_path / "data_model.*.json")).collect()} == {("topics", "Soil"), ("topics", "Rain")}
    lists = readers.string_lists(spark.createDataFrame([("a; b,,c", ["x", " "])], "s string, l array<string>"), "s", "l").first()
    assert lists.s == ["a", "b", "c"] and lists.l == ["x"]
