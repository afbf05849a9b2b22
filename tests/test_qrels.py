from collections import Counter

from granary.operators import retrieval
from granary.plans import registry


def brute(rows, every, least=2, share=0.25):
    strong = {d: {f"p={p.strip()}"} if p and p.strip() else set() for d, p, _ in rows}
    weak = {d: {x.strip().lower() for x in w or [] if x and x.strip()} for d, _, w in rows}
    often = Counter(x for w in weak.values() for x in w)
    weak = {d: {x for x in w if often[x] <= max(1, int(share * len(rows)))} for d, w in weak.items()}
    out = {}
    for q in (d for d in strong if d % every == 0):
        for d in strong:
            grade = 3 if q == d else 2 if strong[q] & strong[d] else 1 if len(weak[q] & weak[d]) >= least else 0
            if grade:
                out[q, d] = grade
    return out


def test_every_related_document_is_graded(spark):
    """Also the hundreds of a hot project, which no pool of the best 20 holds."""
    rows = [(i, " hot " if i % 3 == 0 else f"p{i % 40}" if i % 5 else None, [f" T{i % 7}", f"t{i % 11}", f"u{i % 13}", "ALL"] if i % 4 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, p string, w array<string>")
    asked = df.where("id % 50 = 0").select(df["id"].alias("query"))
    want = brute(rows, 50)
    for lane_docs in (2000, 16):
        got = retrieval.related_grades(df, "id", ["p"], ["w"], asked, lane_docs=lane_docs).collect()
        assert len(got) == len(want) and {(r["query"], r["doc"]): r["grade"] for r in got} == want
    assert sum(q == 0 for q, _ in want) >= 200
    assert retrieval.related_grades(df.limit(0), "id", ["p"], ["w"], asked.limit(0)).collect() == []


def test_query_is_registered():
    assert "graded_qrels" in registry.queries() and "graded_qrels" in registry.oracles()


def test_best_export_of_a_record_without_all_pairs(spark, tmp_path, monkeypatch):
    """ndcg_judgments keeps k records a task: it scores no pairs in a join, and still equals its SQL where records have many exports or no id."""
    import random

    import duckdb

    draw = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    ko = [(i, None if i % 17 == 0 else f"r{i % (7 if i % 3 else 40):02}", " ".join(draw.choices(words, k=4)), draw.choice([None, "w1 w2", "x"])) for i in range(900)]
    judged = [(i, " ".join(draw.sample(words, 2)), {f"r{draw.randrange(40):02}": draw.randrange(4) for _ in range(4)}) for i in range(30)] + [(30, "", {"r01": 2}), (31, "w1", {})]
    spark.createDataFrame(ko, "rec_no long, _orig_id string, title string, description string").repartition(5).write.parquet(f"{tmp_path}/knowledge_objects.parquet")
    spark.createDataFrame(judged, "query_no long, query string, relevant map<string,long>").write.parquet(f"{tmp_path}/judgments.parquet")

    def never(*_, **__):
        raise AssertionError("all pairs are scored")

    monkeypatch.setattr(retrieval, "bm25", never)
    df = registry.queries()["ndcg_judgments"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("knowledge_objects", "judgments"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracles()['ndcg_judgments']})").fetchall()
    got = [tuple(float(x) for x in r) for r in df.collect()]
    assert len(got) > 25 and sorted(got) == sorted(tuple(float(x) for x in r) for r in want)
