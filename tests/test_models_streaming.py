import json
import time

import numpy as np
import pandas as pd
import pytest

from granary.operators import anchors, learning, providers, scoring, summaries
from granary.streaming import sessions


def test_rouge_and_friends():
    recall, precision, f1 = summaries.overlap("a b c d".split(), "a b x".split(), 1)
    assert (recall, precision) == (0.5, pytest.approx(2 / 3)) and f1 == pytest.approx(4 / 7)
    assert summaries.overlap([], ["a"], 1) == (0.0, 0.0, 0.0)
    assert summaries.top_words("soil rain soil cows cows the".split(), 2) == ["soil", "cows"]
    m = dict(zip(summaries.MEASURES, summaries.measure("", "")))
    assert m["score"] == 0.0 and m["compression"] == 0.0
    assert dict(zip(summaries.MEASURES, summaries.measure("in 1990 rain", "in 1991 rain")))["foreign_numbers"] == 1.0


def test_combine_skips_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", None), (3, "a", 0.5), (3, "b", 1.0)], "k int, p string, v double")
    got = {r.k: (r.n_parts, r.score) for r in scoring.combine(df, ["k"], "p", "v", {"a": 1.0, "b": 3.0}).collect()}
    assert got == {1: (1, 1.0), 2: (0, None), 3: (2, pytest.approx(3.5 / 4))}
    v = spark.createDataFrame([(1, "x", 0.9, 0.2), (1, "y", 0.8, 0.9), (2, "x", 0.5, None), (2, "y", 0.5, None), (3, "x", 0.1, 1.0)], "k int, v string, s double, a double")
    assert {r.k: r.pick for r in scoring.recommend(v, ["k"], "v", "s", "a", 0.1).collect()} == {1: "y", 2: "x", 3: "x"}


def test_providers_ask_once_and_resume(spark):
    class Shaky:
        name = "shaky"

        def answer(self, texts):
            if "bad" in texts:
                raise OSError("down")
            return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "k int, t string")
    first = providers.ask(df, "t", Shaky(), batch=1)
    got = {r.request: r.answer for r in first.collect()}
    assert got == {providers.request_key("shaky", "a"): "A", providers.request_key("shaky", "bad"): None}
    kept = spark.createDataFrame([(k, v) for k, v in got.items() if v], "request string, answer string")
    rows = {r.k: r.answer for r in providers.answers(df, "t", Shaky(), cache=kept, batch=1).collect()}
    assert rows == {1: "A", 2: "A", 3: None, 4: None}
    vector = json.loads(providers.HashEmbedder(8).answer(["soil rain"])[0])
    assert len(vector) == 8 and np.linalg.norm(vector) == pytest.approx(1)


@pytest.mark.parametrize(("text", "want"), [('x ```json\n{"a": "}"}\n```', '{"a": "}"}'), ("{broken {\"a\": 1}", '{"a": 1}'), ("none", None), (None, None), ('{"a": {"b": 2}} {"c": 3}', '{"a": {"b": 2}}')])
def test_first_object(text, want):
    assert providers.first_object(text) == want


def test_verdicts_and_premises(spark):
    v = spark.createDataFrame([(1, "absent", True), (1, "supported", True), (2, "absent", True), (2, None, False), (3, "contradicted", True)], "s int, v string, a boolean")
    assert {r.s: r.verdict for r in providers.verdicts(v, ["s"], "v", "a").collect()} == {1: "supported", 2: "unknown", 3: "contradicted"}
    p = spark.createDataFrame([(1, 1, 0.9, 0.0), (1, 1, 0.2, 0.7), (1, 2, 0.1, 0.5)], "k int, h int, e double, c double")
    assert providers.best_premise(p, ["k"], "h", "e", "c").first().score == pytest.approx((0.9 - 0.4) / 2)


def test_anchor_texts(spark):
    rows = [("u", "prefLabel", "soil", "en"), ("u", "prefLabel", "Boden", "de"), ("u", "altLabel", "earth", "en"), ("u", "altLabel", "ground", "en"), ("u", "broader", "p", None), ("p", "prefLabel", "natural resources", "en"), ("q", "prefLabel", "x", "fr")]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string, lang string")
    got = {r.uri: r.anchor_text for r in anchors.anchor_texts(df).collect()}
    assert got == {"u": "soil. earth, ground. natural resources"}


def test_learning(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 120)
    x = rng.normal(size=(120, 3)) + y[:, None] * 3
    df = spark.createDataFrame([(i, v.tolist(), int(c), float(v[0]), float(v[1]), 1.0 + 3 * int(c), f"g{i % 6}") for i, (v, c) in enumerate(zip(x, y))], "k long, v array<double>, y int, a double, b double, grade double, g string")
    scored = learning.gate_probabilities(df, "k", "v", "y", folds=3).persist()
    assert scored.count() == 120 and learning.gate_auc(scored).first().auc > 0.95
    assert sum(r.n for r in learning.gate_report(scored).collect()) == 120
    assert 0 <= learning.expected_calibration_error(scored, "p", "label").first().ece < 0.3
    m = learning.regression_measures(learning.cross_validated(df, "k", "g", ["a", "b"], "grade", folds=3), "grade").first()
    assert m.n == 120 and m.mae < 1.0 and m.spearman > 0.5


def run(query, seconds=60):
    end = time.time() + seconds
    query.processAllAvailable()
    while query.isActive and time.time() < end and query.lastProgress is None:
        time.sleep(0.2)
    query.stop()


SCHEMA = "event_no long, actor string, time timestamp, query string, results long, page long"


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        pdf = pd.DataFrame(rows, columns=["event_no", "actor", "time", "query", "results", "page"])
        pdf["time"] = pd.to_datetime("2024-01-01") + pd.to_timedelta(pdf["time"], unit="s")
        spark.createDataFrame(pdf, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_session_stream(spark, tmp_path):
    batches = [[(1, "a", 0, "x", 1, 1), (1, "a", 0, "x", 1, 1), (2, "a", 600, "y", 1, 1)], [(3, "a", 1200, "z", 1, 1), (4, "b", 5000, "q", 1, 1)], [(5, "c", 50_000, "q", 1, 1)], [(6, "c", 90_000, "q", 1, 1)]]
    stream = sessions.session_stream(feed(spark, str(tmp_path / "in"), batches))
    run(stream.writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start())
    got = {(r.actor, r.n_events) for r in spark.table("sess").collect()}
    assert ("a", 3) in got and ("b", 1) in got


def test_outcome_stream(spark, tmp_path):
    batches = [[(1, "a", 0, "soil rain", 5, 1), (2, "a", 60, "soil rain", 5, 1), (3, "a", 100, "soil sun", 5, 1)], [(4, "a", 150, "cow", 5, 2)], [(5, "b", 90_000, "x", 0, 1)], [(6, "b", 180_000, "x", 1, 1)], [(7, "b", 270_000, "x", 1, 1)]]
    stream = sessions.outcome_stream(feed(spark, str(tmp_path / "in"), batches))
    run(stream.writeStream.format("memory").queryName("outc").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start())
    got = {r.event_no: r.outcome for r in spark.table("outc").collect()}
    assert {k: got.get(k) for k in (1, 2, 3, 4, 5)} == {1: "repeat", 2: "reformulated", 3: "switched", 4: "page_2", 5: "zero"}


