import pytest
from pyspark.sql import functions as F

from granary.operators import behaviour, fields, ranks, statistics

SCHEMA = (
    "rec_no long, title string, subtitle string, description string, keywords array<string>, title_llm string, subtitle_llm string, description_llm string, keywords_llm string, "
    "project_id string, ko_object_name string, text string, variant string"
)
ABOUT = "The farm keeps its soil covered through the winter. Common Agricultural Policy (CAP) money pays for the seed."
ROWS = [
    (1, "Cover crops on farms", "Seed mixtures", ABOUT, ["soil", "cover crop"], None, "", None, "soil; seed", "A", "x/cover.pdf", "soil cover crops winter seed farm " * 20 + "Common Agricultural Policy", "v"),
    (2, "WINTER WHEAT", "winter wheat", "cut in\nthe middle ...", ["a;b", "A"], None, None, None, None, "B", "winter_wheat.pdf", None, "v"),
    (3, "Deliverable 3.1", "Shared words", None, [], None, None, None, None, "C", None, "", "v"),
    (4, "deliverable_x.pdf", "shared  words", " ", None, None, None, None, None, "D", "", "soil", "v"),
]


@pytest.fixture(scope="module")
def scores(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return {(r["key"], r["variant"], r["field"]): r for r in fields.field_scores(df, "rec_no", "text").collect()}


def test_sub_scores(scores):
    assert len(scores) == 4 * 2 * 4
    of = lambda k, f, s: scores[k, "original", f][s]
    assert of(1, "title", "completeness") == 1 and of(1, "title", "formatting") == 1 and of(1, "description", "length") == 1 and of(1, "description", "clarity") == 1
    assert of(2, "title", "completeness") == pytest.approx(4 / 5) and of(2, "title", "formatting") == pytest.approx(4 / 5)  # a copy; capitals
    assert of(2, "description", "formatting") < 1 and of(2, "description", "clarity") == 0.5 and of(2, "keywords", "formatting") == pytest.approx(2 / 5)
    assert of(3, "title", "completeness") == pytest.approx(3 / 4) and of(3, "subtitle", "completeness") == pytest.approx(2 / 3) == of(4, "subtitle", "completeness")
    assert of(4, "title", "completeness") == pytest.approx(3 / 4)
    assert of(1, "keywords", "consistency") == pytest.approx(2 / 3) and of(3, "title", "consistency") is None
    for s in fields.SUBSCORES:
        assert of(4, "description", s) == (0 if s == "completeness" else None) or s == "length"
    assert all(v is None or 0 <= v <= 1 for r in scores.values() for v in r.asDict().values() if isinstance(v, float))


def test_defects_and_verdicts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["key"], r["defect"]): r["outcome"] for r in fields.self_test(df, "rec_no", "text").collect()}
    assert {k for k, _ in got} == {"1", "2"}
    for defect in ("padded", "file name", "debris", "capitals", "cut off"):
        assert got["1", defect] == "dropped", defect
    assert got["2", "capitals"] == "unchanged"
    before = spark.createDataFrame([("a", "s", "f", 1.0), ("b", "s", "f", 0.0), ("c", "s", "f", None)], "key string, sub string, field string, value double")
    after = spark.createDataFrame([("a", "x", "s", "f", 1.0), ("b", "x", "s", "f", 0.0), ("c", "x", "s", "f", 0.5), ("b", "y", "s", "f", 0.1), ("a", "y", "s", "f", 0.9)], "key string, defect string, sub string, field string, value double")
    verdict = {(r["key"], r["defect"]): r["outcome"] for r in fields.verdicts(before, after).collect()}
    assert verdict == {("a", "x"): "unchanged", ("b", "x"): "unchanged_at_floor", ("c", "x"): "not_evaluable", ("b", "y"): "rose", ("a", "y"): "dropped"}
    assert fields.field_scores(df.limit(0), "rec_no", "text").collect() == []


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 3, 3)] + [("b", 7.0), ("b", None), ("c", None)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in ranks.quantiles(df, "v", ["g"], {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    assert got == {"a": (4, 2.5, 3.0, pytest.approx(4.4)), "b": (1, 7.0, 7.0, 7.0)}
    assert ranks.quantiles(df.limit(0), "v", ["g"], {"q": 0.5}).collect() == []


def test_summaries_of_columns(spark):
    df = spark.createDataFrame([(1.0, "x", True), (3.0, "y", False), (None, "x", None)], "v double, c string, f boolean")
    r = statistics.summary(df, ["v"]).first()
    assert (r["n"], r["missing"], r["mean"], r["q2"], r["max"]) == (2, 1, 2.0, 2.0, 3.0)
    assert {tuple(r) for r in statistics.categories(df, ["c", "v"], most=1).collect()} == {("c", 2, None, 3), ("v", 2, None, 2)}
    assert {tuple(r) for r in statistics.categories(df, ["c"]).collect()} == {("c", 2, "x", 2), ("c", 2, "y", 1)}
    assert tuple(statistics.flag_means(df, ["f"], "v").first()) == ("f", 2, 50.0, 1.0, 3.0)
    wins = spark.createDataFrame([(2, 1), (1, 1), (0, 5), (None, 1)], "a int, b int")
    assert tuple(statistics.paired_win_share(wins, "a", "b").first()) == (3, 0.5)
    moved = spark.createDataFrame([(0.0, 0), (1.0, 0), (3.0, 1), (4.0, 1)], "v double, n int")
    assert statistics.wasserstein(moved, "v", "n").first()[0] == pytest.approx(3.0)
    flat = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(5)], "a double, b double, c double")
    assert {(r["a"], r["b"]) for r in statistics.redundant_pairs(flat, ["a", "b", "c"]).collect()} == {("a", "b"), ("c", None)}


def test_ragged_panels_are_cut_to_width(spark):
    votes = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 1), (3, 1, 1)], "i int, rater int, v int")
    assert statistics.fleiss_kappa(votes, ["i"], "v", 2).first()["n_items"] == 1
    r = statistics.fleiss_kappa(votes, ["i"], "v", 2, order="rater").first()
    assert r["n_items"] == 2 and r["agreement"] == 1.0
    assert {tuple(x) for x in statistics.problem_raters(votes, ["i"], "rater", "v").collect()} == {(1, 2, 1.0, False), (2, 2, 1.0, False), (3, 1, 0.0, True)}


def test_searches_of_people(spark):
    rows = [("soil health", "Mozilla"), ("ab", "Mozilla"), ("12345", "Mozilla"), ("soil", "PostmanRuntime"), ("x" * 200, ""), ("boden", "")]
    df = spark.createDataFrame([(q, a, i * 86_400_000_000) for i, (q, a) in enumerate(rows)], "raw string, agent string, t long")
    assert [r["raw"] for r in behaviour.typed_by_people(df).collect()] == ["soil health", "boden"]
    assert behaviour.span_days(df).first()["days"] == 5.0 and F is not None


def test_self_test_equals_all_scores_of_all_defects_at_less_work(spark, tmp_path):
    """Each sub-score is made for the fields it is aimed at alone, as if all scores of all altered records were made."""
    texts = ["Soil water balance in fields", "SOIL report", "a b c.pdf", "Shared Title of projects", "Crop rotation and NPK (nitrogen) use ..."]
    rows = [
        (i, texts[i % 5], texts[i % 3] if i % 4 else None, f"About <p>soil {i % 6} and water</p> of CAP farms, {'so it ends' if i % 2 else 'end.'}", ["soil", f"water {i % 4}; crops"] if i % 7 else None, f"p{i % 3}" if i % 5 else None, "f/a b c.pdf", f"Soil water text {i % 6} with crops and CAP" if i % 6 else None)
        for i in range(24)
    ]
    spark.createDataFrame(rows, "rec_no long, title string, subtitle string, description string, keywords array<string>, project_id string, ko_object_name string, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = fields.self_test(df, "rec_no", "text")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 30
    plain = df.withColumn("rec_no", df["rec_no"].cast("string"))
    common = fields.long_fields(plain, "rec_no", {"original": ""}).where("text <> ''").selectExpr("explode(array_distinct(regexp_extract_all(lower(text), '[\\\\p{L}\\\\p{N}_]+', 0))) AS w")
    top = [r["w"] for r in common.groupBy("w").count().orderBy(F.desc("count"), "w").limit(20).collect()]
    bad = fields.defects(df, "rec_no", top).withColumn("own", F.col("rec_no").cast("string")).withColumn("rec_no", F.concat_ws("|", F.col("rec_no").cast("string"), "defect")).persist()
    long = lambda scores: scores.unpivot(["key", "variant", "field"], list(fields.SUBSCORES), "sub", "value").select("key", "sub", "field", "value")
    after = long(fields.field_scores(bad.drop("defect", "sub", "defect_field", "own"), "rec_no", "text", {"original": ""}, plain))
    aimed = bad.select(F.col("rec_no").alias("key"), "defect", "sub", F.col("defect_field").alias("field"), "own")
    after = after.join(aimed, ["key", "sub", "field"]).select(F.col("own").alias("key"), "defect", "sub", "field", "value")
    want = fields.verdicts(long(fields.field_scores(plain, "rec_no", "text", {"original": ""})), after)
    shown = lambda rows: sorted(((r["key"], r["defect"], r["sub"], r["field"], *(None if r[c] is None else round(r[c], 9) for c in ("before", "after")), r["outcome"]) for r in rows), key=repr)
    rows = got.collect()
    assert len({r["defect"] for r in rows}) == 12 and shown(rows) == shown(want.collect())
