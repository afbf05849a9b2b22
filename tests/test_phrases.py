import math

from granary.operators import ablation


def test_word_order_counts_and_stop_words_do_not(spark):
    """Texts of the same words in another order share no phrase; single words alone would give 1."""
    rows = [(1, "Soil water balance", "balance water soil"), (2, "the soil of water", "soil water"), (3, "the of and", "soil"), (4, None, "soil"), (5, "a b", "a b")]
    df = spark.createDataFrame(rows, "k long, x string, y string")
    got = {r.k: r.cosine for r in ablation.tfidf_phrase_pairs(df, "k", "x", "y").collect()}
    idf = lambda n: math.log(11 / (1 + n)) + 1
    same = idf(4) ** 2 + idf(6) ** 2  # water in 4 texts, soil in 6
    balance, once, soil_water = idf(2) ** 2, idf(1) ** 2, idf(3) ** 2
    words = same + balance
    assert abs(got[1] - words / math.sqrt((words + soil_water + once) * (words + 2 * once))) < 1e-9
    assert abs(got[2] - 1) < 1e-9 and got[3] is None and got[4] is None and got[5] is None


def test_postings_of_phrases_are_not_broadcast(spark, tmp_path):
    """Few bytes on disk hold many postings: the plan must not take them for a small side. Counts hold whatever the batches are."""
    texts = [(i, f"soil water {i % 7} balance", f"water soil balance field{i % 11} soil") for i in range(300)]
    spark.createDataFrame(texts, "k long, x string, y string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = ablation.tfidf_phrase_pairs(df, "k", "x", "y")
    assert "BroadcastHashJoin [term" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.k: r.cosine for r in got.collect()}
    other = {r.k: r.cosine for r in ablation.tfidf_phrase_pairs(df.repartition(7), "k", "x", "y").collect()}
    assert len(rows) == 300 and all(abs(rows[k] - other[k]) < 1e-9 for k in rows)


def test_postings_of_words_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(i, f"soil water {i % 7}", f"water soil {i % 11}") for i in range(300)], "k long, x string, y string").write.parquet(f"{tmp_path}/t")
    got = ablation.tfidf_pairs(spark.read.parquet(f"{tmp_path}/t"), "k", "x", "y")
    assert "BroadcastHashJoin [term" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 300
