import math

import pytest
from pyspark.sql import functions as F

from granary.functions import languages
from granary.functions import text as T
from granary.operators import ablation, filters, inference, profiles, retrieval, sentences
from granary.sources import writers


def test_sentences_mind_abbreviations(spark):
    texts = ["Use approx. Ten kg, e.g. Rye. The farm (see p. 9) gains. Next one!", "", "no stop", None, " \n", "Ask (Dr. Ohm) now?  «Yes.» He did... Then 5 more."]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(sentences.split_sentences(F.col("t"))).collect()]
    assert got[0] == ["Use approx.", "Ten kg, e.g. Rye.", "The farm (see p. 9) gains.", "Next one!"]
    assert got[1:5] == [[], ["no stop"], [], []] and got[5] == ["Ask (Dr. Ohm) now?", "«Yes.»", "He did...", "Then 5 more."]


def test_pack_keeps_every_word(spark):
    parts = ["a b c.", "d e.", "f " * 11]
    df = spark.createDataFrame([(parts,), ([],)], "p array<string>")
    chunks, none = [r[0] for r in df.select(sentences.pack(F.transform("p", lambda x: F.trim(x)), 5)).collect()]
    assert " ".join(chunks).split() == " ".join(parts).split() and all(len(c.split()) <= 5 for c in chunks) and chunks[0] == "a b c. d e." and none == []


def test_acronyms():
    found, open_ = sentences.acronyms("Common Agricultural Policy (CAP), TERRA, Food and Agriculture Organization FAO, ABCDEFGHIJKLM, G20 B2")
    assert found == ["CAP", "TERRA", "FAO", "ABCDEFGHIJKLM"] and open_ == ["TERRA", "ABCDEFGHIJKLM"]
    assert sentences.explained("AB", ["a", *["of"] * 4, "b"]) and not sentences.explained("AB", ["a", *["of"] * 5, "b"]) and not sentences.explained("AB", ["a", "long", "b"])


def test_funnel(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 5), (3, "x", 1), (4, "x", None)], "k int, a string, n int")
    kept, steps = filters.funnel(df, {"a": F.col("a").isNotNull(), "n": F.col("n") > 2})
    assert [r.k for r in kept.collect()] == [1] and {r.step: r.n for r in steps.collect()} == {"kept": 1, "a": 1, "n": 2}


def test_inference(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 10) + 0.5) for i in range(300)], "k long, a double, b double")
    r = inference.mean_interval(df, "k", "a", rounds=300).first()
    assert r.n == 300 and r.low < 4.5 < r.high and r.high - r.low < 1.2
    assert inference.mean_interval(df.limit(3), "k", "a", rounds=50).first().low == inference.mean_interval(df.limit(3), "k", "a", rounds=50).first()["mean"]
    assert inference.paired_test(df, "k", "a", "b", rounds=200).first().p == pytest.approx(1 / 200)
    assert inference.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)
    assert inference.needed_size(100, 0.02, 0.02) == pytest.approx(100 * (1.959964 + 0.841621) ** 2, rel=1e-4)
    bins = spark.createDataFrame([(0, 0.0, 0.9), (1, 1.0, 0.3), (2, 2.0, 0.8), (3, 3.0, 0.95)], "b int, low double, p double")
    assert inference.lowest_lasting(bins, "b", "low", "p", 0.8).first().threshold == 2.0


def test_partial_spearman(spark):
    df = spark.createDataFrame([(float(i), float(i) + (i * 7 % 5), float(i * 3 % 11)) for i in range(60)], "x double, y double, z double")
    r = inference.partial_spearman(df, "x", "y", "z").first()
    assert r.n == 60 and 0.9 < r.rho <= 1 and abs(r.partial_rho) <= 1


def test_bundles(spark):
    df = spark.createDataFrame([(1, "soil", "x"), (2, "rain", "soil"), (3, "sun", "y")], "k long, t string, d string")
    q = spark.createDataFrame([(1, "soil"), (2, "soil")], "query long, term string")
    got = {r.bundle: r.mrr for r in ablation.bundle_mrr(df, "k", {"t": ["t"], "d": ["d"]}, q).collect()}
    assert got == {"t": 0.5, "d": 0.5}
    assert ablation.leave_one_out(["a", "b"]) == {"all": ["a", "b"], "without a": ["b"], "without b": ["a"]}
    cos = {r.k: r.cosine for r in ablation.tfidf_pairs(spark.createDataFrame([(1, "a b", "a b"), (2, "a", "c"), (3, None, "a")], "k long, x string, y string"), "k", "x", "y").collect()}
    assert cos[1] == pytest.approx(1) and cos[2] == 0 and cos[3] is None


def test_profiles(spark):
    df = spark.createDataFrame([(i, "x" if i else " ", ["a"] if i % 2 else [" "], float(i)) for i in range(40)], "k long, t string, xs array<string>, v double")
    got = {r.field: (r.coverage, r.expected) for r in profiles.expected_fields(df, "k", ["t", "xs"], 0.9).collect()}
    assert got == {"t": (39 / 40, True), "xs": (0.5, False)}
    assert profiles.missing_fields(df, "k", ["t", "xs"]).where("k = 0").first().missing == ["t", "xs"]
    ranges = profiles.metric_ranges(df, ["v"], 0.1, 0.9)
    assert {r.k for r in profiles.outside_ranges(df, "k", ["v"], ranges).where("size(unusual) > 0").collect()} == {0, 1, 2, 3, 36, 37, 38, 39}
    place = {r.v: r.place for r in profiles.place_in_reference(df.select("v"), "v", spark.createDataFrame([(0.0,), (10.0,), (10.0,), (39.0,)], "r double"), "r").collect()}
    assert place[0.0] == 0.0 and place[10.0] == pytest.approx(1.5 / 3) and place[39.0] == 1.0
    assert {r.defect for r in profiles.perturbed(df.where("k = 1"), "k", "t").collect()} >= {"markup", "empty", "doubled"}


def test_text_helpers(spark):
    one = lambda make, v, kind="string": spark.createDataFrame([(v,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y
    assert one(T.extracted, "Head\n12\nsoil​ vil-\nlage\nHead\n• a:b\n......9") == "Head\nsoil village\n- a: b"
    assert one(lambda x: T.clamped_list(x, 2, 3), ["Abcd", "abcd", " ", "e", "f"], "array<string>") == ["Abc", "e"]
    assert one(lambda x: T.evenly(x, 3), list("abcde"), "array<string>") == ["a", "c", "e"] and one(lambda x: T.evenly(x, 9), ["a"], "array<string>") == ["a"]
    assert one(languages.language_codes, ["nld, Polski", None, "de-AT", "?"], "array<string>") == ["de", "nl", "pl"] and one(languages.language_codes, None, "array<string>") == []


def test_wrapped(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string").coalesce(1)
    row = writers.wrapped(df, made="now").first()
    assert row.counts.docs == 2 and row.meta.made == "now" and {d.k for d in row.docs} == {1, 2}


def test_specificity(spark):
    assert spark.range(1).select(retrieval.specificity(F.lit(9), F.lit(9))).first()[0] == 0.0
    assert spark.range(1).select(retrieval.specificity(F.lit(0), F.lit(9))).first()[0] == pytest.approx(1.0)
    assert math.isclose(spark.range(1).select(inference.spearman_brown(F.lit(0.5), 2)).first()[0], 2 / 3)
