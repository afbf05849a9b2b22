import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import audit, behaviour, keywords, lexical, quality, ranks, retrieval, sampling, statistics, vectors


# ------------------------------------------------------------------ packed values


USUAL = frozenset(c for c, (_, yes) in keywords.CANDIDATES.items() if yes)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a b;c d", ["a b", "c d"]), ("a, \"b, c\" | d", ["a", "b, c", "d"]), ('["x", "y, z", , "so \\"q\\" w"]', ["x", "y, z", 'so "q" w']), ("C/N ratio / no-till", ["C/N ratio", "no-till"]),
        ('a ; "so ""q"" w"', ["a", 'so "q" w']), ("- a\n- b", ["a", "b"]), ("• a\n• b", ["a", "b"]), ("a • b •", ["a", "b"]), ("growers' groups; L'eau verte", ["growers' groups", "L'eau verte"]),
        ("“a,b”；‘c’", ["a,b", "c"]), ("no. 7/2031|2,4-D", ["no. 7/2031", "2,4-D"]), ("a\xa0 b\tc", ["a b", "c"]), (";;a;;", ["a"]), ("", []), ("  ", []), ("(x); [y]", ["x", "y"]), ('"a;b', ['"a', "b"]),
    ],
)
def test_split(text, want):
    assert keywords.Splitter(USUAL)(text) == want


def test_split_values(spark):
    rows = [(i, ["soil", "rain"], "soil;rain", "a") for i in range(30)]
    rows += [(100, None, None, None), (101, [], "", "a"), (102, ["no-till", None, "x; y"], " ", "b"), (103, ["one"], "one", "b"), (104, ["z"], ";".join(["soil"] * 5000), "a"), (103, ["one"], "one", "b")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "rec_no long, keywords array<string>, keywords_llm string, ko_upload_source string, pos string")
    got = {}
    for r in keywords.split_values(df).collect():
        got.setdefault((r.rec_no, r.field_name), []).append((r.pos, r.keyword, r.packed))
    assert [k for _, k, _ in sorted(got[102, "keywords"])] == ["no-till", "x", "y"] and all(p for *_, p in got[102, "keywords"])
    assert (100, "keywords") not in got and (101, "keywords_llm") not in got and len(got[104, "keywords_llm"]) == 5000
    assert sorted(got[103, "keywords"]) == [(1, "one", False)] * 2
    found = keywords.split_values(df, only_packed=True)
    assert (103, "keywords") not in {(r.rec_no, r.field_name) for r in found.collect()}
    joined = keywords.split_values(df, most_sources=0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, keywords.split_values(df).collect()))
    seps = {(r.separator): r.accepted for r in keywords.infer_separators(df, "rec_no", ("keywords", "keywords_llm"), "ko_upload_source").where("s = 'b'").collect()}
    assert seps["-"] is False and seps[";"] is True
    assert keywords.split_values(df.limit(0)).collect() == []


# ------------------------------------------------------------------ quality


def brute_grams(text):
    import re

    words = re.findall(r"\w+", text.lower())
    out = []
    for n in (2, 3, 4):
        grams = Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        g, c = grams.most_common(1)[0] if grams else ("", 0)
        out.append(len(g) * c / len(text) if c > 1 else 0.0)
    for n in range(5, 11):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if counts[g] > 1:
                covered |= set(range(i, i + n))
        out.append(sum(len(words[i]) for i in covered) / len(text))
    return out


@pytest.mark.parametrize("text", ["a b c a b c a b", "one two three four five six one two three four five six seven", "x", "z z z z z z z z z z z z"])
def test_ngram_shares(text):
    assert lexical.ngram_shares(text) == pytest.approx(brute_grams(text))
    assert lexical.ngram_shares(None) == [0.0] * 9


def test_mtld():
    assert lexical.mtld(["a"] * 9) == 9.0
    assert lexical.mtld([f"w{i}" for i in range(50)]) == 50.0
    assert lexical.mtld(["a"] * 30) == pytest.approx(2.0)


def test_profile():
    n, v, ttr, bits, *_ = lexical.profile("a a b c".split())
    assert (n, v, ttr) == (4, 3, 0.75) and bits == pytest.approx(1.5)
    assert lexical.profile([])[:3] == (0, 0, None) and lexical.profile(["a"])[9] is None and lexical.profile(["a", "b"])[10] is None


def test_filters_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a\na\nb"), (4, "word " * 120_000), (3, "a\na\nb")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.filter_flags(df, "doc_id", "text").collect()}
    assert got[1].few_words and got[1].n_raised == got[2].n_raised and got[4].many_words
    assert got[3].dup_lines == pytest.approx(1 / 3) and got[3].dup_lines_high
    assert quality.filter_flags(df.limit(0), "doc_id", "text").collect() == []
    noise = {r.doc_id: r for r in quality.noise_tokens(spark.createDataFrame([(1, "a a <b> http://x ## ok ok."), (2, None)], "doc_id long, text string"), "doc_id", "text").collect()}
    assert (noise[1].repeats, noise[1].markup, noise[1].url, noise[1].symbols) == (2, 1, 1, 1) and noise[2].cleanness is None


# ------------------------------------------------------------------ retrieval


def test_bm25_against_brute_force(spark):
    docs = {1: "soil soil rain", 2: "rain", 3: "", 4: "sun rain soil crop crop", 5: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    posted = retrieval.postings(df, "doc_id", F.col("text"))
    queries = spark.createDataFrame([(7, "soil"), (7, "crop"), (7, "soil"), (8, "none")], "query long, term string")
    got = {(r["query"], r["doc"]): r["score"] for r in retrieval.bm25(posted, retrieval.corpus_size(df, posted), queries).collect()}
    tokens = {k: (v or "").split() for k, v in docs.items()}
    avg = sum(map(len, tokens.values())) / 5
    want = {}
    for d, ts in tokens.items():
        s = 0.0
        for t in ("soil", "crop"):
            n = sum(t in x for x in tokens.values())
            if t in ts:
                s += math.log1p((5 - n + 0.5) / (n + 0.5)) * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        if s:
            want[7, d] = s
    assert got == pytest.approx(want)
    asked = spark.createDataFrame([(3, "soil"), (3, "crop"), (1, "none"), (4, "crop"), (4, "soil")], "query long, term string")
    for block in (1, 100):
        ranks_ = {r["query"]: r["rank"] for r in retrieval.own_ranks(df, "doc_id", F.col("text"), posted, asked, block=block).collect()}
        assert ranks_ == {3: 1 + 2 + 2 / 2, 1: 5.0, 4: 1.0}
        found = {(r["query"], r["doc"]): (r["score"], r["rank"]) for r in retrieval.search(df, "doc_id", F.col("text"), posted, queries, 5, block=block).collect()}
        assert {k: v[0] for k, v in found.items()} == pytest.approx(want) and found[7, 4][1] == 1


def test_search_keeps_the_best_of_many_ties(spark):
    rows = [(i, "soil", "x") for i in range(3000)] + [(5000, "soil crop", "y"), (5001, None, "y"), (5002, "soil", "y")]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, source string, score double").repartition(5)
    posted = retrieval.postings(df, "doc_id", F.col("text"), "source")
    asked = spark.createDataFrame([(q, "soil") for q in range(6)], "query long, term string")
    got = retrieval.search(df, "doc_id", F.col("text"), posted, asked, 4, part="source").collect()
    for q in range(6):
        assert sorted((r["rank"], r["doc"]) for r in got if r["part"] == "x" and r["query"] == q) == [(1, 0), (2, 1), (3, 2), (4, 3)]
        assert sorted((r["rank"], r["doc"]) for r in got if r["part"] == "y" and r["query"] == q) == [(1, 5002), (2, 5000)]
    assert retrieval.search(df, "doc_id", F.col("text"), posted, asked.limit(0), 4).collect() == []


def test_graded_measures(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query long, doc long, rank int")
    grades = spark.createDataFrame([(1, 11, 3), (1, 12, 1), (1, 13, 2), (1, 10, 0), (2, 5, 1)], "query long, doc long, grade int")
    got = {r["query"]: r for r in retrieval.graded_measures(ranked, grades, 3).collect()}
    dcg, ideal = 7 / math.log2(3) + 1 / 2, 7 + 3 / math.log2(3) + 1 / 2
    assert got[1].mrr == 0.5 and got[1].recall == pytest.approx(2 / 3) and got[1].ndcg == pytest.approx(dcg / ideal) and got[1].ap == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert got[2].ndcg == 0.0 and got[2].mrr == 0.0


# ------------------------------------------------------------------ behaviour


def events(spark, rows):
    return spark.createDataFrame(rows, "event_no long, actor string, t long, query string, results long, page long, arm string, raw string, latency long")


def test_sittings_do_not_depend_on_buckets(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, rnd.choice("abc"), rnd.randint(0, 40_000) * 1_000_000, rnd.choice(["x y", "y z", "q"]), rnd.randint(0, 3), 1, None, "", 1) for i in range(600)]
    rows += [(1000, "edge", 0, "x", 1, 1, None, "", 1), (1001, "edge", 1800_000_000, "x", 1, 1, None, "", 1), (1002, "edge", 3600_000_001, "x", 1, 1, None, "", 1)]
    df = events(spark, rows)
    want = {}
    for a in "abc":
        last = start = None
        for t, i in sorted((r[2], r[0]) for r in rows if r[1] == a):
            if last is None or t - last > 1800_000_000:
                start = t
            want[i], last = start, t
    for bucket in (600, 3600, 10**6):
        got = {r.event_no: r.session_start for r in behaviour.sittings(df, 1800, bucket).collect()}
        assert {k: v for k, v in got.items() if k < 1000} == want
        assert [got[k] for k in (1000, 1001, 1002)] == [0, 0, 3600_000_001]


def test_outcomes(spark):
    s = 1_000_000
    rows = [(1, "a", 0, "soil rain", 5, 1), (2, "a", 60 * s, "soil rain", 5, 1), (3, "a", 100 * s, "soil sun", 5, 1), (4, "a", 150 * s, "cow", 5, 1), (5, "a", 1000 * s, "cow", 0, 1), (6, "a", 1500 * s, "cow", 3, 2)]
    got = {r.event_no: r.outcome for r in behaviour.outcomes(events(spark, [(*r, None, "", 1) for r in rows])).collect()}
    assert got == {1: "repeat", 2: "reformulated", 3: "switched", 4: "settled", 5: "zero", 6: "page_2"}


def test_bootstrap_covers_the_rate(spark):
    rows = [(i, f"u{i % 200}", i, "x", int(i % 4 > 0), 1, "a" if i % 200 < 100 else "b", "", 1) for i in range(2000)]
    lab = events(spark, rows).withColumn("outcome", F.when(F.col("results") == 0, "zero").otherwise("settled"))
    got = {r.arm: r for r in behaviour.cluster_bootstrap(lab, rounds=200).collect()}
    assert set(got) == {"a", "b"} and all(r.low <= r.rate <= r.high and r.rounds == 200 for r in got.values())


# ------------------------------------------------------------------ ranks and statistics


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_ranks(spark, partitions):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.x: (r.below, r.n, r.total) for r in ranks.cumulative(df, "x", partitions=partitions).collect()}
    assert got == {1.0: (0, 1, 5), 2.0: (1, 1, 5), 3.0: (2, 3, 5)}


def test_spearman(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 20, 200).astype(float), rng.integers(0, 20, 200).astype(float)

    def avg(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    row = ranks.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "x", "y").first()
    assert row.rho == pytest.approx(np.corrcoef(avg(x), avg(y))[0, 1])


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (None, 1)], "a int, b int")
    assert statistics.cohens_kappa(df, "a", "b").first().kappa == pytest.approx(0.5)
    assert statistics.cohens_kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first().kappa == 1.0
    votes = spark.createDataFrame([(1, 2), (1, 1), (2, 3), (2, 3)], "i int, v int")
    got = {r.i: (r.grade, r.status) for r in statistics.panel_grades(votes, ["i"], "v").collect()}
    assert got == {1: (1, "split"), 2: (3, "unanimous")}


def test_auc(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "s double, g int")
    assert statistics.area_under_curve(df, "s", "g").first().auc == pytest.approx(3.5 / 4)
    assert statistics.area_under_curve(df.where("g = 1"), "s", "g").first().auc is None


def test_calibration_bins_fold_the_tail(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(25)], "s double, g int")
    got = sorted((r.bin, r.n) for r in statistics.calibration_bins(df, "s", "g", 3, 8).collect())
    assert got == [(0, 8), (1, 8), (2, 9)]


# ------------------------------------------------------------------ samples, audit, vectors


def test_quotas_and_samples(spark):
    df = spark.createDataFrame([(i, "a" if i < 70 else "b" if i < 95 else "c") for i in range(100)], "k long, s string")
    q = {r.s: r.quota for r in sampling.quotas(df, ["s"], 10).collect()}
    assert sum(q.values()) == 10 and q["a"] == 7
    assert {r.s: r.quota for r in sampling.quotas(df, ["s"], 1000).collect()} == {"a": 70, "b": 25, "c": 5}
    one = sorted(r.k for r in sampling.stratified(df, ["s"], "k", 10).collect())
    assert one == sorted(r.k for r in sampling.stratified(df.repartition(7), ["s"], "k", 10).collect()) and len(one) == 10
    turns = [r.s for r in sampling.round_robin(df, ["s"], "k", 6).orderBy("turn").collect()]
    assert turns == ["a", "b", "c"] * 2
    assert spark.range(1).select(sampling.detection_size(0.95, 0.01)).first()[0] == 299


def test_audit(spark):
    df = spark.createDataFrame([(1, "x", ["a", "b"]), (2, " ", ["a", None]), (3, None, None)], "k long, t string, xs array<string>")
    got = {r.field: r for r in audit.field_audit(df, "k", ["t", "xs"]).collect()}
    assert got["t"].coverage == pytest.approx(1 / 3) and got["xs"].n_values == 3 and got["xs"].distinct == 2
    new = audit.upsert(spark.createDataFrame([(1, "a", "z"), (2, "b", "z")], "k int, v string, o string"), spark.createDataFrame([(2, "c", 5), (3, None, 6)], "k int, v string, n int"), "k")
    assert sorted(map(tuple, new.collect())) == [(1, "a", "z", None), (2, "c", "z", 5), (3, None, None, 6)]
    deep = spark.createDataFrame([((1, [(2, 3)]),)], "r struct<a:int,xs:array<struct<a:int,b:int>>>")
    assert audit.drop_deep(deep, {"a"}).first().asDict(True) == {"r": {"xs": [{"b": 3}]}}
    assert audit.flatten(deep).columns == ["r.a", "r.xs"]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "id long, v array<double>").repartition(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for bytes_ in (100, 10**8):
        got = {}
        for r in vectors.nearest(df, "id", "v", every=40, k=5, most_bytes=bytes_).collect():
            got.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
        for q in (0, 40, 80):
            order = [i for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q][:5]
            assert [n for _, n in sorted(got[q])] == order
    assert vectors.nearest(df.limit(0), "id", "v").collect() == []


def test_rank_of_own_vector(spark):
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(60, 6)), rng.normal(size=(60, 6))
    x[1] = x[0]
    df = spark.createDataFrame([(i, x[i].tolist(), q[i].tolist()) for i in range(60)], "id long, v array<double>, q array<double>").repartition(4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for bytes_ in (100, 10**8):
        got = {r["id"]: r["rank"] for r in vectors.rank_of_own(df, "id", "q", "v", every=20, most_bytes=bytes_).collect()}
        for i in (0, 20, 40):
            s = np.round(unit @ (q[i] / np.linalg.norm(q[i])), 9)
            assert got[i] == 1 + (s > s[i]).sum() + ((s == s[i]).sum() - 1) / 2


def test_coherence_equals_all_pairs(spark):
    x = np.random.default_rng(1).normal(size=(20, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.mean([u[i] @ u[j] for i in range(20) for j in range(20) if i != j])
    df = spark.createDataFrame([(1, v.tolist()) for v in x], "g int, v array<double>")
    assert vectors.coherence(df, "v", "g").first().mean_pair_cosine == pytest.approx(want)
