import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import chunks, repetition

LIMITS = {"a": (60, 12), "b": (30, 0)}
LONG_LAP = {"c": (40, 33)}


def test_split_texts_round_trip(spark):
    rnd = random.Random(4)
    texts = [None, "", "x", "y" * 61, "y" * 500, "Short. " * 40, "para one.\n\n" + "word " * 30 + "\n\nlast", "😀" * 130, "a\n" * 90]
    texts += ["".join(rnd.choice("ab .\n,;😀") for _ in range(rnd.randint(0, 300))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, t, t, "x") for i, t in enumerate(texts)], "rec_no long, a string, b string, c string, piece string")
    rows = chunks.split_texts(df, LIMITS | LONG_LAP).collect()
    for field, (most, lap) in (LIMITS | LONG_LAP).items():
        for i, t in enumerate(texts):
            mine = sorted((r.piece_no, r.piece) for r in rows if r.rec_no == i and r.field_name == field)
            if t is None:
                assert not mine
                continue
            pieces = [p for _, p in mine]
            assert [n for n, _ in mine] == list(range(1, len(pieces) + 1))
            assert all(len(p) <= most for p in pieces)
            assert (len(pieces) > 1) == (len(t) > most)
            whole = pieces[0]
            for a, b in zip(pieces, pieces[1:]):
                assert b[:lap] == a[len(a) - lap :]
                whole += b[lap:]
            assert whole == t


def test_cuts_at_the_strongest_boundary(spark):
    df = spark.createDataFrame([(1, "One two three four. Five six seven.\n\nEight nine ten eleven twelve thirteen fourteen.")], "rec_no long, a string")
    got = [r.piece for r in chunks.split_texts(df, {"a": (60, 0)}).orderBy("piece_no").collect()]
    assert got[0].endswith("\n\n")
    with pytest.raises(ValueError):
        chunks.piece_pattern(10, 10)


def test_oversized(spark):
    df = spark.createDataFrame([(1, "x" * 60, None), (2, "x" * 61, "y" * 31), (2, "x" * 61, None), (3, "😀" * 60, "")], "rec_no long, a string, b string")
    got = sorted((r.rec_no, r.field_name) for r in chunks.oversized(df, LIMITS).collect())
    assert got == [(2, "a"), (2, "a"), (2, "b")]
    assert chunks.oversized(df.limit(0), LIMITS).collect() == []


def brute_share(text, run=8):
    import re

    words = re.findall(r"[^\W_]+", text.lower())
    grams = [tuple(words[i : i + run]) for i in range(len(words) - run + 1)]
    covered = {j for i, g in enumerate(grams) if g in grams[:i] for j in range(i, i + run)}
    return len(covered) / len(words) if words else 0.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=60))
def test_share_equals_brute_force(words):
    assert repetition.repeated_share(" ".join(words))[0] == pytest.approx(brute_share(" ".join(words)))


def test_repetitive(spark):
    once = " ".join(f"w{i}" for i in range(40))
    rows = [(1, once, "EN ", "S"), (2, f"{once} {once}", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, f"{once}. {once}", "en", "s"), (6, "a " * 30000, "fr", "t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, share int")
    got = {r.doc_id: r for r in repetition.repetitive(df).collect()}
    assert set(got) == {2, 5, 6} and got[2].share == pytest.approx(0.5) and got[6].share > 0.99
    assert all(r.threshold > 0 for r in got.values())
    limits = repetition.group_thresholds(repetition.measure(df)).collect()
    assert {(r.lang, r.source) for r in limits} == {("en", "s"), ("", ""), ("fr", "t")}
    assert repetition.repetitive(df.limit(0)).collect() == []
    shares = spark.createDataFrame([(i, "en", "s", 100, i / 100) for i in range(1, 101)], "doc_id long, lang string, source string, n_words int, share double")
    assert repetition.group_thresholds(shares).first().threshold == 0.9
    small = repetition.with_thresholds(shares, repetition.group_thresholds(shares))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, repetition.with_thresholds(shares, repetition.group_thresholds(shares), most_bytes=0).select(small.columns).collect()))


def test_documents_that_always_count(spark):
    once = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, f"{once} {once} {'x%d ' % i * (i + 1)}", "en", "s") for i in range(20)], "doc_id long, text string, lang string, source string")
    found, all_of_them = repetition.repetitive(df), repetition.repetitive(df, always=0.4)
    assert 0 < found.count() < 20 and all_of_them.count() == repetition.measure(df).where("share >= 0.4").count()
