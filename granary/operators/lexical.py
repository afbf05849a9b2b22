"""Vocabulary and repetition measures of single documents.

Each document is folded once in an Arrow batch: its counts never leave the task, so no
token is shuffled however large the corpus is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from granary.functions.arrow import map_columns

_word_runs = re.compile(r"\w+").findall

PROFILE = (
    "n_tokens long, n_distinct long, ttr double, entropy_bits double, entropy_nats double, repeated_bigram_types double, hapax long, dis long, "
    "yules_k double, simpsons_d double, honore_r double, guiraud_r double, herdan_c double"
)


def mtld_one_way(tokens: list[str], threshold: float = 0.72) -> float:
    factors, types, n = 0.0, set(), 0
    for t in tokens:
        types.add(t)
        n += 1
        if len(types) / n <= threshold:
            factors += 1
            types, n = set(), 0
    if n:
        factors += (1 - len(types) / n) / (1 - threshold)
    return len(tokens) / factors if factors else float(len(tokens))


def mtld(tokens: list[str], threshold: float = 0.72) -> float:
    """Lexical diversity that does not depend on length: the mean of both directions; the number of tokens under ten."""
    if len(tokens) < 10:
        return float(len(tokens))
    return (mtld_one_way(tokens, threshold) + mtld_one_way(tokens[::-1], threshold)) / 2


def profile(tokens: list[str]) -> tuple:
    counts = Counter(tokens)
    n, v = len(tokens), len(counts)
    if not n:
        return (0, 0, None, None, None, None, 0, 0, None, None, None, None, None)
    nats = -math.fsum(c / n * math.log(c / n) for c in counts.values())
    pairs = Counter(zip(tokens, tokens[1:]))
    repeated = sum(1 for c in pairs.values() if c > 1) / len(pairs) if pairs else 0.0
    hapax = sum(1 for c in counts.values() if c == 1)
    dis = sum(1 for c in counts.values() if c == 2)
    squares = sum(c * c for c in counts.values())
    return (
        n, v, v / n, nats / math.log(2) + 0.0, nats + 0.0, repeated, hapax, dis, 1e4 * (squares - n) / (n * n),
        (squares - n) / (n * (n - 1)) if n > 1 else None, 100 * math.log(n) / (1 - hapax / v) if hapax < v else None,
        v / math.sqrt(n), math.log(v) / math.log(n) if n > 1 else None,
    )


def lexical_profile(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, counts, type-token ratio, entropy, hapax and dis legomena, Yule, Simpson, Honore, Guiraud, Herdan).

    A null or empty text has 0 tokens and null measures; a measure whose denominator vanishes is null (Honore where every word stands once, Simpson and
    Herdan for one word). One row per input row, no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def make():
        return lambda keys, texts: [keys, *zip(*[profile(_word_runs((t or "").lower())) for t in texts])]

    return map_columns(df.select(F.col(key).alias("k"), F.col(text).alias("t")), make, f"k {kind}, {PROFILE}").withColumnRenamed("k", key)


def diversity(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mtld): null for a text without words."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        def one(t):
            tokens = _word_runs((t or "").lower())
            return mtld(tokens) if tokens else None

        return lambda keys, texts: [keys, [one(t) for t in texts]]

    return map_columns(df.select(F.col(key).alias("k"), F.col(text).alias("t")), make, f"k {kind}, mtld double").withColumnRenamed("k", key)


TOP_SIZES = (2, 3, 4)
COVER_SIZES = (5, 6, 7, 8, 9, 10)


def ngram_shares(text: str | None) -> list[float]:
    """Characters in the most frequent 2-, 3- and 4-gram, then in words that repeated 5- to 10-grams cover, over all characters."""
    text = text or ""
    words = _word_runs(text.lower())
    length = len(text) or 1
    out = []
    for n in TOP_SIZES:
        grams = Counter(zip(*[words[i:] for i in range(n)]))
        gram, count = max(grams.items(), key=lambda x: x[1], default=((), 0))  # the first of equals, as counted in order
        out.append((sum(map(len, gram)) + n - 1) * count / length if count > 1 else 0.0)
    sizes = list(map(len, words))
    for n in COVER_SIZES:
        grams = list(zip(*[words[i:] for i in range(n)]))
        covered = end = 0
        counts = Counter(grams)
        if len(counts) < len(grams):
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    covered += sum(sizes[max(end, i) : i + n])
                    end = i + n
        out.append(covered / length)
    return out


def ngram_repetition(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, top_2..top_4, cover_5..cover_10); all 0 for null, empty and short texts."""
    kind = df.schema[key].dataType.simpleString()
    names = [f"top_{n}" for n in TOP_SIZES] + [f"cover_{n}" for n in COVER_SIZES]

    def make():
        return lambda keys, texts: [keys, *zip(*[ngram_shares(t) for t in texts])]

    schema = f"k {kind}, " + ", ".join(f"{n} double" for n in names)
    return map_columns(df.select(F.col(key).alias("k"), F.col(text).alias("t")), make, schema).withColumnRenamed("k", key)


def with_ngram_flags(df: DataFrame, text: str, top: dict[int, float], cover: dict[int, float]) -> DataFrame:
    """The rows with ``top_ngrams_high`` and ``cover_ngrams_high``: whether the share of any size of n-gram is over its limit. Batches pass through, nothing is shuffled."""
    schema = StructType([*df.schema.fields, StructField("top_ngrams_high", BooleanType()), StructField("cover_ngrams_high", BooleanType())])
    names = [f.name for f in schema.fields]
    limits = [top[n] for n in TOP_SIZES], [cover[n] for n in COVER_SIZES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [ngram_shares(t) for t in batch[text].to_pylist()]
            cut = len(TOP_SIZES)
            flags = [pa.array([any(x > y for x, y in zip(part(s), of)) for s in shares], pa.bool_()) for part, of in ((lambda s: s[:cut], limits[0]), (lambda s: s[cut:], limits[1]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], names=names)

    return df.mapInArrow(run, schema)
