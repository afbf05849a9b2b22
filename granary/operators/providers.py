"""Where models come in: embedders, entailment, language models, judges.

A provider is any object with ``name`` and ``answer(texts) -> list``; answers are kept by the digest of model and
text, and only texts without an answer are asked.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns


class Provider(Protocol):
    name: str

    def answer(self, texts: Sequence[str]) -> list[str | None]:
        """One answer per text, as JSON or plain text; None for a failure."""


class HashEmbedder:
    """A deterministic stand-in: the vector of a text is made of its words' digests."""

    def __init__(self, size: int = 16):
        self.name, self.size = f"hash-{size}", size

    def answer(self, texts: Sequence[str]) -> list[str | None]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in re.findall(r"\w+", t.lower()):
                d = hashlib.sha256(w.encode()).digest()
                v = [x + d[i % len(d)] / 127.5 - 1 for i, x in enumerate(v)]
            length = sum(x * x for x in v) ** 0.5
            out.append(json.dumps([x / length if length else 0.0 for x in v]))
        return out


def request_key(model: str, text: str) -> str:
    return hashlib.sha256(f"{model}\0{text}".encode()).hexdigest()


def ask(df: DataFrame, text: str, provider: Provider, cache: DataFrame | None = None, threads: int = 1, batch: int = 64) -> DataFrame:
    """(request, answer) for every different text: from the cache (request, answer), else from the provider.

    Each text is asked once whatever its number of rows. A provider that fails on a batch leaves nulls there, which a later run asks again.
    """
    texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).distinct()
    keyed = texts.select(F.sha2(F.concat(F.lit(f"{provider.name}\0"), "t"), 256).alias("request"), "t")
    todo = keyed.join(cache.select("request"), "request", "left_anti") if cache is not None else keyed

    def make():
        def one(part):
            try:
                return provider.answer(part)
            except Exception:  # a failed call is a missing answer
                return [None] * len(part)

        def work(requests, items):
            parts = [items[i : i + batch] for i in range(0, len(items), batch)]
            with ThreadPoolExecutor(threads) as pool:
                return [requests, [a for part in pool.map(one, parts) for a in part]]

        return work

    fresh = map_columns(todo, make, "request string, answer string")
    if cache is None:
        return fresh
    return cache.join(keyed.select("request"), "request", "left_semi").select("request", "answer").unionByName(fresh)


def answers(df: DataFrame, text: str, provider: Provider, **options) -> DataFrame:
    """The rows with their ``answer``; rows without a text have none."""
    keyed = df.withColumn("request", F.sha2(F.concat(F.lit(f"{provider.name}\0"), F.col(text)), 256))
    return keyed.join(ask(df, text, provider, **options), "request", "left").drop("request")


def first_object(text: str | None) -> str | None:
    """The first whole JSON object in a reply with fences or prose around it; None without one. Brackets in strings do not count."""
    for start in (m.start() for m in re.finditer(r"\{", text or "")):
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif c == "\\":
                skip = quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c == "{") - (c == "}")
                if not depth:
                    candidate = text[start : i + 1]
                    try:
                        json.loads(candidate)
                        return candidate
                    except ValueError:
                        break
    return None


def objects(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, object): the first JSON object of each reply, null without one."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        return lambda keys, replies: [keys, [first_object(r) for r in replies]]

    return map_columns(df.select(F.col(key).alias("k"), F.col(reply).alias("r")), make, f"k {kind}, object string").withColumnRenamed("k", key)


def verdicts(rows: DataFrame, sentence: list[str], verdict: str, answered: str) -> DataFrame:
    """(sentence..., verdict) over the parts of a source: supported by any part keeps a sentence, contradicted is listed, absent only where every part answered."""
    sums = rows.groupBy(*sentence).agg(F.max((F.col(verdict) == "supported").cast("int")).alias("_s"), F.max((F.col(verdict) == "contradicted").cast("int")).alias("_c"), F.min(F.col(answered).cast("int")).alias("_all"))
    return sums.select(*sentence, F.when(F.col("_s") == 1, "supported").when(F.col("_c") == 1, "contradicted").when(F.col("_all") == 1, "absent").otherwise("unknown").alias("verdict"))


def best_premise(rows: DataFrame, pair: list[str], hypothesis: str, entails: str, contradicts: str) -> DataFrame:
    """(pair..., score): each hypothesis part takes its best premise by entailment less contradiction, then the mean over parts."""
    best = rows.groupBy(*pair, hypothesis).agg(F.max(F.struct((F.col(entails) - F.col(contradicts)).alias("d"), F.col(entails).alias("e")))["d"].alias("d"))
    return best.groupBy(*pair).agg(F.avg("d").alias("score"))
