"""Problem 6: how demanding a text is to read.

Gradient-boosted regression trees over distributions of length, vocabulary, syntax and
cohesion, fitted to the majority grade of a panel of readers. Cuts between grades are
calibrated on predictions for sources that the trees had not seen.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns
from granary.llm.scans import read_page
from granary.llm.text_types import TYPES, TypeModel, decode, learn, statistics
from granary.llm.words import ALL_COMMON, join_letters
from granary.session import keep

_words = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?").findall
_stop = re.compile(r"[.!?…](?<=[^\W_][^\W_)\]»”\"'%].)[)\]»”\"']*(?=\s|\Z)").split
_hyphen = re.compile(r"(?<=\w)[-‐¬\xad][ \t]*\n[ \t]*(?=\w)").sub
_marked = re.compile(r"[<>&\\{}\[\]*_`=~$#|]").search
_code = re.compile(r"```.*?```|<pre.*?</pre>|\{\|.*?\|\}|<!--.*?-->|\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]{1,60}\$|\[\[(?:Category|File):[^\]]*\]\]", re.S | re.I).sub
_block = re.compile(r"</?(?:p|div|h\d|li|ul|ol|table|tr|br|pre)\b[^<>]*/?>|\\(?:item|begin\{\w+\}|end\{\w+\})|^[ \t]*(?:[-*#+•–]|\d{1,3}[.)])[ \t]+", re.I | re.M).sub
_inline = re.compile(r"<[^<>]{0,200}>?|&#?\w{1,8};|\\(?:cite|ref|footnote|label)\{[^{}]*\}|\\[a-z]+\*?|\]\([^()\s]*\)|https?://\S+|[{}\[\]*_`~$#|\\=]", re.I).sub

FEATURES = (
    "n_words_log", "sentence_mean", "sentence_p10", "sentence_median", "sentence_p90", "sentence_sd", "short_sentences", "long_sentences",
    "word_mean", "word_p75", "word_p95", "long_words", "very_long_words", "distinct_share", "common_share", "commas", "clauses", "overlap", "rarity_mean", "rarity_p90", "rare_share",
)
LEAST_WORDS = 60


def plain(text: str) -> str:
    """Prose of a text: markup, page numbers and line-end hyphens out, blocks apart. For measuring, not for reading."""
    if "\n" in text:
        page = read_page(text)
        if page.scanned:
            text = "\n".join(line for line, out in zip(page.lines, page.furniture) if not out)
        text = _hyphen("", text)
    text = join_letters(text)
    if _marked(text):
        if "&lt;" in text:
            text = text.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
        text = _inline(" ", _block("\n\n", _code(" ", text)))
    return text


class Rarity:
    """How rare words are in the corpus: -log of the share of texts that have them, by cells of a hash; 0 for all without a corpus."""

    CELLS = 1 << 18
    MOST_WORDS = 500_000

    def __init__(self, texts_with: np.ndarray | None = None, texts: int = 0):
        # Words that share a cell with others count as more frequent by these others' mean.
        self.of_cell = None if texts_with is None or not texts else -np.log(np.maximum(texts_with - texts_with.mean(), 1.0) / texts)
        self.known: dict[str, float] = {}

    def __call__(self, word: str) -> float:
        if word not in self.known:
            if len(self.known) > self.MOST_WORDS:  # only memory depends on it
                self.known.clear()
            self.known[word] = 0.0 if self.of_cell is None else float(self.of_cell[zlib.crc32(word.encode()) % self.CELLS])
        return self.known[word]


def measure(text: str, rarity: Rarity | None = None) -> list[float] | None:
    """Features of a text; None where it is out of scope: under 60 words, or no sentences with a stop."""
    lengths: list[int] = []
    words: list[str] = []
    commas = clauses = 0
    overlap = pairs = 0.0
    before: set[str] = set()
    bare = plain(text)
    if len(bare.split()) < LEAST_WORDS:
        return None
    for block in bare.split("\n\n"):
        *closed, _ = _stop(block)
        for sentence in closed:
            own = _words(sentence.lower())
            if not own:
                continue
            lengths.append(len(own))
            words += own
            commas += sentence.count(",")
            clauses += sentence.count(";") + sentence.count(":")
            content = {w for w in own if len(w) > 4}
            if before or content:
                pairs += 1
                overlap += len(content & before) / max(1, min(len(content), len(before)))
            before = content
    n = len(words)
    if n < LEAST_WORDS // 3:  # hardly any of it is in sentences
        return None
    s = sorted(lengths)
    k = len(s)
    w = sorted(map(len, words))
    mean = n / k
    different = set(words)
    rare = sorted(map(rarity, different)) if rarity else [0.0]
    return [
        np.log(n), mean, s[k // 10], s[k // 2], s[min(k - 1, 9 * k // 10)], (sum(x * x for x in s) / k - mean * mean) ** 0.5 if k > 1 else 0.0,
        sum(1 for x in s if x <= 8) / k, sum(1 for x in s if x > 24) / k, sum(w) / n, w[3 * n // 4], w[min(n - 1, 95 * n // 100)],
        sum(1 for x in w if x > 7) / n, sum(1 for x in w if x > 11) / n, len(different) / n, sum(1 for x in words if x in ALL_COMMON) / n,
        commas / k, clauses / k, overlap / max(pairs, 1), sum(rare) / len(rare), rare[9 * (len(rare) - 1) // 10], sum(1 for x in rare if x > 4.6) / len(rare),
    ]


class Boosted:
    """Least-squares gradient boosting of shallow regression trees on binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 8):
        # A leaf holds ``least`` texts, or an eighth of a small sample.
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.base = float(y.mean()) if len(y) else 2.0
        least = max(1, min(self.least, len(y) // 8))
        self.trees: list[list[tuple[int, float, float]]] = []
        if not len(y):
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        fitted = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            rest = y - fitted
            nodes: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            where = {0: np.arange(len(y))}
            for node in range(len(nodes)):
                rows = where.get(node)
                if rows is None:
                    continue
                best = (1e-9, -1, 0)
                if node < 2**self.depth - 1 and len(rows) >= 2 * least:
                    total, count = rest[rows].sum(), len(rows)
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        sums = np.bincount(binned[rows, j], rest[rows], len(e) + 1).cumsum()[:-1]
                        left = np.bincount(binned[rows, j], minlength=len(e) + 1).cumsum()[:-1]
                        ok = (left >= least) & (count - left >= least)
                        if ok.any():
                            gain = np.where(ok, sums**2 / np.maximum(left, 1) + (total - sums) ** 2 / np.maximum(count - left, 1), -np.inf)
                            at = int(gain.argmax())
                            if gain[at] - total**2 / count > best[0]:
                                best = (gain[at] - total**2 / count, j, at)
                if best[1] < 0:
                    nodes[node] = (-1, 0.0, self.rate * float(rest[rows].mean()))
                    fitted[rows] += nodes[node][2]
                    continue
                _, j, at = best
                nodes[node] = (j, float(edges[j][at]), 0.0)
                low = binned[rows, j] <= at
                where[2 * node + 1], where[2 * node + 2] = rows[low], rows[~low]
            self.trees.append(nodes)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for nodes in self.trees:
            feature = np.array([n[0] for n in nodes])
            edge = np.array([n[1] for n in nodes])
            value = np.array([n[2] for n in nodes])
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = feature[at]
                low = x[np.arange(len(x)), np.maximum(j, 0)] <= edge[at]
                at = np.where(j < 0, at, np.where(low, 2 * at + 1, 2 * at + 2))
            out += value[at]
        return out


@dataclass
class ReadingModel:
    trees: Boosted
    cuts: tuple[float, float]
    accuracy: float  # of the bands predicted for unseen sources

    def grade(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated grades between 1 and 3, bands)."""
        raw = self.trees.predict(x)
        low, high = self.cuts
        grade = np.interp(raw, [1.0 - 1e-6, low, high, 3.0 + 1e-6], [1.0, 1.5, 2.5, 3.0])
        return grade, 1 + (raw > low) + (raw > high)


def fit(x: np.ndarray, y: np.ndarray, sources: list[str], most_folds: int = 10) -> ReadingModel:
    """Cross-validated by source, several sources in one fold where there are more than ``most_folds``; with one source by position."""
    names = sorted(set(sources), key=lambda s: (zlib.crc32(s.encode()), s))
    folds = np.array([names.index(s) % most_folds for s in sources], int) if len(names) > 1 else np.arange(len(y)) % 4
    raw = np.zeros(len(y))
    for f in np.unique(folds):
        out = folds == f
        raw[out] = Boosted().fit(x[~out], y[~out]).predict(x[out])
    best = (-1.0, 1.5, 2.5)
    for low in np.arange(1.2, 1.81, 0.05):
        for high in np.arange(2.2, 2.81, 0.05):
            right = float((1 + (raw > low) + (raw > high) == y).mean()) if len(y) else 0.0
            # Of equally good cuts, the ones nearest to the middle.
            if (right, -abs(low - 1.5) - abs(high - 2.5)) > (best[0], -abs(best[1] - 1.5) - abs(best[2] - 2.5)):
                best = (right, float(low), float(high))
    return ReadingModel(Boosted().fit(x, y), (best[1], best[2]), best[0])


def _fields(df: DataFrame, key: str, fields: tuple[str, ...], *more) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("t")) for f in fields])
    return df.select(F.col(key).alias("k"), *more, F.inline(each)).where(F.length("t") > 0)


def learn_rarity(df: DataFrame, key: str = "rec_no", fields: tuple[str, ...] = ("description", "ko_content_flat")) -> tuple[np.ndarray, int]:
    """(texts that have a word of each cell, texts) over all texts of the fields. Counted once a task, so each task shuffles at most a small row per cell, and as many reach the driver."""
    schema = pa.schema([("c", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros(Rarity.CELLS, np.int64), 0
        for batch in batches:
            seen: Counter = Counter()
            for t in batch["t"].to_pylist():
                seen.update(set(_words(t.lower())))
                texts += 1
            cells = np.fromiter((zlib.crc32(w.encode()) % Rarity.CELLS for w in seen), np.int64, len(seen))
            np.add.at(counts, cells, np.fromiter(seen.values(), np.int64, len(seen)))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([texts, *counts[used].tolist()], pa.int64())], schema=schema)

    counted = _fields(df, key, fields).select("t").mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    c, n = counted["c"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    cells = np.zeros(Rarity.CELLS, np.int64)
    cells[c[c >= 0]] = n[c >= 0]
    return cells, int(n[c < 0].sum())


def learn_reading(
    df: DataFrame, panel: DataFrame, key: str = "rec_no", fields: tuple[str, ...] = ("description", "ko_content_flat"), source: str = "ko_upload_source", most_texts: int = 1500,
    frequencies: tuple[np.ndarray, int] | None = None,
) -> ReadingModel:
    """Fitted on at most ``most_texts`` texts of the panel, taken in the order of a hash; repeated ratings count once each, a grade is the
    median of its raters. That bound is also what makes the broadcast of the sampled keys safe. Texts are measured where they are; only features reach the driver."""
    graded = panel.where("band BETWEEN 1 AND 3").groupBy(F.col("rec_no").alias("k"), F.col("field_name").alias("f")).agg(F.percentile("band", F.lit(0.5)).alias("band"))
    sample = graded.orderBy(F.xxhash64("k", "f"), "k", "f").limit(most_texts)
    texts = _fields(df, key, fields, F.coalesce(F.col(source), F.lit("")).alias("s")).join(F.broadcast(sample), ["k", "f"])
    shared = df.sparkSession.sparkContext.broadcast(frequencies or (None, 0))

    def work_on():
        rarity = Rarity(*shared.value)

        def work(keys, sources, bands, texts):
            return [keys, sources, bands, [measure(t, rarity) for t in texts]]

        return work

    hashed = texts.select(F.xxhash64("k", "f").alias("h"), "s", "band", "t")
    measured = map_columns(hashed, work_on, "h long, s string, band double, x array<double>").where("x IS NOT NULL")
    # Rows of one key repeat; the limit counts rows, so that repeats do not break the bound.
    rows = measured.orderBy("h", "x").limit(most_texts).collect()
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([round(r["band"]) for r in rows], float), [r["s"] for r in rows])


def reading_levels(
    df: DataFrame, panel: DataFrame, key: str = "rec_no", fields: tuple[str, ...] = ("description", "ko_content_flat"), typed: str = "ko_content_flat",
    model: ReadingModel | None = None, types: TypeModel | None = None, **options,
) -> DataFrame:
    """(key, field_name, grade, band) of every text in scope.

    Out of scope, and without a row: null and blank texts, under 60 words, no sentence punctuation, and texts of ``typed`` that
    are no prose. Repeated rows repeat. Texts are read once and whole; what is kept of each is its features. An empty panel gives band 2 to all.
    """
    kind = df.schema[key].dataType.simpleString()
    frequencies = learn_rarity(df, key, fields)
    model = model or learn_reading(df, panel, key, fields, frequencies=frequencies, **options)
    shared = df.sparkSession.sparkContext.broadcast(frequencies)

    def read():
        rarity = Rarity(*shared.value)

        def work(keys, names, texts):
            rows = []
            for k, f, t in zip(keys, names, texts):
                if t.isspace():
                    continue
                pattern = statistics(t).pattern if f == typed else None
                m = measure(t, rarity)
                if m is None and pattern is None:
                    continue
                rows.append((k, f, pattern, m))
            return list(zip(*rows)) or [[]] * 4

        return work

    read_once = keep(map_columns(_fields(df, key, fields), read, f"k {kind}, f string, pattern long, x array<double>"))
    if types is None:
        counts = read_once.where("pattern IS NOT NULL").groupBy("pattern").count().collect()  # one row per vote pattern, a few hundred
        types = learn({r["pattern"]: r["count"] for r in counts})

    def grade():
        known: dict[int, bool] = {}

        def work(keys, names, patterns, xs):
            kept = []
            for i, p in enumerate(patterns):
                if p is not None and p not in known:
                    known[p] = TYPES[int(types.posterior(decode(p)).argmax())] == "prose"
                if p is None or known[p]:
                    kept.append(i)
            if not kept:
                return [[]] * 4
            grades, bands = model.grade(np.array([xs[i] for i in kept]))
            return [[keys[i] for i in kept], [names[i] for i in kept], grades.tolist(), bands.tolist()]

        return work

    return map_columns(read_once.where("x IS NOT NULL"), grade, f"k {kind}, field_name string, grade double, band int").withColumnRenamed("k", key)
