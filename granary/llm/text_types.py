"""Problem 5: text statistics of each document, and what kind of text it is.

Thresholds on the statistics are noisy labelling functions: each votes for one type or
abstains. How far each can be trusted is not set by hand but learnt by expectation
maximization from how all documents' votes agree, and the posterior type comes out.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns
from granary.llm.words import ALL_COMMON

TYPES = ("prose", "list", "table", "junk")
_PROSE, _LIST, _TABLE, _JUNK, _ABSTAIN = range(5)

_words = re.compile(r"[^\W_]+").findall
_closing = ")]»”\"'"
_ends = (".", "!", "?", "…")

#: A stop after at least two letters, or a letter and a closing mark: not the one of "3." or "n.d.".
_sentences = re.compile(r"[.!?…](?<=[^\W\d_][^\W\d_)\]»”\"'].)(?=[\s)»”\"]|\Z)").split
_bullet = re.compile(r"(?:[-*•▪‣–—·]|\(?\d{1,3}[.)]|[a-z]\))\s+\S").match
_vowel = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýąęó]", re.I).search
_broken = re.compile(r"\(cid:\d+\)|�|ï¿½|Ã[\x80-\xbf©¼¶¤Ÿ]|â€.|Â[\x80-\xbf°]|Ð.|ƒ").findall
_BROKEN_MARKS = ("(cid:", "�", "ï¿", "Ã", "â€", "Â", "Ð", "ƒ")
_CELL_MARKS = ("\t", "|", ";", "  ")
_code = re.compile(r"function\s?\(|\bvar |=>|[{}];?|\breturn\b|\(\);").findall
_cell = re.compile(r"[\t|;]|  +").split
_value = re.compile(r"[-–]|n\.?d\.?|[-+]?\d[\d.,]*\s*%?").fullmatch
_entries = re.compile(r"[\n;|>•]+|, |  +").split
#: Words of page controls.
CONTROL_WORDS = frozenset("menu login logout search share print back next home cookies top ok en items subscribe contact sitemap previous".split())

STATISTICS = ("n_words", "mean_word_length", "symbol_share", "punct_line_share", "common_word_share")


@dataclass(slots=True)
class Statistics:
    n_words: int
    mean_word_length: float
    symbol_share: float
    punct_line_share: float
    common_word_share: float
    votes: tuple[int, ...]

    @property
    def pattern(self) -> int:
        code = 0
        for v in self.votes:
            code = code * 5 + v
        return code


def statistics(text: str) -> Statistics:
    """Statistics and votes of one text that is not blank. Words are runs of letters or digits."""
    words = _words(text.lower())
    n = len(words)
    n_signs = sum(map(len, words))
    n_letters = n_signs - sum(map(text.count, "0123456789"))
    tokens = text.split()
    n_solid = sum(map(len, tokens))
    symbols = max(0.0, 1 - n_signs / n_solid)
    lines = [s for line in text.split("\n") if (s := line.strip())]
    ended = sum(1 for s in lines if s.rstrip(_closing).endswith(_ends)) / len(lines)
    times = Counter(words)
    common = sum(times[w] for w in times.keys() & ALL_COMMON) / n if n else 0.0

    votes = [_ABSTAIN] * len(FUNCTIONS)
    # 0: function words.
    if n >= 8 and common >= 0.2:
        votes[0] = _PROSE
    # 1: share of the text in sentences of at least four words.
    *closed, _ = _sentences(text)
    share = sum(len(c) for c in closed if c.count(" ") + c.count("\n") >= 3) / len(text)
    if share >= 0.5:
        votes[1] = _PROSE
    # 2, 3: cells that hold values, and rows of equal width.
    cells = values = 0
    widths: dict[int, int] = {}
    split = any(mark in text for mark in _CELL_MARKS)
    for s in lines:
        row = [c for c in map(str.strip, _cell(s)) if c] if split else (s,)
        cells += len(row)
        values += sum(1 for c in row if len(c) <= 12 and _value(c))
        widths[len(row)] = widths.get(len(row), 0) + 1
    value_share = values / cells if cells else 0.0
    if cells >= 4 and value_share >= 0.25:
        votes[2] = _TABLE
    width = max(widths, key=widths.get)
    if len(lines) >= 3 and width >= 2 and widths[width] >= 0.7 * len(lines) and value_share >= 0.1:
        votes[3] = _TABLE
    # 4: marks of enumeration.
    marks = [len(s) for s in lines if _bullet(s)]
    if len(marks) >= 2 and sum(marks) >= 0.5 * sum(map(len, lines)) and value_share < 0.25:
        votes[4] = _LIST
    # 6: signs.
    if symbols >= 0.4 and value_share < 0.2:
        votes[6] = _JUNK
    # 7: letters that make no words.
    odd = sum(len(w) * k for w, k in times.items() if len(w) > 2 and not _vowel(w) and not w.isdigit())
    glued = sum(len(t) for t in tokens if len(t) > 40)
    if n_letters and (odd >= 0.25 * n_letters or glued >= 0.4 * n_solid):
        votes[7] = _JUNK
    # 8: page controls.
    controls = sum(times[w] for w in times.keys() & CONTROL_WORDS) / n if n else 0.0
    if controls >= 0.5:
        votes[8] = _JUNK
    # 9: broken encodings.
    if any(mark in text for mark in _BROKEN_MARKS):
        broken = _broken(text)
        if len(broken) >= 4 and sum(map(len, broken)) >= 0.15 * n_solid:
            votes[9] = _JUNK
    # 10: script.
    scripted = ("{" in text or "=>" in text) and len(_code(text)) * 8 >= len(tokens) + 16
    if scripted and symbols >= 0.12 and value_share < 0.2:
        votes[10] = _JUNK
    if share >= 0.5:
        votes[11] = _PROSE
    elif value_share < 0.2 and controls < 0.4:
        # 5: short entries without sentences.
        entries = [e for e in map(str.strip, _entries(text)) if e]
        short = sum(len(e) for e in entries if len(e) <= 48 and not e.endswith(_ends) and _vowel(e))
        flat = sum(map(len, entries)) or 1
        sizes = sorted(map(len, entries))
        wrapped = _wrapped(lines)
        if len(entries) >= 4 and short >= 0.55 * flat and sizes[len(sizes) // 2] <= 40 and not wrapped and not scripted:
            votes[5] = _LIST
        # 11: running text, here without stops: evenly wrapped or long lines, few separators.
        if n >= 12 and value_share < 0.1 and symbols < 0.05 and odd < 0.15 * n_letters and glued < 0.1 * n_solid and (wrapped or flat >= 60 * len(entries)):
            votes[11] = _PROSE
    # 12: hardly any letters.
    if n_letters < 0.3 * n_solid:
        votes[12] = _TABLE if value_share >= 0.2 else _JUNK
    # 13: the same few words again and again.
    if n >= 40 and len(times) <= 0.08 * n:
        votes[13] = _JUNK
    return Statistics(n, n_signs / n if n else 0.0, symbols, ended, common, tuple(votes))


def _wrapped(lines: list[str]) -> bool:
    """Whether lines were broken at one width: the next line's first word mostly would not have fitted, or all are nearly as long and of many words."""
    if len(lines) < 4:
        return False
    sizes = list(map(len, lines[:-1]))
    mean = sum(sizes) / len(sizes)
    if mean >= 34 and sum((x - mean) ** 2 for x in sizes) <= len(sizes) * (0.2 * mean) ** 2 and sum(s.count(" ") for s in lines) >= 5.5 * len(lines):
        return True
    width = sorted(map(len, lines))[int(0.9 * (len(lines) - 1))]
    full = sum(1 for s, after in zip(lines, lines[1:]) if len(s) + len(after.split(None, 1)[0]) >= width)
    return width >= 24 and full >= 0.55 * (len(lines) - 1)


FUNCTIONS = ("common", "sentences", "values", "rows", "marks", "entries", "signs", "no_words", "controls", "encoding", "script", "running", "few_letters", "monotone")


@dataclass(frozen=True)
class TypeModel:
    """log P(vote | type) for each labelling function, and log P(type)."""

    log_prior: np.ndarray
    log_vote: np.ndarray  # functions x types x 5

    def posterior(self, votes: tuple[int, ...]) -> np.ndarray:
        score = self.log_prior.copy()
        for f, v in enumerate(votes):
            score += self.log_vote[f, :, v]
        e = np.exp(score - score.max())
        return e / e.sum()

    @property
    def accuracies(self) -> dict[str, float]:
        """P(the type voted for | a vote), as learnt."""
        out = {}
        for f, name in enumerate(FUNCTIONS):
            joint = np.exp(self.log_vote[f, :, :4] + self.log_prior[:, None])
            out[name] = float(np.trace(joint) / joint.sum())
        return out


def decode(pattern: int) -> tuple[int, ...]:
    votes = []
    for _ in FUNCTIONS:
        pattern, v = divmod(pattern, 5)
        votes.append(v)
    return tuple(reversed(votes))


def learn(patterns: dict[int, int], rounds: int = 30) -> TypeModel:
    """Expectation maximization over counts of vote patterns.

    Starts from the majority of the votes; a prior of pseudo-votes keeps each function's accuracy near 0.8 until the
    data say otherwise, so that a handful of documents, or none, still gives a usable model.
    """
    keys = list(patterns)
    votes = np.array([decode(p) for p in keys], int).reshape(len(keys), len(FUNCTIONS))
    counts = np.array([patterns[k] for k in keys], float)
    k = len(TYPES)
    start = np.full((len(keys), k), 1e-3)
    for c in range(k):
        start[:, c] += (votes == c).sum(1)
    post = start / start.sum(1, keepdims=True)
    pseudo = np.full((len(FUNCTIONS), k, 5), 0.0)
    targets = [set() for _ in FUNCTIONS]
    for f, t in enumerate((0, 0, 2, 2, 1, 1, 3, 3, 3, 3, 3, 0, 3, 3)):
        targets[f].add(t)
    targets[12].add(_TABLE)
    for f in range(len(FUNCTIONS)):
        for c in range(k):
            pseudo[f, c, _ABSTAIN] = 5 if c in targets[f] else 9.4
            for t in targets[f]:
                pseudo[f, c, t] = 5 if c == t else 0.05
            for t in range(k):
                pseudo[f, c, t] = max(pseudo[f, c, t], 0.02)
    # The pseudo-votes weigh as much as some hundredths of the corpus, and never nothing.
    pseudo *= max(1.0, 0.002 * counts.sum())
    model = None
    for _ in range(rounds):
        weight = post * counts[:, None]
        prior = weight.sum(0) + 1.0
        table = pseudo.copy()
        for f in range(len(FUNCTIONS)):
            for v in range(5):
                table[f, :, v] += weight[votes[:, f] == v].sum(0)
        model = TypeModel(np.log(prior / prior.sum()), np.log(table / table.sum(2, keepdims=True)))
        score = model.log_prior[None, :] + sum(model.log_vote[f][:, votes[:, f]].T for f in range(len(FUNCTIONS)))
        e = np.exp(score - score.max(1, keepdims=True)) if len(keys) else score
        post = e / e.sum(1, keepdims=True) if len(keys) else post
    return model


def vote_patterns(df: DataFrame, text: str) -> DataFrame:
    """(pattern, n): how many non-blank texts voted alike, over the whole table."""

    def make():
        def work(texts):
            seen: dict[int, int] = {}
            for t in texts:
                if t and not t.isspace():
                    p = statistics(t).pattern
                    seen[p] = seen.get(p, 0) + 1
            return [list(seen), list(seen.values())]

        return work

    return map_columns(df.select(F.col(text).alias("t")), make, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def learn_types(df: DataFrame, text: str = "ko_content_flat") -> TypeModel:
    """The label model of a table. What reaches the driver is one count per vote pattern that occurs: the functions have a few hundred
    patterns between them, independent of the number of texts."""
    return learn({r["pattern"]: r["n"] for r in vote_patterns(df, text).collect()})


class TypeOf:
    """Type of a text; remembers patterns."""

    def __init__(self, model: TypeModel):
        self.model, self.known = model, {}

    def __call__(self, s: Statistics) -> tuple[str, float]:
        if s.votes not in self.known:
            post = self.model.posterior(s.votes)
            best = int(post.argmax())
            self.known[s.votes] = (TYPES[best], float(post[best]))
        return self.known[s.votes]


def classify(df: DataFrame, key: str = "rec_no", text: str = "ko_content_flat", model: TypeModel | None = None) -> DataFrame:
    """(key, n_words, mean_word_length, symbol_share, punct_line_share, common_word_share, content_class, confidence).

    One row per input row. Null and blank texts have n_words 0, null shares, class and confidence. Very long texts are
    read whole. Two narrow passes; between them only counts of vote patterns are shuffled.
    """
    kind = df.schema[key].dataType.simpleString()
    model = model or learn_types(df, text)

    def make():
        type_of = TypeOf(model)

        def work(keys, texts):
            rows = []
            for k, t in zip(keys, texts):
                if not t or t.isspace():
                    rows.append((k, 0, None, None, None, None, None, None))
                    continue
                s = statistics(t)
                rows.append((k, s.n_words, s.mean_word_length, s.symbol_share, s.punct_line_share, s.common_word_share, *type_of(s)))
            return list(zip(*rows))

        return work

    schema = f"k {kind}, n_words int, mean_word_length double, symbol_share double, punct_line_share double, common_word_share double, content_class string, confidence double"
    return map_columns(df.select(F.col(key).alias("k"), F.col(text).alias("t")), make, schema).withColumnRenamed("k", key)
