"""Problem 4: the language of each document and of each passage in another language.

Hierarchical discrimination: linear support vector machines first tell the language
families apart (one against the rest), then one machine for each pair of languages of the
family decides between the close relatives. Features are words and their character
trigrams, so a passage's score is the mean of its words' scores, which a worker remembers.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns
from granary.llm.text_types import TYPES, TypeModel, decode, learn, statistics
from granary.llm.words import FAMILIES, LABEL_CODES, join_letters
from granary.session import keep

_words = re.compile(r"[^\W\d_]+").findall
_quoted = re.compile(r"\(?[«“„\"][^«»“”„\"\n]+[»”“\"]\)?").sub
_bracketed = re.compile(r"\([^()\n]+\)").sub
_word_spans = re.compile(r"[^\W\d_]+").finditer
_stops = re.compile(r"[.!?…](?<=[^\W\d_][^\W\d_)\]»”\"'].)(?=[\s)»”\"]|\Z)|\n[ \t]*\n+")
_entry_edges = re.compile(r"[\n;|>•▪]+|, |  +")
_label_edges = re.compile(r"[,;/|+&]").split

FAMILY_NAMES = tuple(sorted(set(FAMILIES.values())))
LANGUAGES = tuple(sorted(FAMILIES))
PAIRS = tuple((a, b) for fam in FAMILY_NAMES for a, b in combinations([x for x in LANGUAGES if FAMILIES[x] == fam], 2))
DIMENSIONS = 4096
_LISTED = {TYPES.index("list")}


def label_codes(labels: list[str] | None) -> frozenset[str]:
    """Two-letter codes that labels of any spelling name; what names no language is left out."""
    codes = set()
    for label in labels or ():
        for part in _label_edges(label or ""):
            name = part.strip().lower()
            code = LABEL_CODES.get(name) or LABEL_CODES.get(name.replace("_", "-").split("-")[0] if re.fullmatch(r"[a-z]{2,3}[-_][a-z0-9]{2,4}", name) else "")
            if code:
                codes.add(code)
    return frozenset(codes)


def word_features(word: str) -> list[int]:
    framed = f"^{word}$"
    grams = {framed, *(framed[i : i + 3] for i in range(len(framed) - 2))}
    return [zlib.crc32(g.encode()) % DIMENSIONS for g in sorted(grams)]


@dataclass(frozen=True)
class LanguageModel:
    """Weights of the machines: families, then pairs; one column each."""

    weights: np.ndarray  # DIMENSIONS x (families + pairs)

    def word_score(self, word: str) -> np.ndarray:
        f = word_features(word)
        return self.weights[f].sum(0) / len(f) ** 0.5


def _vector(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a unit and their weights; its score is the sum of its words' scores over the root of their number."""
    weight: dict[int, float] = {}
    for w in words:
        f = word_features(w)
        for i in f:
            weight[i] = weight.get(i, 0.0) + len(f) ** -0.5
    return np.fromiter(weight, np.int64), np.fromiter(weight.values(), float) / len(words) ** 0.5


def _machine(units: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, rounds: int, cost: float = 1.0) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by dual coordinate descent; sign 0 leaves a unit out."""
    w = np.zeros(DIMENSIONS)
    used = np.flatnonzero(signs)
    alpha = np.zeros(len(units))
    norms = [float(v @ v) + 0.5 / cost for _, v in units]
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(used):
            at, value = units[i]
            y = signs[i]
            slope = y * float(w[at] @ value) - 1 + alpha[i] * 0.5 / cost
            if slope >= 0 and alpha[i] == 0:
                continue
            step = max(alpha[i] - slope / norms[i], 0.0) - alpha[i]
            alpha[i] += step
            w[at] += step * y * value
    return w


def train(units: list[list[str]], labels: list[str], rows: list[int], prose: list[bool]) -> LanguageModel:
    """Three rounds, the first on prose alone. A row's units take part in the next round where the model so far gives the row, by the sum of its units of
    that style, the language of its label; so wrong labels, and keywords in another language than the text, drop out."""
    vectors = [_vector(u) for u in units]
    y = np.array(labels, dtype="U2")
    fams = np.array([FAMILIES[v] for v in labels], dtype="U16")
    style = np.array(prose, bool)
    keep = style.copy()
    group = np.array(rows, np.int64) * 2 + style if units else np.zeros(0, np.int64)
    _, group = np.unique(group, return_inverse=True)
    model = LanguageModel(np.zeros((DIMENSIONS, len(FAMILY_NAMES) + len(PAIRS))))
    for rounds in (2, 2, 5) if units else ():
        columns = [_machine(vectors, np.where(keep, np.where(fams == f, 1, -1), 0), rounds) for f in FAMILY_NAMES]
        columns += [_machine(vectors, np.where(keep, (y == a) * 1 - (y == b) * 1, 0), rounds) for a, b in PAIRS]
        model = LanguageModel(np.stack(columns, 1))
        odds = log_odds(np.stack([v @ model.weights[at] for at, v in vectors]))
        total = np.zeros((group.max() + 1, len(LANGUAGES)))
        np.add.at(total, group, odds)
        keep = np.array(LANGUAGES)[total.argmax(1)][group] == y
    return model


_FAMILY_OF = np.array([FAMILY_NAMES.index(FAMILIES[v]) for v in LANGUAGES])
_STEEP = 3.0


def log_odds(scores: np.ndarray) -> np.ndarray:
    """log P(language) of each row of machine scores: family first, then the pairs inside it."""
    fam = scores[:, : len(FAMILY_NAMES)] * _STEEP
    fam = fam - np.logaddexp.reduce(fam, axis=1, keepdims=True)
    inner = np.zeros((len(scores), len(LANGUAGES)))
    for p, (a, b) in enumerate(PAIRS):
        m = scores[:, len(FAMILY_NAMES) + p] * _STEEP
        inner[:, LANGUAGES.index(a)] -= np.logaddexp(0, -m)
        inner[:, LANGUAGES.index(b)] -= np.logaddexp(0, m)
    for f in range(len(FAMILY_NAMES)):
        mine = _FAMILY_OF == f
        inner[:, mine] -= np.logaddexp.reduce(inner[:, mine], axis=1, keepdims=True)
    return fam[:, _FAMILY_OF] + inner


Unit = tuple[tuple[int, int], list[str]]  # where it stands, and its words in lower case

#: Takes the place of what is left out, so that positions stay those of the text.
_GAP = "\ue000"


def _parts(edges: re.Pattern, text: str) -> list[tuple[int, int]]:
    spans, start = [], 0
    for m in edges.finditer(text):
        spans.append((start, m.start()))
        start = m.end()
    return [*spans, (start, len(text))]


class Units:
    """Cuts a text into the units that get a language: sentences, entries of a list, or runs of a dozen words where there are no stops."""

    RUN = 12

    @staticmethod
    def of_text(text: str, listed: bool) -> list[Unit]:
        blank = lambda m: " " + _GAP * (len(m[0]) - 1)
        if any(c in text for c in "«“„\""):
            text = _quoted(blank, text)
        if "(" in text:
            text = _bracketed(blank, text)
        text = join_letters(text, _GAP)
        units: list[Unit] = []
        for start, end in _parts(_entry_edges if listed else _stops, text):
            part = text[start:end]
            words = _words(part.lower())
            if not words:
                continue
            if len(words) <= 40 or listed:
                units.append(((start, end), words))
                continue
            spans = [m.span() for m in _word_spans(part)]
            for i in range(0, len(spans), Units.RUN):
                run = spans[i : i + Units.RUN]
                units.append(((start + run[0][0], start + run[-1][1]), [part[x:y].lower() for x, y in run]))
        return units

    @staticmethod
    def of_keywords(items: list[str]) -> list[Unit]:
        """The place of an entry is that of its item, counted from 0."""
        return [((i, i + 1), w) for i, item in enumerate(items) for p in _entry_edges.split((item or "").replace('"', " ").replace(" / ", "\n")) if (w := _words(p.lower()))]


class Labeller:
    """Machine scores of units with a trained model; remembers the scores of words."""

    MOST_WORDS = 500_000

    def __init__(self, model: LanguageModel):
        self.model, self.ids = model, {}
        self.table = np.zeros((1024, model.weights.shape[1]), np.float32)

    def _add(self, word: str) -> int:
        i = self.ids[word] = len(self.ids)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = self.model.word_score(word)
        return i

    def scores(self, units: list[list[str]]) -> np.ndarray:
        if len(self.ids) > self.MOST_WORDS:  # only memory depends on it
            self.ids.clear()
        get, add = self.ids.get, self._add
        flat, starts = [], []
        for u in units:
            starts.append(len(flat))
            for w in u:
                i = get(w)
                flat.append(add(w) if i is None else i)
        sums = np.add.reduceat(self.table[np.array(flat, np.int64)], np.array(starts, np.int64), axis=0)
        return sums / np.sqrt([len(u) for u in units])[:, None]


def smooth(log_p: np.ndarray, words: list[int], switch: float) -> np.ndarray:
    """The likeliest sequence of languages when a change costs ``switch`` (Viterbi)."""
    weight = np.minimum(np.array(words, float), 12.0)[:, None] / 4.0
    gain = log_p * weight
    n, k = gain.shape
    best, back = gain[0].copy(), np.zeros((n, k), np.int8)
    for i in range(1, n):
        top = int(best.argmax())
        jump = best[top] - switch
        stay = best >= jump
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, jump) + gain[i]
    path = np.zeros(n, int)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


@dataclass(frozen=True)
class Found:
    """A language of a text: its confidence, how many units and words it has, and its passages as (start, end, words, confidence)."""

    lang: str
    confidence: float
    n_units: int
    n_words: int
    passages: list[tuple[int, int, int, float]]


PASSAGE = ("start_char", "end_char", "n_words", "confidence")

#: Below this mean probability, no language of the machines is named.
UNSURE = 0.4


def judge(units: list[Unit], scores: np.ndarray, form: str) -> list[Found]:
    """Languages in the order of their words; the first is the document's.

    ``form`` is ``prose``, ``list`` or ``keywords``. Another language counts with two whole sentences, however long the rest is, or with three entries that
    make a fifth of the list and have a quarter of the main language's words; a title, a quoted phrase or a name never does. Units of a language that does not
    count go with the passage around them. A text that no machine is sure of is ``und``.
    """
    log_p = log_odds(scores)
    sizes = np.array([len(w) for _, w in units], float)
    path = smooth(log_p, sizes, 4.0 if form == "prose" else 12.0)
    chance = np.exp(log_p)
    found = []
    for lang in np.unique(path):
        at = np.flatnonzero(path == lang)
        whole = int((sizes[at] >= 4).sum()) if form == "prose" else len(at)
        sure = float((chance[at, lang] * sizes[at]).sum() / sizes[at].sum())
        found.append((int(sizes[at].sum()), int(lang), sure, whole))
    found.sort(key=lambda r: (-r[0], LANGUAGES[r[1]]))
    most = found[0][0]
    if form == "prose":
        named = [r for i, r in enumerate(found) if i == 0 or r[3] >= 2 and r[2] >= 0.6]
    else:
        named = [r for i, r in enumerate(found) if i == 0 or r[3] >= 3 and r[3] >= 0.2 * len(units) and r[2] >= 0.6 and r[0] >= 0.25 * most]
    kept = {r[1] for r in named}
    of = [int(x) for x in path]
    for i, lang in enumerate(of):
        if lang not in kept:
            of[i] = of[i - 1] if i else next((x for x in of if x in kept), found[0][1])
    passages: dict[int, list[tuple[int, int, int, float]]] = {lang: [] for lang in kept}
    start = 0
    for i in range(1, len(of) + 1):
        if i == len(of) or of[i] != of[start]:
            run = slice(start, i)
            weight = sizes[run]
            sure = float((chance[run, of[start]] * weight).sum() / weight.sum())
            passages[of[start]].append((units[start][0][0], units[i - 1][0][1], int(weight.sum()), sure))
            start = i
    out = []
    for n_words, lang, sure, _ in named:
        name = LANGUAGES[lang] if sure >= UNSURE else "und"
        out.append(Found(name, sure, int((path == lang).sum()), n_words, passages[lang]))
    return out


def sampled_units(text: str | None, keywords: list[str] | None, per_row: int) -> list[tuple[bool, list[str]]]:
    """(prose?, words) of at most ``per_row`` sentences and as many keywords of a row, drawn by a hash over the whole text, none longer than 40 words."""
    drawn = lambda units: sorted((u for u in units if len(u) <= 40), key=lambda u: (zlib.crc32(" ".join(u).encode()), u))[:per_row]
    cut = [(True, u) for u in drawn([w for _, w in Units.of_text(text or "", False) if len(w) >= 4])]
    return cut + [(False, u) for u in drawn([w for _, w in Units.of_keywords(keywords or [])])]


def of_own_label(rows: list[tuple[list[tuple[bool, list[str]]], str]]) -> set[tuple[int, bool]]:
    """(row number, prose?) of what is written in the language of its row's label, of (units, code) rows.

    Each word votes for labels as all units of the sample have it, in two rounds, of prose first and then of what agreed; what has no known word stays. This
    has to come before any balance of the languages, which gives a common language's texts under a rare language's label more weight than under their own.
    """
    number: dict[str, int] = {}
    group: dict[tuple[int, bool], int] = {}
    words, at = [], []
    for n, (cut, _) in enumerate(rows):
        for form, unit in cut:
            g = group.setdefault((n, form), len(group))
            for w in unit:
                words.append(number.setdefault(w, len(number)))
                at.append(g)
    if not words:
        return set()
    words, at = np.array(words, np.int64), np.array(at, np.int64)
    y = np.array([LANGUAGES.index(rows[n][1]) for n, _ in group])
    prose = np.array([form for _, form in group])
    used = prose | ~np.isin(y, y[prose])
    for _ in range(2):
        seen = used[at]
        counts = np.bincount(y[at[seen]] * len(number) + words[seen], minlength=len(LANGUAGES) * len(number)).reshape(len(LANGUAGES), -1)
        share = counts / np.maximum(counts.sum(0), 1)
        votes = np.stack([np.bincount(at, s[words], len(group)) for s in share])
        used = (votes.argmax(0) == y) | (votes.max(0) == 0)
    return {g for g, own in zip(group, used) if own}


def units_of_sample(rows: list[tuple[list[tuple[bool, list[str]]], list[str]]], most_units: int) -> tuple[list, list, list, list]:
    """Units with label, row number and style, of (units, labels) rows: a third of each language's share are keywords, the style of lists.

    Rows whose units are not in the language of their label give none; of the others, each gives its first before any gives its second.
    """
    coded = [(cut, codes[0]) for cut, labels in rows if len(codes := [c for c in label_codes(labels) if c in FAMILIES]) == 1]
    own = of_own_label(coded)
    turns = []
    for number, (cut, code) in enumerate(coded):
        nth = {True: 0, False: 0}
        for form, words in cut:
            if (number, form) in own:
                turns.append((nth[form], number, form, words, code))
                nth[form] += 1
    turns.sort(key=lambda x: x[:2])
    units, langs, numbers, prose = [], [], [], []
    share = most_units // len(LANGUAGES)
    room = {(lang, form): share * part // 3 for lang in LANGUAGES for form, part in ((True, 2), (False, 1))}
    for _, number, form, words, code in turns:
        if room[code, form] > 0:
            room[code, form] -= 1
            units.append(words)
            langs.append(code)
            numbers.append(number)
            prose.append(form)
    return units, langs, numbers, prose


def learn_languages(
    df: DataFrame, key: str = "rec_no", text: str = "ko_content_flat", keywords: str = "keywords", labels: str = "languages", most_rows: int = 3000, most_units: int = 3000, per_row: int = 6
) -> LanguageModel:
    """Fitted on at most ``most_rows`` labelled rows, taken in the order of a hash of the key, and ``most_units`` units, of which each language has an equal share at most.

    Keys alone are sorted; ``most_rows`` of them, the bound of what is broadcast, then draw ``per_row`` sentences and keywords each from their whole texts. Only
    these units, of at most 40 words, reach the driver.
    """
    labelled = df.where(F.size(labels) == 1)
    chosen = labelled.select(F.col(key).alias("_k"), F.xxhash64(F.col(key)).alias("_h")).distinct().orderBy("_h", "_k").limit(most_rows)
    texts = labelled.select(F.col(key).alias("_k"), F.col(text).alias("t"), F.col(keywords).alias("w"), F.col(labels).alias("l"))

    def draw():
        def work(hashes, contents, items, names):
            cut = [sampled_units(t, w, per_row) for t, w in zip(contents, items)]
            return [hashes, [[{"prose": p, "words": w} for p, w in c] for c in cut], names]

        return work

    drawn = map_columns(texts.join(F.broadcast(chosen), "_k").select("_h", "t", "w", "l"), draw, "h long, units array<struct<prose:boolean,words:array<string>>>, l array<string>")
    # Rows of one key repeat; the limit counts rows, so that repeats do not break the bound.
    rows = drawn.orderBy("h", F.xxhash64("units")).limit(most_rows).collect()
    return train(*units_of_sample([([(u["prose"], u["words"]) for u in r["units"]], r["l"]) for r in rows], most_units))


def identify(
    df: DataFrame, key: str = "rec_no", text: str = "ko_content_flat", keywords: str = "keywords", labels: str = "languages",
    model: LanguageModel | None = None, types: TypeModel | None = None,
) -> DataFrame:
    """(key, content_class, labelled, lang, confidence, is_main, n_units, n_words, passages, agrees).

    One row per language that a record is written in: its main one, and each other with whole
    passages. ``labelled`` holds the codes that the record's labels name, ``agrees`` whether these
    are exactly the languages found. ``passages`` are the stretches in the language as (start_char, end_char, n_words, confidence), of characters from 0, end
    excluded, or of positions in the keywords. The text is ``text``, or ``keywords`` where that is null or blank. A record with neither, or without letters, gives no row.
    ``und`` stands for a language that no machine is sure of. Narrow after two bounded fits: the sample of labelled rows, and the counts of vote patterns.
    """
    kind = df.schema[key].dataType.simpleString()
    model = model or learn_languages(df, key, text, keywords, labels)

    def read():
        labeller = Labeller(model)

        def work(keys, texts, items, named):
            cut = []
            for k, t, kw, names in zip(keys, texts, items, named):
                codes = sorted(label_codes(names))
                if t and not t.isspace():
                    votes = statistics(t)
                    cut.append((k, votes.pattern, "prose", codes, Units.of_text(t, False)))
                    if _LISTED & set(votes.votes):
                        cut.append((k, votes.pattern, "list", codes, Units.of_text(t, True)))
                else:
                    cut.append((k, None, "keywords", codes, Units.of_keywords(kw or [])))
            cut = [c for c in cut if c[-1]]
            if not cut:
                return [[]] * 5
            scores = labeller.scores([w for *_, units in cut for _, w in units])
            rows, at = [], 0
            for k, pattern, form, codes, units in cut:
                found = judge(units, scores[at : at + len(units)], form)
                at += len(units)
                rows.append((k, pattern, form, codes, [{"lang": x.lang, "confidence": x.confidence, "n_units": x.n_units, "n_words": x.n_words, "passages": [dict(zip(PASSAGE, p)) for p in x.passages]} for x in found]))
            return list(zip(*rows))

        return work

    columns = [F.col(c).alias(a) for c, a in ((key, "k"), (text, "t"), (keywords, "w"), (labels, "l"))]
    passages = "array<struct<start_char:int,end_char:int,n_words:int,confidence:double>>"
    found = f"array<struct<lang:string,confidence:double,n_units:int,n_words:int,passages:{passages}>>"
    # Texts are read once: a text with votes for a list is cut both ways, and its type, known when all votes are counted, picks one.
    read_once = map_columns(df.select(*columns), read, f"k {kind}, pattern long, form string, labelled array<string>, found {found}")
    read_once = keep(read_once)
    if types is None:
        counts = read_once.where("form = 'prose'").groupBy("pattern").count().collect()  # one row per vote pattern, a few hundred
        types = learn({r["pattern"]: r["count"] for r in counts})

    def pick():
        known: dict[int, str] = {}

        def work(keys, patterns, forms, codes, founds):
            rows = []
            for k, p, form, named, langs in zip(keys, patterns, forms, codes, founds):
                kind_of = None
                if p is not None:
                    if p not in known:
                        known[p] = TYPES[int(types.posterior(decode(p)).argmax())]
                    kind_of = known[p]
                    if form != ("list" if kind_of == "list" and _LISTED & set(decode(p)) else "prose"):
                        continue
                agrees = sorted(x["lang"] for x in langs) == named
                rows += [(k, kind_of, named, x["lang"], x["confidence"], i == 0, x["n_units"], x["n_words"], x["passages"], agrees) for i, x in enumerate(langs)]
            return list(zip(*rows)) or [[]] * 10

        return work

    schema = f"k {kind}, content_class string, labelled array<string>, lang string, confidence double, is_main boolean, n_units int, n_words int, passages {passages}, agrees boolean"
    return map_columns(read_once, pick, schema).withColumnRenamed("k", key)


def mislabelled(df: DataFrame, key: str = "rec_no", **options) -> DataFrame:
    """(key, lang) of each record whose labels are not exactly its languages; tables and junk are left out."""
    rows = identify(df, key, **options)
    return rows.where("NOT agrees AND (content_class IS NULL OR content_class NOT IN ('table', 'junk'))").select(key, "lang")


def passages(df: DataFrame, key: str = "rec_no", **options) -> DataFrame:
    """(key, lang, confidence, start_char, end_char, n_words): one row per stretch of a record in one language. Repeated rows repeat."""
    return identify(df, key, **options).select(key, "lang", F.inline("passages")).select(key, "lang", "confidence", "start_char", "end_char", "n_words")
