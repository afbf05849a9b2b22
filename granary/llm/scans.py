"""Problem 1: noise in text from scanned pages.

Misread words are found by intersecting a Levenshtein automaton with a trie of the corpus
vocabulary. The automaton knows, beside the plain edits, the merges and splits of letters
that scanners make ("rn" for "m"), so its candidates are complete for them. Candidates are
ranked by their frequency, by the words next to them and by the rest of the text; page
furniture is dropped and lines are joined into paragraphs again.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns
from granary.session import keep
from granary.llm.text_types import TypeModel, TypeOf, learn, statistics

KINDS = ("hyphenation", "misread", "page_number", "running_header")

# Fixed values: (what is read, what was printed) of common misreadings.
CONFUSIONS = (
    ("ri", "n"), ("5", "s"), ("†", "t"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("0", "o"), ("å", "a"), ("cl", "d"), ("1", "l"), ("1", "i"),
    ("9", "g"), ("ii", "u"), ("b", "h"), ("6", "b"), ("vv", "w"), ("m", "in"), ("m", "ni"), ("rn", "m"), ("m", "rn"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("||", "ll"), ("|", "l"),
    ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("l", "t"), ("ni", "m"), ("in", "m"), ("li", "h"), ("h", "li"), ("lc", "k"), ("d", "cl"), ("ti", "h"), ("u", "ii"), ("w", "vv"), ("n", "ri"), ("$", "s"),
)

_token = re.compile(r"[^\W_](?:[\w†$]|\|(?=[\w|])|(?<=\|)\||\|\||['’](?=[^\W_]))*|†\w+", re.U).findall
_plain_word = re.compile(r"[^\W\d_]+").fullmatch
_number = re.compile(r"\d[\d.,]*").fullmatch
_spaced = re.compile(r"(?<![^\s(«“\"'])((?:[^\W_†]|ri|ii|cl|vv|rn|†|\|\|)( {1,3})(?:[^\W_]|ri|ii|cl|vv|rn|†|\|\|)(?:\2(?:[^\W_]|ri|ii|cl|vv|rn|†|\|\|))+)(?![^\s.,;:!?)»”\"'])")
_blank_run = re.compile(r"[ \t\xa0]{2,}").split
_hyphen_end = re.compile(r"([^\W\d_]+)([-‐¬\xad])[ \t]*$").search
_first_word = re.compile(r"[^\W_][^\s.,;:!?]*").match
# Words for "page" and "of" in front of page numbers.
_page = re.compile(
    r"[-–—\[(|~]*\s*(?:(?:page|p\.|pp\.|seite|s\.|pagina|pág\.?|página|blz\.|strona|str\.)\s*)?(?:\d{1,4}|[ivxlc]{1,7})(?:\s*(?:/|of|von|de|di|van|z|sur)\s*\d{1,4})?\s*[-–—\])|~]*", re.I
).fullmatch
_bare = re.compile(r"(?:\d{1,4}|[ivxl]{1,7})").fullmatch
_stop_end = re.compile(r"[.!?…:][)\]»”\"']*$").search
_item = re.compile(r"(?:[-*•▪‣–+#>|]|\d{1,3}[.)])\s").match


class Trie:
    """Vocabulary as nested dicts; the key '' holds a word's document frequency."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for word, n in words.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = n
        by_first: dict[str, list[tuple[str, str]]] = {}
        for seen, true in CONFUSIONS:
            by_first.setdefault(seen[0], []).append((seen, true))
        self.confusions = by_first

    def candidates(self, word: str, confusions: int, edits: int = 0) -> dict[str, tuple[int, int, int]]:
        """{printed word: (plain edits, confusions, frequency)}: all words that the automaton of ``word``
        accepts with at most so many plain edits and confusions, each with its cheapest way."""
        found: dict[str, tuple[int, int, int]] = {}
        n = len(word)
        stack = [(0, self.root, "", 0, 0)]
        while stack:
            i, node, made, e, c = stack.pop()
            if i == n and "" in node:
                if made not in found or (e, c) < found[made][:2]:
                    found[made] = (e, c, node[""])
            if i < n:
                here = word[i]
                if here in node:
                    stack.append((i + 1, node[here], made + here, e, c))
                if c < confusions and here in self.confusions:
                    for seen, true in self.confusions[here]:
                        if word.startswith(seen, i):
                            to = node
                            for x in true:
                                to = to.get(x)
                                if to is None:
                                    break
                            else:
                                stack.append((i + len(seen), to, made + true, e, c + 1))
                if e < edits:
                    stack.append((i + 1, node, made, e + 1, c))
            if e < edits:
                for x, to in node.items():
                    if x:
                        stack.append((i, to, made + x, e + 1, c))
                        if i < n and x != word[i]:
                            stack.append((i + 1, to, made + x, e + 1, c))
        return found


@dataclass(frozen=True)
class Vocabulary:
    """Document frequencies of the corpus' words; words below ``least`` are not held. ``pairs`` counts neighbouring words, in hashed cells."""

    words: dict[str, int]
    least: int
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))


#: Cells in which pairs of neighbouring words are counted, a power of two.
CELLS = 1 << 20


class Pairs:
    """Cells of pairs of neighbouring words; remembers the words' codes."""

    def __init__(self, cells: int = CELLS):
        self.mask, self.codes = cells - 1, {}

    def code(self, word: str) -> int:
        if word not in self.codes:
            if len(self.codes) > 500_000:
                self.codes.clear()
            self.codes[word] = zlib.crc32(word.encode())
        return self.codes[word]

    def cell(self, a: str, b: str) -> int:
        return (self.code(a) * 2654435761 + self.code(b)) & self.mask

    def cells(self, words: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.code, words), np.int64, len(words))
        return (codes[:-1] * 2654435761 + codes[1:]) & self.mask


#: What counts as often where a word's frequency is judged by itself; the same in a corpus of any size.
FEW = 3
#: How much more frequent the printed word must be than the one read.
RATIO = 12


class Speller:
    """Which words are misread, and for what; remembers its answers."""

    MOST = 300_000

    def __init__(self, vocabulary: Vocabulary):
        self.words, self.least = vocabulary.words, vocabulary.least
        self.trie = Trie({w: n for w, n in vocabulary.words.items() if _plain_word(w.replace("'", "").replace("’", ""))})
        self.known: dict[str, tuple[tuple[str, float], ...]] = {}
        self.nearby: dict[tuple[str, int], tuple[tuple[str, float], ...]] = {}

    def printed(self, word: str) -> tuple[tuple[str, float], ...]:
        """Candidates for a misread word in lower case, best first; empty for a word that is right or unknown."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > self.MOST:
            self.known.clear()
        out: tuple = ()
        self.known[word] = out  # while its candidates are asked for themselves
        if len(word) >= 3 and not _number(word):
            own = max(1, self.words.get(word, 0))
            strange = any(c in "†|$ﬁﬂ" for c in word) or (any(c.isdigit() for c in word) and own < 50 * FEW)
            # Where a sign that no word has stands in a word, any known word will do; else the printed word must be far more frequent.
            floor = self.least if strange and own < self.least else RATIO * own
            if own < self.least or own * RATIO <= self._most:
                found = self._explanations(word, 1, floor)
                if not found and own < 8 * FEW:
                    found = self._explanations(word, 4, floor)
                if found:
                    out = tuple(sorted(((w, math.log(n) - 2.5 * c) for w, (c, n) in found.items()), key=lambda x: (-x[1], x[0])))
        self.known[word] = out
        return out

    def _explanations(self, word: str, confusions: int, floor: int) -> dict[str, tuple[int, int]]:
        """{candidate: (confusions, frequency)}, without candidates that are misread words themselves."""
        found = {w: (c, n) for w, (_, c, n) in self.trie.candidates(word, confusions).items() if c and n >= floor}
        return {w: x for w, x in found.items() if not self.printed(w)}

    @property
    def _most(self) -> int:
        if not hasattr(self, "_top"):
            self._top = max(self.words.values(), default=0)
        return self._top

    def is_word(self, word: str) -> bool:
        return self.words.get(word, 0) >= self.least and not self.printed(word) or bool(self.printed(word))

    def near(self, word: str, edits: int = 1) -> tuple[tuple[str, float], ...]:
        """Known words so many plain edits, and at most one confusion, from a word below the floor that no confusion explains, best first.

        A word that differs by letters at its start or end alone is an inflected or cut form, and gives no candidate.
        """
        if (word, edits) in self.nearby:
            return self.nearby[word, edits]
        if len(self.nearby) > self.MOST:
            self.nearby.clear()
        out: tuple = ()
        own = self.words.get(word, 0)
        if len(word) >= (5 if edits == 1 else 8) and own < self.least and not _number(word) and not self.printed(word):
            found = self.trie.candidates(word, 1 if edits == 1 and len(word) >= 7 else 0, edits)
            far = {w: (e, c, n) for w, (e, c, n) in found.items() if e and n >= RATIO * max(self.least, own) and not (word.startswith(w) or word.endswith(w) or w.startswith(word) or w.endswith(word))}
            out = tuple(sorted(((w, math.log(n) - 4.0 * e - 2.5 * c) for w, (e, c, n) in far.items() if not self.printed(w)), key=lambda x: (-x[1], x[0])))
        self.nearby[word, edits] = out
        return out


def _like(word: str, shape: str) -> str:
    """A word in the case of another."""
    if shape.isupper() and len(shape) > 1:
        return word.upper()
    return word[0].upper() + word[1:] if shape[:1].isupper() else word


@dataclass
class Page:
    """Lines of a text, and what each is: text, '' for an empty one, or furniture."""

    lines: list[str]
    furniture: list[bool]
    page_numbers: int
    headers: int
    width: int
    scanned: bool


def _split_number(line: str) -> tuple[str, bool]:
    """(the line without its page number, whether it had one)."""
    if _page(line):
        return "", True
    parts = [p for p in _blank_run(line) if p]
    if len(parts) > 1:
        rest = [p for p in parts if not _page(p)]
        if len(rest) == len(parts) - 1 and (not _bare(next(p for p in parts if _page(p))) or len(line) < 60):
            return "   ".join(rest), True
    return line, False


def _clusters(lines: list[tuple[str, int]]) -> list[list[int]]:
    """Positions of lines with the same letters but for a cut or misread end."""
    groups: list[list[int]] = []
    before = ""
    for whole, i in sorted(lines):
        n = max(5, min(len(before), len(whole)) - 1)
        if before and whole[:n] == before[:n] and abs(len(whole) - len(before)) <= 2:
            groups[-1].append(i)
        else:
            groups.append([i])
        before = whole
    return [sorted(g) for g in groups if len(g) > 1]


def read_page(text: str) -> Page:
    lines = [line.strip() for line in text.split("\n")]
    furniture = [False] * len(lines)
    full = [i for i, s in enumerate(lines) if s]
    lengths = sorted(len(lines[i]) for i in full)
    width = lengths[int(0.9 * (len(lengths) - 1))] if lengths else 0
    inside = sum(
        1
        for a, b in zip(full, full[1:])
        if not _stop_end(lines[a]) and lines[a][-1] != ">" and not _item(lines[a]) and (lines[b][0].islower() or b == a + 1 and lines[b][0].isalpha() and len(lines[a]) >= 0.75 * width)
    )
    scanned = len(full) >= 3 and inside >= max(1, 0.12 * len(full)) or (len(full) >= 2 and inside >= 1)
    if not scanned:
        return Page(lines, furniture, 0, 0, width, False)
    numbers = 0
    candidates: list[tuple[str, int]] = []
    for i in full:
        s = lines[i]
        if len(s) > 90:
            continue
        rest, numbered = _split_number(s)
        if numbered and not rest and _bare(s) and not _alone(lines, i):
            numbered = False
        if numbered:
            furniture[i] = True
            numbers += 1
        if rest and len(rest) <= 70 and (numbered or not _item(s)) and (rest[0].isupper() or rest[0].isdigit() or rest[0] in "©'\"«“"):
            # A cut last letter may read as a stop, but not on all pages.
            if len(rest.split()) <= 5 and len(s) < 0.85 * width if _stop_end(rest) else numbered or len(s) < 0.85 * width or s.isupper() or len(rest.split()) <= 7:
                candidates.append((re.sub(r"[\W\d_]+", "", rest.replace("|", "l")).lower(), i))
    headers = 0
    for at in _clusters([c for c in candidates if c[0]]):
        # Not as neighbours; a line of running text hardly comes twice as a whole.
        if at[-1] - at[0] >= 2 and not all(_stop_end(lines[i]) for i in at) and 2 * sum(_goes_on(lines, furniture, i) for i in at) < len(at):
            headers += 1
            for i in at:
                furniture[i] = True
    return Page(lines, furniture, numbers, headers, width, True)


def _goes_on(lines: list[str], furniture: list[bool], i: int) -> bool:
    """Whether the text must run from this line into the next: the one before has ended its sentence, and the next begins in the middle of one."""
    before = next((lines[j] for j in range(i - 1, -1, -1) if lines[j] and not furniture[j]), "")
    after = next((lines[j] for j in range(i + 1, len(lines)) if lines[j] and not furniture[j]), "")
    return bool(_stop_end(before)) and after[:1].islower()


def _alone(lines: list[str], i: int) -> bool:
    """A bare number is a page number unless its neighbours are as short: then it is a cell."""
    around = [lines[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(lines) and lines[j]]
    return not around or max(map(len, around)) >= 20


class Reader:
    """Finds and repairs the noise of one text."""

    def __init__(self, vocabulary: Vocabulary):
        self.speller = Speller(vocabulary)
        self.pairs, self.cells = vocabulary.pairs, Pairs(len(vocabulary.pairs))
        # What other pairs in the same cell may account for.
        self.noise = 2.0 * float(self.pairs.mean())
        self.clean: set[str] = set()
        self.odd: set[str] = set()
        self.rare: set[str] = set()

    def misread_words(self, text: str) -> list[str]:
        """Occurrences of misread words, in lower case."""
        words = _token(text.lower())
        choice = self.choices(words, text)
        return [w for w in words if w in choice] if choice else []

    def beside(self, a: str, b: str) -> float:
        """How often a word stands before another in the corpus, beyond what shares its cell."""
        return max(0.0, float(self.pairs[self.cells.cell(a, b)]) - self.noise) if a and b else 0.0

    def context(self, word: str, sides: list[tuple[str, str]]) -> tuple[float, bool]:
        """(log-frequency of a word beside the words around its places, whether both sides know it at one place)."""
        total, both = 0.0, False
        for a, b in sides:
            left, right = self.beside(a, word), self.beside(word, b)
            total = max(total, math.log1p(left) + math.log1p(right))
            both = both or min(left, right) >= FEW
        return total, both

    def choices(self, words: list[str], text: str = "") -> dict[str, str]:
        """{misread word: the printed one} of a text's words in lower case.

        Candidates by confusions come first. Those by plain edits need a witness, as a rare word may be right: a digit or sign
        inside the word, or, in a text that has other misread words, the printed word elsewhere, or words on both sides that the corpus has beside the
        printed word and not beside the one read, which must stand in small letters. Two plain edits are tried with that last witness alone.
        """
        different = set(words)
        for w in different - self.clean - self.odd - self.rare:
            (self.odd if self.speller.printed(w) else self.rare if self.speller.words.get(w, 0) < self.speller.least and len(w) >= 5 else self.clean).add(w)
        if len(self.clean) + len(self.rare) > 400_000:
            self.clean.clear()
            self.rare.clear()
        odd, rare = different & self.odd, different & self.rare
        if not odd and not rare:
            return {}
        around = Counter(words)
        sides: dict[str, list[tuple[str, str]]] = {}
        for i, w in enumerate(words):
            if w in odd or w in rare:
                sides.setdefault(w, []).append((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))

        def best(w: str, found: tuple) -> str:
            if len(found) == 1:
                return found[0][0]
            return max(found, key=lambda x: (x[1] + 3.0 * math.log1p(around[x[0]]) + self.context(x[0], sides[w])[0], x[0]))[0]

        out = {w: best(w, self.speller.printed(w)) for w in odd}
        for w in rare:
            near = self.speller.near(w)
            if near:
                to = best(w, near)
                if not _plain_word(w.replace("'", "").replace("’", "")) or odd and (around[to] or self.witnessed(w, to, sides[w], text)):
                    out[w] = to
            elif odd and len(w) >= 8 and any(a and b for a, b in sides[w]) and (far := self.speller.near(w, 2)):
                to = best(w, far)
                if self.witnessed(w, to, sides[w], text):
                    out[w] = to
        return out

    def witnessed(self, word: str, printed: str, sides: list[tuple[str, str]], text: str) -> bool:
        return word in text and self.context(printed, sides)[1] and not any(self.beside(a, word) >= FEW or self.beside(word, b) >= FEW for a, b in sides)

    def unhyphenate(self, page: Page) -> tuple[list[str], int]:
        """Lines of text with divided words put together, and how many there were."""
        lines: list[str] = []
        divided = 0
        words = self.speller.words
        for s, out in zip(page.lines, page.furniture):
            if out:
                continue
            last = next((k for k in range(len(lines) - 1, -1, -1) if lines[k]), None) if s else None
            end = _hyphen_end(lines[last]) if last is not None else None
            if end and (start := _first_word(s)) and len(lines) - 1 - last <= 1:
                left, mark, right = end[1], end[2], start[0]
                whole = (left + right).lower()
                sure = mark != "-" or whole in words and words[whole] >= self.speller.least
                both = f"{left}-{right}".lower() in words or (len(left) > 2 and left.lower() in words and right.lower() in words)
                if right[0].islower() and (sure or not both and (page.scanned or self.speller.is_word(whole))):
                    divided += 1
                    lines[last] = lines[last][: end.start()] + left + right
                    s = s[start.end() :].lstrip(" ") if s[start.end() : start.end() + 1] in ("", " ") else self._glue(lines, last, s[start.end() :])
                    if not s:
                        continue
                    del lines[last + 1 :]
            lines.append(s)
        return lines, divided

    @staticmethod
    def _glue(lines: list[str], last: int, rest: str) -> str:
        """Stops that belong to the word just put together go with it."""
        k = 0
        while k < len(rest) and not rest[k].isspace():
            k += 1
        lines[last] += rest[:k]
        return rest[k:].lstrip()

    def join_spaced(self, text: str) -> str:
        def join(m: re.Match) -> str:
            whole = m[1].replace(" ", "")
            if not any(map(str.isalpha, whole)):
                return m[0]
            low, known = whole.lower(), self.speller.is_word
            if len(whole) > 5 and not known(low):
                for k in range(2, len(whole) - 1):
                    if known(low[:k]) and known(low[k:]):
                        return f"{whole[:k]} {whole[k:]}"
            return whole

        return _spaced(join, text) if " " in text else text

    def find(self, text: str) -> list[str]:
        """Kinds of noise in a text."""
        found = []
        page = read_page(text) if "\n" in text else None
        if page:
            lines, divided = self.unhyphenate(page) if page.scanned else (page.lines, 0)
            if divided:
                found.append("hyphenation")
            body = "\n".join(lines)
        else:
            body = text
        if len(self.misread_words(body)) >= 3:
            found.append("misread")
        if page and page.page_numbers:
            found.append("page_number")
        if page and page.headers:
            found.append("running_header")
        return found

    def repair(self, text: str) -> str:
        """Continuous paragraphs, an empty line between them; a text without noise stays as it is, line breaks included."""
        page = read_page(text)
        if not page.scanned:
            return self.respell(self.join_spaced(text))
        lines, divided = self.unhyphenate(page)
        if not (divided or page.page_numbers or page.headers) and self.join_spaced(text) == text and self.respell(text) == text:
            return text
        width = max(map(len, lines), default=0)
        paragraphs: list[list[str]] = [[]]
        for k, s in enumerate(lines):
            s = self.join_spaced(s)
            if not s:
                ended = not paragraphs[-1] or _stop_end(paragraphs[-1][-1])
                after = next((x for x in lines[k + 1 :] if x), "")
                if ended or not after[:1].islower():
                    paragraphs.append([])
                continue
            if paragraphs[-1]:
                before = paragraphs[-1][-1]
                first = s.split(None, 1)[0]
                # The next word would have fitted: the line was ended on purpose.
                short = len(before) + 1 + len(first) <= 0.8 * page.width
                if (_stop_end(before) and short) or _item(s) or (len(paragraphs[-1]) == 1 and not _stop_end(before) and short and s[0].isupper() and before[0].isupper()):
                    paragraphs.append([])
            paragraphs[-1].append(s)
        body = "\n\n".join(" ".join(p) for p in paragraphs if p)
        return self.respell(body)

    def respell(self, text: str) -> str:
        choice = self.choices(_token(text.lower()), text)
        return _TOKEN.sub(lambda m: _like(choice[m[0].lower()], m[0]) if m[0].lower() in choice else m[0], text) if choice else text


_TOKEN = re.compile(_token.__self__.pattern)
_spaced = _spaced.sub


def _fields(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("t")) for f in fields])
    return df.select(F.col(key).alias("k"), F.inline(each)).where(F.length("t") > 0)


def learn_vocabulary(
    df: DataFrame, key: str = "rec_no", fields: tuple[str, ...] = ("description", "ko_content_flat"), typed: str = "ko_content_flat", least: int = 3, share: float = 5e-5
) -> tuple[Vocabulary, TypeModel]:
    """Vocabulary with document frequencies and pairs over all texts of the fields, and the label model of ``typed``, in one pass.

    Only words of at least max(``least``, ``share`` x texts) texts are collected. A text has some hundred different words, so at
    most (different words of an average text) / ``share`` words can be that frequent, whatever the size of the corpus. Pairs of neighbouring words are
    counted in ``CELLS`` cells, once a task, so each task adds at most that many small rows to the shuffle.
    """
    schema = pa.schema([("w", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counted = Pairs(), np.zeros(CELLS, np.int64)
        for batch in batches:
            seen: Counter = Counter()
            for f, t in zip(batch["f"].to_pylist(), batch["t"].to_pylist()):
                if t.isspace():
                    continue
                words = _token(t.lower())
                seen.update(set(words))
                seen["\0"] += 1
                if len(words) > 1:
                    np.add.at(counted, pairs.cells(words), 1)
                if f == typed:
                    seen[f"\0{statistics(t).pattern}"] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)
        used = np.flatnonzero(counted)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array([f"\1{i}" for i in used.tolist()], pa.string()), pa.array(counted[used])], schema=schema)

    counts = keep(_fields(df, key, fields).select("f", "t").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    texts = counts.where(F.col("w") == "\0").collect()
    floor = max(least, int(share * (texts[0]["n"] if texts else 0)))
    words, patterns, pairs = {}, {}, np.zeros(CELLS, np.int64)
    for w, n in counts.where((F.col("n") >= floor) | (F.substring("w", 1, 1) < " ")).toLocalIterator():
        if w[:1] == "\1":
            pairs[int(w[1:])] = n
        elif w[:1] != "\0":
            words[w] = n
        elif len(w) > 1:
            patterns[int(w[1:])] = n
    counts.unpersist()
    return Vocabulary(words, floor, np.minimum(pairs, 2**31 - 1).astype(np.int32)), learn(patterns)


def _map_texts(df: DataFrame, key: str, fields: tuple[str, ...], typed: str, vocabulary: Vocabulary, types: TypeModel, work_one, schema: str, left_out: tuple[str, ...]) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, types))

    def make():
        reader, type_of = _reader(shared)

        def work(keys, names, texts):
            rows = []
            for k, f, t in zip(keys, names, texts):
                if f == typed and (t.isspace() or type_of(statistics(t))[0] in left_out):
                    rows += work_one(reader, k, f, t, True)
                else:
                    rows += work_one(reader, k, f, t, False)
            return list(zip(*rows)) or [[]] * (schema.count(",") + 2)

        return work

    return map_columns(_fields(df, key, fields), make, f"k {kind}, {schema}").withColumnRenamed("k", key)


_readers: dict = {}


def _reader(shared):
    """One reader per worker and vocabulary: its memory of words serves all tasks."""
    if shared.id not in _readers if hasattr(shared, "id") else True:
        _readers.clear()
        vocabulary, types = shared.value
        made = Reader(vocabulary), TypeOf(types)
        _readers[getattr(shared, "id", 0)] = made
    return _readers[getattr(shared, "id", 0)]


def repair(df: DataFrame, key: str = "rec_no", fields: tuple[str, ...] = ("description", "ko_content_flat"), typed: str = "ko_content_flat") -> DataFrame:
    """(key, field_name, noise, clean_text) of every non-empty text.

    Texts of ``typed`` that are no prose, and blank ones, come out unchanged and without noise. Null and empty texts give
    no row, repeated rows repeat. Whole texts are read, however long.
    """
    vocabulary, types = learn_vocabulary(df, key, fields, typed)

    def one(reader, k, f, t, out):
        return [(k, f, [], t)] if out else [(k, f, reader.find(t), reader.repair(t))]

    return _map_texts(df, key, fields, typed, vocabulary, types, one, "field_name string, noise array<string>, clean_text string", ("list", "table", "junk"))


def noisy(df: DataFrame, key: str = "rec_no", fields: tuple[str, ...] = ("description", "ko_content_flat"), typed: str = "ko_content_flat") -> DataFrame:
    """(key, field_name, noise): one row per text and kind of noise in it; texts of ``typed`` that are no prose are left out."""
    vocabulary, types = learn_vocabulary(df, key, fields, typed)

    def one(reader, k, f, t, out):
        return [] if out else [(k, f, noise) for noise in reader.find(t)]

    return _map_texts(df, key, fields, typed, vocabulary, types, one, "field_name string, noise string", ("list", "table", "junk"))
