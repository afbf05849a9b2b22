"""Problem 7: several values packed in one field.

Which signs separate values is inferred for each source and field from the whole table: a candidate counts
by how consistently it cuts strings into several pieces, by how regular the pieces' type is, and by how many of the pieces
also stand elsewhere as whole values. Then every string is cut at the signs of its source, outside quotes, and exploded with position.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns
from granary.session import keep

#: Candidate separators as patterns, and whether one is commonly a separator.
CANDIDATES = {
    ";": (";", True), "；": ("；", True), ",": (r"(?<!\d),|,(?!\d)", True), "|": (r"\|", True), "•": ("•", True), "line": (r"\n", True), "tab": (r"\t", True),
    "spaced /": (r"(?<=\s)/(?=\s)", True), "/": (r"(?<=\S)/(?=\S)", False), "-": (r"(?<=\S)-(?=\S)", False), "&": ("&", False), ":": (":", False), ".": (r"\.", False), "+": (r"\+", False),
}
_QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "'": "'", "‘": "’"}
_mark = re.compile(r"\s*(?:[-*•▪‣–—·]|\(?\d{1,3}[.)])\s+")
_blank = re.compile(r"\s+")
_spans = re.compile(r"\"(?:[^\"\\]|\\.|\"\")*\"|“[^”]*”|«[^»]*»|(?<!\w)'[^'\n]*'(?!\w)")


class Splitter:
    """Cuts strings at a set of separators, outside quotes."""

    def __init__(self, separators: frozenset[str]):
        patterns = [CANDIDATES[s][0] for s in CANDIDATES if s in separators]
        self.at = re.compile("|".join(patterns) if patterns else r"(?!)")

    def _quoted(self, text: str, i: int) -> tuple[str, int] | None:
        """(content, end) of a quoted value that begins at i and ends before a separator or the end."""
        close = _QUOTES.get(text[i])
        if close is None:
            return None
        j, out = i + 1, []
        while j < len(text):
            c = text[j]
            if c == "\\" and j + 1 < len(text) and text[j + 1] in "\"'\\":
                out.append(text[j + 1])
                j += 2
                continue
            if c in close:
                if c == text[j + 1 : j + 2] and c in "\"'":  # doubled inside, or an empty value
                    out.append(c)
                    j += 2
                    continue
                k = j + 1
                while k < len(text) and text[k] in " \xa0\t" and not self.at.match(text, k):
                    k += 1
                if k == len(text) or self.at.match(text, k) or (text[k] == "]" and k == len(text) - 1):
                    return "".join(out), k
                if c != "'":
                    return None
            out.append(c)
            j += 1
        return None

    def __call__(self, text: str) -> list[str]:
        """Values of a string, cleaned; empty ones left out."""
        text = text.strip()
        if len(text) > 1 and text[0] == "[" and text[-1] == "]":
            text = text[1:-1]
        values, i, n = [], 0, len(text)
        while i <= n:
            # One separator first: a mark of enumeration is not taken for one.
            start = i
            while start < n and text[start].isspace() and not self.at.match(text, start):
                start += 1
            if m := _mark.match(text, start):
                start = m.end()
            got = self._quoted(text, start) if start < n else None
            if got:
                value, end = got
                values.append(_blank.sub(" ", value).strip())
            else:
                end = start
                while end < n:
                    if m := self.at.match(text, end):
                        break
                    if (text[end] in "\"“«" and (end == start or not text[end - 1].isalnum())) and (q := _spans.match(text, end)):
                        end = q.end()
                    else:
                        end += 1
                values.append(clean_value(text[start:end]))
            m = self.at.match(text, end)
            i = m.end() if m else n + 1
        return [v for v in values if v]


def clean_value(value: str) -> str:
    """A value trimmed, with single blanks, without enclosing quotes, brackets and list marks."""
    value = _blank.sub(" ", value).strip()
    while value:
        before = value
        if m := _mark.match(value):
            value = value[m.end() :].strip()
        if len(value) > 1 and value[0] in _QUOTES and value[-1] in _QUOTES[value[0]]:
            value = value[1:-1].replace('""', '"').replace('\\"', '"').strip()
        elif len(value) > 1 and (value[0], value[-1]) in (("(", ")"), ("[", "]"), ("{", "}"), ("<", ">")) and value[0] not in value[1:-1]:
            value = value[1:-1].strip()
        if value == before:
            return value
    return value


_text_like = re.compile(r"[^\W\d_][\w '’&/().-]*").fullmatch
_number_like = re.compile(r"[\d.,%+-]+").fullmatch


def piece_type(piece: str) -> str:
    """What a piece looks like: text of one word, of a few words, or of many, a number, or anything else."""
    if _text_like(piece):
        n = piece.count(" ")
        return "word" if not n else "phrase" if n < 6 else "prose"
    return "number" if _number_like(piece) else "other"


def _key(value: str) -> str:
    return clean_value(value).lower()


def _fields(df: DataFrame, key: str, fields: tuple[str, ...], source: str | None) -> DataFrame:
    """(k, s, f, items): arrays and strings alike as arrays."""
    each = []
    for f in fields:
        kind = df.schema[f].dataType.simpleString()
        each.append(F.struct(F.lit(f).alias("f"), (F.col(f) if kind.startswith("array") else F.when(F.col(f).isNotNull(), F.array(f))).alias("items")))
    name = F.lower(F.trim(F.coalesce(F.col(source).cast("string"), F.lit("")))) if source else F.lit("")
    return df.select(F.col(key).alias("k"), name.alias("s"), F.inline(F.array(*each))).where("items IS NOT NULL")


#: Types that count as one when regularity is measured.
_TYPES = (("word", "phrase"), ("prose",), ("number",), ("other",))


def infer_separators(df: DataFrame, key: str, fields: tuple[str, ...], source: str | None, threshold: float = 0.25, prior: float = 8.0) -> DataFrame:
    """(s, f, separator, n_strings, several, regular, known, score, accepted) for each source, field and candidate that occurs.

    ``several`` is the share of strings that the candidate cuts into at least two non-empty pieces (consistency), ``regular`` the share of pieces of the
    commonest types, words and phrases being one, ``known`` the share of pieces that are whole values somewhere in the table; a sign is accepted where their product reaches the threshold. ``prior`` pieces of the
    usual behaviour of the sign are added, so that rare ones keep it. Pieces are counted per batch before they are shuffled, by piece, so neither a
    source nor a value that has a third of all rows goes through one task row by row.
    """
    tests = {name: re.compile(pattern) for name, (pattern, _) in CANDIDATES.items()}

    def make():
        def work(_, sources, names, lists):
            seen: Counter = Counter()
            for s, f, items in zip(sources, names, lists):
                for item in items:
                    if not item or not item.strip():
                        continue
                    bare = _spans.sub("\x00", item)
                    marked = False
                    for name, at in tests.items():
                        if not at.search(bare):
                            continue
                        pieces = [k for p in at.split(bare) if (k := _key(p)) and "\x00" not in k]
                        if CANDIDATES[name][1]:
                            marked = True
                        seen[s, f, name, "\x01several" if len(pieces) > 1 else "\x01one"] += 1
                        for p in pieces if len(pieces) > 1 else ():
                            seen[s, f, name, p] += 1
                            seen[s, f, name, "\x02" + piece_type(p)] += 1
                    if not marked:
                        seen["", "", "", _key(item)] += 1
            return [*map(list, zip(*seen)), list(seen.values())] if seen else [[]] * 5

        return work

    counts = map_columns(_fields(df, key, fields, source), make, "s string, f string, c string, piece string, n long")
    counts = keep(counts.groupBy("piece", "s", "f", "c").agg(F.sum("n").alias("n")))
    whole = counts.where("c = ''").select("piece").distinct().withColumn("whole", F.lit(True))
    judged = counts.where("c <> ''").join(whole, "piece", "left")
    is_piece = F.col("piece") >= "\x03"
    sums = judged.groupBy("s", "f", "c").agg(
        F.coalesce(F.sum(F.when(F.startswith("piece", F.lit("\x01")), F.col("n"))), F.lit(0)).alias("n_strings"),
        F.coalesce(F.sum(F.when(F.col("piece") == "\x01several", F.col("n"))), F.lit(0)).alias("n_several"),
        F.coalesce(F.sum(F.when(is_piece, F.col("n"))), F.lit(0)).alias("n_pieces"),
        F.coalesce(F.sum(F.when(is_piece & F.col("whole"), F.col("n"))), F.lit(0)).alias("n_known"),
        *[F.coalesce(F.sum(F.when(F.col("piece").isin(*["\x02" + t for t in types]), F.col("n"))), F.lit(0)).alias(f"n_{types[0]}") for types in _TYPES],
    )
    usual = F.col("c").isin([c for c, (_, yes) in CANDIDATES.items() if yes]).cast("double")
    several = (F.col("n_several") + prior) / (F.col("n_strings") + prior)
    known = (F.col("n_known") + prior * usual) / (F.col("n_pieces") + prior)
    regular = (F.greatest(*[F.col(f"n_{types[0]}") for types in _TYPES]) + prior) / (F.col("n_pieces") + prior)
    score = several * regular * known
    return sums.select("s", "f", F.col("c").alias("separator"), "n_strings", several.alias("several"), regular.alias("regular"), known.alias("known"), score.alias("score"), (score >= threshold).alias("accepted"))


def split_values(
    df: DataFrame, key: str = "rec_no", fields: tuple[str, ...] = ("keywords", "keywords_llm"), source: str | None = "ko_upload_source", only_packed: bool = False, most_sources: int = 50_000
) -> DataFrame:
    """(key, field_name, pos, keyword, packed): one row per value, numbered from 1 over all strings of the field.

    ``packed`` tells whether a string of the field holds several values; with ``only_packed`` other fields are left out. Null fields and empty pieces
    give no row, repeats stay. Separators of up to ``most_sources`` sources are broadcast, a bound that is checked: with more, rows are joined to their source's.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = _fields(df, key, fields, source)
    accepted = keep(infer_separators(df, key, fields, source).where("accepted").groupBy("s", "f").agg(F.collect_set("separator").alias("separators")))
    head = accepted.limit(most_sources + 1).collect()
    known: dict[tuple[str, str], frozenset[str]] = {}
    if len(head) > most_sources:
        rows = rows.join(accepted, ["s", "f"], "left").select("k", "s", "f", "items", "separators")
    else:
        known = {(r["s"], r["f"]): frozenset(r["separators"]) for r in head}
    shared = df.sparkSession.sparkContext.broadcast(known)
    usual = frozenset(c for c, (_, yes) in CANDIDATES.items() if yes)

    def make():
        made: dict[frozenset[str], Splitter] = {}

        def work(keys, sources, names, lists, joined=None):
            out = []
            for i, (k, s, f, items) in enumerate(zip(keys, sources, names, lists)):
                # A sign that the source does not show has its usual meaning.
                own = frozenset(joined[i] or usual) if joined else shared.value.get((s, f), usual)
                if own not in made:
                    made[own] = Splitter(own)
                parts = [made[own](item) for item in items if item]
                packed = any(len(p) > 1 for p in parts)
                if packed or not only_packed:
                    out += [(k, f, pos, value, packed) for pos, value in enumerate((v for p in parts for v in p), 1)]
            return list(zip(*out)) or [[]] * 5

        return work

    return map_columns(rows, make, f"k {kind}, field_name string, pos int, keyword string, packed boolean").withColumnRenamed("k", key)
