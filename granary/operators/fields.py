"""Sub-scores of a record's descriptive fields, and deliberate defects that must lower them.

A record becomes one row per variant and field; all checks are expressions on that row. What needs the whole table (texts shared by
projects, document frequencies, quantiles) is aggregated first and joined by text or term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.arrow import map_columns
from granary.functions.numeric import at_least, at_most, clamp
from granary.operators import retrieval as R
from granary.operators.quality import lix
from granary.operators.ranks import quantiles
from granary.operators.sentences import _is_acronym, explained
from granary.session import keep

FIELDS = ("title", "subtitle", "description", "keywords")
# Limits of fields, the look of internal references, and the signs that may end a description.
MOST_TITLE_SIGNS, LEAST_DESCRIPTION, MOST_DESCRIPTION = 150, 50, 5000
INTERNAL = r"(?i)\b(?:deliverable|milestone|task|work\s*package)\s*\d+(?:\.\d+)*\b|\b(?:wp|ms)\s?\d+\b|\b[dt]\s?\d+\.\d+\b"
ENDS = r"[.!?)\]\"'»”’]$"
EASY_LIX, HARD_LIX, LIX_WORDS = 40.0, 60.0, 40


def terms(items: Column) -> Column:
    """Keywords of a list whose items may hold several between semicolons or commas; trimmed, without empty ones."""
    parts = F.flatten(F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.split(x, "[;,]")))
    return F.filter(F.transform(parts, lambda x: T.one_line(x)), lambda x: x != "")


def _items(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    return F.col(column) if kind.startswith("array") else F.when(T.not_blank(F.col(column)), F.array(column))


def long_fields(df: DataFrame, key: str, suffixes: dict[str, str] | None = None, project: str = "project_id", file_name: str = "ko_object_name", only: tuple[str, ...] = FIELDS, more_columns: dict[str, Column] | None = None, others: bool = True) -> DataFrame:
    """(key, project, file, variant, field, raw, items, found, text, title, others): one row per variant and field of every record, empty ones included.

    ``text`` is the field in one line, '' where empty; ``others`` are the variant's other texts in lower case, keywords aside; ``items`` the keywords as kept, ``found`` one by one.
    ``only`` names the fields that get rows, ``more_columns`` are carried along; without ``others``, that and ``title`` are left empty and only the named fields are read.
    """
    wide, each, more_columns = {}, [], more_columns or {}
    read = FIELDS if others else only
    for variant, suffix in (suffixes or {"original": "", "improved": "_llm"}).items():
        column = {f: f"{f}{suffix}" if f"{f}{suffix}" in df.columns else f for f in FIELDS}
        name = lambda f, what, v=variant: f"_{v}_{f}_{what}"
        wide |= {name(f, "raw"): F.col(column[f]) for f in read if f not in ("description", "keywords")}
        wide |= {name("description", "raw"): T.rich_to_plain(F.col(column["description"]))} if "description" in read else {}
        wide |= {name("keywords", "items"): _items(df, column["keywords"])} if "keywords" in only else {}
    first = df.select(F.col(key).alias("key"), F.trim(F.coalesce(F.col(project), F.lit(""))).alias("project"), F.coalesce(F.col(file_name), F.lit("")).alias("file"), *[c.alias(n) for n, c in (more_columns | wide).items()])
    more = {}
    for n in wide:
        more |= {n.replace("_items", "_found"): terms(F.col(n))} if n.endswith("_items") else {n.replace("_raw", "_text"): T.one_line(F.col(n))}
    first = first.select("*", *[c.alias(n) for n, c in more.items()])
    none = F.lit(None).cast("array<string>")
    for variant in suffixes or {"original": "", "improved": "_llm"}:
        at = lambda f, what, v=variant: F.col(f"_{v}_{f}_{what}")
        joined = F.array_join(at("keywords", "found"), ", ")
        for f in only:
            mine = (joined, at(f, "items"), at(f, "found"), joined) if f == "keywords" else (at(f, "raw"), none, none, at(f, "text"))
            rest = F.array(*[F.lower(at(o, "text")) for o in FIELDS if o not in (f, "keywords")]) if others else F.array().cast("array<string>")
            title = at("title", "text") if others else F.lit("")
            each.append(F.struct(F.lit(variant).alias("variant"), F.lit(f).alias("field"), *[c.alias(n) for c, n in zip(mine, ("raw", "items", "found", "text"))], title.alias("title"), rest.alias("others")))
    return first.select("key", "project", "file", *more_columns, F.inline(F.array(*each)))


def _share(checks: list[Column | None]) -> Column:
    """Share of the checks that hold; checks that are null do not count."""
    used = F.array_compact(F.array(*[c.cast("int") for c in checks]))
    return F.try_divide(F.aggregate(used, F.lit(0), lambda a, x: a + x), F.size(used))


def _letters_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def completeness(rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``completeness``: 0 for an empty field, else the share of checks that hold: no file name, no copy of another field, not shared by several
    projects, and for titles no internal reference and not the file's name; for keywords that there are any.

    Texts of several projects are found by one aggregate over (variant, field, text); only those are joined back.
    With ``among``, they are found there instead of in the rows.
    """
    low = F.lower("text")
    shared = (
        (rows if among is None else among).where((F.col("text") != "") & (F.col("field") != "keywords") & (F.col("project") != ""))
        .groupBy("variant", "field", low.alias("low")).agg((F.min("project") != F.max("project")).alias("shared")).where("shared")
    )
    rows = rows.withColumn("low", low).join(shared, ["variant", "field", "low"], "left")
    stem = _letters_only(F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[A-Za-z0-9]{2,5}$", ""))
    is_title, is_text = F.col("field") == "title", F.col("field") != "keywords"
    t = F.col("text")
    file_like = (~F.contains(t, F.lit(" ")) & F.regexp_like(t, F.lit("[_.]"))) | F.regexp_like(t, F.lit(r"\.(?:[A-Za-z][A-Za-z0-9]{2,3}|[0-9][A-Za-z][A-Za-z0-9]{1,2}|[0-9]{2}[A-Za-z][A-Za-z0-9]?|[0-9]{3}[A-Za-z])$"))
    checks = [
        F.when(is_title, ~F.regexp_like(t, F.lit(INTERNAL))), F.when(is_title & (stem != ""), _letters_only(t) != stem), F.when(is_text, ~file_like),
        F.when(is_text, ~F.array_contains("others", F.col("low"))), F.when(is_text, F.col("shared").isNull()), F.when(~is_text, t != ""),
    ]
    return rows.withColumn("completeness", F.when(t == "", F.lit(0.0)).otherwise(_share(checks))).drop("low", "shared")


def formatting(rows: DataFrame, most_words: int = 5) -> DataFrame:
    """``rows`` with ``formatting``: the share of form checks that hold, null for an empty field.

    Texts: clean white space, not all capitals; titles and subtitles one line, no loose end, not all small letters; descriptions no break inside a sentence, a capital
    first, a stop last. Keywords: one term an item, no repeats, no trivial terms, at most ``most_words`` words each, no stop at the end.
    """
    t, raw, field = F.col("text"), F.coalesce("raw", F.lit("")), F.col("field")
    title, keywords = field.isin("title", "subtitle"), field == "keywords"
    up, low = F.regexp_count(t, F.lit(r"\p{Lu}")), F.regexp_count(t, F.lit(r"\p{Ll}"))
    text, about = ~keywords, field == "description"
    found = F.col("found")
    small = F.transform(found, lambda x: F.lower(x))
    checks = [
        F.when(text, (raw == F.regexp_replace(raw, r"^\s+|\s+$", "")) & ~F.regexp_like(raw, F.lit("  |\t"))),
        F.when(text, ~((up + low >= 4) & F.contains(t, F.lit(" ")) & (up > 0.8 * (up + low)))),
        F.when(title, ~F.contains(raw, F.lit("\n"))), F.when(title, ~F.regexp_like(t, F.lit("[,;:]$"))), F.when(title, ~((low > 0) & (up == 0))),
        F.when(about, ~F.regexp_like(raw, F.lit(r"[^\s.!?:;…]\n[ \t]*\p{Ll}"))), F.when(about, ~F.regexp_like(t, F.lit(r"^\P{L}*\p{Ll}"))), F.when(about, F.regexp_like(t, F.lit(ENDS))),
        F.when(keywords, ~F.exists("items", lambda x: F.regexp_like(x, F.lit("[;,|]")))), F.when(keywords, F.size(F.array_distinct(small)) == F.size(small)),
        F.when(keywords, F.forall(found, lambda x: (F.length(x) >= 2) & F.regexp_like(x, F.lit(r"\p{L}")))), F.when(keywords, F.forall(found, lambda x: F.size(F.split(x, " ")) <= most_words)),
        F.when(keywords, ~F.exists(found, lambda x: F.regexp_like(x, F.lit("[.;:,!?]$")))),
    ]
    return rows.withColumn("formatting", F.when(t != "", _share(checks)))


def length_fit(rows: DataFrame) -> DataFrame:
    """``rows`` with ``length``: 1 within the field's limits, falling off beyond them; null for fields without limits."""
    n = F.length("text")
    title = at_most(F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("double"), float(MOST_TITLE_SIGNS))
    about = F.least(at_most(n.cast("double"), float(MOST_DESCRIPTION)), at_least(n.cast("double"), float(LEAST_DESCRIPTION)))
    return rows.withColumn("length", F.when(F.col("field") == "title", title).when(F.col("field") == "description", about))


def clarity(rows: DataFrame) -> DataFrame:
    """``rows`` with ``clarity``: the mean of: no cut at the end; the share of words that are no acronym left open by the field's record; easy reading of descriptions.

    Null for an empty field. ``rows`` have ``context``, the texts in which acronyms may be explained; only rows with an acronym send it to the search.
    """
    kind = rows.schema.simpleString()
    names = rows.columns
    has = F.regexp_like("text", F.lit(r"(?:^|[\s(\[\"'])[A-Z0-9][A-Z0-9&-]*[A-Z0-9]"))
    packed = rows.select(F.struct(*names).alias("r"), F.when(has, F.col("text")).alias("t"), F.when(has, F.col("context")).alias("c"))

    def make():
        def left_open(text, context):
            if text is None:
                return 0.0
            tokens = [x for t in text.split() if (x := t.strip(".,;:()[]\"'"))]
            shorts = [t for t in tokens if _is_acronym(t)]
            if not shorts:
                return 0.0
            words = [w for w in _words(context or "") if not w.isupper()]
            return sum(1 for t in shorts if not explained(t, words)) / len(tokens)

        return lambda records, texts, contexts: [records, [left_open(t, c) for t, c in zip(texts, contexts)]]

    opened = map_columns(packed, make, f"r {kind}, open double").select("r.*", "open")
    t = F.col("text")
    cut = F.regexp_like(t, F.lit(r"(?:\.\.\.|…|[,;:\-–—(])$"))
    score = lix(t, 10)
    easy = F.when((F.col("field") == "description") & (F.size(F.split(t, " ")) >= LIX_WORDS), clamp((HARD_LIX - score) / (HARD_LIX - EASY_LIX)))
    parts = F.array_compact(F.array(F.when(F.col("field") != "keywords", (~cut).cast("double")), 1 - F.col("open"), easy))
    return opened.withColumn("clarity", F.when(t != "", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))).drop("open")


def _words(text: str) -> list[str]:
    from granary.operators.sentences import _context_words

    return _context_words(text)


def density(rows: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``density``: how specific the field's words are in the mean, between the 5th and 95th percentile of the field over the reference rows.

    ``reference`` (the rows themselves, if none) gives frequencies and anchors. Null for a field without words; 0.5 where the anchors coincide.
    """
    base = rows if reference is None else reference
    each = base.where("text <> ''").select("key", "variant", "field", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    freq = keep(each.groupBy("term").agg(F.countDistinct("key", "variant", "field").alias("df")))
    n = base.where("text <> ''").agg(F.count("*").alias("n"))  # one row

    def means(of: DataFrame) -> DataFrame:
        found = of.select("key", "variant", "field", F.explode(T.words(F.col("text"))).alias("term")).join(freq, "term", "left").crossJoin(F.broadcast(n))
        return found.groupBy("key", "variant", "field").agg(F.avg(R.specificity(F.coalesce("df", F.lit(0)), F.col("n"))).alias("mean"))

    anchors = quantiles(means(base), "mean", ["field"], {"lo": 0.05, "hi": 0.95}).drop("n")  # one row per field
    scored = means(rows).join(F.broadcast(anchors), "field")
    value = F.when(F.col("hi") > F.col("lo"), clamp((F.col("mean") - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(0.5)
    return rows.join(scored.select("key", "variant", "field", value.alias("density")), ["key", "variant", "field"], "left")


def usefulness(rows: DataFrame, key_terms: DataFrame) -> DataFrame:
    """``rows`` with ``usefulness``: the mean of: the share of the file's characteristic words that the field has; for keywords the share of words that do not repeat;
    for subtitle and description how little they repeat the title. Null where none is known.

    ``key_terms`` has (key, terms), at most one row per record.
    """
    known = rows.join(key_terms, "key", "left")
    words = T.words(F.col("text"))
    some = F.col("text") != ""
    covered = F.when(some & (F.size("terms") > 0), T.coverage(F.col("terms"), words))
    varied = F.when((F.col("field") == "keywords") & (F.size("found") >= 2), F.try_divide(F.size(F.array_distinct(words)), F.size(words)))
    adds = F.when(some & F.col("field").isin("subtitle", "description") & (F.col("title") != ""), 1 - T.jaccard(words, T.words(F.col("title"))))
    parts = F.array_compact(F.array(covered, varied, adds))
    return known.withColumn("usefulness", F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))).drop("terms")


def shared_with_text(rows: DataFrame, key_words: DataFrame) -> DataFrame:
    """``rows`` with ``consistency``: the share of the field's words of over three letters that the record's own reference text has; null without such words or text.

    ``key_words`` has (key, ref), the different words of the reference. A stand-in for entailment by a model, for which ``providers`` is the seam.
    """
    own = F.array_distinct(F.filter(T.words(F.col("text")), lambda w: F.length(w) > 3))
    joined = rows.join(key_words, "key", "left")
    return joined.withColumn("consistency", F.when(F.size("ref") > 0, F.try_divide(F.size(F.array_intersect(own, "ref")), F.size(own)))).drop("ref")


def noise(rows: DataFrame) -> DataFrame:
    """``rows`` with ``noise``: the share of tokens that are no debris; null without tokens."""
    tokens = F.filter(F.split(T.one_line(F.col("raw")), " "), lambda x: x != "")
    debris = F.size(F.filter(tokens, lambda x: F.regexp_like(x, F.lit(r"<[^>]+>|&[A-Za-z]+;|&#\d+;|(?i)https?://|www\.|\S+@\S+\.\w+|\x{fffd}|Ã[\x{80}-\x{bf}]|â€|^[^\p{L}\p{N}]{2,}$"))))
    return rows.withColumn("noise", F.when(F.size(tokens) > 0, 1 - debris / F.size(tokens)))


SUBSCORES = ("length", "completeness", "noise", "formatting", "consistency", "density", "clarity", "usefulness")


def field_scores(df: DataFrame, key: str, reference: str, suffixes: dict[str, str] | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """(key, variant, field, length, completeness, noise, formatting, consistency, density, clarity, usefulness): sub-scores from 0 to 1 of every field of every record.

    A sub-score is null where it cannot be judged; of an empty field only completeness is known, as 0. ``reference`` is the column that tells what the
    file says. ``corpus``, if given, provides what the table as a whole says: characteristic words, frequencies and anchors; so altered records are measured by the corpus as it was.
    """
    corpus = df if corpus is None else corpus
    rows = long_fields(df, key, suffixes)
    text = df.select(F.col(key).alias("key"), T.one_line(F.col(reference)).alias("_ref"))
    words = text.select("key", F.array_distinct(T.words(F.col("_ref"))).alias("ref"))
    posted = R.postings(corpus, key, F.col(reference))
    size = corpus.agg(F.count("*").alias("n_docs"))
    freq = R.document_frequency(keep(posted))
    mine = keep(R.postings(df, key, F.col(reference))) if corpus is not df else posted
    ranked = R.key_terms_by(mine, freq, size, 10)
    best = ranked.groupBy(F.col("doc").alias("key")).agg(F.collect_list("term").alias("terms"))  # ten a record
    rows = length_fit(formatting(completeness(rows)))
    context = F.concat_ws(" ", "_ref", F.array_join("others", " "))
    rows = clarity(rows.join(text, "key", "left").withColumn("context", context).drop("_ref")).drop("context")
    rows = noise(rows)
    rows = density(shared_with_text(usefulness(rows, best), words), None if corpus is df else long_fields(corpus, key, suffixes))
    return rows.select("key", "variant", "field", *SUBSCORES)


def _pool(df: DataFrame, key: str, donors: int) -> DataFrame:
    """One row: the donors of texts for defects, the first by a hash of those that have all fields."""
    pool = df.where(T.not_blank(F.col("title")) & T.not_blank(F.col("description")) & (F.size("keywords") > 0))
    return pool.orderBy(F.xxhash64(key), key).limit(donors).agg(F.collect_list(F.struct(F.col("project_id").alias("p"), F.col("title").alias("t"), F.col("description").alias("d"), F.col("keywords").alias("k"))).alias("_pool"))


def defects(df: DataFrame, key: str, generic: list[str], donors: int = 40, only: set[str] | None = None, pool: DataFrame | None = None) -> DataFrame:
    """The records once per deliberate defect, with ``defect``, ``sub`` and ``defect_field``, which name it, the sub-score it aims at and the field it is in.

    Donors of texts from another project are drawn from ``donors`` records, the first by a hash, which bounds what is broadcast; a record without a donor of
    another project has no such defect. ``generic`` are words that say nothing. ``only`` names the defects that are made, ``pool`` gives donors that are drawn already.
    """
    title, about = T.one_line(F.col("title")), T.one_line(T.rich_to_plain(F.col("description")))
    rows = df.crossJoin(F.broadcast(_pool(df, key, donors) if pool is None else pool))  # one row
    other = F.filter("_pool", lambda x: ~x["p"].eqNullSafe(F.col("project_id")))
    rows = rows.withColumn("_donor", F.when(F.size(other) > 0, F.get(other, F.pmod(F.xxhash64(key), F.size(other)).cast("int"))))
    words, parts = F.split(title, " "), F.split(about, " ")
    capital = F.transform(terms(F.col("keywords")), lambda x: F.upper(x))
    none = F.lit(None).cast("string")
    nothing = F.lit(None).cast("array<string>")

    def one(defect, sub, field, value):
        return defect, F.struct(
            F.lit(defect).alias("defect"), F.lit(sub).alias("sub"), F.lit(field).alias("defect_field"), (none if field == "keywords" else value).alias("value"), (value if field == "keywords" else nothing).alias("values")
        )

    each = (
        one("padded", "length", "title", F.repeat(F.concat(title, F.lit(" ")), F.greatest(F.lit(2), F.expr("0") + F.ceil(320 / F.greatest(F.lit(1), F.length(title))).cast("int") + 1))),
        one("file name", "completeness", "title", F.concat(F.array_join(F.slice(words, 1, 3), "_"), F.lit("_final.pdf"))),
        one("debris", "noise", "description", F.concat(about, F.lit(" &amp;amp; http://example.org/x �� ####"))),
        one("capitals", "formatting", "title", F.upper("title")),
        one("other description", "consistency", "description", F.col("_donor.d")), one("other title", "consistency", "title", F.col("_donor.t")),
        one("common words", "density", "title", F.array_join(F.slice(F.array(*[F.lit(w) for w in generic]), 1, F.greatest(F.lit(3), F.size(words))), " ")),
        one("cut off", "clarity", "description", F.concat(F.regexp_replace(F.array_join(F.slice(parts, 1, F.greatest(F.lit(3), (F.size(parts) * 0.6).cast("int"))), " "), r"[.!?;:,]+$", ""), F.lit(" ..."))),
        one("other keywords", "usefulness", "keywords", F.col("_donor.k")), one("doubled keywords", "usefulness", "keywords", F.concat(terms(F.col("keywords")), capital)),
        one("other title for coverage", "usefulness", "title", F.col("_donor.t")), one("copied title", "completeness", "subtitle", F.when(T.not_blank(F.col("subtitle")), title)),
    )
    made = rows.where(T.not_blank(F.col("title")) & T.not_blank(F.col("description")) & (F.size(terms(F.col("keywords"))) > 0)).withColumn("_d", F.explode(F.array(*[d for name, d in each if only is None or name in only]))).where("_d.value IS NOT NULL OR _d.values IS NOT NULL")
    put = lambda f: F.when(F.col("_d.defect_field") == f, F.col("_d.values" if f == "keywords" else "_d.value")).otherwise(F.col(f)).alias(f)
    kept = [put(c) if c in FIELDS else F.col(c) for c in df.columns]
    return made.select(*kept, "_d.defect", "_d.sub", "_d.defect_field")


def _outcome() -> Column:
    change = F.col("after") - F.col("before")
    return (
        F.when(change.isNull(), "not_evaluable").when(change < -1e-9, "dropped").when(change > 1e-9, "rose").when(F.col("before") <= 1e-9, "unchanged_at_floor").otherwise("unchanged")
    )


def verdicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, defect, sub, field, before, after, outcome) of (key, sub, field, value) and (key, defect, sub, field, value): dropped, unchanged, unchanged_at_floor, rose, or
    not_evaluable where either is null."""
    both = after.withColumnRenamed("value", "after").join(before.withColumnRenamed("value", "before"), ["key", "sub", "field"])
    return both.select("key", "defect", "sub", "field", "before", "after", _outcome().alias("outcome"))


# The defects by the sub-score that they aim at, with the fields they are in.
_AIMS = {
    "length": {"padded": "title"}, "completeness": {"file name": "title", "copied title": "subtitle"}, "noise": {"debris": "description"}, "formatting": {"capitals": "title"},
    "consistency": {"other description": "description", "other title": "title"}, "density": {"common words": "title"}, "clarity": {"cut off": "description"},
    "usefulness": {"other keywords": "keywords", "doubled keywords": "keywords", "other title for coverage": "title"},
}


def self_test(df: DataFrame, key: str, reference: str) -> DataFrame:
    """(key, defect, sub, field, before, after, outcome): every record's defects and what they do to the sub-score they aim at. ``key`` is unique.

    Each sub-score is made for the fields that its defects are in and for nothing else; values are those of field_scores over all records, and over all defects with
    the corpus as it was. Altered records are made anew for each sub-score, so no copies of texts are kept or shuffled.
    """
    plain = df.withColumn(key, F.col(key).cast("string"))
    ref = T.one_line(F.col(reference))
    whole = {"original": ""}
    fields = long_fields(plain, key, whole, others=False).where("text <> ''")
    freq = keep(fields.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    generic = [r["term"] for r in freq.orderBy(F.desc("df"), "term").limit(20).collect()]
    pool = keep(_pool(df, key, 40))

    def altered(names: set[str], only: tuple[str, ...], **more) -> DataFrame:
        made = defects(df, key, generic, only=names, pool=pool).withColumn(key, F.col(key).cast("string"))
        carried = {"defect": F.col("defect"), "aim": F.col("defect_field")} | more.pop("more_columns", {})
        return long_fields(made, key, whole, only=only, more_columns=carried, **more)

    def rows(sub: str, **more) -> tuple[DataFrame, DataFrame]:
        """The records' rows of a sub-score, and those with its defects."""
        only = tuple(f for f in FIELDS if f in _AIMS[sub].values())
        none = {"defect": F.lit(None).cast("string"), "aim": F.lit(None).cast("string")}
        more = {"others": False, "more_columns": {}} | more
        return long_fields(plain, key, whole, only=only, **(more | {"more_columns": none | more["more_columns"]})), altered(set(_AIMS[sub]), only, **more).where("field = aim")

    def both(sub: str, **more) -> DataFrame:
        before, after = rows(sub, **more)
        return before.unionByName(after)

    scores = {"length": length_fit(both("length")), "noise": noise(both("noise")), "formatting": formatting(both("formatting"))}
    # Texts of several projects: among the records, and among all that defects make of them. Those of other fields leave titles as they are, as doubled keywords do.
    before, after = rows("completeness", others=True)
    titles = {d for of in _AIMS.values() for d, f in of.items() if f in ("title", "subtitle")} | {"doubled keywords"}
    among = altered(titles, ("title", "subtitle"), others=False)
    scores["completeness"] = completeness(before).unionByName(completeness(after, among))
    own = F.array_distinct(F.filter(T.words(F.col("text")), lambda w: F.length(w) > 3))
    told = both("consistency", more_columns={"ref": F.array_distinct(T.words(ref))})
    scores["consistency"] = told.withColumn("consistency", F.when(F.size("ref") > 0, F.try_divide(F.size(F.array_intersect(own, "ref")), F.size(own))))
    read = both("clarity", others=True, more_columns={"_ref": ref}).withColumn("context", F.concat_ws(" ", "_ref", F.array_join("others", " ")))
    scores["clarity"] = clarity(read.select("key", "defect", "field", "text", "context"))
    scores["density"] = _density_of_titles(both("density"), fields, freq)
    posted = keep(R.postings(plain, key, F.col(reference)))
    ranked = R.key_terms_by(posted, R.document_frequency(posted), df.agg(F.count("*").alias("n_docs")), 10)
    scores["usefulness"] = usefulness(both("usefulness"), ranked.groupBy(F.col("doc").alias("key")).agg(F.collect_list("term").alias("terms")))  # ten a record
    every = None
    for sub, of in scores.items():
        part = of.select("key", F.lit(sub).alias("sub"), "field", "defect", F.col(sub).alias("value"))
        every = part if every is None else every.unionByName(part)
    joined = every.groupBy("key", "sub", "field").agg(
        F.max(F.when(F.col("defect").isNull(), F.col("value"))).alias("before"), F.collect_list(F.when(F.col("defect").isNotNull(), F.struct("defect", F.col("value").alias("after")))).alias("of")
    )  # at most three a field
    return joined.select("key", "sub", "field", "before", F.inline("of")).select("key", "defect", "sub", "field", "before", "after", _outcome().alias("outcome"))


def _density_of_titles(rows: DataFrame, fields: DataFrame, freq: DataFrame) -> DataFrame:
    """``rows`` with ``density``, as there: ``fields`` are the corpus' rows that have text and ``freq`` the frequencies of their words. Titles alone have such a defect."""
    n = fields.agg(F.count("*").alias("n"))  # one row

    def means(of: DataFrame, *more: str) -> DataFrame:
        found = of.select("key", "field", *more, F.explode(T.words(F.col("text"))).alias("term")).join(freq.hint("merge"), "term", "left").crossJoin(F.broadcast(n))
        return found.groupBy("key", "field", *more).agg(F.avg(R.specificity(F.coalesce("df", F.lit(0)), F.col("n"))).alias("mean"))

    anchors = quantiles(means(fields.where("field = 'title'")), "mean", ["field"], {"lo": 0.05, "hi": 0.95}).drop("n")  # one row
    value = F.when(F.col("hi") > F.col("lo"), clamp((F.col("mean") - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(0.5)
    scored = means(rows.withColumn("defect", F.coalesce("defect", F.lit(""))), "defect").join(F.broadcast(anchors), "field").select("key", "defect", value.alias("density"))
    named = rows.withColumn("_d", F.coalesce("defect", F.lit(""))).join(scored.withColumnRenamed("defect", "_d"), ["key", "_d"], "left")
    return named.drop("_d")
