"""Filters and measures of text quality, one projection over each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.lexical import with_ngram_flags
from granary.operators.retrieval import postings

# Published thresholds of web-text filters.
QUALITY = {"min_words": 50, "max_words": 100_000, "min_mean_word": 3, "max_mean_word": 10, "max_symbols": 0.1, "max_bullets": 0.9, "max_ellipses": 0.3, "min_alpha": 0.8, "min_stop_words": 2}
REPETITION = {"dup_lines": 0.3, "dup_paragraphs": 0.3, "dup_line_chars": 0.2, "dup_paragraph_chars": 0.2}
TOP_NGRAMS = {2: 0.20, 3: 0.18, 4: 0.16}
COVER_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
WEB = {"punctuated": 0.12, "dup_chars": 0.1, "short_line": 30, "short_lines": 0.67}


def share_of(items: Column, test) -> Column:
    """Share of the items that pass; 0 without items."""
    return F.coalesce(F.try_divide(F.size(F.filter(items, test)), F.size(items)), F.lit(0.0))


def total_length(items: Column) -> Column:
    return F.length(F.array_join(items, ""))


def duplicate_shares(items: Column) -> tuple[Column, Column]:
    """Share of the items, and of their characters, that repeat an earlier one."""
    once = F.array_distinct(items)
    return (
        F.coalesce(1 - F.try_divide(F.size(once), F.size(items)), F.lit(0.0)),
        F.coalesce(1 - F.try_divide(total_length(once), total_length(items)), F.lit(0.0)),
    )


def line_statistics(text: Column) -> dict[str, Column]:
    # The marks of bullets and the signs that may end a line.
    lines, paragraphs = T.lines(text), T.paragraphs(text)
    line_share, line_chars = duplicate_shares(lines)
    para_share, para_chars = duplicate_shares(paragraphs)
    return {
        "n_lines": F.size(lines).cast("long"), "n_paragraphs": F.size(paragraphs).cast("long"),
        "dup_lines": line_share, "dup_line_chars": line_chars, "dup_paragraphs": para_share, "dup_paragraph_chars": para_chars,
        "bullet_lines": share_of(lines, lambda x: F.regexp_like(x, F.lit(r"^\s*[•\-*–·▪►◦‣]\s"))),
        "ellipsis_lines": share_of(lines, lambda x: F.regexp_like(x, F.lit(r"(?:\.\.\.|…)\s*$"))),
        "punctuated_lines": share_of(lines, lambda x: F.regexp_like(x, F.lit(r"[.!?\"'”’»)…:;]\s*$"))),
        "short_lines": share_of(lines, lambda x: F.length(F.regexp_replace(x, r"^\s+|\s+$", "")) <= WEB["short_line"]),
    }


def word_statistics(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    words = T.cased_words(t)
    n = F.size(words)
    count = lambda sign: F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))
    symbols = count("#") + F.expr("0") + count("...") / 3 + count("…")
    return {
        "n_chars": F.length(t).cast("long"), "n_words": n.cast("long"),
        "mean_word": F.coalesce(F.try_divide(total_length(words), n), F.lit(0.0)),
        "symbol_share": F.coalesce(F.try_divide(symbols, n), F.lit(0.0)),
        "alpha_words": share_of(words, lambda w: F.regexp_like(w, F.lit(r"\p{L}"))),
    }


def frequent_words(df: DataFrame, text: str, lang: str, n: int = 8) -> dict[str, list[str]]:
    """The ``n`` words of letters alone that each language's texts use most; of equals the first in order. One short list per language is collected.

    Words are counted where they are read, by batch, so a language that a third of all texts have sends one row per word and batch.
    """
    counts = postings(df, lang, F.col(text)).groupBy("doc", "term").agg(F.sum("tf").alias("n")).where(F.regexp_like("term", F.lit(r"^\p{L}+$")))
    ranked = counts.withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "term"))).where(F.col("i") <= n)
    out: dict[str, list[str]] = {}
    for r in ranked.where(F.col("doc").isNotNull()).orderBy("doc", "i").collect():
        out.setdefault(r["doc"], []).append(r["term"])
    return out


def filter_flags(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """(key, statistics, one boolean per filter, n_raised).

    Null and empty texts count as texts without words. The measures are one projection and one pass of batches; the flags read them, so nothing is computed
    twice and nothing is shuffled. Fewer than two of its language's most frequent words raise ``stop_words_low``; without ``lang``, or for a null one, it is not raised.
    """
    t = F.col(text)
    stops = F.lit(None).cast("array<string>")
    if lang:
        known = frequent_words(df, text, lang)
        pairs = [x for name, words in known.items() for x in (F.lit(name), F.array(*[F.lit(w) for w in words]))]
        stops = F.try_element_at(F.create_map(*pairs), F.col(lang)) if pairs else stops
    few_stops = F.coalesce(F.size(F.array_intersect(T.words(t), stops)) < QUALITY["min_stop_words"], F.lit(False))
    flagged = with_ngram_flags(df.select(F.col(key), F.col(text).alias("_text"), few_stops.alias("_few_stops")), "_text", TOP_NGRAMS, COVER_NGRAMS)
    t = F.col("_text")
    wide = flagged.select(F.col(key), *[c.alias(n) for n, c in (word_statistics(t) | line_statistics(t)).items()], F.lower(F.coalesce(t, F.lit(""))).alias("_low"), "_few_stops", "top_ngrams_high", "cover_ngrams_high")
    c = F.col
    some = c("n_words") > 0
    several = c("n_lines") > 1
    flags = {
        "few_words": c("n_words") < QUALITY["min_words"],
        "many_words": c("n_words") > QUALITY["max_words"],
        "mean_word_out": some & ~c("mean_word").between(QUALITY["min_mean_word"], QUALITY["max_mean_word"]),
        "symbols_high": some & (c("symbol_share") > QUALITY["max_symbols"]),
        "bullets_high": c("bullet_lines") > QUALITY["max_bullets"],
        "ellipses_high": c("ellipsis_lines") > QUALITY["max_ellipses"],
        "alpha_low": some & (c("alpha_words") < QUALITY["min_alpha"]),
        "stop_words_low": c("_few_stops"),
        "dup_lines_high": c("dup_lines") > REPETITION["dup_lines"],
        "dup_paragraphs_high": c("dup_paragraphs") > REPETITION["dup_paragraphs"],
        "dup_line_chars_high": c("dup_line_chars") > REPETITION["dup_line_chars"],
        "dup_paragraph_chars_high": c("dup_paragraph_chars") > REPETITION["dup_paragraph_chars"],
        "top_ngrams_high": c("top_ngrams_high"),
        "cover_ngrams_high": c("cover_ngrams_high"),
        "web_few_punctuated": several & (c("punctuated_lines") <= WEB["punctuated"]),
        "web_dup_chars": c("dup_line_chars") >= WEB["dup_chars"],
        "web_short_lines": several & (c("short_lines") >= WEB["short_lines"]),
        "lorem_ipsum": F.contains("_low", F.lit("lorem ipsum")),
        "curly_bracket": F.contains("_low", F.lit("{")),
        "javascript": F.contains("_low", F.lit("javascript")),
    }
    kept = [n for n in wide.columns if n not in flags and n not in ("_low", "_few_stops")]
    out = wide.select(*kept, *[f.alias(n) for n, f in flags.items()])
    return out.withColumn("n_raised", sum((c(n).cast("long") for n in flags), F.lit(0).cast("long")))


FLAGS = (
    "few_words many_words mean_word_out symbols_high bullets_high ellipses_high alpha_low stop_words_low dup_lines_high dup_paragraphs_high dup_line_chars_high "
    "dup_paragraph_chars_high top_ngrams_high cover_ngrams_high web_few_punctuated web_dup_chars web_short_lines lorem_ipsum curly_bracket javascript"
).split()


def flag_summary(flagged: DataFrame, group: str) -> DataFrame:
    """(group, flag, n, share): how many documents of a group raise a flag. Aggregated before it is unpivoted, so one row per group is shuffled."""
    sums = flagged.groupBy(group).agg(F.count("*").alias("total"), *[F.sum(F.col(f).cast("long")).alias(f) for f in FLAGS])
    return sums.unpivot([group, "total"], FLAGS, "flag", "n").where("n > 0").select(group, "flag", "n", (F.col("n") / F.col("total")).alias("share"))


def lix(text: Column, least: int = 100) -> Column:
    """Words per sentence plus the percentage of words over six letters; null below ``least`` words."""
    t = F.coalesce(text, F.lit(""))
    n = F.regexp_count(t, F.lit(r"\p{L}+"))
    stops = F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"[.!?:;]+(?:\s|$)")))
    return F.when(n >= least, n / stops + 100.0 * F.regexp_count(t, F.lit(r"\p{L}{7,}")) / F.greatest(n, F.lit(1)))


def syllables(words: Column) -> Column:
    """Vowel groups of each ASCII word, without a silent final e, at least one; summed."""
    groups = F.transform(
        words,
        lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(F.regexp_like(w, F.lit("[^aeiouy]e$")) & (F.regexp_count(w, F.lit("[aeiouy]+")) > 1), 1).otherwise(0)),
    )
    return F.aggregate(groups, F.lit(0), lambda a, x: a + x)


def flesch(text: Column) -> Column:
    """Reading ease over ASCII words; null without any."""
    words = T.ascii_words(text)
    n = F.size(words)
    stops = F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[.!?]+(?:\s|$)")))
    return F.when(n > 0, 206.835 - 1.015 * n / stops - 84.6 * syllables(words) / F.greatest(n, F.lit(1)))


def _equals(value: str):
    return lambda x: x == value


def noise_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_tokens, markup, url, encoding, symbols, repeats, cleanness): tokens that are debris, by kind.

    A token counts for the first kind that fits; a repeat is a token like the one before it, also where that one was debris.
    ``cleanness`` is 1 - debris / tokens, null without tokens.
    """
    # Signs of each kind of debris.
    markup, url = r"<[^>]+>|&[a-z]+;|&#\d+;", r"(?i)https?://|www\.|\S+@\S+\.\w+"
    encoding = r"Ã[\x{80}-\x{bf}]|â€|\x{fffd}|Â[ -\x{bf}]|[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"
    single = r"^[|■□★#*_=~^<>{}\[\]]$"
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x{0b}\f\r]+", " ")
    tokens = F.filter(F.split(bare, " "), lambda t: t != "")
    low = F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), r"^[.,;:]+|[.,;:]+$", ""))
    wide = df.select(F.col(key), tokens.alias("t"), low.alias("l"))
    is_ = lambda x, p: F.regexp_like(x, F.lit(p))
    kind = F.transform(
        F.arrays_zip("t", F.concat(F.array(F.lit("")), F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0)))).alias("p"), "l"),
        lambda x: F.when(is_(x["t"], markup), "markup").when(is_(x["t"], url), "url").when(is_(x["t"], encoding), "encoding")
        .when(~is_(x["t"], r"[\p{L}\p{N}]") & ((F.length(x["t"]) >= 2) | is_(x["t"], single)), "symbols")
        .when(is_(x["t"], r"\p{L}") & (x["l"] == x["p"]), "repeats"),
    )
    kinds = ("markup", "url", "encoding", "symbols", "repeats")
    marked = wide.where("size(t) > 0").select(F.col(key), F.size("t").cast("long").alias("n_tokens"), kind.alias("kinds"))
    counted = marked.select(key, "n_tokens", *[F.size(F.filter("kinds", _equals(k))).cast("long").alias(k) for k in kinds])
    found = counted.withColumn("cleanness", 1 - sum((F.col(k) for k in kinds), F.lit(0)) / F.col("n_tokens"))
    none = wide.where("size(t) = 0").select(F.col(key), F.lit(0).cast("long").alias("n_tokens"), *[F.lit(0).cast("long").alias(k) for k in kinds], F.lit(None).cast("double").alias("cleanness"))
    return found.unionByName(none)
