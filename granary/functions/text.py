"""Tokenisers, normalisers and sentence splitters: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common English function words, for measures that leave them out.
STOP_WORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her his how i if in into is it its just may more most no nor not of on one or our "
    "out over she should so some such than that the their them then there these they this those through to under up was we were what when where which while who will with would you your"
).split()


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def not_blank(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"[^\s\p{Z}]"))


def words(text: Column) -> Column:
    """Unicode words in lower case, of any length."""
    return _all(F.lower(text), r"[\p{L}\p{N}_]+")


def long_words(text: Column) -> Column:
    """Unicode words in lower case, of at least two characters."""
    return _all(F.lower(text), r"[\p{L}\p{N}_]{2,}")


def cased_words(text: Column) -> Column:
    """Unicode words as written."""
    return _all(text, r"[\p{L}\p{N}_]+")


def plain_tokens(text: Column) -> Column:
    """Lower case, links out, ASCII punctuation deleted, split at blanks, at least two characters."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+|www\.\S+", " ")
    bare = F.regexp_replace(bare, r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(F.trim(F.regexp_replace(bare, r"\s+", " ")), " "), lambda t: F.length(t) >= 2)


def placeholder_tokens(text: Column) -> Column:
    """Words with inner apostrophe, after links, addresses and long numbers became placeholders."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"https?://\S+|www\.\S+", " urltoken ")
    t = F.regexp_replace(t, r"\S+@\S+\.\S+", " emailtoken ")
    t = F.regexp_replace(t, r"[0-9]{4,}", " numtoken ")
    return _all(t, r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?")


def latin_words(text: Column) -> Column:
    """Words of Latin letters, digits and %, with inner apostrophes and hyphens."""
    return _all(F.lower(text), r"[a-zà-öø-ÿ0-9%]+(?:['-][a-zà-öø-ÿ0-9%]+)*")


def ascii_terms(text: Column) -> Column:
    """ASCII words that begin with a letter, at least two signs, outer - and ' off."""
    return F.transform(_all(F.lower(text), r"[a-z][a-z0-9'-]+"), lambda t: F.regexp_replace(t, r"^['-]+|['-]+$", ""))


def ascii_words(text: Column) -> Column:
    """ASCII words with an inner apostrophe."""
    return _all(F.lower(text), r"[a-z0-9]+(?:'[a-z0-9]+)?")


def approximate_tokens(text: Column) -> Column:
    """Number of words and single signs, a stand-in for a model's token count."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).cast("long")


def quarter_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.expr("0L") + F.floor(F.length(F.coalesce(text, F.lit(""))) / 4))


def without_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


def one_line(text: Column) -> Column:
    """Soft hyphens out, every run of white space one blank, trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "­", ""), r"\s+", " "))


def rejoined_line(text: Column) -> Column:
    """As one_line, and words that a line end divided are put together again."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"([A-Za-z])\s*-\s*\n\s*([A-Za-z])", "$1$2")
    return one_line(joined)


def without_tags(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")


def rich_to_plain(text: Column) -> Column:
    """Editor HTML as lines: items get a bullet, blocks end lines, the usual entities are resolved."""
    t = F.coalesce(text, F.lit(""))
    for pattern, put in ((r"(?i)<li\b[^>]*>", "\n• "), (r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr|ul|ol)>", "\n"), (r"<[^>]+>", "")):
        t = F.regexp_replace(t, pattern, put)
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def lines(text: Column) -> Column:
    """Lines that are not blank, as they are."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), not_blank)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), not_blank)


def sentences(text: Column) -> Column:
    """Parts after a stop and white space."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda x: x != "")


def sentence_lengths(text: Column) -> Column:
    """Tokens of every sentence."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?]\s+"), not_blank)
    return F.transform(parts, lambda x: F.size(plain_tokens(x)))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared over all distinct items; ``empty`` where both are empty, 0 where one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(empty)).otherwise(
        F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    )


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Shared items over the smaller set."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), least), F.lit(0.0))


def coverage(wanted: Column, present: Column) -> Column:
    """Share of the distinct wanted items that are present."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, present)), F.size(F.array_distinct(wanted))), F.lit(0.0))


def windows(items: Column, size: int) -> Column:
    """Consecutive slices of ``size`` items; the last may be shorter."""
    n = F.size(items)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((n - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, F.lit(size)))).otherwise(
        F.array().cast("array<array<string>>")
    )


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams in order, joined by a blank."""
    count = F.size(tokens) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def head_and_tail(text: Column, most: int, head: int, tail: int) -> Column:
    """Long texts as their first and last characters."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit("\n...\n"), F.right(text, F.lit(tail)))).otherwise(text)


def year_in(text: Column) -> Column:
    """The first year of 1900 to 2099, else null."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?![0-9])", 1), F.lit("")).cast("int")


def person_key(*candidates: Column) -> Column:
    """A stable pseudonym of the first candidate that is not blank; '' where all are."""
    first = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in candidates])
    return F.coalesce(F.substring(F.sha2(first, 256), 1, 16), F.lit(""))


def extracted(text: Column) -> Column:
    """Text extracted from a document file, in readable lines: invisible signs, page numbers, dot leaders and repeated lines out, bullets, dashes
    and quotes of one kind, words divided at line ends put together, a blank after colons."""
    t = F.coalesce(text, F.lit(""))
    for pattern, put in (
        (r"[\x{200b}-\x{200f}\x{2060}\x{feff}]", ""), (r"\r\n?", "\n"), (r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]", ""), ("\u00a0", " "),
        (r"(?m)^[ \t]*(?:[Pp]age\s+)?[0-9]{1,4}(?:\s*(?:/|of)\s*[0-9]{1,4})?[ \t]*$", ""), (r"\.{4,}[ \t]*[0-9]*", " "), (r"(?m)^[ \t]*[•▪►◦‣·●][ \t]*", "- "), (r"[–—―]", "-"), (r"[“”„«»]", '"'), (r"[‘’‚]", "'"),
        (r"([\p{L}])[-‐\x{ad}][ \t]*\n[ \t]*([\p{Ll}])", "$1$2"), (r"([\p{Ll}])([\p{Lu}][\p{Ll}])", "$1 $2"), (r":(?=[\p{L}])", ": "), (r"[ \t]+", " "),
    ):
        t = F.regexp_replace(t, pattern, put)
    kept = F.array_distinct(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.array_join(kept, "\n")


def reference_text(summary: Column, vision: Column, content: Column, most_chars: int) -> Column:
    """What a field is held against: the summary, else the readings of the file, cut to a number of characters."""
    read = F.concat_ws(" ", *[F.nullif(one_line(c), F.lit("")) for c in (vision, content)])
    return F.left(F.coalesce(F.nullif(one_line(summary), F.lit("")), read), F.lit(most_chars))


def clamped_list(items: Column, most_items: int, most_chars: int) -> Column:
    """The first items without repeats (case aside, the first spelling stays), each cut to a number of characters."""
    low = F.transform(items, lambda x: F.lower(F.trim(x)))
    first = F.filter(items, lambda x, i: F.array_position(low, F.lower(F.trim(x))) == i + 1)
    return F.slice(F.transform(F.filter(first, lambda x: F.trim(x) != ""), lambda x: F.left(F.trim(x), F.lit(most_chars))), 1, most_items)


def evenly(items: Column, k: int) -> Column:
    """At most ``k`` items at even distances, the first and last among them."""
    n = F.size(items)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / max(1, k - 1)).cast("int")))
    return F.when(n <= k, items).otherwise(F.transform(at, lambda i: F.get(items, i)))
