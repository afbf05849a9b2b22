"""Language labels of any spelling as two-letter codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names by which a label may call a language: English name, own name, German name, ISO codes.
LANGUAGE_NAMES = {
    "en": "english anglais englisch en eng",
    "fr": "french français francais französisch fr fra fre",
    "de": "german deutsch allemand de deu ger",
    "es": "spanish español espanol castellano spanisch es spa",
    "it": "italian italiano italienisch it ita",
    "nl": "dutch nederlands niederländisch flemish nl nld dut",
    "pl": "polish polski polnisch pl pol",
    "pt": "portuguese português portugiesisch pt por",
    "el": "greek ελληνικά griechisch el ell gre",
    "da": "danish dansk dänisch da dan",
    "ro": "romanian română rumänisch ro ron rum",
    "hu": "hungarian magyar ungarisch hu hun",
    "sv": "swedish svenska schwedisch sv swe",
    "fi": "finnish suomi finnisch fi fin",
    "cs": "czech čeština tschechisch cs ces cze",
    "sk": "slovak slovenčina slowakisch sk slk slo",
    "sl": "slovenian slovene slovenščina slowenisch sl slv",
    "hr": "croatian hrvatski kroatisch hr hrv",
    "bg": "bulgarian български bulgarisch bg bul",
    "lt": "lithuanian lietuvių litauisch lt lit",
    "lv": "latvian latviešu lettisch lv lav",
    "et": "estonian eesti estnisch et est",
    "ga": "irish gaeilge irisch ga gle",
    "mt": "maltese malti maltesisch mt mlt",
    "ca": "catalan català katalanisch ca cat",
    "no": "norwegian norsk norwegisch no nor nb nob",
    "uk": "ukrainian українська ukrainisch uk ukr",
    "ru": "russian русский russisch ru rus",
    "tr": "turkish türkçe türkisch tr tur",
}
LABEL_CODES = {name: code for code, names in LANGUAGE_NAMES.items() for name in names.split()}


def language_code(label: Column) -> Column:
    """The code that a label names, by name or tag; null for none."""
    names = F.create_map(*[F.lit(x) for kv in LABEL_CODES.items() for x in kv])
    bare = F.lower(F.trim(label))
    tag = F.regexp_extract(bare, r"^([a-z]{2,3})[-_][a-z0-9]{2,4}$", 1)
    return F.coalesce(F.try_element_at(names, bare), F.try_element_at(names, tag))


def language_codes(labels: Column) -> Column:
    """Distinct codes of a list of labels, sorted; each item may hold several between commas, semicolons, slashes or bars."""
    parts = F.flatten(F.transform(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.split(x, r"[,;/|+&]")))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(parts, language_code))))
