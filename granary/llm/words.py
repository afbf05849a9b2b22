"""Fixed word and name lists that several operators share."""

from __future__ import annotations

import re

from granary.functions.languages import LABEL_CODES, LANGUAGE_NAMES

_letter_spaced = re.compile(r"(?<!\w)[^\W_](?: {1,3}[^\W_](?!\w)){3,}").sub


def join_letters(text: str, pad: str = "") -> str:
    """Words that were set with blanks between their letters, put together; ``pad`` stands behind them for each blank left out."""

    def joined(m: re.Match) -> str:
        word = m[0].replace(" ", "")
        return word + pad * (len(m[0]) - len(word))

    return _letter_spaced(joined, text)


# Frequent function words of the supported languages, public knowledge.
COMMON_WORDS = {
    "en": "the of and to in a is that for on with as by at from are this be or an which but so because while over under during".split(),
    "fr": "le la les de des du et à en un une dans pour par sur avec est que qui au aux sous pendant mais ou donc".split(),
    "de": "der die das und in den von zu mit dem des ein eine ist im auf für bei nach aus um während aber oder denn".split(),
    "es": "el la los las de del y en un una que por con para es al se su durante sobre entre pero o porque".split(),
    "it": "il lo la i gli le di del della dei delle e in un una che per con è al dal nel durante ma o perché".split(),
    "nl": "de het een van en in op met voor te is dat aan bij uit over tijdens maar of want door na".split(),
    "pl": "w i z na do się nie jest że o po przy dla od za przez podczas ale lub ponieważ każdego".split(),
}
ALL_COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words)

# Language family of each supported language.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pl": "slavic"}

__all__ = ["ALL_COMMON", "COMMON_WORDS", "FAMILIES", "LABEL_CODES", "LANGUAGE_NAMES", "join_letters"]
