"""Problem 3: cutting oversized texts at natural boundaries, with overlap.

One regular expression with bounded quantifiers does the cutting inside the JVM. Its
alternatives stand in the order of boundary strength (end of text, paragraph, line,
sentence, clause, word) and end with plain characters; each consumes as much as it may.
Array functions then put the overlap in front of each piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before a cut, strongest first.
BOUNDARIES = (r"\n\s*\n", r"\n", r"[.!?…]\s", r"[;:,]\s", r"\s")


def _alternatives(limit: int, overlap: int) -> str:
    # A strong boundary is used where it leaves the piece at least half full, a blank
    # anywhere beyond the overlap, which the next piece repeats from this one.
    half = min(limit, max(limit // 2, overlap, 1))
    low = min(limit, max(overlap, 1))
    cuts = [rf".{{1,{limit}}}\z"]
    for k, boundary in enumerate(BOUNDARIES):
        least = low if k == len(BOUNDARIES) - 1 else half
        behind = r"\n[ \t]{0,9}\n" if k == 0 else boundary
        cuts.append(rf".{{{least},{limit}}}(?<={behind})")
    cuts.append(rf".{{1,{limit}}}")
    return "|".join(cuts)


def piece_pattern(max_size: int, overlap: int) -> str:
    """The first piece may fill the limit; the others leave room for the overlap.

    An overlap of up to half of the size lies in what the piece before has consumed, so each consumes that much at least; a longer one
    reaches further back, and only the first piece has to be so long.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("the overlap must be at least 0 and less than the size")
    return rf"(?s)\A(?:{_alternatives(max_size, overlap)})|(?:{_alternatives(max_size - overlap, 0 if 2 * overlap > max_size else overlap)})"


def pieces(text: Column, max_size: int, overlap: int) -> Column:
    """ARRAY<STRING> of pieces: null for null, one piece for what is within the limit."""
    cut = F.regexp_extract_all(text, F.lit(piece_pattern(max_size, overlap)), F.lit(0))
    if 2 * overlap <= max_size:
        lapped = F.transform(cut, lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(F.right(F.get(cut, i - 1), F.lit(overlap)), piece)))
    else:
        # Where each piece begins, from the lengths of those before it.
        ends = F.aggregate(
            cut, F.array().cast("array<int>"), lambda at, piece: F.concat(at, F.array(F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(0)) + F.char_length(piece)))
        )
        both = F.arrays_zip(cut.alias("piece"), ends.alias("end"))
        lapped = F.transform(
            both,
            lambda x, i: F.when(i == 0, x["piece"]).otherwise(
                F.substring(text, x["end"] - F.char_length(x["piece"]) - overlap + 1, F.char_length(x["piece"]) + overlap)
            ),
        )
    return F.when(F.char_length(text) > max_size, lapped).when(text.isNotNull(), F.array(text))


def split_texts(df: DataFrame, limits: dict[str, tuple[int, int]], key: str = "rec_no") -> DataFrame:
    """(key, field_name, n_pieces, piece_no, piece) for every non-null text of the named fields.

    ``limits`` maps a column to its (max_size, overlap) in Unicode code points. Pieces are
    numbered from 1, none is longer than max_size, and each but the first begins with the
    last ``overlap`` characters of the one before. Null texts give no row, an empty text one
    empty piece, repeated rows repeat. A text of any length is cut; without any boundary it is
    cut between characters. Narrow: no shuffle.
    """
    per_field = F.array(
        *[F.struct(F.lit(f).alias("field_name"), pieces(F.col(f), *limits[f]).alias("all")) for f in limits]
    )
    rows = df.select(F.col(key).alias("k"), F.inline(per_field))
    return rows.select(
        F.col("k").alias(key), "field_name", F.size("all").alias("n_pieces"), F.posexplode("all").alias("p", "piece")
    ).select(key, "field_name", "n_pieces", (F.col("p") + 1).alias("piece_no"), "piece")


def oversized(df: DataFrame, limits: dict[str, tuple[int, int]], key: str = "rec_no") -> DataFrame:
    """(key, field_name) of each text that has to be cut, once per row of the input."""
    cut = split_texts(df, limits, key)
    return cut.where("n_pieces > 1 AND piece_no = 1").select(key, "field_name")
