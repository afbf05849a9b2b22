"""Problem 8: encoding of a corpus with a public byte-level BPE vocabulary.

The merges of one piece run over a segment tree: leaf i holds the merge rank of the live
token that starts at byte i together with its right neighbour, an inner node the smallest
rank below it. The leftmost minimum is found by one descent, and a merge changes three
leaves, so a piece of n bytes takes O(n log n), also where it has no blank at all.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns

DEFAULT_TOKENIZERS = os.environ.get("GRANARY_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the public split pattern of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NEVER = 1 << 60
_STRETCH = r" ?\S+|\s+(?!\S)|\s"
_stretches = re.compile(_STRETCH).findall
_stretches_exact = regex.compile(_STRETCH).findall
#: Four signs that only the standard library takes for white space.
_SEPARATOR_CONTROLS = re.compile("[\x1c-\x1f]").search
#: Pieces kept in a worker's memory; only speed depends on it.
_MEMO_ENTRIES = 400_000


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece of a split text."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NEVER] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        tree[width + i] = get(piece[i : i + 2], _NEVER)
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        k = width + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] != _NEVER:
        k, low = 1, tree[1]
        while k < width:
            k *= 2
            if tree[k] != low:
                k += 1
        i = k - width
        gone = after[i]
        after[i] = end = after[gone]
        if end < n:
            before[end] = i
        if gone < n - 1:
            put(gone, _NEVER)
        put(i, get(piece[i : after[end]], _NEVER) if end < n else _NEVER) if i < n - 1 else None
        if (left := before[i]) >= 0:
            put(left, get(piece[left : after[i]], _NEVER))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Memo(dict):
    """Ids of a stretch of text, made when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        if len(self) >= _MEMO_ENTRIES:
            self.clear()
        ids = self.encode(stretch)
        if len(stretch) <= 64:
            self[stretch] = ids
        return ids


class ByteBpe:
    """Encoder of one rank file; special tokens are never made."""

    _loaded: dict[str, ByteBpe] = {}

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.memo = _Memo(self._stretch)

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _stretch(self, stretch: str) -> tuple[int, ...]:
        ranks, ids = self.ranks, []
        for piece in self.split(stretch):
            raw = piece.encode("utf-8", "replace")
            whole = ranks.get(raw)
            ids += [whole] if whole is not None else merge_piece(raw, ranks)
        return tuple(ids)

    def stretches(self, text: str) -> list[str]:
        """Parts of the text that can be encoded one by one: no token of the split pattern
        reaches from one of them into the next."""
        return (_stretches_exact if _SEPARATOR_CONTROLS(text) else _stretches)(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.stretches(text))))


def rank_file(tokenizer: str, folder: str) -> str:
    return os.path.join(folder, f"{tokenizer}.tiktoken")


def encode_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_TOKENIZERS
) -> DataFrame:
    """(key, ids): the token ids of every text.

    ``tokenizer`` is a rank file of ``folder`` (encoded here), ``word_bpe_49k`` or
    ``piece_bpe_32k`` (whose normalisation belongs to their own libraries). A null and an
    empty text give an empty list; repeated rows stay; whole texts are encoded, whatever
    their length. No shuffle: one narrow stage over the key and the text.
    """
    kind = df.schema[key].dataType.simpleString()

    def make():
        encode = encoder(tokenizer, folder)

        def work(keys: list, texts: list) -> list:
            rows = encode(texts)
            ends = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
            return [keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

        return work

    return map_columns(df.select(F.col(key).alias("k"), F.col(text).alias("t")), make, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def encoder(tokenizer: str, folder: str):
    """A function from texts to lists of ids; nulls and empty texts give empty lists."""
    if tokenizer == "word_bpe_49k":
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(os.path.join(folder, f"{tokenizer}.json"))
        words.encode_special_tokens = True
        return lambda texts: [e.ids for e in words.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    if tokenizer == "piece_bpe_32k":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{tokenizer}.model"))
        return lambda texts: pieces.encode([t or "" for t in texts], num_threads=1)
    bpe = ByteBpe.load(rank_file(tokenizer, folder))
    return lambda texts: [bpe.encode(t) if t else [] for t in texts]


def decode_documents(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_TOKENIZERS) -> DataFrame:
    """(key, text): the text of every list of ids of a rank file; '' for an empty or null list. Bytes that are no UTF-8 become the replacement sign, ids that the file lacks nothing."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        tokens = {rank: raw for raw, rank in ByteBpe.load(rank_file(tokenizer, folder)).ranks.items()}
        return lambda keys, rows: [keys, [b"".join(tokens.get(i, b"") for i in row or ()).decode("utf-8", "replace") for row in rows]]

    return map_columns(df.select(F.col(key).alias("k"), F.col(ids).alias("t")), make, f"k {kind}, text string").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_TOKENIZERS) -> DataFrame:
    """(key, tokens): the number of ids of every text, 0 for null and empty ones."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        encode = encoder(tokenizer, folder)
        return lambda keys, texts: [keys, [len(ids) for ids in encode(texts)]]

    return map_columns(df.select(F.col(key).alias("k"), F.col(text).alias("t")), make, f"k {kind}, tokens int").withColumnRenamed("k", key)
