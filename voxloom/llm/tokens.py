"""Text sizes in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("VOXLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public tokenizer cuts text into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 500_000


class Counter(dict):
    """Tokens of a piece; pieces merge independently, so a text's size is the sum over its pieces."""

    def __init__(self, vocabulary: bytes):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(self) < REMEMBERED:
            self[piece] = n
        return n

    def size(self, text: str | None) -> int | None:
        return None if text is None else sum(map(self.__getitem__, self.pieces(text)))


def with_tokens(df: DataFrame, text: str, out: str = "tokens", path: str = TOKENIZERS, file: str = VOCABULARY) -> DataFrame:
    """Add ``out``, the number of tokens of ``text``; null stays null, '' is 0.

    The vocabulary file (a few MB, fixed by the tokenizer) is read on the driver from the folder
    ``path`` and broadcast; whole texts are counted, in one pass without a shuffle.
    """
    with open(os.path.join(path, file), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def size(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = Counter(shared.value)
        for p in parts:
            yield pd.Series([c.size(t) for t in p], dtype="Int64")

    return df.withColumn(out, size(F.col(text)))
