"""Sub-word tokens from a given vocabulary, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

MAX_VOCABULARY_BYTES = 16 << 20
SPECIAL = ("[CLS]", "[SEP]")


def read_vocabulary(path: str) -> list[str]:
    """Tokens of a vocabulary file, one a line; it must have both special tokens, once each, and fit into a task."""
    with open(path, encoding="utf-8") as file:
        text = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary larger than {MAX_VOCABULARY_BYTES} characters")
    tokens = text.splitlines()
    for special in SPECIAL:
        if tokens.count(special) != 1:
            raise ValueError(f"the vocabulary must hold {special} once")
    return tokens


def encoder(vocabulary: list[str], lowercase: bool = True):
    """A column function from text to WordPiece ids, without special tokens and without truncation; null gives null."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import BertWordPieceTokenizer

        made = BertWordPieceTokenizer(vocab={t: i for i, t in enumerate(vocabulary)}, lowercase=lowercase)
        for texts in batches:
            ids = made.encode_batch([t or "" for t in texts], add_special_tokens=False)
            yield pd.Series([None if t is None else x.ids for t, x in zip(texts, ids)], dtype=object)

    return encode
