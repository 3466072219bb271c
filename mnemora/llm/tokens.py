"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary of byte-pair ranks; any other file of that form can be named instead.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public splitting pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(path: str) -> Callable[[str], int]:
    """A function giving a text's number of tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def token_counts(documents: DataFrame, path: str = TOKENIZER, *keep: str) -> DataFrame:
    """``doc_id``, the columns ``keep`` and ``n_tokens`` of each row.

    Whole texts are counted; a null text has 0 tokens, an empty one too. One pass, no exchange; the texts themselves
    are not carried on.
    """
    schema = documents.select("doc_id", *keep).schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_tokens long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = None
        for batch in batches:
            if len(batch):
                size = size or counter(path)
                yield batch.drop(columns="text").assign(n_tokens=[size(t) if t else 0 for t in batch["text"]])

    return documents.select("doc_id", *keep, F.col("text")).mapInPandas(run, fields)
