"""Sizes of texts in tokens of a public tokenizer; used by problems 6 and 7."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabularies lie and which one counts; both are parameters of every function.
DIRECTORY = os.environ.get("TRAZO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_loaded: dict[str, object] = {}


def encoder(directory: str, vocabulary: str):
    """A function from text to its number of tokens; loaded once a process."""
    key = f"{directory}/{vocabulary}"
    if key not in _loaded:
        if vocabulary.endswith(".tiktoken"):
            import tiktoken

            with open(key, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[key] = lambda text: len(enc.encode_ordinary(text))
        elif vocabulary.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(key)
            tok.encode_special_tokens = True
            _loaded[key] = lambda text: len(tok.encode(text, add_special_tokens=False).ids)
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=key)
            _loaded[key] = lambda text: len(sp.encode(text, num_threads=1))
    return _loaded[key]


def n_tokens(text: Column, directory: str = DIRECTORY, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; null has none."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = encoder(directory, vocabulary)
        for texts in batches:
            yield pd.Series([size(t) if t else 0 for t in texts], dtype="int64")

    return count(text)
