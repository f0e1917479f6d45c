"""Tokenised training sets: pairs of texts as fixed-length arrays of token ids."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie and which one is used, with the ids of its first, last and filling token; all are parameters.
DIRECTORY = os.environ.get("TRAZO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY, FIRST, LAST, FILL = "piece_bpe_32k.model", 1, 2, 0
#: Tokens of a text at most, and the label of a filled place, which a loss leaves out.
LENGTH, NO_LABEL = 128, -100
_loaded: dict[str, object] = {}


def _pieces(path: str):
    """The vocabulary of a file, loaded once a process."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def encode(texts: list[str | None], length: int = LENGTH, path: str = f"{DIRECTORY}/{VOCABULARY}") -> tuple[list[list[int]], list[int]]:
    """Ids of each text between the first and the last token, cut and filled to the length, and how many of them are real. A null text is an empty one."""
    out, sizes = [], []
    for ids in _pieces(path).encode([t or "" for t in texts], num_threads=1):
        ids = [FIRST, *ids[: length - 2], LAST]
        sizes.append(len(ids))
        out.append(ids + [FILL] * (length - len(ids)))
    return out, sizes


def decode(ids: list[int], skip_special: bool = True, path: str = f"{DIRECTORY}/{VOCABULARY}") -> str:
    """The text of the ids."""
    special = {FIRST, LAST, FILL, NO_LABEL} if skip_special else {NO_LABEL}
    return _pieces(path).decode([int(i) for i in ids if i not in special])


def dataset(pairs: DataFrame, source: str = "erronea", target: str = "corregida", length: int = LENGTH, directory: str = DIRECTORY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(input_ids, attention_mask, labels) of every pair: the source's ids, where they are real, and the target's ids with NO_LABEL where they are filled.

    Null texts are empty ones; longer texts are cut to the length, which is the model's; other
    columns aren't read. One Arrow batch after another, no shuffle.
    """
    path = f"{directory}/{vocabulary}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, sizes = encode(b["s"].tolist(), length, path)
            labels, reals = encode(b["t"].tolist(), length, path)
            yield pd.DataFrame({
                "input_ids": ids, "attention_mask": [[1] * n + [0] * (length - n) for n in sizes], "labels": [x[:n] + [NO_LABEL] * (length - n) for x, n in zip(labels, reals)],
            })

    return pairs.select(F.col(source).alias("s"), F.col(target).alias("t")).mapInPandas(run, "input_ids array<int>, attention_mask array<int>, labels array<int>")


def texts(rows: DataFrame, column: str = "labels", out: str = "text", directory: str = DIRECTORY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the text of a column of ids."""
    path = f"{directory}/{vocabulary}"

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode(list(x), path=path) for x in ids], dtype=object)

    return rows.withColumn(out, run(F.col(column)))
