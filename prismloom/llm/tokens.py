"""Token counts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.balance import spread

#: Folder of the vocabulary files; a parameter of every operator that counts tokens.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a rank file, built once per worker process."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, text: str = "text", out: str = "n_tokens", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the number of tokens of each whole text; null and empty texts have 0."""
    path = f"{folder}/{vocabulary}"

    @F.pandas_udf("int")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    rows = spread(documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, text))]))
    return rows.select(*[F.col(f"`{c}`") for c in keep], size(F.col(f"`{text}`")).alias(out))
