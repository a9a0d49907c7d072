"""Token counts: batch encoding in Arrow functions that return lengths only.

An Arrow batch is dealt into batches of about equal bytes, so that a few long
texts do not make one of them large, and long texts are cut at safe boundaries
(see :mod:`tidewell.llm.pieces`), so no text is encoded in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .batches import text_batches, text_or_empty
from .pieces import encoder, tokenizer_path


def token_count(text: Column, tokenizer: str = "byte_bpe_50k.json", batch_bytes: int = 1 << 20) -> Column:
    """Number of tokens of a text as the tokenizer's own library counts them, no special tokens added (bigint)."""
    @arrow_udf("long")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        engine = encoder(tokenizer_path(tokenizer), lengths_only=True)
        for column in columns:
            yield pa.array([n for texts in text_batches(column, batch_bytes) for n in engine.encode(texts)], pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
                 tokenizer: str = "byte_bpe_50k.json", batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    A null text counts as empty: 0 bytes, 0 tokens.  Null or repeated ids are
    rows like others; other columns are not read, so their names may clash.
    An empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    counted = docs.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"),
                          token_count(text, tokenizer, batch_bytes).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
