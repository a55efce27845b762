"""Token counts: Arrow functions that return lengths only.

Batches are balanced by bytes: the rows of an Arrow batch are taken in runs of
about ``BATCH_CHARS`` characters, and a long text is cut at safe boundaries, so
the memory of a task depends on neither the row count nor the longest text.

Edge cases: null counts as the empty text (0 bytes, 0 tokens); repeated rows
each give a row; an empty table gives an empty result; other columns of the
input are kept by ``with_token_counts`` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import table

#: Tokens above which a document is over the limit.
LIMIT = 512


def runs(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def _lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import pyarrow.compute as pc

    enc = tokens.encoder()
    for texts in batches:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        counts: list[int] = []
        for start, end in runs(sizes, tokens.BATCH_CHARS):
            counts += [tokens.length(enc, t) if t else 0 for t in texts.slice(start, end - start).to_pylist()]
        yield pa.array(counts, pa.int64())


def token_count(text: Column) -> Column:
    """The number of tokens of a text column."""
    return F.arrow_udf(_lengths, "long")(text)


def with_token_counts(docs: DataFrame, text: str | Column = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text."""
    return docs.withColumn(name, token_count(F.col(text) if isinstance(text, str) else text))


def count_tokens(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    counted = with_token_counts(docs.select("doc_id", "text"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
