"""Token counts by rank-synchronous merging (see bpe.py for the method)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.common import runs


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """`docs` without its text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    A map over the rows, without a shuffle: each task merges the distinct pre-tokens of about two million
    characters at a time. A null text counts as empty (0 bytes, 0 tokens); repeated rows stay, each counted;
    columns named like the new ones are replaced; an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(*kept, F.octet_length(body).cast("long").alias("n_bytes"), body.alias("__text"))
    schema = source.drop("__text").schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(vocabulary_path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in runs(texts):
                counts = pa.array(bpe.count_tokens(v, texts[a:b]), pa.int64())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts], [*part.schema.names[:-1], "n_tokens"])

    return source.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
