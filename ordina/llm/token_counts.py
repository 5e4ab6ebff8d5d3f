"""Exact token-length histogram.

Documents are aggregated by encoded length; sums over all longer lengths then answer, for
every context limit at once, how many tokens remain when each document is truncated there,
how many documents are cut, and each quantile of the lengths.

Defined cases: a null or empty text has 0 tokens and counts at length 0. Repeated rows are
separate documents. No rows in, no rows out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.llm._store import durable, pick
from ordina.llm._word_ids import default_tokenizer, word_ids

#: Lengths are summed in blocks of so many lengths, then over the blocks.
BLOCK = 1024


def count_tokens(texts: pa.Array, tokenizer: str) -> pa.Array:
    out = np.zeros(len(texts), np.int64)
    for text, _, _, n, words in word_ids(texts, tokenizer):
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(words)
        out[text.first : text.first + len(text)] = total[ends] - total[ends - words]
    return pa.array(out)


def lengths(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """n_tokens of each whole text."""
    path = tokenizer or default_tokenizer()
    counted = F.arrow_udf(lambda texts: count_tokens(texts, path), T.LongType())
    return pick(docs, text=text).select(counted("text").alias("n_tokens"))


def histogram(lengths: DataFrame) -> DataFrame:
    """From n_tokens per document, one row per distinct length L:

    n_tokens (L), n_docs, docs_to (documents of L tokens or fewer), docs_over, tokens_over
    (documents longer than L and their tokens), total_tokens (of all documents),
    truncated_total (tokens left with a limit of L), quantile (docs_to over all documents).
    """
    held = durable(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "token-lengths")
    held = held.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    # one row per block of lengths: as many as the longest text has thousands of tokens
    block = held.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    over = Window.partitionBy(F.lit(0)).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    block = block.select(F.col("block").alias("b"), F.coalesce(F.sum("d").over(over), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("later_tokens"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(block, F.col("block") == F.col("b"))
    out = out.withColumn("docs_over", F.col("later_docs") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
    out = out.withColumn("tokens_over", F.col("later_tokens") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    out = out.withColumn("docs_to", F.col("all_docs") - F.col("docs_over"))
    truncated = F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")
    return out.select("n_tokens", "n_docs", "docs_to", "docs_over", "tokens_over", "total_tokens", truncated.alias("truncated_total"), (F.col("docs_to") / F.col("all_docs")).alias("quantile"))


def token_histogram(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """histogram() of the encoded lengths of all documents."""
    return histogram(lengths(docs, tokenizer, text))


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to limit tokens, for any limit."""
    row = hist.where(F.col("n_tokens") >= limit).orderBy("n_tokens").select("n_tokens", "n_docs", "docs_over", "tokens_over", "total_tokens").first()
    if row is None:
        row = hist.select("total_tokens").first()
        return row["total_tokens"] if row else 0
    longer, tokens = row["docs_over"] + row["n_docs"], row["tokens_over"] + row["n_tokens"] * row["n_docs"]
    return row["total_tokens"] - tokens + limit * longer


def quantile(hist: DataFrame, share: float) -> int | None:
    """The least length that so large a share of the documents doesn't exceed."""
    row = hist.where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()
    return row[0]
