"""Host-level quality rules.

Each document is measured once; rule failures are summed by host (a partial sum in every
task, so that a host with a third of all rows is no hot spot), failure rates are shrunk to
a beta prior that is fitted to the hosts themselves, and the hosts that fail go back to
their documents.

Defined cases: a null text counts as empty; it fails for want of words. A document without
a host is judged by itself alone. Repeated rows are separate documents. No rows in, no rows out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.llm._store import durable, flag, flat, pick
from ordina.llm._text import LEAD, Bytes, mix, parts

#: Words that count as repeated lie in windows of so many words.
WINDOW = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

@dataclass(frozen=True)
class Rules:
    """min_words: fewer fail. max_repeated: a larger share of repeated words fails. max_host_rate: a host fails when the
    shrunk rate of either failure among its documents is higher."""

    min_words: int = 20
    max_repeated: float = 0.3
    max_host_rate: float = 0.5


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.sort(keys)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(again, keys)
    at[at == len(again)] = 0
    return again[at] == keys


def _duplicate_lines(text: Bytes, word_start: np.ndarray) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of the text."""
    is_end = text.buf == 10
    line_start = np.union1d(np.flatnonzero(is_end) + 1, text.off[:-1])
    line_start = line_start[line_start < len(text.buf)]
    limit = np.append(line_start[1:], len(text.buf))[: len(line_start)]
    line_end = limit - is_end[limit - 1]
    worded = np.diff(np.append(np.searchsorted(word_start, line_start), len(word_start))) > 0
    line_start, line_end = line_start[worded], line_end[worded]
    rows = np.searchsorted(text.off, line_start, side="right") - 1
    keys = mix(text.hashes(line_start, line_end) ^ mix(rows.astype(np.uint64)))
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return np.bincount(rows[later], minlength=len(text))


def _repeated_words(text: Bytes, start: np.ndarray, end: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per text: words inside windows that occur twice or more in the text."""
    n = len(start) - WINDOW + 1
    if n < 2:
        return np.zeros(len(text), np.int64)
    words = text.hashes(start, end)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
    at = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :])
    at = at[repeated(mix(key[at] ^ mix(rows[at].astype(np.uint64))))]
    depth = np.zeros(len(start) + 1, np.int64)
    depth[at] += 1
    depth[at + WINDOW] -= 1
    return np.bincount(rows[np.cumsum(depth)[:-1] > 0], minlength=len(text))


def _measure(texts: pa.Array) -> pa.Array:
    out = [np.zeros(len(texts), np.int64) for _ in MEASURES]
    for text in parts(texts):
        here = slice(text.first, text.first + len(text))
        start, end = text.words()
        rows = text.rows(start)
        inside = np.zeros(len(text.buf) + 1, np.int8)
        inside[start] += 1
        inside[end] -= 1  # two words never touch but at the edge of texts, where the two cancel out
        lead = np.flatnonzero((np.cumsum(inside, dtype=np.int8)[:-1] > 0) & LEAD[text.buf])
        found = (text.count(start), text.count(lead), text.count(np.flatnonzero(SYMBOL[text.buf])), _duplicate_lines(text, start), _repeated_words(text, start, end, rows))
        for column, values in zip(out, found, strict=True):
            column[here] = values
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=list(MEASURES))


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES]))
def measure(texts: pa.Array) -> pa.Array:
    return _measure(texts)


def failures(m: Column, rules: Rules) -> tuple[Column, Column]:
    """Too few words; too large a share of repeated words."""
    share = round(100 * rules.max_repeated)
    return m["n_words"] < rules.min_words, 100 * m["n_repeat_words"] > share * m["n_words"]


def host_verdicts(measured: DataFrame, rules: Rules) -> DataFrame:
    """One row per host: host, docs, and for each rule its shrunk failure rate; host_failed.

    The prior Beta(a, b) has the mean and variance of the hosts' own rates (method of moments;
    one host, or hosts all alike, leave the pooled rate with the weight of one document).
    """
    hosts = measured.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("docs"), *[F.sum(F.col(f).cast("long")).alias(f) for f in ("short", "repeating")])
    moments = hosts.agg(*[g for f in ("short", "repeating") for g in (F.avg(F.col(f) / F.col("docs")).alias(f"m_{f}"), F.var_pop(F.col(f) / F.col("docs")).alias(f"v_{f}"))]).first()
    for f in ("short", "repeating"):
        m, v = moments[f"m_{f}"] or 0.0, moments[f"v_{f}"] or 0.0
        weight = max(1.0, m * (1 - m) / v - 1) if v > 1e-12 else 1.0
        hosts = hosts.withColumn(f"{f}_rate", (F.col(f) + F.lit(m * weight)) / (F.col("docs") + F.lit(weight)))
    return hosts.withColumn("host_failed", F.greatest("short_rate", "repeating_rate") > rules.max_host_rate)


def _measured(docs: DataFrame, rules: Rules, id: str, text: str, host: str) -> DataFrame:
    rows = pick(docs, doc_id=id, text=text, host=host).select("doc_id", "host", measure("text").alias("m"))
    short, repeating = failures(F.col("m"), rules)
    return durable(rows.select("doc_id", "host", "m.*", short.alias("short"), repeating.alias("repeating")), "quality-rules")


def judge(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, host, host_failed, kept."""
    rows = _measured(docs, rules, id, text, host)
    failed = host_verdicts(rows, rules).where("host_failed")
    out = flag(rows, F.col("host"), failed.select("host"), "host_failed").withColumn("base_failed", F.col("short") | F.col("repeating"))
    return out.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host", "host_failed")


def keep(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that judge() keeps, with all their columns and whole texts.

    The texts are measured a second time: cheaper than a shuffle of texts.
    """
    failed = host_verdicts(_measured(docs, rules, id, text, host), rules).where("host_failed")
    at = {c: f"_{docs.columns.index(c)}" for c in (id, text, host)}
    rows = flat(docs).withColumn("_m", measure(F.col(at[text])))
    rows = flag(rows, F.col(at[host]), failed.select("host"), "host_failed")
    short, repeating = failures(F.col("_m"), rules)
    return rows.where(~short & ~repeating & ~F.col("host_failed")).drop("_m", "host_failed").toDF(*docs.columns)


measure = measure.asNondeterministic()  # else a filter on a measure would measure again
