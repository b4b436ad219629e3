"""Mixing sources to target shares of the total size, with capped repetition.

Method: capped water-filling. Each source is asked for its share of the total; sources that would
need more than their most repetitions are clamped there, and what they lack is spread over the others
in proportion to their shares, until none is above its cap. A source's repetitions are then a whole
number for all of its documents and one more for a seeded fraction of them.

Defined results: sources are compared without case and outer blanks; null and blank sources are none;
targets of equal names add up and have the larger cap; null shares or caps are 0; a source without
documents gets nothing; texts that are null have 0 tokens; if all sources are clamped the mix is
smaller than asked for. Whether a document is taken once more depends on its id and the seed alone.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's tokenizer cuts a text before merging; fixed by the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SEED = 7
#: Targets are sent to all tasks; more are refused.
MOST_SOURCES = 10_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """One per Python worker."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(source: Column) -> Column:
    """A source's name as compared; null if there is none."""
    name = F.lower(F.trim(source))
    return F.when(name != "", name)


def _sized(documents: DataFrame) -> DataFrame:
    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain(F.col("source").cast("string")).alias("source"), F.col("text").cast("string").alias("text"))
    return picked.where("source IS NOT NULL")


def character_counts(documents: DataFrame) -> DataFrame:
    """As token_counts, with characters for tokens: for sources whose language the vocabulary does not know."""
    return _sized(documents).select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens"))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (as compared), tokens of every document with a source.

    The vocabulary is a file of this machine; Spark sends it to the executors.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            counts = [len(own.encode_ordinary(t)) if (t := text.as_py()) else 0 for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source", "tokens"])

    return _sized(documents).mapInArrow(scan, "doc_id bigint, source string, tokens bigint")


def water_fill(sizes: list[float], shares: list[float], caps: list[float], total: float) -> tuple[list[float], list[int | None]]:
    """What each source gives, at most caps * sizes and together total if that is feasible, and when it was clamped.

    A source clamped in round 1 falls short of its share of the total; one clamped in a later round only can't take
    what others lack; None is a source that is never clamped. Shares are relative to their sum.
    """
    room = [s * c for s, c in zip(sizes, caps, strict=True)]
    given, open_ = [0.0] * len(sizes), {k for k, w in enumerate(shares) if w > 0}
    clamped: list[int | None] = [None] * len(sizes)
    left, number = total, 0
    while open_:
        number += 1
        weight = math.fsum(shares[k] for k in open_)
        full = {k for k in open_ if left * shares[k] > room[k] * weight}
        for k in full:
            clamped[k] = number
        if not full:
            for k in open_:
                given[k] = left * shares[k] / weight
            break
        for k in full:
            given[k] = room[k]
        left -= sum(room[k] for k in full)
        open_ -= full
    return given, clamped


_PLAN = "source string, target_share double, max_repeats bigint, documents bigint, tokens bigint, total_tokens bigint, falls_short boolean, clamped_in int, repetitions double"


def plan(counted: DataFrame, mix_target: DataFrame) -> DataFrame:
    """One row per target source: sizes, whether it falls short, and its repetitions in the mix.

    clamped_in is the round of water-filling in which the source came to its cap, null if it did not; a source falls
    short if that is the first.
    counted: doc_id, source, tokens. It is summed per source before it is shuffled; all sources of the
    documents count for the total.
    """
    sizes = counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    targets = mix_target.select(plain(F.col("source").cast("string")).alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("w"), F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(0)).alias("cap"))
    targets = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("w").alias("w"), F.max("cap").alias("cap"))
    both = sizes.join(targets, "source", "full").select("source", "w", "cap", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    named = F.collect_list(F.when(F.col("w").isNotNull(), F.struct("source", "w", "cap", "documents", "tokens")))  # targets only
    gathered = both.agg(named.alias("rows"), F.sum("tokens").alias("total"))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, total in zip(frame["rows"], frame["total"], strict=True):
                rows = sorted(rows, key=lambda r: r["source"])
                if len(rows) > MOST_SOURCES:
                    raise ValueError(f"{len(rows)} target sources; at most {MOST_SOURCES} are mixed at once")
                total = 0 if pd.isna(total) else int(total)
                given, clamped = water_fill([r["tokens"] for r in rows], [r["w"] for r in rows], [r["cap"] for r in rows], total)
                out = [
                    (r["source"], r["w"], r["cap"], r["documents"], r["tokens"], total, c == 1, c, min(g / r["tokens"], r["cap"]) if r["tokens"] else 0.0)
                    for r, g, c in zip(rows, given, clamped, strict=True)
                ]
                names = ["source", "target_share", "max_repeats", "documents", "tokens", "total_tokens", "falls_short", "clamped_in", "repetitions"]
                yield pd.DataFrame(out, columns=names).astype({"clamped_in": "Int32"})

    return gathered.mapInPandas(fill, _PLAN)


def mix(counted: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, repeats of every document that is used at least once."""
    joined = counted.join(F.broadcast(planned.select("source", "repetitions")), "source")  # at most MOST_SOURCES rows
    whole = F.floor("repetitions")
    chance = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53)))
    repeats = whole + F.when(chance < F.col("repetitions") - whole, 1).otherwise(0)
    return joined.select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def actual_shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """The plan beside what the mix holds: mixed_tokens and actual_share per target source."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    out = planned.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # at most MOST_SOURCES rows
    share = F.coalesce(F.col("mixed_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0))
    return out.select(*planned.columns, "mixed_tokens", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), share.alias("actual_share"))
