"""Repeated content inside single documents, and cutoffs with a bounded risk of false rejection.

Measures per document: the share of words that lie in five consecutive words that began earlier in
the document too (overlaps count), and the shares of characters in sentences and in paragraphs that
stood earlier in it.

Method for cutoffs: risk control. A seeded part of the documents is held out and labelled; on it, for every
stratum and every cutoff of a grid, the exact binomial test of "at least RISK of the good documents would be
rejected" is made; a cutoff is sure if the test rejects at DELTA divided by the number of tests (Bonferroni),
and the smallest sure cutoff of the stratum is taken. For documents that were not held out the guarantee holds
for all strata at once with probability 1 - DELTA; a stratum without sure cutoff rejects nothing. What the
cutoffs do to those documents is counted too.

Defined results: null texts and texts of fewer than five words have share 0; languages are compared
without case and outer blanks, and those of less than STRATUM_SHARE of the documents are one stratum with
the unknown ones; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbrook.llm.words import words

RUN = 5
LIMIT_TENTHS = 3
RISK, DELTA = 0.02, 0.05
CUTOFFS = [k / 20 for k in range(1, 20)]
#: Documents held out for labels, of 100, and the seed that chooses them.
HOLDOUT, SEED = 50, 8
#: A language of fewer documents has no strata of its own; so there are at most 1 / STRATUM_SHARE languages.
STRATUM_SHARE = 0.01
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def repeated_words(own: list[str]) -> int:
    """Number of words in five consecutive words that began earlier too."""
    n = len(own)
    if n <= RUN:
        return 0
    grams = list(zip(*(own[k:] for k in range(RUN)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    known: dict[str, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in own), np.int32, n)
    runs = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(numbers, RUN)).view(np.dtype((np.void, 4 * RUN))).ravel()
    _, first, inverse = np.unique(runs, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[inverse] < np.arange(len(runs)))
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + RUN, -1)
    return int((np.cumsum(marks)[:n] > 0).sum())


def repeated_parts(text: str, cut: re.Pattern[str]) -> float:
    """Share of characters in parts that stood earlier, without case and blanks."""
    total = again = 0
    seen = set()
    for part in cut.split(text):
        key = " ".join(part.lower().split())
        total += len(key)
        if key in seen:
            again += len(key)
        seen.add(key)
    return again / total if total else 0.0


_MEASURES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("word_count", pa.int64()), ("repeated_words", pa.int64()), ("repeated_sentences", pa.float64()), ("repeated_paragraphs", pa.float64())])


def measures(documents: DataFrame, parts: bool = True) -> DataFrame:
    """doc_id, lang, word_count, repeated_words and, with `parts`, the shares of sentences and paragraphs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                text = text.as_py() or ""
                own = words(text)
                rows.append((len(own), repeated_words(own), *((repeated_parts(text, _SENTENCE), repeated_parts(text, _PARAGRAPH)) if parts else (None, None))))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(columns, list(_MEASURES)[2:], strict=True))], schema=_MEASURES)

    lang = F.lower(F.trim(F.col("lang").cast("string")))
    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(lang != "", lang).alias("lang"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(scan, "doc_id bigint, lang string, word_count bigint, repeated_words bigint, repeated_sentences double, repeated_paragraphs double")


def is_repetitive() -> Column:
    """At least 30 % of the words are repeated, in whole numbers."""
    return (F.col("word_count") > 0) & (F.col("repeated_words") * 10 >= F.col("word_count") * LIMIT_TENTHS)


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, exactly, as an incomplete beta function."""
    return 1.0 if k >= n else _beta(n - k, k + 1, 1 - p)


def _beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + step * d) or tiny), (1 + step / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return front * h / a


def sure_cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, cutoff, good, false_rejections of the smallest sure cutoff; cutoff is null if there is none.

    labelled: stratum, score, good (true for documents that must not be rejected). Only counts per
    stratum and grid step are gathered.
    """
    step = F.aggregate(F.array(*(F.lit(c) for c in CUTOFFS)), F.lit(0), lambda n, c: n + F.when(F.col("score") >= c, 1).otherwise(0))
    counts = labelled.groupBy("stratum", step.alias("step")).agg(F.count_if("good").alias("good"))
    per_stratum = counts.groupBy("stratum").agg(F.collect_list(F.struct("step", "good")).alias("steps"))
    gathered = per_stratum.agg(F.collect_list(F.struct("stratum", "steps")).alias("strata"))  # strata x 20 numbers

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for strata in frame["strata"]:
                rows = []
                level = delta / max(1, len(strata) * len(CUTOFFS))
                for s in strata:
                    own = {x["step"]: x["good"] for x in s["steps"]}
                    n, chosen, wrong = sum(own.values()), None, 0
                    for k in range(len(CUTOFFS), 0, -1):
                        above = sum(v for step_no, v in own.items() if step_no >= k)
                        if n and binomial_at_most(above, n, risk) <= level:
                            chosen, wrong = CUTOFFS[k - 1], above
                    rows.append((s["stratum"], chosen, n, wrong))
                yield pd.DataFrame(rows, columns=["stratum", "cutoff", "good", "false_rejections"]).astype({"cutoff": "float64", "good": "int64", "false_rejections": "int64"})

    return gathered.mapInPandas(choose, "stratum string, cutoff double, good bigint, false_rejections bigint")


def strata(measured: DataFrame) -> DataFrame:
    """Language and length class as stratum; score is the larger share of repeated sentences and paragraphs.

    good is the label: the document is not repetitive by the word rule. Which languages have strata is counted, one
    row per language before any shuffle.
    """
    counts = measured.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # over one row per language
    common = counts.withColumn("whole", whole).where(F.col("n") >= F.lit(STRATUM_SHARE) * F.col("whole")).select("lang", F.col("lang").alias("known"))
    length = F.when(F.col("word_count") < 50, "short").when(F.col("word_count") < 150, "middle").otherwise("long")
    held = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(100)) < HOLDOUT
    return measured.join(F.broadcast(common), "lang", "left").withColumns({
        "stratum": F.concat_ws("/", F.coalesce("known", F.lit("other")), length), "score": F.greatest("repeated_sentences", "repeated_paragraphs"), "good": ~is_repetitive(), "is_held_out": held,
    }).drop("known")


def rejected(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Every document with its stratum, score, the stratum's cutoff and whether it is rejected.

    scored: strata(); documents that are held out gave the labels, and the guarantee is for the others.
    """
    chosen = cutoffs.select("stratum", F.when(~F.isnan("cutoff"), F.col("cutoff")).alias("cutoff"))  # at most three per language
    return scored.join(F.broadcast(chosen), "stratum", "left").select(
        "doc_id", "stratum", "is_held_out", "score", "cutoff", F.coalesce(F.col("score") >= F.col("cutoff"), F.lit(False)).alias("is_rejected"), "word_count", "repeated_words", "good"
    )


def risks(decided: DataFrame) -> DataFrame:
    """Per stratum, of the documents that were not held out: good ones, those among them rejected, repetitive ones and
    those found; decided is rejected()."""
    of = decided.where("NOT is_held_out").groupBy("stratum").agg(
        F.max("cutoff").alias("cutoff"), F.count_if("good").alias("good"), F.count_if(F.col("good") & F.col("is_rejected")).alias("false_rejections"), F.count_if(~F.col("good")).alias("repetitive"), F.count_if(~F.col("good") & F.col("is_rejected")).alias("rejected")
    )
    return of.withColumn("false_rate", F.coalesce(F.col("false_rejections") / F.nullif(F.col("good"), F.lit(0)), F.lit(0.0)))
