"""Source mixing and repetition measures."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbrook.llm import mixing, repetition
from plumbrook.llm.words import words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 10), st.integers(0, 4)), min_size=1, max_size=8))
def test_water_filling(sources):
    sizes, shares, caps = zip(*sources, strict=True)
    total = sum(sizes)
    given_, clamped = mixing.water_fill(sizes, shares, caps, total)
    for s, w, c, n in zip(sizes, shares, caps, clamped, strict=True):  # the first round clamps those that fall short
        assert (n == 1) is (w > 0 and s * c * sum(shares) < w * total) and (n is None or w > 0)
    room = [s * c for s, c in zip(sizes, caps, strict=True)]
    assert all(-1e-9 <= g <= r + 1e-6 for g, r in zip(given_, room, strict=True))
    open_ = sum(r for r, w in zip(room, shares, strict=True) if w)
    assert sum(given_) == pytest.approx(min(total, open_) if any(shares) else 0)
    levels = [g / w for g, w, r in zip(given_, shares, room, strict=True) if w and g < r - 1e-6]
    assert not levels or max(levels) == pytest.approx(min(levels))  # those below their cap share in proportion
    assert all(g / w <= max(levels) + 1e-6 for g, w, r in zip(given_, shares, room, strict=True) if w and levels and g >= r - 1e-6)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(k, "some words here " * 3, s) for k, s in enumerate([" Big", "big", "BIG "] * 100 + ["small"] * 10 + [None, "", "  "] + ["loose"] * 40)] + [(999, None, "big")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("Big ", 0.4, 2), ("small", 0.4, 3), ("absent", 0.2, 9), (None, 0.5, 1), ("nul", None, None)], "source string, target_share double, max_repeats int")
    counted = mixing.token_counts(documents).cache()
    return counted, targets, mixing.plan(counted, targets)


def test_plan(mixed):
    counted, _, planned = mixed
    got = {r.source: r for r in planned.collect()}
    assert set(got) == {"big", "small", "absent", "nul"} and got["big"].documents == 301 and counted.count() == 351
    assert got["small"].falls_short and got["absent"].falls_short and not got["big"].falls_short and not got["nul"].falls_short
    assert {s: r.clamped_in for s, r in got.items()} == {"small": 1, "absent": 1, "big": None, "nul": None}
    each = got["small"].tokens // 10
    assert got["big"].total_tokens == 350 * each and got["small"].repetitions == 3 and got["absent"].repetitions == 0
    assert got["big"].repetitions == pytest.approx((350 - 30) / 300, rel=1e-9)  # what the others lack


def test_mix_and_shares(spark, mixed):
    counted, targets, planned = mixed
    got = mixing.mix(counted, planned).collect()
    assert {r.source for r in got} == {"big", "small"} and {r.repeats for r in got if r.source == "small"} == {3} and {r.repeats for r in got if r.source == "big"} <= {1, 2}
    again = mixing.mix(counted.repartition(7), planned).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    shares = {r.source: r for r in mixing.actual_shares(mixing.mix(counted, planned), planned).collect()}
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1) and shares["absent"].mixed_tokens == 0 and shares["small"].most_repeats == 3
    twice = sum(r.repeats == 2 for r in got if r.source == "big")
    assert twice == pytest.approx(301 * (320 / 300 - 1), abs=15)
    assert mixing.plan(counted.limit(0), targets).where("repetitions > 0").count() == 0 and mixing.plan(counted, targets.limit(0)).count() == 0


def test_tokens_round_trip():
    own = mixing.encoder(mixing.VOCABULARY)
    for text in ("Hello world's 123", "ünï çödé\n\n  x", "a" * 5000, "👍🏽"):
        assert own.decode(own.encode_ordinary(text)) == text


def plain_repeated(own):
    marked = set()
    for i in range(len(own) - 4):
        if any(own[j : j + 5] == own[i : i + 5] for j in range(i)):
            marked.update(range(i, i + 5))
    return len(marked)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(own):
    assert repetition.repeated_words(own) == plain_repeated(own)


def test_long_repetition():
    assert repetition.repeated_words(["x"] * 200_000) == 199_999 and repetition.repeated_words([str(k) for k in range(200_000)]) == 0


def test_parts():
    assert repetition.repeated_parts("A b. A  B. c", repetition._SENTENCE) == pytest.approx(4 / 9)
    assert repetition.repeated_parts("", repetition._PARAGRAPH) == 0


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.3), (3, 10, 0.3), (9, 10, 0.3), (10, 10, 0.3), (40, 1000, 0.05), (70, 1000, 0.05), (1000, 100_000, 0.01)])
def test_binomial(k, n, p):
    terms = (math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert repetition.binomial_at_most(k, n, p) == pytest.approx(min(1.0, math.fsum(terms)), rel=1e-8)


def test_sure_cutoffs(spark):
    r = random.Random(1)
    rows = [("clear", r.uniform(0, 0.2), True) for _ in range(3000)] + [("clear", r.uniform(0.6, 1), False) for _ in range(50)]
    rows += [("few", 0.0, True)] * 20 + [("mixed", r.random(), True) for _ in range(3000)] + [("bad", 0.9, False)] * 5
    labelled = spark.createDataFrame(rows, "stratum string, score double, good boolean")
    got = {x.stratum: x for x in repetition.sure_cutoffs(labelled).collect()}
    assert got["clear"].cutoff == pytest.approx(0.2) and got["clear"].false_rejections == 0 and got["few"].cutoff is None or math.isnan(got["few"].cutoff)
    level = repetition.DELTA / (4 * len(repetition.CUTOFFS))
    for k, cutoff in enumerate(repetition.CUTOFFS):
        wrong = sum(s >= cutoff for g, s, good in rows if g == "mixed" and good)
        if repetition.binomial_at_most(wrong, 3000, repetition.RISK) <= level:
            assert got["mixed"].cutoff == cutoff
            break
    else:
        assert got["mixed"].cutoff is None or math.isnan(got["mixed"].cutoff)


def test_false_rejection_is_bounded_on_fresh_documents():
    """Held-out accuracy: cutoffs from one half keep the risk on the other, in all of many draws but few."""
    r, broken = random.Random(7), 0
    for _ in range(60):
        good = [min(1.0, r.expovariate(12)) for _ in range(4000)]
        learn, fresh = good[:2000], good[2000:]
        level = repetition.DELTA / len(repetition.CUTOFFS)
        sure = [c for c in repetition.CUTOFFS if repetition.binomial_at_most(sum(s >= c for s in learn), len(learn), repetition.RISK) <= level]
        broken += sum(s >= min(sure) for s in fresh) / len(fresh) > repetition.RISK * 1.5
    assert broken <= 3


def test_measures_and_rejection(spark):
    loop = "the same thing again and again. " * 20
    fresh = " ".join(f"word{k}" for k in range(80))
    rows = [(1, loop, "EN "), (2, fresh, "en"), (3, None, None), (4, "", "xx"), (5, "a b c d e", "de"), (None, loop, "fr")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("word_count", F.lit("clash"))
    measured = repetition.measures(documents)
    got = {r.doc_id: r for r in measured.collect()}
    assert got[1].lang == "en" and got[3].lang is None and got[4].lang == "xx" and got[1].repeated_words == plain_repeated(words(loop)) and got[1].repeated_sentences > 0.9
    assert sorted(str(r.doc_id) for r in measured.where(repetition.is_repetitive()).collect()) == ["1", "None"]
    scored = repetition.strata(measured)
    out = repetition.rejected(scored, repetition.sure_cutoffs(scored.where("is_held_out")))
    assert out.count() == 6 and not any(r.is_rejected for r in out.collect())  # too few to be sure of anything
    cutoffs = spark.createDataFrame([("en/middle", 0.5)], "stratum string, cutoff double")
    assert [r.doc_id for r in repetition.rejected(scored, cutoffs).where("is_rejected").collect()] == [1]
    assert repetition.measures(documents.limit(0)).count() == 0 and repetition.strata(measured.limit(0)).count() == 0


def test_cutoffs_keep_the_risk_on_documents_not_held_out(spark):
    """Labels of the held out half only; the other half is counted afterwards. Rare languages share strata."""
    r = random.Random(2)
    rows = []
    for k in range(12_000):
        bad = r.random() < 0.04
        rows.append((k, r.choice(["en"] * 60 + ["de"] * 39 + ["xy", None]) if k % 300 else f"rare{k}", 40, 20 if bad else 0, r.uniform(0.5, 1) if bad else min(1.0, r.expovariate(14)), 0.0))
    measured = spark.createDataFrame(rows, "doc_id bigint, lang string, word_count bigint, repeated_words bigint, repeated_sentences double, repeated_paragraphs double").repartition(4)
    scored = repetition.strata(measured)
    assert {x.stratum for x in scored.select("stratum").distinct().collect()} == {"en/short", "de/short", "other/short"}
    assert scored.where("is_held_out").count() == pytest.approx(6000, abs=300)
    # Labels outside the held out half play no part.
    turned = scored.withColumn("good", F.when(F.col("is_held_out"), F.col("good")).otherwise(~F.col("good")))
    cutoffs = {x.stratum: x.cutoff for x in repetition.sure_cutoffs(turned.where("is_held_out")).collect()}
    decided = repetition.rejected(scored, repetition.sure_cutoffs(scored.where("is_held_out")))
    found = {x.stratum: x for x in repetition.risks(decided).collect()}
    assert found["en/short"].cutoff == cutoffs["en/short"] and found["en/short"].false_rate <= repetition.RISK and found["en/short"].rejected >= 0.9 * found["en/short"].repetitive > 50
    assert sum(x.good + x.repetitive for x in found.values()) == scored.where("NOT is_held_out").count()
