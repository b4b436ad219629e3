"""Leak search against the plain rule over all documents and items."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbrook.llm import leaks
from plumbrook.llm.words import words


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def holds(document, item):
    d, t = words(document), words(item)
    if not t:
        return False
    n, size = len(t), min(12, len(t))
    passages = {tuple(t[i : i + size]) for i in range(n - size + 1)}
    if any(tuple(d[i : i + size]) in passages for i in range(len(d) - size + 1)):
        return True
    if n < 20:
        return False
    stretch = n * 3 // 2
    return any(10 * longest_common(t, d[s : s + stretch]) >= 7 * n for s in range(max(1, len(d) - stretch + 1)))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    common = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.6 else f"t{r.randint(0, 5000)}" for _ in range(n))
    items = [text(n) for n in (1, 2, 3, 4, 5, 6, 8, 11, 12, 13, 19, 20, 21, 25, 30, 37, 45, 60, 80, 97, 140)]
    items += ["", None, items[10], "<b>Straße</b> und ­Markt ﬁnden wir"]
    documents = [text(r.randint(0, 120)) for _ in range(60)]
    for item in items:
        own = words(item)
        if not own:
            continue
        for keep in (1.0, 0.85, 0.72, 0.66):
            kept = [w if r.random() < keep else r.choice(["", "zz"]) for w in own]
            documents.append(f"{text(r.randint(0, 90))} {' '.join(kept)} {text(r.randint(0, 90))}")
        k = r.randint(0, max(0, len(own) - 12))
        documents.append(f"{text(50)} {' '.join(own[k : k + 12])} {text(50)}")
        documents.append(f"{text(50)} {' '.join(own[k : k + 11])} {text(50)}")
        spread = [x for w in own for x in ((w, "pad") if r.random() < 0.35 else (w,))]
        documents.append(" ".join(spread))
    documents += ["", None, text(60_000) + " " + items[17] + " " + text(30_000), "STRASSE <i>strasse</i> STRAße UND MARKT finden​ wir", items[15].replace(" ", " <br> ")]
    return documents, items


def test_against_plain_rule(spark, corpus):
    documents, items = corpus
    df = spark.createDataFrame(list(enumerate(documents)), "doc_id bigint, text string").repartition(3)
    held = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, "nobody")], "eval_id bigint, item_text string")
    got = sorted(tuple(r) for r in leaks.leaks(df, held).collect())
    short = [(i, d) for i, d in enumerate(documents) if d is None or len(d) < 50_000]
    want = sorted((i, k) for i, d in short for k, t in enumerate(items) if holds(d, t))
    assert [g for g in got if g[0] in {i for i, _ in short}] == want and len(want) > 100
    long = next(i for i, d in enumerate(documents) if d and len(d) > 50_000)
    assert (long, 17) in got


def test_units_of_few_distinct_shingles_are_found():
    """Repeated words: too few distinct shingles for equal MinHash values to be sure."""
    r = random.Random(4)
    items = [" ".join(f"i{k}x{j % d}" for j in range(n)) for d in (1, 2, 3, 5) for n in (6, 8, 11, 12, 13, 20, 24, 40) for k in [100 * d + n]]
    index = leaks.Index(list(enumerate(items)))
    parts, want = [], []
    for _ in range(12):
        for k, item in enumerate(items):
            own = words(item)
            size, pad = min(12, len(own)), lambda: [f"p{r.randint(0, 10**6)}" for _ in range(r.randint(20, 60))]
            a = r.randint(0, len(own) - size)
            parts.append(pad() + own[a : a + size] + pad())
            want.append(k)
            parts.append(own[: size - 1])  # the next part goes on with the missing word
            want.append(None)
            parts.append(own[size - 1 : size])
            want.append(None)
            if len(own) >= 20:
                gap = iter(range(10**6))
                parts.append(pad() + [w for j, w in enumerate(own) for w in ((w,) if j % 4 else (f"g{next(gap)}",))] + pad())
                want.append(k)
    found = index.found(parts)
    for part, got, k in zip(parts, found, want, strict=True):
        assert (k is None or k in got) and got == {j for j, t in enumerate(items) if (j == k or k is None) and holds(" ".join(part), t)}


def test_least_shared():
    assert leaks.least_shared(leaks.Counter("abcdefghijklmnopqrst")) == 14 and leaks.least_shared(leaks.Counter("abcde" * 4)) == 4 and leaks.least_shared(leaks.Counter("a" * 20)) == 1


def test_blocks_of_items(spark, corpus, monkeypatch):
    documents, items = corpus
    df = spark.createDataFrame(list(enumerate(documents[:150])), "doc_id bigint, text string")
    held = spark.createDataFrame(list(enumerate(items)), "eval_id bigint, item_text string")
    whole = sorted(tuple(r) for r in leaks.leaks(df, held).collect())
    monkeypatch.setattr(leaks, "BLOCK", 7)
    assert sorted(tuple(r) for r in leaks.leaks(df, held).collect()) == whole
    assert leaks.leaks(df.limit(0), held).count() == 0 and leaks.leaks(df, held.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=20, max_size=40), st.lists(st.sampled_from("abcdefgh"), max_size=80))
def test_order_check(item, window):
    stretch, need = len(item) * 3 // 2, -(-7 * len(item) // 10)
    want = any(longest_common(item, window[s : s + stretch]) >= need for s in range(max(1, len(window) - stretch + 1)))
    assert leaks.holds_in_order(item, window) is want


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 400), st.integers(0, 9), st.sampled_from([(24, 12), (10, 5), (109, 36), (16, 8)]))
def test_windows_hold_every_stretch(length, before, sizes):
    window, hop = sizes
    reach = window - hop
    offsets = np.array([0, before, before, before + length, before + length + 3])
    numbers = np.arange(offsets[-1], dtype=np.uint64) + np.uint64(1000)
    for s in range(max(1, length - reach + 1)):
        first, last = before + s, before + min(length, s + reach) - 1
        units = leaks.Units(1)
        units.add(7, units.add_class(window, hop), 1 if first == last else 3, {1000 + first: 1, 1000 + last: 1 if first == last else 2})
        item, part, begin, end, _ = units.close().search(numbers, offsets)
        assert set(item.tolist()) == {7} and set(part.tolist()) == {2} and all(a <= first and last < b <= before + length for a, b in zip(begin, end, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 12), st.integers(1, 5), min_size=1), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 14), max_size=30), min_size=1, max_size=4), st.integers(1, 12))
def test_what_is_left_aside_loses_no_unit(weights, parts, needed):
    units = leaks.Units(1)
    for k, w in enumerate(weights):
        units.add(k, units.add_class(40, 20), min(needed, sum(w.values())), w)
    units.close()
    offsets = np.cumsum([0] + [len(p) for p in parts])
    item, part, *_ = units.search(np.array([x for p in parts for x in p], dtype=np.uint64), offsets)
    want = {(k, p) for k, w in enumerate(weights) for p, own in enumerate(parts) if sum(n for e, n in w.items() if e in own) >= min(needed, sum(w.values()))}
    assert set(zip(item.tolist(), part.tolist(), strict=True)) == want


def test_needed_counts():
    assert leaks.least_count(0.4, 64) >= 5 and leaks.least_count(1.0, 64) == 64 and leaks.least_count(0.01, 64) == 0
    assert leaks.needed_words(20) == 14 and leaks.needed_words(21) == 15


def test_common_words_start_no_search():
    """Items that share most words with all documents: few windows are counted, fewer verified."""
    r = random.Random(5)
    common = [f"w{k}" for k in range(30)]
    text = lambda n, own: [r.choice(common) if r.random() < 0.35 else f"{own}{r.randint(0, 10**6)}" for _ in range(n)]
    items = [text(40, "i") for _ in range(200)]
    parts = [text(120, "d") for _ in range(400)] + [text(20, "e") + items[3] + text(20, "e")]
    index = leaks.Index([(k, " ".join(t)) for k, t in enumerate(items)])
    found = index.found(parts)
    assert found[-1] == {3} and not any(found[:-1])
    assert index.counted < len(parts) * len(items) / 10 and index.verified < 20


def test_segments_cover_everything():
    tokens = [str(k) for k in range(100_000)]
    parts = list(leaks.segments(tokens, 300))
    assert parts[0][0] == "0" and parts[-1][-1] == "99999" and all(a[-300:] == b[:300] for a, b in zip(parts, parts[1:], strict=False))


def test_words():
    assert words("Ab-c_d <i>e</i>&1²­x ＦＵＬＬ é <" + "y" * 41 + ">") == ["ab", "c", "d", "e", "12x", "full", "é", "y" * 41]
    assert words(None) == words("") == words("<br>") == []


def test_equal_items_each_leak_and_are_searched_once():
    text = " ".join(f"w{k}" for k in range(30))
    index = leaks.Index([(1, text), (2, text.upper()), (3, f"<b>{text}</b>"), (4, "other words")])
    assert index.ids == [[1, 2, 3], [4]] and index.found([words(f"x {text} y")]) == [{0}]


def test_steps_of_a_search_do_not_matter(monkeypatch):
    r = random.Random(6)
    items = [" ".join(r.choice("abcdefghijklmnop") for _ in range(n)) for n in (5, 12, 20, 25, 40) for _ in range(6)]
    parts = [[r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 200))] for _ in range(30)]
    for k, item in enumerate(items):
        parts[k][5:5] = [w for w in item.split() if r.random() < 0.9]
    whole = leaks.Index(list(enumerate(items))).found(parts)
    monkeypatch.setattr(leaks, "_STEP", 7)
    assert leaks.Index(list(enumerate(items))).found(parts) == whole and any(whole)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aé\n\t\r  ​­﻿\U000e0061<>ﬁ²"), st.characters()), max_size=40))
def test_words_without_the_shortcut(text):
    import re
    import unicodedata

    plain = "".join(c for c in text if unicodedata.category(c) != "Cf")
    plain = unicodedata.normalize("NFKC", re.sub("<[^<>]{0,40}>", " ", plain).lower())
    assert words(text) == ["".join(g) for g in re.findall(r"[^\W_]+", plain)]
