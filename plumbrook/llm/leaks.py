"""Test passages inside documents by size-partitioned MinHash containment search.

Rule: a document leaks an item if it holds PASSAGE consecutive words of it (the whole item if it is
shorter), or, for items of LONG words or more, if a stretch of at most 1.5 times the item's words
holds at least 70 % of the item's words in the item's order.

Method: items are cut into units: passages as sets of five-word shingles for the first rule, whole
items as sets of words for the second. A unit's sketch holds, for each of a number of hash functions,
the element of least hash value. The chance that this element lies in a set that holds the share c of
the unit is c, whatever the size of that set, so the number of sketch elements found in a set measures
the containment of the unit in it. Sizes are partitioned: units of like size form a class, and for each
class the document is cut into overlapping windows in proportion to the class, such that any stretch
that satisfies the rule lies in one window. A window that holds a passage holds all of its sketch; one
that satisfies the second rule holds at least the share of distinct words that is left when the words
lost are those that cost most distinct ones, and the number of sketch elements asked for is missed by
such a window with a probability under MISS. Units of so small a share that not even one element is sure
take the counts of all their words in place of the sketch, which misses none.

Candidates: of a unit's elements those that occur most often in the texts at hand are left aside as long
as they can't make up the needed number by themselves; only the others are looked up, so that common words
start nothing.
What a window then holds of the whole sketch is counted, and candidates are verified exactly, by
shingles and by order.

The items are a stated query set: they are indexed in blocks of bounded words, each sent to all tasks;
documents are read once per block and never shuffled. Documents of any length are processed whole, in
overlapping segments.

Defined results: null or wordless texts and items hold nothing and leak nothing; equal items each leak;
an empty table of either gives no rows; rows are distinct.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbrook.llm.words import words

PASSAGE, SHINGLE, LONG = 12, 5, 20
KEPT_TENTHS, STRETCH_HALVES = 7, 3
#: Hash functions of the sketches of shingle sets and of word sets.
PASSAGE_HASHES, WORD_HASHES = 16, 256
#: Greatest probability that the search misses a true case.
MISS = 1e-6
CLASS_RATIO = 1.2
#: Items and characters of items that are indexed at once; a block is held by every Python worker.
BLOCK, BLOCK_CHARACTERS = 20_000, 4_000_000
SEGMENT = 50_000
_FOUND = pa.schema([("doc_id", pa.int64()), ("eval_id", pa.int64())])

_random = np.random.Generator(np.random.PCG64(20_240))
_SEEDS = _random.integers(1, 1 << 63, WORD_HASHES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.empty(0, np.int64)
#: Places that are looked at in one step, which bounds the memory of a search.
_STEP = 500_000


def hashes(numbers: np.ndarray, count: int) -> np.ndarray:
    """One row of `count` 64-bit hash values per number."""
    x = numbers[:, None] ^ _SEEDS[None, :count]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def sketch(elements: np.ndarray, count: int) -> Counter[int]:
    """The elements of least hash value, with the number of hash functions that choose them."""
    chosen = elements[hashes(elements, count).argmin(axis=0)]
    return Counter(chosen.tolist())


def shingles(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words, by the position of its first word; of single words their number."""
    if size == 1:
        return numbers
    out = np.zeros(max(0, len(numbers) - size + 1), dtype=np.uint64)
    for k in range(size):
        out = out * _P + numbers[k : k + len(out)]
    return out * _P


class _Numbers(dict):
    """A 64-bit number per word, the same everywhere."""

    def __missing__(self, word: str) -> int:
        n = self[word] = xxhash.xxh64_intdigest(word)
        return n


_numbers = _Numbers()


def word_numbers(tokens: list[str]) -> np.ndarray:
    if len(_numbers) > 500_000:  # a cache: it is bounded
        _numbers.clear()
    return np.fromiter(map(_numbers.__getitem__, tokens), np.uint64, len(tokens))


@lru_cache(maxsize=65536)
def least_count(share: float, count: int, miss: float = MISS) -> int:
    """The largest number of sketch elements that a set with this share of a unit falls short of with probability < miss."""
    if share >= 1:
        return count
    total, k = 0.0, 0
    while k < count:
        total += math.exp(math.lgamma(count + 1) - math.lgamma(k + 1) - math.lgamma(count - k + 1) + k * math.log(share) + (count - k) * math.log1p(-share))
        if total >= miss:
            return k
        k += 1
    return count


class Units:
    """The units of all size classes whose elements are runs of `run` words, ready to be searched."""

    def __init__(self, run: int):
        self.run = run
        self.classes: list[tuple[int, int]] = []  # window and hop, in words
        self.rows: list[tuple[int, int, int, int, dict[int, int], dict[int, int]]] = []

    def add_class(self, window: int, hop: int) -> int:
        self.classes.append((window, hop))
        return len(self.classes) - 1

    def add(self, item: int, size_class: int, needed: int, weights: dict[int, int], most: int = 0, held: dict[int, int] | None = None) -> None:
        """A unit whose windows hold elements of a total weight of `needed`, and of a total of `held` of `most`."""
        self.rows.append((item, size_class, needed, most, weights, held or {}))

    def close(self) -> Units:
        elements = np.array(sorted({e for *_, weights, held in self.rows for e in {*weights, *held}}), dtype=np.uint64)
        place = {e: k for k, e in enumerate(elements.tolist())}
        self.elements, width = elements, max(1, len(elements))
        self.item, self.size_class, self.needed, self.most = (np.array([r[k] for r in self.rows], dtype=np.int64) for k in range(4))
        entries = sorted((number * width + place[e], weights.get(e, 0), held.get(e, 0)) for number, (*_, weights, held) in enumerate(self.rows) for e in {*weights, *held})
        self.keys, self.weight, self.held = (np.array([e[k] for e in entries], dtype=np.int64) for k in range(3))
        chosen = np.flatnonzero(self.weight)
        self.own_unit, self.own_place, self.own_weight = self.keys[chosen] // width, self.keys[chosen] % width, self.weight[chosen]
        self.rows = []
        return self

    def _starts(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units to look for from each element, and where those of an element begin.

        Of every unit's elements, the ones that occur most often here are left aside while their weights together
        are below the needed weight.
        """
        often = np.bincount(place, minlength=len(self.elements))[self.own_place]
        order = np.lexsort((-often, self.own_unit))
        unit = self.own_unit[order]
        upto = np.cumsum(self.own_weight[order])
        upto -= (upto - self.own_weight[order])[np.searchsorted(unit, unit)]
        order = order[upto >= self.needed[unit]]
        order = order[np.argsort(self.own_place[order], kind="stable")]
        return self.own_unit[order], np.searchsorted(self.own_place[order], np.arange(len(self.elements) + 1))

    def search(self, numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Item, part, first and last word of every window with enough of a unit, and how many windows were counted.

        numbers are those of the joined words of all parts, offsets the first word of each and the end.
        """
        own = shingles(numbers, self.run)
        if not len(own) or not len(self.elements):
            return _EMPTY, _EMPTY, _EMPTY, _EMPTY, 0
        part = np.searchsorted(offsets, np.arange(len(own)), "right") - 1
        place = np.searchsorted(self.elements, own)
        place[place == len(self.elements)] = 0
        known = (self.elements[place] == own) & (np.arange(len(own)) + self.run <= offsets[part + 1])
        at = np.flatnonzero(known)
        place = place[at]
        start_unit, first = self._starts(place)
        counts = first[place + 1] - first[place]
        found = [_EMPTY]
        total = np.cumsum(counts)
        done = 0
        while done < len(at):  # in steps, as many units may begin at one element
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _STEP, "right")))
            own = slice(done, upto)
            unit = start_unit[_expand(first[place[own]], counts[own])]
            found.append(np.unique(self._around(unit, np.repeat(at[own], counts[own]), part, offsets, len(numbers) + 1)))
            done = upto
        pairs = np.unique(np.concatenate(found))
        unit, begin = pairs // (len(numbers) + 1), pairs % (len(numbers) + 1)
        of = part[begin]
        end = np.minimum(begin + np.array([w for w, _ in self.classes], dtype=np.int64)[self.size_class[unit]], offsets[of + 1])
        enough = self._enough(unit, begin, end - self.run + 1, at, place)
        return self.item[unit[enough]], of[enough], begin[enough], end[enough], len(pairs)

    def _around(self, unit: np.ndarray, where: np.ndarray, part: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
        """The windows of each unit's class around its place in the texts, as unit * width + first word."""
        window, hop = np.array(self.classes, dtype=np.int64)[self.size_class[unit]].T
        of = part[where]
        length = offsets[of + 1] - offsets[of]
        inside = where - offsets[of]
        last = np.maximum(0, -((window - length) // hop))  # the first window that reaches the end
        low = np.minimum(np.maximum(0, -((window - self.run - inside) // hop)), last)
        high = np.minimum(inside // hop, last)
        spread = high - low + 1
        begin = np.repeat(offsets[of], spread) + _expand(low, spread) * np.repeat(hop, spread)
        return np.repeat(unit, spread) * width + begin

    def _enough(self, unit: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which windows hold the needed weight of the unit's elements, each counted once."""
        before = np.full(len(at), -1, dtype=np.int64)  # where the same element stood last
        order = np.argsort(place, kind="stable")
        same = np.flatnonzero(place[order][1:] == place[order][:-1])
        before[order[same + 1]] = at[order[same]]
        low, high = np.searchsorted(at, begin), np.searchsorted(at, end)
        out = np.zeros(len(unit), dtype=bool)
        total = np.cumsum(high - low)
        first = 0
        while first < len(unit):
            done = total[first - 1] if first else 0
            upto = max(first + 1, int(np.searchsorted(total, done + _STEP, "right")))
            size = (high - low)[first:upto]
            row, k = np.repeat(np.arange(first, upto), size), _expand(low[first:upto], size)
            new = before[k] < begin[row]
            row, k = row[new], k[new]
            key = unit[row] * len(self.elements) + place[k]
            entry = np.searchsorted(self.keys, key)
            entry[entry == len(self.keys)] = 0
            hit = self.keys[entry] == key
            row, entry = row[hit] - first, entry[hit]
            weight, held = (np.bincount(row, v[entry], minlength=upto - first) for v in (self.weight, self.held))
            out[first:upto] = (weight >= self.needed[unit[first:upto]]) & (held >= self.most[unit[first:upto]])
            first = upto
        return np.flatnonzero(out)


def _expand(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each count, joined."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Index:
    """All size classes of a block of items, and what verification needs."""

    def __init__(self, items: list[tuple[int, str | None]]):
        alike: dict[tuple[str, ...], list[int]] = {}
        for eval_id, text in items:
            if eval_id is not None and (own := words(text)):
                alike.setdefault(tuple(own), []).append(eval_id)
        #: Items of equal words are searched once.
        self.ids, self.tokens = list(alike.values()), [list(t) for t in alike]
        self.joined = [f" {' '.join(t)} " for t in self.tokens]
        self.bags = [Counter(t) for t in self.tokens]
        self.counted = self.verified = 0
        self.passages = [u.close() for u in self._passage_units().values()]
        self.whole = self._word_units().close()
        self.overlap = max([1, *(window for u in [*self.passages, self.whole] for window, _ in u.classes)])

    def _passage_units(self) -> dict[int, Units]:
        by_run: dict[int, Units] = {}
        classes: dict[int, int] = {}
        for k, tokens in enumerate(self.tokens):
            size = min(PASSAGE, len(tokens))
            run = min(SHINGLE, size)
            units = by_run.setdefault(run, Units(run))
            if size not in classes:
                classes[size] = units.add_class(2 * size, size)
            own = shingles(word_numbers(tokens), run)
            span = size - run + 1
            for elements in {frozenset(own[i : i + span].tolist()) for i in range(len(own) - span + 1)}:
                # All of a passage is held, so every hash function's element is.
                units.add(k, classes[size], PASSAGE_HASHES, sketch(np.array(sorted(elements), dtype=np.uint64), PASSAGE_HASHES))
        return by_run

    def _word_units(self) -> Units:
        units = Units(1)
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, tokens in enumerate(self.tokens):
            if len(tokens) >= LONG:
                by_size[int(math.log(len(tokens) / LONG, CLASS_RATIO))].append(k)
        for members in by_size.values():
            stretch = max(len(self.tokens[k]) for k in members) * STRETCH_HALVES // 2
            hop = max(1, stretch // 2)
            number = units.add_class(stretch + hop, hop)
            for k in members:
                bag = self.bags[k]
                elements = word_numbers(list(bag))
                held, most = dict(zip(elements.tolist(), bag.values(), strict=True)), needed_words(len(self.tokens[k]))
                needed = least_count(least_shared(bag) / len(bag), WORD_HASHES)
                if needed >= 1:
                    units.add(k, number, needed, sketch(elements, WORD_HASHES), most, held)
                else:
                    units.add(k, number, most, held, most, held)
        return units

    def found(self, parts: list[list[str]]) -> list[set[int]]:
        """The items, by position, that each of some segments of documents leaks."""
        out: list[set[int]] = [set() for _ in parts]
        offsets = np.cumsum([0] + [len(p) for p in parts])
        tokens = [w for p in parts for w in p]
        if not tokens:
            return out
        numbers = word_numbers(tokens)
        for units in [*self.passages, self.whole]:
            holds = self._holds_in_order if units is self.whole else self._holds_passage
            items, of, begin, end, counted = units.search(numbers, offsets)
            self.counted += counted
            for k, p, a, b in zip(items.tolist(), of.tolist(), begin.tolist(), end.tolist(), strict=True):
                if k not in out[p]:
                    self.verified += 1
                    if holds(k, tokens[a:b]):
                        out[p].add(k)
        return out

    def _holds_passage(self, k: int, window: list[str]) -> bool:
        size, joined = min(PASSAGE, len(self.tokens[k])), self.joined[k]
        return any(f" {' '.join(window[i : i + size])} " in joined for i in range(len(window) - size + 1))

    def _holds_in_order(self, k: int, window: list[str]) -> bool:
        n, bag = len(self.tokens[k]), self.bags[k]
        inside = Counter(w for w in window if w in bag)
        if sum(min(c, bag[w]) for w, c in inside.items()) < needed_words(n):
            return False
        return holds_in_order(self.tokens[k], window)


def needed_words(n: int) -> int:
    """The least whole number of words that is 70 % of n or more."""
    return -(-n * KEPT_TENTHS // 10)


def least_shared(bag: Counter[str]) -> int:
    """The fewest distinct words among any 70 % of an item's words: the rarest are lost first."""
    n, distinct = bag.total(), len(bag)
    lost = n - needed_words(n)
    for count in sorted(bag.values()):
        lost -= count
        if lost < 0:
            break
        distinct -= 1
    return distinct


def holds_in_order(item: list[str], window: list[str]) -> bool:
    """Whether some stretch of at most 1.5 times the item's words has 70 % of them in order.

    The longest common subsequence of item and stretch, by bit vectors over the item.
    """
    n = len(item)
    need, most, full = needed_words(n), n * STRETCH_HALVES // 2, (1 << n) - 1
    places: dict[str, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    masks = [places.get(w, 0) for w in window]

    def common(own: list[int]) -> int:
        v = full
        for m in own:
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return n - v.bit_count()

    if common(masks) < need:
        return False
    if len(masks) <= most:
        return True
    hits = np.cumsum([0] + [m > 0 for m in masks])
    for s, m in enumerate(masks):
        if m and hits[min(len(masks), s + most)] - hits[s] >= need and common(masks[s : s + most]) >= need:
            return True
    return False


def segments(tokens: list[str], overlap: int) -> Iterator[list[str]]:
    """The whole document in overlapping pieces, each small enough for its hash values to be held."""
    step = max(SEGMENT, 2 * overlap)
    for start in range(0, max(1, len(tokens) - overlap), step):
        yield tokens[start : start + step + overlap]


def _search(documents: DataFrame, items: list[tuple[int, str | None]]) -> DataFrame:
    index = documents.sparkSession.sparkContext.broadcast(Index(items))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            found: set[tuple[int | None, int]] = set()
            parts: list[list[str]] = []
            docs: list[int | None] = []
            size = 0

            def close() -> None:
                for doc_id, items in zip(docs, own.found(parts), strict=True):  # noqa: B023
                    found.update((doc_id, eval_id) for k in items for eval_id in own.ids[k])  # noqa: B023

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in segments(words(text.as_py()), own.overlap):
                    parts.append(part)
                    docs.append(doc_id)
                    size += len(part)
                    if size >= SEGMENT:
                        close()
                        parts, docs, size = [], [], 0
            close()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([e for _, e in found], pa.int64())], schema=_FOUND)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id bigint, eval_id bigint")


def leaks(documents: DataFrame, eval_item: DataFrame) -> DataFrame:
    """doc_id, eval_id of every document and item that it leaks."""
    picked = eval_item.select(F.col("eval_id").cast("bigint").alias("eval_id"), F.col("item_text").cast("string").alias("item_text")).distinct()
    size = picked.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.length("item_text")), F.lit(0)).alias("characters")).first()
    blocks = max(1, math.ceil(size["items"] / BLOCK), math.ceil(size["characters"] / BLOCK_CHARACTERS))
    out = None
    for k in range(blocks):
        block = picked.where(F.pmod(F.xxhash64("eval_id", "item_text"), F.lit(blocks)) == k)
        found = _search(documents, [tuple(r) for r in block.collect()])
        out = found if out is None else out.unionByName(found)
    return out.distinct()
