"""Operator 12: periodic runs of words, by suffix trees and Lyndon roots.

A run is a stretch of words with smallest period q that can't be extended, here of
length >= max(24, 3q). A document's words are made numbers; Ukkonen's algorithm
builds the suffix trees of the words and of their reversal. A tour of a tree gives
the order of suffixes and the depths of the branches between them; the longest
common extension of two places is the least depth between their leaves, found in
constant time by block minima and a sparse table over blocks. By the theorem on
runs, each run has a Lyndon root that is the longest Lyndon word at its place under
the order of words or under the inverse order: these 2n candidates (up to the next
smaller suffix) are extended to both sides by the two trees, all at once in numpy.

Trees are built only of stretches where runs can be: a run of such a length has all
its words in 16-word windows that occur once more in the document, so stretches
that no repeated window covers are left out. Equal hashes of windows only add
stretches. A tree needs about 500 bytes for each word of the longest stretch.

Null and empty texts have no words: no runs, empty text kept. A null id has no
checksum, and `periodize` leaves its words alone. Repeated rows are documents of their
own. Empty tables give an empty result. The result has the named columns only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices, small_batches

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Every run of these limits has all words in repeated windows of so many words.
WINDOW = 16
BLOCK = 16
_WORD = re.compile(WORD)


class SuffixTree:
    """Suffix tree of numbers 1..k (a last 0 is added), by Ukkonen's algorithm; ranks of suffixes and common extensions."""

    def __init__(self, numbers: list[int]) -> None:
        self.n = len(numbers)
        self.text = [*numbers, 0]
        self.base = max(numbers, default=0) + 1
        self._build()
        self.order, lows = self._tour(False)
        self.rank = np.empty(self.n + 1, dtype=np.int64)
        self.rank[self.order] = np.arange(self.n + 1)
        self._blocks(lows)

    def _build(self) -> None:
        text, base, n = self.text, self.base, self.n + 1
        to: dict[int, int] = {}  # node * base + first number: child
        start, end, link = [0], [0], [0]
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            last = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * base + text[edge]
                child = to.get(key)
                if child is None:
                    to[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = start[child]
                    size = min(end[child], i + 1) - begin
                    if length >= size:
                        node, edge, length = child, edge + size, length - size
                        continue
                    if text[begin + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    to[key] = middle
                    to[middle * base + c] = middle + 1
                    to[middle * base + text[begin + length]] = child
                    start += (begin, i)
                    end += (begin + length, n)
                    link += (0, 0)
                    start[child] = begin + length
                    if last:
                        link[last] = middle
                    last = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(to.keys(), dtype=np.int64, count=len(to))
        self.parent, self.first = keys // base, keys % base
        self.child = np.fromiter(to.values(), dtype=np.int64, count=len(to))
        self.size = np.array(end, dtype=np.int64) - np.array(start, dtype=np.int64)

    def _tour(self, inverse: bool) -> tuple[list[int], list[int]]:
        """Suffixes in the order of the tree's leaves, and the depth of the branch before each; under the inverse order ends come first as well."""
        first = np.where(self.first > 0, self.base - self.first, 0) if inverse else self.first
        at = np.lexsort((-first, self.parent))  # a stack takes the last child first
        children = self.child[at].tolist()
        bounds = np.searchsorted(self.parent[at], np.arange(len(self.size) + 1)).tolist()
        size, whole = self.size.tolist(), self.n + 1
        order, lows, low = [], [], 0
        nodes, depths = [0], [0]
        while nodes:
            node, depth = nodes.pop(), depths.pop()
            if depth < low:
                low = depth
            depth += size[node]
            a, b = bounds[node], bounds[node + 1]
            if a == b:
                order.append(whole - depth)
                lows.append(low)
                low = whole
            else:
                nodes += children[a:b]
                depths += [depth] * (b - a)
        return order, lows

    def inverse_rank(self) -> np.ndarray:
        rank = np.empty(self.n + 1, dtype=np.int64)
        rank[self._tour(True)[0]] = np.arange(self.n + 1)
        return rank

    def _blocks(self, lows: list[int]) -> None:
        n = -(-len(lows) // BLOCK) * BLOCK
        x = np.full(n, self.n + 1, dtype=np.int32)
        x[: len(lows)] = lows
        x = x.reshape(-1, BLOCK)
        self.lows = x.ravel()
        self.heads, self.tails = np.minimum.accumulate(x, axis=1).ravel(), np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [x.min(axis=1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def extensions(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j (i < j <= n)."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        first, last = low // BLOCK, high // BLOCK
        found = np.minimum(self.tails[low], self.heads[high])
        inner = last - first - 1
        for level, mins in enumerate(self.table):
            at = np.flatnonzero((inner >= 1 << level) & (inner < 2 << level))
            found[at] = np.minimum(found[at], np.minimum(mins[first[at] + 1], mins[last[at] - (1 << level)]))
        for at in np.array_split(np.flatnonzero(inner < 0), max(1, len(i) >> 14)):  # both in one block
            places = low[at, None] + np.arange(BLOCK)
            found[at] = np.where(places <= high[at, None], self.lows[np.minimum(places, len(self.lows) - 1)], self.n + 1).min(axis=1, initial=self.n + 1)
        return found.astype(np.int64)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the last (empty) one the next with a smaller rank: where the longest Lyndon word ends."""
    ranks, found, stack = rank.tolist(), [0] * (len(rank) - 1), [len(rank) - 1]
    for i in range(len(rank) - 2, -1, -1):
        r = ranks[i]
        while ranks[stack[-1]] > r:
            stack.pop()
        found[i] = stack[-1]
        stack.append(i)
    return np.array(found, dtype=np.int64)


def runs_of(numbers: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """(start, length, period) of all runs of a stretch of numbers (1 and more), by start, then period."""
    n = len(numbers)
    forward, backward = SuffixTree(numbers.tolist()), SuffixTree(numbers[::-1].tolist())
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([next_smaller(forward.rank), next_smaller(forward.inverse_rank())])
    left, right = backward.extensions(n - j, n - i), forward.extensions(i, j)
    found = np.stack([i - left, j - i + left + right, j - i], axis=1)
    found = found[(found[:, 1] >= least_length) & (found[:, 1] >= least_exponent * found[:, 2])]
    return np.unique(found, axis=0)[:, :3] if len(found) else found


def stretches(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words that lie in windows which occur more than once; all runs are inside them."""
    if len(numbers) < LEAST_LENGTH:
        return []
    h = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in (1, 2, 4, 8):
        h = h[:-k] * np.uint64(0xD6E8FEB86659FD93) + h[k:]
        h ^= h >> np.uint64(32)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    starts = np.flatnonzero(np.isin(h, twice))
    steps = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    inside = np.concatenate([[False], np.cumsum(steps)[:-1] > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    return [(a, b) for a, b in edges.tolist() if b - a >= LEAST_LENGTH]


def periodic_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's words."""
    known: dict[str, int] = {}
    numbers = np.array([known.setdefault(x, len(known)) for x in words], dtype=np.int64)
    found = []
    for a, b in stretches(numbers):
        runs = runs_of(np.unique(numbers[a:b], return_inverse=True)[1] + 1)
        found += [(a + start, length, period) for start, length, period in runs.tolist()]
    return found


def periodize(words: list[str], doc_id: int | None) -> list[str]:
    """Makes the end of a tenth of documents (by checksum of the id) periodic."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + period] * (1 + (n - a) // period))[: n - a]


RESULT = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapse_runs(docs: DataFrame, change: Callable[[list[str], int | None], list[str]] = lambda words, _: words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (by start, then period), collapsed: the words, one space between them, without what runs repeat after their first period.

    `change` may alter the words before.
    """
    small_batches(docs.sparkSession)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            all_runs, texts = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = change(_WORD.findall(text or ""), doc_id)
                found = periodic_runs(words)
                if found:
                    dropped = np.zeros(len(words) + 1, dtype=np.int64)
                    for start, length, period in found:
                        dropped[start + period] += 1
                        dropped[start + length] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(dropped)[:-1] == 0).tolist()]
                all_runs.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in found])
                texts.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(all_runs, type=pa.list_(run_type)), pa.array(texts, type=pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, {RESULT}")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (ties: least start, then period), hashes of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
