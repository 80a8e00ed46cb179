"""Operator 7: benchmark decontamination by SimHash of item-sized windows.

A window of a document has as many words as an item; a shorter document is one
window. Window and item have 64-bit SimHashes of their word shingles (SHINGLE
words; case and ASCII punctuation don't count), made by prefix sums of bits, in
which a shingle counts by the root of its weight: the cosine of two such vectors
is by weights then, as the similarity is. Item fingerprints are
indexed by BLOCKS bit blocks: of two fingerprints within RADIUS bits, some block
differs in RADIUS // BLOCKS bits at most, so looking up each block and its
neighbours finds all items within the radius. A candidate's similarity is then
computed exactly: weighted Jaccard of the shingle multisets, where a shingle of
the item weighs 1 / (number of items that have it), and any other one 1.

A window that is similar enough has all but a share of 1 - SIMILARITY of the item's weight, so it
has one of the item's seeds: its heaviest (rarest) shingles, as many as weigh more than that share. Only windows
around seeds are fingerprinted, and only for the items whose seed they have (by lists of
the items of each seed); nothing is lost by that, and a shingle of most items is hardly ever a seed.

The benchmark is read in blocks, dealt by a hash of id and text until each has at most MOST_ITEMS items and
MOST_BYTES of text (or is a single item); several blocks are broadcast together, up to MOST_BLOCKS a pass over the documents.
Documents are never shuffled.

Null or empty texts and items match nothing. Items under SHINGLE words are one
shingle of their own length. Repeated rows are matched each by itself, null ids like others; items that are equal in id and text
count once, items with equal or null ids are items of their own. Empty tables give an empty result. The result has only the named
columns.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices, small_batches
from .shingles import mix, shingles, text_batches, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 10
MOST_ITEMS = 20_000
MOST_BYTES = 16 << 20
MOST_BLOCKS = 4
#: Cells of a table of windows and items.
MOST_CELLS = 1 << 22
_FILTER = 1 << 22
#: Weights in sums of bits are integers, so that equal windows have equal sums.
_UNIT = 1 << 16
_EDGES = [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def bits_of(values: np.ndarray) -> np.ndarray:
    """-1 or 1 for each of 64 bits."""
    bits = np.unpackbits(mix(values ^ np.uint64(0x51A5)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int16) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1).view(">u8").ravel().astype(np.uint64)


class Index:
    """Items of one block of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]], counts: dict[int, int] | None = None):
        self.ids, self.shingles, self.words = [], [], []
        for item_id, text in sorted(set(items), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            words, _ = word_hashes([(text or "").lower()], punctuation=False)
            if len(words):
                self.ids.append(item_id)
                self.words.append(len(words))
                self.shingles.append(np.sort(shingles(words, SHINGLE)))
        have: dict[int, int] = defaultdict(int)
        for x in self.shingles:
            for v in set(x.tolist()):
                have[v] += 1
        #: of the whole benchmark, where this is a block of it
        have = {v: (counts or {}).get(v, n) for v, n in have.items()}
        self.vocabulary = np.array(sorted(have), dtype=np.uint64)
        self.weights = np.array([1 / have[v] for v in sorted(have)])
        self.maybe = np.zeros(_FILTER, dtype=bool)
        self.maybe[(self.vocabulary % np.uint64(_FILTER)).astype(np.int64)] = True
        self.roots = np.maximum(1, np.rint(_UNIT * np.sqrt(self.weights))).astype(np.int64)
        self.prints = np.array([packed(self.weighted_bits(x).sum(axis=0))[0] for x in self.shingles], dtype=np.uint64)
        self.lengths = sorted(set(self.words))
        self.words_of = np.array(self.words, dtype=np.int64)
        # the items of each seed, one list after the other
        seeds = [self.seeds_of(x) for x in self.shingles]
        at = np.concatenate([np.zeros(0, dtype=np.uint64), *seeds])
        order = np.argsort(at, kind="stable")
        self.having = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])[order].astype(np.int32)
        self.seeds, first = np.unique(at[order], return_index=True)
        self.having_at = np.append(first, len(at))
        #: by length: its items, and for each block which of them lie next to each value of the block
        self.tables: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for n in self.lengths:
            own = np.flatnonzero(np.array(self.words) == n)
            near = []
            for low, high in zip(_EDGES[:-1], _EDGES[1:], strict=True):
                values = (self.prints[own] >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
                near.append(np.bitwise_count(np.arange(1 << (high - low), dtype=np.uint64)[:, None] ^ values) <= RADIUS // BLOCKS)
            self.tables[n] = own, near

    def known(self, values: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Whether each value is a shingle of some item (or one of some sorted shingles of items)."""
        among = self.vocabulary if among is None else among
        out = self.maybe[(values % np.uint64(_FILTER)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            found = np.minimum(np.searchsorted(among, values[at]), len(among) - 1)
            out[at] = among[found] == values[at]
        return out

    def seeds_of(self, item: np.ndarray) -> np.ndarray:
        """The heaviest shingles of an item, of which together every window with SIMILARITY to it lacks some weight: it has one of them."""
        own, n = np.unique(item, return_counts=True)
        weights = self.weights[np.searchsorted(self.vocabulary, own)]
        order = np.argsort(-weights, kind="stable")
        total = np.cumsum((weights * n)[order])
        # a little more than the share, so that rounding loses no shingle
        return own[order[: np.searchsorted(total, (1 - SIMILARITY) * (1 + 1e-9) * total[-1], side="right") + 1]]

    def weighted_bits(self, values: np.ndarray) -> np.ndarray:
        """The bits of each value by the root of its weight: 1 / number of items that have it, or 1."""
        root = np.full(len(values), _UNIT, dtype=np.int64)
        at = np.flatnonzero(self.known(values))
        root[at] = self.roots[np.searchsorted(self.vocabulary, values[at])]
        return bits_of(values) * root[:, None]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard of two shingle multisets."""
        own, n = np.unique(window, return_counts=True)
        other, m = np.unique(self.shingles[item], return_counts=True)
        both = np.union1d(own, other)
        a, b = np.zeros(len(both)), np.zeros(len(both))
        a[np.searchsorted(both, own)], b[np.searchsorted(both, other)] = n, m
        at = np.minimum(np.searchsorted(self.vocabulary, both), len(self.vocabulary) - 1)
        weight = np.where(b > 0, self.weights[at], 1.0)
        return float((np.minimum(a, b) * weight).sum() / (np.maximum(a, b) * weight).sum())

    def items_with(self, values: np.ndarray) -> np.ndarray:
        """The items that have one of these seeds."""
        at = np.unique(np.searchsorted(self.seeds, values))
        if len(at) == 1:
            return self.having[self.having_at[at[0]] : self.having_at[at[0] + 1]]
        low = self.having_at[at]
        return np.unique(self.having[ranges(low, self.having_at[at + 1] - low)])

    def candidates(self, prints: np.ndarray, n: int, items: np.ndarray | None = None) -> list[tuple[int, int]]:
        """(window, item) pairs of which the fingerprints are within RADIUS, among (some) items of n words."""
        own, near = self.tables[n]
        column = np.arange(len(own)) if items is None else np.searchsorted(own, items)
        found = np.zeros((len(prints), len(column)), dtype=bool)
        for low, high, table in zip(_EDGES[:-1], _EDGES[1:], near, strict=True):
            value = ((prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)
            found |= table[value[:, None], column]
        window, item = np.nonzero(found)
        item = own[column[item]]
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return list(zip(window[close].tolist(), item[close].tolist(), strict=True))

    def matches(self, words: np.ndarray, values: np.ndarray, hits: np.ndarray, k: int) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of one text's best window for each item found."""
        best: dict[int, tuple[float, int, int]] = {}
        # hits that no window has together are looked at apart
        for near in np.split(hits, np.flatnonzero(np.diff(hits) > self.lengths[-1]) + 1):
            items = self.items_with(values[near])
            for n in np.unique(self.words_of[items]).tolist():
                if min(n, SHINGLE) != k:
                    continue
                own = items[self.words_of[items] == n]
                size = min(n, len(words))
                span = size - k + 1  # shingles of a window
                starts = np.unique(np.concatenate([near - j for j in range(span)]))
                starts = starts[(starts >= 0) & (starts + span <= len(values))]
                step = max(64, min(4096, MOST_CELLS // len(own)))
                # runs of starts with what their windows cover
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
                    for at in range(0, len(run), step):
                        part = run[at : at + step]
                        low, high = part[0], part[-1] + span
                        sums = np.zeros((high - low + 1, 64), dtype=np.int64)
                        np.cumsum(self.weighted_bits(values[low:high]), axis=0, out=sums[1:])
                        prints = packed(sums[part - low + span] - sums[part - low])
                        for w, item in self.candidates(prints, n, own):
                            score = self.similarity(values[part[w] : part[w] + span], item)
                            if score >= SIMILARITY and score > best.get(item, (0.0,))[0]:
                                best[item] = (score, int(part[w]), size)
        for item, (score, start, size) in sorted(best.items()):
            yield item, score, start, size


def find_matches(texts: list[str | None], indexes: list[Index]) -> Iterator[tuple[int, int | None, float, int, int]]:
    """(text, item id, similarity, first word, words) of every match of some texts."""
    words, owner = word_hashes([(x or "").lower() for x in texts], punctuation=False)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in sorted({min(n, SHINGLE) for index in indexes for n in index.lengths}):
        if len(words) < k:
            continue
        values = shingles(words, k)
        one_text = owner[: len(values)] == owner[k - 1 :]
        for index in indexes:
            if not len(index.vocabulary):
                continue
            hits = np.flatnonzero(index.known(values, index.seeds) & one_text)
            for i in np.unique(owner[hits]):
                a, b = bounds[i], bounds[i + 1]
                own = hits[slice(*np.searchsorted(hits, [a, b]))] - a
                for item, score, start, size in index.matches(words[a:b], values[a : b - k + 1], own, k):
                    yield int(i), index.ids[item], score, start, size


def item_counts(items: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """How many items have each of some shingles (of one block: bounded)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                words, _ = word_hashes([(text or "").lower()], punctuation=False)
                yield pd.DataFrame({"v": np.unique(shingles(words, SHINGLE)).view(np.int64)})

    own = items.sparkSession.createDataFrame([(int(v),) for v in wanted.view(np.int64)], "v long")
    rows = items.mapInPandas(of, "v long").groupBy("v").agg(F.count("*").alias("n")).join(F.broadcast(own), "v").collect()
    return {r["v"] % (1 << 64): r["n"] for r in rows}


def _dealt(items: DataFrame) -> tuple[DataFrame, int]:
    """The items with a block each, and the number of blocks: doubled until the sizes of all are in bounds."""
    key = F.xxhash64(F.lit("block"), "item_id", "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = 1 + int(max(n // MOST_ITEMS, size // MOST_BYTES))
    while True:
        dealt = items.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int"))
        too_large = (F.col("n") > MOST_ITEMS) | (F.col("size") > MOST_BYTES)
        if blocks >= 2 * n or dealt.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).filter(too_large & (F.col("n") > 1)).isEmpty():
            return dealt, blocks
        blocks *= 2


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words, key: the best window of each document for each item it has; the key is xxhash64 of the text."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("text is not null").distinct()
    dealt, blocks = _dealt(items)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).filter("text is not null")
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long, key long"
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def index_of(block: int):
        own = [tuple(x) for x in dealt.filter(F.col("block") == block).select("item_id", "text").collect()]
        index = Index(own)
        if blocks > 1 and len(index.vocabulary):
            index = Index(own, item_counts(items, index.vocabulary))
        return spark.sparkContext.broadcast(index)

    def against(indexes: list) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                ids, keys, texts = (batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))
                out = []
                for a, b in text_batches(texts):
                    out += [(ids[a + i], *x, keys[a + i]) for i, *x in find_matches(texts[a:b], [x.value for x in indexes])]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

        return rows.mapInArrow(search, schema)

    parts = [against([index_of(x) for x in range(at, min(at + MOST_BLOCKS, blocks))]) for at in range(0, blocks, MOST_BLOCKS)]
    return reduce(DataFrame.unionByName, parts)
