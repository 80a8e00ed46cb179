"""Operator 10: exact Jaccard join of word n-gram sets by universe partition.

Two sets with similarity p / q or more differ in at most
H = (|R| + |S|) (q - p) / (q + p) tokens. Sizes are cut into bands; in a band's
scheme the token universe is hashed into segments. A segment's threshold t is 0
(equal subsets), 1 (subsets that differ in one token, found by one-deletion
neighbourhoods) or -1 (not used). If the sum of (t + 1) is above H, a similar pair
must agree on one segment: the pigeonhole. A set that could pair with the next
band has keys there too.

Allocation follows cost. Tokens that a sample finds in several documents (shared
passages) form a segment of their own with t = -1; over H segments are made of the
others, so that sets which merely share a passage don't meet. A set with too few
rare tokens for the pigeonhole (and only such a set) is indexed under a second
scheme of all tokens as well, where `allocate` weighs segments of t = 0 and
t = 1 by index entries and expected chance agreements. If either set of a
pair has enough rare tokens, the first scheme finds the pair; if neither has,
the second does. The sample changes costs, never results. Empty subsets agree
everywhere, so they only get a key where the pigeonhole would fail without them.

Keys are packed into arrays, dealt out by key, and sorted in numpy. Sets with
the same tokens are one node, known by a 64-bit digest. A further digest of each set is compared by node: where
different sets share an id, nodes are made once more, with a second digest in place of that id. Nodes that share a key are joined to its smallest
node, and components of these candidate links are found. No similar pair lies
across two of them. A component of bounded size is joined exactly in one task by an
inverted index, with all pairs tested that don't already hang together. In
larger ones, each key's nodes are verified against its smallest (the pivot) for some
rounds, after which the pivot leaves. Keys whose nodes hang together by verified links
are done. The nodes of the others are cut into blocks, of one key or of the whole
component, whichever copies less; each pair of blocks is joined exactly in a task of its
own, which gives links that connect its nodes, not its pairs.

A key that many nodes of one task share is sent on for the smallest of them only, which
stands for the others; no key's nodes are ever in one place. The number of packs and
tasks follows the bytes of the input.

Null or empty texts, or texts without words: empty set, linked with nothing.
Texts shorter than n words: their whole sequence is one shingle. Rows with equal texts
are one node, rows with equal ids and different texts are nodes of their own. Null ids link like others, but
are no component's smallest id; a component of null ids alone has none. Empty tables give an empty result. The result has
only the named columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranges, slices, small_batches
from .components import connected_components
from .shingles import mix, shingle_sets, text_batches

#: Ids that are broadcast to find the texts to verify; beyond, the join is a shuffled one.
MOST_BROADCAST = 2_000_000
#: Partners of one pivot in one task.
PARTNERS = 500
#: Rounds of verified pivots that part a large component before its keys are joined by blocks.
PEELS = 3
#: Index entries and known nodes of a task that are held at once.
PACK = 250_000
#: Components up to this many nodes and tokens are joined in one task.
MOST_NODES = 20_000
MOST_TOKENS = 8_000_000
#: Blocks of a large bucket hold this part of these bounds, so that a pair of blocks stays within them.
BLOCKS = 4
#: Nodes of a bucket in one row.
CHUNK = 1_024
#: Ids of nodes that different sets may share; that many are expected from some 10^12 sets on.
MOST_SHARED = 100_000
#: Nodes of a key in one task, beyond which only the smallest is sent on.
MOST_LOCAL = 64
#: Bytes of text for each destination of packs, and for each task that reads them.
DEAL_BYTES = 4 << 20
TASK_BYTES = 16 << 20
#: Documents sampled for frequent tokens, how many must have one, and how many are kept.
SAMPLE = 5_000
OFTEN = 3
MOST_FREQUENT = 500_000
_GROWTH = 1.35
#: Share of tokens that unrelated sets have in common where they share a passage.
_COMMON = 0.4


@lru_cache(None)
def band_edges(p: int, q: int, most: int = 1 << 40) -> tuple[int, ...]:
    """First sizes of bands: a size can pair with its own or the next band only."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, q * max(out[-1] - 1, 0) // p + 1, int(out[-1] * _GROWTH)))
    return tuple(out)


@lru_cache(None)
def allocate(high: int, p: int, q: int, chance_cost: float) -> tuple[int, int, int]:
    """(segments with t = 0, segments with t = 1, H) for sets of at most `high` tokens."""
    h = 2 * high * (q - p) // (q + p)
    best = None
    for one in range(0, (h + 1) // 2 + 2, max(1, (h + 1) // 24)):
        zero = max(0, h + 1 - 2 * one)
        m = max(1, zero + one)
        t = 0.85 * high / m
        slack = int(np.ceil(m * np.exp(-t))) + 2 if h else 0
        zero, m = zero + slack, m + slack
        u = 1.4 * 0.85 * high / m
        agree = _COMMON**u
        cost = m + one * t + chance_cost * agree * (zero + one * (1 + u * (1 - _COMMON) / _COMMON))
        if best is None or cost < best[0]:
            best = (cost, zero, one, h)
    return best[1:]


def _segments(tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segment of each (sorted) token, their number in each segment, and commutative hashes of the subsets."""
    segment = (((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(segment, minlength=m)
    full = np.flatnonzero(count)
    sums = np.zeros(m, dtype=np.uint64)
    if len(full):
        sums[full] = np.add.reduceat(mix(tokens), (np.cumsum(count) - count)[full])
    return segment, count, sums


def segment_keys(tokens: np.ndarray, p: int, q: int, frequent: np.ndarray | None = None, level: int = 0, within: int = 0) -> np.ndarray:
    """Index keys of one set (sorted distinct token hashes)."""
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    rare = tokens
    if frequent is not None and len(frequent):
        rare = tokens[frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] != tokens]
    if level:
        tokens = np.sort(mix(tokens + np.uint64(0x1000193 * level)))
    edges = band_edges(p, q)
    band = int(np.searchsorted(edges, n, side="right")) - 1
    bands = [band] + [band + 1] * (q * n // p >= edges[band + 1])
    out = []
    for b in bands:
        zero, one, h = allocate(edges[b + 1] - 1, p, q, 2_000.0 * 10**level)
        if not level:
            m = (h + 1) + (h + 1) // 4 + 2
            _, count, sums = _segments(rare, m)
            full = np.flatnonzero(count)
            out.append(mix(sums[full] ^ mix(full.astype(np.uint64) + np.uint64((b + 1) << 32) + np.uint64(1 << 60))))
            if len(full) > h:
                continue
        m = zero + one
        segment, count, sums = _segments(tokens, m)
        full = np.flatnonzero(count)
        label = mix(np.arange(m, dtype=np.uint64) + np.uint64((b + 1) << 32) + np.uint64(level << 56)) ^ np.uint64(within & (2**64 - 1))
        # the first `one` segments have t = 1; a lone token's deletion would be an empty subset
        sure = int((count[one:] > 0).sum() + np.minimum(count[:one], 2).sum())
        short = sure <= h
        out.append(mix(sums ^ label) if short else mix(sums[full] ^ label[full]))
        if one:
            at = np.flatnonzero(segment < one)
            at = at if short else at[count[segment[at]] > 1]
            out.append(mix((sums[segment[at]] - mix(tokens[at])) ^ label[segment[at]]))
    return np.unique(np.concatenate(out))


def frequent_tokens(rows: DataFrame, n_words: int, n: int) -> np.ndarray:
    """Sorted hashes of shingles that several documents of a bounded sample (of n rows) have."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = shingle_sets([x or "" for x in batch["text"]], n_words)
            yield pd.DataFrame({"token": np.concatenate([x.view(np.int64) for x in got]) if got else np.zeros(0, dtype=np.int64)})

    share = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("often"), "doc_id", "key"), F.lit(1 << 30)) < share).dropDuplicates(["text"])
    often = sample.mapInPandas(tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    got = often.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toPandas()["token"].to_numpy(dtype=np.int64)
    return np.sort(got.view(np.uint64))


def digests_of(tokens: np.ndarray) -> tuple[int, ...]:
    """Three 64-bit digests of a set's content."""
    got = hashlib.blake2b(tokens.tobytes(), digest_size=24).digest()
    return tuple(int.from_bytes(got[at : at + 8], "little", signed=True) for at in (0, 8, 16))


def node_of(tokens: np.ndarray, shared: frozenset[int] = frozenset(), digests=digests_of) -> tuple[int, int]:
    """An id of a set's content, 0 for the empty set, and a digest to check it by. Ids that different sets were found to share aren't used."""
    if not len(tokens):
        return 0, 0
    first, second, check = digests(tokens)
    return (second if first in shared else first), check


_FOUND = "kind int, a long, b long, n long, key long, digest long, members array<long>"


def _found(kind: int, a, b, n=None, key=None, digest=None, members: list | None = None) -> pa.RecordBatch:
    size = len(a)
    as_long = lambda x: x if isinstance(x, pa.Array) else pa.array(x if x is not None else [None] * size, type=pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, dtype=np.int32)), *map(as_long, (a, b, n, key, digest)), pa.array(members if members is not None else [None] * size, type=pa.list_(pa.int64()))], ["kind", "a", "b", "n", "key", "digest", "members"]
    )


def find_candidates(rows: DataFrame, n_words: int, p: int, q: int, frequent=None, size: int = 0, shared: frozenset[int] = frozenset()) -> DataFrame:
    """(doc_id, key, text) -> kinds 0: rows (doc_id, node, size, key, digest of the set); 1: (pivot, node) pairs; 2: buckets of three and more nodes, CHUNK of them in a row.

    `size`: bytes of all texts. `shared`: ids of nodes that aren't used.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal, tasks = min(2**31 - 1, max(4 * least, size // DEAL_BYTES)), max(least, size // TASK_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, nodes, sizes, docs = [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            if keys:
                k, v = np.concatenate(keys), np.repeat(np.array(nodes, dtype=np.int64), sizes)
                order = np.lexsort((v, k))
                k, v = k[order], v[order]
                starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                counts = np.diff(starts, append=len(k))
                many = np.zeros(len(k), dtype=bool)
                keep = np.ones(len(k), dtype=bool)
                for s, c in zip(starts[counts > MOST_LOCAL], counts[counts > MOST_LOCAL], strict=True):
                    many[s], keep[s + 1 : s + c] = True, False
                    for at in range(s, s + c, CHUNK):
                        out.append((int(mix(v[at : at + 1].view(np.uint64))[0] % np.uint64(deal)), 2, k[s : s + 1].tobytes() + v[s : s + 1].tobytes() + v[at : min(at + CHUNK, s + c)].tobytes()))
                k, v, many = k[keep], v[keep], many[keep]
                to = (k % np.uint64(deal)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                k, v, many, to = k[order], v[order], many[order], to[order]
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
                    out.append((int(to[a]), 1, k[a:b].tobytes() + v[a:b].tobytes() + many[a:b].tobytes()))
            for at in range(0, len(docs), 2048):
                part = np.array(docs[at : at + 2048], dtype=np.int64)
                out.append((int(mix(part[:1, 2].view(np.uint64))[0] % np.uint64(deal)), 0, part.T.tobytes()))
            keys.clear(), nodes.clear(), sizes.clear(), docs.clear()
            if len(seen) > PACK:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=pa.int32()), pa.array([x[1] for x in out], type=pa.int32()), pa.array([x[2] for x in out], type=pa.binary())], ["deal", "kind", "packed"])

        for batch in slices(batches, "text"):
            ids, own_keys, texts = (batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))
            for a, b in text_batches(texts):
                for i, tokens in enumerate(shingle_sets([x or "" for x in texts[a:b]], n_words), a):
                    node, digest = node_of(tokens, shared, digests_of)
                    docs.append((ids[i] or 0, ids[i] is None, node, len(tokens), own_keys[i], digest))
                    if len(tokens) and node not in seen:
                        seen.add(node)
                        keys.append(segment_keys(tokens, p, q, frequent.value if frequent else None))
                        nodes.append(node)
                        sizes.append(len(keys[-1]))
                if sum(sizes) > PACK or len(docs) > PACK:
                    yield from flush()
        yield from flush()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None
        known: set[tuple[int, ...]] = set()

        def close() -> Iterator[pa.RecordBatch]:
            counts = [len(x) // 17 for x in held]
            k = np.concatenate([np.frombuffer(x, dtype=np.uint64, count=n) for x, n in zip(held, counts, strict=True)])
            v = np.concatenate([np.frombuffer(x, dtype=np.int64, count=n, offset=8 * n) for x, n in zip(held, counts, strict=True)])
            more = np.concatenate([np.frombuffer(x, dtype=bool, count=n, offset=16 * n) for x, n in zip(held, counts, strict=True)])
            held.clear()
            order = np.lexsort((~more, v, k))
            k, v, more = k[order], v[order], more[order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
            k, v, more = k[new], v[new], more[new]
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            counts = np.diff(starts, append=len(k))
            many = counts > 1
            if not many.any():
                return
            inner = np.repeat(many, counts)
            first = np.zeros(len(k), dtype=bool)
            first[starts] = True
            pivot = np.repeat(v[starts], counts)
            pick = inner & ~first
            pairs = np.unique(np.stack([pivot[pick], v[pick]], axis=1), axis=0)
            yield _found(1, pairs[:, 0], pairs[:, 1])
            members, names = [], []
            # a key with more nodes elsewhere is known by itself, other buckets by their nodes
            more = np.logical_or.reduceat(more, starts)
            wanted = (counts > 2) | (many & more)
            for s, c, own in zip(starts[wanted], counts[wanted], more[wanted], strict=True):
                got = v[s : s + c]
                name, *more_of = (int(k[s].view(np.int64)),) if own else digests_of(got)
                if (name, *more_of) not in known:
                    known.add((name, *more_of))
                    members.append(got)
                    names.append(name)
            # the bucket's name, pivot and size stand beside each chunk
            for at_once in range(0, len(members), 1024):
                cuts = [(name, got, at) for name, got in zip(names[at_once : at_once + 1024], members[at_once : at_once + 1024], strict=True) for at in range(0, len(got), CHUNK)]
                yield _found(2, [x[0] for x in cuts], [int(x[1][0]) for x in cuts], [len(x[1]) for x in cuts], members=[x[1][x[2] : x[2] + CHUNK] for x in cuts])

        for batch in batches:
            for to, kind, packed in zip(*(batch.column(c).to_pylist() for c in ("deal", "kind")), map(memoryview, (x.as_buffer() for x in batch.column("packed"))), strict=True):
                if kind == 0:
                    doc_id, no_id, node, n, key, digest = np.frombuffer(packed, dtype=np.int64).reshape(6, -1)
                    yield _found(0, pa.array(doc_id, mask=no_id > 0), node, n, key, digest)
                    continue
                if kind == 2:
                    name, pivot, *_ = got = np.frombuffer(packed, dtype=np.int64)
                    yield _found(2, [name], [pivot], [len(got) - 2], members=[got[2:]])
                    if len(others := got[2:][got[2:] != pivot]):
                        yield _found(1, np.full(len(others), pivot), others)
                    continue
                if to != at and held:
                    yield from close()
                at = to
                held.append(packed)
        if held:
            yield from close()

    packed = rows.mapInArrow(pack, "deal int, kind int, packed binary")
    return materialize(packed.repartition(tasks, "deal").sortWithinPartitions("deal", "kind").mapInArrow(group, _FOUND), "join-found")


def verify(pairs: DataFrame, texts: DataFrame, n_words: int) -> DataFrame:
    """(a, b) node pairs, (node, text) -> (a, b, same, n_a, n_b): exact sizes of sets and intersections.

    Partners' texts come to the pivot's; a pivot with many partners is dealt out over several tasks.
    """
    pairs = pairs.distinct()
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("slots"))
    pairs = pairs.join(many, "a").withColumn("slot", F.pmod(F.xxhash64("b"), F.col("slots"))).drop("slots")
    pivots = pairs.select("a", "slot").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "slot", F.lit(None).cast("long").alias("b"), "text")
    others = pairs.join(texts.withColumnRenamed("node", "b"), "b").select("a", "slot", "b", "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for batch in batches:
            out = []
            texts = list(batch["text"])
            a_col, no_b, b_col = (x.to_numpy() for x in (batch["a"].astype("int64"), batch["b"].isna(), batch["b"].fillna(0).astype("int64")))
            for lo, hi in text_batches(texts):
                for i, tokens in enumerate(shingle_sets(texts[lo:hi], n_words), lo):
                    if no_b[i]:
                        at, own = a_col[i], tokens
                    elif at == a_col[i]:
                        out.append((at, b_col[i], len(np.intersect1d(own, tokens, assume_unique=True)), len(own), len(tokens)))
            yield pd.DataFrame(out, columns=["a", "b", "same", "n_a", "n_b"]).astype("int64")

    both = pivots.unionByName(others.select(*pivots.columns))
    both = both.repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())
    return both.select("a", "b", "text").mapInArrow(_as_frames(compare), "a long, b long, same long, n_a long, n_b long")


def _as_frames(f):
    """Runs a function of pandas frames on Arrow batches, with nullable integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (pa.Table.from_batches([x]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for x in slices(batches, "text"))
        for out in f(frames):
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return run


def join_component(sets: list[np.ndarray], p: int, q: int) -> np.ndarray:
    """The component of each set (the place of its first member), with links between similar sets.

    A query counts its common tokens with all sets by an inverted index. Sets
    outside of the largest component are asked until all of them were: then every
    pair across components is tested.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    tokens = tokens[order]
    root, asked = np.arange(n), np.zeros(n, dtype=bool)
    while True:
        main = np.argmax(np.bincount(root, minlength=n))
        open_ones = np.flatnonzero(~asked & (root != main))
        if not len(open_ones) or (root == root[0]).all():
            return root
        # at first any set; then those outside
        i = open_ones[0]
        asked[i] = True
        low, high = np.searchsorted(tokens, sets[i], side="left"), np.searchsorted(tokens, sets[i], side="right")
        same = np.bincount(owner[ranges(low, high - low)], minlength=n)
        linked = np.flatnonzero((same * q >= p * (sizes + sizes[i] - same)) & (same > 0))
        roots = np.unique(root[linked])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]


def _join_components(n_words: int, p: int, q: int):
    def close(comp: int, nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(nodes)
        names = np.array(nodes, dtype=np.int64)[order]
        root = join_component([sets[i] for i in order], p, q)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], ["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []
        for batch in slices(batches, "text"):
            comps, names, texts = (batch.column(c).to_pylist() for c in ("comp", "node", "text"))
            for a, b in text_batches(texts):
                for i, tokens in enumerate(shingle_sets(texts[a:b], n_words), a):
                    if comps[i] != at:
                        if nodes:
                            yield close(at, nodes, sets)
                        at, nodes, sets = comps[i], [], []
                    if not nodes or names[i] != nodes[-1]:
                        nodes.append(names[i])
                        sets.append(tokens)
        if nodes:
            yield close(at, nodes, sets)

    return run


def _texts_of(rows: DataFrame, need: DataFrame) -> DataFrame:
    """The nodes of `need` (node, doc_id, key and further columns) with their texts; equal rows are brought once by each task that reads some."""
    named = need.withColumnsRenamed({"doc_id": "own_id", "key": "own_key"})
    found = rows.join(F.broadcast(named) if need.count() <= MOST_BROADCAST else named, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key"))).drop("own_id", "own_key")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for node in batch.column("node").to_pylist():
                new.append(node not in seen)
                seen.add(node)
            yield batch if all(new) else batch.filter(pa.array(new))

    repeated = not need.filter("copies > 1").isEmpty()
    return found.mapInArrow(once, found.schema) if repeated else found


def shared_nodes(found: DataFrame) -> frozenset[int]:
    """Ids of nodes that stand for different sets: chance only, so a handful."""
    seen = found.filter("kind = 0").groupBy(F.col("b").alias("node")).agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high")
    nodes = [r["node"] for r in seen.select("node").limit(MOST_SHARED + 1).collect()]
    if len(nodes) > MOST_SHARED:
        raise ValueError(f"over {MOST_SHARED} digests of 64 bits stand for different sets")
    return frozenset(nodes)


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, text: equal ids and keys are equal rows."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def jaccard_roots(docs: DataFrame, n_words: int, p: int, q: int, id_col: str = "doc_id", text_col: str = "text", most_nodes: int = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node, n_shingles) of every row, and (node, root) of nodes in components of links."""
    small_batches(docs.sparkSession)
    rows = keyed_rows(docs, id_col, text_col)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(rows, n_words, n))
    found = find_candidates(rows, n_words, p, q, frequent, size)
    if shared := shared_nodes(found):
        # different sets with one id (expected from some 10^9 sets on): once more, with the second digest in their place
        found = find_candidates(rows, n_words, p, q, frequent, size, shared)
        if shared_nodes(found):
            raise ValueError("ids of nodes still stand for different sets with their second digests")
    members = found.filter("kind = 0").select(F.col("a").alias("doc_id"), "key", F.col("b").alias("node"), F.col("n").alias("n_shingles"))
    comps = connected_components(found.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    comps = comps.select(F.col("u").alias("node"), F.col("root").alias("comp"))
    comps = comps.unionByName(comps.select(F.col("comp").alias("node"), "comp").distinct())
    reps = members.filter("n_shingles > 0").groupBy("node", "doc_id", "key").agg(F.count("*").alias("copies"), F.first("n_shingles").alias("size"))
    reps = reps.groupBy("node").agg(F.min(F.struct("doc_id", "key", "copies", "size")).alias("r")).select("node", "r.*")
    nodes = materialize(comps.join(reps, "node"), "join-nodes")
    narrow, wide = _by_size(nodes, most_nodes)
    links = None
    if not wide.isEmpty():
        wide = materialize(wide, "join-wide")
        parted, wide, peeled, buckets = _peel(rows, found, wide, n_words, p, q, most_nodes)
        narrow = narrow.unionByName(parted)
        if not wide.isEmpty():
            links = _wide_links(rows, peeled, buckets, wide, n_words, p, q, most_nodes)
    texts = _texts_of(rows, narrow.select("doc_id", "key", "node", "comp", "copies")).select("comp", "node", "text")
    roots = texts.repartition("comp").sortWithinPartitions("comp", "node").mapInArrow(_join_components(n_words, p, q), "node long, root long")
    if links is not None:
        more = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        roots = roots.unionByName(more.select(F.col("u").alias("node"), "root"))
    return members, materialize(roots, "join-roots")


def _by_size(nodes: DataFrame, most_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of components that one task can join, and of those that it can't."""
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    wide = sizes.filter((F.col("n") > most_nodes) | (F.col("tokens") > MOST_TOKENS)).select("comp")
    return nodes.join(wide, "comp", "left_anti"), nodes.join(wide, "comp", "left_semi")


def _peel(rows: DataFrame, found: DataFrame, wide: DataFrame, n_words: int, p: int, q: int, most_nodes: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parts large components by verifying pivots: (nodes of components that are small now, nodes of those that aren't, and the latter's links and buckets without their pivots).

    When all pairs of a key's pivot are verified, the pivot only hangs on by links, and
    the key's other nodes get the next pivot. Chance agreements of two sets end there.
    """
    texts = materialize(_texts_of(rows, wide.select("node", "doc_id", "key", "copies")).select("node", "text"), "join-texts")
    inside = wide.select(F.col("node").alias("a"))
    pairs = found.filter("kind = 1").select("a", "b").join(inside, "a", "left_semi")
    buckets = found.filter("kind = 2").select("a", "b", "members").join(inside.withColumnRenamed("a", "b"), "b", "left_semi").select(F.col("a").alias("bucket"), F.explode("members").alias("node")).distinct()
    links, small = None, None
    for _ in range(PEELS):
        fresh = materialize(verify(pairs, texts, n_words).filter(_is_link(p, q)).select("a", "b"), "join-peeled")
        links = fresh if links is None else links.unionByName(fresh)
        buckets = materialize(_unpivoted(buckets), "join-buckets")
        pairs = buckets.join(buckets.groupBy("bucket").agg(F.min("node").alias("a")), "bucket").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
        comps = connected_components(links.unionByName(pairs).select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("node"), F.col("root").alias("comp"))
        comps = comps.unionByName(comps.select(F.col("comp").alias("node"), "comp").distinct())
        parted = materialize(wide.drop("comp").join(comps, "node").select(wide.columns), "join-parted")
        small, left = _by_size(parted, most_nodes)
        if left.isEmpty():
            break
    # links and buckets lie within one component each
    links = links.join(left.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b")
    buckets = buckets.join(left.select("node"), "node", "left_semi").select("bucket", "node")
    return small, left, links, buckets


def _unpivoted(buckets: DataFrame) -> DataFrame:
    """(bucket, node) rows without the smallest node of each, of buckets that keep two or more nodes; equal buckets once."""
    least = buckets.groupBy("bucket").agg(F.min("node").alias("least"))
    rest = buckets.join(least, "bucket").filter("node <> least").select("bucket", "node")
    of = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "node"), 24)).alias("s"))
    once = of.filter("n > 1").groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket")
    return rest.join(once, "bucket", "left_semi").select("bucket", "node")


def _is_link(p: int, q: int):
    return F.col("same") * q >= p * (F.col("n_a") + F.col("n_b") - F.col("same"))


def _wide_links(rows: DataFrame, links: DataFrame, buckets: DataFrame, inside: DataFrame, n_words: int, p: int, q: int, most_nodes: int) -> DataFrame:
    """Links (a, b) that connect the nodes of components too large for one task: those known, and those in their buckets."""
    known = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("node"), "root")
    rooted = buckets.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    unsettled = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    open_ones = materialize(buckets.join(unsettled, "bucket", "left_semi").join(inside.select("node", "comp", "size"), "node").select("comp", "bucket", "node", "size"), "join-open")
    if open_ones.isEmpty():
        return links
    most = F.lit(max(1, most_nodes // BLOCKS)), F.lit(max(1, MOST_TOKENS // BLOCKS))

    def pieces(of: DataFrame, *names: str) -> DataFrame:
        sizes = of.groupBy(*names).agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
        return sizes.withColumn("k", F.least("n", F.greatest(F.ceil(F.col("n") / most[0]), F.ceil(F.col("tokens") / most[1])))).withColumn("copies", F.col("n") * F.greatest(F.col("k") - 1, F.lit(1)))

    by_bucket = pieces(open_ones, "comp", "bucket")
    whole = open_ones.select("comp", "node", "size").distinct()
    by_comp = pieces(whole, "comp")
    # a component is joined as one piece where its buckets would copy more
    taken = by_comp.join(by_bucket.groupBy("comp").agg(F.sum("copies").alias("other")), "comp").select("comp", "k", (F.col("copies") <= F.col("other")).alias("as_one"))
    one = whole.join(taken.filter("as_one"), "comp").select(F.lit(0).alias("kind"), F.col("comp").alias("piece"), "k", "node")
    many = open_ones.join(taken.filter("not as_one").select("comp"), "comp", "left_semi").join(by_bucket.select("comp", "bucket", "k"), ["comp", "bucket"])
    dealt = one.unionByName(many.select(F.lit(1).alias("kind"), F.col("bucket").alias("piece"), "k", "node"))
    # each block meets each other one; within a block, nodes meet in all of its pairs
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).filter("own <> other or k = 1")
    dealt = dealt.select(F.xxhash64("kind", "piece", F.least("own", "other"), F.greatest("own", "other")).alias("comp"), "node")
    texts = _texts_of(rows, inside.select("node", "doc_id", "key", "copies")).select("node", "text")
    joined = dealt.join(texts, "node").select("comp", "node", "text").repartition("comp").sortWithinPartitions("comp", "node")
    more = joined.mapInArrow(_join_components(n_words, p, q), "node long, root long").filter("node <> root")
    return links.unionByName(materialize(more.select(F.col("node").alias("a"), F.col("root").alias("b")), "join-blocks"))


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds component_id to rows: the smallest id of the nodes that hang together."""
    least = members.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    by_root = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.min("node").alias("first_node"))
    labels = labelled.join(by_root, "root").select("node", "component_id", "first_node")
    return members.join(labels, "node", "left")


def jaccard_components(docs: DataFrame, n_words: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text", most_nodes: int = MOST_NODES) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; component_id is the smallest doc_id reachable by links."""
    members, roots = jaccard_roots(docs, n_words, p, q, id_col, text_col, most_nodes)
    return _labelled(members, roots).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def repeated_documents(docs: DataFrame, n_words: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, kept: the rows (by keyed_rows) that aren't their component's first (smallest id, then key; null ids come last), and firsts of which there are equal rows (kept)."""
    rows = _labelled(*jaccard_roots(docs, n_words, p, q, id_col, text_col)).filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    rows = rows.groupBy("first_node", "doc_id", "key").agg(F.count("*").alias("copies"))
    first = rows.groupBy("first_node").agg(F.min(order).alias("first"), F.sum("copies").alias("n")).filter("n > 1")
    return rows.join(first, "first_node").withColumn("kept", order.eqNullSafe(F.col("first"))).filter("copies > 1 or not kept").select("doc_id", "key", "kept")
