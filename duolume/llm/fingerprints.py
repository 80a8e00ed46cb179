"""Operator 8: document fingerprints from prefix polynomial hashes.

H[i] is the sum of c[j] * B^j over j < i, modulo 2^31 - 1, under two bases (62
bits together). A span's hash is (H[j] - H[i]) * B^-i, so any two spans can be
compared at once, and the longest common extension of two places is found by
binary search. The hash of two joined texts follows from theirs, which gives
edited texts' hashes without a new pass.

A fingerprint is `length-hash-sketch`: the sketch has the SKETCH smallest mixed
hashes of all spans of SPAN code points. The likeness of two fingerprints is the
share of the smallest values of both that both have (an estimate of the Jaccard
similarity of their span sets). Texts shorter than SPAN are one span.

Null texts count as empty: length 0, no spans, like other empty texts (1) and
unlike all else (0). Repeated ids are ordered by text. Empty tables give an
empty result. The result has the named columns only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

P = np.uint64((1 << 31) - 1)
_P = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
SPAN = 16
SKETCH = 32
BLOCK = 1 << 15


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x under 2^62."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


def _powers(base: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < BLOCK + SPAN:
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), _P)))])
    return out[: BLOCK + SPAN]


POWERS = [_powers(b) for b in BASES]
INVERSE = [_powers(pow(b, -1, _P)) for b in BASES]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.h = [np.zeros(self.n + 1, dtype=np.uint64) for _ in BASES]
        for out, base, powers in zip(self.h, BASES, POWERS, strict=True):
            for at in range(0, self.n, BLOCK):
                part = codes[at : at + BLOCK]
                local = _mod(np.cumsum(_mod(part * powers[: len(part)])))
                out[at + 1 : at + 1 + len(part)] = _mod(local * np.uint64(pow(base, at, _P)) + out[at])

    def span(self, at: int, n: int) -> tuple[int, ...]:
        """The hash of n code points from `at`."""
        return tuple((int(h[at + n]) - int(h[at])) * pow(b, -at, _P) % _P for h, b in zip(self.h, BASES, strict=True))

    def common_extension(self, at: int, other: PrefixHash, there: int) -> int:
        """How many code points from `at` equal those of the other text from `there`."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.span(at, mid) == other.span(there, mid) else (low, mid - 1)
        return low


def joined(first: PrefixHash, n: int, second: PrefixHash, m: int) -> tuple[int, ...]:
    """The hash of the first n code points of a text and then the first m of another."""
    return tuple((int(h[n]) + int(g[m]) * pow(b, n, _P)) % _P for h, g, b in zip(first.h, second.h, BASES, strict=True))


def span_hashes(codes: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of every span of SPAN code points (of the whole, if it is shorter)."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    k = min(SPAN, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for at in range(0, n - k + 1, BLOCK):
        part = codes[at : at + BLOCK + k - 1]
        m = len(part) - k + 1
        both = np.zeros(m, dtype=np.uint64)
        for powers, inverse in zip(POWERS, INVERSE, strict=True):
            h = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_mod(part * powers[: len(part)]), out=h[1:])
            both = (both << np.uint64(31)) | _mod(_mod(h[k : k + m] - h[:m]) * inverse[:m])
        out[at : at + m] = both
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def sketch(*parts: np.ndarray) -> np.ndarray:
    """The SKETCH smallest different values (of their upper 32 bits)."""
    small = []
    for x in parts:
        got = np.unique((np.partition(x, 2 * SKETCH)[: 2 * SKETCH] if len(x) > 2 * SKETCH else x) >> np.uint64(32))
        if len(got) < SKETCH and len(x) > 2 * SKETCH:  # values that repeat
            got = np.unique(x >> np.uint64(32))
        small.append(got)
    got = np.unique(np.concatenate(small))
    return got[:SKETCH].astype(np.uint32)


def fingerprint(n: int, whole: tuple[int, ...], small: np.ndarray) -> str:
    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-{small.astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: 0 to 1."""
    if a == b:
        return 1.0
    x, y = (set(s[i : i + 8] for i in range(0, len(s), 8)) for s in (f.rpartition("-")[2] for f in (a, b)))
    both = sorted(x | y)[:SKETCH]
    return sum(1 for v in both if v in x and v in y) / len(both) if both else 0.0


class _Document:
    def __init__(self, text: str):
        self.text, self.codes = text, codes_of(text)
        self.prefix, self.spans = PrefixHash(self.codes), span_hashes(self.codes)
        self.fingerprint = fingerprint(len(self.codes), self.prefix.span(0, len(self.codes)), sketch(self.spans))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _compared(doc: _Document, after: _Document) -> tuple:
    """The result's columns from n_chars on, for a document and the next one."""
    n = doc.prefix.n
    b = min(n // 2, after.prefix.n)
    a = n - n // 2
    edited = doc.text[:a] + after.text[:b]
    cross = np.concatenate([doc.codes[max(0, a - SPAN + 1) : a], after.codes[: min(b, SPAN - 1)]])
    inner = [doc.spans[: max(0, a - SPAN + 1)], after.spans[: max(0, b - SPAN + 1)]]
    if a + b <= SPAN or a and b:
        inner.append(span_hashes(cross) if len(cross) >= SPAN or a + b < SPAN else np.zeros(0, dtype=np.uint64))
    changed = fingerprint(a + b, joined(doc.prefix, a, after.prefix, b), sketch(*inner))
    lead = doc.prefix.common_extension(a, after.prefix, 0) if n else 0
    return n, hashlib.sha256(edited.encode()).hexdigest(), doc.fingerprint, changed, likeness(doc.fingerprint, changed), likeness(doc.fingerprint, after.fingerprint), a + min(lead, b), doc.prefix.common_extension(0, after.prefix, 0)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next one in falling id order (after the last: the first).

    Texts are sorted by id over ranges, so a document's next is the row before
    it. Only the first row of each range needs one from another range: those
    two rows of each range are compared in a second, small step.
    """
    small_batches(docs.sparkSession)
    extra = "kind int, part int, text string"
    fields = [*_NAMES, "kind", "part", "text"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, last_id = TaskContext.get().partitionId(), None, None
        blank = (None,) * (len(_NAMES) - 1)
        rows: list[tuple] = []
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc = _Document(text or "")
                rows.append((doc_id, *_compared(doc, before), 0, part, None) if before else (doc_id, *blank, 1, part, doc.text))
                before, last_id = doc, doc_id
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
        if before:
            rows.append((last_id, *blank, 2, part, before.text))
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        types = [kinds[x.split()[1]] for x in f"{OUT}, {extra}".split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = materialize(ordered.mapInArrow(compare, f"{OUT}, {extra}"), "fingerprints")
    # two rows of each range from here on
    parts = found.filter("kind = 1").select("part")
    every = Window.partitionBy()
    parts = parts.select("part", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(every)).alias("before"))
    firsts, lasts = found.filter("kind = 1").select("doc_id", "text", "part"), found.filter("kind = 2").select(F.col("text").alias("next_text"), F.col("part").alias("before"))
    pairs = firsts.join(parts, "part").join(lasts, "before")

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            rows = [(i, *_compared(_Document(a or ""), _Document(b or "")), None, None, None) for i, a, b in zip(x["doc_id"], x["text"], x["next_text"], strict=True)]
            if rows:
                yield _batch(rows).select(_NAMES)

    return found.filter("kind = 0").select(*_NAMES).unionByName(pairs.select("doc_id", "text", "next_text").mapInArrow(border, OUT))
