"""Operator 9: repeated byte strings by a sparse enhanced suffix array, and their removal.

A byte goes if it is covered by a LENGTH-byte string that also starts in a
document with a smaller id. Every such string holds an anchor: the ANCHOR-byte
string with the smallest hash in it (a minimizer), so equal strings have equal
anchors, and only anchors need to meet. An anchor's context is all that the
strings around it can cover: 30 bytes before it and 50 from its start.

1. Hashes of anchors and contexts are dealt out by anchor. A context that a
   document with a smaller id has as well is covered as a whole (equal 48-bit anchor and
   64-bit context hashes). Within a task, this is settled before anything is sent.
2. Where an anchor has several contexts in several documents, one copy of each
   context is sent. The suffixes from the anchors are sorted, with the common prefixes
   of neighbours: an enhanced suffix array. A stack scan gives the intervals of its
   common-prefix tree. The members of an interval of depth d are ordered by their bytes to
   the left, and a second stack scan cuts them where left extensions become diverse: each
   of its intervals of depth a is a maximal repeat of a + d bytes with all
   its occurrences. Where these are 50 or more, all but the occurrences in the smallest document are covered.
   Bytes are compared here, so equal hashes of different anchors do no harm.
3. Covered spans come back to the documents, which are cut and hashed.

Anchors that a sample finds in many different contexts (a ruler, a common phrase) would bring
them all into one task. Their strings are dealt out one by one instead, by their own hashes, of which only the
smallest document id is needed. The sample changes the way, never the result.

Texts travel as compressed packs; their number and that of the tasks follow the bytes of the input.

`repeat_groups` gives the maximal repeat groups themselves. A repeat reaches from 30 bytes before its anchor
to 50 from its start; longer ones are chains of groups.

Null texts count as empty. Texts under 50 bytes stay as they are. Rows with equal ids never
remove from each other; null ids come after all others. Empty tables give an
empty result. The result has only the named columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranges, small_batches, trim_memory
from .shingles import mix

LENGTH = 50
ANCHOR = 20
LEFT = LENGTH - ANCHOR
WIDTH = LEFT + LENGTH
_BLOCK = 1 << 20
#: Bytes of text that a task looks at before it sends what it found.
FLUSH = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LAST = np.uint64(2**64 - 1)
_KEEP = np.uint64(2**48 - 1)
_NO_ID = 2**63 - 1
_ROWS = "deal int, kind int, packed binary"
#: Bytes of text for each destination of packs, and for each task that reads them.
DEAL_BYTES = 2 << 20
TASK_BYTES = 16 << 20
#: An anchor with so many contexts in a sample (of SAMPLE documents, or a thousandth of all) is hot; so many hot ones are kept.
HOT = 32
SAMPLE = 4_000
MOST_HOT = 1_000_000


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK + WIDTH), _powers(_INVERSE, _BLOCK + WIDTH)


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of `width` values."""
    n, out, step = len(a) - width + 1, a, 1
    while step * 2 <= width:
        out = op(out[:-step], out[step:])
        step *= 2
    return op(out[:n], out[width - step : width - step + n]) if width > step else out[:n]


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, anchor hashes (48 bits) and context hashes of one text's bytes, in order."""
    found = ([], [], [])
    n = len(raw)
    # blocks overlap so that each position has its whole surroundings in one of them
    step = _BLOCK - 2 * WIDTH
    for at in range(0, max(1, n), step):
        low, high = max(0, at - WIDTH), min(n, at + step + WIDTH)
        part = raw[low:high]
        if len(part) < LENGTH:
            continue
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=sums[1:])
        h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * _DOWN[: len(part) - ANCHOR + 1]) | np.uint64(1)
        least = _slide(h, LEFT + 1, np.minimum)
        edge = np.zeros(LEFT, dtype=np.uint64)
        p = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), LEFT + 1, np.maximum) == h)
        p = p[(p + low >= at) & (p + low < at + step)]
        a, b = np.maximum(p - LEFT, 0), np.minimum(p + LENGTH, len(part))
        c = mix((sums[b] - sums[a]) * _DOWN[a] + ((b - a) * 128 + (p - a)).astype(np.uint64))
        for out, x in zip(found, (p + low, h[p] & _KEEP, c), strict=True):
            out.append(x)
        if high == n:
            break
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64 if i == 0 else np.uint64) for i, x in enumerate(found))


def _many_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: owner, position in it, anchor hash, context hash."""
    found = ([], [], [], [])
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size + len(texts[end]) <= _BLOCK // 2 or end == at):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        if len(part) == 1:
            p, h, c = anchors(np.frombuffer(part[0], dtype=np.uint8))
            out = (np.full(len(p), at), p, h, c)
        else:
            lengths = np.array([len(x) for x in part], dtype=np.int64)
            ends = np.cumsum(lengths)
            raw = np.frombuffer(b"".join(part), dtype=np.uint8)
            owner = np.repeat(np.arange(len(part)), lengths)
            end_of, start_of = ends[owner], (ends - lengths)[owner]
            out = (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),) * 2
            if len(raw) >= LENGTH:
                sums = np.zeros(len(raw) + 1, dtype=np.uint64)
                np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], out=sums[1:])
                h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * _DOWN[: len(raw) - ANCHOR + 1]) | np.uint64(1)
                own = np.arange(len(h)) + ANCHOR <= end_of[: len(h)]
                h[~own] = _LAST
                least = _slide(h, LEFT + 1, np.minimum)
                least[np.arange(len(least)) + LENGTH > end_of[: len(least)]] = 0
                edge = np.zeros(LEFT, dtype=np.uint64)
                p = np.flatnonzero((_slide(np.concatenate([edge, least, edge]), LEFT + 1, np.maximum) == h) & own)
                a, b = np.maximum(p - LEFT, start_of[p]), np.minimum(p + LENGTH, end_of[p])
                c = mix((sums[b] - sums[a]) * _DOWN[a] + ((b - a) * 128 + (p - a)).astype(np.uint64))
                out = (owner[p] + at, p - start_of[p], h[p] & _KEEP, c)
        for x, y in zip(found, out, strict=True):
            x.append(y)
        at = end
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in found)


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """The low bytes of 64-bit integers, byte by byte, so that equal high bytes compress away."""
    return np.ascontiguousarray(x.astype("<i8" if x.dtype.kind == "i" else "<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _whole(packed: bytes, n: int, width: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(packed, dtype=np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def _pack(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """Integer columns of one length."""
    return len(columns[0]).to_bytes(4, "little") + b"".join(_planes(x, w) for x, w in zip(columns, widths, strict=True))


def _unpack(packed: bytes, widths: list[int]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(packed[:4], "little"), 4, []
    for w in widths:
        out.append(_whole(packed[at : at + n * w], n, w))
        at += n * w
    return out


def _split(to: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each destination, in their order."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
        yield int(to[a]), [x[order[a:b]] for x in columns]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    deal, kind, packed = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(deal, type=pa.int32()), pa.array(kind, type=pa.int32()), pa.array(packed, type=pa.binary())], ["deal", "kind", "packed"])


def _packs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, memoryview]]:
    """Destination, kind and bytes of each pack; the bytes aren't copied."""
    return zip(*(batch.column(x).to_pylist() for x in ("deal", "kind")), (memoryview(x.as_buffer()) for x in batch.column("packed")), strict=True)


class _Outbox:
    """Gathers findings of a task and sends them in packs, one for each destination, when they are many or at the end."""

    MOST = 100_000

    def __init__(self, kind: int, widths: list[int], deal: int):
        self.kind, self.widths, self.deal = kind, widths, deal
        self.held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.size = 0

    def put(self, to: np.ndarray, columns: list[np.ndarray]) -> None:
        if len(to):
            self.held.append((to, columns))
            self.size += len(to)

    def full(self) -> bool:
        return self.size >= self.MOST

    def rows(self) -> list[tuple[int, int, bytes]]:
        if not self.held:
            return []
        to = np.concatenate([x for x, _ in self.held])
        columns = [np.concatenate(x) for x in zip(*(c for _, c in self.held), strict=True)]
        self.held, self.size = [], 0
        n = len(self.widths)
        return [(at, self.kind, _pack(x[:n], self.widths) + b"".join(y.tobytes() for y in x[n:])) for at, x in _split(to, columns)]


def _home(ids: np.ndarray, deal: int) -> np.ndarray:
    """Where a document's findings and text meet."""
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(deal)).astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], most: int = FLUSH) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts, some megabytes together, in id order."""
    ids, texts, size = [], [], 0
    trim_memory()

    def out():
        order = sorted(range(len(ids)), key=ids.__getitem__)
        return np.array([ids[i] for i in order], dtype=np.int64), [texts[i] for i in order]

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
            ids.append(_NO_ID if doc_id is None else doc_id)
            texts.append(raw)
            size += len(raw)
            if size >= most:
                yield out()
                ids, texts, size = [], [], 0
    if ids:
        yield out()
    ids, texts = [], []
    trim_memory()


_STRING = [6, 8, 8, 6]  # anchor, string, doc_id, start
_ENTRY = [6, 8, 8, 4]  # anchor, context, doc_id, number of the anchor in its document
_REPLY = [8, 4, 1]  # doc_id, number, 1: covered, 2: context wanted
_SPAN = [8, 6, 6]  # doc_id, start, end
_CONTEXT = [8, 6, 1, 1]  # doc_id, position, bytes before, bytes from it


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before."""
    out = np.ones(len(keys[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _windows(texts: list[bytes], who: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of some places in some texts: bytes before, bytes from the place on, and all of them (0 where there is no text)."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    before, after = np.minimum(p, LEFT), np.minimum(LENGTH, lengths[who] - p)
    raw = np.frombuffer(bytes(LEFT) + b"".join(texts) + bytes(LENGTH), dtype=np.uint8)
    chars = raw[((np.cumsum(lengths) - lengths)[who] + p)[:, None] + np.arange(WIDTH)]
    column = np.arange(WIDTH) - LEFT
    chars[(column < -before[:, None]) | (column >= after[:, None])] = 0
    return before, after, chars


def _strings(texts: list[bytes], who: np.ndarray, p: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each 50-byte string around some anchors: its anchor, hash, text and start."""
    for at in range(0, len(p), 20_000):
        own = slice(at, at + 20_000)
        before, after, chars = _windows(texts, who[own], p[own])
        sums = np.zeros((len(before), WIDTH + 1), dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * _UP[:WIDTH], axis=1, out=sums[:, 1:])
        whole = mix((sums[:, LENGTH:] - sums[:, : WIDTH - LENGTH + 1]) * _DOWN[: WIDTH - LENGTH + 1])
        left = LEFT - np.arange(WIDTH - LENGTH + 1)
        row, column = np.nonzero((left <= before[:, None]) & (LENGTH - left <= after[:, None]))
        yield h[own][row], whole[row, column], who[own][row], p[own][row] - left[column]


def _covered(*keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same keys."""
    order = np.lexsort((doc, *keys[::-1]))
    new = _firsts(*(k[order] for k in keys))
    out = np.zeros(len(doc), dtype=bool)
    out[order] = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _send_hashes(deal: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_ones = hot.value
        for ids, texts in _runs(batches):
            owner, position, h, c = _many_anchors(texts)
            if not len(owner):
                continue
            starts = np.flatnonzero(_firsts(owner))
            number = np.arange(len(owner)) - np.repeat(starts, np.diff(starts, append=len(owner)))
            rows = []
            if len(hot_ones):
                is_hot = hot_ones[np.minimum(np.searchsorted(hot_ones, h), len(hot_ones) - 1)] == h
                for own, string, who, start in _strings(texts, owner[is_hot], position[is_hot], h[is_hot]):
                    gone = _covered(own, string, doc=ids[who])
                    rows += [(to, 3, _pack([*x, x[1] + LENGTH], _SPAN)) for to, x in _split(_home(ids[who[gone]], deal), [ids[who[gone]], start[gone]])]
                    keep = ~gone
                    rows += [(to, 2, _pack(x, _STRING)) for to, x in _split((mix(string[keep]) % np.uint64(deal)).astype(np.int64), [own[keep], string[keep], ids[who[keep]], start[keep]])]
                    yield _batch(rows)
                    rows = []
                owner, number, h, c = (x[~is_hot] for x in (owner, number, h, c))
            doc = ids[owner]
            covered = _covered(h, c, doc=doc)
            rows += [(to, 1, _pack([*x, np.ones(len(x[0]), dtype=np.int64)], _REPLY)) for to, x in _split(_home(doc[covered], deal), [doc[covered], number[covered]])]
            keep = ~covered
            rows += [(to, 0, _pack(x, _ENTRY)) for to, x in _split((h[keep] % np.uint64(deal)).astype(np.int64), [h[keep], c[keep], doc[keep], number[keep]])]
            yield _batch(rows)

    return run


def hot_anchors(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of anchors that have HOT contexts or more in a sample of the documents."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _runs(batches):
            _, _, h, c = _many_anchors(texts)
            order = np.lexsort((c, h))
            new = _firsts(h[order], c[order])
            pairs = h[order][new].view(np.int64), c[order][new].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["h", "c"])

    share = int(min(1.0, max(SAMPLE / max(rows.count(), 1), 0.001)) * (1 << 30))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(1 << 30)) < share)
    found = sample.mapInArrow(contexts, "h long, c long").distinct().groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT)
    got = found.orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").toPandas()["h"].to_numpy(dtype=np.int64)
    return np.sort(got.view(np.uint64))


def _compare_hashes(deal: int, one_document: bool = False):
    def contexts(held: list[bytes], box: _Outbox) -> None:
        h, c, doc, number = (np.concatenate(x) for x in zip(*(_unpack(x, _ENTRY) for x in held), strict=True))
        order = np.lexsort((doc, c, h))
        h, c, doc, number = h[order], c[order], doc[order], number[order]
        new_anchor = _firsts(h)
        new = new_anchor | _firsts(c)
        starts = np.flatnonzero(new_anchor)
        group = np.cumsum(new_anchor) - 1
        several = (np.add.reduceat(new.astype(np.int64), starts) > 1) & (one_document | (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)))
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        status = np.where(doc > least, 1, np.where(several[group], 2, 0))
        some = status > 0
        box.put(_home(doc[some], deal), [doc[some], number[some], status[some]])

    def strings(held: list[bytes], box: _Outbox) -> None:
        h, string, doc, start = (np.concatenate(x) for x in zip(*(_unpack(x, _STRING) for x in held), strict=True))
        gone = _covered(h, string, doc=doc)
        box.put(_home(doc[gone], deal), [doc[gone], start[gone], start[gone] + LENGTH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_deal(batches, {0: (contexts, _Outbox(1, _REPLY, deal)), 2: (strings, _Outbox(3, _SPAN, deal))})

    return run


def _by_deal(batches: Iterator[pa.RecordBatch], settlers: dict) -> Iterator[pa.RecordBatch]:
    """Gathers the packs of a kind and destination and settles them together; kinds without a settler pass."""
    held, at = [], None
    trim_memory()

    def settle() -> list[tuple[int, int, bytes]]:
        if not held:
            return []
        how, box = settlers[at[1]]
        how(held, box)
        held.clear()
        return box.rows() if box.full() else []

    for batch in batches:
        rows = []
        for to, k, packed in _packs(batch):
            if k not in settlers:
                rows.append((to, k, packed))
                continue
            if (to, k) != at:
                rows += settle()
            at = to, k
            held.append(packed)
        yield _batch(rows)
    yield _batch(settle() + [x for _, box in settlers.values() for x in box.rows()])
    batch = None
    trim_memory()


def _pack_texts(deal: int):
    """Texts by the home of their document: kind 9, after all findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _runs(batches):
            rows = []
            for to, (at,) in _split(_home(ids, deal), [np.arange(len(ids))]):
                raw = b"".join(texts[i] for i in at)
                head = _pack([ids[at], np.array([len(texts[i]) for i in at], dtype=np.int64)], [8, 6])
                body = pa.compress(head + raw, codec="zstd", asbytes=True)
                rows.append((to, 9, (len(head) + len(raw)).to_bytes(8, "little") + body))
            yield _batch(rows)

    return run


def _texts(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    whole = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    ids, sizes = _unpack(whole, [8, 6])
    ends = 4 + 14 * len(ids) + np.cumsum(sizes)
    return ids, [whole[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _meet(batches: Iterator[pa.RecordBatch], widths: list[int]) -> Iterator[tuple[np.ndarray, list[bytes], list[np.ndarray]]]:
    """(ids, texts, findings) of each pack of texts, with the findings of its home sorted by document."""
    held, at, table = [], None, None
    trim_memory()
    for batch in batches:
        for to, kind, packed in _packs(batch):
            if to != at:
                held, at, table = [], to, None
            if kind != 9:
                held.append(packed)
                continue
            if table is None:
                table = [np.concatenate(x) for x in zip(*(_unpack(x, widths) for x in held), strict=True)] if held else [np.zeros(0, dtype=np.int64) for _ in widths]
                order = np.argsort(table[0], kind="stable")
                table, held = [x[order] for x in table], []
            ids, texts = _texts(packed)
            yield ids, texts, table


def _send_contexts(deal: int):
    def use(ids: np.ndarray, texts: list[bytes], replies: list[np.ndarray], spans: _Outbox, contexts: _Outbox) -> None:
        low, high = np.searchsorted(replies[0], ids, side="left"), np.searchsorted(replies[0], ids, side="right")
        pick = np.flatnonzero(high > low)
        own = [texts[i] for i in pick]
        owner, position, h, _ = _many_anchors(own)
        bounds = np.searchsorted(owner, np.arange(len(own) + 1))
        sizes = (high - low)[pick]
        who = np.repeat(np.arange(len(pick)), sizes)
        rows_at = np.repeat(low[pick], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        anchor = bounds[who] + replies[1][rows_at]
        status = replies[2][rows_at]
        lengths = np.array([len(x) for x in own], dtype=np.int64)
        p, doc = position[anchor], ids[pick][who]
        lengths = np.array([len(x) for x in own], dtype=np.int64)
        one = status == 1
        # covered contexts of a document that touch become one span
        s, e, d, w = np.maximum(p - LEFT, 0)[one], np.minimum(p + LENGTH, lengths[who])[one], doc[one], who[one]
        order = np.lexsort((s, w))
        s, e, d, w = s[order], e[order], d[order], w[order]
        if len(s):
            reach = np.maximum.accumulate(e + w * np.int64(1 << 40)) - w * np.int64(1 << 40)
            fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (s[1:] > reach[:-1])])
            first = np.flatnonzero(fresh)
            last = np.concatenate([first[1:], [len(s)]]) - 1
            spans.put(_home(d[first], deal), [d[first], s[first], reach[last]])
        two = np.flatnonzero(status == 2)
        if len(two):
            contexts.put((h[anchor[two]] % np.uint64(deal)).astype(np.int64), [doc[two], p[two], *_windows(own, who[two], p[two])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, contexts = _Outbox(1, _SPAN, deal), _Outbox(0, _CONTEXT, deal)
        for met in _meet(batches, _REPLY):
            use(*met, spans, contexts)
            if spans.full() or contexts.full():
                yield _batch(spans.rows() + contexts.rows())
        yield _batch(spans.rows() + contexts.rows())

    return run


def scan(common: list[int], least: list[int]) -> np.ndarray:
    """The intervals (depth, first, end) of the common-prefix tree of sorted strings, by a stack.

    `common` has the length of each string's common prefix with the one before, -1 at a border that no
    interval crosses; `least` the depth from which on intervals that begin there are wanted.
    """
    out, depths, firsts = [], [-1], [0]
    for i, c in enumerate([*common, -1]):
        first = i - 1
        while depths[-1] > c:
            depth, first = depths.pop(), firsts.pop()
            if depth >= least[first]:
                out.append((depth, first, i))
        if depths[-1] < c:
            depths.append(c)
            firsts.append(first)
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def _sorted_by(chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of byte strings that are filled up with zeros; a string is before those that it begins."""
    n, width = chars.shape
    words = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    words[:, :width] = chars
    return np.lexsort((sizes, *words.view(">u8").astype(np.uint64).T[::-1]))


def _common(chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The common prefix of each string with the one before; the first has none (-1)."""
    differ = chars[1:] != chars[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), chars.shape[1])
    return np.concatenate([[-1], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))])


def maximal_repeats(doc: np.ndarray, before: np.ndarray, after: np.ndarray, chars: np.ndarray, one_document: bool = False, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts around anchors -> maximal repeats of LENGTH bytes and more, in two documents or more (or in one as well).

    Some repeats at once: bytes before the anchor, bytes from it on, number of occurrences, and the
    occurrences (places in the input) of one repeat after the other.
    """
    order = _sorted_by(chars[:, LEFT:], after)
    right = scan(_common(chars[order, LEFT:], after[order]).tolist(), [ANCHOR] * len(doc))
    if not len(right):
        return
    bounds, sorted_doc = right[:, 1:].ravel(), np.append(doc[order], doc[order[-1]])
    right = right[one_document | (np.minimum.reduceat(sorted_doc, bounds)[::2] < np.maximum.reduceat(sorted_doc, bounds)[::2])]
    if not len(right):
        return
    left_chars = np.ascontiguousarray(chars[:, LEFT - 1 :: -1][:, :LEFT])
    rank = np.empty(len(doc), dtype=np.int64)
    rank[_sorted_by(left_chars, before)] = np.arange(len(doc))
    sizes = right[:, 2] - right[:, 1]
    pieces = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // most, prepend=-1))
    for a, b in zip(pieces, [*pieces[1:], len(right)], strict=True):
        depth, first, size = right[a:b, 0], right[a:b, 1], sizes[a:b]
        node = np.repeat(np.arange(b - a), size)
        member = order[ranges(first, size)]
        member = member[np.lexsort((rank[member], node))]
        common = _common(left_chars[member], before[member])
        common[np.cumsum(size) - size] = -1
        groups = scan(common.tolist(), (LENGTH - depth)[node].tolist())
        if not len(groups):
            continue
        count = groups[:, 2] - groups[:, 1]
        cuts = np.flatnonzero(np.diff((np.cumsum(count) - 1) // most, prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(groups)], strict=True):
            part, n = groups[i:j], count[i:j]
            own, starts = doc[member[ranges(part[:, 1], n)]], np.cumsum(n) - n
            several = one_document | (np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts))
            part, n = part[several], n[several]
            if len(part):
                yield part[:, 0], depth[node[part[:, 1]]], n, member[ranges(part[:, 1], n)]


def repeats_of(doc: np.ndarray, before: np.ndarray, after: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts around anchors: how far left and right of its anchor each one is covered (-1: not at all)."""
    left, right = np.full(len(doc), -1), np.full(len(doc), -1)
    for a, d, n, member in maximal_repeats(doc, before, after, chars):
        least = np.minimum.reduceat(doc[member], np.cumsum(n) - n)
        gone = doc[member] > np.repeat(least, n)
        np.maximum.at(left, member[gone], np.repeat(a, n)[gone])
        np.maximum.at(right, member[gone], np.repeat(d, n)[gone])
    return left, right


def _contexts(held: list[bytes]) -> list[np.ndarray]:
    parts = []
    for x in held:
        columns = _unpack(x, _CONTEXT)
        parts.append([*columns, np.frombuffer(x[4 + 16 * len(columns[0]) :], dtype=np.uint8).reshape(-1, WIDTH)])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _compare_contexts(deal: int):
    def settle(held: list[bytes], box: _Outbox) -> None:
        doc, p, before, after, chars = _contexts(held)
        left, right = repeats_of(doc, before, after, chars)
        some = left >= 0
        box.put(_home(doc[some], deal), [doc[some], (p - left)[some], (p + right)[some]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_deal(batches, {0: (settle, _Outbox(1, _SPAN, deal))})

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    kept, at, runs, reach = [], 0, 0, -1
    for i in np.argsort(starts, kind="stable").tolist():
        s, e = int(starts[i]), int(ends[i])
        if s > reach:
            runs += 1
            kept.append(raw[at:s])
        reach = max(reach, e)
        at = reach
    kept.append(raw[at:])
    return b"".join(kept), runs


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in OUT.split(", ")]
    for ids, texts, spans in _meet(batches, _SPAN):
        low, high = np.searchsorted(spans[0], ids, side="left"), np.searchsorted(spans[0], ids, side="right")
        out = []
        for i, raw in enumerate(texts):
            kept, runs = cut(raw, spans[1][low[i] : high[i]], spans[2][low[i] : high[i]]) if high[i] > low[i] else (raw, 0)
            out.append((None if ids[i] == _NO_ID else int(ids[i]), len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string() if n == "kept_sha256" else pa.int64()) for c, n in zip(zip(*out, strict=True), names, strict=True)], names)


def _plan(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(doc_id, text) as bytes, the number of destinations of packs, and the tasks that read them."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows, min(2**31 - 1, max(2 * least, size // DEAL_BYTES)), max(least, size // TASK_BYTES)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows, deal, tasks = _plan(docs, id_col, text_col)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "deal").sortWithinPartitions("deal", "kind")

    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(rows))
    packs = rows.mapInArrow(_pack_texts(deal), _ROWS)
    replies = materialize(dealt(rows.mapInArrow(_send_hashes(deal, hot), _ROWS)).mapInArrow(_compare_hashes(deal), _ROWS), "repeats-replies")
    contexts = dealt(replies.filter("kind <> 3").unionByName(packs)).mapInArrow(_send_contexts(deal), _ROWS)
    spans = materialize(dealt(contexts).mapInArrow(_compare_contexts(deal), _ROWS), "repeats-spans")
    spans = spans.unionByName(replies.filter("kind = 3").withColumn("kind", F.lit(1)))
    return dealt(spans.unionByName(packs)).mapInArrow(_finish, OUT)


GROUPS = "repeat long, length int, before int, anchor long, context long"


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different contexts of each maximal repeat, of packs of contexts."""
    found: list[pa.RecordBatch] = []

    def settle(held: list[bytes], box: None) -> None:
        doc, p, before, after, chars = _contexts(held)
        values, column = (chars.astype(np.uint64) + np.uint64(1)) * _UP[:WIDTH], np.arange(WIDTH) - LEFT
        own = (values * ((column >= -before[:, None]) & (column < after[:, None]))).sum(axis=1, dtype=np.uint64)
        c = mix(own * _DOWN[LEFT - before] + ((before + after) * 128 + before).astype(np.uint64)).view(np.int64)
        h = ((mix(values[:, LEFT : LEFT + ANCHOR].sum(axis=1, dtype=np.uint64) * _DOWN[LEFT]) | np.uint64(1)) & _KEEP).view(np.int64)
        for a, d, n, member in maximal_repeats(doc, before, after, chars, one_document=True):
            name = np.repeat(mix(c[member[np.cumsum(n) - n]].view(np.uint64) + (a * 64 + d).astype(np.uint64)), n).view(np.int64)
            found.append(pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.repeat(a + d, n).astype(np.int32)), pa.array(np.repeat(a, n).astype(np.int32)), pa.array(h[member]), pa.array(c[member])], [x.split()[0] for x in GROUPS.split(", ")]))

    held, at = [], None
    for batch in batches:
        for to, kind, packed in _packs(batch):
            if to != at and held:
                settle(held, None)
                held = []
                yield from found
                found.clear()
            if kind == 0:
                at = to
                held.append(packed)
    if held:
        settle(held, None)
    yield from found


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _runs(batches):
        owner, p, h, c = _many_anchors(texts)
        doc, lengths = ids[owner], np.array([len(x) for x in texts], dtype=np.int64)
        before = np.minimum(p, LEFT)
        window = before + np.minimum(LENGTH, lengths[owner] - p) if len(owner) else before
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), doc, p, before.astype(np.int64), window.astype(np.int64))], ["anchor", "context", "doc_id", "p", "own_before", "window"])


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repeat, length, doc_id, start: every occurrence of each maximal repeat of LENGTH bytes or more in two documents or more.

    The suffix array has each different context once; a join brings its occurrences, so a frequent
    context is never gathered. Contexts of one anchor meet in one task here, hot or not.
    """
    rows, deal, tasks = _plan(docs, id_col, text_col)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "deal").sortWithinPartitions("deal", "kind")

    none = docs.sparkSession.sparkContext.broadcast(np.zeros(0, dtype=np.uint64))
    packs = rows.mapInArrow(_pack_texts(deal), _ROWS)
    replies = dealt(rows.mapInArrow(_send_hashes(deal, none), _ROWS)).mapInArrow(_compare_hashes(deal, one_document=True), _ROWS)
    contexts = dealt(replies.unionByName(packs)).mapInArrow(_send_contexts(deal), _ROWS).filter("kind = 0")
    members = materialize(dealt(contexts).mapInArrow(_group_rows, GROUPS).distinct(), "repeats-groups")
    places = rows.mapInArrow(_occurrences, "anchor long, context long, doc_id long, p long, own_before long, window long").filter(F.col("window") >= LENGTH)
    # a context that several documents have is a repeat of its own
    shared = places.groupBy("anchor", "context").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("window").cast("int").alias("length"), F.first("own_before").cast("int").alias("before")).filter("low < high")
    members = members.unionByName(shared.select(F.xxhash64("anchor", "context").alias("repeat"), "length", "before", "anchor", "context"))
    found = materialize(places.join(members, ["anchor", "context"]).select("repeat", "length", "doc_id", (F.col("p") - F.col("before")).alias("start")).distinct(), "repeats-found")
    several = found.groupBy("repeat").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("repeat")
    return found.join(several, "repeat", "left_semi").select("repeat", "length", F.when(F.col("doc_id") < _NO_ID, F.col("doc_id")).alias("doc_id"), "start")
