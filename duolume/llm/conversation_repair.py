"""Operator 11: conversation structure repair by rank-convergence parallel Viterbi.

A conversation is repaired to role initials `(s?(ua)+)?` by the cheapest edits of
its rows: Keep (K, 0), Rerole to user or assistant (R, 3), Delete (D, 4; blank and
duplicate rows can only be deleted), Insert an empty user or assistant row (I, 3).
A truncated row that isn't deleted costs 3 more. Among the cheapest edits those
with the ASCII-least string of initials are taken.

Rows are sorted by ranges of (conversation, turn, role, text), so a conversation of
any size lies in as many tasks as it needs, and cut into chunks of bounded rows and
bytes. A chunk's backward costs (cheapest way to finish from each of four states)
start from a speculative vector, the one at a conversation's end. Vectors are kept
without their constants; there are few of them (VECTORS), and a step is a look-up.
Fix-up passes rerun chunks whose neighbour came to another vector than assumed, and
stop where old and new vectors differ only by a constant. Runs of rows may keep
vectors apart for ever (all deleted, all truncated), so after MOST_PASSES the chunks
of such conversations are run from all vectors at once and their maps composed. With
the stitched costs, each chunk maps its state at entry to that at exit, these maps
are composed, and all chunks are traced at once. A conversation that begins and ends
inside one chunk needs no neighbour and is traced where it is packed.

Composition and window go over one row for a chunk, not for a row. The hash of a
whole repaired conversation is serial by nature: its pieces pass one task as a stream.

Null conv_id is a conversation of its own. Nulls elsewhere are one space, turns
excepted, which come first. Rows of one turn are ordered by role, then text; equal
rows are adjacent, and all but the first are duplicates. A role that is empty or
begins with another letter than s, u, a can't be kept. Long texts are carried whole.
Empty tables give empty results. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

CHUNK_ROWS = 16_384
CHUNK_BYTES = 1 << 20
MOST_PASSES = 3

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled row.
FORCED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept row, by its initial.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INITIALS = ("s", "u", "a", "")
#: Rows as codes: place in INITIALS, 4 more if truncated; GONE if the row must be deleted.
GONE = 8
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"


def _edits(code: int, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """Edits that use up a row: letter, cost of all that follows too, next state."""
    found = [("D", DELETE + after[state], state)]
    if code != GONE:
        more = TRUNCATED if code & 4 else 0
        to = KEPT.get(INITIALS[code & 3], {}).get(state)
        if to is not None:
            found.append(("K", more + after[to], to))
        found.append(("R", REROLE + more + after[FORCED[state]], FORCED[state]))
    return found


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(2):
        costs = [min(costs[q], INSERT + costs[FORCED[q]]) for q in range(4)]
    return tuple(costs)


def _relative(costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(x - costs[ASSISTANT] for x in costs)


#: Costs at the end of a conversation.
END = (0, 6, 3, 0)


def _closure() -> tuple[list[tuple[int, ...]], np.ndarray, list[list[list[tuple[str, int]]]]]:
    """All vectors that can come up; the vector before a row, by code and vector; letters and next state, by code, vector and state."""
    vectors, steps, paths, at = [END], [[] for _ in range(GONE + 1)], [[] for _ in range(GONE + 1)], 0
    while at < len(vectors):
        after = vectors[at]
        for code in range(GONE + 1):
            costs = _with_inserts([min(x[1] for x in _edits(code, q, after)) for q in range(4)])
            if _relative(costs) not in vectors:
                vectors.append(_relative(costs))
            steps[code].append(vectors.index(_relative(costs)))
            found = []
            for state in range(4):
                letters, q, used = "", state, False
                while not used:
                    ways = [(x, to, True) for x, cost, to in _edits(code, q, after) if cost == costs[q]]
                    if INSERT + costs[FORCED[q]] == costs[q]:
                        ways.append(("I", FORCED[q], False))
                    letter, q, used = min(ways)
                    letters += letter
                found.append((letters, q))
            paths[code].append(found)
        at += 1
    return vectors, np.array(steps), paths


VECTORS, _STEPS, PATHS = _closure()
STEPS = _STEPS.tolist()
#: Inserts at the end of a conversation, by state.
TAIL = ("", "II", "I", "")


def run_back(codes: bytes, vector: int) -> int:
    """The vector at the start of a chunk."""
    for code in reversed(codes):
        vector = STEPS[code][vector]
    return vector


def fix_up(codes: bytes, old: int, new: int, start: int) -> int:
    """The vector at the start, if the one at the end isn't `old` as assumed; `start` is what `old` gave."""
    for code in reversed(codes):
        if old == new:  # they differ only by a constant from here on
            return start
        old, new = STEPS[code][old], STEPS[code][new]
    return new


def _vectors(codes: bytes, end: int) -> list[int]:
    """The vector after each row."""
    found = [end]
    for code in reversed(codes[1:]):
        found.append(STEPS[code][found[-1]])
    return found[::-1]


def exits(codes: bytes, end: int) -> list[int]:
    """The state at the end of a chunk, for each at its start."""
    states = list(range(4))
    for code, after in zip(codes, _vectors(codes, end), strict=False):
        states = [PATHS[code][after][q][1] for q in states]
    return states


def trace(codes: bytes, roles: list[str], texts: list[str], end: int, state: int, last: bool) -> tuple[str, int, list[str], list[str]]:
    """Letters, cost, repaired roles and texts. Roles and texts are those of rows that aren't GONE."""
    letters, cost, new_roles, new_texts, at = [], 0, [], [], 0
    for code, after in zip(codes, _vectors(codes, end), strict=False):
        found, to = PATHS[code][after][state]
        for letter in found:
            if letter == "D":
                cost += DELETE
            elif letter == "K":
                cost += TRUNCATED if code & 4 else 0
                new_roles.append(roles[at])
                new_texts.append(texts[at])
                state = to
            else:
                state = FORCED[state]
                cost += INSERT if letter == "I" else REROLE + (TRUNCATED if code & 4 else 0)
                new_roles.append(NAMES[state])
                new_texts.append("" if letter == "I" else texts[at])
        letters.append(found)
        at += code != GONE
    if last:
        letters.append(TAIL[state])
        for _ in TAIL[state]:
            state = FORCED[state]
            new_roles.append(NAMES[state])
            new_texts.append("")
            cost += INSERT
    return "".join(letters), cost, new_roles, new_texts


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32(`conv_id:turn`) % 20; dropped ones have 0 copies."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def mark_first(rows: DataFrame) -> DataFrame:
    """Adds `first`: no earlier turn has this role and text. Equal rows of a turn become one with all copies.

    Counts by hash are pre-aggregated; only rows that come more than once are grouped by their text.
    """
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("digest", F.when(F.col("copies") > 0, digest))
    seen = rows.filter("copies > 0").groupBy("conv_id", "digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).getField("turn").alias("first_turn")).filter("n > 1")
    seen = materialize(seen.select(F.col("conv_id").alias("seen_conv"), F.col("digest").alias("seen_digest"), "first_turn"), "seen")
    same = F.col("conv_id").eqNullSafe(F.col("seen_conv")) & (F.col("digest") == F.col("seen_digest"))
    names = ["conv_id", "turn", "role", "text"]
    once = rows.join(seen, same, "left_anti").select(*names, F.lit(True).alias("first"), "copies")
    twice = rows.join(seen, same).select(*names, F.col("turn").eqNullSafe(F.col("first_turn")).alias("first"), "copies")
    return once.unionByName(twice.groupBy(*names, "first").agg(F.sum("copies").cast("int").alias("copies")))


COUNTS = ("n_rows", "n_turns", "blank", "duplicate", "truncated", "illegal")
PIECES = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    + [(x, pa.int64()) for x in (*COUNTS, "low_turn", "high_turn")]
    + [("low_initial", pa.string()), ("high_initial", pa.string()), ("audit", pa.string()), ("cost", pa.int64())]
)
PIECES_DDL = "conv_id long, piece long, whole boolean, codes binary, roles array<string>, texts array<string>, " + ", ".join(f"{x} long" for x in (*COUNTS, "low_turn", "high_turn")) + ", low_initial string, high_initial string, audit string, cost long"


class _Chunk:
    """Rows of a conversation one after the other; low and high are its first and last turn and initial."""

    def __init__(self) -> None:
        self.codes, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.n = dict.fromkeys(COUNTS, 0)
        self.low_turn = self.high_turn = self.low_initial = self.high_initial = None

    def add(self, turn: int | None, role: str, text: str, first: bool, copies: int) -> None:
        n, kept = self.n, text.rstrip(WHITE)
        code = INITIALS.index(role[:1]) if role[:1] in KEPT else 3
        if not kept:
            n["blank"] += copies
            code = GONE
        else:
            n["duplicate"] += copies - bool(first)
            if not first:
                code = GONE
            elif kept[-1] not in ".!?":
                n["truncated"] += 1
                code += 4
        if code != GONE:
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(role) + len(text)
        self.codes.append(code)
        self.codes.extend(bytes([GONE]) * (copies - 1))
        n["n_rows"] += copies
        n["illegal"] += (copies - 1) * (role[:1] * 2 not in LEGAL)
        if self.high_initial is None:
            self.low_initial = role[:1]
        else:
            n["illegal"] += self.high_initial + role[:1] not in LEGAL
        self.high_initial = role[:1]
        if turn is not None:
            n["n_turns"] += turn != self.high_turn
            self.low_turn, self.high_turn = turn if self.low_turn is None else self.low_turn, turn

    def row(self, conv: int | None, piece: int, whole: bool) -> tuple:
        codes, roles, texts, audit, cost = bytes(self.codes), self.roles, self.texts, None, None
        if whole:
            audit, cost, roles, texts = trace(codes, roles, texts, 0, START, True)
        return (conv, piece, whole, codes, roles, texts, *self.n.values(), self.low_turn, self.high_turn, self.low_initial, self.high_initial, audit, cost)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda row: 100) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= 1 << 20:
            yield _batch(held, schema)
            held, n = [], 0
    if held:
        yield _batch(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(x.to_pylist() for x in batch.columns), strict=True)


def pack(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of conversations, in the order of `piece`; those that are whole conversations are repaired already.

    The first and the last conversation of a task may go on in another one.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        piece, conv, chunk, before = TaskContext.get().partitionId() << 32, None, None, False  # before: the conversation has, or may have, earlier chunks
        for found, turn, role, text, first, copies in _rows(batches):
            if chunk is None or found != conv:
                if chunk is not None:
                    yield chunk.row(conv, piece, not before)
                    piece += 1
                conv, chunk, before = found, _Chunk(), chunk is None
            elif len(chunk.codes) >= chunk_rows or chunk.size >= chunk_bytes:
                yield chunk.row(conv, piece, False)
                piece, chunk, before = piece + 1, _Chunk(), True
            while copies > 0:  # a row with very many copies is cut as well
                now = min(copies, chunk_rows)
                chunk.add(turn, role, text, first, now)
                copies, first = copies - now, False
                if copies:
                    yield chunk.row(conv, piece, False)
                    piece, chunk, before = piece + 1, _Chunk(), True
        if chunk is not None:
            yield chunk.row(conv, piece, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(chunks(batches), PIECES, lambda row: 200 + len(row[3]) + 2 * sum(map(len, row[5])))

    # the head of a text is enough to part ranges; a sample of these keys goes to the driver
    order = ["conv_id", "turn", "role", "text"]
    ranges = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    return ranges.select(*order, "first", "copies").sortWithinPartitions(*order).mapInArrow(run, PIECES_DDL)


def _mapped(pieces: DataFrame, f: Callable[..., tuple], schema: str, types: list[tuple[str, pa.DataType]]) -> DataFrame:
    arrow = pa.schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((f(*row) for row in _rows(batches)), arrow)

    return pieces.mapInArrow(run, schema)


def _composed(maps: DataFrame, first: int, descending: bool) -> DataFrame:
    """conv_id, piece, value: what stands before each piece (after it, if descending) when maps are applied one after the other, from `first`."""
    arrow = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("value", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values() -> Iterator[tuple]:
            last, value = (), first
            for conv, piece, to in _rows(batches):
                if (conv,) != last:
                    last, value = (conv,), first
                yield conv, piece, value
                value = to[value]

        return _batches(values(), arrow)

    order = F.desc("piece") if descending else F.asc("piece")
    return maps.select("conv_id", "piece", "to").repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, "conv_id long, piece long, value int")


def stitched_ends(pieces: DataFrame, most_passes: int = MOST_PASSES) -> DataFrame:
    """piece, end, last: the vector of backward costs at the end of each chunk, and whether the conversation ends there."""
    codes = pieces.select("conv_id", "piece", "codes")
    starts = _mapped(codes, lambda conv, piece, codes: (conv, piece, run_back(codes, 0)), "conv_id long, piece long, start int", [("conv_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int32())])
    known = materialize(starts.withColumn("end", F.lit(0)), "starts")
    after = F.lead("start").over(Window.partitionBy("conv_id").orderBy("piece"))
    for k in range(most_passes + 1):
        known = materialize(known.withColumn("new_end", F.coalesce(after, F.lit(0))).withColumn("last", after.isNull()), "ends")
        wrong = known.filter("new_end <> end")
        if wrong.isEmpty():
            return known.select("piece", "end", "last")
        if k == most_passes:
            break
        rerun = codes.join(wrong.select("piece", "end", "new_end", "start"), "piece").select("piece", "codes", "end", "new_end", "start")
        fixed = _mapped(rerun, lambda piece, codes, old, new, start: (piece, fix_up(codes, old, new, start)), "piece long, fixed int", [("piece", pa.int64()), ("fixed", pa.int32())])
        known = known.join(fixed, "piece", "left").select("conv_id", "piece", F.coalesce("fixed", "start").alias("start"), F.col("new_end").alias("end"))
    slow = wrong.select(F.col("conv_id").alias("slow")).distinct()
    in_slow = F.col("conv_id").eqNullSafe(F.col("slow"))

    def from_all(conv: int | None, piece: int, codes: bytes) -> tuple:
        now = np.arange(len(VECTORS))
        for code in reversed(codes):
            now = _STEPS[code][now]
        return conv, piece, now.tolist()

    maps = _mapped(codes.join(slow, in_slow, "left_semi"), from_all, "conv_id long, piece long, to array<int>", [("conv_id", pa.int64()), ("piece", pa.int64()), ("to", pa.list_(pa.int32()))])
    found = _composed(maps, 0, True).select("piece", F.col("value").alias("end"))
    return known.join(found, "piece", "left").select("piece", F.coalesce(found["end"], known["end"]).alias("end"), "last")


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, most_passes: int = MOST_PASSES) -> DataFrame:
    """Repaired chunks of conversations (conv_id, turn, role, text, copies), in the order of `piece`.

    audit has the edits' initials, roles and texts the repaired rows. Rows with 0
    copies are not looked at, but their conversations have a piece.
    """
    small_batches(rows.sparkSession)
    packed = materialize(pack(mark_first(rows), chunk_rows, chunk_bytes), "packed")
    done, pieces = packed.filter("whole"), packed.filter("not whole")
    if pieces.isEmpty():
        return done.drop("codes")
    ends = materialize(stitched_ends(pieces, most_passes), "stitched")
    codes = pieces.select("conv_id", "piece", "codes").join(ends, "piece")
    maps = _mapped(codes.select("conv_id", "piece", "codes", "end"), lambda conv, piece, codes, end: (conv, piece, exits(codes, end)), "conv_id long, piece long, to array<int>", [("conv_id", pa.int64()), ("piece", pa.int64()), ("to", pa.list_(pa.int32()))])
    entries = materialize(_composed(maps, START, False).select("piece", F.col("value").alias("entry")).join(ends, "piece"), "entries")
    names = [x for x in PIECES.names if x not in ("audit", "cost")]

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for *row, end, entry, last in _rows(batches):
                audit, cost, roles, texts = trace(row[3], row[4], row[5], end, entry, last)
                yield (*row[:4], roles, texts, *row[6:], audit, cost)

        return _batches(found(), PIECES, lambda row: 200 + len(row[3]) + 2 * sum(map(len, row[5])))

    rest = pieces.select(*names).join(entries, "piece").select(*names, "end", "entry", "last").mapInArrow(traced, PIECES_DDL)
    return done.unionByName(rest).drop("codes")


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, place, role, text: the rows of repaired conversations; order by piece and place."""
    return pieces.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row")).select("conv_id", "piece", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(pieces: DataFrame) -> DataFrame:
    """A row for each conversation: faults, cost, edits, hash of its repaired rows."""
    lines = F.concat_ws("\n", F.zip_with("roles", "texts", lambda role, text: F.concat(role, F.lit(":"), text)))
    gaps = F.coalesce(F.col("high_turn") - F.col("low_turn") + 1 - F.col("n_turns"), F.lit(0))
    whole = pieces.filter("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    arrow = pa.schema([("conv_id", pa.int64()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now = None

            def end() -> tuple:
                gaps = high - low + 1 - n_turns if low is not None else 0
                return (*now, gaps, *counts, "".join(audits), digest.hexdigest())

            for conv, roles, texts, n_rows, n_turn, *faults, low_turn, high_turn, low_initial, high_initial, audit, cost in _rows(batches):
                if (conv,) != now:
                    if now is not None:
                        yield end()
                    now, counts, audits, digest, begun = (conv,), [0] * 5, [], hashlib.sha256(), False
                    low = high = initial = None
                    n_turns = 0
                counts = [a + b for a, b in zip(counts, (*faults, cost), strict=True)]
                if n_rows:
                    counts[3] += initial is not None and initial + low_initial not in LEGAL
                    initial = high_initial
                n_turns += n_turn - (low_turn is not None and low_turn == high)
                low, high = low_turn if low is None else low, high if high_turn is None else high_turn
                audits.append(audit)
                for role, text in zip(roles, texts, strict=True):
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
            if now is not None:
                yield end()

        return _batches(found(), arrow, lambda row: 200 + len(row[7]))

    names = ["conv_id", "roles", "texts", *COUNTS, "low_turn", "high_turn", "low_initial", "high_initial", "audit", "cost"]
    parts = pieces.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select(*names).mapInArrow(run, RESULT)
    return whole.unionByName(parts)
