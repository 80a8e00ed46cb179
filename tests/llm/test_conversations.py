"""Operator 11 against all cheapest edits of small conversations, whole and cut into chunks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from duolume.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = {"su", "ua", "au"}


def damaged(rows):
    """(conv, turn, role, text) after damage, by conversation, in order; all conversations."""
    found = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        found.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for k, v in found.items()}


def wanted(rows):
    """The report on one damaged conversation, by looking at every cheapest string of edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, last, room):
        """(cost, strings with rows kept) to finish from row i, when the last initial is `last` and `room` inserts may follow at once."""
        ways = []
        if i == len(rows):
            if last in "-a":
                ways.append((0, {("", ())}))
        else:
            _, role, text = rows[i]
            more = 3 if faults[i] == "truncated" else 0
            ways.append((4 + best(i + 1, last, 3)[0], {("D" + s, r) for s, r in best(i + 1, last, 3)[1]}))
            if faults[i] not in ("blank", "duplicate"):
                for letter, cost, name in [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                    x = name[:1]
                    if x and (last + x in ("-s", "-u", "su", "ua", "au")):
                        c, found = best(i + 1, x, 3)
                        ways.append((c + cost + more, {(letter + s, ((name, text), *r)) for s, r in found}))
        if room:
            for name in ("user", "assistant"):
                if last + name[0] in ("-u", "su", "ua", "au"):
                    c, found = best(i, name[0], room - 1)
                    ways.append((c + 3, {("I" + s, ((name, ""), *r)) for s, r in found}))
        least = min((c for c, _ in ways), default=10**6)
        return least, set().union(*(x for c, x in ways if c == least)) if ways else set()

    cost, found = best(0, "-", 3)
    audit, repaired = min(found)
    turns = [x[0] for x in rows if x[0] is not None]
    initials = [x[1][:1] for x in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest(),
    )


def odd_rows(seed=3, convs=60):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        n = rng.choice([1, 2, 3, 5, 7])
        for k in range(n):
            turn = rng.choice([None, k, k, k, k + 1, k * 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "sys"])
            rows.append((conv, turn, role, rng.choice([f"text {k}.", f"text {k}.", "same.", "same.", "cut", "why?  \n", "", " \t", None, "é\x0b."])))
    return rows + rows[5:9]


def check(spark, rows, n_parts=4, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"first": F.lit(1), "copies": F.lit("x"), "piece": F.lit(2)})
    spark.conf.set("spark.sql.shuffle.partitions", str(n_parts))
    try:
        got = {x[0]: tuple(x)[1:] for x in R.report(R.repair(R.damage(df), **how)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {k: wanted(v) for k, v in damaged(rows).items()}


@pytest.mark.parametrize("how", [{}, {"chunk_rows": 1}, {"chunk_rows": 2, "most_passes": 1}, {"chunk_rows": 3, "most_passes": 0}, {"chunk_bytes": 1}])
def test_all_cheapest_edits(spark, how):
    check(spark, odd_rows(), **how)


def test_long_conversation_in_many_tasks(spark):
    """One conversation has nearly all rows; it is cut into chunks of several tasks, with the same report as whole."""
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"t {k}.", f"t {k}", "same.", ""])) for k in range(3000)] + odd_rows(5, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    found = [sorted(map(tuple, R.report(R.repair(R.damage(df), **how)).collect()), key=str) for how in ({}, {"chunk_rows": 64}, {"chunk_rows": 200, "most_passes": 0})]
    assert found[0] == found[1] == found[2]
    pieces = R.repair(R.damage(df), chunk_rows=64)
    assert pieces.filter("conv_id = 7").count() >= 40
    rows = R.repaired_rows(pieces).filter("conv_id = 7").orderBy("piece", "place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in rows))
    digest = hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in rows).encode()).hexdigest()
    assert digest == next(x[-1] for x in found[0] if x[0] == 7)


def test_rows_that_keep_vectors_apart(spark):
    """Truncated or deleted rows only: vectors don't converge, and maps of chunks are composed."""
    rows = [(1, k, "user", f"cut {k}") for k in range(40)] + [(2, k, "assistant", "same.") for k in range(40)] + [(2, 50, "user", "end.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(1))
    whole, cut = (sorted(map(tuple, R.report(R.repair(df, **how)).collect())) for how in ({"chunk_rows": 1000}, {"chunk_rows": 4, "most_passes": 1}))
    assert whole == cut and [x[6] for x in whole] == [x for x in (whole[0][6], whole[1][6])]
    assert whole[1][2:5] == (0, 39, 0)


def test_equal_rows_are_one_group(spark):
    rows = [(1, 0, "user", "same.")] * 500 + [(1, 1, "assistant", "yes.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(1))
    for how in ({}, {"chunk_rows": 7}):
        found = R.report(R.repair(df, **how)).first()
        assert (found["duplicate"], found["cost"], found["audit"]) == (499, 4 * 499, "K" + "D" * 499 + "K")


def test_empty_and_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.report(R.repair(R.damage(none))).collect() == []
    rows = [(1, None, "user", "x" * 2_000_000 + "."), (1, None, "assistant", None), (3, None, None, None)]
    check(spark, rows)


def test_dropped_conversations_remain(spark):
    turn = next(k for k in range(100) if zlib.crc32(f"5:{k}".encode()) % 20 == 0)
    rows = [(5, turn, "user", "gone.")]
    check(spark, rows)
    assert wanted([]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
