"""Operator 2: mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words by water-filling (weights, and a cap
of some times its own size). Within a source, a document's expected copies are level * odds, at most the cap:
odds grow with the fourth root of its length (a document sixteen times as long is twice as likely), or by a
weight column; the level is water-filled as well, so that expected words meet the target. Odds are
rounded to eighths of an octave, which keeps the table of levels small. Whole
copies are certain; the rest is an inclusion probability p. Documents are then
ranked by [u / (1 - u)] / [p / (1 - p)], u being a uniform number made from the
id, and the first of them are taken until the source's words are used up: the
sample has a fixed size in words, with unequal probabilities.

No source is sorted as a whole. A histogram of the ranks finds the bin in which
the cut lies, a second one splits that bin a thousandfold, and only rows of the
last bin are put in order. Where a large document lies on the cut, the one
document whose addition or removal brings the source nearest to its target is
changed at the end.

Null or empty texts have size 0 and are taken 0 times. Null sources are a source
(the last). Rows with equal ids and sizes have equal ranks and are taken together, the last change included, so a source
that mostly consists of such rows may miss its target by some of them; so do null ids of one size. Weights of 0 or less and
null weights count as the smallest odds. Empty tables give an empty result. The result has the named columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_columns, word_count

BINS = 1024
#: Odds of a document grow with this power of its words.
LENGTH_POWER = 0.25
#: Sources whose plan is broadcast; with more, documents are joined to it by source.
MOST_BROADCAST = 100_000


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) made from a key: 52 bits of an MD5 sum."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target: one row for each source.

    Sources in code-point order (null last) take the weights in turn; together they
    get `share` times all sizes. What a source can't take (over `cap` times its
    size) is shared again by weight, until none is above: in order of cap / weight,
    source k is full if the level that all from k on would reach is above its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int")))
    per = per.withColumn("all_words", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    left = F.col("all_words") - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    reached = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("reached", reached).select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("reached") * F.col("weight")).alias("target"))


def odds_levels(sized: DataFrame, per: DataFrame, cap: float) -> DataFrame:
    """s (source), level: where expected copies min(cap, level * odds) give the target; null if all are at the cap. A row for each source and odds is all that is ordered."""
    rows = sized.groupBy("source", "own_weight").agg(F.sum("size").alias("n")).filter("n > 0").join(per.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
    order = Window.partitionBy("source").orderBy(F.desc("own_weight"))
    left = F.col("target") - F.lit(float(cap)) * F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum(F.col("n") * F.col("own_weight")).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("at", F.row_number().over(order)).withColumn("full", F.col("level") * F.col("own_weight") >= F.lit(float(cap)))
    first = rows.groupBy("source").agg(F.min(F.when(~F.col("full"), F.struct("at", "level"))).alias("m"))
    return per.select(F.col("source").alias("s")).join(first, F.col("s").eqNullSafe(F.col("source")), "left").select("s", F.col("m.level").alias("level"))


def _cut(rows: DataFrame, bin_col: str) -> DataFrame:
    """For each source, the bin in which its words run out, and the words in the bins before."""
    bins = rows.groupBy("source", bin_col).agg(F.sum("size").alias("n"), F.first("need").alias("need"))
    running = F.sum("n").over(Window.partitionBy("source").orderBy(bin_col))
    bins = bins.withColumn("upto", running).filter(F.col("upto") > F.col("need"))
    first = bins.groupBy("source").agg(F.min(F.struct(bin_col, "upto", "n", "need")).alias("m"))
    return first.select("source", F.col(f"m.{bin_col}").alias("cut_bin"), (F.col("m.need") - (F.col("m.upto") - F.col("m.n"))).alias("cut_need"))


def _ranked(rows: DataFrame, plan: DataFrame, cap: float, seed: str) -> DataFrame:
    """Adds whole copies, the inclusion probability of one more, and the Pareto rank as a number in (0, 1)."""
    named = plan.withColumnRenamed("source", "s")
    rows = rows.join(F.broadcast(named) if plan.count() <= MOST_BROADCAST else named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    expected = F.when(F.col("source_size") > 0, F.least(F.coalesce(F.col("level") * F.col("own_weight"), F.lit(float(cap))), F.lit(float(cap)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole")).withColumn("u", uniform(F.col("doc_id"), seed))
    # [u / (1 - u)] / [p / (1 - p)], brought to (0, 1) in the same order
    return rows.withColumn("rank", (F.col("u") * (1 - F.col("p"))) / (F.col("u") * (1 - F.col("p")) + F.col("p") * (1 - F.col("u"))))


def _extra() -> Column:
    """Whether a ranked document is before its source's cut; without a cut, all are taken once more."""
    before = (F.col("rank") < F.col("edge")) | F.coalesce(F.struct("rank", "doc_id", "size") <= F.col("end"), F.lit(False))
    return F.when(F.col("p") <= 0, False).when(F.col("edge").isNull(), True).otherwise(before)


def mix_plan(sized: DataFrame, weights: list[float], share: float, cap: float, seed: str) -> DataFrame:
    """One row for each source: its target, where its ranks are cut, and the document that is changed at the end.

    `sized` has doc_id, source, size, own_weight.
    """
    per = source_targets(sized, weights, share, cap)
    per = materialize(per.join(odds_levels(sized, per, cap), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    rows = _ranked(sized, per, cap, seed)

    certain = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("all")).select(F.col("source").alias("s"), (F.col("all") - F.col("certain")).alias("need"))
    certain = materialize(certain, "mix-certain")
    open_rows = rows.filter((F.col("p") > 0) & (F.col("size") > 0)).join(F.broadcast(certain), F.col("source").eqNullSafe(F.col("s"))) if certain.count() <= MOST_BROADCAST else rows.filter((F.col("p") > 0) & (F.col("size") > 0)).join(certain, F.col("source").eqNullSafe(F.col("s")))
    open_rows = open_rows.withColumn("bin", F.floor(F.col("rank") * BINS)).withColumn("fine", F.floor(F.col("rank") * (BINS * BINS))).select("doc_id", "source", "size", "rank", "bin", "fine", "need")
    first = materialize(_cut(open_rows, "bin"), "mix-cut").withColumnRenamed("source", "s")
    inner = open_rows.join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut_bin"))).withColumn("need", F.col("cut_need")).drop("s", "cut_bin", "cut_need")
    inner = materialize(inner, "mix-inner")
    second = _cut(inner, "fine").withColumnRenamed("source", "s")
    last = inner.join(second, F.col("source").eqNullSafe(F.col("s")) & (F.col("fine") == F.col("cut_bin"))).drop("s")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a document is taken if that brings the words nearer to the target
    last = last.withColumn("ok", before + F.col("size") / 2 <= F.col("cut_need"))
    ends = last.groupBy(F.col("source").alias("s")).agg((F.min("fine") / F.lit(float(BINS * BINS))).alias("edge"), F.max(F.when(F.col("ok"), F.struct("rank", "doc_id", "size"))).alias("end"))
    plan = materialize(per.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-ends")

    # the one document whose change brings a source nearest to its target
    rows = _ranked(sized, plan, cap, seed).withColumn("extra", _extra())
    gap = rows.groupBy(F.col("source").alias("s")).agg((F.first("target") - F.sum((F.col("whole") + F.col("extra").cast("long")) * F.col("size"))).alias("gap"))
    plan = materialize(plan.join(gap, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-gaps")
    rows = _ranked(sized, plan, cap, seed).withColumn("extra", _extra()).filter(_may_change())
    changed = rows.groupBy(F.col("source").alias("s")).agg(F.min(F.struct(_off().alias("off"), "rank", "doc_id", "size")).alias("m")).select("s", F.struct("m.rank", "m.doc_id", "m.size").alias("changed"))
    return materialize(plan.join(changed, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-plan")


def _off() -> Column:
    return F.abs(F.col("gap") - F.col("size") * F.when(F.col("extra"), -1).otherwise(1))


def _may_change() -> Column:
    return (F.col("p") > 0) & (F.col("size") > 0) & (F.col("extra") == (F.col("gap") < 0)) & (_off() < F.abs("gap"))


def with_copies(sized: DataFrame, plan: DataFrame, cap: float, seed: str) -> DataFrame:
    """Adds source_size, target and copies; other columns stay. The plan is small, so documents aren't shuffled."""
    rows = _ranked(sized, plan, cap, seed).withColumn("extra", _extra())
    changed = F.coalesce(_may_change() & (F.struct("rank", "doc_id", "size") == F.col("changed")), F.lit(False))
    return rows.withColumn("copies", F.col("whole") + (F.col("extra") != changed).cast("long"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), (F.col(weight_col).cast("double") if weight_col else F.lit(None).cast("double")).alias("own_weight"))
    return rows.withColumn("own_weight", odds(F.coalesce("own_weight", F.lit(0.0)) if weight_col else F.pow(F.col("size") + 1, F.lit(LENGTH_POWER))))


def odds(weight: Column) -> Column:
    """A weight rounded to eighths of an octave, between 2^-30 and 2^30."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.coalesce(F.round(F.when(weight > 0, F.log2(weight)) * 8) / 8, F.lit(-30.0)))))


def pareto_mix(docs: DataFrame, weights: list[float], share: float, cap: float, seed: str = "mix", **columns: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document."""
    sized = materialize(sizes(docs, **columns), "mix-sizes")
    rows = with_copies(sized, mix_plan(sized, weights, share, cap, seed), cap, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[float], share: float, cap: float, seed: str = "mix") -> DataFrame:
    """The documents themselves, each as many times as the mix takes it, with their own columns."""
    sized = materialize(sizes(docs), "mix-sizes")
    plan = mix_plan(sized, weights, share, cap, seed)
    own = docs.select(F.struct(*own_columns(docs)).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("own_weight", odds(F.pow(F.col("size") + 1, F.lit(LENGTH_POWER))))
    rows = with_copies(own, plan, cap, seed).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
