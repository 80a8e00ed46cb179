"""Labels and images: pair checks, matching, counts, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import global_rank


def check_pairs(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Labels without an image (an error) and images without a label (allowed)."""
    a, b = images.select(key).distinct(), labels.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("problem", F.lit("label_without_image")).unionByName(a.join(b, key, "left_anti").withColumn("problem", F.lit("image_without_label")))


def backgrounds(images: DataFrame, labels: DataFrame, key: str, empty: Column) -> DataFrame:
    """Images without a label, or with empty ones only."""
    return images.join(labels.filter(~empty).select(key), key, "left_anti")


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes given as structs of x, y, w, h."""
    x, y, w, h = ({s: F.col(f"{s}.{c}") for s in (a, b)} for c in "xywh")
    over = lambda p, s: F.greatest(F.lit(0.0), F.least(p[a] + s[a], p[b] + s[b]) - F.greatest(p[a], p[b]))
    both = over(x, w) * over(y, h)
    union = w[a] * h[a] + w[b] * h[b] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def match_detections(truth: DataFrame, found: DataFrame, image: str, det_id: str, least_iou: float = 0.5, least_score: float = 0.5) -> DataFrame:
    """Detections with `matched`: some box of the same image and class overlaps enough, and the score is high enough."""
    boxed = lambda df, name: F.struct(*[F.col(c) for c in "xywh"]).alias(name)
    pairs = found.select(image, "name", det_id, boxed(found, "d")).join(truth.select(image, "name", boxed(truth, "g")), [image, "name"])
    best = pairs.groupBy(image, det_id).agg(F.max(iou("d", "g")).alias("iou"))
    return found.join(best, [image, det_id], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0))).withColumn("matched", (F.col("iou") > least_iou) & (F.col("score") > least_score))


def distinct_ratio(images: DataFrame, keys: list[str], split: str, name: str) -> DataFrame:
    """Distinct names over the sum of each split's distinct names, cumulated over the splits in their order.

    A name counts as new in its least split; new names are summed from split to split, so no set of names is held.
    """
    names = images.select(*keys, split, name).distinct()
    new = names.groupBy(*keys, name).agg(F.min(split).alias(split)).select(*keys, split, F.lit(0).alias("own"), F.lit(1).alias("new"))
    per = names.select(*keys, split, F.lit(1).alias("own"), F.lit(0).alias("new")).unionByName(new).groupBy(*keys, split).agg(F.sum("own").alias("own"), F.sum("new").alias("new"))
    so_far = Window.partitionBy(*keys).orderBy(split)
    return per.select(*keys, split, F.round(F.sum("new").over(so_far) / F.sum("own").over(so_far), 6).alias("unique_ratio"))


def dataset_counts(images: DataFrame, labels: DataFrame, keys: list[str], image: str, split: str | None = None, name: str | None = None) -> DataFrame:
    """Images, label rows, backgrounds and their share for each split and condition; with a split (one of the keys) and a name, the ratio of distinct names up to that split."""
    if split:
        ratio = distinct_ratio(images, [k for k in keys if k != split], split, name).select(*[F.col(k).alias(f"__{k}") for k in keys], "unique_ratio")
        return dataset_counts(images, labels, keys, image).join(ratio, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])
    per = labels.groupBy(image).agg(F.count("*").alias("rows"))
    joined = images.join(per, image, "left")
    out = joined.groupBy(*keys).agg(F.count("*").alias("images"), F.coalesce(F.sum("rows"), F.lit(0)).alias("labels"), F.sum(F.col("rows").isNull().cast("long")).alias("backgrounds"))
    return out.withColumn("b_percent", F.round(100 * F.col("backgrounds") / F.col("images"), 3))


def set_counts(images: DataFrame, condition: str, image_set: str) -> DataFrame:
    """Images of each set, of each condition, and of all."""
    return images.rollup(condition, image_set).agg(F.count("*").alias("n"))


def owner_split(lists: DataFrame, image: str, order: str, split: str) -> DataFrame:
    """Each image's first split owns it; later ones refer to it."""
    owner = F.min(F.struct(order, split)).over(Window.partitionBy(image))[split]
    return lists.withColumn("owner", owner).withColumn("is_reference", F.col(split) != F.col("owner"))


def split_contiguous(df: DataFrame, keys: list[str], order: list[str], share: float) -> DataFrame:
    """The first rows of a fixed order are train (rows 0 to floor(n * share), included), the rest test."""
    ranked = global_rank(df, keys, order, "__rank", "__rows")
    return ranked.withColumn("part", F.when(F.col("__rank") - 1 <= F.floor(F.col("__rows") * F.lit(share)), F.lit("train")).otherwise("test")).drop("__rank", "__rows")


def duplicate_files(files: DataFrame, path: str, content: str) -> DataFrame:
    """Pairs (first, other) of equal contents: each file against the first of its group, so groups give no squares of pairs."""
    keyed = files.select(path, F.sha2(content, 256).alias("hash"), F.length(content).alias("size"))
    first = keyed.groupBy("hash", "size").agg(F.min(path).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    return keyed.join(first, ["hash", "size"]).filter(F.col(path) != F.col("first")).select(F.col("first"), F.col(path).alias("other"), "copies")


def equivalent_option(options: DataFrame, done: DataFrame) -> DataFrame:
    """For each option, the first other one in registry order of equal version and extension that is done.

    That is its group's first done option, or the second where it is the first itself: options meet two of a group, not all.
    """
    group = ["version", "extension"]
    other = options.join(done, "option", "left_semi").select(*group, F.struct("place", "option").alias("m"))
    first = other.groupBy(*group).agg(F.min("m").alias("first"))
    second = other.join(first, group).filter(F.col("m.option") != F.col("first.option")).groupBy(*group).agg(F.min("m").alias("second"))
    pairs = options.join(first.join(second, group, "left"), group)
    best = pairs.select("option", F.when(F.col("first.option") != F.col("option"), F.col("first")).otherwise(F.col("second")).alias("m"))
    return best.groupBy("option").agg(F.min("m").alias("m")).filter("m is not null").select("option", F.col("m.option").alias("equivalent"))


def expand_options(options: DataFrame) -> DataFrame:
    """Options with those that meta-options stand for, without repeats, in the order of first use."""
    many = options.select("place", F.posexplode(F.when(F.size("expands_to") > 0, F.col("expands_to")).otherwise(F.array("option"))).alias("i", "option"))
    return many.groupBy("option").agg(F.min(F.struct("place", "i")).alias("first")).select("option", F.col("first.place").alias("place"), F.col("first.i").alias("i"))
