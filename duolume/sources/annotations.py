"""Annotations and images: XML and text boxes, label files, image lists, pixels, sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duolume.operators.ranks import sum_before

# Fixed values of the annotation files.
SKIPPED = ("person?",)
BBGT_HEADER = "% bbGt version=3"
IMAGE_SUFFIXES = r"(?i)\.(png|jpg|jpeg|bmp)$"


def _read_xml(spark: SparkSession, path: str, fields: str) -> DataFrame:
    box = f"array<struct<name:string,bndbox:struct<{fields}>,label:string>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(f"size struct<width:int,height:int>, object {box}").load(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), "size.width", "size.height", F.explode_outer("object").alias("o"))


def read_boxes_xywh(spark: SparkSession, path: str, relabeling: bool = False) -> DataFrame:
    """Corner-and-size boxes; uncertain persons are skipped, and relabelled objects unless they are asked for. Images without objects give a row without a box."""
    rows = _read_xml(spark, path, "x:double,y:double,w:double,h:double")
    keep = F.col("o").isNull() | (~F.col("o.name").isin(*SKIPPED) & (F.lit(relabeling) | F.col("o.label").isNull()))
    return rows.filter(keep).select("path", "width", "height", F.col("o.name").alias("name"), "o.bndbox.*")


def read_boxes_minmax(spark: SparkSession, path: str) -> DataFrame:
    """Corner-to-corner boxes of persons."""
    rows = _read_xml(spark, path, "xmin:double,ymin:double,xmax:double,ymax:double")
    return rows.filter("o.name = 'person'").select("path", "width", "height", F.col("o.name").alias("name"), "o.bndbox.*")


def parse_bbgt(lines: DataFrame) -> DataFrame:
    """(path, value) lines `name x y w h ...` -> boxes, without the header, uncertain and unpaired ones."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.col("value").startswith("%") & (F.size(p) >= 5)).withColumn("p", p)
    rows = rows.select("path", F.get("p", 0).alias("name"), *[F.get("p", i + 1).try_cast("double").alias(c) for i, c in enumerate("xywh")], F.array_contains("p", "unpaired").alias("unpaired"))
    return rows.filter(~F.col("name").isin(*SKIPPED) & ~F.col("unpaired") & F.col("h").isNotNull()).drop("unpaired")


def read_boxes_bbgt(spark: SparkSession, path: str) -> DataFrame:
    return parse_bbgt(spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value"))


def parse_labels(lines: DataFrame, scored: bool = False) -> DataFrame:
    """(path, value) lines `class cx cy w h [score]`; lines of another width or that don't parse are left out."""
    names = ["cls", "cx", "cy", "nw", "nh", *(["score"] if scored else [])]
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("p", p).filter(F.size("p") == len(names))
    return rows.select("path", F.get("p", 0).try_cast("int").alias("cls"), *[F.get("p", i).try_cast("double").alias(c) for i, c in enumerate(names) if i]).dropna()


def read_labels(spark: SparkSession, path: str, scored: bool = False) -> DataFrame:
    return parse_labels(spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value"), scored)


def write_labels(boxes: DataFrame, path: str, image: str = "image_id") -> None:
    """One folder of label lines for each image; images without boxes have none."""
    line = F.concat_ws(" ", F.col("cls").cast("string"), *[F.col(c).cast("string") for c in ("cx", "cy", "nw", "nh")])
    boxes.select(image, line.alias("value")).repartition(image).write.partitionBy(image).text(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def place_files(files: DataFrame, target_bytes: int) -> DataFrame:
    """split, path, length and the part that each file goes to: parts are filled to the target one after the other, in the order of paths.

    A part's bytes differ from the target by one file at most, the last one's apart.
    """
    placed = sum_before(files, ["split"], ["path"], "length", "__before")
    return placed.withColumn("part", F.floor(F.col("__before") / target_bytes).cast("long")).drop("__before")


def compact_labels(spark: SparkSession, path: str, out: str, split: Column | None = None, target_bytes: int = 128 << 20) -> None:
    """Many small label files as Parquet files (split, part, path, line, value) of about equal input bytes; the split is the folder above, unless given."""
    kind = F.element_at(F.split("path", "/"), -2) if split is None else split
    placed = place_files(list_files(spark, path).select("path", "length", kind.alias("split")), target_bytes).select("split", "part", F.col("path").alias("file"))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), "value")
    rows = lines.join(placed, F.col("path") == F.col("file")).drop("file").repartition("split", "part").sortWithinPartitions("split", "part", "path", "line")
    rows.write.partitionBy("split", "part").parquet(out)


def read_image_lists(spark: SparkSession, path: str, allow: list[str] | None = None, deny: list[str] | None = None, name: str = r"([^/]+)\.txt$") -> DataFrame:
    """list, image of text lists with one `set/seq/img` in each line; `name` takes the list's name from a file's path."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.regexp_extract("_metadata.file_path", name, 1).alias("list"), F.trim("value").alias("image")).filter("image <> ''")
    if allow:
        rows = rows.filter(F.col("list").isin(*allow))
    return rows.filter(~F.col("list").isin(*deny)) if deny else rows


def list_visible(files: DataFrame, dataset: str) -> DataFrame:
    """Visible images of a listing by the dataset's layout, with set, sequence and name."""
    layout = r"(set\d+)/(V\d+)/visible/([^/]+)$" if dataset == "kaist" else r"visible/(train|test)/()([^/]+)$"
    rows = files.filter(F.col("path").rlike(layout) & F.col("path").rlike(IMAGE_SUFFIXES))
    return rows.select("path", *[F.regexp_extract("path", layout, i).alias(n) for i, n in ((1, "set"), (2, "seq"), (3, "name"))])


def to_pixels(images: DataFrame, key: Column) -> DataFrame:
    """Spark `image` rows -> image_id, y, x, and b, g, r (grey images have all three equal). Values that `gaps`, if there is such a column, marks are null."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, h, w, n, data, gaps in zip(batch["image_id"], batch["height"], batch["width"], batch["nChannels"], batch["data"], batch["gaps"], strict=True):
                a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n).astype(float)
                if gaps is not None:
                    a[np.frombuffer(gaps, dtype=bool).reshape(h, w, n)] = np.nan
                y, x = np.divmod(np.arange(h * w), w)
                c = [a[:, :, min(i, n - 1)].ravel() for i in range(3)]
                yield pd.DataFrame({"image_id": name, "y": y, "x": x, "b": c[0], "g": c[1], "r": c[2]})

    gaps = F.col("gaps") if "gaps" in images.columns else F.lit(None).cast("binary").alias("gaps")
    rows = images.select(key.alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data", gaps)
    return rows.mapInPandas(unpack, "image_id string, y long, x long, b double, g double, r double")


def pack_images(px: DataFrame, channels: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """image_id, image, gaps: pixels (whole numbers 0..255) as rows of Spark's image source, the opposite of `to_pixels`. A task needs room for one image.

    An image has no mark for a missing value: it is 0 there, and `gaps` has a byte of 1 for it (null: nothing is missing).
    """
    at = lambda c: F.lpad(F.hex(F.coalesce(F.col(c).cast("int"), F.lit(0))), 2, "0")
    hole = lambda c: F.when(F.col(c).isNull(), F.lit("01")).otherwise("00")
    none = F.bool_and(F.concat(*channels).isNotNull())
    rows = px.groupBy("image_id").agg(none.alias("whole"), F.array_sort(F.collect_list(F.struct("y", "x", F.concat(*map(at, channels)).alias("v"), F.concat(*map(hole, channels)).alias("g")))).alias("p"), (F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
    data = F.unhex(F.array_join(F.transform("p", lambda p: p["v"]), ""))
    gaps = F.when(~F.col("whole"), F.unhex(F.array_join(F.transform("p", lambda p: p["g"]), "")))
    n = len(channels)
    return rows.select("image_id", F.struct(F.col("image_id").cast("string").alias("origin"), "height", "width", F.lit(n).alias("nChannels"), F.lit(16 if n == 3 else 0).alias("mode"), data.alias("data")).alias("image"), gaps.alias("gaps"))


def pair_images(visible: DataFrame, thermal: DataFrame) -> DataFrame:
    """Pixels that both images have: the common crop."""
    return visible.join(thermal.select("image_id", "y", "x", F.col("b").alias("t")), ["image_id", "y", "x"])


def write_table(df: DataFrame, path: str, kind: str = "csv", digits: int = 6) -> None:
    """CSV with a header, empty cells for missing values and six significant digits; or JSON with null for what isn't finite."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    clean = {c: F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(F.col(c)) for c in numbers}
    df = df.withColumns(clean)
    if kind == "csv":
        df = df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}g", F.col(c))) for c in numbers})
        df.write.option("header", "true").option("emptyValue", "").option("nullValue", "").csv(path)
    else:
        df.write.option("ignoreNullFields", "false").json(path)


def project_columns(df: DataFrame, columns: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """The named columns that exist, in that order (all, if none does), renamed."""
    keep = [c for c in columns if c in df.columns] or df.columns
    return df.select(*[f"`{c}`" for c in keep]).withColumnsRenamed(rename or {})


def translate(df: DataFrame, words: DataFrame, column: str, lang: str) -> DataFrame:
    """A column's labels in a language, by a (label, lang, text) table; unknown ones stay."""
    own = words.filter(F.col("lang") == lang).select(F.col("label").alias(column), F.col("text").alias("__t"))
    return df.join(own, column, "left").withColumn(column, F.coalesce("__t", column)).select(df.columns)
