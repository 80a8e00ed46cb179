"""What is kept in files: stored scores, and tables written to label, XML, list, CSV and image files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolume.operators import calibration as C
from duolume.operators import pixels as P
from duolume.operators.incremental import fingerprint
from duolume.operators.stored import new_folder
from duolume.sources import annotations as A
from duolume.sources import archives as R

from .run_queries import rounded
from .score_queries import REG
from .views import BOXES, PIXELS, boxes, pixels, placed, table

STORED_METHODS = ("rgbt", "rgbt_v2", "visible")


def a18(spark, d):
    """Scores of three methods in three runs over one store: half of the images, all images, all images after one method changed.

    `batch` is the run that computed a row.
    """
    px = placed(pixels(spark, d))
    store = C.score_store(spark, new_folder(spark, "score-store"))
    images = px.select("image_id", F.lit(1.0).alias("visible_time"), F.lit(2.0).alias("thermal_time")).distinct()
    marks = {m: fingerprint(P.FUSIONS[m]) for m in STORED_METHODS}
    for part, now in ((images.filter("image_id % 2 = 0"), marks), (images, marks), (images, marks | {"rgbt_v2": "changed"})):
        wanted = C.wanted_scores(part, now, "none")
        got = C.incremental_scores(store, px, wanted, ["reg"], average_orders=False)
    return rounded(store.rows(batch=True).join(got.select("cache_key").distinct(), "cache_key", "left_semi").select("method", "image_id", "batch", "value"), "value", digits=5)


A18 = f"""WITH scored AS ({REG}) SELECT method, image_id, CASE WHEN method = 'rgbt_v2' THEN 3 WHEN image_id % 2 = 0 THEN 1 ELSE 2 END::INT AS batch, value FROM scored WHERE method IN ('rgbt', 'rgbt_v2', 'visible')"""

# ---- written as files and read back; folders stand for a few files each, and all rows of the tables go through them

_FOLDER = lambda name: F.regexp_extract("path", rf"/{name}=([^/]+)/", 1)


def a4(spark, d):
    """Events as epoch logs with padded names and numbers, a log for each run."""
    path = new_folder(spark, "logs")
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("run"), F.lpad(F.col("event_id").cast("string"), 9, " ").alias("     epoch"), F.lpad(F.col("value").cast("string"), 24, " ").alias("   train/box_loss"), F.lpad((F.col("user_id") / 2).cast("string"), 24, " ").alias(" metrics/mAP50(B)"))
    e.repartition("run").write.partitionBy("run").option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(path)
    rows = R.read_epoch_logs(spark, path, "epoch int, box_loss double, map50 double")
    return rounded(rows.select(_FOLDER("run").cast("long").alias("run"), "epoch", "box_loss", "map50"), "box_loss", "map50")


A4 = "SELECT user_id % 20 AS run, event_id::INT AS epoch, round(value, 6) AS box_loss, round(user_id / 2, 6) AS map50 FROM events"


def a10(spark, d):
    """Pixels as stored images of three channels, read back as pixels. An image has no pixel without a place."""
    path = new_folder(spark, "images")
    A.pack_images(pixels(spark, d).dropna(subset=["y", "x"])).write.parquet(path)
    back = A.to_pixels(spark.read.parquet(path), F.col("image.origin"))
    return back.select(F.col("image_id").cast("long").alias("image_id"), "y", "x", "b", "g", "r")


A10 = f"WITH {PIXELS} SELECT image_id, y, x, b, g, r FROM px"


def c6(spark, d):
    """Visible images and thermal ones that lack a row and two columns, both stored; their common pixels."""
    path, px = new_folder(spark, "pairs"), pixels(spark, d).dropna(subset=["y", "x"])
    A.pack_images(px).write.parquet(f"{path}/visible")
    A.pack_images(px.filter("y < 7 and x < 6"), ("t",)).write.parquet(f"{path}/lwir")
    visible, thermal = (A.to_pixels(spark.read.parquet(f"{path}/{x}"), F.col("image.origin")) for x in ("visible", "lwir"))
    return A.pair_images(visible, thermal).select(F.col("image_id").cast("long").alias("image_id"), "y", "x", "b", "g", "r", "t")


C6 = f"WITH {PIXELS} SELECT image_id, y, x, b, g, r, t FROM px WHERE y < 7 AND x < 6"


def a11(spark, d):
    """Line items as image lists, a folder for each list; one list is left out by name."""
    path = new_folder(spark, "lists")
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("day"), F.col("l_linenumber")).alias("list"), F.concat(F.lit("set"), F.col("l_suppkey") % 12, F.lit("/V"), F.col("l_partkey"), F.lit("/I"), "l_orderkey", F.lit("  ")).alias("value"))
    lines.repartition("list").write.partitionBy("list").text(path)
    return A.read_image_lists(spark, path, deny=["day3"], name=r"/list=([^/]+)/")


A11 = "SELECT 'day' || l_linenumber AS list, 'set' || (l_suppkey % 12) || '/V' || l_partkey || '/I' || l_orderkey AS image FROM lineitem WHERE l_linenumber <> 3"


def _annotations(spark, d, box):
    """Boxes as XML annotations of their images; a folder's images are written where they were grouped, so no task has a whole folder."""
    path = new_folder(spark, "xml")
    name = F.when(F.col("obj_id") == 2, F.lit("person?")).otherwise(F.col("name"))
    one = F.struct(name.alias("name"), F.struct(*box).alias("bndbox"), F.when(F.col("obj_id") == 3, F.lit("relabelled")).alias("label"))
    images = boxes(spark, d).groupBy("image_id").agg(F.collect_list(one).alias("object"))
    images.select((F.col("image_id") % 16).alias("folder"), F.struct(F.lit(640).alias("width"), F.lit(512).alias("height")).alias("size"), "object").write.partitionBy("folder").format("xml").option("rowTag", "annotation").save(path)
    return path


def a12(spark, d):
    path = _annotations(spark, d, [F.col(c) for c in "xywh"])
    rows = A.read_boxes_xywh(spark, path).filter("name is not null")
    return rows.select(_FOLDER("folder").cast("long").alias("folder"), "width", "height", "name", "x", "y", "w", "h")


A12 = f"WITH {BOXES} SELECT image_id % 16 AS folder, 640 AS width, 512 AS height, name, x, y, w, h FROM boxes WHERE obj_id NOT IN (2, 3)"


def a13(spark, d):
    path = _annotations(spark, d, [F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + F.col("w")).alias("xmax"), (F.col("y") + F.col("h")).alias("ymax")])
    return A.read_boxes_minmax(spark, path).select(_FOLDER("folder").cast("long").alias("folder"), "width", "height", "name", "xmin", "ymin", "xmax", "ymax")


A13 = f"WITH {BOXES} SELECT image_id % 16 AS folder, 640 AS width, 512 AS height, name, x AS xmin, y AS ymin, x + w AS xmax, y + h AS ymax FROM boxes WHERE obj_id <> 2 AND name = 'person'"


def a16(spark, d):
    """Labels of all line items, an image for each supplier."""
    path = new_folder(spark, "labels")
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 200).alias("image"), F.col("l_linenumber").alias("cls"), *[(F.col(c) / 64).alias(n) for c, n in (("l_quantity", "cx"), ("l_linenumber", "cy"))], (F.col("l_partkey") % 64 / 64).alias("nw"), F.lit(0.5).alias("nh"))
    A.write_labels(rows, path, "image")
    return A.read_labels(spark, path).select(_FOLDER("image").cast("long").alias("image"), F.col("cls").cast("long").alias("cls"), "cx", "cy", "nw", "nh")


A16 = "SELECT l_suppkey % 200 AS image, l_linenumber::BIGINT AS cls, l_quantity / 64 AS cx, l_linenumber / 64 AS cy, l_partkey % 64 / 64 AS nw, 0.5::DOUBLE AS nh FROM lineitem"


def a17(spark, d):
    """Customers as CSV and as JSON, with numbers that aren't finite, read back."""
    path, bal = new_folder(spark, "tables"), F.col("c_acctbal").cast("double")
    odd = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 7 == 0, F.lit(float("-inf"))).when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(bal)
    rows = table(spark, d, "customer").select("c_custkey", "c_name", odd.alias("bal"))
    for kind in ("csv", "json"):
        A.write_table(rows, f"{path}/{kind}", kind)
    schema = "c_custkey long, c_name string, bal double"
    back = [spark.read.schema(schema).option("header", "true").csv(f"{path}/csv"), spark.read.schema(schema).json(f"{path}/json")]
    return back[0].withColumn("kind", F.lit("csv")).unionByName(back[1].withColumn("kind", F.lit("json")))


A17 = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_acctbal::DOUBLE END AS bal, unnest(['csv', 'json']) AS kind FROM customer"

PART_BYTES = 40_000


def a19(spark, d):
    """Line items as small label files, an image for each supplier; compacted to parts of equal bytes. Lines and part of each file."""
    path, out = new_folder(spark, "small"), new_folder(spark, "compact")
    line = F.concat_ws(" ", "l_linenumber", "l_partkey", "l_orderkey")
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 3 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("I"), F.col("l_suppkey") % 300).alias("image"), line.alias("value"))
    rows.repartition("split", "image").write.partitionBy("split", "image").text(path)
    A.compact_labels(spark, path, out, F.regexp_extract("path", "/split=([^/]+)/", 1), PART_BYTES)
    back = spark.read.schema("split string, part long, path string, line long, value string").parquet(out)
    return back.groupBy("split", _FOLDER("image").alias("image"), "part").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


A19 = f"""WITH f AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, 'I' || (l_suppkey % 300) AS image, count(*) AS lines, sum(length(l_linenumber || ' ' || l_partkey || ' ' || l_orderkey)) AS chars FROM lineitem GROUP BY ALL)
SELECT split, image, floor(coalesce(sum(chars + lines) OVER (PARTITION BY split ORDER BY image || '/' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {PART_BYTES})::BIGINT AS part, lines, chars::BIGINT AS chars FROM f"""

PLANS = {
    "a18_incremental_scores": (a18, A18), "a4_epoch_logs": (a4, A4), "a10_images": (a10, A10), "c6_pairs": (c6, C6), "a11_image_lists": (a11, A11),
    "a12_boxes_xywh": (a12, A12), "a13_boxes_minmax": (a13, A13), "a16_labels": (a16, A16), "a17_tables": (a17, A17), "a19_compact": (a19, A19),
}
