"""Boxes over line items, pair checks over documents and labels, samples over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from duolume.functions import boxes as B
from duolume.operators import boxes as O
from duolume.operators import sampling as S

from .run_queries import rounded
from .views import BOXES, boxes, table


def b14(spark, d):
    return B.remap_classes(boxes(spark, d)).groupBy("image_id").agg(F.count("*").alias("n"))


def b15(spark, d):
    return rounded(B.normalize_boxes(boxes(spark, d)).select("image_id", "obj_id", "part_id", "cx", "cy", "nw", "nh"), "cx", "cy", "nw", "nh", digits=9)


def b16(spark, d):
    back = B.denormalize_boxes(B.normalize_boxes(boxes(spark, d)))
    return back.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in ("x2", "y2")])


def b17(spark, d):
    return B.drop_border_boxes(boxes(spark, d)).groupBy("name").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def b18(spark, d):
    t = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("image_id"), F.lit(1.1).alias("a"), F.lit(0.0).alias("b"), (F.col("o_custkey") % 20 - 10).cast("double").alias("c"), F.lit(0.0).alias("d"), F.lit(0.9).alias("e"), F.lit(5.0).alias("f"))
    out = B.transform_boxes(boxes(spark, d), t, "image_id", (20, 10, 600, 480))
    return rounded(out.groupBy("image_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xywh"]), *"xywh")


B18 = f"""WITH {BOXES}, t AS (SELECT o_orderkey AS image_id, 1.1::DOUBLE AS a, (o_custkey % 20 - 10)::DOUBLE AS c, 0.9::DOUBLE AS e, 5.0::DOUBLE AS f FROM orders WHERE o_orderkey % 2 = 0),
j AS (SELECT image_id, x, y, w, h, coalesce(a, 1) AS a, coalesce(c, 0) AS c, coalesce(e, 1) AS e, coalesce(f, 0) AS f FROM boxes LEFT JOIN t USING (image_id)),
k AS (SELECT image_id, greatest(1, least(599, a * x + c - 20)) AS x1, greatest(1, least(479, e * y + f - 10)) AS y1, greatest(1, least(599, a * (x + w) + c - 20)) AS x2, greatest(1, least(479, e * (y + h) + f - 10)) AS y2 FROM j)
SELECT image_id, count(*) AS n, round(sum(x1), 6) AS x, round(sum(y1), 6) AS y, round(sum(x2 - x1), 6) AS w, round(sum(y2 - y1), 6) AS h FROM k WHERE x2 > x1 AND y2 > y1 GROUP BY image_id"""


def b19(spark, d):
    out = B.mosaic_boxes(boxes(spark, d), 320, 256)
    return out.groupBy("image_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


B19 = f"""WITH {BOXES}, c AS (SELECT *, unnest([0.0, 320.0, 0.0, 320.0])::DOUBLE AS dx, unnest([0.0, 0.0, 256.0, 256.0])::DOUBLE AS dy FROM boxes),
k AS (SELECT image_id, greatest(dx, least(dx + 320, 640, x + dx)) AS x1, greatest(dy, least(dy + 256, 512, y + dy)) AS y1, greatest(dx, least(dx + 320, 640, x + w + dx)) AS x2, greatest(dy, least(dy + 256, 512, y + h + dy)) AS y2 FROM c)
SELECT image_id, count(*) AS n, sum(x1) AS x1, sum(y1) AS y1, sum(x2) AS x2, sum(y2) AS y2 FROM k WHERE x2 > x1 AND y2 > y1 GROUP BY image_id"""


def affine(spark, d):
    return table(spark, d, "part").select("p_partkey", (1 + F.col("p_size") / 1000).alias("a"), (F.col("p_size") / 500).alias("b"), (F.col("p_retailprice") / 100).alias("c"), (F.col("p_size") / -400).alias("d"), (1 - F.col("p_size") / 2000).alias("e"), (F.col("p_retailprice") / 200).alias("f"))


def b20(spark, d):
    return rounded(B.invert_affine(B.scale_affine(affine(spark, d))), *"abcdef")


B20 = """WITH m AS (SELECT p_partkey, 1 + p_size / 1000 AS a, p_size / 500 AS b, p_retailprice / 100 AS c, p_size / -400 AS d, 1 - p_size / 2000 AS e, p_retailprice / 200 AS f FROM part),
s AS (SELECT p_partkey, 1 + (a - 1) * 5 AS a, b * 5 AS b, c * 5 AS c, d * 5 AS d, 1 + (e - 1) * 5 AS e, f * 5 AS f FROM m), t AS (SELECT *, a * e - b * d AS det FROM s)
SELECT p_partkey, round(e / det, 6) AS a, round(-b / det, 6) AS b, round((b * f - e * c) / det, 6) AS c, round(-d / det, 6) AS d, round(a / det, 6) AS e, round((d * c - a * f) / det, 6) AS f FROM t"""


def crops(spark, d):
    moves = table(spark, d, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 21 - 6).cast("double").alias("tx"), (F.col("o_custkey") % 13 - 4).cast("double").alias("ty"))
    return B.crop_window(moves)


CROPS = f"""moves AS (SELECT o_orderkey AS image_id, (o_custkey % 21 - 6)::DOUBLE AS tx, (o_custkey % 13 - 4)::DOUBLE AS ty FROM orders WHERE o_orderkey % 3 > 0),
uv AS (SELECT image_id, 2 * ((greatest({B.LIMITS_X[0]}, least({B.LIMITS_X[1]}, tx)) - {B.LIMITS_X[0]}) / ({B.LIMITS_X[1] - B.LIMITS_X[0]!r}::DOUBLE)) - 1 AS u, 2 * ((greatest({B.LIMITS_Y[0]}, least({B.LIMITS_Y[1]}, ty)) - {B.LIMITS_Y[0]}) / ({B.LIMITS_Y[1] - B.LIMITS_Y[0]!r}::DOUBLE)) - 1 AS v FROM moves),
sz AS (SELECT *, trunc(640 * (1 - abs(0.35::DOUBLE * u)))::INT AS crop_w, trunc(512 * (1 - abs(0.35::DOUBLE * v)))::INT AS crop_h FROM uv),
crops AS (SELECT image_id, crop_w, crop_h, trunc(greatest(crop_w / 2, least(640 - crop_w / 2, 320 + (640 - crop_w) / 2 * u)) - crop_w / 2)::INT AS crop_x, trunc(greatest(crop_h / 2, least(512 - crop_h / 2, 256 + (640 - crop_w) / 2 * v)) - crop_h / 2)::INT AS crop_y FROM sz)"""


def b21(spark, d):
    return crops(spark, d).select("image_id", "crop_x", "crop_y", "crop_w", "crop_h")


def b22(spark, d):
    out = B.spill_boxes(boxes(spark, d).join(crops(spark, d), "image_id", "left"))
    return out.groupBy("kind").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xywh"])


B22 = f"""WITH {BOXES}, {CROPS}, j AS (SELECT boxes.*, crop_x AS cx, crop_y AS cy, crop_w AS cw, crop_h AS ch FROM boxes LEFT JOIN crops USING (image_id)),
i AS (SELECT *, greatest(0.0, least(cw, x - cx)) AS nx, greatest(0.0, least(ch, y - cy)) AS ny FROM j), k AS (SELECT *, least(cw - nx, w) AS nw, least(ch - ny, h) AS nh FROM i),
a AS (SELECT 'whole' AS kind, x, y, w, h FROM k WHERE cx IS NULL UNION ALL SELECT 'inside', nx + cx, ny + cy, nw, nh FROM k WHERE nw > 0 AND nh > 0 AND cx IS NOT NULL
  UNION ALL SELECT 'left', x + 640, y, least(w, cx - x), h FROM k WHERE x < cx UNION ALL SELECT 'right', x - cw, y, least(w, x + w - cx - cw), h FROM k WHERE x + w > cx + cw
  UNION ALL SELECT 'top', x, y + 512, w, least(h, cy - y) FROM k WHERE y < cy UNION ALL SELECT 'bottom', x, y - ch, w, least(h, y + h - cy - ch) FROM k WHERE y + h > cy + ch)
SELECT kind, count(*) AS n, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y, sum(w)::DOUBLE AS w, sum(h)::DOUBLE AS h FROM a GROUP BY kind"""


def c7(spark, d):
    return O.check_pairs(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id")), "doc_id")


def c8(spark, d):
    return O.backgrounds(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id", F.col("quality") == 0).groupBy("lang").agg(F.count("*").alias("n"))


def c9(spark, d):
    b = boxes(spark, d).withColumn("w", F.col("w") * 4).withColumn("h", F.col("h") * 4).withColumn("name", F.lit("person")).withColumn("det", F.concat_ws("-", "obj_id", "part_id", "x", "y", "w"))
    found = O.match_detections(b.filter("obj_id <= 3"), b.filter("obj_id > 3"), "image_id", "det", 0.2, 0.5)
    return found.groupBy("matched").agg(F.count("*").alias("n"), F.round(F.sum("iou"), 4).alias("iou"))


C9 = f"""WITH {BOXES}, b AS (SELECT image_id, obj_id, x, y, w * 4 AS w, h * 4 AS h, score, row_number() OVER () AS k FROM boxes),
p AS (SELECT d.k, greatest(0, least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x)) * greatest(0, least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y)) AS common, d.w * d.h + g.w * g.h AS total FROM b d JOIN b g ON d.image_id = g.image_id AND d.obj_id > 3 AND g.obj_id <= 3),
m AS (SELECT k, max(common / (total - common)) AS iou FROM p GROUP BY k)
SELECT coalesce(iou, 0) > 0.2 AND score > 0.5 AS matched, count(*) AS n, round(sum(coalesce(iou, 0)), 4) AS iou FROM b LEFT JOIN m USING (k) WHERE obj_id > 3 GROUP BY 1"""


def c12(spark, d):
    return O.duplicate_files(table(spark, d, "documents"), "doc_id", "text")


C12 = """WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT first, doc_id AS other, copies FROM documents JOIN f ON sha256(text) = h WHERE doc_id <> first"""


def c13(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("option"), F.col("p_partkey").alias("place"), F.col("p_brand").alias("version"), F.col("p_size").alias("extension"))
    return O.equivalent_option(p, p.filter("option % 5 = 0").select("option"))


C13 = """SELECT a.p_partkey AS option, min(b.p_partkey) AS equivalent FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey AND b.p_partkey % 5 = 0 GROUP BY a.p_partkey"""


def b35(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("option"), F.when(F.col("p_size") % 3 == 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>")).alias("expands_to"))
    return O.expand_options(p)


B35 = """WITH e AS (SELECT p_partkey AS place, unnest(CASE WHEN p_size % 3 = 0 THEN string_split(p_name, ' ') ELSE [p_name] END) AS option, unnest(range(CASE WHEN p_size % 3 = 0 THEN len(string_split(p_name, ' ')) ELSE 1 END))::INT AS i FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY option ORDER BY place, i) AS k FROM e) SELECT option, place, i FROM k WHERE k = 1"""


def d27(spark, d):
    images = table(spark, d, "documents").select("doc_id", "lang", "source", F.substring("text", 1, 12).alias("name"))
    return O.dataset_counts(images, table(spark, d, "labels"), ["source", "lang"], "doc_id", split="source", name="name")


D27 = """WITH p AS (SELECT doc_id, count(*) AS rows FROM labels GROUP BY doc_id), n AS (SELECT DISTINCT lang, source, substr(text, 1, 12) AS name FROM documents),
f AS (SELECT lang, name, min(source) AS source FROM n GROUP BY ALL), o AS (SELECT lang, source, count(*) AS own FROM n GROUP BY ALL), w AS (SELECT lang, source, count(*) AS fresh FROM f GROUP BY ALL),
r AS (SELECT o.lang, o.source, round(sum(coalesce(fresh, 0)) OVER k / sum(own) OVER k, 6) AS unique_ratio FROM o LEFT JOIN w ON o.lang IS NOT DISTINCT FROM w.lang AND o.source IS NOT DISTINCT FROM w.source WINDOW k AS (PARTITION BY o.lang ORDER BY o.source NULLS FIRST)),
c AS (SELECT source, lang, count(*) AS images, coalesce(sum(rows), 0)::BIGINT AS labels, count(*) FILTER (rows IS NULL) AS backgrounds, round(100 * count(*) FILTER (rows IS NULL) / count(*), 3) AS b_percent FROM documents LEFT JOIN p USING (doc_id) GROUP BY ALL)
SELECT c.*, unique_ratio FROM c LEFT JOIN r ON c.lang IS NOT DISTINCT FROM r.lang AND c.source IS NOT DISTINCT FROM r.source"""


def d28(spark, d):
    return O.set_counts(table(spark, d, "documents"), "lang", "source")


def e14(spark, d):
    lists = table(spark, d, "lineitem").select(F.col("l_partkey").alias("image"), F.col("l_linenumber").alias("place"), F.concat(F.lit("split"), F.col("l_linenumber")).alias("split")).distinct()
    return O.owner_split(lists, "image", "place", "split").groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("is_reference").cast("int")).alias("refs"))


E14 = """WITH l AS (SELECT DISTINCT l_partkey AS image, l_linenumber AS place FROM lineitem), o AS (SELECT *, min(place) OVER (PARTITION BY image) AS own FROM l)
SELECT 'split' || place AS split, count(*) AS n, sum((place <> own)::INT)::BIGINT AS refs FROM o GROUP BY place"""


def e8(spark, d):
    return O.split_contiguous(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 0.7).groupBy("o_orderpriority", "part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


E8 = """WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM r GROUP BY ALL"""


def f1(spark, d):
    return S.stratified_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 1000, "s1")


F1 = """WITH c AS (SELECT o_orderpriority, count(*) AS rows FROM orders GROUP BY 1), t AS (SELECT *, rows * 1000 / sum(rows) OVER () AS ideal FROM c), b AS (SELECT *, floor(ideal) AS base, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, o_orderpriority) AS place, 1000 - sum(floor(ideal)) OVER () AS rest FROM t),
q AS (SELECT o_orderpriority, base + (place <= rest)::INT AS quota FROM b), r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('s1|' || o_orderkey), o_orderkey) AS k FROM orders)
SELECT o_orderkey, o_orderpriority FROM r JOIN q USING (o_orderpriority) WHERE k <= quota"""


def f2(spark, d):
    return S.split_calibration(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "s2", ratio=0.1)


F2 = """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('s2|' || o_orderkey), o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN k <= round(n * 0.1) THEN 'calibration' ELSE 'evaluation' END AS part FROM r"""


def f3(spark, d):
    return S.cap(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100)


def f5(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg((F.max("l_quantity") - F.avg("l_quantity")).alias("shift"))
    return rounded(S.top_shift(rows.withColumn("shift", F.round("shift", 6)), "shift", "l_partkey"), "shift")


def a18(spark, d):
    return S.incremental(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), ["doc_id"]).select("doc_id", "cache_key")


PLANS = {
    "b14_remap_classes": (b14, f"WITH {BOXES} SELECT image_id, count(*) AS n FROM boxes WHERE name IN ('person', 'cyclist') GROUP BY image_id"),
    "b15_normalize_boxes": (b15, f"WITH {BOXES} SELECT image_id, obj_id, part_id, round((x + w / 2) / 640, 9) AS cx, round((y + h / 2) / 512, 9) AS cy, round(w / 640, 9) AS nw, round(h / 512, 9) AS nh FROM boxes"),
    "b16_denormalize_boxes": (b16, f"WITH {BOXES} SELECT image_id, sum(trunc(((x + w / 2) / 640 + w / 640 / 2) * 640))::BIGINT AS x2, sum(trunc(((y + h / 2) / 512 + h / 512 / 2) * 512))::BIGINT AS y2 FROM boxes GROUP BY image_id"),
    "b17_border_boxes": (b17, f"WITH {BOXES} SELECT name, count(*) AS n, sum(w) AS w FROM boxes WHERE x - w / 2 > 3 AND y - h / 2 > 3 AND x + w / 2 < 637 AND y + h / 2 < 509 GROUP BY name"),
    "b18_transform_boxes": (b18, B18), "b19_mosaic_boxes": (b19, B19), "b20_affine": (b20, B20), "b21_crop_window": (b21, f"WITH {CROPS} SELECT image_id, crop_x, crop_y, crop_w, crop_h FROM crops"), "b22_spill_boxes": (b22, B22), "b35_expand_options": (b35, B35),
    "c7_check_pairs": (c7, "WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id * 2 AS doc_id FROM labels) SELECT doc_id, 'label_without_image' AS problem FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION ALL SELECT doc_id, 'image_without_label' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)"),
    "c8_backgrounds": (c8, "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 0) GROUP BY lang"),
    "c9_match_detections": (c9, C9), "c12_duplicate_files": (c12, C12), "c13_equivalent_option": (c13, C13),
    "d27_dataset_counts": (d27, D27),
    "d28_set_counts": (d28, "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)"),
    "e14_owner_split": (e14, E14), "e8_split_contiguous": (e8, E8), "f1_stratified_sample": (f1, F1), "f2_split_calibration": (f2, F2),
    "f3_subsample": (lambda spark, d: S.subsample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 0.03),
        "SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice, o_orderkey) <= greatest(1, floor(0.03 * count(*) OVER ()))"),
    "f3_cap": (f3, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100"),
    "f5_top_shift": (f5, "WITH s AS (SELECT l_partkey, round(max(l_quantity) - avg(l_quantity), 6) AS shift FROM lineitem GROUP BY 1) SELECT * FROM s ORDER BY abs(shift) DESC, l_partkey LIMIT 10"),
    "a18_incremental": (a18, "SELECT doc_id, sha256(doc_id::VARCHAR) AS cache_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
}
