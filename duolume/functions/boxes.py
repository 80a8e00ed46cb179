"""Bounding boxes as column expressions: normalise, transform, replicate, crop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT = 640, 512
EPS = 1.0
#: The range of measured translations between the two cameras.
LIMITS_X = (-4.818207761938845, 12.099579119016507)
LIMITS_Y = (-2.318536707291676, 6.618311282898231)
MOST_CROP = 0.35


def remap_classes(df: DataFrame, people_too: bool = False, keep: tuple[str, ...] = ("person",)) -> DataFrame:
    """Cyclists (and people) become persons; other classes are dropped."""
    name = F.when(F.col("name").isin("cyclist", *(["people"] if people_too else [])), F.lit("person")).otherwise(F.col("name"))
    return df.withColumn("name", name).filter(F.col("name").isin(*keep))


def normalize_boxes(df: DataFrame, width: Column | int = WIDTH, height: Column | int = HEIGHT) -> DataFrame:
    """Corner and size in pixels -> centre and size within 0 to 1."""
    return df.withColumns({"cx": (F.col("x") + F.col("w") / 2) / width, "cy": (F.col("y") + F.col("h") / 2) / height, "nw": F.col("w") / width, "nh": F.col("h") / height})


def minmax_to_center(df: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    return df.withColumns({"cx": (F.col("xmin") + F.col("xmax")) / 2 / width, "cy": (F.col("ymin") + F.col("ymax")) / 2 / height, "nw": (F.col("xmax") - F.col("xmin")) / width, "nh": (F.col("ymax") - F.col("ymin")) / height})


def denormalize_boxes(df: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Centre and size within 0 to 1 -> whole corners in pixels."""
    corner = lambda c, s, sign, n: ((F.col(c) + sign * F.col(s) / 2) * n).cast("int")
    return df.withColumns({"x1": corner("cx", "nw", -1, width), "y1": corner("cy", "nh", -1, height), "x2": corner("cx", "nw", 1, width), "y2": corner("cy", "nh", 1, height)})


def drop_border_boxes(df: DataFrame, eps: float = 3, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Drops boxes that reach within eps pixels of the frame; (x, y) is taken as the centre here."""
    left, top = F.col("x") - F.col("w") / 2, F.col("y") - F.col("h") / 2
    return df.filter((left > eps) & (top > eps) & (left + F.col("w") < width - eps) & (top + F.col("h") < height - eps))


def transform_boxes(df: DataFrame, transforms: DataFrame, key: str, crop: tuple[float, float, float, float] = (0, 0, WIDTH, HEIGHT)) -> DataFrame:
    """Box corners through their image's 2 x 3 matrix (a..f; identity without one), then into the crop; empty boxes go."""
    names, identity = "abcdef", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    x0, y0, cw, ch = crop
    j = df.join(transforms, key, "left").withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in zip(names, identity, strict=True)})
    at = lambda x, y: (F.col("a") * x + F.col("b") * y + F.col("c"), F.col("d") * x + F.col("e") * y + F.col("f"))
    inside = lambda v, low, size: F.greatest(F.lit(EPS), F.least(F.lit(size - EPS), v - low))
    (ax, ay), (bx, by) = at(F.col("x"), F.col("y")), at(F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    j = j.withColumns({"x1": inside(F.least(ax, bx), x0, cw), "y1": inside(F.least(ay, by), y0, ch), "x2": inside(F.greatest(ax, bx), x0, cw), "y2": inside(F.greatest(ay, by), y0, ch)}).drop(*names)
    return j.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumns({"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}).drop("x1", "y1", "x2", "y2")


def mosaic_boxes(df: DataFrame, cell_w: float, cell_h: float, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Each box in the four cells of a 2 x 2 mosaic, clamped to its cell and to the frame; empty ones go."""
    cells = F.array(*[F.struct(F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy")) for dy in (0, cell_h) for dx in (0, cell_w)])
    m = df.withColumn("cell", F.explode(cells))
    clamp = lambda v, d, size, frame: F.greatest(d, F.least(d + size, F.lit(float(frame)), v))
    m = m.withColumns({"x1": clamp(F.col("x") + F.col("cell.dx"), F.col("cell.dx"), cell_w, width), "y1": clamp(F.col("y") + F.col("cell.dy"), F.col("cell.dy"), cell_h, height), "x2": clamp(F.col("x") + F.col("w") + F.col("cell.dx"), F.col("cell.dx"), cell_w, width), "y2": clamp(F.col("y") + F.col("h") + F.col("cell.dy"), F.col("cell.dy"), cell_h, height)})
    return m.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).drop("cell")


def scale_affine(df: DataFrame, k: float = 5) -> DataFrame:
    """I + (A - I) k, and k t."""
    one = {"a": 1.0, "e": 1.0}
    return df.withColumns({n: F.lit(one.get(n, 0.0)) + (F.col(n) - one.get(n, 0.0)) * k for n in "abcdef"})


def invert_affine(df: DataFrame) -> DataFrame:
    a, b, c, d, e, f = (F.col(x) for x in "abcdef")
    det = a * e - b * d
    return df.withColumns({"a": e / det, "b": -b / det, "c": (b * f - e * c) / det, "d": -d / det, "e": a / det, "f": (d * c - a * f) / det})


def crop_window(df: DataFrame, tx: str = "tx", ty: str = "ty", width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Crop of an image by its measured translation: x, y, w, h of the window, in whole pixels.

    The shift in y moves by the range of centres in x, as the measured data were made.
    """
    norm = lambda t, r: (F.greatest(F.lit(r[0]), F.least(F.lit(r[1]), F.col(t))) - r[0]) / (r[1] - r[0])
    u, v = 2 * norm(tx, LIMITS_X) - 1, 2 * norm(ty, LIMITS_Y) - 1
    df = df.withColumns({"__u": u, "__v": v})
    df = df.withColumns({"crop_w": (width * (1 - F.abs(MOST_CROP * F.col("__u")))).cast("int"), "crop_h": (height * (1 - F.abs(MOST_CROP * F.col("__v")))).cast("int")})
    move = (width - F.col("crop_w")) / 2
    within = lambda c, size, n: F.greatest(size / 2, F.least(n - size / 2, c))
    cx = within(width / 2 + move * F.col("__u"), F.col("crop_w"), width)
    cy = within(height / 2 + move * F.col("__v"), F.col("crop_h"), height)
    return df.withColumns({"crop_x": (cx - F.col("crop_w") / 2).cast("int"), "crop_y": (cy - F.col("crop_h") / 2).cast("int")}).drop("__u", "__v")


def spill_boxes(df: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """The cropped box and up to four that wrap around; unchanged where there is no crop window."""
    x, y, w, h = (F.col(c) for c in "xywh")
    cx, cy, cw, ch = (F.col(f"crop_{c}") for c in "xywh")
    nx, ny = F.greatest(F.lit(0.0), F.least(cw, x - cx)), F.greatest(F.lit(0.0), F.least(ch, y - cy))
    nw, nh = F.least(cw - nx, w), F.least(ch - ny, h)
    box = lambda ok, kind, a, b, c, d: F.when(ok, F.struct(F.lit(kind).alias("kind"), a.cast("double").alias("x"), b.cast("double").alias("y"), c.cast("double").alias("w"), d.cast("double").alias("h")))
    parts = F.when(cx.isNull(), F.array(box(F.lit(True), "whole", x, y, w, h))).otherwise(F.array(
        box((nw > 0) & (nh > 0), "inside", nx + cx, ny + cy, nw, nh), box(x < cx, "left", x + width, y, F.least(w, cx - x), h), box(x + w > cx + cw, "right", x - cw, y, F.least(w, x + w - cx - cw), h),
        box(y < cy, "top", x, y + height, w, F.least(h, cy - y)), box(y + h > cy + ch, "bottom", x, y - ch, w, F.least(h, y + h - cy - ch)),
    ))
    rest = [c for c in df.columns if c not in "xywh"]
    return df.select(*rest, F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select(*rest, "p.*")
