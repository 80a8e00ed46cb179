"""Readers and sinks on small files."""

from __future__ import annotations

import datetime as dt
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from duolume.operators import runs as R
from duolume.sources import annotations as A
from duolume.sources import archives as S


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text) if isinstance(text, bytes) else p.write_text(text)


def test_discovery(spark, tmp_path):
    for name in ("g/m_4090/r1/results.yaml", "g/m_4090/r1/results_reconstructed.yaml", "g/m/r2/results.yaml", "g/m/r2/npzfix/f1/results.yaml", "g/m/r2/npzfix/f2/results.yaml", "h/X_GUI_IGNORE", "h/m/r3/results.yaml", "g/validate/r4/results.yaml"):
        put(tmp_path, name, "a: 1")
    files = S.list_files(spark, f"file://{tmp_path}")
    got = {r["run_key"]: r for r in S.discover_runs(files, f"file:{tmp_path}").collect()}
    assert set(got) == {"g/m/r1", "g/m/r2"}
    assert got["g/m/r1"]["path"].endswith("results_reconstructed.yaml") and got["g/m/r2"]["val_override_path"].endswith("f2/results.yaml") and got["g/m/r1"]["val_override_path"] is None


def test_documents_and_logs(spark, tmp_path):
    put(tmp_path, "a/args.yaml", "batch: 8\ndeterministic: true\n")
    put(tmp_path, "b/args.yaml", "batch: [broken")
    docs = S.read_documents(spark, f"file://{tmp_path}", "args.yaml", "batch int, deterministic boolean")
    got = {r["path"].split("/")[-2]: r for r in docs.collect()}
    assert got["a"]["batch"] == 8 and got["a"]["_error"] is None and got["b"]["batch"] is None and got["b"]["_error"]
    put(tmp_path, "n/deep.yaml", "a: {p: 1, q: [1.5, 2]}\nm: {x: {v: 3}, y: {v: null}}\n")
    put(tmp_path, "w/deep.yaml", "a: {p: wrong, q: [1.5]}\nm: {}\n")
    put(tmp_path, "l/deep.yaml", "- 1\n- 2\n")
    deep = S.read_documents(spark, f"file://{tmp_path}", "deep.yaml", "a struct<p: int, q: array<double>>, m map<string, struct<v: int>>")
    got = {r["path"].split("/")[-2]: r for r in deep.collect()}
    assert (got["n"]["a"]["p"], got["n"]["a"]["q"], got["n"]["m"]["x"]["v"], got["n"]["m"]["y"]["v"], got["n"]["_error"]) == (1, [1.5, 2.0], 3, None, None)
    assert got["w"]["_error"] and got["l"]["_error"] and got["l"]["a"] is None
    done = {r["dir"].split("/")[-1]: r["completed"] for r in S.completed(deep, "a").collect()}
    assert done["n"] and not done["l"]
    files = spark.createDataFrame([(f"/r/{x}",) for x in ("1/best.pt", "1/results.yaml", "2/notbest.pt", "2/results.yaml", "3/best.pt", "3/my_results.yaml", "4/best.pt", "4/results.yaml", "4/X_GUI_IGNORE")], "path string")
    assert [r["dir"] for r in S.eligible_runs(files, "t").collect()] == ["/r/1"]
    put(tmp_path, "logs/results.csv", "  epoch,   train/box_loss\n   1,    0.5\n   2,  0.25\n")
    rows = S.read_epoch_logs(spark, f"file://{tmp_path}/logs", "epoch int, box_loss double").orderBy("epoch").collect()
    assert [(r["epoch"], r["box_loss"]) for r in rows] == [(1, 0.5), (2, 0.25)]


def test_xml_boxes(spark, tmp_path):
    one = "<object><name>{}</name><bndbox><x>1</x><y>2</y><w>3</w><h>4</h></bndbox>{}</object>"
    put(tmp_path, "x/i.xml", "<annotation><size><width>640</width><height>512</height></size>" + one.format("person", "") + one.format("person?", "") + one.format("cyclist", "<label>l</label>") + "</annotation>")
    put(tmp_path, "x/empty.xml", "<annotation><size><width>640</width><height>512</height></size></annotation>")
    rows = A.read_boxes_xywh(spark, f"file://{tmp_path}/x").collect()
    assert sorted((r["name"] or "", r["w"]) for r in rows) == [("", None), ("person", 3.0)]
    assert A.read_boxes_xywh(spark, f"file://{tmp_path}/x", relabeling=True).filter("name = 'cyclist'").count() == 1
    put(tmp_path, "y/i.xml", "<annotation><size><width>10</width><height>10</height></size><object><name>person</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>5</xmax><ymax>8</ymax></bndbox></object><object><name>dog</name></object></annotation>")
    assert [(r["xmin"], r["ymax"]) for r in A.read_boxes_minmax(spark, f"file://{tmp_path}/y").collect()] == [(1.0, 8.0)]


def test_label_files(spark, tmp_path):
    put(tmp_path, "l/a.txt", "0 0.5 0.5 0.1 0.2\nbad line\n1 x 0 0 0\n")
    rows = A.read_labels(spark, f"file://{tmp_path}/l").withColumn("image_id", F.lit("a"))
    assert [(r["cls"], r["nh"]) for r in rows.collect()] == [(0, 0.2)]
    A.write_labels(rows, f"file://{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").glob("image_id=*")] == ["image_id=a"]
    A.compact_labels(spark, f"file://{tmp_path}/l", f"file://{tmp_path}/packed")
    assert spark.read.parquet(f"file://{tmp_path}/packed").count() == 3


def test_image_lists(spark, tmp_path):
    put(tmp_path, "train.txt", "set00/V000/I1\n\nset00/V000/I2\n")
    put(tmp_path, "test.txt", "set01/V000/I1\n")
    assert A.read_image_lists(spark, f"file://{tmp_path}/*.txt").count() == 3
    assert A.read_image_lists(spark, f"file://{tmp_path}/*.txt", allow=["test"]).count() == 1


def png(width, height, rows):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pixels_of_an_image(spark, tmp_path):
    put(tmp_path, "img/visible/a.png", png(2, 1, [[10, 20, 30, 40, 50, 60]]))
    images = spark.read.format("image").load(f"file://{tmp_path}/img/visible")
    rows = A.to_pixels(images, F.lit("a")).orderBy("x").collect()
    assert [(r["y"], r["x"], r["b"], r["g"], r["r"]) for r in rows] == [(0, 0, 30.0, 20.0, 10.0), (0, 1, 60.0, 50.0, 40.0)]
    px = A.to_pixels(images, F.lit("a"))
    assert A.pair_images(px, px.filter("x = 0")).count() == 1


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_table_sinks(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", 1 / 3), ("b", float("nan")), ("c", None)], "k string, v double")
    A.write_table(df, f"file://{tmp_path}/t", kind)
    text = "".join(p.read_text() for p in (tmp_path / "t").glob(f"part*.{kind}"))
    assert ("0.333333" in text) if kind == "csv" else ('"v":null' in text and "NaN" not in text)


def test_incremental_and_assembly(spark):
    results = spark.createDataFrame([("d1", 1), ("d2", 2)], "dir string, v int")
    epochs = spark.createDataFrame([("d1", 2, 0.1), ("d1", 1, 0.2)], "dir string, epoch int, loss double")
    args = spark.createDataFrame([("d2", 8, True)], "dir string, batch int, deterministic boolean")
    got = {r["dir"]: r for r in S.assemble_runs(results, epochs, args).collect()}
    assert [e["epoch"] for e in got["d1"]["epochs"]] == [1, 2] and got["d2"]["batch"] == 8 and got["d2"]["epochs"] is None
    assert S.latest(spark.createDataFrame([("a", "x", dt.datetime(2024, 1, 1)), ("b", "x", dt.datetime(2024, 1, 2))], "path string, k string, modificationTime timestamp"), ["k"]).first()["path"] == "b"


def test_overview_back_fill(spark):
    df = spark.createDataFrame([("none", "none", 60.0, 40.0, 0.5), ("clahe", "none", 1.0, 1.0, 0.1)], "eq_vis string, eq_th string, raw_mean double, reg_mean double, latent_z_mean double")
    rows = S.load_overview(df, "none", "none").collect()
    assert len(rows) == 1 and rows[0]["thermal_share_reg"] == pytest.approx(0.6) and rows[0]["calibration_lift"] == pytest.approx(-0.1)


def test_curve_gaps_are_skipped(spark):
    df = spark.createDataFrame([("g", 0, 1.0), ("g", 0, float("nan")), ("g", 0, 3.0)], "k string, pt int, value double")
    r = R.curve_envelope(df, ["k"]).first()
    assert (r["mean"], r["low"], r["high"], r["n"]) == (2.0, 1.0, 3.0, 2)
