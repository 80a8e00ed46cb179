"""Run archives: discovery from file listings, documents, epoch logs, result tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duolume.functions.names import REGIMES, build_key, build_label, clean_tags

# Fixed names of the archives.
RESULTS, REBUILT, IGNORE = "results.yaml", "results_reconstructed.yaml", "GUI_IGNORE"


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "modificationTime", "length")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _parents(path: Column) -> Column:
    """All folders above a file."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def discover_runs(files: DataFrame, root: str = "") -> DataFrame:
    """Run catalogue of a listing (path, modificationTime).

    Subtrees with an ignore marker are left out, and paths with `validate`. A folder's
    rebuilt results win over the original ones. A run below `npzfix` is no run of
    its own but overrides the run above it; the latest path wins.
    """
    names = files.withColumn("file", base(F.col("path"))).withColumn("dir", folder(F.col("path")))
    marked = names.filter(F.col("file").endswith(IGNORE)).select(F.col("dir").alias("up")).distinct()
    found = names.filter(F.col("file").isin(RESULTS, REBUILT) & ~F.col("path").contains("validate"))
    hidden = found.select("path", F.explode(_parents(F.col("path"))).alias("up")).join(marked, "up", "left_semi").select("path").distinct()
    found = found.join(hidden, "path", "left_anti")
    found = found.groupBy("dir").agg(F.max_by("path", F.struct((F.col("file") == REBUILT).cast("int"), "path")).alias("path"))
    rel = F.filter(F.split(F.substring(F.col("dir"), len(root) + 1, 1 << 20) if root else F.col("dir"), "/"), lambda x: x != "")
    found = found.withColumn("parts", rel).withColumn("fix", F.array_position("parts", F.lit("npzfix")).cast("int"))
    runs = found.filter("fix = 0 and size(parts) >= 2")
    fixes = found.filter("fix > 1").select(F.array_join(F.slice("parts", 1, F.col("fix") - 1), "/").alias("home"), "path").groupBy("home").agg(F.max("path").alias("val_override_path"))
    n = F.size("parts")
    runs = runs.select("path", F.element_at("parts", -1).alias("name"), clean_tags(F.element_at("parts", -2)).alias("model"), F.slice("parts", 1, F.greatest(n - 2, F.lit(0))).alias("group_path"), F.array_join("parts", "/").alias("home"))
    runs = runs.join(fixes, "home", "left").withColumn("title", F.regexp_replace(F.element_at(F.concat(F.array(F.lit("")), "group_path"), -1), "variance_", ""))
    return runs.select(build_key(F.col("group_path"), F.col("model"), F.col("name")).alias("run_key"), "name", "path", "model", "title", build_label(F.col("title"), F.col("model")).alias("label"), "group_path", "val_override_path")


def discover_cached(files: DataFrame, root: str, extension: str = ".yaml.cache") -> DataFrame:
    """The same from cached files: the key is the relative path without the extension."""
    key = F.regexp_replace(F.substring(F.col("path"), len(root) + 2, 1 << 20), extension.replace(".", r"\.") + "$", "")
    return files.filter(F.col("path").endswith(extension)).select(key.alias("run_key"), "path")


def read_documents(spark: SparkSession, path: str, glob: str, schema: str) -> DataFrame:
    """YAML documents as rows of a fixed schema (nested ones too); broken ones, and those with a value of another type, have an `_error`, the latter with nulls for what doesn't fit."""

    @F.pandas_udf("json string, error string")
    def decode(texts: pd.Series) -> pd.DataFrame:
        import yaml

        out = []
        for text in texts:
            try:
                got = yaml.safe_load(text)
                if got is not None and not isinstance(got, dict):
                    raise ValueError("no mapping")
                out.append((json.dumps(got or {}, default=str), None))
            except (yaml.YAMLError, ValueError, TypeError, RecursionError) as e:
                out.append((None, str(e)[:200]))
        return pd.DataFrame(out, columns=["json", "error"])

    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    found = text.select(F.col("_metadata.file_path").alias("path"), decode("value").alias("d"))
    fields = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_misfit", T.StringType())])
    found = found.select("path", "d.error", F.from_json("d.json", fields, {"columnNameOfCorruptRecord": "_misfit"}).alias("row"))
    return found.select("path", *[F.col("row").getField(f.name).alias(f.name) for f in fields[:-1]], F.coalesce("error", F.when(F.col("row._misfit").isNotNull(), F.lit("a value doesn't fit the schema"))).alias("_error"))


def read_epoch_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Epoch logs with padded headers: columns by place, numbers as doubles; one row for each epoch of each file."""
    rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").option("recursiveFileLookup", "true").csv(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), "*")


def read_args(documents: DataFrame) -> DataFrame:
    return documents.select("path", "batch", "deterministic")


def load_training_results(df: DataFrame, target_class: str = "person") -> DataFrame:
    """Rows of one class under the four regimes, day or night."""
    return df.filter((F.col("Class") == target_class) & F.col("Group Key").isin(*REGIMES) & F.col("Condition").isin("day", "night"))


def load_overview(df: DataFrame, eq_vis: str, eq_th: str) -> DataFrame:
    """Rows of one setting, with older tables' missing columns filled in."""
    fill = {"thermal_share_raw": 1 - F.col("raw_mean") / 100, "thermal_share_reg": 1 - F.col("reg_mean") / 100, "calibration_lift": F.col("latent_z_mean") - (1 - F.col("reg_mean") / 100)}
    return df.withColumns({k: v for k, v in fill.items() if k not in df.columns}).filter((F.col("eq_vis") == eq_vis) & (F.col("eq_th") == eq_th))


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def proxy_table(df: DataFrame, proxies: list[str], methods: list[str] | None = None, conditions: list[str] | None = None, optional: str | None = None) -> DataFrame:
    """Rows with all proxies finite, without the anchors; the optional column stays only if it is finite in every row."""
    for c in proxies:
        df = df.filter(finite(c))
    df = df.filter(~F.col("method").isin("visible", "lwir"))
    if methods:
        df = df.filter(F.col("method").isin(*methods))
    if conditions:
        df = df.filter(F.col("condition").isin(*conditions))
    if optional and df.agg(F.coalesce(F.min(finite(optional).cast("int")), F.lit(0))).first()[0] == 0:
        df = df.drop(optional)
    return df


def drop_nonfinite(df: DataFrame, columns: list[str], observation=None) -> DataFrame:
    """Without rows that have a missing or non-finite value; an Observation gets their number."""
    good = F.lit(True)
    for c in columns:
        good = good & F.coalesce(finite(c), F.lit(False))
    if observation is not None:
        df = df.observe(observation, F.sum((~good).cast("long")).alias("dropped"))
    return df.filter(good)


def assemble_runs(results: DataFrame, epochs: DataFrame, args: DataFrame) -> DataFrame:
    """Results with their epoch rows (a list by epoch) and two run arguments, by folder."""
    log = epochs.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("epoch", *[c for c in epochs.columns if c not in ("dir", "epoch")]))).alias("epochs"))
    return results.join(log, "dir", "left").join(args.select("dir", "batch", "deterministic"), "dir", "left")


def eligible_runs(files: DataFrame, tag: str) -> DataFrame:
    """Folders with best weights and results, without an ignore marker, not yet validated for a tag."""
    name = base(F.col("path"))
    marks = {"weights": name == "best.pt", "results": name == RESULTS, "ignored": name.endswith(IGNORE), "done": name == f"validated_{tag}"}
    per = files.groupBy(folder(F.col("path")).alias("dir")).agg(*[F.bool_or(v).alias(k) for k, v in marks.items()])
    return per.filter("weights and results and not ignored and not done").select("dir")


def completed(documents: DataFrame, block: str) -> DataFrame:
    """dir, completed: whether a run's result document has its completion block (a column), for each folder."""
    return documents.groupBy(folder(F.col("path")).alias("dir")).agg(F.bool_or(F.col(block).isNotNull()).alias("completed"))


def combine_variants(variants: dict[str, tuple[str, str, DataFrame]]) -> DataFrame:
    """Reports of several settings as one table with variant, eq_vis and eq_th."""
    parts = [df.withColumns({"variant": F.lit(k), "eq_vis": F.lit(v), "eq_th": F.lit(t)}) for k, (v, t, df) in variants.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def anomaly_report(runs: DataFrame, least: int = 5) -> DataFrame:
    """kind, run_key, expected, found, detail of everything odd in (run_key, regime, folder_regime, dataset, condition, option, error, content_hash)."""

    def of(kind: str, where: Column, expected: Column, found: Column, detail: Column) -> DataFrame:
        return runs.filter(where).select(F.lit(kind).alias("kind"), "run_key", expected.cast("string").alias("expected"), found.cast("string").alias("found"), detail.cast("string").alias("detail"))

    none = F.lit(None)
    out = of("regime_mismatch", F.col("regime") != F.col("folder_regime"), F.col("regime"), F.col("folder_regime"), none)
    out = out.unionByName(of("unknown_dataset", F.col("dataset").startswith("unknown"), none, F.col("dataset"), none))
    out = out.unionByName(of("unknown_condition", ~F.col("condition").isin("day", "night"), none, F.col("condition"), none))
    out = out.unionByName(of("unknown_option", F.col("option") == "unknown_option", none, F.col("option"), none))
    out = out.unionByName(of("error", F.col("error").isNotNull(), none, none, F.col("error")))
    same = runs.groupBy("content_hash").agg(F.min("run_key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    twice = runs.join(same, "content_hash").filter(F.col("run_key") != F.col("first"))
    return out.unionByName(twice.select(F.lit("duplicate").alias("kind"), "run_key", F.col("first").alias("expected"), F.lit(None).cast("string").alias("found"), F.col("n").cast("string").alias("detail")))


def latest(files: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("modificationTime"), F.desc("path"))
    return files.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
