"""Names, tags and paths of runs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the result archives.
CONDITIONS = ("day", "night", "all")
DATASETS = ("kaist", "llvip")
DEVICE_TAGS = (r"_4090[0-9]{0,2}", r"_3090[0-9]{0,2}", "_GPU3090", "_A30", r"_[0-9]{8,9}", r"_[0-9]{6}", r"_GPU[0-1]")
DAY_SETS = ("set00", "set01", "set02", "set06", "set07", "set08")
NIGHT_SETS = ("set03", "set04", "set05", "set09", "set10", "set11")
REGIMES = ("no_equalization", "rgb_equalization", "th_equalization", "rgb_th_equalization")
BASELINE = REGIMES[0]
FAMILIES = {
    "reference": ("visible", "lwir"),
    "static_fusion": ("rgbt", "rgbt_v2", "vt", "vths", "vths_v2", "vths_v3", "hsvt"),
    "reprojection_variance": ("pca", "fa"),
    "reprojection_freq": ("wavelet", "wavelet_max", "curvelet", "curvelet_max"),
    "alpha": ("ssim", "ssim_v2", "sobel_weighted", "superpixel"),
    "dl_fusion": ("early_4ch", "middle_4ch", "late_4ch", "split_late_4ch"),
}
UNKNOWN_FAMILY = "__unknown__"
NOISE_TOKENS = ("llvip", "kaist", "coco", "rgb", "th", "no", "equalization", "rgbt", "rgb_th")
SUFFIX_STARTS = ("patches", "max", "weighted", "v2", "v3", "split", "late", "early", "middle", "4ch", "3ch", "2ch", "1ch")
SPLITS = ("90_10", "80_20", "70_30")


def first_of(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first condition that holds."""
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def parse_name(name: Column) -> Column:
    """`dataset_method..._condition` as a struct of the three."""
    parts = F.split(name, "_")
    last = F.element_at(parts, -1)
    has = (F.size(parts) >= 2) & last.isin(*CONDITIONS)
    n = F.when(has, F.size(parts) - 2).otherwise(F.size(parts) - 1)
    return F.struct(F.element_at(parts, 1).alias("dataset"), F.array_join(F.slice(parts, F.lit(2), F.greatest(n, F.lit(0))), "_").alias("method"), F.when(has, last).otherwise("").alias("condition"))


def clean_tags(name: Column) -> Column:
    """Without the device and date tags, so that runs of different machines merge."""
    for tag in DEVICE_TAGS:
        name = F.regexp_replace(name, tag, "")
    return name


def build_key(group_path: Column, model: Column, name: Column) -> Column:
    return F.concat_ws("/", F.array_join(group_path, "/"), model, name)


def build_label(method: Column, model: Column) -> Column:
    return F.concat(F.upper(method), F.lit(" ("), F.replace(model, F.lit("_sameseed"), F.lit("")), F.lit(")"))


def condition_of(name: Column) -> Column:
    """The parsed condition; else night, day or all within the first token; else Unknown."""
    first = F.element_at(F.split(name, "_"), 1)
    parsed = parse_name(name)["condition"]
    return first_of([(parsed != "", parsed)] + [(first.contains(x), F.lit(x)) for x in ("night", "day", "all")], F.lit("Unknown"))


def infer_condition(path: Column, dataset: Column) -> Column:
    """day or night by the first known set in a path; llvip is night."""
    known = F.filter(F.split(path, "/"), lambda x: x.isin(*DAY_SETS, *NIGHT_SETS))
    by_set = F.when(F.size(known) == 0, F.lit("unknown")).when(F.get(known, 0).isin(*DAY_SETS), F.lit("day")).otherwise("night")
    return first_of([(dataset == "kaist", by_set), (dataset == "llvip", F.lit("night"))], F.lit("unknown"))


def eq_regime(rgb: Column, thermal: Column) -> Column:
    a, b = F.coalesce(rgb, F.lit("none")) != "none", F.coalesce(thermal, F.lit("none")) != "none"
    return first_of([(a & b, F.lit("rgb_th_equalization")), (a, F.lit("rgb_equalization")), (b, F.lit("th_equalization"))], F.lit("no_equalization"))


def eq_labels(regime: Column) -> Column:
    """(eq_vis, eq_th, shown): the inverse of eq_regime, and a short label."""
    rgb, th = regime.isin("rgb_equalization", "rgb_th_equalization"), regime.isin("th_equalization", "rgb_th_equalization")
    shown = F.concat_ws("+", F.when(rgb, F.lit("RGB")), F.when(th, F.lit("TH")))
    return F.struct(F.when(rgb, F.lit("clahe")).otherwise("none").alias("eq_vis"), F.when(th, F.lit("clahe")).otherwise("none").alias("eq_th"), F.when(shown == "", F.lit("-")).otherwise(shown).alias("shown"))


def eq_from_text(text: Column) -> Column:
    """The regime named in a text, the longest name first; null if there is none."""
    value = F.lower(text)
    return first_of([(value.contains(x), F.lit(x)) for x in ("rgb_th_equalization", "th_equalization", "rgb_equalization", "no_equalization")], F.lit(None).cast("string"))


def infer_dataset(tag: Column, *texts: Column) -> Column:
    """A tag that isn't `unknown_...` stays; else dataset and split found in the texts."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in texts]))
    name = first_of([(joined.contains(x), F.lit(x)) for x in ("kaist", "llvip", "coco")], F.lit("unknown"))
    split = first_of([(joined.contains(x), F.lit(x)) for x in SPLITS], F.lit("unknown_split"))
    return F.when((F.coalesce(tag, F.lit("")) != "") & ~tag.startswith("unknown_"), tag).otherwise(F.concat_ws("_", name, split))


def normalize_condition(condition: Column, *texts: Column) -> Column:
    value = F.coalesce(condition, F.lit(""))
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in texts]))
    unknown = F.lower(value).startswith("unknown_condition")
    return first_of([(F.lower(value).isin("day", "night"), F.lower(value)), (unknown & joined.contains("day"), F.lit("day")), (unknown & joined.contains("night"), F.lit("night"))], value)


def infer_option(train_path: Column, name: Column) -> Column:
    """Last segment of the training path; else the second token of the run's name."""
    tokens = F.filter(F.split(F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1), "_"), lambda x: x != "")
    return F.coalesce(F.element_at(F.split(train_path, "/"), -1), F.when(F.size(tokens) >= 2, F.get(tokens, 1)), F.lit("unknown_option"))


def normalize_fusion(fusion: Column, path_name: Column, condition: Column) -> Column:
    """The base method, with the path's tail if that starts with an allowed suffix."""
    tokens = F.filter(F.split(F.element_at(F.split(F.coalesce(path_name, F.lit("")), "/"), -1), "_"), lambda x: x != "")
    at = F.array_position(tokens, fusion).cast("int")
    tail = F.slice(tokens, at + 1, F.greatest(F.size(tokens) - at, F.lit(0)))
    tail = F.filter(tail, lambda x: ~x.isin(*NOISE_TOKENS, "day", "night") & (x != F.coalesce(condition, F.lit(""))))
    extended = F.concat_ws("_", fusion, F.array_join(tail, "_"))
    empty = F.coalesce(fusion, F.lit("")) == ""
    return first_of([(empty, F.lit("unknown_fusion")), ((at > 0) & F.coalesce(F.get(tail, 0).isin(*SUFFIX_STARTS), F.lit(False)), extended)], fusion)


def normalize_path(path: Column) -> Column:
    """Without an accidentally nested regime segment."""
    p = F.split(path, "/")
    nested = (F.size(p) >= 3) & F.get(p, 0).isin(*REGIMES) & F.get(p, 1).startswith("variance_") & F.get(p, 2).startswith("variance_") & F.get(p, 2).endswith("equalization")
    return F.when(nested, F.concat_ws("/", F.get(p, 0), F.get(p, 1))).otherwise(path)


def fusion_family(method: Column) -> Column:
    key = F.lower(F.trim(method))
    return first_of([(key.isin(*names), F.lit(family)) for family, names in FAMILIES.items()], F.lit(UNKNOWN_FAMILY))


def method_rank(method: Column) -> Column:
    """Sorts by family, then by the place in it, then by name; unknown methods last."""
    key = F.lower(F.trim(method))
    pairs = [(key == name, F.struct(F.lit(i), F.lit(j), key)) for i, names in enumerate(FAMILIES.values()) for j, name in enumerate(names)]
    return first_of(pairs, F.struct(F.lit(len(FAMILIES)), F.lit(999), key))


def lwir_path(path: Column) -> Column:
    return F.replace(path, F.lit("/visible/"), F.lit("/lwir/"))


def fingerprint(*columns: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, n)


def metric(metrics: Column, name: str) -> Column:
    """P or mP, R or mR, ...: whichever a record has."""
    return F.coalesce(metrics[name], metrics[f"m{name}"])


def group_label(label: Column, size: Column) -> Column:
    """A label, with the size of its group where that is more than one."""
    return F.when(size > 1, F.format_string("%s N=%d", label, size.cast("long"))).otherwise(label)


def fmt_pm(mean: Column, std: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f±%.{digits}f", mean, std)


def fmt_ts(text: Column) -> Column:
    return F.date_format(F.to_timestamp(text), "yyyy-MM-dd_HH:mm:ss")


def in_time_window(ts: Column, start: str, end: str) -> Column:
    """Whether the time of day lies in a window, borders included; the window may span midnight."""
    now = F.date_format(ts, "HH:mm")
    after, before = now >= F.lit(start), now <= F.lit(end)
    return after & before if start <= end else after | before


def to_number(text: Column) -> Column:
    return text.try_cast("double")


def anchor_map(delta: Column, at_visible: Column, at_thermal: Column) -> Column:
    """100 (delta - thermal) / (visible - thermal) within 0 to 100; 50 where the anchors coincide."""
    span = at_visible - at_thermal
    return F.when(F.abs(span) < 1e-8, F.lit(50.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (delta - at_thermal) / span)))
