"""Operator 5: language identification by multinomial naive Bayes.

Texts are lower-cased and runs of anything but letters become one space. All
character n-grams (1 to 4) of the whole text are hashed into BUCKETS. A model is
a matrix of log probabilities, languages by buckets, with add-one smoothing; it
is broadcast (its size is languages * BUCKETS * 4 bytes; more than `most_langs`
languages are an error, none is left out). Priors are the shares of languages among all labelled documents. Scoring is a sparse matrix product: the matrix rows of
all n-grams of a batch of texts are gathered and summed for each text.

Training reads at most `max_training_docs` labelled documents of each language
(whole texts), chosen by a hash of id and text. A very long text is looked at in parts.

Null texts and texts without letters: `und`, score 0. An empty training set
gives `und` for everything. Ties go to the language that sorts first. Repeated
rows are scored alike. The result has all input columns, or the named ones, plus two new ones, which take the place
of input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, slices, small_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Languages of a model: 128 MB of log probabilities.
MOST_LANGS = 1_000
MAX_TRAINING_DOCS = 2_000
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_MIX = np.uint32(0x9E3779B1)


def clean(text: str | None) -> str:
    """Lower-case letters with single spaces around and between words; empty without letters."""
    if text is None:
        return ""
    got = _OTHER.sub(" ", text.lower()).strip()
    return f" {got} " if any(map(str.isalpha, got)) else ""


def buckets_of(texts: list[str], starts: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some texts, and the number of n-grams of each text.

    n-grams of one order stand together, so the second value has a row for each order.
    Of a single text, those that start before `starts` can be taken only.
    """
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(lengths)
    last = np.zeros(len(codes), dtype=np.int64)
    if len(codes):
        last = np.repeat(ends, lengths) - np.arange(len(codes))
    found, counts, h = [], [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            counts.append(np.zeros(len(texts), dtype=np.int64))
            continue
        h = (h[:m] ^ codes[n - 1 :]) * _MIX
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            found.append((h[: min(m, starts)][last[: min(m, starts)] >= n] ^ np.uint32(n)) & np.uint32(BUCKETS - 1))
        counts.append(np.clip(lengths - n + 1, 0, starts) if n in ORDERS else np.zeros(len(texts), dtype=np.int64))
    return (np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)), np.array([c for n, c in enumerate(counts, 1) if n in ORDERS])


def _batches(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Buckets and counts of runs of texts of some length together, with the place of the first; a longer text comes in parts."""
    at, size, held = 0, 0, []
    for i, x in enumerate(texts):
        if len(x) > most:
            if held:
                yield at, *buckets_of(held)
            for start in range(0, len(x), most):
                yield i, *buckets_of([x[start : start + most + max(ORDERS) - 1]], most)
            at, size, held = i + 1, 0, []
            continue
        held.append(x)
        size += len(x)
        if size >= most:
            yield at, *buckets_of(held)
            at, size, held = i + 1, 0, []
    if held:
        yield at, *buckets_of(held)


def score_texts(texts: list[str], log_probs: np.ndarray, priors: np.ndarray) -> np.ndarray:
    """Log posteriors without the common term: a row for each (cleaned) text."""
    out = np.tile(priors, (len(texts), 1))
    for at, buckets, counts in _batches(texts):
        flat = counts.ravel()
        full = np.flatnonzero(flat)
        if not len(full):
            continue
        starts = (np.cumsum(flat) - flat)[full]
        for lang in range(log_probs.shape[0]):
            sums = np.zeros(len(flat))
            sums[full] = np.add.reduceat(log_probs[lang][buckets], starts, dtype=np.float64)
            out[at : at + counts.shape[1], lang] += sums.reshape(counts.shape).sum(axis=0)
    return out


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_training_docs: int = MAX_TRAINING_DOCS, most_langs: int = MOST_LANGS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities, log priors. Counts are summed by Spark; the driver gets one number for each language and bucket."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    totals = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs + 1).collect()
    if len(totals) > most_langs:
        raise ValueError(f"over {most_langs} languages")
    langs = sorted(x["lang"] for x in totals)
    if not langs:
        return [], np.zeros((0, BUCKETS), dtype=np.float32), np.zeros(0)
    share = {x["lang"]: min(1.0, max_training_docs / x["n"]) for x in totals}
    keep = F.create_map(*[y for k, v in share.items() for y in (F.lit(k), F.lit(int(v * (1 << 30))))])
    sample = labelled.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1 << 30)) < F.element_at(keep, F.col("lang")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        at = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for _, buckets, _ in _batches([clean(x) for x in texts]):
                    sums[at[lang]] += np.bincount(buckets, minlength=BUCKETS)
        i, j = np.nonzero(sums)
        yield pd.DataFrame({"lang": i.astype(np.int32), "bucket": j.astype(np.int32), "n": sums[i, j]})

    counts = sample.mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    sums = np.ones((len(langs), BUCKETS))
    sums[got["lang"], got["bucket"]] += got["n"]
    log_probs = np.log(sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)
    priors = np.array([{x["lang"]: x["n"] for x in totals}[k] for k in langs], dtype=float)
    return langs, log_probs, np.log(priors / priors.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", *, lang: str = "lang_pred", score: str = "score", returned: list[str] | None = None) -> DataFrame:
    """All input columns (or the named ones) plus the language and its posterior probability."""
    small_batches(docs.sparkSession)
    langs, log_probs, priors = model
    shared = docs.sparkSession.sparkContext.broadcast((log_probs, priors))
    kept = [x for x in (docs.columns if returned is None else returned) if x not in (lang, score)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_probs, priors = shared.value
        for batch in slices(batches, "text"):
            texts = [clean(x) for x in batch.column("text").to_pylist()]
            names, p = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if langs:
                logs = score_texts(texts, log_probs, priors)
                best = logs.argmax(axis=1)
                sure = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i, text in enumerate(texts):
                    if text:
                        names[i], p[i] = langs[best[i]], float(sure[i])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names, type=pa.string()), pa.array(p, type=pa.float64())], [*kept, lang, score])

    # input columns of any name go in by place
    return docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)], F.col(text_col).alias("text")).mapInArrow(run, schema)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
