"""Operator 1: token ids as Parquet list columns.

Texts are sorted by id, encoded, and written by Spark's Parquet writer. The ids
column is dictionary-encoded (token ids repeat), the ascending metadata columns
are delta-encoded, row groups are small and every page has an index entry. As
files are sorted by document id, a filter on it reads a few pages, and a
read of metadata never touches the ids.

Nulls, empty texts: a document with the end id alone. Repeated ids: each row is
a document of its own, equal ids ordered by text. Null ids sort first. Empty
tables give an empty file set. Further input columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranges, slices, small_batches, worker_caches

#: White space in any version of Unicode but line ends, for a character class.
_WHITE = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}"
#: Neighbours in white space, other than two line ends before something else: there, not every space or line end is a border.
_RUNS = rf"[{_WHITE}][{_WHITE}\n]|\n[{_WHITE}]|\n\n(?:\n|\z)"
#: A space is a border wherever something that isn't white space stands before it.
_BORDER = re.compile(f"(?<=[^\n{re.sub(r'x{([0-9a-f]+)}', lambda m: 'u' + m[1].zfill(4), _WHITE)}]) ")
#: The byte-level pattern, and the printable stand-ins of bytes.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_SPACE_NAME = chr(_BYTE_NAMES[32])
_NAMES_OF_BYTES = "".join(chr(_BYTE_NAMES[b]) for b in range(256))
#: A word of Latin letters; between it and ASCII signs the byte-level pattern cuts, and nowhere else in the two.
_LATIN = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"
_STOPS = frozenset(".,;:!?")
#: All but tabs, line ends and the scripts of which no version of Unicode moves letters or white space.
_UNUSUAL = re.compile(r"[^\t\n\x20-\x7e\xa1-\u052f]")
#: Pieces and ids that a worker knows at most, besides those of the texts at hand.
KNOWN_PIECES = 600_000
KNOWN_IDS = 4_000_000
#: Words within pieces that a worker keeps; emptied when full.
KNOWN_WORDS = 20_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000


def _is_byte_level(spec: dict) -> bool:
    """Whether a tokenizer's description is byte-level BPE that cuts texts by the pattern above and changes nothing else."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    cuts = pre.get("type") == "ByteLevel" and pre.get("add_prefix_space") is False and pre.get("use_regex", True)
    return bool(model.get("type") == "BPE" and plain and cuts and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))


def _strings(strings: pa.Array) -> list[str]:
    """As `to_pylist`, which makes a scalar of each and takes many times as long."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts, as little-endian 32-bit integers, by one tokenizer file.

    Byte-level BPE encodes a word wherever it stands alike, so a text is cut before its
    spaces and line ends and each piece goes to the tokenizer once. A piece that isn't letters alone is cut
    by the byte-level pattern into words and signs, which go to the tokenizer's own
    BPE model; a word before signs is looked up as the piece that it is without them. What the pattern might treat differently here (rare white space,
    control characters, scripts that Unicode still adds to) is encoded by the tokenizer as a whole,
    as are texts with one of its added tokens, and all texts of tokenizers of any other kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_level = _is_byte_level(spec)
        self.added = sorted({x["content"] for x in spec.get("added_tokens") or [] if x.get("content")})
        #: known pieces, and where their ids lie
        self.pieces: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<i4")
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def named(self, name: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(name)]).tobytes()

    def word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= KNOWN_WORDS:
                self.words.clear()
            got = self.words[word] = self.named(word if word.isascii() and word.isalpha() else word.encode().decode("latin1").translate(_BYTE_NAMES))
        return got

    def piece(self, piece: str) -> bytes:
        """The ids of a piece that starts a text or has its own white space before it."""
        return self.whole(piece) if _UNUSUAL.search(piece) else b"".join(map(self.word, _PATTERN.findall(piece)))

    def after_border(self, piece: str) -> bytes:
        """The ids of a piece with its line end, or of one that had a space before it."""
        if piece[:1] == "\n":
            return self.piece(piece)
        stop = piece[-1:] in _STOPS
        word = piece[:-1] if stop else piece
        if not word.isalpha() or _UNUSUAL.search(word):
            return self.piece(" " + piece)
        # ASCII letters stand for themselves
        got = self.named(_SPACE_NAME + (word if word.isascii() else word.encode().decode("latin1").translate(_BYTE_NAMES)))
        return got + self.word(piece[-1]) if stop else got

    def spaced(self, text: str) -> bytes:
        """A text with runs of white space."""
        first, *rest = _BORDER.split(text)
        return self.piece(first) + b"".join([self.piece(" " + x) for x in rest])

    def after_space(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words of letters, each with a space before it."""
        names = codecs.charmap_decode(" \n ".join(["", *words]).encode(), "strict", _NAMES_OF_BYTES)[0].split(_SPACE_NAME + _NAMES_OF_BYTES[10])[1:]
        got = [[x.id for x in self.model.tokenize(name)] for name in names]
        sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return sizes, np.fromiter(chain.from_iterable(got), dtype="<i4", count=int(sizes.sum()))

    def add(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.pieces.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])

    def place(self, pieces: pa.Array) -> np.ndarray:
        """Places of pieces in the table of known ones; -1 for others."""
        return np.fromiter(map(self.pieces.get, _strings(pieces), repeat(-1)), dtype=np.int64, count=len(pieces))

    def learn(self, new: pa.Array) -> None:
        """Adds pieces to the table of known ones."""
        word = pc.ascii_rtrim(new, characters=punctuation)
        latin = pc.match_substring_regex(word, _LATIN)
        words = [x for x in _strings(word.filter(latin).unique()) if x not in self.pieces]
        self.add(words, *self.after_space(words))
        # words with signs after them
        beyond = pc.subtract(pc.binary_length(new), pc.binary_length(word))
        signed = pc.and_(latin, pc.greater(beyond, 0))
        pieces, at = _strings(new.filter(signed)), self.place(word.filter(signed))
        tails = pa.array([x[-k:] for x, k in zip(pieces, beyond.filter(signed).to_numpy().tolist(), strict=True)], type=pa.string()).dictionary_encode()
        got = [self.word(x) for x in _strings(tails.dictionary)]
        lengths, tail = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4, tails.indices.to_numpy(zero_copy_only=False)
        starts = np.column_stack([self.starts[at], (len(self.ids) + np.cumsum(lengths) - lengths)[tail]]).ravel()
        sizes = np.column_stack([self.sizes[at], lengths[tail]])
        self.add(pieces, sizes.sum(axis=1), np.concatenate([self.ids, np.frombuffer(b"".join(got), dtype="<i4")])[ranges(starts, sizes.ravel())])
        # all others
        pieces = _strings(new.filter(pc.invert(latin)))
        got = [self.after_border(x) for x in pieces]
        self.add(pieces, np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4, np.frombuffer(b"".join(got), dtype="<i4"))

    def known(self, pieces: pa.Array) -> np.ndarray:
        """Places in the table of known pieces, to which new ones come."""
        if len(self.pieces) > KNOWN_PIECES or len(self.ids) > KNOWN_IDS:
            # the common ones are back with the next texts
            self.pieces, self.starts, self.sizes, self.ids = {}, self.starts[:0], self.sizes[:0], self.ids[:0]
        out = self.place(pieces)
        new = out < 0
        missing = pieces.filter(pa.array(new))
        self.learn(missing)
        out[new] = self.place(missing)
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of whole texts (null: empty), each with the end id after it."""
        texts = pc.fill_null(texts, "")
        other = np.full(len(texts), not self.byte_level)
        for x in self.added if self.byte_level else []:
            other |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        spaced = ~other & pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        alone = other | spaced
        cut = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~alone)), "\n", " \n"), " ")
        at, pieces = np.asarray(cut.offsets, dtype=np.int64), cut.values.dictionary_encode()
        places = self.known(pieces.dictionary)
        parts = [self.piece(x) for x in _strings(cut.values.take(pa.array(at[:-1])))]
        n_first = len(parts)
        parts += [(self.whole if o else self.spaced)(x) for x, o in zip(_strings(texts.filter(pa.array(alone))), other[alone].tolist(), strict=True)]
        parts.append(b"" if end_id is None else array("I", [end_id]).tobytes())
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        n_known = len(self.starts)
        starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        sizes = np.concatenate([self.sizes, lengths])
        # the parts of each text in their order, and the end
        counts = np.full(len(texts), 2)
        counts[~alone] = np.diff(at) + 1
        last = np.cumsum(counts)
        order = np.full(int(counts.sum()), n_known + len(parts) - 1)
        inner = np.ones(len(order), dtype=bool)
        inner[last - 1] = False
        of_pieces = np.repeat(~alone, counts)
        code = places[pieces.indices.to_numpy(zero_copy_only=False)]
        code[at[:-1]] = n_known + np.arange(n_first)
        order[inner & of_pieces] = code
        order[inner & ~of_pieces] = n_known + n_first + np.arange(len(parts) - 1 - n_first)
        sizes, starts = sizes[order], starts[order]
        values = np.concatenate([self.ids, np.frombuffer(b"".join(parts), dtype="<i4")])[ranges(starts, sizes)]
        return np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], last])], values


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, loaded once a worker."""
    loaded = worker_caches.setdefault("tokens", {})
    if path not in loaded:
        loaded[path] = Encoder(path)
    return loaded[path]


TOKEN_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def tokenize_sorted(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document in ascending id order, with its place within its part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", keeps="tokens"):
            offsets, values = encoder(tokenizer_path).encode(batch.column("text"), end_id)
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(offsets) - 1, part, dtype=np.int32)), batch.column("doc_id"), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), ids], ["part", "doc_id", "local_start", "n_tokens", "ids"])
            start += int(offsets[-1])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, TOKEN_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes the file set."""
    options = {
        "compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true", **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "local_start", "n_tokens")},
    }
    tokenize_sorted(docs, tokenizer_path, end_id, id_col, text_col).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The file set, or some of its columns: only those are read."""
    df = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    return df.select(*columns) if columns else df


def with_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `start`: ids of all documents before. The totals have one row for each file."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(before, "part").withColumn("start", F.col("base") + F.col("local_start"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, at = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets)
            crc = np.fromiter((zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), dtype=np.int64, count=len(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "local_start", "n_tokens")), pa.array(crc)], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path).mapInArrow(digest, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return with_start(rows, read_token_files(spark, path, ["part", "n_tokens"])).select("doc_id", "start", "n_tokens", "ids_crc32")
