"""Packing by powers of two: documents cut into pieces of binary lengths.

A document's ids are cut into as many whole sequences as fit and the binary
digits of what is left, so every piece is a power of two long and fills a
sequence by itself: nothing is padded and no sequence holds two documents.
Pieces of one length form a bucket, from which batches of one shape can be
read.  Nothing is shuffled but one row for each partition and length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, text_batches, written

SIZE = 1024
#: Rows of (partition, length, pieces before) that may be broadcast.
BROADCAST_ROWS = 200_000
#: Spellings that a worker gathers before it forgets those not met since as many before; some 100 MB.
REMEMBERED = 500_000

SPACE = r"\x20\x09-\x0D"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space beyond the six bytes above, by any definition of it.
RARE_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BEFORE_SPACE = re.compile(rf"(?<=\S)(?=[{SPACE}])")
#: Chunks of which the vocabulary's pattern makes just these parts: letters,
#: digits and other signs that every version of Unicode takes for that.
PLAIN = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~])+")
PART = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: Up to here what Python takes for a letter is one in every version of Unicode.
LAST = "\u00ff"
PIECES = "start long, length long, ids binary, doc_tokens long, _part int, _nth long"


def public_vocabulary() -> str:
    """Path of a byte-level vocabulary that comes with the tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_lengths(n: int, size: int = SIZE) -> list[int]:
    """Powers of two, ``size`` at most, that add up to ``n``; longest first."""
    rest = n % size
    return [size] * (n // size) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class Encoder(dict):
    """Ids of a text as little-endian unsigned 32-bit numbers.

    A byte-level vocabulary's own pattern never joins white space to what is
    before it and looks at nothing behind, so a text may be cut before white
    space; each distinct chunk is encoded by ``tokenizers`` once, and one of
    plain words and signs by the merges alone.  For other vocabularies whole
    texts are encoded.  Strings of special tokens are
    ordinary text.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.older: dict[str, bytes] = {}
        self.end = np.array([end_id], "<u4").tobytes()
        self.merge = self.tokenizer.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        # byte-level vocabularies spell a byte that is no visible sign by the next letter from 256 on
        visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: 256 + i for i, b in enumerate(hidden)}
        model = json.loads(self.tokenizer.to_str())
        before = model.get("pre_tokenizer") or {}
        plain = [t for t in model.get("added_tokens", []) if not t.get("special") or t.get("lstrip") or t.get("rstrip")]
        self.by_chunk = model.get("normalizer") is None and not plain and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and bool(before.get("use_regex", True))

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            word = text[1:] if text[:1] == " " else text
            if not self.by_chunk or not word:
                ids = self._whole(text)
            elif word.isalpha() and max(word) <= LAST:
                ids = self._merged(text)
            elif word[:-1].isalpha() and max(word) <= LAST and word[-1] in ",.;:!?":
                ids = self[text[:-1]] + self[word[-1]]
            elif text[0] == "\n" and len(text) > 1 and not text[1].isspace():
                ids = self["\n"] + self[text[1:]]
            elif PLAIN.fullmatch(text):
                parts = PART.findall(text)
                ids = b"".join([self[p] for p in parts]) if len(parts) > 1 else self._merged(text)
            else:
                ids = self._whole(text)
        self[text] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, part: str) -> bytes:
        spelt = part.replace(" ", "\u0120") if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.merge(spelt)])

    def __call__(self, text: str) -> bytes:
        """The ids of ``text`` and the end of the document."""
        chunks = [text] if not self.by_chunk else BEFORE_SPACE.split(text) if RARE_SPACE.search(text) else CHUNK.findall(text)
        out = b"".join(map(self.__getitem__, chunks)) + self.end
        if len(self) > (REMEMBERED if self.by_chunk else 0):
            self.older = dict(self)
            self.clear()
        return out


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, end_id)


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, start, length, ids, doc_tokens, _part, _nth)``: each
    document's pieces; ``_nth`` counts those of a length within a partition.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    text_batches(docs.sparkSession)
    path = vocabulary or public_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, counts = encoder(path, end_id), TaskContext.get().partitionId(), {}
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids, start = encode(text), 0
                total = len(ids) // 4
                for length in piece_lengths(total, size):
                    nth = counts.get(length, 0)
                    counts[length] = nth + 1
                    at.append(i)
                    rows.append((start, length, ids[4 * start : 4 * (start + length)], total, part, nth))
                    start += length
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], ["_id", "start", "length", "ids", "doc_tokens", "_part", "_nth"])

    rows = docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(cut, f"_id {kind}, {PIECES}").withColumnRenamed("_id", id_col)


def packed(docs: DataFrame, size: int = SIZE, end_id: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A sequence per row: ``(<id_col>, start, length, ids, doc_tokens,
    sequence_id, offset)``.

    A document is its ids and ``end_id``; ``start`` counts its ids before the
    piece, ``ids`` holds ``length`` little-endian unsigned 32-bit ids, and
    ``length`` is a power of two, ``size`` at most.  Sequences are numbered
    from 0 without gaps, the longest first, then by partition and order in it;
    ``offset`` is 0, as a sequence holds one piece.

    A null or empty text is the end alone.  Repeated rows, and rows of one or
    no id, are packed each for itself.  Texts are never shortened; other
    columns are not read.  An empty frame gives no rows.  The pieces are
    written to the shared folder, so they are made once; which numbers they get
    depends on how the input is split into partitions.
    """
    if id_col in {"start", "length", "ids", "doc_tokens", "sequence_id", "offset", "_part", "_nth"}:
        raise ValueError(f"rename the column {id_col}: results have one of that name")
    rows = written(pieces(docs, size, end_id, vocabulary, id_col, text_col), "pieces")
    # one row for each partition and length
    counts = rows.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counts = written(counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))), "piece-counts")
    longer, totals = 0, {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # a row for each power of two
    base = F.lit(0).cast("long")
    for length in sorted(totals, reverse=True):
        base = F.when(F.col("length") == length, F.lit(longer).cast("long")).otherwise(base)
        longer += totals[length]
    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    before = counts.select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    joined = rows.join(F.broadcast(before) if few else before, ["length", "_part"])
    return joined.select(quoted(id_col), "start", "length", "ids", "doc_tokens", (base + F.col("_before") + F.col("_nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Write ``packed`` rows as Parquet, a folder for each length."""
    sequences.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def unpacked(ids: bytes) -> np.ndarray:
    """The numbers in a value of ``ids``."""
    return np.frombuffer(ids, "<u4")
