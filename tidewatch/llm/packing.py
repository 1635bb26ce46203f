"""Best-fit packing planned on a histogram of lengths.

Documents become token pieces of at most one sequence.  The plan sees only how many
pieces there are of each length (at most ``capacity`` numbers, whatever the corpus): longest
first, each length fills the sequences with the least sufficient room, whole groups of
equal sequences at a time.  Pieces then take planned slots by their rank within their
length.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import first_columns, python_ready, ranked_in_chunks, saved, shuffle_partitions, texts, word_bytes

_CACHED_WORDS = 500_000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                           ("length", pa.int64()), ("ids_crc32", pa.int64())])
_IDS_ARROW = _PIECES_ARROW.append(pa.field("ids", pa.binary()))


#: Words whose normal form and pieces are plain: printable ASCII without apostrophe and "<", and
#: the letters of Latin-1.  Lower-casing is by character there, and no two of them compose.
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own pieces of such a word, lower-cased: letters, one digit, others.
_PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """Character that byte-level BPE writes for each byte: itself if it is visible in Latin-1,
    else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class WordTokens(dict):
    """Token ids of texts through a cache of words and their pieces (little-endian unsigned
    32-bit ids by UTF-8 bytes).

    The tokenizer drops white space and splits at it before anything else, so a text's ids are
    its words' ids in order.  Plain words are cut into the tokenizer's pieces here and go
    straight to its model; all others go through the whole tokenizer.
    """

    def __init__(self, definition: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _CACHED_WORDS:
            self.clear()              # costs time only
        text = word.decode()
        if not _PLAIN.fullmatch(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            pieces = _PIECE.findall(text.lower())
            if len(pieces) > 1:
                found = self[word] = b"".join([self[p.encode()] for p in pieces])
                return found
            piece = pieces[0] if pieces[0].isascii() else pieces[0].encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(piece)]
        found = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def ids(self, text: bytes | None) -> bytes:
        # letters are lower-cased anyway; done first, it saves entries (special tokens keep their case)
        words = word_bytes(text.lower() if text and b"<|" not in text else text)
        return b"".join(map(self.__getitem__, words))


_tokenizers: dict[int, WordTokens] = {}


def _tokens(definition: str) -> WordTokens:
    """One tokenizer (and word cache) per Python worker."""
    key = hash(definition)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokens(definition)
    return _tokenizers[key]


def _piece_rows(definition, capacity: int, end_id: int, with_ids: bool):
    schema = _IDS_ARROW if with_ids else _PIECES_ARROW

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(definition.value)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            out, size = [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b, "text")):
                ids = tokens.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[:len(schema)])
                    size += 40 + with_ids * len(part)
                if size > 8_000_000:
                    yield _batch(out, schema)
                    out, size = [], 0
            if out:
                yield _batch(out, schema)
    return rows


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every row's token ids followed by ``end_id``; only longer rows are cut.

    ``tokenizer`` is the path of a tokenizer definition that the driver can read; its text is
    broadcast (a definition is a few MB).  Null text: the end id alone.
    """
    spark = docs.sparkSession
    python_ready(spark)
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = first_columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_piece_rows(definition, capacity, end_id, with_ids),
                           _PIECES + (", ids binary" if with_ids else ""))


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, count, first sequence, offset).

    The pieces of this length and of ranks first .. first + count - 1 go to as many sequences
    from ``first sequence`` on, at the same offset in each.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    room: list[int] = []                             # sorted; rooms that some sequence has
    groups: dict[int, list[tuple[int, int]]] = {}    # room -> (first sequence, sequences)
    made = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in groups:
                bisect.insort(room, left)
                groups[left] = []
            groups[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while count:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                left = room[at]
                first, n = groups[left].pop()
                if not groups[left]:
                    del groups[left], room[at]
            else:
                left, first = capacity, made
                n = -(-count // (capacity // length))
                made += n
            # the fullest sequence takes the next piece too, so each takes as many as fit
            each = left // length
            full = min(n, count // each)
            rest = min(count - full * each, each) if full < n else 0
            for sequences, start, k in ((full, first, each), (bool(rest), first + full, rest)):
                for j in range(k if sequences else 0):
                    plan.append((length, rank, int(sequences), start, capacity - left + j * length))
                    rank += int(sequences)
                put(left - k * length, start, int(sequences))
                count -= int(sequences) * k
            put(left, first + full + bool(rest), n - full - bool(rest))
    return plan


_PLAN = "plan_length bigint, first_rank bigint, n bigint, first_sequence bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Place of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids, little-endian unsigned 32-bit, if asked for).

    Sequences are filled from offset 0 without gaps.  Null text packs the end id alone;
    repeated rows and null ids are packed like any others; an empty table gives no rows.
    Rank within length is counted in chunks, so a length that a third of all pieces have is
    not one task.
    """
    spark = docs.sparkSession
    pieces = saved(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids))
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(best_fit_plan(histogram, capacity), _PLAN)
    chunks = 4 * shuffle_partitions(spark)
    ranked = ranked_in_chunks(
        pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)).cast("int")),
        ["length"], "_chunk", ["doc_id", "piece", "ids_crc32"], "_rank")
    # the plan's size is bounded by the number of lengths, so it may be broadcast
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("plan_length"))
                         & (F.col("_rank") >= F.col("first_rank"))
                         & (F.col("_rank") < F.col("first_rank") + F.col("n")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("first_sequence") + F.col("_rank") - F.col("first_rank")).alias("sequence_id"),
                         "offset", *(["ids"] if with_ids else []))
