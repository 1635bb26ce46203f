"""Byte-pair encoding and decoding with a rank array per word.

A text is cut at white space, each word into the definition's pieces, and each piece is merged
on its own.  A short piece is held as a contiguous list of part boundaries and the merge rank
of every adjacent pair: the least rank is found by a scan, its boundary is deleted, and the two
neighbouring ranks are refreshed.  A long piece (no white space for hundreds of characters)
would make these scans quadratic; there the same merges are taken from a heap of (rank, place).
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import first_columns, python_ready, texts, word_bytes

_CACHED_WORDS = 300_000
_CACHED_BYTES = 64            # longer words are not kept
_SCANNED_PARTS = 100          # pieces of more characters use the heap
_BATCH_BYTES = 8_000_000
_NO_MERGE = 1 << 40

#: Words of visible ASCII and the letters of Latin-1: their normal form is their lower case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The definition's pieces of such a word in lower case.
_PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The character that byte-level BPE writes for a byte: itself where it is visible in Latin-1,
    else the next free one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in seen else chr(next(free)) for b in range(256)}


class Merges:
    """The merge table of a definition; ``parts`` merges one piece."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        # by the joined parts and the place of the boundary between them
        self.ranks = {(a + b, len(a)): n for n, (a, b) in enumerate(pairs)}
        self.letters = {a + b: n for n, (a, b) in enumerate(pairs) if len(a) == len(b) == 1}

    def parts(self, piece: str) -> list[str]:
        """Merged parts of a piece of byte letters; the last one carries the word end."""
        if not piece:
            return []
        text = piece + self.suffix
        bounds = [*range(len(piece)), len(text)]
        if len(piece) > _SCANNED_PARTS:
            bounds = self._by_heap(text, bounds)
        else:
            self._by_scan(text, bounds)
        return [text[a:b] for a, b in zip(bounds, bounds[1:])]

    def _by_scan(self, text: str, bounds: list[int]) -> None:
        rank, letters, last = self.ranks.get, self.letters.get, len(bounds) - 3
        ranks = [letters(text[i:i + 2], _NO_MERGE) for i in range(last)]
        if last >= 0:
            ranks.append(rank((text[last:], 1), _NO_MERGE))
        while ranks:
            least = min(ranks)
            if least == _NO_MERGE:
                break
            i = ranks.index(least)          # ties: the leftmost
            del bounds[i + 1], ranks[i]
            start, mid = bounds[i], bounds[i + 1]
            if i < len(ranks):
                ranks[i] = rank((text[start:bounds[i + 2]], mid - start), _NO_MERGE)
            if i:
                before = bounds[i - 1]
                ranks[i - 1] = rank((text[before:mid], start - before), _NO_MERGE)

    def _by_heap(self, text: str, bounds: list[int]) -> list[int]:
        n, rank = len(bounds) - 1, self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [_NO_MERGE] * n             # of a part and the one after it; stale heap entries differ
        alive = [True] * n
        end = lambda i: bounds[after[i]]
        heap: list[tuple[int, int]] = []

        def refresh(i: int) -> None:
            j = after[i]
            ranks[i] = rank((text[bounds[i]:end(j)], bounds[j] - bounds[i]), _NO_MERGE) if j < n else _NO_MERGE
            if ranks[i] != _NO_MERGE:
                heapq.heappush(heap, (ranks[i], i))

        for i in range(n):
            refresh(i)
        while heap:
            least, i = heapq.heappop(heap)
            if not alive[i] or ranks[i] != least:
                continue
            gone = after[i]
            alive[gone], after[i] = False, after[gone]
            if after[i] < n:
                before[after[i]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        return [bounds[i] for i in range(n) if alive[i]] + bounds[-1:]


class Codec(dict):
    """Ids of words (little-endian unsigned 32-bit, by UTF-8 bytes), computed on first use.

    Takes definitions of byte-level BPE that drop white space and split at it first, so that a
    text's ids are its words' ids in order.  Special tokens are found in the text as written.
    """

    def __init__(self, definition: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        spec = json.loads(definition)
        model, added = spec["model"], spec["added_tokens"]
        if (model["type"] != "BPE" or spec["decoder"] or model["continuing_subword_prefix"] or model["byte_fallback"]
                or model["ignore_merges"] or model["dropout"] or not spec["normalizer"] or not spec["pre_tokenizer"]
                or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)):
            raise ValueError("not a byte-level BPE definition with white space dropped and no decoder")
        cleaner = Tokenizer.from_str(definition)
        self.normalize, self.pieces = cleaner.normalizer.normalize_str, cleaner.pre_tokenizer.pre_tokenize_str
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.marks = sorted({c[:2].encode() for c in self.special})
        self.tokens = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.known: dict[str, bytes] = {}      # ids by piece
        self.letters = byte_letters()

    def _of_piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            ids = [self.merges.vocab[p] for p in self.merges.parts(piece)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= _CACHED_BYTES:
                if len(self.known) >= _CACHED_WORDS:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _of_text(self, text: str) -> bytes:
        """Ids of a word or of the part of one between special tokens."""
        if _PLAIN.fullmatch(text):
            pieces = _PLAIN_PIECES.findall(text.lower())
            if not text.isascii():
                pieces = [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
            return self._of_piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._of_piece, pieces))
        return b"".join([self._of_piece(p) for p, _ in self.pieces(self.normalize(text))])

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if any(m in word for m in self.marks):
            found = b"".join(struct.pack("<I", self.special[s]) if s in self.special else self._of_text(s)
                             for s in self.at_special.split(text) if s)
        else:
            found = self._of_text(text)
        if len(word) <= _CACHED_BYTES:
            if len(self) >= _CACHED_WORDS:
                self.clear()              # costs time only
            self[word] = found
        return found

    def encode(self, text: bytes | None) -> bytes:
        # letters are lower-cased anyway; done first, it saves entries (special tokens keep their case)
        if text and not any(m in text for m in self.marks):
            text = text.lower()
        return b"".join(map(self.__getitem__, word_bytes(text)))

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces, as the library does without a decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[int, Codec] = {}


def _codec(definition: str) -> Codec:
    """One codec (and word cache) per Python worker."""
    key = hash(definition)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(definition)
    return _codecs[key]


def _shared_definition(df: DataFrame, tokenizer: str):
    """The definition's text, broadcast: a few MB whatever the data."""
    python_ready(df.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _in_batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (bytes, values) as batches of bounded size."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 40
        if size > _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row's whole text;
    ``with_text`` adds ``decoded``, the ids' own decoding, in the same pass.

    ``tokenizer`` is the path of a definition that the driver can read.  Null and empty texts have
    no ids; null doc_ids, repeated rows and extra columns make no difference; an empty table gives
    no rows.  Rows are independent: nothing is shuffled.
    """
    definition = _shared_definition(docs, tokenizer)
    rows = first_columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                        *([("decoded", pa.string())] if with_text else [])])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(definition.value)

        def each():
            for b in batches:
                for doc, text in zip(b.column("doc_id").to_pylist(), texts(b, "text")):
                    ids = codec.encode(text)
                    back = (codec.decode(ids),) if with_text else ()
                    yield len(ids) + sum(map(len, back)), (doc, len(ids) // 4, ids, *back)
        yield from _in_batches(each(), schema)

    return rows.mapInArrow(coded, "doc_id bigint, n_tokens bigint, ids binary" + (", decoded string" if with_text else ""))


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of every row of ids (as ``encode`` writes them).  Null ids decode
    to the empty text; an id that the definition lacks is an error."""
    definition = _shared_definition(encoded, tokenizer)
    rows = first_columns(encoded, doc_id=id_col, ids=ids_col).select(F.col("doc_id").cast("long"), "ids")
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(definition.value)

        def each():
            for b in batches:
                for doc, ids in zip(b.column("doc_id").to_pylist(), texts(b, "ids")):
                    back = codec.decode(ids or b"")
                    yield len(back), (doc, back)
        yield from _in_batches(each(), schema)

    return rows.mapInArrow(read, "doc_id bigint, decoded string")
