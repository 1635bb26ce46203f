"""Substring dedup: Rabin-Karp fingerprints of every window of words, counted in Spark.

Each map task rolls a polynomial hash over its texts (random 64-bit word values, odd base,
modulus 2^64), keeps the first window of each hash it meets, and marks the others at once.
What is left travels as packed arrays to the hash's bucket, where the window that starts
first in the corpus survives and all others are marked.  The marks travel back to their
documents and merge into maximal removal intervals there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blobs import by_bucket, joined, mixed
from tidewatch.llm.common import first_columns, python_ready, shuffle_partitions, texts, word_bytes

_BASE = 0x9E3779B97F4A7C15                     # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_NO_ID = np.iinfo(np.int64).max
_WORDS_AT_ONCE = 1_000_000
_CACHED_WORDS = 400_000
_ROW = "bucket int, kind int, doc_id bigint, payload binary"
_ROW_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("payload", pa.binary())])
_WINDOWS, _MARKS, _TEXT = 0, 1, 2
#: One marked window: document, checksum of its text, first word.
_MARK = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("start", "<u4")])


def _compress(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _decompress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _WordValues(dict):
    """Word -> random 64-bit value; forgets all when full, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 1)
        return value


_values = _WordValues()
_powers = {_BASE: np.ones(1, dtype=np.uint64), _INVERSE: np.ones(1, dtype=np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have if len(have) <= 4 * _WORDS_AT_ONCE else have[:4 * _WORDS_AT_ONCE]
    return have[:n]


def word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_values.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(values: np.ndarray, window: int) -> np.ndarray:
    """Hash of every window: sum of value * base^place, all from one running sum."""
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _power(_BASE, len(values)), dtype=np.uint64)])
    return mixed((sums[window:] - sums[:-window]) * _power(_INVERSE, n))


def _target(doc: np.ndarray, targets: int) -> np.ndarray:
    return (mixed(doc.view(np.uint64)) % np.uint64(targets)).astype(np.int32)


def _mark_rows(doc, crc, start, targets: int) -> list[tuple]:
    marks = np.empty(len(doc), dtype=_MARK)
    marks["doc"], marks["crc"], marks["start"] = doc, crc, start
    return [(t, _MARKS, None, m.tobytes()) for t, (m,) in by_bucket(_target(marks["doc"].copy(), targets), marks)]


def _first_of_each(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows come ordered by (document, start).  (indices to keep, indices of later windows):
    a window is later if one of the same hash starts before it; windows that share the first
    place (rows with one id) are all kept."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    new = np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (doc[order] != doc[first]) | (start[order] != start[first])
    return order[~later], order[later]


def _window_rows(window: int, buckets: int, targets: int):
    def flush(held: list) -> pa.RecordBatch:
        held.sort(key=lambda d: d[0])
        sizes = np.array([len(d[2]) for d in held])
        values = np.concatenate([d[2] for d in held])
        ends = np.cumsum(sizes)
        doc_of = np.repeat(np.arange(len(held)), sizes)
        start = np.arange(len(values)) - np.repeat(ends - sizes, sizes)
        whole = start + window <= np.repeat(sizes, sizes)
        hashes = rolling(values, window)
        at = np.flatnonzero(whole[:len(hashes)])
        hashes, doc_of, start = hashes[at], doc_of[at], start[at].astype(np.uint32)
        ids = np.array([d[0] for d in held], dtype=np.int64)
        crcs = np.array([d[1] for d in held], dtype=np.uint32)
        keep, later = _first_of_each(hashes, ids[doc_of], start)
        rows = _mark_rows(ids[doc_of[later]], crcs[doc_of[later]], start[later], targets)
        keep.sort()
        hashes, doc_of, start = hashes[keep], doc_of[keep], start[keep]
        for bucket, (h, d, s) in by_bucket((hashes % np.uint64(buckets)).astype(np.int32), hashes, doc_of, start):
            rows.append((bucket, _WINDOWS, None, _packed(ids, crcs, d, s, h)))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW_ARROW)] if rows
            else [pa.array([], f.type) for f in _ROW_ARROW], schema=_ROW_ARROW)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b, "text")):
                words = word_bytes(text)
                if len(words) < window:
                    continue
                held.append((_NO_ID if doc is None else doc, zlib.crc32(text), word_values(words)))
                n += len(words)
                if n >= _WORDS_AT_ONCE:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)
    return rows


def _packed(ids: np.ndarray, crcs: np.ndarray, doc_of: np.ndarray, start: np.ndarray, hashes: np.ndarray) -> bytes:
    """Windows ordered by (document, start) as bytes.  Per document its id, checksum and number
    of windows; ids and places as steps, which compress to about a byte; hashes do not compress."""
    cut = np.flatnonzero(np.concatenate([[True], doc_of[1:] != doc_of[:-1]]))
    counts = np.diff(np.append(cut, len(doc_of))).astype(np.uint32)
    id_steps = np.diff(ids[doc_of[cut]], prepend=np.int64(0))
    steps = np.diff(start.astype(np.int64), prepend=0)
    steps[cut] = start[cut]
    places = _compress(b"".join(x.tobytes() for x in (id_steps, crcs[doc_of[cut]], counts, steps.astype(np.uint32))))
    return np.array([len(cut), len(doc_of), len(places)], dtype=np.uint32).tobytes() + places + hashes.tobytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, ...]:
    """(document, checksum, start, hash) of every window."""
    n_docs, n, size = np.frombuffer(payload, np.uint32, 3).tolist()
    places, at, out = _decompress(payload[12:12 + size]), 0, []
    for dtype, k in ((np.int64, n_docs), (np.uint32, n_docs), (np.uint32, n_docs), (np.uint32, n)):
        out.append(np.frombuffer(places, dtype, k, at))
        at += k * np.dtype(dtype).itemsize
    id_steps, crcs, counts, steps = out
    ids = np.cumsum(id_steps, dtype=np.int64)
    total = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(counts, dtype=np.int64) - counts
    start = (total - np.repeat(total[first] - steps[first], counts)).astype(np.uint32)
    return np.repeat(ids, counts), np.repeat(crcs, counts), start, np.frombuffer(payload, np.uint64, n, 12 + size)


def _settle(targets: int):
    """One bucket of hashes: marks of every window but the first of its hash."""
    def rows(group: pa.Table) -> pa.Table:
        kinds, payloads = group.column("kind").to_pylist(), group.column("payload").to_pylist()
        out = [(b, _MARKS, None, p) for b, k, p in zip(group.column("bucket").to_pylist(), kinds, payloads)
               if k == _MARKS]
        parts = [_unpacked(p) for k, p in zip(kinds, payloads) if k == _WINDOWS]
        if parts:
            doc, crc, start, hashes = (np.concatenate(x) for x in zip(*parts))
            # only hashes that come twice need the order of documents
            order = np.argsort(hashes, kind="stable")
            same = hashes[order][1:] == hashes[order][:-1]
            twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            twice = twice[np.lexsort((start[twice], doc[twice]))]
            _, later = _first_of_each(hashes[twice], doc[twice], start[twice]) if len(twice) else (None, twice)
            at = twice[later]
            out += _mark_rows(doc[at], crc[at], start[at], targets)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROW_ARROW)] if out
                                    else [pa.array([], f.type) for f in _ROW_ARROW], schema=_ROW_ARROW)
    return rows


def _text_rows(targets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = np.array([_NO_ID if d is None else d for d in b.column("doc_id").to_pylist()], dtype=np.int64)
            packed = [None if t is None else _compress(t) for t in texts(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_target(doc, targets)), pa.array([_TEXT] * len(doc), pa.int32()), b.column("doc_id"),
                 pa.array(packed, pa.binary())], schema=_ROW_ARROW)
    return rows


def intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Union of the windows at the (sorted, distinct) starts, as maximal intervals."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts.astype(np.int64)) > window) + 1
    lo = starts[np.concatenate([[0], cut])]
    hi = starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    return [(int(a), int(b) + window) for a, b in zip(lo, hi)]


_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept_text string"
_RESULT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])


def _removed(window: int):
    """Rows arrive ordered by target, marks before texts."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, blobs, marked = None, [], None
        for b in batches:
            out, size = [], 0
            for t, kind, doc, payload in zip(*(c.to_pylist() for c in b.columns)):
                if t != target:
                    target, blobs, marked = t, [], None
                if kind == _MARKS:
                    blobs.append(payload)
                    continue
                if marked is None:
                    marked, blobs = _marks_by_doc(blobs), []
                text = None if payload is None else _decompress(payload)
                words = word_bytes(text)
                starts = marked.get((_NO_ID if doc is None else doc, zlib.crc32(text or b"")))
                gone = intervals(np.unique(starts), window) if starts is not None else []
                if gone:
                    kept, at = [], 0
                    for lo, hi in gone:
                        kept += words[at:lo]
                        at = hi
                    kept += words[at:]
                else:
                    kept = words
                line = b" ".join(kept).decode()
                out.append((doc, len(words), len(words) - len(kept),
                            [{"start": lo, "end": hi} for lo, hi in gone], line))
                size += len(line)
                if size > 8_000_000:
                    yield _result(out)
                    out, size = [], 0
            if out:
                yield _result(out)
    return rows


def _result(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT_ARROW)],
                                      schema=_RESULT_ARROW)


def _marks_by_doc(blobs: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    marks = joined(blobs, _MARK)
    if not len(marks):
        return {}
    marks = marks[np.lexsort((marks["crc"], marks["doc"]))]
    cut = np.flatnonzero((np.diff(marks["doc"]) != 0) | (marks["crc"][1:] != marks["crc"][:-1])) + 1
    return {(int(m["doc"][0]), int(m["crc"][0])): m["start"] for m in np.split(marks, cut)}


#: Bytes of text whose windows one bucket holds: a bucket is one group in memory.
_BUCKET_BYTES = 12_000_000


def _buckets(rows: DataFrame) -> int:
    """Hash buckets for the windows: their number grows with the text, so that a bucket does not."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * shuffle_partitions(rows.sparkSession), -(-size // _BUCKET_BYTES))


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                     buckets: int | None = None) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier
    (smaller doc_id, or the same document at a smaller place), judged on the input.

    Returns doc_id, n_words, n_removed, removed (maximal intervals of word places, end
    exclusive) and kept_text (kept words joined by one space).

    Null or blank text: no words, kept_text empty.  Texts shorter than a window lose
    nothing.  A null doc_id comes after all others.  Rows with one id are one document:
    identical ones get the same result, none removes the other's words at the same place.
    Equal windows are told by 64-bit hashes; two different ones agree with a chance of about
    2^-58, so over n distinct windows n^2 / 2^59 false matches are expected.
    """
    spark = docs.sparkSession
    python_ready(spark)
    rows = first_columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    buckets = buckets or _buckets(rows)
    marks = (rows.mapInArrow(_window_rows(window, buckets, buckets), _ROW)
             .groupBy("bucket").applyInArrow(_settle(buckets), _ROW))
    packed = rows.mapInArrow(_text_rows(buckets), _ROW)
    return (marks.union(packed).repartition(shuffle_partitions(spark), "bucket")
            .sortWithinPartitions("bucket", "kind")
            .mapInArrow(_removed(window), _RESULT))
