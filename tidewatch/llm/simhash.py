"""SimHash near-duplicates by anchor points.

Anchors are the words of a covering code of 64 bits: the direct product of perfect codes
(two binary Golay codes of 23 bits and two repetition codes of 9), so every fingerprint
has one nearest anchor, its home, at most 3 + 3 + 4 + 4 = 14 bits away.  If two
fingerprints differ in t bits at most, the home of one is within its distance plus t of the
other.  So every fingerprint is replicated to all anchors that can be the home of a
fingerprint within t bits (per block: within the block's covering radius plus its share of
the t bits), and per anchor the homes are compared with the replicas.  No link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.blobs import by_bucket, joined, mixed
from tidewatch.llm.common import first_columns, fresh, python_ready, saved, shuffle_partitions, texts
from tidewatch.llm.components import component_of
from tidewatch.operators.joins import small_side

#: Perfect codes per block, 64 bits together.  FINE has 2^36 anchors and about 165 replicas of a
#: fingerprint at 2 bits; COARSE 2^26 anchors and about 70.  Both find every link.
COARSE = ("golay23", "golay23", "repeat9", "repeat9")
FINE = ("golay23", "golay23", "hamming15", "repeat3")
_GOLAY_POLYNOMIAL = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_PAIRS_AT_ONCE = 2_000_000


def _syndromes(code: str) -> tuple[list[int], int]:
    """(syndrome of each bit, covering radius)."""
    n = int("".join(c for c in code if c.isdigit()))
    if code.startswith("golay"):
        out, x = [], 1
        for _ in range(n):
            out.append(x)
            x <<= 1
            if x >> 11:
                x ^= _GOLAY_POLYNOMIAL
        return out, 3
    if code.startswith("hamming"):
        return [i + 1 for i in range(n)], 1
    return [1 << i for i in range(n - 1)] + [(1 << (n - 1)) - 1], n // 2


class _Block:
    """Error patterns of one block by syndrome and by excess over the covering radius."""

    def __init__(self, code: str, shift: int, threshold: int):
        columns, radius = _syndromes(code)
        self.shift, self.n = shift, len(columns)
        self.low = _xor_table(columns[:12])
        self.high = _xor_table(columns[12:])
        found: list[list[tuple[int, int]]] = [[] for _ in range(threshold + 1)]
        for weight in range(min(self.n, radius + threshold) + 1):
            for places in combinations(range(self.n), weight):
                syndrome = error = 0
                for p in places:
                    syndrome ^= columns[p]
                    error |= 1 << p
                found[max(0, weight - radius)].append((syndrome, error))
        size = 1 << max(x.bit_length() for x in columns)
        self.lists = []
        for pairs in found:
            pairs.sort()
            s = np.array([p[0] for p in pairs], dtype=np.int64)
            errors = np.array([p[1] for p in pairs], dtype=np.uint64) << np.uint64(shift)
            counts = np.bincount(s, minlength=size)
            self.lists.append((np.concatenate([[0], np.cumsum(counts)[:-1]]), counts, errors))
        assert (self.lists[0][1] == 1).all(), "the code is not perfect"

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        word = (x >> np.uint64(self.shift)) & np.uint64((1 << self.n) - 1)
        return self.low[(word & np.uint64(0xFFF)).astype(np.int64)] ^ self.high[(word >> np.uint64(12)).astype(np.int64)]


def _xor_table(columns: list[int]) -> np.ndarray:
    out = np.zeros(1, dtype=np.int64)
    for c in columns:
        out = np.concatenate([out, out ^ c])
    return out


@lru_cache(maxsize=4)
def _blocks(code: tuple[str, ...], threshold: int) -> list[_Block]:
    out, shift = [], 0
    for name in code:
        out.append(_Block(name, shift, threshold))
        shift += out[-1].n
    assert shift == 64
    return out


def anchors(fingerprints: np.ndarray, threshold: int, code: tuple[str, ...] = COARSE
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each fingerprint, index of a fingerprint, anchor it is replicated to)."""
    blocks = _blocks(code, threshold)
    syndromes = [b.syndrome(fingerprints) for b in blocks]
    leader = np.zeros(len(fingerprints), dtype=np.uint64)
    leaders = [b.lists[0][2][b.lists[0][0][s]] for b, s in zip(blocks, syndromes)]
    for x in leaders:
        leader ^= x
    home = fingerprints ^ leader
    everyone = np.arange(len(fingerprints))
    at, to = [everyone], [home]

    def further(index: np.ndarray, anchor: np.ndarray, first: int, left: int) -> None:
        for k in range(first, len(blocks)):
            for excess in range(1, left + 1):
                starts, counts, errors = blocks[k].lists[excess]
                s = syndromes[k][index]
                n = counts[s]
                which = np.repeat(np.arange(len(index)), n)
                within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                # this block's part of the anchor changes from the leader's to another word
                moved = anchor[which] ^ leaders[k][index[which]] ^ errors[starts[s][which] + within]
                at.append(index[which])
                to.append(moved)
                if left > excess and k + 1 < len(blocks):
                    further(index[which], moved, k + 1, left - excess)

    further(everyone, home, 0, threshold)
    return home, np.concatenate(at), np.concatenate(to)


def fingerprint(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """SimHash of the word shingles (A-Z lower-cased); fewer words than a shingle: of the whole
    sequence; no word: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = [0, *ends[:len(words) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())),
                         dtype=np.uint64, count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo:lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_rows(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, shingle) for x in texts(b, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"])
    return rows


def _fingerprinted(shingle: int, text_col: str, name: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, shingle) for x in texts(b, text_col)], dtype=np.uint64)
            yield b.append_column(name, pa.array(found.view(np.int64), pa.int64()))
    return rows


def _replicas(threshold: int, code: tuple[str, ...], buckets: int, at_once: int = 20_000):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(every), at_once):
                fps = every[lo:lo + at_once]
                home, index, to = anchors(fps, threshold, code)
                out: dict[str, list] = {"bucket": [], "is_home": [], "anchors": [], "fps": []}
                for is_home, a, f in ((True, home, fps), (False, to, fps[index])):
                    spread = (mixed(a) % np.uint64(buckets)).astype(np.int32)
                    for bucket, (x, y) in by_bucket(spread, a, f):
                        for key, value in zip(out, (bucket, is_home, x.tobytes(), y.tobytes())):
                            out[key].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=_REPLICA_ARROW)
    return rows


_REPLICA_ARROW = pa.schema([("bucket", pa.int32()), ("is_home", pa.bool_()), ("anchors", pa.binary()),
                            ("fps", pa.binary())])
_REPLICA = "bucket int, is_home boolean, anchors binary, fps binary"


class Forest:
    """Union-find over 0..n-1 that takes arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._top(a), self._top(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def _top(self, x: np.ndarray) -> np.ndarray:
        top = self.root[x]
        while True:
            up = self.root[top]
            if (up == top).all():
                self.root[x] = top
                return top
            top = up

    def tops(self) -> np.ndarray:
        return self._top(np.arange(len(self.root)))


def _near(threshold: int):
    """Masks of all non-empty sets of at most ``threshold`` bits."""
    masks = [sum(1 << p for p in places) for n in range(1, threshold + 1) for places in combinations(range(64), n)]
    return np.array(masks, dtype=np.uint64)


def links_at_anchors(home_anchor: np.ndarray, home_fp: np.ndarray, anchor: np.ndarray, fp: np.ndarray,
                     threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that meet at an anchor, as a forest: (fingerprint, smallest
    fingerprint it is connected with here).

    Homes and replicas of an anchor are compared in slices.  Where an anchor has more replicas
    than there are patterns of ``threshold`` bits, the patterns are looked up instead, so the
    work stays in proportion to the fingerprints.
    """
    order = np.lexsort((fp, anchor))
    anchor, fp = anchor[order], fp[order]
    lo = np.searchsorted(anchor, home_anchor, "left")
    n = np.searchsorted(anchor, home_anchor, "right") - lo
    nodes = np.unique(np.concatenate([fp, home_fp]))
    forest = Forest(len(nodes))
    masks = _near(threshold)
    crowded = n > 4 * len(masks)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        forest.link(np.searchsorted(nodes, a), np.searchsorted(nodes, b))

    # slices of homes with a bounded number of pairs
    few = np.flatnonzero(~crowded & (n > 1))
    total = np.cumsum(n[few])
    start = 0
    while start < len(few):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _PAIRS_AT_ONCE, "right")))
        part = few[start:stop]
        which = np.repeat(part, n[part])
        place = np.arange(len(which)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + lo[which]
        a, b = home_fp[which], fp[place]
        near = (np.bitwise_count(a ^ b) <= threshold) & (a != b)
        link(a[near], b[near])
        start = stop
    for k in np.flatnonzero(crowded):
        there = fp[lo[k]:lo[k] + n[k]]
        wanted = home_fp[k] ^ masks
        at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
        hit = wanted[there[at] == wanted]
        link(np.full(len(hit), home_fp[k], dtype=np.uint64), hit)
    top = nodes[forest.tops()]
    joined_up = top != nodes
    return nodes[joined_up], top[joined_up]


def _forest_rows(threshold: int):
    def rows(group: pa.Table) -> pa.Table:
        is_home = np.array(group.column("is_home").to_pylist(), dtype=bool)
        a, f = group.column("anchors").to_pylist(), group.column("fps").to_pylist()
        pick = lambda values, want: joined((v for v, h in zip(values, is_home) if h == want), np.uint64)
        x, y = links_at_anchors(pick(a, True), pick(f, True), pick(a, False), pick(f, False), threshold)
        return pa.table({"a": x.view(np.int64), "b": y.view(np.int64)})
    return rows


#: Distinct fingerprints whose replicas (some 70 to 165 each) one bucket holds on average.
_BUCKET_FINGERPRINTS = 40_000
#: Ids up to which a counted list of them is broadcast.
_BROADCAST_IDS = 1_000_000
#: A fingerprint of more than this share of all rows is looked up by broadcast: there are fewer than
#: 1 / share of them.
_HOT_SHARE = 0.001


def fingerprint_links(fps: DataFrame, threshold: int, code: tuple[str, ...] = COARSE,
                      buckets: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``, bigint) of at most ``threshold``
    differing bits: enough of them to connect whatever is connected."""
    # the number of buckets grows with the fingerprints, so that a bucket, one group in memory, does not
    buckets = buckets or max(2 * shuffle_partitions(fps.sparkSession), -(-fps.count() // _BUCKET_FINGERPRINTS))
    python_ready(fps.sparkSession)
    return (fps.select("fp").mapInArrow(_replicas(threshold, code, buckets), _REPLICA)
            .groupBy("bucket").applyInArrow(_forest_rows(threshold), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", code: tuple[str, ...] = COARSE) -> DataFrame:
    """doc_id, fp (bigint) and component_id of every row.

    Fingerprints of at most ``threshold`` differing bits are linked; component_id is the
    smallest doc_id that links reach, its own included.  Null or blank text: fingerprint 0,
    linked like any other.  Repeated rows have one fingerprint and one component; a null doc_id
    takes part but never names a component unless all of its members are null.
    """
    python_ready(docs.sparkSession)
    rows = first_columns(docs, doc_id=id_col, text=text_col)
    of_doc = saved(rows.mapInArrow(_fingerprint_rows(shingle), "doc_id bigint, fp bigint"))
    return _components(of_doc, threshold, code)


def _components(of_doc: DataFrame, threshold: int, code: tuple[str, ...]) -> DataFrame:
    """doc_id, fp and component_id of kept rows (doc_id, fp)."""
    # one row per fingerprint before anything is replicated: copies cost nothing further on
    distinct = saved(of_doc.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("rows")))
    found = component_of(fingerprint_links(distinct, threshold, code), "a", "b")
    # only linked fingerprints need their component's smallest document
    member = distinct.join(found, distinct["fp"] == found["node"]).select("fp", "component", "first_doc")
    smallest = member.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    linked = member.join(smallest, "component").select("fp", "component_id")
    own = (distinct.join(linked, "fp", "left")
           .select("fp", "rows", F.coalesce("component_id", "first_doc").alias("component_id")))
    # a fingerprint that very many rows share would be one task of the join
    n = distinct.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") > max(1000, int(n * _HOT_SHARE))
    of_hot = own.where(hot).select("fp", F.col("component_id").alias("_hot_id"), F.lit(True).alias("_hot"))
    marked = of_doc.join(F.broadcast(of_hot), "fp", "left")
    rest = marked.where(F.col("_hot").isNull()).select("doc_id", "fp").join(own.where(~hot).select("fp", "component_id"), "fp")
    return (rest.select("doc_id", "fp", "component_id")
            .unionByName(marked.where("_hot").select("doc_id", "fp", F.col("_hot_id").alias("component_id"))))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 2, id_col: str = "doc_id",
                         text_col: str = "text", code: tuple[str, ...] = COARSE) -> DataFrame:
    """One row (all columns) of each component of ``near_duplicates``: the one of the smallest doc_id.

    Of repeated rows one stays.  Where all members of a component lack an id, one row of each
    distinct fingerprint stays.  An empty table stays empty.

    Texts are fingerprinted once.  Rows whose id is theirs alone are settled by it: the ids that go are
    subtracted, by broadcast up to a counted number of ids (texts are then not moved), else by a shuffled join.
    Only rows without an id, or with a repeated one, are
    fingerprinted again and told apart by (id, fingerprint).
    """
    python_ready(docs.sparkSession)
    key, fp, nth = fresh(docs, "key", "fp", "nth")
    named = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias(key)
    rows = first_columns(docs, doc_id=id_col, text=text_col)
    of_doc = saved(rows.mapInArrow(_fingerprint_rows(shingle), "doc_id bigint, fp bigint"))
    settled = saved(_components(of_doc, threshold, code))
    shared = saved(of_doc.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
                   .where("_n > 1").select("doc_id"))
    gone = (settled.where(F.col("doc_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select("doc_id").unionByName(shared))
    gone, shared = (small_side(ids.withColumnRenamed("doc_id", key), _BROADCAST_IDS) for ids in (gone, shared))
    single = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col) == F.col(key), "left_anti")
    odd = docs.join(shared, F.col(id_col) == F.col(key), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    stays = (settled.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .select(named(F.col("doc_id")), F.col("fp").alias(fp)).distinct())
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])
    again = odd.mapInArrow(_fingerprinted(shingle, text_col, fp), schema)
    again = again.select(*again.columns, named(F.col(id_col))).join(stays, [key, fp], "left_semi")
    one = F.row_number().over(W.partitionBy(key, fp).orderBy(id_col))
    again = again.withColumn(nth, one).where(F.col(nth) == 1).select(*docs.columns)
    return single.select(*docs.columns).unionByName(again)
