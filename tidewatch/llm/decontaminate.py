"""Benchmark decontamination: BM25 over test items, searched with every training passage.

The test items are the indexed documents; a passage of a training text is the query.  Each
posting holds the share of an item's own BM25 score that the word contributes, divided by the least
share that a leak of the item can have, so 1 is the threshold of every item and loses no leak.
Items are grouped into blocks, and each word has its greatest share per block.  A passage
whose block bounds stay below the threshold is never scored; the others run block-max WAND.
What is retrieved counts only if the item's question and answer both overlap the passage, in
common shingles or word by word in an alignment; where the answer is a made-up last quarter, also
if the passage has most of the item's shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm.common import first_columns, python_ready, saved, texts, word_bytes

K1, B = 1.2, 0.75
OVERLAP = 0.8            # share of the question's, and of the answer's, words that the passage has
SHINGLE = 5
LEAST_CLASS = 64         # items are searched by length class: up to 64 words, 128, 256 and so on
_MAX_BLOCKS = 512
_HALVES_AT_ONCE = 200      # of a text
_CACHED_WORDS = 400_000
_UNKNOWN, _BLANK = -1, -2
_EDIT, _WORD = 1 << 40, 1 << 20      # an alignment's changes and lost words, in one number


def normal_word(word: str) -> str:
    """Lower-case letters and digits of a word; empty if it has none."""
    word = word.lower()
    return word if word.isalnum() else re.sub(r"[\W_]+", "", word)


def item_words(text: str | None) -> list[str]:
    return [w for w in (normal_word(x.decode()) for x in word_bytes((text or "").encode())) if w]


def answer_start(text: str | None) -> int:
    """First word of the answer: of the last sentence that follows a question mark, else of the
    item's last quarter (five words at least, at most half of them)."""
    n = len(item_words(text))
    return asked_words(text) or n - min(max(SHINGLE, n // 4), n // 2)


def asked_words(text: str | None) -> int:
    """Words up to the last question mark; 0 if none of the words, or all of them, are."""
    asked = (text or "").rfind("?")
    at = len(item_words(text[:asked + 1])) if asked >= 0 else 0
    return at if at < len(item_words(text)) else 0


@dataclass
class Index:
    """Postings of one block of items, ready for workers."""
    words: dict[str, int]
    item_ids: list
    item_words: list[list[str]]
    answers: list[int]
    asked: list[bool]                           # the answer follows a question mark
    postings: list[list[tuple[int, float]]]     # per word: (item, share), by item
    block_size: int
    block_bounds: np.ndarray                    # word x block: greatest share
    passage: int                                # words; half of it is the step
    least: list[float]                          # per item: share of its BM25 score that counts as 1


def word_shares(items: DataFrame) -> DataFrame:
    """(item_no, word, share) of items (item_no, words array): BM25 weights divided by the item's
    own total.  Document frequencies are over all items."""
    n_items, mean_words = items.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    tf = (items.select("item_no", F.size("words").alias("n_words"), F.explode("words").alias("word"))
          .groupBy("item_no", "n_words", "word").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n_items - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / (mean_words or 1.0)))
    weighted = tf.join(df, "word").select("item_no", "word", weight.alias("weight"))
    return weighted.select("item_no", "word",
                           (F.col("weight") / F.sum("weight").over(W.partitionBy("item_no"))).alias("share"))


def length_class(n_words: int) -> int:
    """Words of the class that an item of this length is searched in; it depends on no other item."""
    size = LEAST_CLASS
    while size < n_words:
        size *= 2
    return size


def least_share(shares: list[float], n_words: int, overlap: float) -> float:
    """Least share of its own BM25 score that an item keeps in any passage that has ``overlap`` of its
    words: all but the heaviest that may be missing.  Retrieval by this bound loses no leak, whatever
    weights the other items give the words."""
    missing = int((1 - overlap) * n_words + 1e-9)
    return max(1.0 - sum(sorted(shares, reverse=True)[:missing]) - 1e-6, 1e-3)


def build_index(rows: list, shares: list, at_least: int = 4, overlap: float | None = None) -> Index:
    """Index of one block of items: rows (item_no, item_id, text), shares (item_no, word, share).
    Items are ordered by length, so a block's bounds are close to its items' shares.  With ``overlap``
    an item's shares are divided by its ``least_share``, so 1 is the threshold of every item."""
    rows = sorted(rows, key=lambda r: (len(item_words(r["text"])), r["item_no"]))
    place = {r["item_no"]: i for i, r in enumerate(rows)}
    words = {w: i for i, w in enumerate(sorted({s["word"] for s in shares}))}
    own: list[list[float]] = [[] for _ in rows]
    for s in shares:
        own[place[s["item_no"]]].append(s["share"])
    least = [1.0 if overlap is None else least_share(x, len(item_words(r["text"])), overlap) for x, r in zip(own, rows)]
    postings: list[list[tuple[int, float]]] = [[] for _ in words]
    for s in shares:
        at = place[s["item_no"]]
        postings[words[s["word"]]].append((at, s["share"] / least[at]))
    size = max(at_least, -(-len(rows) // _MAX_BLOCKS))
    bounds = np.zeros((len(words), -(-len(rows) // size)), dtype=np.float32)
    for w, found in enumerate(postings):
        found.sort()
        for item, share in found:
            bounds[w, item // size] = max(bounds[w, item // size], share)
    lengths = [item_words(r["text"]) for r in rows]
    return Index(words, [r["item_id"] for r in rows], lengths, [answer_start(r["text"]) for r in rows],
                 [asked_words(r["text"]) > 0 for r in rows], postings, size, bounds,
                 2 * length_class(max((len(x) for x in lengths), default=1)), least)


def block_max_wand(words: list[int], index: Index, threshold: float) -> list[tuple[int, float]]:
    """All items whose shares over the (distinct) words sum to the threshold or more.

    Cursors over the words' postings are kept in the order of their items.  The pivot is the first
    item that the words' greatest shares could lift to the threshold; if the pivot's block bounds
    cannot, the cursors leap behind that block, else the pivot is scored.
    """
    slack = threshold - 1e-6
    lists = [[index.postings[w], 0, float(index.block_bounds[w].max()), w] for w in words]
    out = []
    while True:
        lists = sorted((c for c in lists if c[1] < len(c[0])), key=lambda c: c[0][c[1]][0])
        total, pivot = 0.0, None
        for i, c in enumerate(lists):
            total += c[2]
            if total >= slack:
                pivot = i
                break
        if pivot is None:
            return out
        item = lists[pivot][0][lists[pivot][1]][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]][0] == item:
            pivot += 1
        block = item // index.block_size
        if sum(float(index.block_bounds[c[3], block]) for c in lists[:pivot + 1]) < slack:
            # nothing before the block's end, or before the next word's item, can reach it
            to = (block + 1) * index.block_size
            if pivot + 1 < len(lists):
                to = min(to, lists[pivot + 1][0][lists[pivot + 1][1]][0])
            to = max(to, item + 1)
        else:
            score = 0.0
            for c in lists[:pivot + 1]:
                _advance(c, item)
                if c[1] < len(c[0]) and c[0][c[1]][0] == item:
                    score += c[0][c[1]][1]
            if score >= slack:
                out.append((item, score))
            to = item + 1
        for c in lists[:pivot + 1]:
            _advance(c, to)


def _advance(cursor: list, item: int) -> None:
    postings, at = cursor[0], cursor[1]
    while at < len(postings) and postings[at][0] < item:
        at += 1
    cursor[1] = at


def overlaps(item: list[str], answer: int, passage: list[str], k: int = SHINGLE) -> tuple[float, float]:
    """Shares of the question's and of the answer's words that lie in a shingle of ``k`` words
    which the passage has too (items shorter than a shingle: in the whole sequence)."""
    k = min(k, len(item))
    there = {tuple(passage[i:i + k]) for i in range(len(passage) - k + 1)}
    covered = [False] * len(item)
    for i in range(len(item) - k + 1):
        if tuple(item[i:i + k]) in there:
            covered[i:i + k] = [True] * k
    share = lambda part: sum(part) / len(part) if part else 1.0
    return share(covered[:answer]), share(covered[answer:])


def contained(item: list[str], passage: list[str], k: int = SHINGLE) -> float:
    """Share of the item's shingles of ``k`` words that the passage has; 0 for shorter items."""
    there = {tuple(passage[i:i + k]) for i in range(len(passage) - k + 1)}
    found = [tuple(item[i:i + k]) in there for i in range(len(item) - k + 1)]
    return sum(found) / len(found) if found else 0.0


def aligned(item: list[str], answer: int, passage: list[str]) -> tuple[float, float]:
    """Shares of the question's and of the answer's words that stay when the whole item is aligned
    with a stretch of the passage by the fewest changed, left-out and added words (of equal
    alignments, the one that keeps most words)."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(item))}
    there = np.array([numbers.get(w, -1) for w in passage], dtype=np.int64)
    added = np.arange(len(there) + 1, dtype=np.int64) * _EDIT
    best = np.zeros(len(there) + 1, dtype=np.int64)
    for i, word in enumerate(item):
        lost = _EDIT + _WORD + (i >= answer)
        now = best + lost
        np.minimum(now[1:], best[:-1] + np.where(there == numbers[word], 0, lost), out=now[1:])
        best = np.minimum.accumulate(now - added) + added
    lost = int(best.min()) % _EDIT
    q_lost, a_lost = lost // _WORD - lost % _WORD, lost % _WORD
    share = lambda n, lost: (n - lost) / n if n else 1.0
    return share(answer, q_lost), share(len(item) - answer, a_lost)


def near_overlaps(item: list[str], answer: int, passage: list[str], least: float) -> tuple[float, float]:
    """The greater of ``overlaps`` and ``aligned``, per part.  Parts of a shingle's length or more
    are aligned on their own too, as other text may stand between them."""
    q, a = overlaps(item, answer, passage)
    there = set(passage)
    if min(q, a) >= least or any(sum(w in there for w in part) < least * len(part) for part in (item[:answer], item[answer:])):
        return q, a
    q_near, a_near = aligned(item, answer, passage)
    q, a = max(q, q_near), max(a, a_near)
    if q < least and answer >= SHINGLE:
        q = max(q, aligned(item[:answer], answer, passage)[0])
    if a < least and len(item) - answer >= SHINGLE:
        a = max(a, aligned(item[answer:], 0, passage)[1])
    return q, a


def _leak_schema(item_type: T.DataType) -> T.StructType:
    """Item ids keep their type."""
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", item_type),
                         *[T.StructField(n, T.DoubleType()) for n in ("score", "question_overlap", "answer_overlap")]])


class _WordNumbers(dict):
    """Raw word -> number in the index, unknown, or blank; forgets all when full."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        word = normal_word(raw.decode())
        number = self[raw] = self.words.get(word, _UNKNOWN) if word else _BLANK
        return number


class _Searcher:
    """Search of one worker in one block of items of a length class."""

    def __init__(self, index: Index, overlap: float):
        self.index, self.overlap = index, overlap
        self.numbers, self.bounds = _WordNumbers(index.words), index.block_bounds
        self.spelled = [w for w, _ in sorted(index.words.items(), key=lambda x: x[1])] + [""]

    def leaks(self, text: bytes | None) -> dict[int, tuple[float, float, float]]:
        """Leaked items: score, question overlap and answer overlap of the best passage."""
        index, words = self.index, word_bytes(text)
        ids = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        ids = ids[ids != _BLANK]
        found: dict[int, tuple[float, float, float]] = {}
        for lo, hi in self._able(ids):
            part = ids[lo:hi]
            for item, score in block_max_wand(np.unique(part[part >= 0]).tolist(), index, 1.0):
                own, passage = index.item_words[item], [self.spelled[i] for i in part]
                q, a = near_overlaps(own, index.answers[item], passage, self.overlap)
                if min(q, a) >= self.overlap or not index.asked[item] and contained(own, passage) >= self.overlap:
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score * index.least[item], q, a))
        return found

    def _able(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Passages that could reach the threshold within some block of items: the bounds of a
        passage's distinct words are summed for all passages of a text at once.

        A passage is two neighbouring halves.  Its sum is that of both halves' distinct words less
        that of the words which the second half shares with the first."""
        half, n_words = max(1, self.index.passage // 2), len(self.index.words)
        for at in range(0, len(ids), _HALVES_AT_ONCE * half):
            part = ids[at:at + (_HALVES_AT_ONCE + 1) * half]
            n = -(-len(part) // half)
            if at and n < 2:
                break
            places = np.flatnonzero(part >= 0)
            pairs = np.unique(places // half * n_words + part[places])     # (half, word), each once
            if not len(pairs):
                continue
            of_half, found = pairs // n_words, self.bounds[pairs % n_words]
            again = np.isin(pairs - n_words, pairs, assume_unique=True)
            sums = _sums_by(of_half, found, n + 1)
            able = sums[:-1] + sums[1:] - _sums_by(of_half[again], found[again], n + 1)[1:]
            able = np.flatnonzero(able[:max(1, n - 1)].max(axis=1) >= 1.0 - 1e-4)
            for lo in (at + able * half).tolist():
                yield lo, min(lo + 2 * half, len(ids))


def _sums_by(group: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each group 0..n-1; groups are in order."""
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    if len(group):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def _leak_rows(shared, overlap: float, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Searcher(shared.value, overlap)
        for b in batches:
            out = [(doc, search.index.item_ids[item], *found)
                   for doc, text in zip(b.column("doc_id").to_pylist(), texts(b, "text"))
                   for item, found in sorted(search.leaks(text).items())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out
                else [pa.array([], f.type) for f in schema], schema=schema)
    return rows


def _clean_rows(shared, overlap: float, text_col: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Searcher(shared.value, overlap)
        for b in batches:
            yield b.filter(pa.array([not search.leaks(t) for t in texts(b, text_col)], pa.bool_()))
    return rows


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [item_words(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("item_id"), b.column("text"), pa.array(words, pa.list_(pa.string())),
             pa.array([length_class(len(w)) for w in words], pa.int32())], names=["item_id", "text", "words", "size"])


def _indexes(items: DataFrame, item_id_col: str, item_text_col: str, items_at_once: int, overlap: float) -> Iterator[Index]:
    """Indexes of blocks of at most about ``items_at_once`` items, each of one length class."""
    python_ready(items.sparkSession)
    named = first_columns(items, item_id=item_id_col, text=item_text_col)
    numbered = (named.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
                .select("item_id", "text")
                .mapInArrow(_item_rows, T.StructType([*named.schema.fields, T.StructField("words", T.ArrayType(T.StringType())),
                                                      T.StructField("size", T.IntegerType())]))
                .where(F.size("words") >= SHINGLE).withColumn("item_no", F.xxhash64("text")))
    numbered = saved(numbered)
    shares = saved(word_shares(numbered.select("item_no", "words")).join(numbered.select("item_no", "size"), "item_no"))
    for r in numbered.groupBy("size").count().orderBy("size").collect():       # one row a class
        blocks = max(1, -(-r["count"] // items_at_once))
        for k in range(blocks):
            part = (F.pmod(F.col("item_no"), F.lit(blocks)) == k) & (F.col("size") == r["size"])
            rows = numbered.where(part).select("item_no", "item_id", "text").collect()
            if rows:
                yield build_index(rows, shares.where(part).collect(), overlap=overlap)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", overlap: float = OVERLAP,
               items_at_once: int = 2_000) -> DataFrame:
    """One row per text and leaked item: doc_id, item_id (of its own type), score (best passage's share of
    the item's BM25 score), question_overlap, answer_overlap.  Both overlaps reach ``overlap``, or the
    item has no answer after a question mark and the passage has that share of its shingles.

    Every text is searched whole, in passages of twice the item's length class that step by half of
    that, so an item is never cut by a passage's end.  Retrieval takes every item whose BM25 share reaches
    the least that such overlaps leave it, so which items leak does not depend on what else is in the table
    (scores do: BM25 weighs words by it).  Words are compared as lower-case letters and digits.  Items of
    fewer than five words match nothing: any text may hold them.  Items are taken ``items_at_once`` per pass
    over the texts (only one such block is ever broadcast).  Null or blank texts and items match nothing;
    repeated texts are reported each; items with one text are one item under its smallest item_id; empty
    tables give no rows.
    """
    spark = docs.sparkSession
    python_ready(spark)
    rows = first_columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    schema = _leak_schema(items.schema[item_id_col].dataType)
    out = spark.createDataFrame([], schema)
    for n, index in enumerate(_indexes(items, item_id_col, item_text_col, items_at_once, overlap)):
        found = rows.mapInArrow(_leak_rows(spark.sparkContext.broadcast(index), overlap, to_arrow_schema(schema)), schema)
        out = out.union(found) if n else found
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", overlap: float = OVERLAP, items_at_once: int = 2_000) -> DataFrame:
    """The rows (all columns) without a leak as ``find_leaks`` defines it; nothing is shuffled."""
    spark = docs.sparkSession
    out = docs
    for index in _indexes(items, item_id_col, item_text_col, items_at_once, overlap):
        shared = spark.sparkContext.broadcast(index)
        out = out.mapInArrow(_clean_rows(shared, overlap, text_col), docs.schema)
    return out
