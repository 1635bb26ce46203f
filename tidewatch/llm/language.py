"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram binds its letters' vectors,
rotated by their place, into one by multiplication; a text bundles its trigrams' vectors by
addition; a language's prototype bundles all its training texts.  A text gets the
language of the prototype with the greatest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm.common import first_columns, python_ready

DIMENSIONS = 1024
UNKNOWN = "und"
_CHARS_AT_ONCE = 2_000_000
_VECTORS_AT_ONCE = 32_768       # of distinct trigrams
_KEPT_LETTERS = 20_000
_SPACE = 32


class _State:
    letters: dict[tuple[int, int, int], np.ndarray] = {}
    is_letter: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    if _State.is_letter is None:
        _State.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _State.is_letter


def letter_vector(code_point: int, dimensions: int, seed: int) -> np.ndarray:
    key = (code_point, dimensions, seed)
    if key not in _State.letters:
        if len(_State.letters) >= _KEPT_LETTERS:
            _State.letters.clear()
        bits = np.random.Generator(np.random.Philox(key=seed, counter=code_point)).integers(0, 2, dimensions, dtype=np.int8)
        _State.letters[key] = 2 * bits - 1
    return _State.letters[key]


def trigram_vectors(trigrams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """One row per packed trigram (three code points of 21 bits)."""
    out = np.ones((len(trigrams), dimensions), dtype=np.float32)
    for place, shift in enumerate((42, 21, 0)):
        code_points = (trigrams >> np.uint64(shift)) & np.uint64(0x1FFFFF)
        found, at = np.unique(code_points, return_inverse=True)
        table = np.stack([np.roll(letter_vector(int(c), dimensions, seed), 2 - place) for c in found])
        out *= table[at]
    return out


def trigrams(text: str) -> np.ndarray:
    """Packed trigrams of the lower-cased letters, with a space for every run of others and at
    both ends.  A text without letters has none."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.where(_is_letter()[points], points, _SPACE)
    if not (letters != _SPACE).any():
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([[_SPACE], letters, [_SPACE]]).astype(np.uint64)
    padded = padded[np.concatenate([[True], (padded[1:] != _SPACE) | (padded[:-1] != _SPACE)])]
    return (padded[:-2] << np.uint64(42)) | (padded[1:-1] << np.uint64(21)) | padded[2:]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, trigrams of each row) of a batch whose last column is the text, a bounded
    number of characters at a time."""
    first, grams, size = 0, [], 0
    for at, text in enumerate(batch.column(batch.num_columns - 1)):
        text = text.as_py()
        grams.append(trigrams(text) if text else np.zeros(0, dtype=np.uint64))
        size += len(grams[-1])
        if size >= _CHARS_AT_ONCE:
            yield first, grams
            first, grams, size = at + 1, [], 0
    if grams:
        yield first, grams


def _coded(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, found = pd.factorize(np.concatenate(grams)) if grams else (np.zeros(0, int), np.zeros(0, np.uint64))
    return codes, np.asarray(found, dtype=np.uint64)


def _vector_blocks(found: np.ndarray, dimensions: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first code, vectors) of a bounded number of distinct trigrams at a time."""
    for at in range(0, len(found), _VECTORS_AT_ONCE):
        yield at, trigram_vectors(found[at:at + _VECTORS_AT_ONCE], dimensions, seed)


def _text_vectors(grams: list[np.ndarray], dimensions: int, seed: int) -> np.ndarray:
    """Sum of each text's trigram vectors."""
    codes, found = _coded(grams)
    parts = np.split(codes, np.cumsum([len(g) for g in grams])[:-1]) if grams else []
    out = np.zeros((len(grams), dimensions), dtype=np.float32)
    for at, vectors in _vector_blocks(found, dimensions, seed):
        for row, part in enumerate(parts):
            if len(vectors) < len(found):
                part = part[(part >= at) & (part < at + len(vectors))] - at
            counts = np.bincount(part, minlength=len(vectors))
            used = np.flatnonzero(counts)
            if len(used):
                out[row] += counts[used].astype(np.float32) @ vectors[used]
    return out


def _bundles(dimensions: int, seed: int):
    """Sum of the text vectors per language, one row per language and task."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for langs, grams in ((b.column(0).slice(at, len(grams)), grams) for b in batches for at, grams in _slices(b)):
            codes, found = _coded(grams)
            names, which = np.unique(langs.to_pylist(), return_inverse=True)
            per_gram = np.repeat(which, [len(g) for g in grams])
            counts = np.bincount(per_gram * len(found) + codes, minlength=len(names) * len(found)).reshape(len(names), -1)
            sums = np.zeros((len(names), dimensions))
            for at, vectors in _vector_blocks(found, dimensions, seed):
                sums += counts[:, at:at + len(vectors)].astype(np.float64) @ vectors
            for name, s in zip(names.tolist(), sums):
                total[name] = total.get(name, 0) + s
        yield pa.RecordBatch.from_pydict(
            {"lang": list(total), "bundle": [np.rint(v).astype(np.int64).tolist() for v in total.values()]},
            schema=pa.schema([("lang", pa.string()), ("bundle", pa.list_(pa.int64()))]))
    return rows


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                     dimensions: int = DIMENSIONS, seed: int = 11, max_languages: int = 4096) -> dict[str, np.ndarray]:
    """Prototype of every language, from all rows with a language and a text.  A row labelled ``und``
    names no language and teaches nothing.

    The driver gets one vector per language; more than ``max_languages`` distinct values are
    refused (such a column holds no languages).
    """
    python_ready(docs.sparkSession)
    rows = first_columns(docs, lang=lang_col, text=text_col).where(
        f"lang is not null and text is not null and lang <> '{UNKNOWN}'")
    sums = (rows.mapInArrow(_bundles(dimensions, seed), "lang string, bundle array<bigint>")
            .select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v")))
    one = (sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("v"))
           .limit(max_languages + 1).collect())
    if len(one) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found = {r["lang"]: np.array([x["v"] for x in r["v"]], dtype=np.float64) for r in one}
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}


def _predictions(names: list[str], prototypes: np.ndarray, dimensions: int, seed: int, schema: pa.Schema,
                 untaught: str | None):
    def scored(n_grams: int, vector: np.ndarray) -> tuple[str | None, float]:
        if not n_grams or not names:
            return (untaught if n_grams else UNKNOWN), 0.0
        cosines = prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-12)
        best = int(np.argmax(cosines))
        return names[best], float(min(1.0, max(0.0, cosines[best])))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, grams in _slices(b):
                out += [scored(len(g), v) for g, v in zip(grams, _text_vectors(grams, dimensions, seed))]
            langs, scores = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(b.columns[:-1], schema)]
                + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)
    return rows


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None, dimensions: int = DIMENSIONS, seed: int = 11,
             untaught: str | None = UNKNOWN) -> DataFrame:
    """doc_id, lang_pred and score (cosine, negative ones as 0) of every row, from its text alone.

    ``keep`` names input columns to pass through, in front.  Null text or a text without a letter:
    ``und`` with score 0; a text with letters where no language is known: ``untaught`` with score 0.  An empty
    table gives no rows.  Equal cosines: the smaller name.  Repeated rows and
    null ids are rows like any other.
    """
    python_ready(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], dtype=np.float32).reshape(len(names), dimensions)
    kept = keep or []
    rows = docs.select(*[docs[c] for c in kept], *([] if id_col in kept else [docs[id_col].alias("doc_id")]),
                       docs[text_col].alias("_text"))
    out = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predictions(names, matrix, dimensions, seed, to_arrow_schema(out), untaught), out)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's text modulo the folds (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
