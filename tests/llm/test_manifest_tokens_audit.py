"""Merkle manifest, byte-pair coding and filter audit against brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import audit, bpe, merkle
from tidewatch.llm import queries as Q

from fixtures import documents, empty, frame, prose


# -- 11: Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root of a list of digests, and each one's path as (side, sibling) steps."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            other = i ^ 1
            paths[leaf].append((None, None) if other >= len(nodes) else ("L" if other < i else "R", nodes[other]))
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def brute_manifest(rows):
    """Rows (doc_id, text, lang, source) -> Counter of the query's rows."""
    groups = {}
    for i, t, lang, s in rows:
        n = None if t is None else len(t)
        changed = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        groups.setdefault(lang, []).append(
            (i, leaf_of([i, s, lang, n, t]), leaf_of([i, s, lang, n + 1 if changed else n, t])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made[g] = tree([r[1] for r in groups[g]])
    root, above = tree([made[g][0] for g in names])
    out = Counter()
    for g, up in zip(names, above):
        for (i, leaf, now), path in zip(groups[g], made[g][1]):
            end = now
            for side, other in path + up:
                end = h(end) if side is None else h(other, end) if side == "L" else h(end, other)
            out[i, leaf, made[g][0], root, h(*(o for _, o in path + up if o)), end, end == root] += 1
    return out


def manifest_of(spark, rows, band_levels):
    docs = frame(spark, rows)
    more = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0,
                  F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(docs, altered={"n_chars": more}, band_levels=band_levels)


@pytest.mark.parametrize("band_levels", [1, 2, 12])
def test_manifest_equals_brute_force(spark, band_levels):
    rows = documents()
    out = manifest_of(spark, rows, band_levels).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out) \
        == brute_manifest(rows)
    assert {r.verified for r in out} == {True, False}


def test_manifest_of_few_rows(spark):
    for rows in ([(1, "a b", "en", "s")], [(1, "a", "en", "s"), (2, None, None, None), (3, "", "", "s")],
                 [(i, str(i), "en", "s") for i in range(9)]):
        out = manifest_of(spark, rows, 2).collect()
        assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out) \
            == brute_manifest(rows)
    assert merkle.manifest(empty(spark)).count() == 0


def test_paths_lead_to_the_root(spark):
    out = merkle.manifest(frame(spark, documents()), with_path=True, band_levels=3).collect()
    assert all(merkle.folded(r.leaf, r.path) == r.root and r.verified for r in out)
    assert all(hashlib.sha256(merkle.siblings(r.path).encode()).hexdigest() == r.proof_sha256 for r in out)


def test_manifest_query_on_the_table(spark):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = Q.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out) \
        == brute_manifest(docs)


def test_intervals_are_nested():
    levels = merkle.levels_of(np.arange(11), [h(str(i)) for i in range(11)], 11)
    assert [len(x.lo) for x in levels] == [11, 6, 3, 2, 1] and levels[-1].lo[0] == 0 and levels[-1].hi[0] == 11
    for child, parent in zip(levels, levels[1:]):
        at = parent.holder(child.lo)
        assert (parent.lo[at] <= child.lo).all() and (child.hi <= parent.hi[at]).all()


# -- 12: byte-pair encoding

def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(Q.word_tokenizer())


def coded_by_library(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return len(ids), struct.pack(f"<{len(ids)}I", *ids), tok.decode(ids, skip_special_tokens=False)


ODD_TEXTS = ["It's they're I'D we'll !'s ''t 'x", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|><|endoftext|> <| |>",
             "é ẛ̣ İI ß ﬁ Σς", "x" * 5000, "ab" * 700 + " " + "-=" * 300,
             "你好世界 " * 20 + "你" * 900, "\x00\x01 \x7f \x1c\x1f \u0085  ", "1234 5٥²",
             "\U0001f600‍\U0001f525" * 150, "﻿bom �", "don't" * 90, "́ alone", "a b　c"]


def test_coding_equals_the_library(spark):
    tok = library()
    rows = documents([(900 + i, t, "en", "odd") for i, t in enumerate(ODD_TEXTS)])
    out = bpe.encode(frame(spark, rows), Q.word_tokenizer(), with_text=True)
    want = Counter((i, *coded_by_library(tok, t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()) == want
    back = bpe.decode(out.drop("decoded"), Q.word_tokenizer()).collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((i, d) for (i, _, _, d), n in want.items() for _ in range(n))
    assert bpe.encode(empty(spark), Q.word_tokenizer()).count() == 0


def test_scan_and_heap_merge_alike(monkeypatch):
    with open(Q.word_tokenizer(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    model, rng = library().model, random.Random(4)
    pieces = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    pieces += ["a" * n for n in range(1, 40)] + ["in" * 20, "th" * 33]
    for scanned in (0, 10 ** 9):
        monkeypatch.setattr(bpe, "_SCANNED_PARTS", scanned)
        assert [codec.merges.parts(p) for p in pieces] == [[t.value for t in model.tokenize(p)] for p in pieces]


def test_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHED_WORDS", 3)
    with open(Q.word_tokenizer(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    text, tok = prose(random.Random(1), "fr", 300), library()
    assert codec.encode(text.encode()) == coded_by_library(tok, text)[1]


def test_other_definitions_are_refused():
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        with pytest.raises(ValueError):
            bpe.Codec(f.read())


def test_coding_query_on_the_table(spark):
    tok = library()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = set()
    for r in docs:
        n, ids, back = coded_by_library(tok, r.text)
        want.add((r.doc_id, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = Q.op12_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs) and {tuple(r) for r in got} == want


# -- 13: filter audit

def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failing = []
    for i, t, lang, _ in rows:
        t = t or ""
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        failing.append((lang or "", {x for x in f if f[x]}, i in good, i in toxic))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {p for p, *_ in failing}:
        docs = [d for d in failing if d[0] == part]
        shapley = Counter()
        for o in orders:
            alive = docs
            for step, f in enumerate(o, 1):
                gone = [d for d in alive if f in d[1]]
                alive_before, alive = alive, [d for d in alive if f not in d[1]]
                earlier = sum(f in d[1] for d in docs) - len(gone)
                out[part, o, step] = [len(alive), len(gone), earlier, sum(d[1] == {f} for d in docs),
                                      sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[f] += len(gone)
        for o in orders:
            for step, f in enumerate(o, 1):
                out[part, o, step].append(shapley[f])
    return {(*k, *v) for k, v in out.items()}


AUDIT_ROWS = [(700, "A B C " * 80, "en", "s"), (701, "a b " * 300, "", "s"), (702, "word# " * 3, None, "s"),
              (703, " ".join(f"w{i}" for i in range(250)), "en", "s"), (704, " ".join(f"w{i}" for i in range(250)), "de", "s"),
              (704, " ".join(f"w{i}" for i in range(250)), "de", "s"), (705, "É" * 97 + "AAA", "fr", "s"), (706, "", "xx", "s")]
AUDIT_LABELS = [(700, 1, 0), (703, 1, 1), (704, 0, 1), (704, 1, 0), (5, 1, None), (None, 1, 1), (99999, 1, 1), (201, 0, 1), (303, None, 1)]


def label_table(spark, labels=AUDIT_LABELS):
    return spark.createDataFrame([(*x, "clash", "clash") for x in labels],
                                 "doc_id long, quality long, toxic long, part string, mask string")


def test_audit_equals_brute_force(spark):
    rows = documents(AUDIT_ROWS)
    out = audit.audit_filters(frame(spark, rows), label_table(spark)).collect()
    assert {tuple(r) for r in out} == brute_audit(rows, AUDIT_LABELS) and len(out) == 600 * len({r[2] or "" for r in rows})


def test_audit_without_rows_or_labels(spark):
    assert audit.audit_filters(empty(spark), label_table(spark)).count() == 0
    rows = AUDIT_ROWS[:3]
    out = audit.audit_filters(frame(spark, rows), label_table(spark).limit(0)).collect()
    assert {tuple(r) for r in out} == brute_audit(rows, [])


def test_min_plus_product_is_the_first_failing_step():
    named = audit.orders()
    steps = audit.removal_steps(np.arange(32), audit.positions(named))
    for mask in range(32):
        for o, got in zip(named, steps[mask]):
            want = min((o.index(f) + 1 for n, f in enumerate("ABCDE") if mask >> n & 1), default=6)
            assert got == want
