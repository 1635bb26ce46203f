"""The corpus pipeline stage by stage against brute force."""

import re
from collections import Counter

import corpus_pipeline as P
from tidewatch.llm import language, secrets

from fixtures import documents, frame, prose
from test_text_operators import KEYS, brute_base, brute_components, brute_fingerprint


def test_stages(spark, tmp_path):
    import random
    rng = random.Random(12)
    items = [(i, prose(rng, "en", 30)) for i in range(20)]
    rows = documents([(800, f"{prose(rng, 'en', 30)} {items[4][1]} {prose(rng, 'en', 30)}", "en", "s"),
                      (801, f"{prose(rng, 'fr', 40)} token = \"{KEYS[2]}\" {KEYS[1]} {prose(rng, 'fr', 10)}", "fr", "s")])
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, rows).select(*P.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = Counter((i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows)
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        seen.append(name)
        if name == "language_id":
            kept = Counter({r: n for r, n in now.items() if any(c.isalpha() for c in r[1] or "")})
            # a missing language is filled with the predicted one, as the operator gives it
            known = language.learn_prototypes(frame(spark, rows))
            said = {r.text: r.lang_pred for r in language.identify(frame(spark, rows), known, keep=["text"]).collect()}
            assert any(r[2] is None for r in kept)
            now = Counter()
            for (i, t, lang, s, size), c in kept.items():
                now[i, t, lang or said[t], s, size] += c
        elif name == "near_dedup":
            component = brute_components([brute_fingerprint(r[1]) for r in now], 2)
            best = {}
            for r in sorted(now, key=lambda r: (r[0] is None, r[0] or 0)):
                best.setdefault(component[brute_fingerprint(r[1])], r)
            now = Counter(best.values())
        elif name == "decontamination":
            now = Counter({r: n for r, n in now.items() if r[0] != 800})
        elif name == "secret_scan":
            changed = Counter()
            for (i, t, lang, s, n), c in now.items():
                spans, at, new = brute_base(t), 0, ""
                for _, a, b in spans:
                    if a >= at:
                        new, at = new + t[at:a] + "[SECRET]", b
                new += t[at:]
                changed[i, new, lang, s, len(new) if spans else n] += c
            now = changed
            assert sum("[SECRET]" in r[1] for r in now) == 1 and not re.search(secrets.HEX, "".join(r[1] for r in now))
        if name != "best_fit_packing":
            assert docs.columns == P.COLUMNS
            got = Counter(tuple(r) for r in docs.collect())
            assert got == now, name
    assert seen == [n for n, _ in P.STAGES]
    assert Counter(r.doc_id for r in docs.where("piece = 0").collect()) == Counter(r[0] for r in now.elements())
    whole = P.run(spark, str(tmp_path))
    assert whole.count() == docs.count() and P.ORACLE_SQL is None


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = P.language_id(spark, docs, "")
    assert kept.count() == docs.count()


def test_unlabelled_documents_stay(spark):
    """Without a labelled row, or with rows labelled ``und``, every text with a letter stays."""
    rows = [(1, "some clean words", None, "s"), (2, "more of them", None, "s"), (3, "12 34", None, "s"), (4, None, None, "s")]
    for lang in (None, "und"):
        docs = frame(spark, [(i, t, lang, s) for i, t, _, s in rows]).select(*P.COLUMNS)
        assert {(r.doc_id, r.lang) for r in P.language_id(spark, docs, "").collect()} == {(1, lang), (2, lang)}


def test_pipeline_of_no_documents(spark, tmp_path):
    frame(spark, []).select(*P.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_untaught_scripts_are_not_rejected_by_chance(spark):
    """Texts that share no letter with any taught language all stay; letterless ones go."""
    import random
    rng = random.Random(21)
    taught = [(i, prose(rng, lang, 60), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 7)]
    untaught = [(100 + i, " ".join("".join(chr(rng.randint(0x10D0, 0x10F0)) for _ in range(rng.randint(2, 9)))
                                   for _ in range(1 + i % 30)), None, "s") for i in range(60)]
    docs = frame(spark, taught + untaught + [(900, "12 34 !", None, "s"), (901, "", "en", "s")]).select(*P.COLUMNS)
    kept = {r.doc_id for r in P.language_id(spark, docs, "").collect()}
    assert kept == {r[0] for r in taught + untaught}


def test_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and {n for n in names if re.match(r"op\d+_", n)} == set(__import__(
        "tidewatch.llm.queries", fromlist=["QUERIES"]).QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))
