"""Small tables with the awkward rows every operator must take."""

import random

from pyspark.sql import types as T

WORDS = {"en": "the of and thing water house night river stone walk green under after little great over".split(),
         "de": "der und nicht straße über schön müller haus wasser fluß grün unter nach klein groß zeit".split(),
         "fr": "le et forêt été élève maison rivière pierre marcher vert sous après petit grand où".split()}

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that operators use for columns of their own
                     *[T.StructField(n, T.StringType()) for n in ("fp", "bucket", "token", "kept", "_text", "length", "key")]])


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + str(rng.randint(0, 400)) * (rng.random() < 0.5) for _ in range(n))


def documents(extra=()):
    """Rows (doc_id, text, lang, source): copies, shared passages, null and blank texts, a long
    text, ties, repeated rows, null ids and sources."""
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, rng.randint(30, 120)), lang, rng.choice(["hot", "hot", "hot", "b", None]))
            for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(60))]
    shared = prose(rng, "en", 55)
    rows += [(100 + i, f"{prose(rng, 'en', 25)} {shared}\n{prose(rng, 'en', 12)}", "en", "hot") for i in range(6)]
    rows += [(200 + i, rows[3][1], "en", "copy") for i in range(8)]                     # exact copies
    rows += [(220 + i, rows[4][1] + f" end{i}", rows[4][2], "copy") for i in range(4)]  # near copies
    rows += [(300, None, None, None), (301, "", "en", "b"), (302, " \t\n\x0b\x0c\r ", "de", "b"),
             (303, "one", "en", "b"), (304, "one two", None, "b"), (305, "1234 --- 99", "en", "b"),
             (306, prose(rng, "de", 9000), "de", "hot"), (307, "x " * 400, "en", "b"),
             (308, "non\u00a0breaking \u2003 space \U0001f600 emoji", "fr", "b")]
    rows += [(5, rows[5][1], rows[5][2], rows[5][3])] * 2                                # repeated rows
    rows += [(None, rows[6][1], "en", "b"), (None, prose(rng, "fr", 40), "fr", None)]
    return rows + list(extra)


def frame(spark, rows):
    full = [(i, t, l, s, None if t is None else len(t), "clash", None, "x", "y", "z", "1", "k") for i, t, l, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)
