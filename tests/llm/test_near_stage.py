"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import corpus_pipeline as P
from tests.llm import brute
from tests.llm.test_sets import near_rows


def test_pipeline_near_copies_of_five_words(spark):
    r = random.Random(1)
    base = [f"u{i}" for i in range(50)]
    edited = base[:25] + ["other"] + base[26:]
    long = [f"t{i}" for i in range(200)]
    tailed = long + [f"x{i}" for i in range(30)]
    rows = near_rows(11) + [(d, " ".join(w)) for d, w in ((9001, base), (9002, edited), (9003, long), (9004, tailed))]
    r.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(x.doc_id for x in P.near_duplicates(spark, docs, "").collect())
    assert got == sorted(d for d, n, c in brute.components(rows, 80, 5) if c == d or n == 0)
    assert 9001 in got and 9003 in got and 9002 not in got and 9004 not in got

