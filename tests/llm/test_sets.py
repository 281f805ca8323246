"""Substring deduplication and the n-gram Jaccard join against direct Python versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import blobs as B
from cohortkit.llm import kernels as K
from cohortkit.llm import ngram_join, substrings
from tests.llm import brute
from tests.llm.conftest import SF001, read
from tests.llm.test_first import rows_of


def near_rows(seed=7, base_words=60, copies=40):
    """Families of near copies, shared passages and lone texts."""
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(30)]
    rows = []
    for fam in range(6):
        base = [r.choice(vocab) for _ in range(base_words + 40 * fam)]
        for _ in range(copies if fam == 0 else 8):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < .3:
                w = w[r.randrange(4):]
            rows.append(w)
    rows += [[r.choice(vocab) for _ in range(50)] + passage for _ in range(20)] + [[r.choice(vocab)] * 3 for _ in range(5)]
    r.shuffle(rows)
    return [(i * 3, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 4000, "bucket_bytes": 3000}])
def test_substrings(spark, odd_docs, sizes):
    made = spark.createDataFrame(near_rows(), "doc_id bigint, text string")
    for docs in (read(spark, SF001, "documents"), odd_docs, made, odd_docs.limit(0)):
        got = [(r.doc_id, r.n_words, sum(s.b - s.a for s in r.spans), r.kept_sha256, r.kept)
               for r in substrings.dedup_substrings(docs, with_text=True, **sizes).collect()]
        want = brute.repeats([(r.doc_id, r.text) for r in docs.collect()])
        assert sorted((g[:4] for g in got), key=repr) == sorted(want, key=repr)
        assert all(brute.sha(g[4]) == g[3] for g in got)


@pytest.mark.parametrize("part_bytes", [1500, 60_000])
def test_substrings_of_uneven_ids(spark, part_bytes):
    """A third of all rows under one id, ids in far clusters, one very large id, ids below zero."""
    r = random.Random(8)
    rows = [(r.choice([5, 5, d, d + 10**15, 2**62, -d]), t) for d, t in near_rows(5)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(x.doc_id, x.n_words, sum(s.b - s.a for s in x.spans), x.kept_sha256)
           for x in substrings.dedup_substrings(df, part_bytes=part_bytes, bucket_bytes=3000).collect()]
    assert sorted(got) == sorted(brute.repeats(rows))


def test_parts_of_uneven_ids_are_even(spark):
    df = spark.range(100_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id ELSE id + 4000000000000000000 END AS doc_id", "id AS t")
    cuts = df.agg(F.approx_percentile("doc_id", [i / 64 for i in range(65)], 6400)).first()[0]
    parts = df.select(substrings.part_of(F.col("doc_id"), F.xxhash64("t"), sorted(cuts), 1).alias("p")).groupBy("p").count().collect()
    assert max(x["count"] for x in parts) < 2.5 * 100_000 / 64 and len(parts) > 55


def test_parts_inside_slices_are_even(spark):
    """Dense clusters far apart, an id on a third of the rows, one on a hundredth: in rank order, of like size."""
    df = spark.range(90_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 100 = 1 THEN 4000000000000123 WHEN id % 3 = 1 THEN id ELSE id DIV 50 + 4000000000000000 END AS doc_id",
        "CAST(id AS STRING) AS text")
    got = substrings.with_parts(df, substrings.id_cuts(df, 64), 16)
    assert got.count() == 90_000
    sizes = [r["count"] for r in got.groupBy("part").count().collect()]
    assert max(sizes) < 3 * 90_000 / (64 * 16) and len(sizes) > 700
    ranks = got.groupBy("doc_id").agg(F.min(F.shiftright("part", substrings.SUB_BITS)).alias("a"),
                                      F.max(F.shiftright("part", substrings.SUB_BITS)).alias("z")).orderBy("doc_id").collect()
    assert all(r.a == r.z for r in ranks) and all(x.a <= y.a for x, y in zip(ranks, ranks[1:]))
    owners = [x.a for x in ranks]
    for heavy in (7, 4000000000000123):
        (own,) = [r.a for r in ranks if r.doc_id == heavy]
        assert owners.count(own) == 1  # ids that share a rank cannot remove from each other across parts


def test_large_ids_on_many_rows_are_known_exactly(spark):
    df = spark.range(9_000).selectExpr("CASE WHEN id % 3 = 0 THEN 4000000000000000123 WHEN id % 3 = 1 THEN id ELSE 9223372036854775806 - id % 2 END AS doc_id")
    cuts = substrings.id_cuts(df, 60)
    assert len(cuts) == 61 and cuts == sorted(cuts) and 18 <= cuts.count(4000000000000000123) <= 22
    assert 8 <= cuts.count(2**63 - 2) <= 12 and 8 <= cuts.count(2**63 - 3) <= 12
    assert substrings.id_cuts(df.limit(0), 60) == []


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_substrings_with_parts_inside_slices(spark, monkeypatch, broadcast):
    monkeypatch.setattr(substrings, "SLICES", (4, 8))
    monkeypatch.setattr(substrings, "BROADCAST_CUTS", broadcast)
    r = random.Random(9)
    rows = [(r.choice([5, 5, d // 9, d + 10**15, 10**15, 2**62, -d]), t) for d, t in near_rows(6)] * 2 + [(None, "a b"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(x.doc_id, x.n_words, sum(s.b - s.a for s in x.spans), x.kept_sha256)
           for x in substrings.dedup_substrings(df, part_bytes=1500, bucket_bytes=3000).collect()]
    assert sorted(got, key=repr) == sorted(brute.repeats(rows), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 4000, "bucket_bytes": 500}])
def test_jaccard_join(spark, odd_docs, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(ngram_join, "WIDER", (3, 4))  # combinations of two from eight texts, of three from sixteen
    made = spark.createDataFrame(near_rows(), "doc_id bigint, text string")
    for docs in (made, read(spark, SF001, "documents"), odd_docs, odd_docs.limit(0)):
        got = rows_of(ngram_join.near_duplicates(docs, **sizes), "doc_id", "n_shingles", "component_id")
        want = sorted(brute.components([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
        assert got == want


def test_lower_similarity(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "WIDER", (1, 2))
    rows = near_rows(3, 20, 12)
    got = rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=50),
                  "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(rows, 50), key=repr)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_an_entry(percent):
    r = np.random.default_rng(percent)
    for n in [*range(1, 30), 60, 200, 700]:
        for _ in range(12):
            both = r.integers(1, n + 1)
            pool = K.distinct(r.integers(0, 1 << 63, 3 * n, dtype=np.uint64))
            cls = (pool % np.uint64(23)).astype(np.uint8) + 1  # some of every width
            x, y = pool[:n], pool[n - both:n - both + r.integers(both, n + 1)]
            same = len(np.intersect1d(x, y))
            if 100 * same < percent * (len(x) + len(y) - same):
                continue
            got = [set(ngram_join.index_entries(s, cls[np.searchsorted(pool, s)], percent)[0].tolist()) for s in (x, y)]
            assert got[0] & got[1]


def test_entries_stay_near_the_prefix_length():
    r = np.random.default_rng(1)
    for n in (300, 5_000, 200_000):
        tokens = K.distinct(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for cls in (3, 9, 20):
            entries, _ = ngram_join.index_entries(tokens, np.full(n, cls, np.uint8), 80)
            assert len(entries) < 20 * (n // 5 + 1)


def test_long_frequent_text_in_130_near_copies(spark):
    made = spark.range(130).selectExpr("id AS doc_id", """array_join(transform(sequence(0, 20000), i -> CASE WHEN i = id * 50
        THEN 'new' ELSE concat('f', i) END), ' ') AS text""")
    parts = spark.createDataFrame([(900 + i, " ".join(f"f{j}" for j in range(i, i + 40))) for i in range(140)], made.schema)
    got = dict(rows_of(ngram_join.near_duplicates(made.unionAll(parts)), "doc_id", "component_id"))
    assert all(got[d] == 0 for d in range(130))
    want = brute.components([(r.doc_id, r.text) for r in parts.collect()])
    assert {d: c for d, c in got.items() if d >= 900} == {d: c for d, _, c in want}


def test_side_grows_with_the_corpus_and_is_bounded():
    sides = [B.side_bytes(s) for s in (0, 30 << 30, 1 << 40, 100 << 40)]
    assert sides[0] == sides[1] == B.SIDE_BYTES < sides[2] < sides[3] == B.MOST_SIDE_BYTES


def test_one_of_each(spark, odd_docs):
    left = ngram_join.one_of_each(odd_docs)
    assert left.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert 1 in ids and 6 not in ids and 8 in ids and 9 not in ids and ids.count(2) == 1 and 11 in ids and 12 not in ids
