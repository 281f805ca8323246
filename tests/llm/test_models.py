"""Classifiers by held-out figures, licenses against direct search, and odd inputs."""

import re

import numpy as np
import pyarrow as pa

from cohortkit.llm import licenses, quality_model, toxicity
from tests.llm.conftest import SF001, read

SF01 = "/root/testdata/sf0.01"


def test_ordinal_fit_orders_thresholds_and_grades():
    good, mid, bad = "alpha beta gamma delta words here", "alpha beta trash words here", "### $$$ ### !!! ###"
    texts = [good, mid, bad] * 60
    rows = list(quality_model.doc_features(pa.array(texts)))
    grades = np.array([2, 1, 0] * 60)
    model = quality_model.fit_ordinal([f for f, _ in rows], [n for _, n in rows], grades, 3)
    assert np.all(np.diff(model["theta"]) > 0)
    s = [model["w"][f].sum() / n for f, n in rows[:3]]
    assert s[0] > model["theta"][1] > s[1] > model["theta"][0] > s[2]
    none = quality_model.fit_ordinal([], [], np.zeros(0, int), 4)
    assert np.all(np.diff(none["theta"]) > 0)


def test_quality_held_out(spark, odd_docs):
    docs, labels = read(spark, SF01, "documents"), read(spark, SF01, "labels")
    model = quality_model.fit(docs, quality_model.graded(labels.where("doc_id % 4 != 0")), 3)
    got = quality_model.score(docs, model)
    assert set(docs.columns) <= set(got.columns)
    rows = got.join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    right = [(r.tail_probability >= 0.5) == (r.quality == 1) for r in rows]
    assert len(rows) > 50 and np.mean(right) > 0.95
    odd = quality_model.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in odd)
    empty = quality_model.fit(odd_docs, quality_model.graded(labels.limit(0)), 3)
    assert quality_model.score(odd_docs.limit(0), empty).count() == 0


def test_chain_marginals_match_enumeration():
    r = np.random.default_rng(1)
    u, trans = r.normal(size=6), r.normal(size=(2, 2))
    fwd, back = toxicity.passes(u, trans, np.array([0, 4]), np.array([4, 2]))
    got = 1 / (1 + np.exp(-(fwd + back)))
    for a, b in ((0, 4), (4, 6)):
        n, mass = b - a, np.zeros((b - a, 2))
        for s in np.ndindex(*[2] * n):
            p = np.exp(sum(u[a + t] * y for t, y in enumerate(s)) + sum(trans[s[t], s[t + 1]] for t in range(n - 1)))
            for t, y in enumerate(s):
                mass[t, y] += p
        assert np.allclose(got[a:b], mass[:, 1] / mass.sum(axis=1))


def test_toxicity_held_out(spark, odd_docs):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    rows = (toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.fold(labels["doc_id"]) == 0)
            .select("score", "toxic").collect())
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows]) == 1
    rank = np.argsort(np.argsort(s))
    auc = (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    assert auc > 0.97 and (s[~y] >= 0.5).mean() < 0.02
    text = "é the pathetic worthless idiot and the moron of it"
    one = toxicity.score(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    assert {text[s.start:s.end] for s in one.spans} >= {"pathetic", "worthless", "idiot", "moron"} and one.score > 0.5
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(odd_docs.limit(0), toxicity.fit(odd_docs, labels.limit(0))).count() == 0


def test_licenses(spark, odd_docs):
    docs = read(spark, SF001, "documents")
    plain = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
             "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
             "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    rows = [(i, f"{'word other ' * i}{t} tail words follow here") for i in range(9) for t in plain.values()]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    for df in (docs, made, read(spark, SF01, "documents")):
        got = sorted((r.doc_id, r.licenses) for r in licenses.scan_documents(df).collect())
        want = sorted((r.doc_id, ",".join(sorted(k for k, t in plain.items() if t in r.text))) for r in df.collect())
        assert got == want
    edited = ("Redistribution and use in source and binary forms, with or without modification, are hereby permitted provided "
              "that the following conditions are met")
    got = licenses.scan_documents(spark.createDataFrame([(1, "x " * 7 + edited), (2, re.sub("o", "0", edited))],
                                                        "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {1: "BSD", 2: ""}
    odd = licenses.scan_documents(odd_docs).collect()
    assert len(odd) == odd_docs.count() and licenses.scan_documents(odd_docs.limit(0)).count() == 0
