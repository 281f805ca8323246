"""The corpus pipeline, stage by stage against direct versions."""

import corpus_pipeline as P
from tests.llm import brute
from tests.llm.conftest import SF001, read


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages(spark):
    docs = read(spark, SF001, "documents")
    labels = {r.doc_id: r.quality for r in read(spark, SF001, "labels").collect()}
    kept = docs
    for name, stage in P.STAGES:
        before = kept.collect()
        after_df = stage(spark, kept, SF001)
        assert after_df.columns == list(P.COLUMNS)
        after = after_df.collect()
        texts = {r.doc_id: r.text for r in before}
        if name == "quality":
            rated = [r.doc_id for r in before if r.doc_id in labels]
            right = [(i in ids(after)) == (labels[i] == 1) for i in rated]
            assert sum(right) > 0.95 * len(right)
        elif name == "near_duplicates":
            want = brute.components([(r.doc_id, r.text) for r in before], P.NEAR_PERCENT, P.NEAR_WORDS)
            assert ids(after) == sorted(d for d, n, c in want if c == d or n == 0)
        elif name == "decontaminate":
            items = [(str(r.item_id), r.text) for r in read(spark, SF001, "benchmark").collect()]
            hit = {d for d, *_, bad in brute.contamination([(r.doc_id, r.text) for r in before], items) if bad}
            assert ids(after) == sorted(r.doc_id for r in before if r.doc_id not in hit)
        elif name == "secrets":
            assert ids(after) == ids(before)
            for r in after:
                spans = [x.split(":") for x in brute.secrets(texts[r.doc_id])[-1].split(",") if x]
                assert (r.text == texts[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
                assert not any(texts[r.doc_id][int(a):int(b)] in r.text for _, a, b in spans)
        else:
            mixed = brute.mix([(r.doc_id, r.source, r.text) for r in before])
            words = {d: m[3] for d, m in mixed.items()}
            got: dict = {}
            for r in after:
                got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
            assert {d: w for d, w in words.items() if w} == got
        kept = spark.createDataFrame(after, docs.schema) if name != "mix" else kept


def test_run_and_odd_rows(spark, odd_docs):
    assert P.run(spark, SF001).columns == list(P.COLUMNS)
    odd = odd_docs.selectExpr("doc_id", "text", "lang", "source", "CAST(n_chars AS BIGINT) AS n_chars", "1 AS size", "'k' AS _key")
    for name, stage in P.STAGES:
        assert stage(spark, odd, SF001).columns == list(P.COLUMNS)
        assert stage(spark, odd.limit(0), SF001).count() == 0
        assert stage(spark, odd, SF001).count() >= 0


def test_empty_labels_and_benchmark(spark, odd_docs, tmp_path):
    for name, schema in (("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    odd = odd_docs.selectExpr("doc_id", "text", "lang", "source", "CAST(n_chars AS BIGINT) AS n_chars")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    assert ids(P.quality(spark, odd, str(tmp_path)).where("doc_id IS NOT NULL").collect()) == ids(odd.where("doc_id IS NOT NULL").collect())
    assert P.decontaminate(spark, odd, str(tmp_path)).count() == odd.count()
    assert P.run(spark, str(tmp_path)).columns == list(P.COLUMNS)
