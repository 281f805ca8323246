"""Very long labelled texts do not empty the training sample."""

from pyspark.sql import functions as F

from cohortkit.llm import common, quality_model, toxicity


def labelled(spark):
    rows = [(i, ("fine plain words of a report " if i % 2 else "stupid idiot moron junk ### ") * 5) for i in range(1, 201)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    return rows, labels


def test_long_labelled_texts_do_not_empty_the_sample(spark):
    rows, labels = labelled(spark)
    order = F.xxhash64(F.col("doc_id"), F.lit(quality_model.SEED))
    first = labels.orderBy(order).first().doc_id
    order = F.xxhash64(F.col("doc_id"), F.lit(toxicity.SEED))
    front = labels.where(toxicity.fold(F.col("doc_id")) != 0).orderBy(order).first().doc_id
    long = "very long text " * 2_000_000
    docs = spark.createDataFrame([(i, long if i in (first, front) else t) for i, t in rows], "doc_id bigint, text string")
    model = quality_model.fit(docs, quality_model.graded(labels), n_grades=3)
    p = {r.doc_id: r.tail_probability for r in quality_model.score(docs.where(F.length("text") < 1000), model).collect()}
    assert len(p) >= 198 and all((p[i] > 0.5) == (i % 2 == 1) for i in p)
    tox = {r.doc_id: r.score for r in toxicity.score(docs.where(F.length("text") < 1000), toxicity.fit(docs, labels)).collect()}
    assert all((tox[i] > 0.5) == (i % 2 == 0) for i in tox)


def test_only_long_labelled_texts(spark):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame([(i, t * 3_000) for i, t in rows[:40]], "doc_id bigint, text string")
    assert docs.agg(F.min(F.octet_length("text"))).first()[0] > common.LONGEST_TEXT
    model = quality_model.fit(docs, quality_model.graded(labels), n_grades=3)
    p = {r.doc_id: r.tail_probability for r in quality_model.score(docs, model).collect()}
    assert all((p[i] > 0.5) == (i % 2 == 1) for i in p)
    tox = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all((tox[i] > 0.5) == (i % 2 == 0) for i in tox)


def test_pieces_come_from_all_over_a_long_text(spark):
    text = "".join(f"w{i} " for i in range(200_000))
    df = spark.createDataFrame([(text,), ("short",), ("é" * 300_000,)], "text string")
    long, short, wide = [r.e for r in df.select(common.excerpt(F.col("text")).alias("e")).collect()]
    assert short == "short" and max(len(long.encode()), len(wide.encode())) <= common.LONGEST_TEXT
    seen = [int(w[1:]) for w in long.split() if w.startswith("w") and w[1:].isdigit()]
    assert min(seen) == 0 and max(seen) > 180_000


def test_labels_without_a_document_take_no_room(spark):
    rows, labels = labelled(spark)
    more = spark.range(1000, 40_000).selectExpr("id AS doc_id", "1 AS quality", "1 AS toxic")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sample = common.labelled_sample(docs, labels.unionByName(more), F.lit(True), 200, 1 << 20, 1)
    assert sample.count() == 200


def test_rows_without_id_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id bigint")
    assert df.where(toxicity.fold(F.col("doc_id")) == 0).where("doc_id IS NULL").count() == 0
