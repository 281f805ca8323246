"""Small Spark helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortkit.session import cut, ensure_checkpoint_dir  # noqa: F401  (re-exported)

# A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Tables of at most this many rows may be broadcast; they are counted first.
BROADCAST_ROWS = 50_000

# A labelled text of more bytes enters a training sample as PIECES pieces spread evenly over it (scoring takes it whole).
LONGEST_TEXT = 256 << 10
PIECES = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run wrote, through Spark's own file system for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """The words of ``text`` as an array (null text: empty array)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def group_key(col: Column) -> Column:
    """A non-null join key for a nullable string column: nulls form a group of their own."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col.cast("string")))


def join_by_key(rows: DataFrame, small: DataFrame, key: str, salts: int = 64, spread=None) -> DataFrame:
    """Inner join of ``rows`` with a per-group table holding one row per ``key``.

    ``small`` must be materialised.  It is counted: up to BROADCAST_ROWS rows
    it is broadcast, beyond that both sides are salted by the columns
    ``spread`` (default: all), so that a key that holds a third of all rows is
    spread over ``salts`` tasks.
    """
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(salts)).cast("int"))
            .join(salted, [key, "_salt"]).drop("_salt"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total UTF-8 bytes of a text column (one aggregate)."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def labelled_sample(docs: DataFrame, labels: DataFrame, keep: Column, rows: int, max_bytes: int, seed: int) -> DataFrame:
    """A bounded training sample: the columns of ``labels`` (but doc_id) that ``keep`` allows, with ``text``.

    Labels that have a document are taken in the order of a seeded hash of
    ``doc_id``, at most ``rows`` of them, which bounds the broadcast.  A text of
    more than ``LONGEST_TEXT`` bytes is represented by pieces from all over it, of at
    most so many bytes together; the other texts are taken whole.  Texts are
    used in that order until the next one would exceed ``max_bytes``, so at least
    ``max_bytes`` less ``LONGEST_TEXT`` bytes are used where there are as many.
    The window runs over the bounded sample only.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    there = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"))
    some = (labels.where(F.col("doc_id").isNotNull() & keep).join(there, F.col("doc_id") == F.col("_id"), "left_semi")
            .orderBy(order, *labels.columns).limit(rows))
    some = some.select(order.alias("_o"), *[F.col(c).alias(c if c != "doc_id" else "_doc") for c in labels.columns])
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(some), texts["_id"] == some["_doc"]).withColumn("text", excerpt(F.col("text")))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy("_o", *[c for c in labels.columns if c != "doc_id"], "text")
                                                .rowsBetween(Window.unboundedPreceding, 0))
    return sample.withColumn("_bytes", so_far).where(F.col("_bytes") <= max_bytes).drop("_id", "_doc", "_bytes", "_o")


def excerpt(text: Column) -> Column:
    """``text``, or pieces spread evenly over a text of more than ``LONGEST_TEXT`` bytes; a code point has four bytes at most."""
    size = LONGEST_TEXT // (4 * PIECES) - 1
    step = F.length(text) / F.lit(float(PIECES))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)),
                         lambda i: F.substring(text, (F.floor(i * step) + 1).cast("int"), F.least(F.lit(size), F.ceil(step).cast("int"))))
    return F.when(F.octet_length(text) <= LONGEST_TEXT, text).otherwise(F.array_join(pieces, " "))
