"""K operators: read CSV/parquet/tables, preview, write CSV/parquet, run history."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions.core import nan_to_null

RUN_COLUMNS = ["run_id", "run_timestamp", "method", "params"]


def read_csv(spark: SparkSession, path: str, schema=None, sep: str = ",") -> DataFrame:
    """K1: CSV with a header row; types inferred unless a schema is given.

    Inference costs an extra pass over the input; on large inputs pass a
    schema.  An input without data rows is an error.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if not df.columns or not df.take(1):
        raise ValueError(f"no rows in {path}")
    return df


def read_table(spark: SparkSession, name: str, fmt: str | None = None,
               options: dict | None = None) -> DataFrame:
    """K2: whole table by (multi-part) name, from the catalog or a connector format; an empty table is an error."""
    if not name or not name.strip():
        raise ValueError("table name is blank")
    if fmt:
        df = spark.read.format(fmt).options(**(options or {})).option("table", name).load()
    else:
        df = spark.table(name.strip())
    if not df.take(1):
        raise ValueError(f"no rows in {name}")
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """K3."""
    return spark.read.parquet(path)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """K5: first ``n`` rows, every column as text, nulls and NaN as ''."""
    def text(name, kind):
        value = nan_to_null(name) if kind in ("double", "float") else F.col(name)
        return F.coalesce(value.cast("string"), F.lit("")).alias(name)

    return df.limit(n).select(*[text(c, kind) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K6: CSV with a header (one file per partition)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def run_meta(method: str, params: dict, run_id: str | None = None,
             run_timestamp: datetime | None = None) -> dict:
    """Driver-side literals, made once per run (never per row)."""
    ts = run_timestamp or datetime.now(timezone.utc).replace(tzinfo=None)
    return {"run_id": run_id or str(uuid.uuid4()), "run_timestamp": ts,
            "method": method, "params": params}


def add_run_metadata(df: DataFrame, meta: dict) -> DataFrame:
    """K7: append run_id, run_timestamp, method and params (JSON text)."""
    return df.withColumns({
        "run_id": F.lit(meta["run_id"]),
        "run_timestamp": F.lit(meta["run_timestamp"]).cast("timestamp_ntz"),
        "method": F.lit(meta["method"]),
        "params": F.lit(json.dumps(meta["params"], default=str, sort_keys=True)),
    })


def _log_path(path: str) -> str:
    return path.rstrip("/") + "-runs"


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, run_timestamp, folder) of the finished runs of a history; one small row per run."""
    schema = "run_id string, run_timestamp timestamp_ntz, folder string"
    try:
        return spark.read.schema(schema).parquet(_log_path(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_history(df: DataFrame, path: str, meta: dict) -> str:
    """K8: add one run to a history, in a folder of its own under its run date.

    A run counts once its folder is written and its line is in the log beside
    the history (``<path>-runs``).  A write that is tried again replaces the
    folder of an unfinished run and leaves a finished one alone, so it adds nothing.
    New result columns are allowed: readers use ``mergeSchema``.
    """
    spark = df.sparkSession
    if committed_runs(spark, path).where(F.col("run_id") == F.lit(str(meta["run_id"]))).limit(1).count():
        return path
    # a letter in front, so that folder names are never read as numbers
    folder = f"run_date={meta['run_timestamp']:%Y-%m-%d}/run=r{quote(str(meta['run_id']), safe='')}"
    add_run_metadata(df, meta).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{folder}")
    line = spark.createDataFrame([(str(meta["run_id"]), meta["run_timestamp"], folder)], "run_id string, run_timestamp timestamp_ntz, folder string")
    line.coalesce(1).write.mode("append").parquet(_log_path(path))
    return path


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs; ``run_date`` comes from the folders."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("run")


def latest_folder(spark: SparkSession, path: str) -> str:
    """The folder of the newest finished run (ties: the larger run_id), from the log alone."""
    newest = committed_runs(spark, path).agg(F.max(F.struct("run_timestamp", "run_id", "folder")).alias("r")).first().r
    if newest is None:
        raise ValueError(f"no finished run in {path}")
    return f"{path.rstrip('/')}/{newest.folder}"


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """K9: rows of the newest finished run; only its folder is listed and opened."""
    return spark.read.parquet(latest_folder(spark, path))


def create_latest_view(spark: SparkSession, path: str, view: str) -> DataFrame:
    """K9 as a catalog view that callers query by name; every call points it to the newest run."""
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.`{latest_folder(spark, path)}`")
    return spark.table(view)


def create_latest_table_view(spark: SparkSession, table: str, view: str) -> DataFrame:
    """K9 over a catalog table (``append_history_table``): a lasting view that follows later runs by itself."""
    spark.sql(f"""CREATE OR REPLACE VIEW {view} AS SELECT * FROM {table} WHERE run_date = (SELECT max(run_date) FROM {table})
        AND run_timestamp = (SELECT max(run_timestamp) FROM {table} WHERE run_date = (SELECT max(run_date) FROM {table}))""")
    return spark.table(view)


def append_history_table(df: DataFrame, table: str, meta: dict) -> str:
    """K8 into a catalog table: created if absent, new columns are added to it first; a run that is in the table is not added again."""
    spark = df.sparkSession
    out = add_run_metadata(df, meta).withColumn("run_date", F.to_date("run_timestamp"))
    if spark.catalog.tableExists(table) and spark.table(table).where(
            (F.col("run_date") == F.lit(meta["run_timestamp"].date())) & (F.col("run_id") == F.lit(meta["run_id"]))).limit(1).count():
        return table
    if not spark.catalog.tableExists(table):
        out.write.partitionBy("run_date").format("parquet").saveAsTable(table)
        return table
    have = {f.name for f in spark.table(table).schema}
    new = [f for f in out.schema if f.name not in have]
    if new:
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({cols})")
    schema = spark.table(table).schema
    aligned = out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                           for f in schema])
    aligned.write.mode("append").insertInto(table)
    return table


_URI = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]*:/.+|/.+)$")


def write_run_parquet(df: DataFrame, prefix: str, meta: dict, mode: str = "errorifexists") -> str:
    """Parquet at ``<prefix>/<method>/<run_id>.parquet``."""
    if not prefix or not _URI.match(prefix):
        raise ValueError(f"not a storage URI or absolute path: {prefix!r}")
    path = f"{prefix.rstrip('/')}/{meta['method']}/{meta['run_id']}.parquet"
    add_run_metadata(df, meta).write.mode(mode).parquet(path)
    return path


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Stack standardised tables; columns missing on one side become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
