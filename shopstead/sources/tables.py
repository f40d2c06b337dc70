"""Reading and writing catalogue tables: tenant-partitioned Parquet, content-addressed keys, redacted logs."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def read_table(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """A Parquet table; filters and columns asked for later reach the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for intermediate tables in the folder that the driver and all executors share (spark.checkpoint.dir); in a
    temporary folder only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='shopstead-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def for_tenant(df: DataFrame, tenant, column: str = "business_id") -> DataFrame:
    """The rows of one tenant; prunes partitions on tables written by append_table."""
    return df.where(F.col(column) == F.lit(tenant))


def find_by_key(df: DataFrame, **key) -> DataFrame:
    """At most one row with the given unique key."""
    for c, v in key.items():
        df = df.where(F.col(c) == F.lit(v))
    return df.limit(1)


#: Rows and bytes of an Arrow batch at most: a batch is in memory on both sides at once, and texts run to megabytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches at BATCH_ROWS rows and some BATCH_BYTES bytes or fewer."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(name).rstrip("bB")
        if not (have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(name, str(most))


#: Rows that a task of a narrow pass with much work a row should get.
SPREAD = 5000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df dealt out to a task for each `rows` rows (SPREAD of them by default). Columns compress to a few bytes a row, so a file of a million rows is
    one or two tasks as it is read; this is for tables whose rows are small and are then worked on at length."""
    return df.repartition(max(1, -(-df.count() // (rows or SPREAD))))


def append_table(df: DataFrame, root: str, name: str, partition_by: str | None = "business_id") -> None:
    """Appends rows, a folder a tenant."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{root}/{name}.parquet")


def storage_key(business: Column, content: Column, extension: Column) -> Column:
    """`<business>/<first 32 hex digits of sha256>.<ext>`: equal content is stored once."""
    return F.concat(business.cast("string"), F.lit("/"), F.substring(F.sha2(content, 256), 1, 32), F.lit("."), extension)


#: Keys whose values never reach a log, the mask, and the longest string kept.
SECRET_KEYS = r"(?i)(password|passwd|secret|token|api[_-]?key|access[_-]?key|authorization|auth[_-]?secret|encryption[_-]?key|cookie|session[_-]?id|credential|client[_-]?secret)"
MASK, LONGEST = "[REDACTED]", 2000


def redact(fields: Column) -> Column:
    """A map of log fields with secrets masked and long values cut, the cut noted."""
    cut = lambda v: F.concat(F.substring(v, 1, LONGEST), F.lit("…[truncated "), (F.length(v) - LONGEST).cast("string"), F.lit(" chars]"))
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit(MASK)).when(F.length(v) > LONGEST, cut(v)).otherwise(v))


#: Levels of a record that are looked into, and what stands for deeper ones.
MOST_DEPTH, TOO_DEEP = 6, "[MAX_DEPTH]"
_SECRET = re.compile(SECRET_KEYS)


def _redacted(value, depth: int = 0):
    if depth > MOST_DEPTH and value is not None:
        return TOO_DEEP
    if isinstance(value, str) and len(value) > LONGEST:
        return f"{value[:LONGEST]}…[truncated {len(value) - LONGEST} chars]"
    if isinstance(value, list):
        return [_redacted(x, depth + 1) for x in value]
    if isinstance(value, dict):
        return {k: MASK if _SECRET.search(k) else _redacted(x, depth + 1) for k, x in value.items()}
    return value


@F.pandas_udf(StringType())
def redact_json(records: pd.Series) -> pd.Series:
    """Log records as JSON with secrets masked at every level, long strings cut, and levels below the sixth left out; NULL
    for what is no JSON. A record's shape is not known beforehand, so this is an Arrow UDF."""

    def one(raw):
        try:
            return json.dumps(_redacted(json.loads(raw)), ensure_ascii=False, separators=(",", ":")) if raw else None
        except ValueError:
            return None

    return records.map(one)


def safe_key(key: Column) -> Column:
    """Whether an object's key stays below the store's root: relative, no empty part, no dots for a part, no backslash."""
    return key.isNotNull() & ~key.rlike(r"(^|/)(\.{0,2})(/|$)") & ~key.contains("\\") & ~key.contains("\u0000")


def put_objects(objects: DataFrame, root: str) -> None:
    """Appends (key, content, at); keys that would leave the root raise an error. A put of the same key replaces it."""
    checked = objects.select(F.when(safe_key(F.col("key")), F.col("key")).otherwise(F.raise_error(F.lit("unsafe key"))).alias("key"), "content", "at")
    append_table(checked.withColumn("gone", F.lit(False)), root, "objects", None)


def delete_objects(keys: DataFrame, root: str) -> None:
    """Appends a mark (key, at) for each object that is no more; keys that are not there do no harm."""
    append_table(keys.select("key", F.lit(None).cast("binary").alias("content"), "at", F.lit(True).alias("gone")), root, "objects", None)


def get_objects(spark: SparkSession, root: str) -> DataFrame:
    """(key, content) of the objects that are there now: the latest row of each key, unless it deletes it."""
    rows = spark.read.parquet(f"{root}/objects.parquet")
    last = rows.groupBy("key").agg(F.max_by(F.struct("content", "gone"), "at").alias("last"))
    return last.where("not last.gone").select("key", "last.content")
