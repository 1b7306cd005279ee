"""Results: durable rows with their places, live streams, Arrow, CSV export, search, Kafka."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace
from .ingest import ROW_INDEX, open_fs, with_row_index


def durable(df: DataFrame, path: str) -> DataFrame:
    """Rows as JSON with their place, written once and read back."""
    names = df.columns
    with_row_index(df).select(F.col(ROW_INDEX).alias("row_index"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])).alias("row")).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema("row_index bigint, row string").parquet(path)


def live(df: DataFrame, query: str, every: int = 1_000, chaos=None) -> Iterator[dict]:
    """Messages of a running query: subscribed, chaos for faults that are armed, row and progress, then retry and speculative for
    attempts that were, and complete or error. One partition at a time is held."""
    from ..analyze import task_metrics

    spark, group = df.sparkSession, f"live-{query}-{uuid.uuid4().hex}"
    yield {"type": "subscribed", "query": query}
    if chaos is not None and chaos.kind is not None:
        yield {"type": "chaos", "query": query, "kind": chaos.kind, "partition": chaos.partition}
        df = chaos.injected(df)
    n = 0
    spark.sparkContext.setJobGroup(group, query)
    try:
        for row in df.toLocalIterator():
            yield {"type": "row", "query": query, "index": n, "row": row.asDict(recursive=True)}
            n += 1
            if n % every == 0:
                yield {"type": "progress", "query": query, "rows": n}
        for t in task_metrics(spark, group).where("attempt > 1 OR status = 'cancelled'").collect():  # attempts, not rows
            yield {"type": "speculative" if t["status"] == "cancelled" else "retry", "query": query, "task": t["task_id"], "attempt": t["attempt"]}
    except Exception as e:  # noqa: BLE001  the message is the report
        yield {"type": "error", "query": query, "error": str(e).splitlines()[0][:500]}
        return
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    yield {"type": "complete", "query": query, "rows": n}


def replayed(path: str, spark: SparkSession, start: int = 0) -> DataFrame:
    """Durable rows from a place on, for a subscriber that comes late."""
    return spark.read.schema("row_index bigint, row string").parquet(path).where(F.col("row_index") >= start).orderBy("row_index")


def to_arrow(df: DataFrame, max_rows: int = 100_000):
    """An Arrow table of a result, or :class:`ResultTooLarge` where there are more than max_rows."""
    from ..plans.compile import ResultTooLarge

    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        raise ResultTooLarge(f"result exceeds {max_rows} rows")
    return table


def to_ipc(df: DataFrame, max_rows: int = 100_000) -> bytes:
    """The result as an Arrow IPC stream in which every column is text."""
    import pyarrow as pa

    table = to_arrow(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]), max_rows)
    table = table.cast(pa.schema([(c, pa.string()) for c in table.column_names]))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def from_ipc(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all()


def put_object(spark: SparkSession, store: str, bucket: str, name: str, source: str) -> str:
    """Copy a file into a bucket of a store (a folder of any file system that Arrow opens), block by block; its path there."""
    if bucket not in ("datasets", "partitions"):
        raise ValueError("buckets are datasets and partitions")
    fs, at = open_fs(source)
    to, root = open_fs(store)
    to.create_dir(f"{root}/{bucket}", recursive=True)
    part = f"{root}/{bucket}/.{uuid.uuid4().hex}"
    with fs.open_input_stream(at) as f, to.open_output_stream(part) as out:
        while block := f.read(8 << 20):
            out.write(block)
    to.move(part, f"{root}/{bucket}/{name}")
    return f"{store}/{bucket}/{name}"


def get_object(spark: SparkSession, store: str, bucket: str, name: str) -> DataFrame:
    """The rows of a Parquet object."""
    path = f"{store}/{bucket}/{name}"
    if not workspace.exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def resorted(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """A result in another order, with each row's place in it: numbers by value, text by its bytes, null first."""
    c = F.col(f"`{column}`")
    return with_row_index(df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_first())).withColumnRenamed(ROW_INDEX, "place")


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows in which some column holds the text, case ignored."""
    line = F.lower(F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]))
    return df.where(line.contains(text.lower()))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_buckets(df: DataFrame, key: str, buckets: int, path: str) -> DataFrame:
    """Explicit shuffle files: rows by the bucket of their key, as zstd Parquet; returned by bucket."""
    from ..operators.joins import bucket_of

    df.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition(buckets, "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    return df.sparkSession.read.parquet(path)


def _events(df: DataFrame) -> DataFrame:
    n = df.limit(10_001).count()
    if not 1 <= n <= 10_000:
        raise ValueError("from 1 to 10000 events can be published at once")
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def publish_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """One JSON event a row; 1 to 10,000 rows. Needs Spark's Kafka connector on the class path."""
    _events(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """The topic's JSON events from its beginning, with ``seq`` by offset and ``partition``. Needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", 10_000).load()
    return parsed_events(raw, schema)


def parsed_events(raw: DataFrame, schema: str) -> DataFrame:
    """Events of messages (value, partition, offset): seq, partition and the columns of the JSON value."""
    return raw.select(F.col("offset").alias("seq"), "partition", F.from_json(F.col("value").cast("string"), schema).alias("e")).select("seq", "partition", "e.*")


MESSAGES = "value string, partition int, offset bigint"


def publish_files(df: DataFrame, folder: str, topic: str) -> None:
    """As :func:`publish_kafka`, to a folder a topic: for tests, and where there is no broker. Offsets go on from the last ones."""
    spark, path = df.sparkSession, f"{folder}/{topic}"
    known = workspace.exists(spark, path)
    first = (spark.read.schema(MESSAGES).parquet(path).agg(F.max("offset")).first()[0] + 1) if known else 0
    rows = with_row_index(_events(df)).select("value", F.lit(0).alias("partition"), (F.col(ROW_INDEX) + first).alias("offset"))
    rows.coalesce(1).write.mode("append").parquet(path)


def file_source(spark: SparkSession, folder: str, topic: str, schema: str) -> DataFrame:
    """As :func:`kafka_source`, from the files of a topic, one published batch at a time."""
    raw = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{topic}")
    return parsed_events(raw, schema)
