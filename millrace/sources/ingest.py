"""CSV ingest: scan, type inference, contiguous range partitions, Parquet snapshots, statistics and the catalog."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import workspace

ROW_INDEX = "__row"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, ragged: bool = False) -> DataFrame:
    """All columns as text, or by the schema given; empty cells are null. A row with too few cells fails, or with ``ragged`` lacks
    them: they are null, which no predicate holds for."""
    reader = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "").option("mode", "PERMISSIVE" if ragged else "FAILFAST")
    if schema is None:
        return reader.option("inferSchema", False).csv(path)
    return reader.schema(schema).csv(path)


def scan_rows(spark: SparkSession, path: str, where: str, ragged: bool = False) -> DataFrame:
    """Rows of a CSV file, numbers as such, for which a condition holds; it is handed to the reader."""
    raw = read_csv(spark, path, ragged=ragged)
    kinds = infer_types(raw)
    schema = T.StructType([T.StructField(c, T.DoubleType() if kinds[c] == "number" else T.StringType()) for c in raw.columns])
    return read_csv(spark, path, schema, ragged).where(where)


class NotParquet(ValueError):
    """A file that a Parquet scan can't read."""


def parquet_scan(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame:
    """Some columns of Parquet files; anything else is refused by its first and last four bytes, before it is read."""
    for name, _ in files_of(spark, path):
        fs, at = open_fs(name)
        with fs.open_input_file(at) as f:
            size = f.size()
            if size < 12 or f.read_at(4, 0) != b"PAR1" or f.read_at(4, size - 4) != b"PAR1":
                raise NotParquet(f"{name} is no Parquet file")
    df = spark.read.parquet(path)
    return (df.where(where) if where else df).select(*columns)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a table, by path; contents are not read. A row a file comes to the driver."""
    return sorted((r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())


def open_fs(path: str):
    """(file system, path in it)."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class CsvScan:
    rows: int
    columns: list[str]
    checksum: str  # SHA-256 over the files' own SHA-256, by name


def digests(spark: SparkSession, path: str, block: int = 8 << 20) -> DataFrame:
    """(path, sha256) of each file, streamed on the executors in blocks, so that files of any size can be hashed."""
    import pyarrow as pa

    def run(batches):
        import hashlib

        import pyarrow.fs as pafs

        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(name)
                h = hashlib.sha256()
                with fs.open_input_stream(at) as f:
                    while part := f.read(block):
                        h.update(part)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "sha256"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, "path string, sha256 string")


def scan_csv(spark: SparkSession, path: str, rows: int | None = None) -> CsvScan:
    """Row count, header and checksum."""
    df = read_csv(spark, path)
    found = [r["sha256"] for r in digests(spark, path).orderBy("path").collect()]  # a row a file
    return CsvScan(df.count() if rows is None else rows, df.columns, hashlib.sha256("".join(found).encode()).hexdigest())


def infer_types(df: DataFrame, sample: int = 100) -> dict[str, str]:
    """number where every non-blank value of the first rows is a finite number (all-blank columns too), else string."""
    head = df.limit(sample)
    value = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    blank = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) == ""
    good = [F.coalesce(F.bool_and(blank(c) | (value(c).isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) != float("inf")))), F.lit(True)).alias(c) for c in df.columns]
    row = head.agg(*good).first()
    return {c: "number" if row[c] else "string" for c in df.columns}


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns by logical type; values that are no numbers become null."""
    return df.select(*[F.expr(f"try_cast(trim(`{c}`) as double)").alias(c) if kinds[c] == "number" else F.col(f"`{c}`") for c in df.columns])


def partition_index(row: Column, rows: Column | int, partitions: int) -> Column:
    """min(floor(i / ceil(n / p)), p - 1): contiguous ranges in order."""
    n = rows if isinstance(rows, Column) else F.lit(rows)
    size = F.greatest(F.ceil(n / F.lit(partitions)), F.lit(1))
    return F.least(F.floor(row / size), F.lit(partitions - 1)).cast("int")


def with_row_index(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """df with its rows' places from 0 on, by ``order`` or as read.

    Two steps that don't gather rows in one task: places within a partition, then an offset a partition. The rows are written
    between them, as a second run of the first step might deal them otherwise.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order) if order else df
    path = workspace.workspace(spark, "indexed")
    placed.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    tagged = spark.read.parquet(path).withColumn("__part", F.shiftright("__id", 33)).withColumn("__in", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = tagged.groupBy("__part").agg(F.count("*").alias("c"))
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__off")  # a row a partition
    return tagged.join(F.broadcast(offsets), "__part").withColumn(ROW_INDEX, F.col("__in") + F.col("__off")).drop("__id", "__part", "__in", "__off")


def range_partitioned(df: DataFrame, partitions: int = 3, order: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """df with a column ``part``: contiguous ranges of its rows in order."""
    if not 1 <= partitions <= 32:
        raise ValueError("partitions must be from 1 to 32")
    indexed = with_row_index(df, order)
    n = df.count() if rows is None else rows
    return indexed.withColumn("part", partition_index(F.col(ROW_INDEX), n, partitions)).drop(ROW_INDEX)


def parts_for(size: int, part_bytes: int = 128 << 20) -> int:
    """Ranges of about part_bytes, three at least."""
    return max(3, -(-size // part_bytes))


def column_stats(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null, least, greatest, approx_distinct) of every column, in one pass; extremes as text, distinct values to about one percent."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        aggs += [F.count_if(x.isNull()).alias(f"u{i}"), F.min(x).cast("string").alias(f"l{i}"), F.max(x).cast("string").alias(f"g{i}"), F.approx_count_distinct(x, 0.01).alias(f"d{i}")]
    row = df.agg(*aggs)
    stats = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"u{i}").alias("n_null"), F.col(f"l{i}").alias("least"), F.col(f"g{i}").alias("greatest"), F.col(f"d{i}").alias("approx_distinct")) for i, c in enumerate(df.columns)])
    return row.select(F.inline(stats))


def row_group_stats(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(file, row_group, n_rows, compressed_bytes, n_null, least, greatest) from the Parquet footers; nothing else of the files is read."""
    schema = "file string, row_group int, n_rows bigint, compressed_bytes bigint, n_null bigint, least string, greatest string"

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(at) as f:
                    meta = pq.read_metadata(f)
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for j in range(group.num_columns):
                        col = group.column(j)
                        if col.path_in_schema == column:
                            s = col.statistics
                            has = s is not None and s.has_min_max
                            rows.append((name.rsplit("/", 1)[-1], g, group.num_rows, col.total_compressed_size, s.null_count if s is not None and s.has_null_count else None, str(s.min) if has else None, str(s.max) if has else None))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").mapInArrow(run, schema)


def pruned_bytes(groups: list[dict], op: str, value: float) -> tuple[int, int]:
    """(bytes to read, bytes skipped) of row groups with min, max and bytes, for ``column op value``."""
    def may(lo: float, hi: float) -> bool:
        return {"=": lo <= value <= hi, "!=": not lo == hi == value, "<>": not lo == hi == value, ">": hi > value, ">=": hi >= value, "<": lo < value, "<=": lo <= value}[op]

    read = sum(g["bytes"] for g in groups if g.get("min") is None or may(g["min"], g["max"]))
    return read, sum(g["bytes"] for g in groups) - read


def pruned_scan(spark: SparkSession, path: str, column: str, op: str, value: float) -> tuple[int, int]:
    """(bytes to read, bytes skipped) of a numeric column of a table for ``column op value``, by its row groups' statistics."""
    number = lambda x: None if x is None else float(x)
    groups = [{"bytes": r["compressed_bytes"], "min": number(r["least"]), "max": number(r["greatest"])} for r in row_group_stats(spark, path, column).collect()]  # a row a group
    return pruned_bytes(groups, op, value)


@dataclass(frozen=True)
class Dataset:
    """An immutable snapshot."""

    name: str
    id: str
    path: str
    csv_path: str | None
    rows: int
    columns: dict[str, str]
    partitions: int
    checksum: str
    storage: str = "parquet"
    version: int = 1


@dataclass
class Catalog:
    """Datasets by name, each noted in a small file under the root, so that a later process finds them. Ingest writes one zstd
    Parquet file for each range and never changes it again."""

    spark: SparkSession
    root: str
    datasets: dict[str, Dataset] = field(default_factory=dict)
    running: set[str] = field(default_factory=set)  # names with jobs on them

    def __post_init__(self):
        for n in workspace.names(self.spark, f"{self.root}/catalog"):
            if n.endswith(".json"):
                d = Dataset(**json.loads(workspace.get_bytes(self.spark, f"{self.root}/catalog/{n}")))
                self.datasets.setdefault(d.name, d)

    def ingest_csv(self, name: str, path: str, partitions: int | None = 3, part_bytes: int = 128 << 20) -> Dataset:
        """partitions: ranges to write, or None for as many as give files of about part_bytes of text.

        The text is parsed once, into a typed table from which the ranges are cut.
        """
        if not path.lower().rstrip("/").endswith(".csv"):
            raise ValueError("only .csv files can be ingested")
        if partitions is not None and not 1 <= partitions <= 32:
            raise ValueError("partitions must be from 1 to 32")
        raw = read_csv(self.spark, path)
        kinds = infer_types(raw)
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        typed(raw, kinds).withColumn(ROW_INDEX, F.monotonically_increasing_id()).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        n = rows.count()
        p = partitions if partitions is not None else parts_for(sum(b for _, b in files_of(self.spark, path)), part_bytes)
        part = F.shiftright(ROW_INDEX, 33)
        sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("c"))
        before = sizes.withColumn("__off", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__off")  # a row a split
        place = F.col("__off") + F.col(ROW_INDEX).bitwiseAND(F.lit((1 << 33) - 1))
        parts = rows.join(F.broadcast(before), part == F.col("__p")).withColumn("part", partition_index(place, n, p))
        out = f"{self.root}/{name}-{uuid.uuid4().hex}"
        parts.repartition(p, "part").sortWithinPartitions("part", ROW_INDEX).drop(ROW_INDEX, "__p", "__off").write.option("compression", "zstd").option("parquet.block.row.count.limit", 10_000).partitionBy("part").parquet(out)
        workspace.remove(self.spark, staged)
        return self._add(Dataset(name, out.rsplit("/", 1)[-1], out, path, n, kinds, p, scan_csv(self.spark, path, n).checksum))

    def materialize(self, name: str, df: DataFrame) -> Dataset:
        """Write a result as a new dataset; an empty one is refused."""
        out = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(out)
        stored = self.spark.read.schema(df.schema).parquet(out)
        rows = stored.count()
        if not rows:
            raise ValueError("an empty result can't be materialized")
        from ..operators.checksum import semantic_checksum
        from ..plans.binder import kinds

        return self._add(Dataset(name, out.rsplit("/", 1)[-1], out, None, rows, kinds(df.schema), stored.rdd.getNumPartitions(), semantic_checksum(stored).first()["checksum"]))

    def _add(self, d: Dataset) -> Dataset:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", d.name):
            raise ValueError("a name has letters, digits, - and _")
        workspace.put_bytes(self.spark, f"{self.root}/catalog/{d.name}.json", json.dumps(asdict(d)).encode())
        self.datasets[d.name] = d
        return d

    def table(self, name: str) -> DataFrame:
        d = self.datasets[name]
        if d.storage == "csv":
            return typed(read_csv(self.spark, d.csv_path), d.columns)
        return self.spark.read.parquet(d.path).drop("part") if d.csv_path else self.spark.read.parquet(d.path)

    def switch_storage(self, name: str, storage: str) -> Dataset:
        """csv or parquet; refused while jobs run on the dataset."""
        d = self.datasets[name]
        if storage not in ("csv", "parquet"):
            raise ValueError("storage must be csv or parquet")
        if name in self.running:
            raise RuntimeError(f"jobs are running on {name}")
        if storage == "csv" and d.csv_path is None:
            raise ValueError(f"{name} has no CSV source")
        return self._add(replace(d, storage=storage))

    def list(self) -> DataFrame:
        rows = [(d.name, d.id, d.rows, d.partitions, d.storage, d.version, d.checksum) for d in self.datasets.values()]
        return self.spark.createDataFrame(rows, "name string, id string, n_rows bigint, n_partitions int, storage string, version int, checksum string")

    def columns(self, name: str) -> DataFrame:
        return self.spark.createDataFrame(list(self.datasets[name].columns.items()), "column_name string, kind string")
