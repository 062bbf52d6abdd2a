"""File sources and sinks, batch and streaming, and the shape of Kafka ones."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamql.operators.changelog import ADDS


def read_parquet(spark: SparkSession, path: str, schema, *, stream: bool = False, name_filter: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet with a declared schema; only its columns are read. As a stream the path is a folder."""
    reader = (spark.readStream if stream else spark.read).schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if max_files and stream:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def write_parquet(df: DataFrame, path: str, *, compression: str = "snappy", partition_by=(), mode: str = "append"):
    """Parquet, optionally in partition folders."""
    writer = df.write.mode(mode).option("compression", compression)
    return (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def stream_parquet(df: DataFrame, path: str, checkpoint: str, *, compression: str = "snappy", partition_by=(), trigger: dict | None = None):
    """An exactly-once streaming Parquet sink."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def commit_partitions(df: DataFrame, path: str, partition_by: list[str], marker: str = "_SUCCESS", compression: str = "snappy") -> None:
    """Write partitioned, then put a success marker into every partition folder that was written to. For foreachBatch, too."""
    df = df.persist()
    try:
        write_parquet(df, path, compression=compression, partition_by=partition_by)
        spark, jvm = df.sparkSession, df.sparkSession._jvm
        fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for r in df.select(*partition_by).distinct().toLocalIterator():
            folder = "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if r[c] is None else r[c]}" for c in partition_by)
            fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/{marker}"), True).close()
    finally:
        df.unpersist()


def write_once(path: str, *, compression: str = "snappy"):
    """A foreachBatch sink that a repeated batch does not write twice: each batch has a folder of its own, replaced as a whole.

    Sinks that can't replace (Kafka) get rows at least once; their readers drop repeats by the batch number that batch_rows() adds.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        write_parquet(df, f"{path}/batch={batch_id}", compression=compression, mode="overwrite")

    return write


def batch_rows(df: DataFrame, batch_id: int) -> DataFrame:
    """Kafka rows with their batch number as a header, for readers that drop repeated batches."""
    headers = F.array(F.struct(F.lit("batch").alias("key"), F.lit(str(batch_id)).cast("binary").alias("value")))
    return df.withColumn("headers", headers)


def append_to_log(df: DataFrame, path: str, *, partition_by=()) -> None:
    """Append rows to a log table kept as a folder of Parquet files."""
    write_parquet(df, path, partition_by=partition_by)


def read_log(spark: SparkSession, path: str, schema, *, stream: bool = False, columns: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """A log table, from its start: all there is, or as a stream also what is appended later. Only `columns` are read."""
    log = read_parquet(spark, path, schema, stream=stream, max_files=max_files)
    return log.select(*columns) if columns else log


def kafka_options(servers: str, *, topics: list[str] | None = None, pattern: str | None = None, startup: str = "earliest", timestamp: int | None = None, offsets: str | None = None, bounded: bool = False) -> dict:
    """Options of Spark's Kafka source for startup modes earliest, latest, timestamp and offsets."""
    if (topics is None) == (pattern is None):
        raise ValueError("either topics or a pattern")
    out = {"kafka.bootstrap.servers": servers} | ({"subscribe": ",".join(topics)} if topics else {"subscribePattern": pattern})
    if startup in ("earliest", "latest"):
        out["startingOffsets"] = startup
    elif startup == "timestamp":
        out["startingTimestamp"] = str(timestamp)
    elif startup == "offsets":
        out["startingOffsets"] = offsets
    else:
        raise ValueError(f"unknown startup mode {startup}")
    return out | ({"endingOffsets": "latest"} if bounded else {})


def read_kafka(spark: SparkSession, *, stream: bool = True, **options) -> DataFrame:
    """Raw key and value; decode value with sources.formats. Needs Spark's Kafka connector on the class path."""
    return (spark.readStream if stream else spark.read).format("kafka").options(**kafka_options(**options)).load()


def kafka_rows(df: DataFrame, encode, *, key: list[str] | None = None) -> DataFrame:
    """(key, value) to produce. With a key the topic is an upsert log: +I and +U carry the row, -U and -D a tombstone.

    encode: a format's encoder, DataFrame -> DataFrame with one `value` column, row for row, for
    topics without a key; keyed rows are JSON, as key and value are written side by side.
    """
    columns = [c for c in df.columns if c != "row_kind"]
    if key is None:
        return encode(df.select(*columns))
    to_json = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).cast("binary")
    return df.select(to_json(key).alias("key"), F.when(F.col("row_kind").isin(*ADDS), to_json(columns)).alias("value"))
