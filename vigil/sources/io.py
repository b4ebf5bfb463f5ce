"""Sources and sinks.

* S1 raw log CSV with the declared column names: header skipped, lines with
  too many fields dropped, short lines padded with null.
* S3 / S8 Kafka: option builders and value encoding (the connector jar is
  not on this machine, so only the DataFrame side is exercised here).
* S4 watched directory as a file stream source.
* S5 / S6 writers, the ordered sink of N10, S7 description (``quality.describe_dataset``),
  S9 destinations, S10 knowledge-base persistence, S11 profile export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.quality import describe_dataset
from vigil.schema import RAW_COLUMNS, RAW_FILES, UNIFIED_SCHEMA
from vigil.session import cut_lineage

_OVERFLOW, _CORRUPT = "_overflow", "_corrupt"


def load_raw_log(spark: SparkSession, path: str, file_type: str, multi_line: bool = True) -> DataFrame:
    """Read one raw log CSV with the declared names.

    Quoted fields may hold line breaks, which makes a file one task; for files
    without them ``multi_line=False`` lets Spark split each file over tasks.

    The schema has one sentinel column past the declared ones plus the
    corrupt-record column.  A line is too long iff it has at least n
    delimiters outside quotes; those are dropped (DROPMALFORMED would also
    drop short lines, which must be kept and padded)."""
    cols = RAW_COLUMNS[file_type]
    n = len(cols)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols] +
                          [T.StructField(_OVERFLOW, T.StringType()), T.StructField(_CORRUPT, T.StringType())])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
          .option("escape", '"').option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", _CORRUPT).option("columnPruning", False).csv(path))
    # Every row whose token count differs from n+1 is kept as corrupt text, so
    # a null corrupt column means exactly n+1 fields (too long, even when the
    # extra field is empty); otherwise count the delimiters outside quotes.
    # One expression that a CSV reader does not take for a filter of its own (it would test the column before filling it),
    # and that names a second column (a scan of the corrupt text alone is refused).
    extra = F.coalesce(F.length(F.col(_OVERFLOW)), F.lit(0))
    delimiters = F.coalesce(F.length(F.regexp_replace(F.col(_CORRUPT), '"[^"]*"|[^,]', "")), F.lit(n) + extra)
    return df.where(delimiters < n).select(*cols)


def raw_log_exists(spark: SparkSession, data_dir: str, file_type: str) -> bool:
    """N10 guard: a missing source is skipped before planning."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{data_dir.rstrip('/')}/{RAW_FILES[file_type]}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path))


def read_unified(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Processed events with the unified schema (never inferred)."""
    if fmt == "parquet":
        return spark.read.schema(UNIFIED_SCHEMA).parquet(path)
    return spark.read.schema(UNIFIED_SCHEMA).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """One writer for parquet, CSV (with header) and JSON."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_events_by_day(df: DataFrame, path: str) -> None:
    """S5 for events: partitioned by event date so later reads prune days."""
    write_table(df.withColumn("event_date", F.to_date("timestamp")), path, partition_by=["event_date"])


def write_ordered(df: DataFrame, path: str, by: tuple[str, ...] = ("timestamp", "event_id"), fmt: str = "parquet",
                  files: int | None = None) -> None:
    """N10 sink: files that are in order when read by name: rows by ``by``, nulls last.

    Range partitions over all of ``by`` (a time that many rows share is split by the next column), each sorted."""
    order = [F.col(c).asc_nulls_last() for c in by]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    write_table(dealt.sortWithinPartitions(*order), path, fmt)


def save_processed(df: DataFrame, base_path: str, by: tuple[str, ...] = ("timestamp", "event_id")) -> None:
    """The processed dataset as ordered CSV and Parquet, and its description as JSON next to them."""
    df = cut_lineage(df)
    write_ordered(df, base_path + ".csv", by, "csv")
    write_ordered(df, base_path + ".parquet", by)
    describe_dataset(df).coalesce(1).write.mode("overwrite").json(base_path + ".json")


# ------------------------------------------------------------ Kafka
# The topics of the five feeds.
TOPICS = ["cert-logon", "cert-file", "cert-email", "cert-device", "cert-http"]


def kafka_source_options(bootstrap_servers: str, topics: list[str] = TOPICS, group_id: str | None = None,
                         auto_offset_reset: str = "latest", max_poll_records: int | None = None,
                         fail_on_data_loss: bool = True) -> dict:
    """S3: consumer settings → Structured Streaming Kafka options
    (offsets are committed by the query checkpoint, not by the consumer)."""
    opts = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": ",".join(topics),
            "startingOffsets": "earliest" if auto_offset_reset == "earliest" else "latest",
            "failOnDataLoss": str(fail_on_data_loss).lower()}
    if group_id:
        opts["kafka.group.id"] = group_id
    if max_poll_records:
        opts["maxOffsetsPerTrigger"] = str(max_poll_records)
    return opts


def kafka_stream(spark: SparkSession, **kw) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_source_options(**kw)).load()


def decode_kafka(df: DataFrame) -> DataFrame:
    """S3 value decoding: (topic, partition, offset, timestamp, key, value bytes) → strings."""
    return df.select("topic", "partition", "offset", "timestamp",
                     F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def encode_for_kafka(df: DataFrame, topic: str, key_col: str | None = None) -> DataFrame:
    """Rows → (topic, key, value = JSON of the row) for a Kafka sink."""
    key = F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")
    return df.select(F.lit(topic).alias("topic"), key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def kafka_sink_options(bootstrap_servers: str, **producer) -> dict:
    """Producer settings, prefixed as the Kafka sink expects."""
    return {"kafka.bootstrap.servers": bootstrap_servers, **{f"kafka.{k}": str(v) for k, v in producer.items()}}


class Ledger:
    """Epochs that a sink has finished: one empty file each in a folder that all drivers of the query share."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = lambda epoch: jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/epoch={epoch}")
        self._fs = self._path(0).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def done(self, epoch: int) -> bool:
        return bool(self._fs.exists(self._path(epoch)))

    def finish(self, epoch: int) -> None:
        self._fs.create(self._path(epoch), True).close()


def publish_writer(ledger_path: str, topic: str, key_col: str | None = None, folder: str | None = None, kafka: dict | None = None):
    """A ``foreachBatch`` writer that publishes every epoch once.

    An epoch in the ledger is skipped, so a batch that is run again after it was finished adds nothing.  To a
    ``folder`` each epoch overwrites its own part, so a batch that broke off leaves no second copy either.  With
    ``kafka`` (options of ``kafka_sink_options``) a break between sending and the ledger sends again, as any Kafka
    sink does; messages then carry the epoch as a header, so that readers can drop the repeats."""
    if (folder is None) == (kafka is None):
        raise ValueError("publish either to a folder or to Kafka")

    def write(batch: DataFrame, epoch_id: int) -> None:
        ledger = Ledger(batch.sparkSession, ledger_path)
        if ledger.done(epoch_id):
            return
        rows = encode_for_kafka(batch, topic, key_col)
        if folder is not None:
            rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/epoch_id={epoch_id}")
        else:
            header = F.array(F.struct(F.lit("epoch").alias("key"), F.lit(str(epoch_id)).cast("binary").alias("value")))
            rows.withColumn("headers", header).write.format("kafka").options(**kafka).option("includeHeaders", "true").save()
        ledger.finish(epoch_id)
    return write


def publish(stream: DataFrame, checkpoint: str, topic: str, key_col: str | None = None, folder: str | None = None,
            kafka: dict | None = None, available_now: bool = False, flush_seconds: int = 5):
    """Start publishing a stream of processed rows; the ledger lies in the query's checkpoint folder."""
    writer = publish_writer(f"{checkpoint.rstrip('/')}/published", topic, key_col, folder, kafka)
    w = stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{flush_seconds} seconds")
    return w.start()


# ------------------------------------------------------------ directories, destinations
def watched_directory_stream(spark: SparkSession, directory: str, schema: T.StructType,
                             pattern: str = "*.csv", max_files_per_trigger: int = 1) -> DataFrame:
    """A watched folder as a file stream (csv / json by pattern)."""
    r = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
         .option("maxFilesPerTrigger", max_files_per_trigger))
    if pattern.endswith(".json"):
        return r.json(directory)
    return r.option("header", True).csv(directory)


def destination_writer(destination: dict):
    """A ``foreachBatch`` writer for a local / object-store path or a
    JDBC table (connection settings come from the caller's config)."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        if "jdbc_url" in destination:
            (batch.write.mode("append").format("jdbc")
                  .option("url", destination["jdbc_url"]).option("dbtable", destination.get("table", "cert_events"))
                  .options(**destination.get("properties", {})).save())
        else:
            batch.write.mode("append").parquet(destination["path"])
    return write


# ------------------------------------------------------------ knowledge base (S10), profiles
def save_knowledge_base(path: str, kb: DataFrame, role_permissions: DataFrame, project_lifecycles: DataFrame,
                        temporal_rules: DataFrame) -> None:
    """The knowledge base (with its vectors) and the three rule tables."""
    for name, df in (("kb", kb), ("role_permissions", role_permissions),
                     ("project_lifecycles", project_lifecycles), ("temporal_rules", temporal_rules)):
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_knowledge_base(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}")
            for name in ("kb", "role_permissions", "project_lifecycles", "temporal_rules")}


def export_profiles(profiles: DataFrame, path: str, last_updated=None, drift: DataFrame | None = None) -> None:
    """One row per user: activity_count, last_updated, drift flag, one
    column per baseline feature, as CSV."""
    out = profiles
    if drift is not None:
        out = out.join(drift.select("user_id", "drift_detected"), "user_id", "left")
    else:
        out = out.withColumn("drift_detected", F.lit(False))
    out = out.withColumn("last_updated", last_updated if last_updated is not None else F.current_timestamp())
    write_table(out, path, fmt="csv")
