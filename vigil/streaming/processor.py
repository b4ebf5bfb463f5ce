"""Streaming ingestion with Structured Streaming.

Envelopes ({file_type, data} from a feed, or Kafka rows with topic/value)
are routed by type, decoded with ``from_json`` against the raw schema of
their type, normalised and quality-checked per micro-batch in
``foreachBatch``.  Wall-clock flushing (buffer size / flush interval) maps to
the trigger interval and a per-trigger source limit; the final flush is an
``availableNow`` run.  Malformed payloads are counted with ``observe`` and go
to a reject sink.  Every micro-batch overwrites the folder of its own epoch, so
a batch that is run again leaves no second copy."""

from __future__ import annotations

import json
from collections import deque
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from vigil.operators.normalize import union_all
from vigil.plans.etl import process_type
from vigil.schema import RAW_COLUMNS, raw_schema

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("file_type", T.StringType()), T.StructField("topic", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("data", T.StringType()), T.StructField("value", T.StringType()),
])
#: Field that holds the text of a payload that did not parse.
CORRUPT = "_corrupt_record"
# Alert thresholds of the monitoring template.
QUALITY_ALERT_BELOW, LAG_ALERT_ABOVE_S = 0.8, 300


def route(envelopes: DataFrame) -> DataFrame:
    """Type from ``file_type`` or the topic (with or without the 'cert-'
    prefix); unknown types are dropped; payload from ``data`` or ``value`` (D9)."""
    ftype, payload = _type_and_payload()
    return envelopes.withColumns({"_type": ftype, "_payload": payload}).where(F.col("_type").isin(list(RAW_COLUMNS)))


def _type_and_payload() -> tuple[Column, Column]:
    ftype = F.coalesce(F.col("file_type"), F.regexp_replace(F.col("topic"), "^cert-", ""))
    return ftype, F.coalesce(F.col("data"), F.col("value"))


def decode(routed: DataFrame, file_type: str) -> DataFrame:
    """One type's payloads as raw rows (all strings); ``_malformed`` marks
    payloads that are missing or did not parse."""
    parsed = routed.where(F.col("_type") == file_type).withColumn("_r", _parse(F.col("_payload"), file_type))
    return parsed.select(_bad(F.col("_r")).alias("_malformed"), "_payload",
                         *[F.col(f"_r.{c}").alias(c) for c in RAW_COLUMNS[file_type]])


def _parse(payload: Column, file_type: str) -> Column:
    sch = T.StructType([*raw_schema(file_type).fields, T.StructField(CORRUPT, T.StringType())])
    return F.from_json(payload, sch, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def _bad(record: Column) -> Column:
    return record.isNull() | record[CORRUPT].isNotNull()


def malformed() -> Column:
    """Whether an envelope of a known type has a payload that is missing or does not parse."""
    ftype, payload = _type_and_payload()
    return F.coalesce(*[F.when(ftype == t, _bad(_parse(payload, t))) for t in RAW_COLUMNS], F.lit(False))


def micro_batch_writer(out_path: str, report_path: str | None = None, reject_path: str | None = None):
    """Per micro-batch and type: quality report → normalise → flags →
    align (all five types, D8).  Near-duplicates stay: which of them share a
    batch depends on timing.  Results go to the epoch's own folder, overwritten
    if the batch runs again; malformed payloads to ``reject_path``, if given."""
    from vigil.plans.etl import quality_reports

    def write(batch: DataFrame, epoch_id: int) -> None:
        # Several jobs read the micro-batch (five types, the report): read it
        # from the source once.
        batch = batch.persist()
        routed = route(batch)
        decoded = {t: decode(routed, t) for t in RAW_COLUMNS}
        raws = {t: d.where(~F.col("_malformed")).drop("_malformed", "_payload") for t, d in decoded.items()}
        epoch = f"epoch_id={epoch_id}"
        union_all([process_type(r, t, dedup=False) for t, r in raws.items()]).write.mode("overwrite").parquet(f"{out_path}/{epoch}")
        if report_path:
            quality_reports(raws).write.mode("overwrite").parquet(f"{report_path}/{epoch}")
        if reject_path:
            bad = [d.where("_malformed").select(F.lit(t).alias("file_type"), F.col("_payload").alias("payload")) for t, d in decoded.items()]
            union_all(bad).write.mode("overwrite").parquet(f"{reject_path}/{epoch}")
        batch.unpersist()
    return write


def start_ingestion(stream: DataFrame, out_path: str, checkpoint: str, report_path: str | None = None,
                    flush_seconds: int = 5, available_now: bool = False, reject_path: str | None = None):
    """Start the query: micro-batches every ``flush_seconds`` (or one
    availableNow pass that drains everything and stops — the final flush).
    Counts of rows and of malformed payloads are observed per batch (T4)."""
    sent = F.try_to_timestamp(F.col("timestamp")) if "timestamp" in stream.columns else F.lit(None).cast("timestamp")
    obs = stream.observe("ingest", F.count(F.lit(1)).alias("events"),
                         F.count_if(F.col("data").isNull() & F.col("value").isNull()).alias("empty_payloads"),
                         F.count_if(malformed()).alias("events_failed"), F.unix_millis(F.max(sent)).alias("newest_ms"))
    w = (obs.writeStream.foreachBatch(micro_batch_writer(out_path, report_path, reject_path))
            .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{flush_seconds} seconds")
    return w.start()


def metrics_row(progress: dict) -> dict:
    """T4: one metrics row from a progress report: rows, rate, failures, quality (share of payloads that parse, null
    without any), seconds between the newest envelope and the batch, backlog, batch time."""
    src = (progress.get("sources") or [{}])[0]
    obs = (progress.get("observedMetrics") or {}).get("ingest", {})
    if hasattr(obs, "asDict"):
        obs = obs.asDict()
    events, failed, newest = obs.get("events") or 0, obs.get("events_failed") or 0, obs.get("newest_ms")
    at = progress.get("timestamp")
    lag = None
    if at is not None and newest is not None:
        lag = datetime.fromisoformat(at.replace("Z", "+00:00")).timestamp() - newest / 1000.0
    return {"events_processed": progress.get("numInputRows", 0), "processing_rate": progress.get("processedRowsPerSecond", 0.0),
            "empty_payloads": obs.get("empty_payloads") or 0, "events_failed": failed, "batch_id": progress.get("batchId"),
            "quality_score": (events - failed) / events if events else None, "lag_seconds": lag,
            "last_flush_time": at, "backlog": src.get("latestOffset")}


def metrics(query) -> dict:
    """T4: the metrics row of a query's last progress."""
    p = query.lastProgress
    return metrics_row({} if p is None else json.loads(p.json) if hasattr(p, "json") else p)


class IngestionMonitor(StreamingQueryListener):
    """T4 + T5: turns every progress report of a session's queries into a metrics row and raises the two alerts.

    ``on_metrics`` and ``on_alert`` get each row (an alert's row with its alerts); the last ``keep`` rows stay in
    ``rows`` and ``raised``.  Register with ``spark.streams.addListener(monitor)``."""

    def __init__(self, on_metrics=None, on_alert=None, keep: int = 1000):
        self.on_metrics, self.on_alert = on_metrics, on_alert
        self.rows, self.raised = deque(maxlen=keep), deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = {"query": event.progress.name, **metrics_row(json.loads(event.progress.json))}
        self.rows.append(row)
        if self.on_metrics:
            self.on_metrics(row)
        found = alerts(row["quality_score"], row["lag_seconds"])
        if any(found.values()):
            self.raised.append(row | found)
            if self.on_alert:
                self.on_alert(row | found)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def alerts(quality_score: float | None, lag_seconds: float | None) -> dict:
    """T5: monitoring alerts on the metrics row."""
    return {"quality_alert": quality_score is not None and quality_score < QUALITY_ALERT_BELOW,
            "lag_alert": lag_seconds is not None and lag_seconds > LAG_ALERT_ABOVE_S}
