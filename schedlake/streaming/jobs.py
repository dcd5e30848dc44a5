"""Streaming jobs: reminders that fire once, re-planning, re-import detection, live tables.

Sinks are keyed ledgers or tables with one partition per micro-batch, overwritten whole, so a batch that runs again after a
failure leaves the same rows behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from schedlake.sources.ledger import Ledger

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BITMAP = 32768  # bits of one bitmap of the engine


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _earlier(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """Rows of the batches before this one; a replayed batch never sees its own output."""
    return spark.read.schema(f"{schema}, batch BIGINT").option("basePath", path).parquet(path).where(
        F.col("batch") < batch_id
    )


# ---- reminders ----


class Reminder(StatefulProcessor):
    """One reminder: its due time until the clock reaches it, then the mark that it has fired."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("reminder", "due_ms LONG, fired BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        clock = timerValues.getCurrentWatermarkInMs()
        # what was over when it was seen is never planned; what the clock overtook on the way fires at once
        due = min((r.due_ms for r in rows if r.due_ms is not None and (r.due_ms > clock or r.due_ms > r.seen_ms)), default=None)
        if due is not None:
            planned, fired = self.state.get() if self.state.exists() else (None, False)
            if not fired and (planned is None or due < planned):
                if planned is not None:
                    self.handle.deleteTimer(planned)
                self.handle.registerTimer(due)
                self.state.update((due, False))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, fired = self.state.get()
        if not fired and expiredTimerInfo.getExpiryTimeInMs() == due:
            self.state.update((due, True))
            yield Row(id=key[0], due_ms=due)

    def close(self) -> None:
        pass


def fire_reminders(stream: DataFrame, folder: str) -> Callable[[], None]:
    """Fires each reminder once, when the clock has reached it; rows (id, due_ms) lie in ``folder``/out.

    ``stream``: id, due_ms, seen_ms (when it arrived; its maximum is the clock).  State is kept by reminder, with a timer at its
    due time.  Of a reminder that comes several times the earliest time counts, until it has fired; what was due
    before it was seen, and before the clock, is never planned.  Which rows share a batch decides nothing else: a reminder seen
    in time fires also where rows of a later batch's instants came with an earlier batch.  Every row comes as two: the plan has no event time, so a reminder that
    arrives late is not dropped as late data, and the tick moves the clock.
    """
    plan = F.struct(F.col("due_ms"), F.col("seen_ms"), F.lit(None).cast("timestamp").alias("at"))
    tick = F.struct(F.lit(None).cast("long").alias("due_ms"), F.col("seen_ms"), F.timestamp_millis("seen_ms").alias("at"))
    rows = stream.select("id", F.explode(F.array(plan, tick)).alias("r")).select("id", "r.*").withWatermark("at", "0 seconds")
    fired = rows.groupBy("id").transformWithState(
        Reminder(), outputStructType="id LONG, due_ms LONG", outputMode="Append", timeMode="EventTime"
    )
    return _run(fired, lambda b, i: b.write.mode("overwrite").parquet(_batch_path(f"{folder}/out", i)), folder, state=ROCKS)


# ---- plans ----


PLAN_ROW = "id STRING, due_ms BIGINT"


def replan(stream: DataFrame, plan_at: Callable[[int], DataFrame], folder: str) -> Callable[[], None]:
    """Plans reminders again whenever the clock or zone changed; the newest plan replaces the last.

    ``stream``: now_ms.  Only what differs from the plan before is written: new rows, and ids that are gone.
    """
    table = Ledger(stream.sparkSession, f"{folder}/plan", ["id"])

    def step(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("now_ms")).first()[0]
        if now is not None:
            table.replace(plan_at(now).select("id", "due_ms"), PLAN_ROW, f"b{batch_id}", batch_id)

    return _run(stream, step, folder)


def current_plan(spark: SparkSession, folder: str) -> DataFrame:
    return Ledger(spark, f"{folder}/plan", ["id"]).read(PLAN_ROW)


# ---- documents seen before ----


def _bits(rows: DataFrame, bits: int, probes: int) -> DataFrame:
    """The places each hash has in the Bloom filter of its range."""
    place = "pmod(xxhash64(hash, probe), {0})".format(bits)
    places = rows.select("hash", "range", F.explode(F.sequence(F.lit(1), F.lit(probes))).alias("probe")).selectExpr(
        "hash", "range", "probe", f"CAST({place} AS BIGINT) AS place"
    )
    return places.selectExpr("*", f"place div {BITMAP} AS bucket", f"place % {BITMAP} AS bit")


def first_imports(stream: DataFrame, folder: str, digits: int = 2, bits: int = 1 << 18, probes: int = 4) -> Callable[[], None]:
    """Documents not seen before, by content identity; no document is lost however late it comes.

    Identities are stored in ranges (the first ``digits`` hexadecimal digits of the hash) together with a Bloom filter of
    ``bits`` bits for each range and batch.  A batch asks the filters first; the exact anti-join reads only ranges that may hold one
    of its hashes.  Full filters let more ranges be read and change nothing else.
    """
    spark = stream.sparkSession
    known, filters = f"{folder}/out", f"{folder}/filters"

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("hash").dropDuplicates(["hash"]).withColumn("range", F.substring("hash", 1, digits))
        if batch_id > 0:
            stored = _earlier(spark, filters, batch_id, "range STRING, bucket BIGINT, bitmap BINARY")
            asked = _bits(rows, bits, probes).join(stored, ["range", "bucket"])
            byte = "conv(hex(substring(bitmap, CAST(bit div 8 + 1 AS INT), 1)), 16, 10)"
            there = asked.where(f"shiftright(CAST({byte} AS INT), CAST(bit % 8 AS INT)) & 1 = 1")
            maybe = there.groupBy("hash", "range").agg(F.count_distinct("probe").alias("n")).where(F.col("n") == probes)
            ranges = [r[0] for r in maybe.select("range").distinct().collect()]  # 16 ** digits at most
            if ranges:
                earlier = _earlier(spark, known, batch_id, "hash STRING, range STRING").where(F.col("range").isin(ranges))
                rows = rows.join(earlier.select("hash"), "hash", "left_anti")
        path = _batch_path(known, batch_id)
        rows.write.mode("overwrite").partitionBy("range").parquet(path)
        new = spark.read.schema("hash STRING, range STRING").parquet(path)
        bitmaps = _bits(new, bits, probes).groupBy("range", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        bitmaps.write.mode("overwrite").parquet(_batch_path(filters, batch_id))

    return _run(stream, step, folder)


# ---- live tables ----


def keep_newest(stream: DataFrame, schema: str, keys: list[str], version: str, folder: str) -> Callable[[], None]:
    """A live table: of every key the row with the highest ``version``, whatever order rows arrive in.

    A batch writes only keys whose row it changes.
    """
    table = Ledger(stream.sparkSession, folder, keys)

    def step(batch: DataFrame, batch_id: int) -> None:
        old = table.read(schema, batch_id)
        rest = [c for c in old.columns if c not in keys]
        newest = F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version]))
        new = batch.select(*old.columns).groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*")
        has = old.select(*keys, F.col(version).alias("__has"))
        changed = new.join(has, keys, "left").where(F.col("__has").isNull() | (F.col(version) > F.col("__has"))).drop("__has")
        table.write(changed, f"b{batch_id}", batch_id)

    return _run(stream, step, folder)


def live(spark: SparkSession, schema: str, keys: list[str], folder: str) -> DataFrame:
    return Ledger(spark, folder, keys).read(schema)


def _run(stream: DataFrame, step, folder: str, state: str | None = None) -> Callable[[], None]:
    """Starts on call and returns when everything available has been read."""

    def start() -> None:
        spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(name)
        if state:
            spark.conf.set(name, state)  # a query keeps the settings it started with
        try:
            started = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
            query = started.foreachBatch(step).trigger(availableNow=True).start()
        finally:
            spark.conf.set(name, before)
        query.awaitTermination()

    return start
