"""Streams that stop, start again and replay a batch; sinks that a repeated run leaves as they are."""

import glob
import os

import pytest

from schedlake.session import shared_folder
from schedlake.sources.ledger import Ledger, write_results
from schedlake.streaming import jobs as J


class Source:
    """A file stream to which a test adds files one by one."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path, self.n = spark, schema, shared_folder(spark, "source"), 0

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(f"{self.path}/f={self.n}")
        self.n += 1
        return self

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(self.path)


def forget_last_commit(folder):
    """As if the driver had died after a batch wrote its rows and before it was noted."""
    plain = folder.removeprefix("file:")
    last = max((p for p in glob.glob(f"{plain}/checkpoint/commits/*") if os.path.basename(p).isdigit()), key=lambda p: int(os.path.basename(p)))
    os.unlink(last)
    crc = f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"
    if os.path.exists(crc):
        os.unlink(crc)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_reminders_fire_once_over_a_restart_and_a_replayed_batch(spark, few_partitions):
    source = Source(spark, "id long, due_ms long, seen_ms long")
    source.add((1, 5000, 1000), (2, 90_000, 1500), (9, 500, 1600)).add((3, 7000, 6000), (4, 6500, 6400))
    folder = shared_folder(spark, "reminders")
    fired = lambda: rows(spark.read.schema("id long, due_ms long").parquet(f"{folder}/out/batch=*"))
    J.fire_reminders(source.stream(), folder)()
    assert fired() == [(1, 5000), (9, 500)]  # one due before the clock had begun fires at the first tick
    forget_last_commit(folder)
    source.add((5, 70_000, 100), (1, 9000, 8000), (2, 60_000, 8000)).add((6, 15_000, 19_000), (7, 999_999, 20_000), (8, 1, 1))
    J.fire_reminders(source.stream(), folder)()
    # 1 has fired and does not again; 2 is due earlier now; 5 arrived late and is planned; 8 was over when it arrived
    assert fired() == [(1, 5000), (3, 7000), (4, 6500), (6, 15_000), (9, 500)]
    source.add((99, 10**9, 80_000))
    J.fire_reminders(source.stream(), folder)()
    assert fired() == [(1, 5000), (2, 60_000), (3, 7000), (4, 6500), (5, 70_000), (6, 15_000), (9, 500)]
    assert {os.path.basename(p) for p in glob.glob(f"{folder.removeprefix('file:')}/*")} == {"checkpoint", "out"}


def test_a_reminder_overtaken_by_the_clock_fires(spark, few_partitions):
    """Rows of later instants may come with an earlier batch: a reminder seen in time is not lost for that."""
    source = Source(spark, "id long, due_ms long, seen_ms long")
    source.add((1, 10**9, 50_000)).add((2, 20_000, 10_000), (3, 9000, 10_000))
    folder = shared_folder(spark, "reminders")
    J.fire_reminders(source.stream(), folder)()
    assert rows(spark.read.schema("id long, due_ms long").parquet(f"{folder}/out/batch=*")) == [(2, 20_000)]


def test_a_first_arrival_is_kept_however_late(spark, few_partitions):
    import hashlib

    names = [hashlib.sha256(str(i).encode()).hexdigest()[:16] for i in range(400)]
    source = Source(spark, "hash string, arrived long")
    source.add(*[(n, 10**9) for n in names[:300]]).add(*[(n, 0) for n in names[200:]], (names[399], 5))  # the second file is ages older
    folder = shared_folder(spark, "imports")
    first = lambda: rows(spark.read.schema("hash string").parquet(f"{folder}/out/batch=*/range=*"))
    J.first_imports(source.stream(), folder)()
    assert first() == sorted((n,) for n in names)
    forget_last_commit(folder)
    source.add(*[(n, 1) for n in names])
    J.first_imports(source.stream(), folder, bits=1 << 18)()
    assert first() == sorted((n,) for n in names)


def test_filters_spare_ranges(spark, few_partitions):
    """The filters hold every stored hash, and seldom another one."""
    known = spark.createDataFrame([(f"{i * 7919 % 65536:04x}{i:012x}",) for i in range(2000)], "hash string")
    parts = known.selectExpr("hash", "substring(hash, 1, 2) AS range")
    from pyspark.sql import functions as F

    maps = J._bits(parts, 1 << 18, 4).groupBy("range", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    others = spark.createDataFrame([(f"{i * 104729 % 65536:04x}ffff{i:08x}",) for i in range(2000)], "hash string").selectExpr("hash", "substring(hash, 1, 2) AS range")
    byte = "conv(hex(substring(bitmap, CAST(bit div 8 + 1 AS INT), 1)), 16, 10)"

    def found(asked):
        hit = J._bits(asked, 1 << 18, 4).join(maps, ["range", "bucket"]).where(f"shiftright(CAST({byte} AS INT), CAST(bit % 8 AS INT)) & 1 = 1")
        return hit.groupBy("hash").agg(F.count_distinct("probe").alias("n")).where("n = 4").count()

    assert found(parts) == 2000 and found(others) < 5


def size(path):
    return sum(os.path.getsize(p) for p in glob.glob(f"{path.removeprefix('file:')}/**/*.parquet", recursive=True))


def test_a_new_plan_writes_only_what_differs(spark, few_partitions):
    source = Source(spark, "now_ms long").add((1,)).add((2,)).add((3,))
    folder = shared_folder(spark, "plan")
    plans = {n: spark.range(n * 2, 20_000 + n * 2).selectExpr("concat('e', id) AS id", "id * 10 + IF(id = 777, {n}, 0) AS due_ms".format(n=n)) for n in (1, 2, 3)}
    J.replan(source.stream(), lambda now: plans[now], folder)()
    assert rows(J.current_plan(spark, folder)) == rows(plans[3])
    written = [size(f"{folder}/plan/data/run=b{b}") for b in range(3)]
    counts = [spark.read.parquet(f"{folder}/plan/data/run=b{b}").count() for b in range(3)]
    assert counts == [20_000, 5, 5] and written[1] < written[0] / 10
    forget_last_commit(folder)
    J.replan(source.stream(), lambda now: plans[now], folder)()
    assert rows(J.current_plan(spark, folder)) == rows(plans[3])


def test_live_rows_keep_the_newest_whatever_the_order(spark, few_partitions):
    schema = "k string, seq int, v string"
    source = Source(spark, schema).add(("a", 2, "new"), ("b", 1, "x")).add(("a", 1, "old"), ("b", 3, "z"), ("b", 2, "y"))
    folder = shared_folder(spark, "live")
    J.keep_newest(source.stream(), schema, ["k"], "seq", folder)()
    assert rows(J.live(spark, schema, ["k"], folder)) == [("a", 2, "new"), ("b", 3, "z")]
    forget_last_commit(folder)
    source.add(("c", 1, "w"))
    J.keep_newest(source.stream(), schema, ["k"], "seq", folder)()
    assert rows(J.live(spark, schema, ["k"], folder)) == [("a", 2, "new"), ("b", 3, "z"), ("c", 1, "w")]
    assert spark.read.parquet(f"{folder.removeprefix('file:')}/data/run=b1").count() == 1  # only b changed


def test_ledger(spark):
    path, schema = shared_folder(spark, "ledger"), "k long, v string"
    table = lambda *r: spark.createDataFrame(list(r), schema)
    assert rows(write_results(table((1, "a"), (2, "b")), path, ["k"], "r1", 1)) == [(1, "a"), (2, "b")]
    assert rows(write_results(table((2, "B"), (3, "c")), path, ["k"], "r2", 2)) == [(1, "a"), (2, "B"), (3, "c")]
    files = size(path)
    assert rows(write_results(table((1, "a"), (2, "b")), path, ["k"], "r1", 1)) == [(1, "a"), (2, "B"), (3, "c")] and size(path) == files
    ledger = Ledger(spark, path, ["k"])
    # a run that died before its ledger row is not read, and a smaller second try leaves nothing of the first
    table(*[(i, "lost") for i in range(50)]).selectExpr("*", "false AS gone", "3L AS version", "k % 64 AS part").write.partitionBy("part").parquet(f"{path}/data/run=r3")
    assert rows(ledger.read(schema)) == [(1, "a"), (2, "B"), (3, "c")]
    ledger.write(table((4, "d")), "r3", 3, gone=table((1, None)).select("k"))
    assert rows(ledger.read(schema)) == [(2, "B"), (3, "c"), (4, "d")] and rows(ledger.read(schema, 2)) == [(1, "a"), (2, "b")]
    ledger.compact(schema, "base3", 3)
    assert ledger.runs() == ["base3"] and rows(ledger.read(schema)) == [(2, "B"), (3, "c"), (4, "d")]
    ledger.replace(table((3, "c"), (5, "e")), schema, "r4", 4)
    assert rows(ledger.read(schema)) == [(3, "c"), (5, "e")] and spark.read.parquet(f"{path}/data/run=r4").count() == 3
    assert Ledger(spark, shared_folder(spark, "none"), ["k"]).read(schema).count() == 0


def test_a_replayed_table_is_read_in_all_its_tasks(spark):
    """Four files a step, but what the rows are made from is read in every split, not in four tasks."""
    from pyspark import TaskContext

    from schedlake.plans.streams import replay

    def task(frames):
        for frame in frames:
            yield frame.assign(task=TaskContext.get().partitionId())

    made = spark.range(0, 64, 1, 16).selectExpr("id", "CAST(id % 2 AS INT) AS step", "0 AS task")
    stream, tasks = replay(made.mapInPandas(task, "id long, step int, task int"), spark, "replayed", 2), set()
    started = stream.writeStream.option("checkpointLocation", shared_folder(spark, "replayed-checkpoint"))
    started = started.foreachBatch(lambda batch, _: tasks.update(r.task for r in batch.select("task").distinct().collect()))
    started.trigger(availableNow=True).start().awaitTermination()
    assert len(tasks) == 16
