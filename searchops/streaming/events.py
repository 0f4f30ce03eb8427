"""Streams: events counted once, the outbox relay with retries and dead letters, and tables that arriving rows keep up to date.

Each sink lives in a folder of the caller's choice that also holds the stream's checkpoint, so a restart with the same
folder goes on where it stopped, with or without new rows. A batch writes only under its own number and reads only what earlier
numbers have completed, so a batch that runs again after a failure replaces what it wrote and counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import KeyedTable, Ledger, remove

#: Attempts after which an event is a dead letter, and events of one pass.
MAX_ATTEMPTS, PASS = 5, 100


def drain(stream: DataFrame, folder: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Run the stream over all that has landed since its checkpoint in ``folder``."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def hourly_counts(stream: DataFrame, folder: str, horizon_days: int | None = None) -> DataFrame:
    """hour, event_type, n of stream(event_id, ts, event_type): each id once, whenever it comes again, at its earliest time in the
    batch that brings it. No event yet gives no rows.

    With ``horizon_days``, ids of days that lie further back from the newest day are forgotten when the ledger is merged: an event that
    comes again later than that counts again, and no event is ever left out. Counts are kept as one summand a batch.
    """
    spark = stream.sparkSession
    ids = Ledger(spark, f"{folder}/ids", "event_id long, day date")
    counts = Ledger(spark, f"{folder}/counts", "hour timestamp, event_type string, n long")

    def recent(rows: DataFrame) -> DataFrame:
        if horizon_days is None:
            return rows
        newest = rows.agg(F.max("day")).first()[0]
        return rows.where(F.date_diff(F.lit(newest), "day") <= horizon_days)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("hour", "event_type").agg(F.sum("n").alias("n"))

    def batch(rows: DataFrame, number: int) -> None:
        once = rows.groupBy(F.col("event_id").cast("long").alias("event_id")).agg(F.min(F.struct("ts", "event_type")).alias("e")).select("event_id", "e.*")
        new = once.join(ids.read(number), "event_id", "left_anti").persist()
        counts.add(new.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n")), number, summed)
        ids.add(new.select("event_id", F.to_date("ts").alias("day")), number, recent)
        new.unpersist()

    drain(stream, folder, batch)
    return summed(counts.read())


@dataclass
class Consumers:
    """Functions from event rows (with ``attempts`` so far and the id of the ``origin``) to event_id, ok and, if the event goes on as
    another one, emits (its type). A name is registered once for a type."""

    table: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, event_type: str, run: Callable[[DataFrame], DataFrame]) -> None:
        self.table.setdefault((name, event_type), run)

    def of_types(self, events: DataFrame) -> DataFrame:
        """Each event with each of its consumers."""
        table = events.sparkSession.createDataFrame(list(self.table), "consumer string, event_type string")
        return events.join(F.broadcast(table), "event_type")  # one row a consumer


PAIR = ["event_id", "consumer"]
PAIRS = "event_id long, event_type string, created_at timestamp, origin long, payload string, consumer string"
OUTCOMES = "event_id long, event_type string, created_at timestamp, origin long, payload string, consumer string, outcome string, attempts int, emits string, pass int"


def relay_pass(pairs: DataFrame, consumers: Consumers) -> DataFrame:
    """outcome ("ok", "failed" or "dead_letter"), attempts and emits of each of pairs(PAIRS .., attempts) of an event and a consumer."""
    out = None
    for (name, kind), run in consumers.table.items():
        mine = pairs.where((F.col("event_type") == kind) & (F.col("consumer") == name))
        got = run(mine)
        got = got if "emits" in got.columns else got.withColumn("emits", F.lit(None).cast("string"))
        rows = mine.join(got.select("event_id", "ok", "emits"), "event_id", "left")
        ok = F.coalesce("ok", F.lit(False))  # a consumer that says nothing of an event has failed
        tries = F.col("attempts") + (~ok).cast("int")
        outcome = F.when(ok, "ok").when(tries >= MAX_ATTEMPTS, "dead_letter").otherwise("failed")
        rows = rows.select("event_id", "event_type", "created_at", "origin", "payload", "consumer", outcome.alias("outcome"), tries.alias("attempts"), F.when(ok, F.col("emits")).alias("emits"))
        out = rows if out is None else out.unionByName(rows)
    return out


def emitted(outcomes: DataFrame) -> DataFrame:
    """The events that consumers passed on, once each: of their origin's time and payload, numbered by the event and type they come from."""
    new = outcomes.where("emits is not null").select(F.xxhash64("event_id", "emits").alias("event_id"), F.col("emits").alias("event_type"), "created_at", "origin", "payload")
    return new.dropDuplicates(["event_id"])


def relay(stream: DataFrame, folder: str, consumers: Consumers, limit: int | None = PASS) -> DataFrame:
    """All outcomes (OUTCOMES, one row a try) after draining stream(event_id, event_type, created_at and, if there is one, payload) and running passes until no
    event is open with any consumer: each (event, consumer) ends exactly once, as ok or dead letter, however long a chain of events is.

    A pass takes the ``limit`` oldest open events, or all of them; with few events a pass, passes are as many as that makes. Landed
    events and tries are ledgers; what is open is found from them once and handed from pass to pass as a table of its own, so a pass
    reads and writes only what is open. A pass that failed is run again: consumers may see an event twice, the ledgers don't.
    """
    spark = stream.sparkSession
    landed, tries = Ledger(spark, f"{folder}/landed", PAIRS), Ledger(spark, f"{folder}/tries", OUTCOMES)

    def batch(rows: DataFrame, number: int) -> None:
        payload = F.col("payload") if "payload" in rows.columns else F.lit(None).cast("string")
        once = rows.select(F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("created_at").cast("timestamp").alias("created_at"), payload.alias("payload"))
        once = once.groupBy("event_id").agg(F.min(F.struct("created_at", "event_type", "payload")).alias("e"))
        new = once.select("event_id", "e.*").join(landed.read(number).select("event_id").distinct(), "event_id", "left_anti").withColumn("origin", F.col("event_id"))
        landed.add(consumers.of_types(new).select(*[c.split()[0] for c in PAIRS.split(", ")]), number)

    drain(stream, folder, batch)
    number, done = tries.last() + 1, tries.read()
    ended = done.where("outcome <> 'failed'").select(PAIR).distinct()
    attempts = done.groupBy(PAIR).agg(F.max("attempts").alias("attempts"))
    open_ = landed.read().unionByName(consumers.of_types(emitted(done)).select(*landed.read().columns))
    open_ = open_.join(ended, PAIR, "left_anti").join(attempts, PAIR, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    at = f"{folder}/open"
    open_.write.mode("overwrite").parquet(f"{at}/pass={number}")
    while True:
        pairs = spark.read.schema(open_.schema).parquet(f"{at}/pass={number}")
        if pairs.isEmpty():
            break
        if limit is None:
            now = pairs
        else:
            oldest = pairs.select("event_id", "created_at").distinct().orderBy(F.col("created_at").asc_nulls_first(), "event_id").limit(limit)
            now = pairs.join(F.broadcast(oldest.select("event_id")), "event_id", "left_semi")  # at most ``limit`` rows
        tries.add(relay_pass(now, consumers).withColumn("pass", F.lit(number)), number)
        tried = spark.read.schema(OUTCOMES).parquet(f"{tries.path}/batch={number}")
        again = tried.where("outcome = 'failed'").select(*pairs.columns)
        rest = pairs.join(tried.select(PAIR), PAIR, "left_anti").select(*pairs.columns).unionByName(again)
        more = emitted(tried)
        if not more.isEmpty():
            more = more.join(emitted(tries.read(number)).select("event_id"), "event_id", "left_anti")
            rest = rest.unionByName(consumers.of_types(more).withColumn("attempts", F.lit(0)).select(*pairs.columns))
        rest.write.mode("overwrite").parquet(f"{at}/pass={number + 1}")
        remove(spark, f"{at}/pass={number}")
        number += 1
    return tries.read()


def relay_counters(outcomes: DataFrame) -> DataFrame:
    """Per pass: events scanned, and deliveries, failures and dead letters. A dead letter's last try is a failure too."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy("pass").agg(F.count_distinct("event_id").alias("scanned"), count("ok").alias("delivered"), count("failed", "dead_letter").alias("failed"), count("dead_letter").alias("dead_lettered"))


def folded_table(stream: DataFrame, folder: str, keys: list[str], arriving: Callable[[DataFrame], DataFrame], step: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64) -> DataFrame | None:
    """The table by ``keys`` that ``step(rows so far, arriving(rows))`` makes of all batches; None if no row ever came.

    ``step`` sees the rows of the touched buckets and returns all of them, so a batch reads and writes no more than that.
    """
    table = KeyedTable(stream.sparkSession, f"{folder}/table", keys, buckets)
    drain(stream, folder, lambda rows, number: table.fold(arriving(rows), number, step))
    return table.read()
