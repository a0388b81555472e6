"""Registered queries over the order feed derived from ``events``, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec, rendering
from .functions.symbols import add_shard, shard_of, symbol_hash
from .operators import gaps, latency, levels, lifecycle, lineage, retention
from .oracle import ORACLE_SQL
from .plans.pipeline import Batch, Queues, run_messages, run_packets
from .plans.storage import importable, shared, shared_root
from .sources import events_feed
from .streaming import pipeline as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

MESSAGE = ["arrival_no", "msg_type", "seq_num", "order_id", "new_order_id", "symbol", "side", "price", "quantity", "timestamp"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def batch(spark: SparkSession, sf_dir: str) -> Batch:
    """The pipeline over the feed, divided by channel."""
    return run_messages(events_feed.messages(spark, sf_dir), events_feed.SHARDS, "channel")


# ---- feed, codec, routing ----

@query
def feed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_feed.messages(spark, sf_dir).select(*MESSAGE)


@query
def feed_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_feed.messages(spark, sf_dir).groupBy("msg_type").agg(F.count(F.lit(1)).alias("n"))


@query
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = events_feed.messages(spark, sf_dir).filter("symbol is not null").select("symbol").distinct()
    return symbols.select("symbol", symbol_hash(F.col("symbol")).cast("string").alias("hash"), shard_of(F.col("symbol"), events_feed.SHARDS).alias("shard"))


@query
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = codec.encode(events_feed.messages(spark, sf_dir)).select("arrival_no", "raw")
    return codec.decode(raw).select(*MESSAGE, "decode_error")


@query
def decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 13th message cut short, every 17th of a wrong type, every 19th of a wrong length, every 23rd with bytes after it."""
    raw = codec.encode(events_feed.messages(spark, sf_dir)).select("arrival_no", "raw")
    n, r = F.col("arrival_no"), F.col("raw")
    size = F.octet_length(r)
    bad = (F.when(n % 13 == 0, F.substring(r, F.lit(1), size - 5)).when(n % 17 == 0, F.concat(F.unhex(F.lit("FF")), F.substring(r, F.lit(2), size))).when(n % 19 == 0, F.concat(F.substring(r, 1, 1), F.unhex(F.lit("FFFF")), F.substring(r, F.lit(4), size))).when(n % 23 == 0, F.concat(r, F.unhex(F.lit("00AA")))).when(n % 29 == 0, F.substring(r, 1, 2)).otherwise(r))
    return codec.decode(raw.withColumn("raw", bad)).groupBy("decode_error").agg(F.count(F.lit(1)).alias("n"), F.count("seq_num").alias("n_decoded"))


@query
def route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("error") == lifecycle.UNROUTABLE, F.col("error"))
    return batch(spark, sf_dir).folded.select("arrival_no", "symbol", "shard", error.alias("route_error"))


@query
def routed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.routed_ids(batch(spark, sf_dir).folded)


@query
def rejects_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).rejects.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def replace_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.replace_tree(events_feed.messages(spark, sf_dir))


# ---- book ----

LEG = ["arrival_no", "leg", "symbol", "side", "price", "d_qty", "d_count", "seq_num", "timestamp"]


@query
def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).legs.select(*LEG)


@query
def legs_by_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the lineages that replaces make, without knowing channels."""
    return run_messages(events_feed.messages(spark, sf_dir), events_feed.SHARDS).legs.select(*LEG)


@query
def legs_from_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the wire, lost packets included."""
    sent = events_feed.generated(spark, sf_dir).filter("not before_start")
    packets = codec.encode(sent).select("arrival_no", "channel", F.when(~F.col("lost"), F.col("raw")).alias("raw"))
    return run_packets(packets, events_feed.SHARDS, "channel").legs.select(*LEG)


@query
def book_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).deltas.select("arrival_no", "leg", "symbol", "shard", "side", "price", "total_quantity", "order_count", "seq_num", "timestamp")


@query
def delta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).deltas.select("arrival_no", "leg", rendering.delta_line().alias("line"))


@query
def final_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).levels


@query
def best_bid_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.best_bid_ask(batch(spark, sf_dir).levels)


@query
def depth_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.depth(batch(spark, sf_dir).levels, 5)


@query
def depth_snapshot_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(side: str) -> F.Column:
        return F.array_join(F.transform(side, lambda x: F.concat_ws(":", x["price"], x["total_quantity"], x["order_count"])), " ").alias(side)

    return levels.depth_snapshot(batch(spark, sf_dir).levels, 2).select("symbol", text("bids"), text("asks"))


@query
def book_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels after message 500."""
    return levels.levels(batch(spark, sf_dir).legs, 500)


@query
def replay_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.replay(batch(spark, sf_dir).deltas)


@query
def replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch(spark, sf_dir)
    return levels.replay_difference(b.deltas, b.levels).agg(F.count(F.lit(1)).alias("n_different"))


@query
def resting_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.queue_positions(batch(spark, sf_dir).resting)


@query
def has_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that were ever added or replaced into, and still rest."""
    sent = events_feed.messages(spark, sf_dir)
    ids = sent.select(F.when(F.col("msg_type") == codec.ADD, F.col("order_id")).when(F.col("msg_type") == codec.REPLACE, F.col("new_order_id")).alias("order_id")).filter("order_id is not null")
    return lifecycle.has_order(batch(spark, sf_dir).resting, ids)


@query
def order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.order_lifecycle(batch(spark, sf_dir).folded)


@query
def symbol_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes made in a book other than that of the symbol the order's lineage was added with: none."""
    b = batch(spark, sf_dir)
    sent = lineage.with_lineage(events_feed.messages(spark, sf_dir))
    home = sent.filter(F.col("msg_type") == codec.ADD).select("lineage", F.col("symbol").alias("home"))
    legs_of = b.legs.select("arrival_no", "symbol").join(sent.select("arrival_no", "lineage"), "arrival_no").join(home, "lineage")
    return legs_of.agg(F.count_if(F.col("symbol") != F.col("home")).alias("n_leaks"), F.count(F.lit(1)).alias("n_legs"))


# ---- gaps ----

def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).routed.select("arrival_no", "shard", "seq_num")


@query
def gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_events(gaps.classify(_observed(spark, sf_dir)))


@query
def gap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gaps.gap_events(gaps.classify(_observed(spark, sf_dir), chunk=700))
    return found.select("shard", "arrival_no", rendering.gap_line().alias("line"))


@query
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_summary(gaps.classify(_observed(spark, sf_dir)))


@query
def shard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shards saw messages, gaps, and are stale."""
    each = gaps.gap_summary(gaps.classify(_observed(spark, sf_dir)))
    return each.agg(F.count(F.lit(1)).alias("shards"), F.count_if(F.col("gaps_total") > 0).alias("shards_with_gaps"), F.count_if("stale").alias("shards_stale"))


@query
def gap_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose number leaves 7 when divided by 499 stand for resynchronisations to two before them."""
    resync = F.col("arrival_no") % 499 == 7
    rows = _observed(spark, sf_dir).withColumn("resync", resync).withColumn("seq_num", F.when(resync, F.col("seq_num") - 2).otherwise(F.col("seq_num")))
    return gaps.classify(rows, chunk=700).select("arrival_no", "shard", "seq_num", "kind", "expected", "missing", "stale", "gaps_total")


@query
def duplicate_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 53rd message carries a number of five before."""
    late = F.when(F.col("arrival_no") % 53 == 0, F.col("seq_num") - 5).otherwise(F.col("seq_num"))
    found = gaps.classify(_observed(spark, sf_dir).withColumn("seq_num", late))
    return found.filter("kind = 'Duplicate'").select("arrival_no", "shard", "seq_num", "last_seq", "stale")


# ---- queues, latency, counters ----

def _queued(spark: SparkSession, sf_dir: str) -> Batch:
    """Queues of 12 messages a shard, drained after every 64 arrivals."""
    return run_messages(events_feed.messages(spark, sf_dir), events_feed.SHARDS, "channel", queues=Queues(12, 64))


@query
def queue_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_events(_queued(spark, sf_dir).gaps)


@query
def queue_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queued(spark, sf_dir).rejects

@query
def drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_shard(events_feed.messages(spark, sf_dir).filter("symbol is not null"), events_feed.SHARDS)
    return retention.retain_newest(rows.select("shard", "arrival_no", "order_id"), ["shard"], ["arrival_no"], 100)


@query
def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_shard(events_feed.messages(spark, sf_dir).filter("symbol is not null"), events_feed.SHARDS)
    return retention.dropped(rows, ["shard"], 100)


@query
def queue_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds and executes push, other messages pop, on queues of 4 per channel."""
    op = F.when(F.col("msg_type").isin(1, 3), "push").otherwise("pop")
    ops = events_feed.messages(spark, sf_dir).select(F.col("channel").alias("queue"), F.col("arrival_no").alias("n"), op.alias("op"), F.col("arrival_no").alias("value"))
    return retention.run_queues(ops, capacity=4).select("queue", "n", "popped", "evicted")


def _trace(deltas: DataFrame) -> DataFrame:
    """Time stamps made from arrival numbers by integer rules."""
    n = F.col("arrival_no")
    stamps, at = [n * 1000], n * 1000
    for k, (factor, size) in enumerate(((7, 50), (13, 400), (31, 9000), (17, 900), (29, 7000), (11, 60))):
        at = at + (n * factor + F.col("leg") * (k + 3)) % size
        stamps.append(at)
    names = ["t_received", "t_decoded", "t_demuxed", "t_dequeued", "t_book_updated", "t_delta_dequeued", "t_published"]
    return deltas.select("symbol", *(c.alias(name) for name, c in zip(names, stamps, strict=True)))


@query
def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = latency.intervals(_trace(batch(spark, sf_dir).legs)).groupBy("symbol")
    return made.agg(*(F.sum(name).alias(name) for name, _, _ in latency.INTERVALS))


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.statistics(_trace(batch(spark, sf_dir).legs)).withColumn("mean", F.round("mean", 6))


@query
def wall_time_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = latency.intervals(_trace(batch(spark, sf_dir).legs))
    out = latency.wall_time(made, "symbol", "end_to_end")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6))


@query
def latency_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much publication lengthens the mean way to the book, and nanoseconds a delta."""
    made = latency.intervals(_trace(batch(spark, sf_dir).legs)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("tick_to_book_update").alias("base"), F.avg("end_to_end").alias("whole"), F.sum("end_to_end").alias("total"))
    change, each = latency.percent_change(F.col("base"), F.col("whole")), latency.per_message(F.col("total") / 1e9, F.col("n"))
    return made.select("symbol", "n", F.round(change, 6).alias("percent_change"), F.round(each, 4).alias("ns_per_delta"))


@query
def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = events_feed.generated(spark, sf_dir).filter("not before_start").agg(F.count(F.lit(1)).alias("generated"), F.count_if("lost").alias("lost"))
    made = batch(spark, sf_dir).folded.agg(
        F.count_if(F.col("error") == lifecycle.UNROUTABLE).alias("unroutable"), F.count_if(F.col("error").isNotNull() & (F.col("error") != lifecycle.UNROUTABLE)).alias("rejected"),
        F.count_if(F.col("error").isNull()).alias("accepted"), F.sum(F.size("legs")).alias("deltas"), F.countDistinct("shard").alias("shards_with_books"))
    return sent.crossJoin(F.broadcast(made))  # one row each


@query
def generated_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded generator through the whole pipeline, by what must hold for any numbers: every packet is accounted for, deltas replay to the book, no channel repeats a number."""
    from .sources.generator import FeedSource

    spark.dataSource.register(FeedSource)
    options = {"symbols": "AAPL,MSFT,GOOG,AMZN,TSLA,NFLX,META,NVDA", "channels": 4, "messages": 2000, "loss": 0.01, "seed": 777}
    packets = shared(spark.read.format("order_feed").options(**options).load(), "packets")
    made = run_packets(packets, 4, "channel")
    sent = packets.agg(F.count(F.lit(1)).alias("generated"), F.count_if(F.col("raw").isNull()).alias("lost"), F.countDistinct("arrival_no").alias("numbers"))
    done = made.folded.agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("error").isNotNull() & (F.size("legs") > 0)).alias("rejected_with_legs"))
    differ = levels.replay_difference(made.deltas, made.levels).agg(F.count(F.lit(1)).alias("levels_different"))
    backwards = made.gaps.agg(F.count_if(F.col("kind") == "Duplicate").alias("repeated_numbers"))
    whole = sent
    for one in (done, differ, backwards):  # one row each
        whole = whole.crossJoin(F.broadcast(one))
    return whole.select("generated", "numbers", (F.col("generated") - F.col("lost") - F.col("messages")).alias("unaccounted"), "rejected_with_legs", "levels_different", "repeated_numbers")


# ---- streams ----

#: Messages of one file of a stream, about: what a stateful step holds at once.
PER_FILE = 1_000_000


def _streamed(rows: DataFrame, batches: int = 2) -> DataFrame:
    """Rows as a stream of files, in arrival order: ``batches`` of them, more for a feed of more than as many ``PER_FILE`` rows."""
    spark = rows.sparkSession
    rows = shared(rows, "feed")
    path = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    total, last = rows.agg(F.count(F.lit(1)), F.max("arrival_no")).first()
    batches, last = max(batches, -(-total // PER_FILE)), last or 0
    for k in range(batches):
        part = rows.filter((F.col("arrival_no") * batches >= k * (last + 1)) & (F.col("arrival_no") * batches < (k + 1) * (last + 1)))
        part.repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _streamed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(events_feed.messages(spark, sf_dir))


def _drained(stream: DataFrame) -> DataFrame:
    """All that a stream puts out, as a table."""
    spark = stream.sparkSession
    path = f"{shared_root(spark)}/drained-{uuid.uuid4().hex}"
    streams.start(stream, lambda batch: batch.write.mode("append").parquet(path)).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_best_bid_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best prices from the deltas of the streamed pipeline."""
    done = _drained(streams.deltas(streams.folded(_streamed_messages(spark, sf_dir))))
    when = F.struct("arrival_no", "leg")
    last = done.groupBy(*levels.LEVEL).agg(F.max_by("total_quantity", when).alias("total_quantity"), F.max_by("order_count", when).alias("order_count"))
    return levels.best_bid_ask(last.filter("order_count > 0"))


@query
def stream_gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _drained(streams.gaps(streams.observed(streams.folded(_streamed_messages(spark, sf_dir)))))
    missing = F.when(F.col("kind") == "Gap", F.col("seq_num") - F.col("last_seq") - 1)
    return gaps.gap_summary(done.withColumn("missing", missing))


@query
def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deltas of one global feed, whose channels the stream doesn't know."""
    done = _drained(streams.deltas(streams.folded(_streamed_messages(spark, sf_dir), None)))
    return done.select("arrival_no", "leg", "symbol", "shard", "side", "price", "total_quantity", "order_count", "seq_num", "timestamp")


@query
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects of a stream of packets, where those that the feed loses come cut short."""
    sent = codec.encode(events_feed.generated(spark, sf_dir).filter("not before_start"))
    raw = F.when(F.col("lost"), F.substring("raw", 1, 20)).otherwise(F.col("raw"))
    packets = _streamed(sent.select("arrival_no", "channel", raw.alias("raw")))
    return _drained(streams.rejects(streams.folded(streams.messages_of(packets)), streams.undecodable_of(packets)))
