"""The order-feed engine against scripted cases and a sequential model."""

import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from model import Model, shard_of
from quotemill.functions import codec, rendering
from quotemill.functions.symbols import add_shard, hash_text, make_symbol, symbol_hash, symbol_view
from quotemill.operators import components, gaps, latency, levels, lifecycle, lineage, prefix, retention
from quotemill.plans.pipeline import run_messages, run_packets
from quotemill.sources import generator, sinks

MESSAGE = "arrival_no long, msg_type int, seq_num long, order_id long, new_order_id long, symbol string, side int, price long, quantity long, timestamp long"


def add(n, oid, side, price, qty, symbol="TEST", seq=None):
    return (n, 1, seq or n, oid, None, symbol, side, price, qty, n * 100)


def cancel(n, oid, seq=None):
    return (n, 2, seq or n, oid, None, None, None, None, None, n * 100)


def execute(n, oid, qty, seq=None):
    return (n, 3, seq or n, oid, None, None, None, None, qty, n * 100)


def replace(n, oid, new, price, qty, seq=None):
    return (n, 4, seq or n, oid, new, None, None, price, qty, n * 100)


def frame(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


def dicts(rows):
    return [dict(zip([c.split()[0] for c in MESSAGE.split(", ")], r, strict=True)) for r in rows]


# ---- codec ----

SAMPLES = [(1, 1, 42, 1001, None, "AAPL", 0, 1500000, 100, 1720000000000), (2, 2, 43, 1001, None, None, None, None, None, 1720000000100), (3, 3, 44, 1001, None, None, None, None, 50, 1720000000200), (4, 4, 45, 1001, 1002, None, None, 1510000, 75, 1720000000300), (5, 1, 2**63 - 1, 7, None, "ABCDEFGH", 1, -5, 2**32 - 1, 0)]


def test_codec_roundtrip_and_sizes(spark):
    raw = codec.encode(frame(spark, SAMPLES))
    assert [len(r.raw) for r in raw.orderBy("arrival_no").collect()] == [48, 27, 31, 47, 48]
    stored = spark.createDataFrame([(r.arrival_no, bytes(r.raw)) for r in raw.collect()], "arrival_no long, raw binary")
    back = codec.decode(stored).orderBy("arrival_no").collect()
    assert [tuple(r[c.split()[0]] for c in MESSAGE.split(", ")) for r in back] == SAMPLES
    assert codec.encode_error(47, codec.ADD) == "BufferTooSmall" and codec.encode_error(48, codec.ADD) is None


def test_decode_errors(spark):
    good = struct.pack("<BHQQ8sBqIQ", 1, 48, 9, 5, b"AAPL", 7, -3, 10, 11)
    cases = [(1, good[:-5], codec.TRUNCATED), (2, good[:2], codec.TRUNCATED), (3, b"\xff" + good[1:], codec.BAD_TYPE), (4, good[:1] + b"\xff\xff" + good[3:], codec.BAD_LENGTH), (5, good + b"junk", None), (6, b"\0" + good[1:], codec.BAD_TYPE), (7, struct.pack("<BHQQQ", 2, 27, 2**63, 1, 1), codec.OUT_OF_RANGE), (8, None, codec.TRUNCATED), (9, b"", codec.TRUNCATED)]
    out = {r.arrival_no: r for r in codec.decode(spark.createDataFrame([c[:2] for c in cases], "arrival_no long, raw binary")).collect()}
    assert {n: out[n].decode_error for n, _, _ in cases} == {n: e for n, _, e in cases}
    assert (out[5].side, out[5].price, out[5].symbol, out[5].msg_type) == (7, -3, "AAPL", 1) and out[3].msg_type is None


def test_symbols(spark):
    known = {"AAPL": 3222965605098616329, "MSFT": 10027877359232391609, "GOOG": 14509128012078724815, "AMZN": 11752747982852692893, "TSLA": 4819038172428463921, "NFLX": 2108631674763166191, "META": 4333364870665006398, "NVDA": 12232509551593963356}
    df = spark.createDataFrame([(s,) for s in known], "symbol string")
    got = {r.symbol: (int(r.h), r.shard) for r in add_shard(df.withColumn("h", symbol_hash(F.col("symbol"))), 4).collect()}
    assert got == {s: (h, h % 4) for s, h in known.items()}
    assert all(hash_text(s) == h for s, h in known.items())
    one = spark.createDataFrame([("LONGERTHAN8",), ("AB",)], "s string").select(make_symbol(F.col("s")).alias("m")).select("m", symbol_view(F.col("m")).alias("v")).collect()
    assert [(r.m, r.v) for r in one] == [("LONGERTH", "LONGERTH"), ("AB\0\0\0\0\0\0", "AB")]
    with pytest.raises(ValueError):
        add_shard(df, 17)


# ---- book ----

BOOK = [add(1, 1, 0, 100, 10), add(2, 2, 0, 100, 5), add(3, 3, 0, 99, 20), add(4, 4, 1, 101, 8), add(5, 5, 1, 102, 12), cancel(6, 2), execute(7, 1, 4), execute(8, 1, 6), replace(9, 4, 6, 103, 8)]


def test_scripted_book(spark):
    legs = run_messages(frame(spark, BOOK), 4).legs.persist()
    want = {5: ((100, 15, 2), (101, 8, 1)), 6: ((100, 10, 1), (101, 8, 1)), 7: ((100, 6, 1), (101, 8, 1)), 8: ((99, 20, 1), (101, 8, 1)), 9: ((99, 20, 1), (102, 12, 1))}
    for step, best in want.items():
        r = levels.best_bid_ask(levels.levels(legs, step)).first()
        assert ((r.bid_price, r.bid_quantity, r.bid_count), (r.ask_price, r.ask_quantity, r.ask_count)) == best
    deep = lambda step, n: [[tuple(x) for x in side] for side in levels.depth_snapshot(levels.levels(legs, step), n).first()[1:]]
    assert deep(5, 2) == [[(100, 15, 2), (99, 20, 1)], [(101, 8, 1), (102, 12, 1)]]
    assert deep(9, 2) == [[(99, 20, 1)], [(102, 12, 1), (103, 8, 1)]]
    assert deep(9, 50) == deep(9, 2) and levels.depth(levels.levels(legs), 0).count() == 0


@pytest.mark.parametrize(("rows", "error"), [
    ([add(1, 1, 0, 100, 10), cancel(2, 999)], "OrderNotFound"), ([add(1, 1, 0, 100, 20), execute(2, 1, 25)], "ExecutedQuantityExceedsRemaining"), ([add(1, 1, 0, 100, 10), add(2, 1, 0, 100, 10)], "DuplicateOrderId"),
    ([replace(1, 999, 1000, 5, 5)], "OrderNotFound"), ([add(1, 1, 0, 100, 10), add(2, 2, 0, 99, 5), replace(3, 1, 2, 98, 1)], "DuplicateOrderId")])
def test_rejects_of_a_bare_book(spark, rows, error):
    folded = lifecycle.fold(frame(spark, [(*r[:5], "TEST", *r[6:]) for r in rows]).withColumn("book", F.lit("TEST")), "book", routed=False).orderBy("arrival_no").collect()
    assert [r.error for r in folded] == [None] * (len(rows) - 1) + [error] and folded[-1].legs == []


def test_unknown_ids_are_unroutable_in_the_pipeline(spark):
    batch = run_messages(frame(spark, [cancel(1, 999), replace(2, 5, 6, 1, 1), execute(3, 7, 1)]), 3)
    assert {(r.stage, r.reason) for r in batch.rejects.collect()} == {("route", "UnroutableOrderId")} and batch.routed.count() == 0


def test_queue_position(spark):
    rows = [add(1, 1, 0, 100, 10), add(2, 2, 0, 100, 5), add(3, 3, 0, 100, 7), execute(4, 1, 4), replace(5, 2, 4, 100, 9)]
    got = levels.queue_positions(run_messages(frame(spark, rows), 4).resting).collect()
    assert {(r.order_id, r.remaining, r.queue_pos, r.qty_ahead) for r in got} == {(1, 6, 1, 0), (3, 7, 2, 6), (4, 9, 3, 13)}


def test_integration_of_several_symbols(spark):
    seq, rows = Counter(), []

    def next_of(symbol, more=1):
        seq[shard_of(symbol, 3)] += more
        return seq[shard_of(symbol, 3)]

    plan = [(add, (1, 0, 100, 10), "AAPL"), (add, (2, 0, 200, 20), "MSFT"), (add, (3, 1, 105, 5), "AAPL"), (add, (4, 0, 300, 15), "GOOG"), (cancel, (2,), "MSFT"), (execute, (1, 4), "AAPL"), (add, (5, 1, 210, 8), "MSFT"), (replace, (4, 6, 301, 15), "GOOG"), (add, (7, 0, 400, 25), "AMZN")]
    for n, (make, args, symbol) in enumerate(plan, 1):
        s = next_of(symbol, 2 if make is cancel else 1)
        rows.append(make(n, *args, symbol=symbol, seq=s) if make is add else make(n, *args, seq=s))
    batch = run_messages(frame(spark, rows), 3)
    best = {r.symbol: tuple(r)[1:] for r in levels.best_bid_ask(batch.levels).collect()}
    assert best == {"AAPL": (100, 6, 1, 105, 5, 1), "MSFT": (None, None, None, 210, 8, 1), "GOOG": (301, 15, 1, None, None, None), "AMZN": (400, 25, 1, None, None, None)}
    summary = {r.shard: (r.gaps_total, r.stale) for r in gaps.gap_summary(batch.gaps).collect()}
    assert summary[shard_of("MSFT", 3)] == (1, True) and all(x == (0, False) for s, x in summary.items() if s != shard_of("MSFT", 3))


def test_route_table_stays_bounded(spark):
    rows, n, live = [], 0, []
    for i in range(50):
        n += 1
        rows.append(add(n, n, 0, 100, 10, "CYCLE"))
        live.append(n)
    for i in range(200):
        n += 1
        old = live.pop(0)
        rows.append(cancel(n, old) if i % 2 else execute(n, old, 10))
        n += 1
        rows.append(add(n, n, 0, 100, 10, "CYCLE"))
        live.append(n)
    assert lifecycle.routed_ids(run_messages(frame(spark, rows), 1).folded).count() == 50


@pytest.mark.parametrize("seed", range(6))
def test_adversarial_feeds(spark, seed):
    """Ids reused, added to two books, replaced onto each other, zero quantities: batch by lineage against the model."""
    r = random.Random(seed)
    rows, feeds = [], 4
    for feed in range(feeds):
        ids = r.choice([8, 30, 200, 600])
        often = r.choice([0.15, 0.4])
        for k in range(300):
            n, oid = feed * 1000 + k + 1, feed * 10_000 + r.randrange(ids)
            roll = r.random()
            if roll < 0.45:
                rows.append(add(n, oid, r.randrange(3), 100 + r.randrange(5), r.randrange(6), r.choice(["A", "BB", "CCC"])))
            elif roll < 0.45 + often:
                rows.append(replace(n, oid, feed * 10_000 + r.randrange(ids), 100 + r.randrange(5), r.randrange(6)))
            elif roll < 0.85:
                rows.append(execute(n, oid, r.randrange(6)))
            else:
                rows.append(cancel(n, oid))
    model = Model(4).run(dicts(rows))
    batch = run_messages(frame(spark, rows), 4).persisted()
    assert Counter(levels.deltas(batch.legs, 7).collect()) == Counter(batch.deltas.collect())
    assert sorted((x.arrival_no, x.symbol, x.error) for x in batch.folded.collect()) == sorted(model.status)
    assert sorted((x.arrival_no, x.leg, x.symbol, x.side, x.price, x.total_quantity) for x in batch.deltas.collect()) == sorted(model.deltas)
    resting = {(s, i): (o["side"], o["price"], o["qty"]) for s, b in model.books.items() for i, o in b.items()}
    assert {(x.symbol, x.order_id): (x.side, x.price, x.remaining) for x in batch.resting.collect()} == resting
    assert {(x.order_id, x.symbol) for x in lifecycle.routed_ids(batch.folded).collect()} == set(model.route.items())
    assert {x.shard: x.gaps_total for x in gaps.gap_summary(batch.gaps).collect()} == {s: model.gaps.get(s, 0) for s in model.last}
    batch.folded.unpersist()


def test_lineages_and_replace_tree(spark):
    chain = [add(1, 1, 0, 5, 5)] + [replace(k + 1, k, k + 1, 5, 5) for k in range(1, 40)] + [add(100, 500, 0, 5, 5)]
    got = {r.arrival_no: r.lineage for r in lineage.with_lineage(frame(spark, chain)).collect()}
    assert set(got.values()) == {1, 500}
    r = random.Random(8)
    links = [(a, a + r.choice([0, 3, 6, 300])) for a in (r.randrange(400) for _ in range(300))] + [(None, 4), (4, None)]
    parent = {x: x for p in links for x in p}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {x: find(x) for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    found = components.components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {x.node: x.component for x in found.collect()} == want
    tree = {r.order_id: (r.root_id, r.depth) for r in lineage.replace_tree(frame(spark, chain)).collect()}
    assert tree == {k: (1, k - 1) for k in range(1, 41)}


# ---- gaps ----

@pytest.mark.parametrize("chunk", [1_000_000, 2])
def test_gap_sequences(spark, chunk):
    streams = {0: "1 2 3 4 5", 1: "1 2 3 5 6 r100 101", 2: "1 3 r10 12", 3: "1 1000", 4: "1 2 3 2", 5: "1", 6: "7 8", 7: "1 1", 8: "1 5 3 6", 9: "50 60 r10 11"}
    rows = [(s, n, int(x.strip("r")), x[0] == "r") for s, text in streams.items() for n, x in enumerate(text.split())]
    out = gaps.classify(spark.createDataFrame(rows, "shard int, arrival_no long, seq_num long, resync boolean"), chunk=chunk).persist()
    kinds = {s: [r.kind for r in out.filter(F.col("shard") == s).orderBy("arrival_no").collect()] for s in (0, 1, 4, 7, 8, 9)}
    assert kinds == {0: ["InOrder"] * 5, 1: ["InOrder"] * 3 + ["Gap", "InOrder", "Resync", "InOrder"], 4: ["InOrder"] * 3 + ["Duplicate"], 7: ["InOrder", "Duplicate"], 8: ["InOrder", "Gap", "Duplicate", "InOrder"], 9: ["InOrder", "Gap", "Resync", "InOrder"]}
    end = {r.shard: (r.gaps_total, r.missing, r.last_seq, r.stale) for r in gaps.gap_summary(out).collect()}
    assert end[0] == (0, 0, 5, False) and end[1] == (1, 1, 101, False) and end[2] == (2, 2, 12, True) and end[3] == (1, 998, 1000, True) and end[4] == (0, 0, 3, False) and end[5] == (0, 0, 1, False) and end[6] == (0, 0, 8, False)
    stale = [r.stale for r in out.filter("shard = 1").orderBy("arrival_no").collect()]
    assert stale == [False] * 3 + [True] * 2 + [False] * 2
    line = gaps.gap_events(out).filter("shard = 3").select(rendering.gap_line().alias("x")).first().x
    assert line == "[gap_detector] sequence gap: expected 2, got 1000 (998 message(s) missing) -- marking STALE"


def test_running_aggregates_over_chunks(spark):
    r = random.Random(4)
    rows = [(k, n, r.randrange(100)) for k in "ab" for n in r.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k string, n long, v long").withColumn("chunk", F.lit("own")).withColumn("_k_chunk", F.lit(0))
    made = prefix.running(df, ["k"], "n", {"s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False)}, chunk=37)
    assert made.columns == [*df.columns, "s", "m"]
    got = made.collect()
    for x in got:
        before = [v for k, n, v in rows if k == x.k and n < x.n]
        assert x.s == sum(before) + x.v and x.m == (max(before) if before else None)


# ---- queues ----

def test_drop_oldest_queues(spark):
    cases = {"a": (4, "p" * 5 + "g" * 5), "b": (4, "pg" * 100), "c": (8, "p" * 25 + "g" * 9), "d": (4, ("p" * 6 + "g" * 4) * 20), "e": (4, "g")}
    rows, value = [], Counter()
    for q, (cap, ops) in cases.items():
        for n, op in enumerate(ops):
            rows.append((q, n, "push" if op == "p" else "pop", value[q] if op == "p" else None, cap))
            value[q] += op == "p"
    done = retention.run_queues(spark.createDataFrame(rows, "queue string, n long, op string, value long, cap long"), capacity="cap").persist()
    out = {q: [r.popped for r in done.filter((F.col("queue") == q) & (F.col("op") == "pop")).orderBy("n").collect()] for q in cases}
    assert out["a"] == [1, 2, 3, 4, None] and out["b"] == list(range(100)) and out["c"] == [*range(17, 25), None] and out["e"] == [None]
    assert out["d"] == [6 * k + j for k in range(20) for j in range(2, 6)]
    total = {r.queue: (r.pushed, r.received, r.dropped, r.left) for r in retention.queue_summary(done).collect()}
    assert total["a"] == (5, 4, 1, 0) and total["c"] == (25, 8, 17, 0) and total["d"] == (120, 80, 40, 0)
    burst = spark.range(25).withColumn("q", F.lit(1))
    assert sorted(r.id for r in retention.retain_newest(burst, ["q"], ["id"], 8).collect()) == list(range(17, 25))
    assert retention.dropped(burst, ["q"], 8).first().dropped == 17


# ---- publication, latency ----

DELTA = "shard int, arrival_no long, leg int, symbol string, side int, price long, total_quantity long, seq_num long, timestamp long"


def test_delta_lines_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(s, n, 0, "AAPL", s % 2, 10000, q, 42, 12345) for s in (0, 1) for n, q in enumerate((150, 20, 0))], DELTA)
    lines = [r.x for r in df.filter("shard = 0").orderBy("arrival_no").select(rendering.delta_line().alias("x")).collect()]
    assert lines == ["seq=42 ts=12345 symbol=AAPL side=BUY price=10000 qty=150", "seq=42 ts=12345 symbol=AAPL side=BUY price=10000 qty=20", "seq=42 ts=12345 symbol=AAPL side=BUY price=10000 qty=REMOVED"]
    sinks.file_sink(f"file://{tmp_path}/lines")(df)
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/lines/shard=0").collect()] == lines
    sinks.per_shard({1: sinks.table_sink(f"file://{tmp_path}/one")})(df)
    assert spark.read.parquet(f"file://{tmp_path}/one").count() == 3


@pytest.mark.parametrize("n", [1, 2, 100, 1000])
def test_nearest_rank_percentiles(spark, n):
    names = [b for _, _, b in latency.INTERVALS] + [e for _, e, _ in latency.INTERVALS]
    stamps = "t_received t_decoded t_demuxed t_dequeued t_book_updated t_delta_dequeued t_published".split()
    assert set(names) <= set(stamps)
    rows = [tuple(i * 10 * k for k in range(7)) for i in range(1, n + 1)]
    got = {r.stage: r for r in latency.statistics(spark.createDataFrame(rows, ", ".join(f"{s} long" for s in stamps))).collect()}
    values = [i * 60 for i in range(1, n + 1)]
    rank = lambda p: values[min(n, max(1, -(-int(p * 1000) * n // 1000))) - 1]
    assert got == {r.stage: r for r in latency.statistics(spark.createDataFrame(rows, ", ".join(f"{s} long" for s in stamps)), chunk=70).collect()}
    r = got["end_to_end"]
    assert (r.n, r.p50, r.p99, r.p999, r.max) == (n, rank(0.5), rank(0.99), rank(0.999), n * 60) and r.mean == sum(values) / n
    kept = []
    sinks.latency_recording(sinks.null_sink, lambda d: kept.append(d.agg(F.sum("book_update")).first()[0]))(spark.createDataFrame(rows, ", ".join(f"{s} long" for s in stamps)))
    assert kept == [sum(i * 10 for i in range(1, n + 1))]


# ---- generator ----

def test_generator():
    def make(**o):
        return generator.Feed(("AAPL", "MSFT", "GOOG"), seed=123, **o)

    sent = list(make(messages=5000, block=700).packets())
    assert len(sent) == 5000 and None not in sent
    home, seen, kinds = {}, {}, Counter()
    for raw in sent:
        kind, _, seq, oid = struct.unpack_from("<BHQQ", raw)
        kinds[kind] += 1
        if kind == 1:
            assert oid not in home
            home[oid] = raw[19:27].rstrip(b"\0").decode()
        elif kind == 4:
            home[struct.unpack_from("<Q", raw, 19)[0]] = home[oid]
        seen.setdefault(shard_of(home[oid], 4), []).append(seq)
    assert all(x == list(range(1, len(x) + 1)) for x in seen.values())
    assert 0.48 < kinds[1] / 5000 < 0.54 and all(abs(kinds[k] / 5000 - p) < 0.03 for k, p in generator.MIX.items())
    lost = sum(x is None for x in make(messages=20_000, loss=0.1).packets())
    assert 0.08 < lost / 20_000 < 0.12
    assert list(make(messages=500, loss=0.05).packets()) == list(make(messages=500, loss=0.05).packets())
    assert [x for x in make(messages=900, loss=0.3, block=100).make(4).packets().to_pylist() if x] == [x for x in list(make(messages=900, loss=0.3, block=100).packets())[400:500] if x]
    for wrong in ({"shards": 17}, {"loss": 2}):
        with pytest.raises(ValueError):
            generator.Feed(("A",), **wrong)
    with pytest.raises(ValueError):
        generator.Feed(())


def test_generated_feed_through_the_pipeline(spark):
    spark.dataSource.register(generator.FeedSource)
    packets = spark.read.format("order_feed").option("symbols", "AAPL,MSFT,GOOG,AMZN,TSLA").option("messages", 1500).option("loss", 0.02).option("seed", 9).option("channels", 2).load()
    rows = [(r.channel, r.arrival_no, bytes(r.raw) if r.raw else None) for r in packets.collect()]
    batch = run_packets(spark.createDataFrame(rows, "channel int, arrival_no long, raw binary"), 4, "channel")
    sent = codec.decode(spark.createDataFrame([x for x in rows if x[2]], "channel int, arrival_no long, raw binary")).collect()
    model = Model(4).run([r.asDict() for r in sent])
    assert sorted((x.arrival_no, x.symbol, x.error) for x in batch.folded.collect()) == sorted(model.status)
    assert levels.replay_difference(batch.deltas, batch.levels).count() == 0
    assert len(rows) == 3000 == len({x[1] for x in rows}) and batch.folded.count() + sum(x[2] is None for x in rows) == 3000


def test_generated_ranges(spark):
    """Any range of a feed is the same rows, whatever it is cut into."""
    options = {"symbols": "AAPL,MSFT,GOOG,AMZN", "messages": "20000", "channels": "2", "loss": "0.01", "seed": "3"}

    def rows(start, end):
        return [tuple(x.values()) for part in generator._ranges(options, start, end) for batch in generator._read(options, part) for x in batch.to_pylist()]

    whole = rows(0, 20_000)
    assert len(whole) == 40_000 and sorted(rows(0, 8_000) + rows(8_000, 8_300) + rows(8_300, 8_300) + rows(8_300, 20_000), key=lambda r: r[1]) == sorted(whole, key=lambda r: r[1])


# ---- streams ----

def test_stream_equals_batch_and_restarts(spark, tmp_path):
    from quotemill.streaming import pipeline as streams

    spark.dataSource.register(generator.FeedSource)
    options = {"symbols": "AAPL,MSFT,GOOG,AMZN", "messages": 600, "seed": 5, "channels": 2, "loss": 0.01}
    packets = spark.createDataFrame([(r.channel, r.arrival_no, bytes(r.raw) if r.raw else None) for r in spark.read.format("order_feed").options(**options).load().collect()], "channel int, arrival_no long, raw binary")
    want = run_packets(packets, 4, "channel").deltas
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "channel int, arrival_no long, raw binary"
    for k in range(2):  # the second run goes on where the first ended
        packets.filter((F.col("arrival_no") < 600) == (k == 0)).coalesce(1).write.mode("append").parquet(source)
        stream = streams.deltas(streams.folded(streams.messages_of(spark.readStream.schema(schema).parquet(source))))
        streams.start(stream, lambda b: b.write.mode("append").parquet(out), checkpoint=state, partitions=2).awaitTermination()
    pick = ["arrival_no", "leg", "symbol", "shard", "side", "price", "total_quantity", "order_count"]
    got = spark.read.parquet(out).select(*pick)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(*pick).collect()))


def test_generator_streams_and_drains(spark):
    from quotemill.streaming import pipeline as streams

    spark.dataSource.register(generator.FeedSource)
    options = {"messages": 300, "seed": 5, "perSecond": 100_000, "began": 0}
    seen = []
    with streams.running(streams.folded(streams.messages_of(spark.readStream.format("order_feed").options(**options).load())), lambda b: seen.append(b.count()), partitions=2) as query:
        assert query.isActive
    assert sum(seen) == 300 and not query.isActive


def test_streamed_sinks_resync_and_counters(spark, tmp_path):
    """A global feed: shards on deltas for sinks, rejects with undecodable packets, resynchronisation, counters while it runs."""
    from quotemill.streaming import metrics
    from quotemill.streaming import pipeline as streams

    spark.dataSource.register(generator.FeedSource)
    options = {"symbols": "AAPL,MSFT,GOOG,AMZN,META", "messages": 200, "seed": 6, "channels": 2, "loss": 0.05}
    rows = [(r.arrival_no, bytes(r.raw)[: 9 if r.arrival_no % 50 == 0 else 99] if r.raw else None) for r in spark.read.format("order_feed").options(**options).load().collect()]
    packets = spark.createDataFrame(rows, "arrival_no long, raw binary")
    want = run_packets(packets, 4)
    source = f"file://{tmp_path}/in"
    packets.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(packets.schema).parquet(source)
    counters = metrics.Counters()
    spark.streams.addListener(counters)
    fold = lambda: metrics.counted(streams.folded(streams.messages_of(stream()), None))
    sink = sinks.per_shard({1: sinks.table_sink(f"file://{tmp_path}/one")}, sinks.file_sink(f"file://{tmp_path}/lines", "append"))
    streams.start(streams.deltas(fold()), sink, partitions=2).awaitTermination()
    made = want.deltas.groupBy("shard").count().collect()
    lines = {r.shard: r["count"] for r in spark.read.text(f"file://{tmp_path}/lines").groupBy("shard").count().collect()}
    lines[1] = spark.read.parquet(f"file://{tmp_path}/one").count()
    assert lines == {r.shard: r["count"] for r in made}
    bad = []
    streams.start(streams.rejects(streams.folded(streams.messages_of(stream()), None), streams.undecodable_of(stream())), lambda b: bad.extend(map(tuple, b.collect())), partitions=2).awaitTermination()
    assert Counter(bad) == Counter(map(tuple, want.rejects.collect())) and any(r[1] == "decode" for r in bad)
    control = spark.createDataFrame([(1, 150, 5), (3, 250, 400)], "shard int, arrival_no long, seq_num long")
    control.coalesce(1).write.parquet(f"file://{tmp_path}/control")
    controls = spark.readStream.schema(control.schema).parquet(f"file://{tmp_path}/control")
    got = []
    seen = streams.gaps(streams.observed(streams.folded(streams.messages_of(stream()), None), controls))
    streams.start(metrics.counted_gaps(seen), lambda b: got.extend(b.collect()), partitions=2).awaitTermination()
    both = want.routed.select("shard", (F.col("arrival_no") * 2).alias("arrival_no"), "seq_num", F.lit(False).alias("resync")).unionByName(control.select("shard", (F.col("arrival_no") * 2 + 1).alias("arrival_no"), "seq_num", F.lit(True).alias("resync")))
    batch = gaps.classify(both).collect()
    assert Counter((r.shard, r.seq_num, r.last_seq, r.kind, r.stale, r.gaps_total) for r in got) == Counter((r.shard, r.seq_num, r.last_seq, r.kind, r.stale, r.gaps_total) for r in batch)
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(counters)
    feed = counters.totals["feed"]
    assert feed["messages"] == want.folded.count() and feed["deltas"] == want.deltas.count() and counters.totals["gaps"]["gaps"] == sum(r.kind == "Gap" for r in batch)


class CountedState(dict):
    """A map state in memory that counts its calls."""

    calls = 0

    def __getattribute__(self, name):
        if name in ("exists", "containsKey", "getValue", "updateValue", "removeKey"):
            CountedState.calls += 1
        return super().__getattribute__(name)

    exists = __len__ = lambda self: len(self.keys())
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__


def test_streamed_state_is_called_for_pages_not_messages():
    import pandas as pd

    from quotemill.streaming import processors

    state, whole = CountedState(), lifecycle.Fold()
    CountedState.calls = 0
    fold, level = processors.FoldProcessor(4), processors.LevelProcessor()
    fold.orders, level.state = state, CountedState()
    want, got, books = [], [], {}
    for k in range(2):
        at = range(k * 3000, k * 3000 + 3000)
        rows = [(1, n, 0, "AAPL", 0, 100 + n % 7, 10, 14) if n % 3 == 0 else (2, n - 1, 0, None, 0, 0, 0, 15) if n % 3 == 1 and n % 2 else (4, n // 3 * 3, n, None, 0, 90, 5, 0) if n % 3 == 2 else (3, n - 3, 0, None, 0, 0, 4, 1) for n in at]
        rows = [(m, o, w, s, d, p, q, 15 if m == 2 else 1 if m in (1, 3) else 0) for m, o, w, s, d, p, q, _ in rows]
        want += [whole.apply(m, o, None if z & 1 else w, s, None if z & 2 else d, None if z & 4 else p, None if z & 8 else q) for m, o, w, s, d, p, q, z in rows]
        frame = pd.DataFrame(rows, columns=["msg_type", "order_id", "new_order_id", "symbol", "side", "price", "quantity", "nulls"]).assign(arrival_no=at, seq_num=at, timestamp=at, evicted=False)
        made = pd.concat(list(fold.handleInputRows((0,), iter([frame.iloc[1500:], frame.iloc[:1500]]), None)))
        got += [(r.symbol, r.error, [(r.side0, r.price0, r.d_qty0, r.d_count0), (r.side1, r.price1, r.d_qty1, r.d_count1)][: r.n_legs]) for r in made.itertuples()]
        legs = [(r.arrival_no, i, r.symbol, *((r.side0, r.price0, r.d_qty0, r.d_count0), (r.side1, r.price1, r.d_qty1, r.d_count1))[i], 0, 0, 0) for r in made.itertuples() for i in range(r.n_legs)]
        changes = pd.DataFrame(legs, columns=["arrival_no", "leg", "symbol", "side", "price", "d_qty", "d_count", "seq_num", "timestamp", "shard"])
        for r in pd.concat(list(level.handleInputRows(("AAPL",), iter([changes]), None))).itertuples():
            quantity, orders = books.get((r.side, r.price), (0, 0))
            books[r.side, r.price] = quantity + r.d_qty, orders + r.d_count
            assert books[r.side, r.price] == (r.total_quantity, r.order_count)
    assert got == want and {e for _, e, _ in got} >= {None, "UnroutableOrderId"}
    assert dict(level.state) == {k: v for k, v in books.items() if v[1]}
    assert CountedState.calls < 200  # for 6,000 messages


def test_streamed_ids_keep_all_their_digits(spark, tmp_path):
    """Nulls beside them don't turn them into floats."""
    from quotemill.streaming import pipeline as streams

    big = (1 << 60) + 1
    rows = frame(spark, [add(10, big, 0, 100, 10), replace(11, big, big + 2, 101, 7), execute(12, big + 2, 3), cancel(13, big)])
    source = f"file://{tmp_path}/in"
    rows.coalesce(1).write.parquet(source)
    got = []
    streams.start(streams.folded(spark.readStream.schema(rows.schema).parquet(source), None), lambda b: got.extend(b.collect()), partitions=2).awaitTermination()
    assert sorted(map(tuple, got)) == sorted(map(tuple, run_messages(rows, 4).folded.select(got[0].__fields__).collect()))
    assert {r.new_order_id for r in got} == {None, big + 2}


def test_queues_in_the_pipeline(spark):
    """Evicted messages are routed, but show as gaps; what follows an evicted add finds no order."""
    from quotemill.plans.pipeline import Queues

    rows = [add(n, n, 0, 100, 10) for n in range(10, 16)] + [cancel(16, 10), execute(17, 15, 4), execute(20, 11, 5), cancel(21, 14), replace(22, 15, 40, 101, 3), cancel(23, 40)]
    batch = run_messages(frame(spark, rows), 1, queues=Queues(4, 10)).persisted()
    # Arrivals 10 to 19 are one burst of 8: 10 to 13 are evicted.
    assert sorted(map(tuple, batch.rejects.collect())) == [(n, "queue", "QueueOverflow") for n in range(10, 14)] + [(16, "book", "OrderNotFound"), (20, "book", "OrderNotFound")]
    assert [(r.expected, r.got) for r in gaps.gap_events(batch.gaps).orderBy("arrival_no").collect()] == [(18, 20)]
    assert {(r.order_id, r.remaining) for r in batch.resting.collect()} == set()
    assert {r.order_id for r in lifecycle.routed_ids(batch.folded).collect()} == {12, 13}
    whole = run_messages(frame(spark, rows), 1, queues=Queues(8, 10))
    assert whole.rejects.count() == 0


def test_traces(spark):
    rows = frame(spark, BOOK).withColumn("t_received", F.col("arrival_no") * 1000)
    kept = []
    sinks.latency_recording(sinks.null_sink, lambda d: kept.extend(d.collect()))(run_messages(rows, 4, trace=True).deltas)
    assert len(kept) == 10 and all(r.t_received == r.arrival_no * 1000 and r.t_received <= r.t_decoded <= r.t_demuxed <= r.t_book_updated <= r.t_delta_dequeued <= r.t_published for r in kept)
    assert all(r.end_to_end == r.t_published - r.t_received and r.book_update >= 0 for r in kept)


def test_changes_and_rates(spark):
    df = spark.createDataFrame([(100.0, 110.0, 2.0, 1000), (0.0, 5.0, 1.0, 0)], "a double, b double, s double, n long")
    got = df.select(latency.percent_change(F.col("a"), F.col("b")).alias("p"), latency.per_message(F.col("s"), F.col("n")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(10.0, 2_000_000.0), (None, None)]


def test_console_sink(spark, capsys):
    df = spark.createDataFrame([(0, 1, 0, "AAPL", 0, 10000, 150, 42, 12345)], DELTA)
    sinks.console_sink()(df)
    assert "seq=42 ts=12345 symbol=AAPL side=BUY price=10000 qty=150" in capsys.readouterr().out
