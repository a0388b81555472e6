"""SQL for DuckDB, written apart from the Spark plans: the feed, a recursive walk per channel, and what follows from it."""

from __future__ import annotations

FEED = r"""
WITH RECURSIVE symbols AS (
  SELECT 'SYM' || lpad(i::VARCHAR, 2, '0') AS symbol, i FROM range(16) t(i)),
h0 AS (SELECT symbol, i, 1469598103934665603::HUGEINT AS h FROM symbols),
h1 AS (SELECT symbol, i, (xor(h, CASE WHEN length(symbol) >= 1 THEN ascii(symbol[1]) ELSE 0 END::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT AS h FROM h0),
h2 AS (SELECT symbol, i, (xor(h, CASE WHEN length(symbol) >= 2 THEN ascii(symbol[2]) ELSE 0 END::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT AS h FROM h1),
h3 AS (SELECT symbol, i, (xor(h, CASE WHEN length(symbol) >= 3 THEN ascii(symbol[3]) ELSE 0 END::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT AS h FROM h2),
h4 AS (SELECT symbol, i, (xor(h, CASE WHEN length(symbol) >= 4 THEN ascii(symbol[4]) ELSE 0 END::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT AS h FROM h3),
h5 AS (SELECT symbol, i, (xor(h, CASE WHEN length(symbol) >= 5 THEN ascii(symbol[5]) ELSE 0 END::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT AS h FROM h4),
h6 AS (SELECT symbol, i, (xor(h, CASE WHEN length(symbol) >= 6 THEN ascii(symbol[6]) ELSE 0 END::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT AS h FROM h5),
h7 AS (SELECT symbol, i, (xor(h, CASE WHEN length(symbol) >= 7 THEN ascii(symbol[7]) ELSE 0 END::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT AS h FROM h6),
h8 AS (SELECT symbol, i, (xor(h, CASE WHEN length(symbol) >= 8 THEN ascii(symbol[8]) ELSE 0 END::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT AS h FROM h7),
hashed AS (SELECT symbol, i, h AS hash FROM h8),
dim AS (SELECT symbol AS feed_symbol, i, hash, (hash % 4)::INTEGER AS shard FROM hashed),
base AS (
  SELECT event_id AS arrival_no, CASE WHEN event_type IN ('signup', 'view') THEN 1 WHEN event_type = 'error' THEN 2 WHEN event_type = 'click' THEN 3 WHEN event_type = 'purchase' THEN 4 END AS msg_type,
    event_id + 1 AS own_id, user_id AS channel, event_id % 2 AS feed_side, 2000 + regexp_extract(props, '(\d+)', 1)::BIGINT * 7 % 90 AS feed_price, 5 + event_id * 3 % 28 AS qty, 2 + event_id * 5 % 17 AS exec_qty, epoch_us(ts) * 1000 AS timestamp
  FROM events),
numbered AS (
  SELECT base.*, feed_symbol, shard, row_number() OVER (PARTITION BY shard ORDER BY arrival_no) AS seq_num,
    last_value(CASE WHEN msg_type IN (1, 4) THEN own_id END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY arrival_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref_id
  FROM base JOIN dim ON dim.i = channel % 16),
gen AS (
  SELECT arrival_no, msg_type, seq_num, CASE WHEN msg_type = 1 THEN own_id ELSE ref_id END AS order_id, CASE WHEN msg_type = 4 THEN own_id END AS new_order_id,
    CASE WHEN msg_type = 1 THEN feed_symbol END AS symbol, CASE WHEN msg_type = 1 THEN feed_side END AS side, CASE WHEN msg_type IN (1, 4) THEN feed_price END AS price,
    CASE WHEN msg_type = 3 THEN exec_qty WHEN msg_type IN (1, 4) THEN qty END AS quantity, timestamp, channel, shard AS feed_shard,
    arrival_no % 97 = 13 AS lost, msg_type <> 1 AND ref_id IS NULL AS before_start
  FROM numbered),
feed AS (SELECT * FROM gen WHERE NOT lost AND NOT before_start),
"""

#: One step per channel and message: an order's state is that of the channel's newest id.
FOLD = FEED + r"""
ord AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY arrival_no) AS n FROM feed),
st AS (
  SELECT DISTINCT channel, 0::BIGINT AS n, NULL::BIGINT AS arrival_no, NULL::BIGINT AS cur, NULL::BIGINT AS remaining, NULL::BIGINT AS cur_side, NULL::BIGINT AS cur_price, NULL::VARCHAR AS cur_symbol, NULL::VARCHAR AS error, NULL::VARCHAR AS symbol,
    NULL::BIGINT AS l_side, NULL::BIGINT AS l_price, NULL::BIGINT AS l_qty, NULL::BIGINT AS l_count FROM feed
  UNION ALL
  SELECT m.channel, m.n, m.arrival_no,
    CASE WHEN m.msg_type = 1 THEN m.order_id WHEN s.cur IS DISTINCT FROM m.order_id THEN s.cur WHEN m.msg_type = 2 THEN NULL WHEN m.msg_type = 4 THEN m.new_order_id WHEN m.quantity = s.remaining THEN NULL ELSE s.cur END,
    CASE WHEN m.msg_type = 1 THEN m.quantity WHEN s.cur IS DISTINCT FROM m.order_id THEN s.remaining WHEN m.msg_type = 4 THEN m.quantity WHEN m.msg_type = 3 AND m.quantity <= s.remaining THEN s.remaining - m.quantity ELSE s.remaining END,
    CASE WHEN m.msg_type = 1 THEN m.side ELSE s.cur_side END,
    CASE WHEN m.msg_type = 1 OR (m.msg_type = 4 AND s.cur = m.order_id) THEN m.price ELSE s.cur_price END,
    CASE WHEN m.msg_type = 1 THEN m.symbol ELSE s.cur_symbol END,
    CASE WHEN m.msg_type = 1 THEN NULL WHEN s.cur IS DISTINCT FROM m.order_id THEN 'UnroutableOrderId' WHEN m.msg_type = 3 AND m.quantity > s.remaining THEN 'ExecutedQuantityExceedsRemaining' END,
    CASE WHEN m.msg_type = 1 THEN m.symbol WHEN s.cur IS NOT DISTINCT FROM m.order_id THEN s.cur_symbol END,
    CASE WHEN m.msg_type = 1 THEN m.side ELSE s.cur_side END,
    CASE WHEN m.msg_type = 1 THEN m.price ELSE s.cur_price END,
    CASE WHEN m.msg_type = 1 THEN m.quantity WHEN m.msg_type = 3 THEN -m.quantity ELSE -s.remaining END,
    CASE WHEN m.msg_type = 1 THEN 1 WHEN m.msg_type = 3 AND m.quantity < s.remaining THEN 0 ELSE -1 END
  FROM st s JOIN ord m ON m.channel = s.channel AND m.n = s.n + 1),
folded AS (
  SELECT f.arrival_no, f.msg_type, f.seq_num, f.order_id, f.new_order_id, f.timestamp, st.symbol, st.error, dim.shard, f.price AS new_price, f.quantity, l_side, l_price, l_qty, l_count
  FROM st JOIN feed f USING (arrival_no) LEFT JOIN dim ON dim.feed_symbol = st.symbol WHERE st.n > 0),
legs AS (
  SELECT arrival_no, 0 AS leg, symbol, shard, l_side AS side, l_price AS price, l_qty AS d_qty, l_count AS d_count, seq_num, timestamp, msg_type, order_id AS id FROM folded WHERE error IS NULL
  UNION ALL
  SELECT arrival_no, 1, symbol, shard, l_side, new_price, quantity, 1, seq_num, timestamp, msg_type, new_order_id FROM folded WHERE error IS NULL AND msg_type = 4),
levels AS (SELECT symbol, side, price, sum(d_qty)::BIGINT AS total_quantity, sum(d_count)::BIGINT AS order_count FROM legs GROUP BY ALL HAVING sum(d_count) > 0),
deltas AS (SELECT *, (sum(d_qty) OVER w)::BIGINT AS total_quantity, (sum(d_count) OVER w)::BIGINT AS order_count FROM legs WINDOW w AS (PARTITION BY symbol, side, price ORDER BY arrival_no, leg ROWS UNBOUNDED PRECEDING)),
ranked AS (SELECT symbol, side, price, total_quantity, order_count, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 0 THEN -price ELSE price END) AS rank FROM levels),
observed AS (SELECT arrival_no, shard, seq_num FROM folded WHERE error IS DISTINCT FROM 'UnroutableOrderId'),
"""


#: The same walk behind queues of 12 messages a shard, drained after every 64 arrivals: a channel's newest id may be routed, or rest, or both.
QUEUED = FOLD + r"""
marks AS (SELECT arrival_no, row_number() OVER (PARTITION BY shard, arrival_no // 64 ORDER BY arrival_no DESC) > 12 AS evicted FROM observed),
qord AS (SELECT feed.*, coalesce(evicted, false) AS evicted, row_number() OVER (PARTITION BY channel ORDER BY arrival_no) AS n FROM feed LEFT JOIN marks USING (arrival_no)),
q AS (
  SELECT DISTINCT channel, 0::BIGINT AS n, NULL::BIGINT AS arrival_no, NULL::BIGINT AS route, NULL::BIGINT AS rests, NULL::BIGINT AS remaining, NULL::VARCHAR AS error FROM feed
  UNION ALL
  SELECT channel, n, arrival_no,
    CASE WHEN msg_type = 1 THEN order_id WHEN error = 'UnroutableOrderId' THEN route WHEN msg_type = 2 THEN NULL WHEN msg_type = 4 THEN new_order_id
      WHEN error = 'OrderNotFound' OR (error IS NULL AND quantity = remaining) THEN NULL ELSE route END,
    CASE WHEN error IS NOT NULL THEN rests WHEN msg_type = 1 THEN order_id WHEN msg_type = 2 OR (msg_type = 3 AND quantity = remaining) THEN NULL WHEN msg_type = 4 THEN new_order_id ELSE rests END,
    CASE WHEN error IS NOT NULL THEN remaining WHEN msg_type IN (1, 4) THEN quantity WHEN msg_type = 3 THEN remaining - quantity ELSE remaining END,
    error
  FROM (
    SELECT m.channel, m.n, m.arrival_no, m.msg_type, m.order_id, m.new_order_id, m.quantity, s.route, s.rests, s.remaining,
      CASE WHEN m.msg_type <> 1 AND s.route IS DISTINCT FROM m.order_id THEN 'UnroutableOrderId' WHEN m.evicted THEN 'QueueOverflow' WHEN m.msg_type = 1 THEN NULL
        WHEN s.rests IS DISTINCT FROM m.order_id THEN 'OrderNotFound' WHEN m.msg_type = 3 AND m.quantity > s.remaining THEN 'ExecutedQuantityExceedsRemaining' END AS error
    FROM q s JOIN qord m ON m.channel = s.channel AND m.n = s.n + 1)),
queued AS (SELECT q.arrival_no, q.error, f.feed_shard AS shard, f.seq_num FROM q JOIN feed f USING (arrival_no) WHERE q.n > 0),
"""


def _classified(source: str, before: str = FOLD) -> str:
    """Walks each shard by windows: segments begin at resynchronisations."""
    return before + f"""
src AS ({source}),
seg AS (SELECT *, sum(resync::INTEGER) OVER (PARTITION BY shard ORDER BY arrival_no ROWS UNBOUNDED PRECEDING) AS segment FROM src),
lastly AS (SELECT *, max(seq_num) OVER (PARTITION BY shard, segment ORDER BY arrival_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seq FROM seg),
kinds AS (SELECT *, CASE WHEN resync THEN 'Resync' WHEN last_seq IS NULL OR seq_num = last_seq + 1 THEN 'InOrder' WHEN seq_num > last_seq THEN 'Gap' ELSE 'Duplicate' END AS kind FROM lastly),
classified AS (
  SELECT *, CASE WHEN kind = 'Gap' THEN last_seq + 1 END AS expected, CASE WHEN kind = 'Gap' THEN seq_num - last_seq - 1 END AS missing,
    bool_or(kind = 'Gap') OVER (PARTITION BY shard, segment ORDER BY arrival_no ROWS UNBOUNDED PRECEDING) AS stale,
    (sum((kind = 'Gap')::INTEGER) OVER (PARTITION BY shard ORDER BY arrival_no ROWS UNBOUNDED PRECEDING))::BIGINT AS gaps_total FROM kinds)
"""


PLAIN = _classified("SELECT *, false AS resync FROM observed")
RESYNC = _classified("SELECT arrival_no, shard, CASE WHEN arrival_no % 499 = 7 THEN seq_num - 2 ELSE seq_num END AS seq_num, arrival_no % 499 = 7 AS resync FROM observed")
BEHIND = _classified("SELECT arrival_no, shard, seq_num, false AS resync FROM queued WHERE error IS NULL OR error NOT IN ('UnroutableOrderId', 'QueueOverflow')", QUEUED)
LATE = _classified("SELECT arrival_no, shard, CASE WHEN arrival_no % 53 = 0 THEN seq_num - 5 ELSE seq_num END AS seq_num, false AS resync FROM observed")

MESSAGE = "arrival_no, msg_type, seq_num, order_id, new_order_id, symbol, side, price, quantity, timestamp"
_LEGS = "SELECT arrival_no, leg, symbol, side, price, d_qty, d_count, seq_num, timestamp FROM legs"

TRACE = FOLD + r"""
t0 AS (SELECT symbol, arrival_no AS n, leg, arrival_no * 1000 AS t_received FROM legs),
t1 AS (SELECT *, t_received + (n * 7 + leg * 3) % 50 AS t_decoded FROM t0),
t2 AS (SELECT *, t_decoded + (n * 13 + leg * 4) % 400 AS t_demuxed FROM t1),
t3 AS (SELECT *, t_demuxed + (n * 31 + leg * 5) % 9000 AS t_dequeued FROM t2),
t4 AS (SELECT *, t_dequeued + (n * 17 + leg * 6) % 900 AS t_book_updated FROM t3),
t5 AS (SELECT *, t_book_updated + (n * 29 + leg * 7) % 7000 AS t_delta_dequeued FROM t4),
t6 AS (SELECT *, t_delta_dequeued + (n * 11 + leg * 8) % 60 AS t_published FROM t5),
sample AS (
  SELECT symbol, t_decoded - t_received AS receive_to_decode, t_demuxed - t_decoded AS decode_to_demux, t_dequeued - t_demuxed AS input_queue_wait, t_book_updated - t_dequeued AS book_update,
    t_delta_dequeued - t_book_updated AS output_queue_wait, t_published - t_delta_dequeued AS publish, t_book_updated - t_received AS tick_to_book_update, t_published - t_received AS end_to_end FROM t6),
"""
_STAGES = "receive_to_decode decode_to_demux input_queue_wait book_update output_queue_wait publish tick_to_book_update end_to_end".split()
_END = "unused AS (SELECT 1)\n"

ORACLE_SQL: dict[str, str] = {
    "feed_messages": FEED + _END + f"SELECT {MESSAGE} FROM feed",
    "feed_mix": FEED + _END + "SELECT msg_type, count(*) AS n FROM feed GROUP BY 1",
    "shard_assignment": FEED + _END + "SELECT DISTINCT symbol, hash::VARCHAR AS hash, shard FROM feed JOIN dim ON symbol = feed_symbol",
    "codec_roundtrip": FEED + _END + f"SELECT {MESSAGE}, NULL::VARCHAR AS decode_error FROM feed",
    "decode_errors": FEED + """e AS (SELECT CASE WHEN arrival_no % 13 = 0 THEN 'TruncatedMessage' WHEN arrival_no % 17 = 0 THEN 'InvalidMessageType' WHEN arrival_no % 19 = 0 THEN 'LengthMismatch'
        WHEN arrival_no % 23 = 0 THEN NULL WHEN arrival_no % 29 = 0 THEN 'TruncatedMessage' END AS decode_error FROM feed)
        SELECT decode_error, count(*) AS n, count(*) FILTER (decode_error IS NULL) AS n_decoded FROM e GROUP BY 1""",
    "route_status": FOLD + _END + "SELECT arrival_no, symbol, shard, CASE WHEN error = 'UnroutableOrderId' THEN error END AS route_error FROM folded",
    "routed_ids": FOLD + """named AS (
        SELECT order_id AS id, arrival_no, 1 AS part, CASE WHEN msg_type = 1 THEN symbol END AS symbol FROM folded WHERE error IS DISTINCT FROM 'UnroutableOrderId' AND (msg_type IN (1, 2) OR (msg_type = 3 AND error IS NULL AND l_count = -1))
        UNION ALL SELECT order_id, arrival_no, 0, NULL FROM folded WHERE error IS NULL AND msg_type = 4
        UNION ALL SELECT new_order_id, arrival_no, 1, symbol FROM folded WHERE error IS NULL AND msg_type = 4),
        newest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival_no DESC, part DESC) AS k FROM named)
        SELECT id AS order_id, symbol FROM newest WHERE k = 1 AND symbol IS NOT NULL""",
    "rejects_by_reason": FOLD + _END + "SELECT CASE WHEN error = 'UnroutableOrderId' THEN 'route' ELSE 'book' END AS stage, error AS reason, count(*) AS n FROM folded WHERE error IS NOT NULL GROUP BY ALL",
    "replace_lineage": FEED + """edges AS (SELECT new_order_id AS id, order_id AS up FROM feed WHERE msg_type = 4),
        tree AS (SELECT DISTINCT up AS order_id, up AS root_id, 0::BIGINT AS depth FROM edges WHERE up NOT IN (SELECT id FROM edges)
          UNION ALL SELECT e.id, t.root_id, t.depth + 1 FROM tree t JOIN edges e ON e.up = t.order_id)
        SELECT * FROM tree""",
    "legs": FOLD + _END + _LEGS,
    "legs_by_lineage": FOLD + _END + _LEGS,
    "legs_from_packets": FOLD + _END + _LEGS,
    "book_deltas": FOLD + _END + "SELECT arrival_no, leg, symbol, shard, side, price, total_quantity, order_count, seq_num, timestamp FROM deltas",
    "delta_lines": FOLD + _END + """SELECT arrival_no, leg, 'seq=' || seq_num || ' ts=' || timestamp || ' symbol=' || symbol || ' side=' || CASE WHEN side = 0 THEN 'BUY' ELSE 'SELL' END || ' price=' || price || ' qty=' ||
        CASE WHEN total_quantity = 0 THEN 'REMOVED' ELSE total_quantity::VARCHAR END AS line FROM deltas""",
    "final_levels": FOLD + _END + "SELECT * FROM levels",
    "best_bid_ask": FOLD + _END + """SELECT symbol, max(price) FILTER (side = 0) AS bid_price, arg_max(total_quantity, price) FILTER (side = 0) AS bid_quantity, arg_max(order_count, price) FILTER (side = 0) AS bid_count,
        min(price) FILTER (side = 1) AS ask_price, arg_min(total_quantity, price) FILTER (side = 1) AS ask_quantity, arg_min(order_count, price) FILTER (side = 1) AS ask_count FROM levels GROUP BY 1""",
    "depth_5": FOLD + _END + "SELECT * FROM ranked WHERE rank <= 5",
    "depth_snapshot_2": FOLD + _END + """SELECT symbol, coalesce(string_agg(price || ':' || total_quantity || ':' || order_count, ' ' ORDER BY rank) FILTER (side = 0), '') AS bids,
        coalesce(string_agg(price || ':' || total_quantity || ':' || order_count, ' ' ORDER BY rank) FILTER (side = 1), '') AS asks FROM ranked WHERE rank <= 2 GROUP BY 1""",
    "book_as_of": FOLD + _END + "SELECT symbol, side, price, sum(d_qty)::BIGINT AS total_quantity, sum(d_count)::BIGINT AS order_count FROM legs WHERE arrival_no <= 500 GROUP BY ALL HAVING sum(d_count) > 0",
    "replay_levels": FOLD + "last AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, price ORDER BY arrival_no DESC, leg DESC) AS k FROM deltas) SELECT symbol, side, price, total_quantity FROM last WHERE k = 1 AND total_quantity <> 0",
    "replay_diff": FOLD + """last AS (SELECT symbol, side, price, arg_max(total_quantity, arrival_no * 2 + leg) AS q FROM deltas GROUP BY ALL),
        a AS (SELECT * FROM last WHERE q <> 0), b AS (SELECT symbol, side, price, total_quantity AS q FROM levels WHERE total_quantity <> 0)
        SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS n_different""",
    "resting_orders": FOLD + """o AS (SELECT id AS order_id, symbol, side, sum(d_qty)::BIGINT AS remaining, arg_max(price, arrival_no * 2 + leg) AS price, max(arrival_no * 2 + leg) FILTER (d_count = 1) AS entered FROM legs GROUP BY ALL HAVING sum(d_count) > 0)
        SELECT order_id, symbol, side, price, remaining, row_number() OVER w AS queue_pos, coalesce(sum(remaining) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS qty_ahead FROM o WINDOW w AS (PARTITION BY symbol, side, price ORDER BY entered)""",
    "order_lifecycle": FOLD + """x AS (SELECT *, CASE WHEN d_count >= 0 THEN 'RESTING' WHEN msg_type = 2 THEN 'CANCELLED' WHEN msg_type = 3 THEN 'FILLED' ELSE 'REPLACED' END AS state FROM legs)
        SELECT id AS order_id, count(*) FILTER (msg_type = 3) AS fills, coalesce(sum(-d_qty) FILTER (msg_type = 3), 0)::BIGINT AS executed, arg_max(state, arrival_no * 2 + leg) AS final_state FROM x GROUP BY 1""",
    "symbol_isolation": FOLD + "home AS (SELECT DISTINCT channel, symbol FROM feed WHERE msg_type = 1) SELECT count(*) FILTER (legs.symbol <> home.symbol) AS n_leaks, count(*) AS n_legs FROM legs JOIN feed USING (arrival_no) JOIN home USING (channel)",
    "gap_events": PLAIN + "SELECT shard, arrival_no, expected, seq_num AS got, missing FROM classified WHERE kind = 'Gap'",
    "gap_lines": PLAIN + "SELECT shard, arrival_no, '[gap_detector] sequence gap: expected ' || expected || ', got ' || seq_num || ' (' || missing || ' message(s) missing) -- marking STALE' AS line FROM classified WHERE kind = 'Gap'",
    "gap_summary": PLAIN + "SELECT shard, count(*) FILTER (kind = 'Gap') AS gaps_total, coalesce(sum(missing), 0)::BIGINT AS missing, count(*) FILTER (kind = 'Duplicate') AS duplicates, max(seq_num) AS last_seq, bool_or(stale) AS stale FROM classified GROUP BY 1",
    "gap_resync": RESYNC + "SELECT arrival_no, shard, seq_num, kind, expected, missing, stale, gaps_total FROM classified",
    "duplicate_seqs": LATE + "SELECT arrival_no, shard, seq_num, last_seq, stale FROM classified WHERE kind = 'Duplicate'",
    "drop_oldest": FEED + "r AS (SELECT dim.shard, arrival_no, order_id, row_number() OVER (PARTITION BY dim.shard ORDER BY arrival_no DESC) AS k FROM feed JOIN dim ON symbol = feed_symbol) SELECT shard, arrival_no, order_id FROM r WHERE k <= 100",
    "drop_counts": FEED + _END + "SELECT dim.shard, count(*) AS pushed, least(count(*), 100) AS retained, greatest(count(*) - 100, 0) AS dropped FROM feed JOIN dim ON symbol = feed_symbol GROUP BY 1",
    "queue_interleaved": FEED + """o AS (SELECT channel, arrival_no, msg_type IN (1, 3) AS push, row_number() OVER (PARTITION BY channel ORDER BY arrival_no) AS k FROM feed),
        q AS (
          SELECT DISTINCT channel, 0::BIGINT AS k, NULL::BIGINT AS n, []::BIGINT[] AS held, NULL::BIGINT AS popped, NULL::BIGINT AS evicted FROM feed
          UNION ALL
          SELECT o.channel, o.k, o.arrival_no, CASE WHEN o.push AND len(held) >= 4 THEN list_append(held[2:], o.arrival_no) WHEN o.push THEN list_append(held, o.arrival_no) ELSE held[2:] END,
            CASE WHEN NOT o.push THEN held[1] END, CASE WHEN o.push AND len(held) >= 4 THEN held[1] END
          FROM q JOIN o ON o.channel = q.channel AND o.k = q.k + 1)
        SELECT channel::VARCHAR AS queue, n, popped, evicted FROM q WHERE k > 0""",
    "latency_samples": TRACE + _END + f"SELECT symbol, {', '.join(f'sum({s})::BIGINT AS {s}' for s in _STAGES)} FROM sample GROUP BY 1",
    "latency_percentiles": TRACE + "long AS (" + " UNION ALL ".join(f"SELECT '{s}' AS stage, {s} AS ns FROM sample" for s in _STAGES) + ") SELECT stage, count(*) AS n, round(avg(ns), 6) AS mean, quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.99) AS p99, quantile_disc(ns, 0.999) AS p999, max(ns) AS max FROM long GROUP BY 1",
    "wall_time_stats": TRACE + _END + "SELECT symbol, count(*) AS n, round(avg(end_to_end), 6) AS mean, round(stddev_pop(end_to_end), 6) AS stddev, min(end_to_end) AS min, max(end_to_end) AS max FROM sample GROUP BY 1",
    "pipeline_counters": FOLD + """g AS (SELECT count(*) AS generated, count(*) FILTER (lost) AS lost FROM gen WHERE NOT before_start),
        f AS (SELECT count(*) FILTER (error = 'UnroutableOrderId') AS unroutable, count(*) FILTER (error <> 'UnroutableOrderId') AS rejected, count(*) FILTER (error IS NULL) AS accepted, count(DISTINCT shard) AS shards_with_books FROM folded)
        SELECT g.*, f.*, (SELECT count(*) FROM legs) AS deltas FROM g, f""",
}

ORACLE_SQL["stream_best_bid_ask"] = ORACLE_SQL["best_bid_ask"]
ORACLE_SQL["stream_gap_summary"] = ORACLE_SQL["gap_summary"]
ORACLE_SQL["has_order"] = FOLD + _END + "SELECT id AS order_id FROM legs GROUP BY 1 HAVING sum(d_count) > 0"
ORACLE_SQL["shard_states"] = PLAIN + "SELECT count(DISTINCT shard) AS shards, count(DISTINCT shard) FILTER (kind = 'Gap') AS shards_with_gaps, count(DISTINCT shard) FILTER (stale) AS shards_stale FROM classified"

ORACLE_SQL["queue_gaps"] = BEHIND + "SELECT shard, arrival_no, expected, seq_num AS got, missing FROM classified WHERE kind = 'Gap'"
_STAGE = "CASE error WHEN 'UnroutableOrderId' THEN 'route' WHEN 'QueueOverflow' THEN 'queue' ELSE 'book' END AS stage"
ORACLE_SQL["queue_rejects"] = QUEUED + _END + f"SELECT arrival_no, {_STAGE}, error AS reason FROM queued WHERE error IS NOT NULL"
ORACLE_SQL["stream_deltas"] = ORACLE_SQL["book_deltas"]
ORACLE_SQL["stream_rejects"] = FOLD + _END + f"SELECT arrival_no, {_STAGE}, error AS reason FROM folded WHERE error IS NOT NULL UNION ALL SELECT arrival_no, 'decode', 'TruncatedMessage' FROM gen WHERE lost AND NOT before_start"
ORACLE_SQL["latency_changes"] = TRACE + _END + "SELECT symbol, count(*) AS n, round((avg(end_to_end) - avg(tick_to_book_update)) * 100.0 / avg(tick_to_book_update), 6) AS percent_change, round(sum(end_to_end) / count(*), 4) AS ns_per_delta FROM sample GROUP BY 1"
ORACLE_SQL["generated_feed"] = "SELECT 8000 AS generated, 8000 AS numbers, 0 AS unaccounted, 0 AS rejected_with_legs, 0 AS levels_different, 0 AS repeated_numbers"
