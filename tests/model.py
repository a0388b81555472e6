"""A plain sequential model of the synchronous pipeline, written apart from the engine: one global walk in arrival order."""

from __future__ import annotations

START, FACTOR = 1469598103934665603, 1099511628211


def shard_of(symbol: str, shards: int) -> int:
    h = START
    for b in symbol.encode()[:8].ljust(8, b"\0"):
        h = ((h ^ b) * FACTOR) & (2**64 - 1)
    return h % shards


class Model:
    def __init__(self, shards: int) -> None:
        self.shards = shards
        self.route: dict[int, str] = {}
        self.books: dict[str, dict[int, dict]] = {}
        self.status: list[tuple] = []
        self.deltas: list[tuple] = []
        self.last: dict[int, int] = {}
        self.gaps: dict[int, int] = {}
        self.stale: dict[int, bool] = {}

    def total(self, symbol: str, side: int, price: int) -> int:
        return sum(o["qty"] for o in self.books[symbol].values() if (o["side"], o["price"]) == (side, price))

    def run(self, messages: list[dict]) -> Model:
        for m in sorted(messages, key=lambda m: m["arrival_no"]):
            self.step(m)
        return self

    def step(self, m: dict) -> None:
        n, kind, oid = m["arrival_no"], m["msg_type"], m["order_id"]
        if kind == 1:
            self.route[oid] = m["symbol"]
        elif oid not in self.route:
            self.status.append((n, None, "UnroutableOrderId"))
            return
        symbol = self.route[oid]
        if kind == 2:
            del self.route[oid]
        if kind == 4:
            del self.route[oid]
            self.route[m["new_order_id"]] = symbol
        self.observe(shard_of(symbol, self.shards), m["seq_num"])
        book = self.books.setdefault(symbol, {})
        error, touched = None, []
        if kind == 1:
            if oid in book:
                error = "DuplicateOrderId"
            else:
                book[oid] = {"side": 1 if m["side"] else 0, "price": m["price"], "qty": m["quantity"], "at": (n, 0)}
                touched = [(book[oid]["side"], m["price"])]
        elif oid not in book:
            error = "OrderNotFound"
        elif kind == 2:
            gone = book.pop(oid)
            touched = [(gone["side"], gone["price"])]
        elif kind == 3:
            if m["quantity"] > book[oid]["qty"]:
                error = "ExecutedQuantityExceedsRemaining"
            else:
                book[oid]["qty"] -= m["quantity"]
                touched = [(book[oid]["side"], book[oid]["price"])]
                if not book[oid]["qty"]:
                    del book[oid]
        elif m["new_order_id"] in book:
            error = "DuplicateOrderId"
        else:
            old = book.pop(oid)
            self.deltas.append((n, 0, symbol, old["side"], old["price"], self.total(symbol, old["side"], old["price"])))
            book[m["new_order_id"]] = {"side": old["side"], "price": m["price"], "qty": m["quantity"], "at": (n, 1)}
            self.deltas.append((n, 1, symbol, old["side"], m["price"], self.total(symbol, old["side"], m["price"])))
        if kind == 3 and oid not in book:
            self.route.pop(oid, None)
        self.status.append((n, symbol, error))
        for side, price in touched:
            self.deltas.append((n, 0, symbol, side, price, self.total(symbol, side, price)))

    def observe(self, shard: int, seq: int) -> None:
        last = self.last.get(shard)
        if last is not None and seq <= last:
            return
        if last is not None and seq > last + 1:
            self.gaps[shard] = self.gaps.get(shard, 0) + 1
            self.stale[shard] = True
        self.last[shard] = seq
