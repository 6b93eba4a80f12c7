"""The matching engine: limit and market orders, cancels and modifies by symbol, in order of arrival.

What an event does depends on all before it in its symbol, so a symbol is worked off in order by one task, symbols in parallel: a
symbol's events take as long as one core needs for them (some hundred thousand a second), whatever the cluster. The task reads its rows
as they stream, keeps only what rests in the book, and writes trades as it goes. Orders leave the book, and a trader's orders are
found, without a look at any other.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SLOTS = 16


def slot_of(trader: int, size: int) -> int:
    return 1 if trader < 100 else 2 if size < 1000 else 3 + trader % 12


class Book:
    """Price levels of sixteen slots of orders, first in, first out within a slot. Prices of a side are kept sorted."""

    def __init__(self) -> None:
        self.levels: dict[str, dict[int, list[dict[int, dict]]]] = {"BUY": {}, "SELL": {}}
        self.prices: dict[str, list[int]] = {"BUY": [], "SELL": []}  # best last
        self.orders: dict[int, dict] = {}
        self.of_trader: dict[int, dict[int, dict]] = {}
        self.rested = 0

    def _sign(self, side: str) -> int:
        return 1 if side == "BUY" else -1

    def rest(self, order: dict) -> None:
        side, price = order["side"], order["price"]
        if price not in self.levels[side]:
            self.levels[side][price] = [{} for _ in range(SLOTS)]
            insort(self.prices[side], self._sign(side) * price)
        self.rested += 1
        order["place"] = self.rested
        self.levels[side][price][order["slot"]][order["place"]] = order
        self.orders[order["id"]] = order
        self.of_trader.setdefault(order["trader"], {})[order["id"]] = order

    def best(self, side: str) -> int | None:
        """Best price with anything live; levels left empty go."""
        while self.prices[side]:
            price = self._sign(side) * self.prices[side][-1]
            if any(self.levels[side][price]):
                return price
            self.prices[side].pop()
            del self.levels[side][price]
        return None

    def match(self, taker: dict, limit: int | None) -> list[tuple]:
        """Trades (taker, maker, price, size, taker_partial, maker_partial), at the makers' prices."""
        other, trades = "SELL" if taker["side"] == "BUY" else "BUY", []
        while taker["left"] > 0 and (price := self.best(other)) is not None:
            if limit is not None and (price > limit if taker["side"] == "BUY" else price < limit):
                break
            maker = next(iter(next(q for q in self.levels[other][price] if q).values()))
            size = min(taker["left"], maker["left"])
            taker["left"] -= size
            maker["left"] -= size
            taker["filled"] += size
            maker["filled"] += size
            trades.append((taker["id"], maker["id"], price, size, taker["left"] > 0, maker["left"] > 0))
            if not maker["left"]:
                self._drop(maker)
        return trades

    def limit(self, id_: int, trader: int, side: str, price: int, size: int) -> list[tuple]:
        order = {"id": id_, "trader": trader, "side": side, "price": price, "size": size, "left": size, "filled": 0, "slot": slot_of(trader, size)}
        trades = self.match(order, price)
        if order["left"]:
            self.rest(order)
        return trades

    def market(self, id_: int, trader: int, side: str, size: int) -> list[tuple]:
        return self.match({"id": id_, "trader": trader, "side": side, "left": size, "filled": 0}, None)

    def cancel(self, id_: int) -> bool:
        order = self.orders.get(id_)
        if order is None:
            return False
        self._drop(order)
        return True

    def _drop(self, order: dict) -> None:
        """Out of its level and the indexes; a level left empty goes when it is next the best."""
        self.levels[order["side"]][order["price"]][order["slot"]].pop(order["place"], None)
        if self.orders.get(order["id"]) is order:
            del self.orders[order["id"]]
        own = self.of_trader.get(order["trader"], {})
        if own.get(order["id"]) is order:
            del own[order["id"]]
            if not own:
                del self.of_trader[order["trader"]]

    def cancel_trader(self, trader: int) -> int:
        return sum(self.cancel(i) for i in list(self.of_trader.get(trader, ())))

    def modify(self, id_: int, price: int | None, size: int | None) -> tuple[bool, list[tuple]]:
        """A size alone keeps the order's place unless its slot changes; a price moves it to the tail after it has matched again."""
        order = self.orders.get(id_)
        if order is None:
            return False, []
        new_price, new_size = price if price is not None else order["price"], size if size is not None else order["size"]
        if new_price == order["price"] and new_size == order["size"]:
            return True, []
        if new_size <= order["filled"]:
            return self.cancel(id_), []
        slot = slot_of(order["trader"], new_size)
        if new_price == order["price"] and slot == order["slot"]:
            order["size"], order["left"] = new_size, new_size - order["filled"]
            return True, []
        self._drop(order)
        order |= {"price": new_price, "size": new_size, "left": new_size - order["filled"], "slot": slot}
        trades = self.match(order, new_price)
        if order["left"]:
            self.rest(order)
        return True, trades

    def depth(self) -> list[tuple[str, int, int, int]]:
        """side, price, volume and number of live orders of each level."""
        out = []
        for side, levels in self.levels.items():
            for price, slots in levels.items():
                alive = [o for q in slots for o in q.values()]
                if alive:
                    out.append((side, price, sum(o["left"] for o in alive), len(alive)))
        return out


def replay(book: Book, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (seq, kind, id, trader, side, price, size) into trades with the row's seq."""
    for seq, kind, id_, trader, side, price, size in rows:
        if kind == "limit":
            trades = book.limit(id_, trader, side, price, size)
        elif kind == "market":
            trades = book.market(id_, trader, side, size)
        elif kind == "cancel":
            book.cancel(id_)
            trades = []
        elif kind == "cancel_trader":
            book.cancel_trader(trader)
            trades = []
        else:
            trades = book.modify(id_, price, size)[1]
        for t in trades:
            yield (seq, *t)


TRADES = "symbol long, seq long, taker_id long, maker_id long, price long, size long, taker_partial boolean, maker_partial boolean"
COLUMNS = ["symbol", "seq", "kind", "id", "trader", "side", "price", "size"]


def match(events: DataFrame) -> DataFrame:
    """Trades of a stream of events (symbol, seq, kind, id, trader, side, price, size; price and size null where a kind has none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, book = None, Book()
        for b in batches:
            out = []
            none = lambda x: None if pd.isna(x) else int(x)
            for r in b[COLUMNS].itertuples(index=False, name=None):
                if r[0] != symbol:
                    symbol, book = r[0], Book()
                out += [(symbol, *t) for t in replay(book, [(r[1], r[2], none(r[3]), none(r[4]), r[5], none(r[6]), none(r[7]))])]
            yield pd.DataFrame(out, columns=["symbol", "seq", "taker_id", "maker_id", "price", "size", "taker_partial", "maker_partial"])

    ordered = events.select(*COLUMNS).repartition("symbol").sortWithinPartitions("symbol", "seq")
    return ordered.mapInPandas(run, TRADES)
