"""The matching engine against a plain list-based model, and its rules one by one."""

import random

from tidemark.operators.matching import COLUMNS, Book, match, replay, slot_of


class Plain:
    """The same rules with one list of resting orders, sorted on every use."""

    def __init__(self):
        self.rest, self.n = [], 0

    def fill(self, o, limit):
        out, sign = [], 1 if o["side"] == "BUY" else -1
        while o["left"] > 0:
            makers = [m for m in self.rest if m["side"] != o["side"] and (limit is None or sign * m["price"] <= sign * limit)]
            if not makers:
                break
            m = min(makers, key=lambda m: (sign * m["price"], m["slot"], m["t"]))
            size = min(o["left"], m["left"])
            o["left"] -= size
            m["left"] -= size
            o["filled"] += size
            m["filled"] += size
            out.append((o["id"], m["id"], m["price"], size, o["left"] > 0, m["left"] > 0))
            if not m["left"]:
                self.rest.remove(m)
        return out

    def put(self, o):
        self.n += 1
        o["t"] = self.n
        if o["left"]:
            self.rest.append(o)

    def step(self, kind, id_, trader, side, price, size):
        if kind == "limit":
            o = {"id": id_, "trader": trader, "side": side, "price": price, "size": size, "left": size, "filled": 0, "slot": slot_of(trader, size)}
            out = self.fill(o, price)
            self.put(o)
            return out
        if kind == "market":
            return self.fill({"id": id_, "side": side, "left": size, "filled": 0}, None)
        if kind == "cancel_trader":
            self.rest = [o for o in self.rest if o["trader"] != trader]
            return []
        own = [o for o in self.rest if o["id"] == id_]
        if not own:
            return []
        o = own[0]
        if kind == "cancel":
            self.rest.remove(o)
            return []
        price, size = price if price is not None else o["price"], size if size is not None else o["size"]
        if (price, size) == (o["price"], o["size"]):
            return []
        if size <= o["filled"]:
            self.rest.remove(o)
            return []
        slot = slot_of(o["trader"], size)
        same = price == o["price"] and slot == o["slot"]
        o |= {"size": size, "left": size - o["filled"]}
        if same:
            return []
        self.rest.remove(o)
        o |= {"price": price, "slot": slot}
        out = self.fill(o, price)
        self.put(o)
        return out


def flow(rng, n):
    for i in range(n):
        kind = rng.choices(["limit", "market", "cancel", "modify", "cancel_trader"], [50, 15, 15, 18, 2])[0]
        id_ = i if kind in ("limit", "market") else rng.randrange(max(i, 1))
        price = rng.randrange(90, 111) if kind == "limit" or kind == "modify" and rng.random() < 0.5 else None
        size = rng.choice([rng.randrange(1, 50), rng.randrange(900, 1100)]) if kind in ("limit", "market") or rng.random() < 0.6 else None
        yield i, kind, id_, rng.randrange(130), rng.choice(["BUY", "SELL"]), price, size


def test_engine_follows_the_plain_model():
    for seed in range(30):
        book, model = Book(), Plain()
        for row in flow(random.Random(seed), 400):
            got = [t[1:] for t in replay(book, [row])]
            assert got == model.step(*row[1:])
        want = {}
        for o in model.rest:
            v, n = want.get((o["side"], o["price"]), (0, 0))
            want[o["side"], o["price"]] = v + o["left"], n + 1
        assert {(s, p): (v, n) for s, p, v, n in book.depth()} == want


def test_spark_matches_symbols_apart(spark):
    rows = [(s, *r) for s in (1, 2, 3) for r in flow(random.Random(s), 200)]
    df = spark.createDataFrame(rows, "symbol long, seq long, kind string, id long, trader long, side string, price long, size long")
    got = sorted(tuple(r) for r in match(df.repartition(5)).collect())
    want = []
    for s in (1, 2, 3):
        want += [(s, *t) for t in replay(Book(), flow(random.Random(s), 200))]
    assert got == sorted(want) and len(got) > 50
    assert COLUMNS[0] == "symbol"


def test_rules():
    b = Book()
    assert b.market(1, 5, "BUY", 10) == []
    b.limit(1, 200, "SELL", 100, 10)
    b.limit(2, 99, "SELL", 100, 10)  # a VIP's order goes first
    assert b.market(3, 7, "BUY", 15) == [(3, 2, 100, 10, True, False), (3, 1, 100, 5, False, True)]
    assert b.modify(1, None, 5) == (True, []) and not b.cancel(1)  # filled up to the new size: gone
    b.limit(4, 200, "BUY", 90, 999)
    assert b.modify(4, None, 1000) == (True, []) and b.orders[4]["slot"] == slot_of(200, 1000)
    assert b.cancel(4) and not b.cancel(4)
