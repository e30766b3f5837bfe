"""Edits as keyed state equal the fold over the whole log, batch by batch, and a batch changes only what it touches."""

import random

from meshwork.streaming import dynamic, keyed


def random_edits(rng, n, ids):
    out = []
    for seq in range(n):
        op = rng.choice(["+v", "+e", "+e", "+e", "ew", "vw", "-e", "-e", "-v"])
        u, v = rng.randrange(ids), rng.randrange(ids)
        w = rng.choice([None, 1, 2, 5]) if op in ("+v", "+e", "-e") else rng.randint(1, 6)
        out.append((seq, op, u, v if "e" in op else None, None if op == "-v" else w))
    return out


def test_state_equals_the_fold(spark, tmp_path):
    rng = random.Random(7)
    edits = random_edits(rng, 300, 12)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    sizes = []
    try:
        for b in range(3):
            part = edits[100 * b : 100 * b + 100] if b < 2 else [(200, "+e", 1, 2, 1)]
            spark.createDataFrame(part, dynamic.EVENTS).coalesce(1).write.mode("append").csv(str(folder / f"b{b}"))
            stream = dynamic.read_event_stream(spark, str(folder / "*"))
            keyed.follow(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
            log = spark.read.schema(keyed.CHANGES).parquet(out)
            sizes.append(log.count())
            got = keyed.graph_of(log)
            done = edits[: 100 * min(b + 1, 2)] + ([(200, "+e", 1, 2, 1)] if b == 2 else [])
            want = dynamic.snapshot(spark.createDataFrame(done, dynamic.EVENTS))
            assert sorted(map(tuple, got.vertices.collect())) == sorted(map(tuple, want.vertices.collect()))
            assert sorted(map(tuple, got.edges.select("u", "v", "w").collect())) == sorted(map(tuple, want.edges.select("u", "v", "w").collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sizes[2] - sizes[1] <= 4  # one edge: its two copies, and its ends if they were missing


class Store:
    """A stand-in for the state of one vertex that counts what is asked of it."""

    def __init__(self):
        self.head, self.pages, self.asked = None, {}, 0

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def exists(self):
        self.asked += 1
        return self.head is not None

    def get(self):
        self.asked += 1
        return self.head

    def update(self, head):
        self.asked, self.head = self.asked + 1, head

    def getValue(self, key):  # noqa: N802
        self.asked += 1
        return self.pages.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.asked += 1
        self.pages[key] = value

    def removeKey(self, key):  # noqa: N802
        self.asked += 1
        self.pages.pop(key, None)


def test_a_batch_asks_the_store_for_pages_not_edges():
    from pyspark.sql import Row

    store, vertex = Store(), keyed.Edits()
    vertex.init(store)
    want = {}

    def batch(edits):
        at = store.asked
        rows = [Row(seq=seq, op=op, v=v, w=w) for seq, op, v, w in edits]
        for r in vertex.handleInputRows((7,), iter(rows), None):
            if r["kind"] == "e":
                want.pop(r["v"], None)
                want.update({} if r["w"] is None else {r["v"]: r["w"]})
        held = {v: w for vs, ws in store.pages.values() for v, w in zip(vs, ws, strict=True)}
        assert held == want and store.head[1] == len(held) and sum(len(vs) for vs, _ in store.pages.values()) == len(held)
        return store.asked - at

    assert batch([(i, "+e", 3 * i + 1, 2) for i in range(200)]) < 10
    assert batch([(1000 + i, "+e", 3 * i + 1, 1) for i in range(3000)]) < 60 and store.head[2] == 16
    assert want[1] == 3 and want[1 + 3 * 2999] == 1
    assert batch([(9000, "-e", 4, None), (9001, "ew", 7, 5)]) < 10 and 4 not in want and want[7] == 5
    assert batch([(9100, "-v", None, None), (9101, "+e", 8, 1)]) < 60 and want == {8: 1} and store.head[0] == 1
    assert batch([(9200, "-e", 8, None)]) < 10 and not want and not store.pages
