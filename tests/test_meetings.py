"""Users who meet are counted block by block: no pair of users is shuffled."""

from datetime import datetime, timedelta

import __spark_entry__
from meshwork.kernels import meetings
from meshwork.sources import graph as guests

D = "/root/testdata/sf0.001"


def test_no_pair_is_shuffled(spark, tmp_path, monkeypatch):
    rows = [(u, ("a", "b", None)[u % 3], datetime(2024, 1, 1) + timedelta(minutes=37 * i)) for u in range(60) for i in range(u % 7 + 1)]
    rows += [(None, "a", datetime(2024, 1, 1)), (1, "a", None), (77, "alone", datetime(2024, 1, 1)), *rows[:20]]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    keys = {}
    for u, kind, ts in rows:
        if None not in (u, kind, ts):
            keys.setdefault((kind, ts.replace(minute=0)), set()).add(u)
    want = {}
    for us in keys.values():
        for u in us:
            for v in us - {u}:
                want[u, v] = want.get((u, v), 0) + 1
    for at_a_time in (meetings.MEETINGS, 8):  # dense and sparse counting
        monkeypatch.setattr(meetings, "MEETINGS", at_a_time)
        monkeypatch.setattr(guests, "ROWS_A_TASK", 40)
        g = guests.user_cooccur(spark, str(tmp_path))
        got = [tuple(r) for r in g.edges.collect()]
        assert len(got) == len(set(got)) == len(want) and {(u, v): w for u, v, w in got} == want
        assert {r["u"] for r in g.vertices.collect()} == {u for u, _ in want}


def test_counting_in_small_steps(monkeypatch):
    import pandas as pd

    rows = pd.DataFrame([(u, "k", h) for u in range(40) for h in range(u % 5)] + [(u, "far", u) for u in range(40, 300)], columns=["u", "kind", "h"])
    one = meetings.block_of((0,), rows).iloc[0].to_dict()
    whole = sorted(r for b in meetings.shared(one, one) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for n in (1, 8, 100):
        monkeypatch.setattr(meetings, "MEETINGS", n)
        assert sorted(r for b in meetings.shared(one, one) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)) == whole


def test_plan_of_the_query(spark):
    plan = __spark_entry__.queries()["guest_user_cooccur"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
