import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions.hierarchy import Machine
from meshwork.functions.scalars import adaptive_imbalance, lmax
from meshwork.operators import coarsen, gains, metrics, refine
from meshwork.plans import solver
from meshwork.sources import files
from meshwork.sources.graph import Graph
from meshwork.streaming import dynamic

M = Machine.parse("2:2", "1:10")


def edges_of(n, seed, p=0.4):
    rng = random.Random(seed)
    return [(u, v, rng.randint(1, 5)) for u in range(n) for v in range(u + 1, n) if rng.random() < p]


def cost_of(pairs, pid, m=M):
    return 2 * sum(w * m.between(pid[u], pid[v]) for u, v, w in pairs)


@pytest.fixture(scope="module")
def small(spark):
    pairs = edges_of(14, 3)
    weights = [1 + i % 3 for i in range(14)]
    return pairs, weights, Graph.from_lists(spark, 14, pairs, weights).cached()


@pytest.fixture(scope="module")
def placed(spark, small):
    pid = [(7 * u) % 4 for u in range(14)]
    return pid, spark.createDataFrame(list(enumerate(pid)), "u long, pid long").cache()


@pytest.mark.parametrize("h,d", [("4:4", "1:10"), ("2:3:5", "1:10:100"), ("3:1:2", "1:5:25"), ("1:4", "1:2")])
def test_distance_forms_agree(spark, h, d):
    m = Machine.parse(h, d)
    pes = m.pes(spark)
    ids = m.matrix(spark).join(pes.select(F.col("pid").alias("a"), F.col("ident").alias("ia")), "a").join(pes.select(F.col("pid").alias("b"), F.col("ident").alias("ib")), "b")
    for r in ids.select("a", "b", "d", m.distance_by_bits(F.col("ia"), F.col("ib")).alias("bits")).collect():
        assert r["d"] == r["bits"] == m.between(r["a"], r["b"])


def test_machine_reads_innermost_level_first():
    m = Machine.parse("4:8:6", "1:10:100")
    assert m.k == 192 and m.between(0, 3) == 1 and m.between(0, 4) == 10 and m.between(0, 32) == 100 and m.between(5, 5) == 0
    with pytest.raises(ValueError):
        Machine.parse("4:8", "1")


def test_limits():
    assert lmax(100, 3, 0.03) == 35 and lmax(100, 3, 0.03, "trunc") == 33
    assert adaptive_imbalance(0.03, 100, 4, 60, 2, 1) == 0.0 and adaptive_imbalance(0.03, 100, 4, 60, 2, 1, None) < 0


def test_cost_and_cut(small, placed):
    pairs, _, g = small
    pid, a = placed
    ea = metrics.placed(g.edges, a)
    assert metrics.qap(ea, M).first()[0] == metrics.qap_by_groups(ea, M).first()[0] == metrics.qap_of_conn(metrics.block_conn(ea), a, M).first()[0] == cost_of(pairs, pid)
    assert metrics.edge_cut(ea).first()["edge_cut"] == sum(w for u, v, w in pairs if pid[u] != pid[v])


def test_gains_change_the_cost_twice(small, placed):
    pairs, _, g = small
    pid, a = placed
    conn = metrics.block_conn(metrics.placed(g.edges, a))
    moves = a.select("u", F.col("pid").alias("old_id"), ((F.col("pid") + 1) % 4).alias("new_id"))
    for r in gains.gain_and_flags(conn, moves, M).collect():
        new = list(pid)
        new[r["u"]] = r["new_id"]
        assert cost_of(pairs, new) == cost_of(pairs, pid) - 2 * r["gain"]
        near = {pid[v] for u, v, _ in pairs if u == r["u"]} | {pid[u] for u, v, _ in pairs if v == r["u"]}
        assert r["is_connected"] == (r["new_id"] in near) and r["is_boundary_old"] == bool(near - {r["old_id"]})


def test_swap_gain(small, placed):
    pairs, _, g = small
    pid, a = placed
    conn = metrics.block_conn(metrics.placed(g.edges, a))
    for r in gains.swap_gain(g.edges, conn, a, M).collect():
        new = list(pid)
        new[r["u"]], new[r["v"]] = pid[r["v"]], pid[r["u"]]
        assert cost_of(pairs, new) == cost_of(pairs, pid) - 2 * r["gain"]


def test_views_follow_moves(small, placed):
    _, weights, g = small
    _, a = placed
    moves = a.where("u % 3 = 0").select("u", F.col("pid").alias("old_id"), ((F.col("pid") + 1) % 4).alias("new_id"))
    new = gains.apply_moves(a, moves)
    conn = gains.moved_conn(metrics.block_conn(metrics.placed(g.edges, a)), g.edges, moves)
    assert sorted(map(tuple, conn.collect())) == sorted(map(tuple, metrics.block_conn(metrics.placed(g.edges, new)).collect()))
    blocks = gains.moved_weights(metrics.block_weights(g.vertices, a, 4), g.vertices, moves)
    assert sorted((r["pid"], r["bweight"]) for r in blocks.collect()) == sorted((r["pid"], r["bweight"]) for r in metrics.block_weights(g.vertices, new, 4).collect())


def test_matching_is_maximal_and_keeps_the_cap(small):
    pairs, weights, g = small
    got = {tuple(r) for r in coarsen.matching(g.vertices, g.edges, cap=5, seed=2).collect()}
    ends = [x for p in got for x in p]
    assert len(ends) == len(set(ends)) and all((u, v) in {(a, b) for a, b, _ in pairs} and weights[u] + weights[v] <= 5 for u, v in got)
    assert not [1 for u, v, _ in pairs if u not in ends and v not in ends and weights[u] + weights[v] <= 5]


def test_contraction_keeps_weight_and_cost(small, placed):
    pairs, weights, g = small
    mapping = coarsen.mapping_of(g.vertices, coarsen.matching(g.vertices, g.edges, seed=1))
    c = coarsen.contract(g, mapping)
    assert c.vertices.agg(F.sum("vw")).first()[0] == sum(weights)
    coarse = c.vertices.select("u", (F.col("u") % 4).alias("pid"))
    fine = coarsen.project(coarse, mapping)
    assert metrics.qap(metrics.placed(c.edges, coarse), M).first()[0] == metrics.qap(metrics.placed(g.edges, fine), M).first()[0]


def test_clusters_keep_their_limit(small):
    _, _, g = small
    c = coarsen.cluster(g, 6, 3)
    sizes = c.join(g.vertices, "u").groupBy("c").agg(F.sum("vw").alias("w")).collect()
    assert c.count() == 14 and max(r["w"] for r in sizes) <= 6 and len(sizes) < 14


def test_label_propagation_only_improves(small, placed):
    _, weights, g = small
    _, a = placed
    before = refine.cost(g, a, M)
    limit = max(r["bweight"] for r in metrics.block_weights(g.vertices, a, 4).collect()) + 2
    new = refine.label_propagation(g, a, M, limit, 2)
    assert refine.cost(g, new, M) <= before and new.count() == 14
    assert max(r["bweight"] for r in metrics.block_weights(g.vertices, new, 4).collect()) <= limit


@pytest.mark.parametrize("kernel", ["fm", "flow"])
def test_pair_refinement_only_improves(small, placed, kernel):
    _, _, g = small
    _, a = placed
    new = refine.refine_pairs(g, a, M, 12, kernel)
    assert refine.cost(g, new, M) <= refine.cost(g, a, M) and new.count() == 14


def test_rebalance(small, spark):
    _, weights, g = small
    a = spark.createDataFrame([(u, 0) for u in range(14)], "u long, pid long")
    limit = lmax(sum(weights), 4, 0.3)
    new = refine.rebalance(g, a, M, limit)
    assert max(r["bweight"] for r in metrics.block_weights(g.vertices, new, 4).collect()) <= limit


def test_schedules():
    pairs = [(a, b, a + b) for a in range(6) for b in range(a + 1, 6)]
    for make in (refine.schedule, refine.distance3_schedule):
        batches = make(pairs)
        assert sorted(p for b in batches for p in b) == sorted((a, b) for a, b, _ in pairs)
        assert all(len({x for p in b for x in p}) == 2 * len(b) for b in batches)


def test_solve_is_balanced_and_beats_modulo(spark):
    n, w = 144, 12
    pairs = [(p, p + 1, 1) for p in range(n) if p % w != w - 1] + [(p, p + w, 1) for p in range(n - w)]
    g = Graph.from_lists(spark, n, pairs)
    a = solver.solve(g, M, 0.05, "fast")
    pid = {r["u"]: r["pid"] for r in a.collect()}
    assert len(pid) == n and max(list(pid.values()).count(b) for b in range(4)) <= lmax(n, 4, 0.05)
    assert cost_of(pairs, pid) < cost_of(pairs, [u % 4 for u in range(n)]) / 4


def test_distributed_levels(spark, monkeypatch):
    """With no room for a whole graph in one task, the solver coarsens and refines in Spark."""
    monkeypatch.setattr(solver, "LOCAL_ARCS", 100)
    pairs = [(p, p + 1, 1) for p in range(80) if p % 10 != 9] + [(p, p + 10, 1) for p in range(70)]
    g = Graph.from_lists(spark, 80, pairs)
    levels = []
    a = solver.solve(g, Machine.flat(2), 0.1, solver.profile_with("fast", lp=1, trials=1), levels=levels)
    assert len(levels) >= 2 and levels[-1]["n"] == 80 and levels[-1]["n_overloaded"] == 0
    assert solver.level_table(spark, levels).count() == len(levels) and a.count() == 80


def test_deep_splits_while_uncoarsening(spark, monkeypatch):
    monkeypatch.setattr(solver, "LOCAL_ARCS", 10)
    pairs = [(p, p + 1, 1) for p in range(48) if p % 8 != 7] + [(p, p + 8, 1) for p in range(40)]
    g = Graph.from_lists(spark, 48, pairs)
    a = solver.solve_deep(g, M, 0.2, solver.profile_with("fast", lp=1, trials=1, pairs=0, c=4))
    pid = {r["u"]: r["pid"] for r in a.collect()}
    assert len(pid) == 48 and set(pid.values()) == {0, 1, 2, 3} and max(list(pid.values()).count(b) for b in range(4)) <= lmax(48, 4, 0.2)


def test_metis_round_trip(spark, small, tmp_path):
    pairs, weights, g = small
    files.write_metis(g, f"{tmp_path}/g")
    back = files.read_metis(spark, f"{tmp_path}/g")
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    assert sorted(map(tuple, back.vertices.collect())) == sorted(map(tuple, g.vertices.collect()))
    assert files.fingerprint(back).first() == files.fingerprint(g).first()


def test_metis_formats(spark, tmp_path):
    (tmp_path / "a").write_text("% comment\n3 2\n% more\n2\n1 3\n2\n")
    g = files.read_metis(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 1, 1)]
    (tmp_path / "b").write_text("3 1 011\n5 2 7\n6 1 7\n9\n")
    g = files.read_metis(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, g.vertices.collect())) == [(0, 5), (1, 6), (2, 9)] and g.edges.agg(F.sum("w")).first()[0] == 14
    (tmp_path / "c").write_text("3 2\n2\n1\n\n")
    with pytest.raises(ValueError):
        files.read_metis(spark, str(tmp_path / "c"))


def test_commands(spark):
    got = files.command_list(spark, ["# x", "+v 1 2", "", "+e 1 2", "-v 3", "vw 1", "ew a b 1", "save_partition x", "stats"]).collect()
    assert [(r["op"], r["rejected"]) for r in got] == [("+v", False), ("+e", False), ("-v", False), ("vw", True), ("ew", True), ("save_partition", True), ("stats", False)]


def plain_fold(events):
    vw, ew = {}, {}
    for _, op, u, v, w in sorted(events, key=lambda e: e[0]):
        if op in ("+v", "vw"):
            vw[u] = (vw.get(u, 0) if op == "+v" else 0) + (1 if w is None else w)
        elif op == "-v":
            vw.pop(u, None)
            ew = {k: x for k, x in ew.items() if u not in k}
        elif u != v:
            key = (min(u, v), max(u, v))
            if op in ("+e", "ew"):
                for x in (u, v):
                    vw[x] = vw.get(x, 0) or 1
                ew[key] = (ew.get(key, 0) if op == "+e" else 0) + (1 if w is None else w)
            elif w is None:
                ew.pop(key, None)
            else:
                ew[key] = max(0, ew.get(key, 0) - w)
    return {u: x for u, x in vw.items() if x}, {k: x for k, x in ew.items() if x > 0}


def random_events(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        op = rng.choice(["+v", "+e", "+e", "+e", "ew", "vw", "-e", "-e", "-v"] if rng.random() < 0.5 else ["+e", "+v"])
        u, v = rng.randrange(9), rng.randrange(9)
        w = rng.choice([None, rng.randint(1, 4)])
        if op in ("ew", "vw"):
            w = rng.randint(0 if op == "vw" else 1, 4)
        out.append((i, op, u, None if op in ("+v", "-v", "vw") else v, None if op == "-v" else w))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fold(spark, seed):
    events = random_events(seed)
    g = dynamic.snapshot(spark.createDataFrame(events, dynamic.EVENTS))
    vw, ew = plain_fold(events)
    assert {r["u"]: r["vw"] for r in g.vertices.collect()} == vw
    assert {(r["u"], r["v"]): r["w"] for r in g.edges.where("u < v").collect()} == ew


def test_session_folds_in_batches_and_from_a_stream(spark, tmp_path):
    events = random_events(9)
    want = plain_fold(events)
    s = dynamic.Session(spark, M, 0.5)
    for lo in (0, 100, 200):
        s.apply(spark.createDataFrame(events[lo : lo + 150], dynamic.EVENTS))  # rows that come twice count once
    assert {r["u"]: r["vw"] for r in s.graph.vertices.collect()} == want[0]
    (tmp_path / "in").mkdir()
    for i, lo in enumerate((0, 150)):
        rows = "\n".join(",".join("" if x is None else str(x) for x in e) for e in events[lo : lo + 150])
        (tmp_path / "in" / f"{i}.csv").write_text(rows + "\n")
    t = dynamic.Session(spark, M, 0.5)
    q = t.follow(dynamic.read_event_stream(spark, str(tmp_path / "in")), checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    assert {(r["u"], r["v"]): r["w"] for r in t.graph.edges.where("u < v").collect()} == want[1]


def test_session_commands(spark, tmp_path):
    s = dynamic.Session(spark, M, 0.5, solver.Profile(trials=1, lp=1, pairs=0))
    solver.PROFILES["tiny"] = solver.Profile(trials=1, lp=1, pairs=0)
    lines = [f"+e {u} {u + 1}" for u in range(12)] + ["partition tiny", "+e 3 20", "+v 30 2", "refine-fast 1", "nonsense", f"save-partition {tmp_path}/p", "stats"]
    s.run(files.command_list(spark, lines))
    pid = {r["u"]: r["pid"] for r in s.assign.collect()}
    assert set(pid) == set(range(13)) | {20, 30} and all(0 <= b < 4 for b in pid.values())
    assert s.rejected == [lines.index("nonsense")] and s.report["n"] == 15
    assert files.read_partition(spark, f"{tmp_path}/p").count() == 15 and s.timings().count() == 4


def test_alignment_keeps_the_cost_and_cuts_migration(spark, small, placed):
    pairs, _, g = small
    pid, a = placed
    turned = a.select("u", F.element_at(F.array(*[F.lit(x).cast("long") for x in (3, 2, 1, 0)]), (F.col("pid") + 1).cast("int")).alias("pid"))
    back = dynamic.align(g.vertices, a, turned, M)
    assert sorted(map(tuple, back.collect())) == sorted(enumerate(pid))
    assert refine.cost(g, back, M) == refine.cost(g, turned, M)


def test_queries_are_registered_without_the_text_operators():
    from meshwork.plans import catalogue

    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES) and len(catalogue.ORACLE) >= 60
