import json

import pytest

from meshwork.__main__ import main
from meshwork.plans.options import parser, profile_of
from meshwork.sources import files
from meshwork.sources.graph import Graph


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("g") / "grid")
    pairs = [(p, p + 1) for p in range(36) if p % 6 != 5] + [(p, p + 6) for p in range(30)]
    files.write_metis(Graph.from_lists(spark, 36, pairs), path)
    return path


def test_options_override_the_profile():
    args = parser().parse_args(["map", "--graph", "x", "--hierarchy", "2:2", "--distance", "1:10", "--config", "strong", "--lp", "9"])
    assert profile_of(args).lp == 9 and profile_of(args).c == 64
    with pytest.raises(SystemExit):
        parser().parse_args(["map", "--graph", "x"])


@pytest.mark.parametrize("argv", [["partition", "--k", "4"], ["map", "--hierarchy", "2:2", "--distance", "1:10"]])
def test_programs(spark, grid, tmp_path, argv, capsys):
    main([*argv, "--graph", grid, "--mapping", f"{tmp_path}/p", "--imbalance", "0.1"], spark)
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert report["n"] == 36 and report["n_overloaded"] == 0 and report["edge_cut"] <= 20
    assert files.read_partition(spark, f"{tmp_path}/p").count() == 36


def test_dynamic_program(spark, tmp_path, capsys):
    (tmp_path / "log").write_text("# edits\n" + "".join(f"+e {u} {u + 1}\n" for u in range(8)) + "partition given\n+e 0 9\nrefine-fast 1\n")
    main(["dynamic", "--commands", str(tmp_path / "log"), "--hierarchy", "2:2", "--distance", "1:10", "--imbalance", "0.5", "--lp", "1", "--trials", "1", "--pairs", "0"], spark)
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert report["n"] == 10 and report["m_edges"] == 9


def test_outputs_of_the_programs(spark, grid, tmp_path):
    files_of = [f"{tmp_path}/{x}" for x in ("coarsest", "items", "dataset")]
    options = [x for pair in zip(("--save-coarsest-graph", "--items", "--dataset"), files_of, strict=True) for x in pair]
    main(["partition", "--k", "2", "--graph", grid, "--imbalance", "0.1", "--trials", "1", *options], spark)
    assert files.read_metis(spark, files_of[0]).vertices.count() == 36  # it fits into one task, so nothing is coarsened before
    assert spark.read.option("header", True).csv(files_of[1]).count() == 1
    assert spark.read.parquet(f"{files_of[2]}/vertices").count() == 36


def test_commands_from_a_stream_of_lines(spark):
    from meshwork.functions.hierarchy import Machine
    from meshwork.plans import solver
    from meshwork.streaming.dynamic import Session

    solver.PROFILES["light"] = solver.profile_with("fast", trials=1, lp=1, pairs=0)
    said = []
    s = Session(spark, Machine.flat(2), 0.5, "light")
    s.listen(iter([f"+e {u} {u + 1}" for u in range(6)] + ["# note", "bad", "partition light", "+e 0 9", "quit", "+e 1 9"]), said.append)
    assert said == ["partition", "quit"] and s.graph.vertices.count() == 8 and s.graph.edges.count() == 14
    paths = [r[0] for r in s.profiler.rows()]
    assert paths == ["partition", "partition/solve"] and json.loads(s.profiler.to_json())[0]["children"][0]["name"] == "solve"


def test_profiler():
    from meshwork.functions.profiler import Profiler

    p = Profiler()
    for _ in range(2):
        with p.scope("a"), p.scope("b"):
            pass
    rows = p.rows()
    assert [(r[0], r[1], r[2]) for r in rows] == [("a", 0, 2), ("a/b", 1, 2)] and 0 <= rows[1][5] <= 1
