"""Lines keep their order where a folder has parts of different sizes, and where a file is read in many splits."""

import pytest

from meshwork.sources import files


@pytest.fixture
def splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, size) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


def test_parts_count_by_name_not_by_size(spark, tmp_path, splits):
    lines = [f"{i} " + "x" * (i % 50) for i in range(900)]
    for part, (a, b) in enumerate([(0, 3), (3, 500), (500, 510), (510, 510), (510, 900)]):
        (tmp_path / f"part-{part:05d}.txt").write_text("".join(x + "\n" for x in lines[a:b]))
    for size in ("128m", "700", "64"):
        splits(size)
        got = files.numbered_lines(spark, str(tmp_path)).collect()
        assert [r["value"] for r in sorted(got)] == lines and sorted(r["line"] for r in got) == list(range(900))


def test_metis_graph_in_unequal_parts(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "part-00000").write_text("4 3 011\n1 2 5\n")
    (tmp_path / "g" / "part-00001").write_text("2 1 5 3 6\n3 2 6 4 7\n4 3 7\n")
    g = files.read_metis(spark, f"{tmp_path}/g")
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 5), (1, 0, 5), (1, 2, 6), (2, 1, 6), (2, 3, 7), (3, 2, 7)]
    assert sorted(map(tuple, g.vertices.collect())) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_partition_in_unequal_parts(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "part-00000").write_text("7\n")
    (tmp_path / "p" / "part-00001").write_text("8\n9\n6\n")
    assert sorted(map(tuple, files.read_partition(spark, f"{tmp_path}/p").collect())) == [(0, 7), (1, 8), (2, 9), (3, 6)]
