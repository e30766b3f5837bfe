"""The METIS data source: all four formats, comments, blank lines, byte ranges of any size, folders of parts."""

import pytest

from meshwork.sources import files, metis
from meshwork.sources.graph import Graph

TEXTS = {
    "0": "% head\n4 3\n2 3\n1\n% between\n1 4\n3\n",
    "1": "4 3 1\n2 7 3 1\n1 7\n1 1 4 9\n3 9\n",
    "10": "4 3 10\n5 2 3\n1 1\n2 1 4\n8 3\n",
    "11": "4 3 011\n5 2 7 3 1\n1 1 7\n2 1 1 4 9\n8 3 9",
    "isolated": "5 1\n2\n1\n\n\n\n",
}


def rows(g):
    return sorted(map(tuple, g.vertices.select("u", "vw").collect())), sorted(map(tuple, g.edges.select("u", "v", "w").collect()))


@pytest.mark.parametrize("name", list(TEXTS))
def test_formats(spark, tmp_path, name):
    path = str(tmp_path / "g.graph")
    (tmp_path / "g.graph").write_text(TEXTS[name])
    want = rows(files.read_metis(spark, path))
    for size in (3, 7, 1 << 20):
        assert rows(metis.read_graph(spark, path, size)) == want
    load = lambda what: spark.read.format("metis").option("path", path).option("rows", what).option("range_bytes", "5").load()
    assert rows(Graph(load("vertices"), load("edges"))) == want


def test_written_folders_are_read(spark, tmp_path):
    g = Graph.from_lists(spark, 30, [(u, (u * 7 + 1) % 30, 1 + u % 4) for u in range(0, 30, 3) if u != (u * 7 + 1) % 30], [1 + u % 5 for u in range(30)])
    path = str(tmp_path / "out")
    files.write_metis(g, path)
    assert rows(metis.read_graph(spark, "file://" + path, 16)) == rows(g) == rows(metis.read_graph(spark, path, 1 << 20))


def test_wrong_headers(spark, tmp_path):
    (tmp_path / "bad").write_text("3 2\n2\n1\n\n")
    with pytest.raises(ValueError, match="arcs"):
        metis.read_graph(spark, str(tmp_path / "bad"))
    (tmp_path / "empty").write_text("% nothing\n")
    with pytest.raises(ValueError, match="no header"):
        metis.read_graph(spark, str(tmp_path / "empty"))


def test_small_ranges_share_tasks_and_no_task_gets_all_ranges(tmp_path):
    import pickle

    n = 3000
    (tmp_path / "ring").write_text(f"{n} {n}\n" + "".join(f"{(i - 1) % n + 1} {(i + 1) % n + 1}\n" for i in range(n)))
    reader = metis.MetisReader({"path": str(tmp_path / "ring"), "rows": "edges", "range_bytes": "16"})
    parts = reader.partitions()
    assert len(reader.ranges) > 1000 and len(parts) == 1 and len(pickle.dumps(reader)) < 2000
    got = [(u, v) for p in parts for b in reader.read(p) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
    assert sorted(got) == sorted((i, j) for i in range(n) for j in ((i - 1) % n, (i + 1) % n))
