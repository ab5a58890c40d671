import pytest

from quiltgraph import jobs
from quiltgraph.operators import analytics, program
from quiltgraph.operators.graph import build_graph
from quiltgraph.operators.subgraphs import form_subgraphs
from quiltgraph.plans import storage

LINES = ["1 0 2 3", "2 0 1 3 4", "3 0 1 2", "4 1 2", "5 1"]


@pytest.mark.parametrize(("name", "options", "want"), [("vertex_count", [], ["5"]), ("edge_list", ["--no-split"], ["1\t2", "1\t3", "2\t1", "2\t3", "2\t4", "3\t1", "3\t2", "4\t2"]), ("shortest_paths", ["--source", "1"], ["1\t0\t-1", "2\t1\t1", "3\t1\t1", "4\t2\t2"]), ("triangle_count", [], ["1"])])
def test_jobs_from_files_to_files(spark, tmp_path, monkeypatch, name, options, want):
    monkeypatch.setattr(jobs, "clean_up", lambda spark: None)  # other tests' tables stay
    (tmp_path / "in").write_text("\n".join(LINES))
    jobs.main([name, f"file://{tmp_path}/in", f"file://{tmp_path}/out", *options])
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()) == want


def test_missing_arguments():
    with pytest.raises(SystemExit):
        jobs.arguments(["shortest_paths", "in", "out"])
    with pytest.raises(SystemExit):
        jobs.arguments(["no_such_job", "in", "out"])


def test_hubs_are_spread(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 40, 2)] + [(3, 4), (3, 4), (5, 6), (7, 8)]
    vertices = spark.createDataFrame([(i, i % 3) for i in range(42)], "vertex_id long, partition_id int")
    g = build_graph(vertices, spark.createDataFrame(edges, "src long, dst long"))
    for mode in ("sync", "partition_lag"):
        monkeypatch.setattr(analytics, "HUB_EDGES", 1_000_000)
        plain = {r["vertex_id"]: r["rank"] for r in analytics.pagerank(g, 9, mode).collect()}
        monkeypatch.setattr(analytics, "HUB_EDGES", 4)
        spread = {r["vertex_id"]: r["rank"] for r in analytics.pagerank(g, 9, mode).collect()}
        assert len(plain) == 42 and all(abs(plain[i] - spread[i]) < 1e-9 for i in plain)


def test_subgraph_too_large_for_a_worker(spark, monkeypatch):
    g = build_graph(spark.createDataFrame([(1, 0), (2, 0)], "vertex_id long, partition_id int"), spark.createDataFrame([(1, 2)], "src long, dst long"))
    monkeypatch.setattr(program, "MAX_ELEMENTS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        program.run_program(form_subgraphs(g), program.min_label_program)


def test_folders_and_clean_up(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(storage, "_written", written)
    held = storage.materialise(spark.range(3), "some")
    assert held.count() == 3 and len(written) == 1
    storage.clean_up(spark)
    assert not written
    with pytest.raises(Exception):
        held.count()
