"""GraphML round trips, imports with provenance, and steps that resume."""

from __future__ import annotations

from pathlib import Path
from xml.etree import ElementTree

import pytest

from varve.operators import steps
from varve.sources.graph_files import read_graphml, write_graphml
from varve.sources.imports import import_files


def test_graphml_round_trip(spark, tmp_path):
    edges = [("a", "b", 0.5), ('x<&>"y', "a", -1.25), ("a", "b", 0.5), ("tab\there", "line\nbreak", None), (None, "a", 1.0), ("&lt;", "ü", 1e-9)]
    path = f"{tmp_path}/g"
    write_graphml(spark.createDataFrame([("lonely",), ("a",), ("a",), (None,)], "node string"), spark.createDataFrame(edges, "src string, dst string, weight double"), path)
    nodes, back = read_graphml(spark, path)
    kept = [e for e in edges if e[0] is not None]
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, kept))
    names = {"lonely"} | {n for e in kept for n in e[:2]}
    assert sorted(r.node for r in nodes.collect()) == sorted(names)
    root = ElementTree.fromstring("".join(p.read_text() for p in sorted(Path(path).glob("part-*"))).encode())
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert {n.get("id") for n in root.iter(f"{ns}node")} == names and len(list(root.iter(f"{ns}edge"))) == len(kept)


def test_empty_graph(spark, tmp_path):
    write_graphml(spark.createDataFrame([], "node string"), spark.createDataFrame([], "src string, dst string, weight double"), f"{tmp_path}/g")
    nodes, edges = read_graphml(spark, f"{tmp_path}/g")
    assert nodes.count() == 0 and edges.count() == 0


def test_import_copies_only_what_changed(spark, sf, tmp_path):
    files = [(f"{sf}/nation.parquet", ["n_nationkey"]), (f"{sf}/region.parquet", [])]
    rows = import_files(spark, files, f"{tmp_path}/in").collect()
    assert [r.copied for r in rows] == [True, True] and all(r.imported_at.endswith("UTC") for r in rows)
    assert {r.source.rsplit("/", 1)[1]: r.bytes for r in rows} == {n: Path(sf, n).stat().st_size for n in ("nation.parquet", "region.parquet")}
    Path(tmp_path, "in", "region.parquet").write_bytes(b"short")
    again = {r.destination.rsplit("/", 1)[1]: r.copied for r in import_files(spark, files, f"{tmp_path}/in").collect()}
    assert again == {"nation.parquet": False, "region.parquet": True}
    assert Path(tmp_path, "in", "region.parquet").read_bytes() == Path(sf, "region.parquet").read_bytes()
    with pytest.raises(ValueError, match="nope"):
        import_files(spark, [(f"{sf}/nation.parquet", ["nope"])], f"{tmp_path}/in")


def test_step_ids():
    assert [steps.step_id(s) for s in ("3", "003", "07b", "12", "x")] == ["03", "03", "07b", "12", "x"]


def test_steps_resume(spark, tmp_path):
    calls = []

    def build(name):
        def of(done):
            calls.append((name, sorted(done)))
            return spark.range(len(done) + 1)

        return of

    listed = [steps.Step(i, i, build(i)) for i in ("0", "1", "2b")]
    with pytest.raises(ValueError, match="no stored table"):
        steps.run(spark, listed, str(tmp_path), start="01")
    steps.run(spark, listed, str(tmp_path))
    calls.clear()
    tables, states = steps.run(spark, listed, str(tmp_path), start="2b")
    assert calls == [("2b", ["00", "01"])] and [s for _, _, s in states] == ["reused", "reused", "computed"]
    assert tables["02b"].count() == 3
    with pytest.raises(ValueError, match="no step"):
        steps.run(spark, listed, str(tmp_path), start="9")
