"""Term weights move their rows by term and by document once each; an index keeps no table that nothing reads."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from varve.operators import ordered, search_index
from varve.operators.staging import Workspace
from varve.plans.retrieval import tf_idf, tf_idf_weights
from varve.sources.domain import Domain


def test_rows_of_terms_move_twice(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma{i % 5} delta{i}") for i in range(60)], "doc_id long, text string")
    plan = tf_idf(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    # The texts, the rows by term and the rows by document; five with a join before.
    assert len(moved) == 3 and "SortMergeJoin" not in plan, plan
    assert tf_idf(docs, "doc_id", "text").where("abs(weight) > 1").count() == 0


def test_only_the_index_stays(spark):
    ws = Workspace(spark, "test-index-steps")
    rows = spark.createDataFrame([(i % 7, f"t{i}", 0.5) for i in range(50)], "id long, term string, weight double")
    search_index.write(rows, ws.path("index"), "id", ws=ws)
    assert [n[4:] for n in os.listdir(urlparse(ws.root).path)] == ["index"]


def test_positions_drop_what_is_dealt_again(spark):
    ws = Workspace(spark, "test-positions")
    found = ordered.positions(spark.range(30), ["id"], ws=ws)
    assert sorted(n[4:] for n in os.listdir(urlparse(ws.root).path)) == ["before", "dealt"] and found.count() == 30


def test_rows_by_term_are_stored_before_they_move_by_document(spark, sf):
    plan = tf_idf_weights(Domain(spark, sf))._jdf.queryExecution().executedPlan().toString()
    # Only the rows by document are still to move; three before, all of whose files stayed to the end.
    assert plan.count("Exchange hashpartitioning(") == 1, plan
