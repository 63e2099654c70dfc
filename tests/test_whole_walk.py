"""Queries on the order graph do the whole walk: three hops, 20 iterations, timelines of any length. Their SQL does too."""

import re

import pytest

from rankloom.operators import graph
from rankloom.plans import registry
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", ["dag_links", "ppr_subgraph", "dag_walk_topk", "dag_walk_blind_topk"])
def test_walk_takes_three_hops(spark, sf_dir, name):
    assert re.findall(r"WHERE depth < (\d+)\)", registry.ORACLE_SQL[name]) == ["3"]
    assert_same(registry.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["onto_walk_topk", "onto_walk_blind_topk", "onto_rule_walk"])
def test_entity_walk_runs_all_iterations(spark, sf_dir, name, monkeypatch):
    rounds, real = [], graph.pagerank

    def counted(*args, **options):
        rounds.append(options.get("iterations", graph.ITERATIONS))
        return real(*args, **options)

    monkeypatch.setattr(graph, "pagerank", counted)
    assert re.search(r"\bp(h1)?20\b", registry.ORACLE_SQL[name])
    assert_same(registry.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(registry.ORACLE_SQL[name]).df())
    assert set(rounds) == {20}


def test_timeline_has_no_upper_bound(spark, sf_dir):
    want = connect(sf_dir).execute(registry.ORACLE_SQL["timeline_questions"]).df()
    assert want["slot"].max() >= 9
    assert_same(registry.QUERIES["timeline_questions"](spark, sf_dir).toPandas(), want)
