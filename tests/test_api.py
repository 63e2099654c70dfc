import pytest

from rankloom import __main__ as cli
from rankloom import api
from rankloom.operators import guards
from rankloom.sources.record import Record


def test_compare_gives_a_verdict(spark, sf_dir):
    out = api.compare(Record(spark, sf_dir), "bm25", "hybrid_rrf")
    assert out["verdict"] in {"BETTER", "WORSE", "UNDERPOWERED", "NO DATA"} and out["n"] >= 0


def test_graph_scorers_are_refused_on_graph_labels(spark, sf_dir):
    with pytest.raises(guards.Circular):
        api.rankings(Record(spark, sf_dir), "graph_boost", "dag_mined")


def test_scorers_can_be_added(spark, sf_dir):
    api.register("mine", lambda rec: rec.dense_top(3))
    assert api.rankings(Record(spark, sf_dir), "mine").columns == ["run", "query_id", "card_id", "score", "rank", "top_score", "chain_pos"]


def test_command_line(capsys, spark, sf_dir):
    assert cli.main(["list"]) == 0
    assert "bm25_topk" in capsys.readouterr().out
