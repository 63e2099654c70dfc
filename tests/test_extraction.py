import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.operators import embed, extraction, guards
from rankloom.sources import loaders, sinks


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.y for r in df.select(fn(F.col("x")).alias("y")).collect()]


def test_keys_and_values(spark):
    assert one(spark, text.entity_key, "  Tunnel 12", "tunnel-12 Method", "Basalt-Text corpus") == ["tunnel12", "tunnel12", "basalttext"]
    assert one(spark, text.leading_value, "0.318 of all", ".9", "Tunnel-12", "12") == ["0.32", "0.90", None, None]
    assert one(spark, text.snake, "evaluatedOn", "Builds on") == ["evaluated_on", "builds_on"]


def test_roles(spark):
    said = ["We introduce X", "samples of Y", "it relies on Z", "compared with W"]
    assert one(spark, extraction.role, *said) == ["introduces", "studies", "uses", "mentions"]


NOTE = "rain was scarce . the survey builds on Harbor 31 and on Basalt-Text . a first try had 0.62 depth-score with Harbor 31 . iron oxide was found"


def test_mentions_values_and_resolution(spark):
    both = "presents Harbour 31 beside Harbor-31 , Harbor-13 and Quarry-Bench . 0.4 depth-score for Harbor-13 . more on Basalt-Text"
    cards = spark.createDataFrame([(8, NOTE), (9, both), (10, None), (11, "")], "card_id long, txt string")
    found = extraction.mentions(cards)
    assert sorted((r.sentence_no, r.surface, r["class"], r.role) for r in found.where("card_id = 8").collect()) == [
        (1, "Basalt-Text", "Dataset", "uses"), (1, "Harbor 31", "Method", "uses"), (2, "Harbor 31", "Method", "mentions"), (2, "depth-score", "Metric", "mentions"), (3, "iron oxide", "Material", "mentions"),
    ]
    # card 9 names two datasets, so it is open which of them a value belongs to
    assert [(r.card_id, r.dataset, r.surface, r.value) for r in extraction.reported_values(cards, found).collect()] == [(8, "Basalt-Text", "Harbor 31", "0.62")]
    names = {r.surface: r.entity for r in extraction.resolved(found).where("class = 'Method'").collect()}
    assert names["Harbor 31"] == names["Harbor-31"] == names["Harbour 31"] != names["Harbor-13"]


def test_fidelity_of_a_perfect_and_a_partial_extraction(spark):
    truth = spark.createDataFrame([(3, "Harbor 31", "uses"), (3, "Basalt-Text", "mentions"), (5, "Quarry-Bench", "introduces"), (5, "Harbor 31", "studies")], "card_id long, surface string, role string")
    found = spark.createDataFrame([(3, "harbor-31", "mentions"), (5, "Quarry-Bench", "introduces"), (5, "Gravel 2", "uses")], "card_id long, surface string, role string")
    values = spark.createDataFrame([(3, "Harbor 31", "0.62"), (5, "Harbor 31", "0.10")], "card_id long, surface string, value string")
    assert tuple(extraction.fidelity(truth, truth, values, values).first()) == (1.0,) * 5
    assert tuple(extraction.fidelity(found, truth, values.where("card_id = 3"), values).first()) == (round(2 / 3, 6), 0.5, 0.5, 1.0, 0.5)


def test_a_name_takes_no_role_from_a_longer_one(spark):
    cards = spark.createDataFrame([(1, "we introduce Harbor 312 here . compared with Harbor 31 , (Harbor 31)")], "card_id long, txt string")
    found = spark.createDataFrame([(1, "Harbor 31"), (1, "Harbor 312"), (1, "Absent 5")], "card_id long, surface string")
    assert {(r.surface, r.role) for r in extraction.whole_name_roles(cards, found).collect()} == {("Harbor 31", "mentions"), ("Harbor 312", "introduces")}


def test_all_grades_of_a_small_extraction(spark):
    """Two true entities, one of them split by the extractor, one false name, one false merge, one relation that is not known."""
    make = spark.createDataFrame
    truth = {
        "entities": make([("t1", "Harbor 31", "KernelMethod", "Method"), ("t2", "Basalt-Text", "Corpus", "Dataset"), ("t3", "Quarry-Bench", "Benchmark", "Dataset")], "entity_id string, name string, kind string, parent_kind string"),
        "mentions": make([(1, "t1", "Harbor 31", "uses"), (1, "t2", "Basalt-Text", "mentions"), (2, "t1", "HB-31", "introduces"), (2, "t3", "Quarry-Bench", "mentions"), (7, "t3", "Quarry-Bench", "uses")], "card_id long, entity_id string, surface string, role string"),
        "facts": make([(1, "t1", "evaluated_on", "t2", None), (2, "t1", "reports", "t3", "0.5")], "card_id long, subj string, rel string, obj string, value string"),
    }
    ext = {
        "cards": make([(1,), (2,), (3,)], "card_id long"),
        "entities": make([("a", "Harbor 31", "Method"), ("b", "HB-31", "Kernel method"), ("c", "Basalt-Text", "Corpus"), ("d", "Gravel", "Method")], "entity_id string, name string, kind string"),
        "mentions": make([(1, "a", "Harbor 31", "uses"), (1, "c", "Basalt-Text", "uses"), (2, "b", "HB-31", "introduces"), (2, "c", "Quarry-Bench", "mentions"), (3, "d", "Gravel", "mentions")], "card_id long, entity_id string, surface string, role string"),
        "facts": make([(1, "a", "evaluatedOn", "c", None), (2, "b", "reports", "d", "0.5"), (2, "b", "likes", "c", None)], "card_id long, subj string, rel string, obj string, value string"),
        "classes": make([("Method", None), ("Corpus", "Dataset"), ("Gravel", "Method")], "class string, parent string"),
    }
    r = extraction.grade(truth, ext).first()
    assert (r.n_cards, r.n_entities, r.n_mentions, r.n_facts, r.measured) == (3, 4, 5, 3, True)
    assert (r.mention_precision, r.mention_recall, r.role_accuracy) == (0.8, 1.0, 0.75)
    assert (r.alias_resolution, r.false_merges, r.untyped_links, r.domain_range_violations) == (0.0, 1, 1, 1)
    assert (r.fact_precision, r.fact_recall) == (0.5, 0.5)
    assert (r.class_recall, r.subclass_edge_recall) == (0.2, 0.2)
    assert (r.bridges, r.bridge_coverage) == (1, 1.0)
    empty = extraction.grade({**truth, "entities": truth["entities"].where("false")}, ext).first()
    assert not empty.measured and empty.mention_recall is None and empty.n_facts == 3


def test_errors_beyond_the_limit_stop_a_run(spark):
    rows = spark.createDataFrame([(i, "bad" if i < 2 else None) for i in range(20)], "card_id int, error string")
    with pytest.raises(extraction.TooManyErrors):
        extraction.error_gate(rows)
    assert extraction.error_gate(rows, 0.1).count() == 18


def test_a_text_is_read_once_over_all_runs(spark, tmp_path):
    log = tmp_path / "reads"

    def read(text):
        with open(log, "a") as f:
            f.write("x")
        if not text:
            raise ValueError("nothing to read")
        return {"words": len(text.split())}

    cards = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "card_id long, txt string")
    for _ in range(2):
        got = {r.card_id: (r.result and r.result.words, r.error) for r in extraction.cached_extraction(cards, read, str(tmp_path / "cache"), "counter", "words int").collect()}
        assert got[1] == got[2] == (2, None) and got[3][0] is None and "nothing to read" in got[3][1]
    assert log.read_text() == "xxx"  # the text once, the failure in both runs


def test_guards(spark, tmp_path):
    guards.check_circular(True, False, "planted")
    with pytest.raises(guards.Circular):
        guards.check_circular(True, False, "dag_mined")
    path = str(tmp_path / "true_facts.parquet")
    spark.range(2).write.parquet(path)
    with pytest.raises(guards.TruthLeak):
        guards.check_truth(spark.read.parquet(path))
    guards.check_truth(spark.range(2))


def test_hash_embedding(spark):
    v = spark.createDataFrame([("deep nets",), ("deep nets",), ("",), (None,)], "t string").select(embed.hash_embedding(F.col("t"), 32).alias("v")).collect()
    assert v[0].v == v[1].v and abs(sum(x * x for x in v[0].v) - 1) < 1e-5
    assert set(v[2].v) == set(v[3].v) == {0.0}


def test_papers_and_citations(spark, tmp_path):
    good = {"id": "p1", "title": "A long enough title", "abstract": "words " * 50, "categories": "cs.LG stat.ML", "versions": [{"version": f"v{k}", "created": f"Mon, {k} Apr 2007 19:18:42 GMT"} for k in (2, 3)]}
    bad = [good | {"id": "p2", "abstract": "short"}, good | {"id": "p3", "versions": []}, good | {"id": "p4", "categories": ""}]
    (tmp_path / "p.json").write_text("\n".join([json.dumps(x) for x in [good, *bad, good | {"id": "p5"}]] + ["{broken"]))
    p = loaders.read_papers(spark, str(tmp_path / "p.json")).cache()
    assert {(r.reason, r.n) for r in loaders.dropped(p).collect()} == {("too short", 1), ("no version", 1), ("no category", 1), ("unparseable", 1)}
    cards = {r.card_id: r for r in loaders.paper_cards(p).collect()}
    assert set(cards) == {"p1v2", "p1v3", "p5v2", "p5v3"} and cards["p1v3"].supersedes_id == "p1v2" and cards["p1v2"].committed_at.day == 2
    (tmp_path / "c.tsv").write_text("p1\tp5\np1\tp1\np1\tgone\np1\tp5\n")
    assert [(r.src, r.dst) for r in loaders.read_citations(spark, str(tmp_path / "c.tsv"), p.where("reason is null")).collect()] == [("p1", "p5")]


def test_title_join(spark):
    a = spark.createDataFrame([(1, "On  Nets!"), (2, "on nets"), (3, "")], "id long, t string")
    b = spark.createDataFrame([(9, "ON NETS"), (8, "Else")], "id long, t string")
    assert [(r.left_key, r.right_key) for r in loaders.joined_by_title(a, b, "t", "id", "t", "id").collect()] == [(1, 9)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_source(spark.createDataFrame([(1, "a"), (2, "b")], "x long, source string"), path)
    sinks.replace_source(spark.createDataFrame([(3, "a")], "x long, source string"), path)
    assert {(r.x, r.source) for r in spark.read.parquet(path).collect()} == {(3, "a"), (2, "b")}
    report = {"b4": {"rows": {"all": {"lo": float("nan"), "n": 3}}, "list": [float("inf"), 1]}}
    sinks.write_report(report, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["b4"]["list"] == [None, 1]
    assert set(sinks.headline({"a": {"b": {"c": 1, "d": {"e": 2}}}, "x": 1})) == {"a.b.c", "x"}
    assert sinks.different({"a": 1.0, "t": 5}, {"a": 1.0 + 1e-12, "t": 6}, allowed=frozenset({"t"})) == [] and sinks.different({"a": 1}, {"a": 2}) == ["a"]
