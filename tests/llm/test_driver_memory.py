"""What the driver holds does not grow with texts, and its plans do not repeat their own parts."""

from rankloom import storage
from rankloom.llm import mixing, quality_model, quality_rules


def plan_of(label):
    path = [p for p in storage.made if f"/{label}-" in p][-1]
    return storage.made[path]._jdf.queryExecution().analyzed().toString()


def test_training_runs_on_an_executor(spark, monkeypatch):
    good, bad = ("the quick brown fox jumps over it", "zzz qqq zzz qqq xxx xxx")
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = docs.join(labels, "doc_id").where(~quality_model.held_out()).toPandas()
    rows["h"] = [hash_key(i) for i in rows["doc_id"]]
    rows = rows.sort_values("h")
    here = quality_model.fit(rows["text"].tolist(), rows["quality"].tolist())

    def never(texts):
        raise AssertionError("texts on the driver")

    monkeypatch.setattr(quality_model, "_Bags", never)
    there = quality_model.train(docs, labels)
    assert there.packed() == here.packed()
    none = quality_model.train(docs, labels.limit(0))
    assert none.bias == 0 and not none.weights.any()


def hash_key(doc_id):
    from hashlib import md5

    return md5(f"{quality_model.SEED}:{doc_id}".encode()).hexdigest()


def test_thresholds_are_planned_over_the_stored_sketch(spark):
    words = " ".join(f"{i:02}" for i in range(80))
    docs = spark.createDataFrame([(i, words, "en", f"s{i % 2}") for i in range(8)], "doc_id long, text string, lang string, source string")
    assert quality_rules.filter_documents(docs).count() == 8
    assert "Generate" not in plan_of("rules-limits")
    assert plan_of("rules-limits").count("Relation") <= 8


def test_cuts_are_planned_over_stored_sums(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    assert mixing.mix_documents(docs).count() == 45
    assert plan_of("mix-cuts").count("Relation") <= 4
