"""One row stays for each group of near copies, whatever the doc_ids."""

from rankloom.llm import neardup

A = " ".join(f"a{i}" for i in range(60))
A2 = A + " tail"
B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "bc")


def left(spark, rows):
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    out = neardup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_rows_of_null_and_repeated_ids_are_decided_on_their_text(spark):
    rows = [(1, A), (2, B), (2, A), (None, A), (None, C), (None, C), (3, None), (3, None), (3, "")]
    assert left(spark, rows) == sorted([(1, A), (2, B), (None, C), (3, None), (3, "")], key=str)


def test_one_of_near_copies_with_one_id_stays(spark):
    for i in (5, None):
        got = left(spark, [(i, A), (i, A2), (i, B)])
        assert len(got) == 2 and (i, B) in got
