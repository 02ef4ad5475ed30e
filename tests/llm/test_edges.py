"""Empty tables, null and empty texts, repeated rows and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from breathline.llm import pieces, quality, secrets, toxicity, warc
from breathline.llm.storage import new_path

#: Extra columns have the names that the operators use inside.
SCHEMA = "doc_id long, text string, id string, ids string, spans string, score string"
SECRET = "api_key = abcdef123"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)


ROWS = [(1, SECRET), (1, SECRET), (2, ""), (3, None), (None, "plain words"), (4, "word " * 50_000)]


def test_secrets(spark):
    got = [(r.id, len(r.spans)) for r in secrets.find_secrets(documents(spark, ROWS)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (2, 0), (3, 0), (None, 0), (4, 0)], key=str)
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_pieces(spark):
    got = {(r.id, None if r.ids is None else tuple(r.ids), r.lossless) for r in pieces.encode(documents(spark, ROWS)).collect()}
    assert {i: s for i, _, s in got} == {1: True, 2: True, 3: None, None: True, 4: True}
    assert len(got) == 5  # repeated rows draw alike
    assert pieces.encode(documents(spark, [])).count() == 0


def inputs(docs):
    return docs.select(F.col("doc_id").alias("id"), "text")


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_without_a_class(spark, operator):
    docs = inputs(documents(spark, ROWS))
    for labels in ([], [(1, 0), (2, None), (None, 1)]):
        model = operator.fit(docs, spark.createDataFrame(labels, "id long, label int"))
        scores = [r.score for r in operator.score(docs, model).collect()]
        assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
        assert len(set(scores)) == 1
        assert operator.score(docs.limit(0), model).count() == 0


def test_toxicity_drops_only_what_scores_high(spark):
    toxic = [(i, f"you are such an idiot number {i}") for i in range(40)]
    clean = [(100 + i, f"the garden is green and quiet today {i}") for i in range(40)]
    odd = [(500, "you are an i-d-i-o-t"), (500, "you are an i-d-i-o-t"), (501, None), (502, ""), (None, "such an idiot")]
    docs = documents(spark, toxic + clean + odd)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in toxic + clean], "id long, label int")
    model = toxicity.fit(inputs(docs), labels)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([i for i, _ in clean] + [501, 502, None], key=str)


def test_quality_parts_classes(spark):
    good = [(i, f"A calm sentence about rivers, number {i}. It goes on for a while.") for i in range(30)]
    bad = [(100 + i, f"$$$ 99{i} !!! ### {i * 7} @@@ 1234") for i in range(30)]
    docs = inputs(documents(spark, good + bad + ROWS[2:5]))
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad] + [(0, 0), (0, 1)], "id long, label int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 63 and all(0 <= r.score <= 1 for r in rows)
    scores = {r.id: r.score for r in rows if r.id not in (2, 3)}  # these are there with an empty and a null text too
    assert all(scores[i] > 0.5 for i, _ in good if i not in (2, 3)) and all(scores[i] < 0.5 for i, _ in bad)


def test_archives(spark):
    rows = [(1, "u", "same", 0), (2, None, "same", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "ü /", "own", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    index = warc.write_archives(pages, new_path(spark, "warc"))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(index.unionByName(index)).collect()}
    assert got == {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 3)}
    assert warc.read_records(warc.write_archives(pages.limit(0), new_path(spark, "warc"))).count() == 0
