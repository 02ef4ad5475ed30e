"""Similarity groups and exact copies against brute force, with null, empty, short and repeated texts."""

import random
import re

import pytest

from breathline.llm.exact_dedup import exact_groups
from breathline.llm.jaccard_join import jaccard_groups

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One TWO"), (4, " \n"), (5, "")]
    for group in range(6):
        words = [f"w{rng.randint(0, 400)}" for _ in range(60)]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(60)] = f"x{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def large_group():
    """Near copies in chains, a passage in every text, repeated rows and a text of other words under a used id."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for group in range(2):
        words = [f"g{group}w{i}" for i in range(50)] + passage
        for n in range(70):
            copy = list(words)
            for at in rng.sample(range(50), rng.randint(0, 3)):
                copy[at] = f"x{rng.randint(0, 30)}"
            rows.append((1000 - len(rows), " ".join(copy)))
    for n in range(40):
        rows.append((2000 + n, " ".join([f"o{n}v{i}" for i in range(30)] + passage)))
    return rows


def links_of(rows):
    sets = {}
    for i, text in rows:
        w = SPLIT.findall((text or "").lower().encode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("rows, rounds", [(corpus(), 6), (large_group(), 6), (large_group(), 1), (large_group(), 0)])
def test_similarity_groups(spark, rows, rounds):
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), slots=1 << 10, rounds=rounds).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == links_of(rows)


def test_similarity_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, 1), (4, text, 2), (4, text, 3), (4, "other words here", 4), (9, text + " more", 5), (None, None, 6), (8, "OTHER words HERE", 7)]
    schema = "doc_id long, text string, id long"
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_groups(spark.createDataFrame(rows, schema)).collect())
    want = [("4", 1, 4), ("4", 36, 4), ("4", 36, 4), ("8", 1, 4), ("9", 37, 4), ("None", 0, None), ("None", 36, None)]
    assert got == want
    assert jaccard_groups(spark.createDataFrame([], schema)).collect() == []


def test_colliding_hashes_do_not_merge_texts(spark):
    from pyspark.sql import functions as F

    rows = corpus()
    weak = lambda text: F.unhex(F.hex(F.length(text) % 3))
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), keep="max", content_hash=weak).collect()
    by_text = {}
    for i, text in rows:
        by_text.setdefault(text or "", []).append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in by_text.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want


def pairs_of_all_sizes():
    """Pairs of a text and a longer one that has it all, from 20 words on, so that some differ in size class."""
    rows = []
    for n in range(20, 130, 3):
        words = [f"n{n}w{i}" for i in range(n + n // 7)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:n]))]
    return rows


def test_pairs_of_different_size_classes_are_compared(spark):
    rows = pairs_of_all_sizes()
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), slots=1 << 10).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == links_of(rows)


def test_pipeline_drops_pairs_of_different_size_classes(spark):
    import corpus_pipeline

    rows = pairs_of_all_sizes()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, "").collect()}
    assert got == {i for i, (_, keep) in links_of(rows).items() if i == keep}


def test_repeated_rows_keep_their_links(spark):
    import corpus_pipeline

    rows = pairs_of_all_sizes()[:30] + [(1000 + i, t) for i, t in large_group()[:8]]
    want = links_of(rows)
    docs = spark.createDataFrame(rows * 2 + rows[:6] * 3, "doc_id long, text string").repartition(3)
    got = jaccard_groups(docs, slots=1 << 10).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *w) for i, w in want.items()}
    kept = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {i for i, (_, keep) in want.items() if i == keep}


def test_rounds_without_links_go_on(spark, monkeypatch):
    from breathline.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "PAIRS_PER_POSTING", 0)
    rows = large_group()
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), slots=1 << 10).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == links_of(rows)
