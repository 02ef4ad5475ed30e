"""Contamination against brute force; proximity matches of passages with a word inserted, dropped or changed in every window."""

import random
import re

from pyspark.sql import Row

from breathline.llm.decontaminate import _texts, contamination, keep_clean, phrase_hits, proximity_hits

PASSAGE = [f"p{i}" for i in range(24)]


def edited(change):
    return " ".join(["before", *[x for i, w in enumerate(PASSAGE) for x in (change(w) if i % 12 == 5 else [w])], "after"])


def test_edited_passages(spark):
    docs = [
        (1, edited(lambda w: [w])),
        (2, edited(lambda w: [w, "extra"])),
        (3, edited(lambda w: [])),
        (4, edited(lambda w: ["other"])),
        (5, " ".join(reversed(PASSAGE))),
        (6, " ".join(PASSAGE[:8])),
        (7, None),
        (8, ""),
        (9, " ".join(w if i % 3 else "no" for i, w in enumerate(PASSAGE))),
        (10, " ".join([*PASSAGE[1:13], "end"])),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(PASSAGE)), (2, "tiny two"), (3, None)], "item_id long, text string")
    names = {r.row: r.doc_id for r in _texts(docs).collect()}
    assert {names[r.row] for r in phrase_hits(docs, bench).collect()} == {1}
    got = [Row(doc_id=names[r.row], **r.asDict()) for r in proximity_hits(docs, bench).collect()]
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 10}
    assert {r.item_id for r in got} == {1}
    assert sorted((r.start, r.matched) for r in got if r.doc_id == 1 and r.matched == 13) == [(k + 1, 13) for k in range(12)]
    for k in (2, 3, 4):
        assert sum(r.doc_id == k and r.matched >= 11 for r in got) >= 12


def brute(rows, items):
    """doc_id, n_words, n_hit, items of each row, by looking at every window at every place."""
    find = lambda text: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    wins = {}
    for item, text in items:
        w = find(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, named = find(text), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if found := wins.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    named |= found
        out.append((str(doc_id), len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"b{rng.randint(0, 30)}" for _ in range(rng.choice([3, 13, 14, 40])))) for i in range(12)] + [(99, None), (100, ""), (101, "B0 b0"), (2, "again under one id " * 5)]
    rows = [(None, items[0][1]), (None, None), (5, items[1][1]), (5, "other text here"), (5, items[1][1]), (6, ""), (7, "b0 B0 b0"), (8, "x " * 3000 + items[3][1])]
    for i in range(60):
        parts = [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), items[rng.randrange(12)][1].upper())
        rows.append((10 + i, " - ".join(parts)))
    frame = spark.createDataFrame([(i, t, "r", "w") for i, t in rows], "doc_id long, text string, row string, win string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(frame, bench).collect())
    assert got == brute(rows, items)
    kept = keep_clean(frame, bench)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in rows if not brute([(i, t)], items)[0][4])
    assert contamination(frame.limit(0), bench).count() == 0
    assert contamination(frame, bench.limit(0)).filter("n_hit > 0").count() == 0
