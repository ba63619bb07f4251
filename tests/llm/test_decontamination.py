"""Benchmark decontamination against a plain pass over all windows."""

from __future__ import annotations

import re
import string

import pytest

from veilspark.llm.decontamination import Decontaminator

from ..conftest import SF

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), window)
        for s in range(len(w) - k + 1) if k else ():
            grams.setdefault(tuple(w[s : s + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in grams:
                    hit.update(range(s, s + k))
                    found |= grams[tuple(w[s : s + k])]
        out.append((doc, len(w), len(hit), sorted(found - {None}), hit))
    return out


def run(docs, items, **k):
    out = []
    for r in Decontaminator(**k).report(docs, items).collect():
        hit = [p for s in r.spans for p in range(s.start, s.start + s.length)]
        assert hit == sorted(set(hit)) and all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))
        out.append((r.doc_id, r.n_words, r.n_hit, r["items"], set(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_documents(spark, bound):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = run(docs, items, broadcast_bytes=bound)
    assert got == sorted(want, key=str) and any(r[2] for r in got) and not all(r[2] for r in got)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven TWELVE"), (2, "Ünder-score"), (3, None), (4, " ... "), (None, "left out"), (5, "one two three four five six seven eight nine ten"), (5, "again"), (6, "AGAIN!")]
DOCS = [
    (1, "zero one two three, four five six seven eight nine TEN eleven twelve thirteen"), (2, None), (2, ""), (None, "Ünder score; ünder SCORE"), (3, "ünder_score"), (3, "ünder_score"),
    (4, "Left\x00out [again]AGAIN"), (5, "__"), (6, "nothing of it"), (7, "again " * 30_000), (8, "one two three four five six seven eight nine"),
]


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_edges(spark, bound):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert run(docs, items, broadcast_bytes=bound) == sorted(brute(DOCS, ITEMS), key=str)
    assert run(docs.limit(0), items, broadcast_bytes=bound) == []
    assert {r[2] for r in run(docs, items.limit(0), broadcast_bytes=bound)} == {0}


def test_cleaned(spark):
    names = "row long, words int, start string, gram int, items string, number string"
    docs = spark.createDataFrame([(*r, 1, 2, "s", 3, None, "n") for r in DOCS], "doc_id long, text string, " + names)
    items = spark.createDataFrame([(*r, 7) for r in ITEMS], "item_id long, text string, words int")
    out = Decontaminator().clean(docs, items)
    assert out.schema == docs.schema
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id not in (2, 3)}
    assert {r[2:] for r in out.collect()} == {(1, 2, "s", 3, None, "n")}
    assert got[1] == "zero thirteen" and got[None] == "; ünder SCORE" and got[4] == "" and got[7] == " " and got[6] == "nothing of it" and got[5] == "__"
    assert sorted([(r.doc_id, r.text) for r in out.where("doc_id = 2").collect()], key=str) == [(2, ""), (2, None)]
    whole = Decontaminator().clean(docs, items, remove="documents")
    hit = {r[0] for r in brute(DOCS, ITEMS) if r[2]}
    assert sorted(r.doc_id for r in whole.collect()) == sorted(d for d, _ in DOCS if d not in hit)
    with pytest.raises(ValueError):
        Decontaminator().clean(docs, items, remove="nothing")


def test_a_passage_that_most_documents_share_and_no_python(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{passage} own{i}" if i % 3 else f"own{i}") for i in range(600)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, passage) for i in range(50)], "item_id long, text string")
    for bound in (64 << 20, 0):
        assert run(docs, items, broadcast_bytes=bound) == sorted(brute(rows, [(i, passage) for i in range(50)]), key=str)
    plan = Decontaminator().report(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
