"""Substring dedup against a plain pass over all windows."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from veilspark.llm.substrings import SubstringDedup

from ..conftest import SF


def brute(rows, span=20):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - span + 1):
            window = tuple(words[s : s + span])
            if window in seen:
                gone[s : s + span] = [True] * span
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **k):
    out = SubstringDedup(**k).run(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("hot", [256, 2])
def test_documents(spark, hot):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert run(df, hot=hot) == want and sum(r[2] for r in want) > 1000


def test_edges(spark):
    az = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = [
        (1, "for " * 60), (2, None), (3, ""), (None, "for " * 25), (4, " ".join(az)), (4, "zz " + " ".join(az) + " yy"), (4, " ".join(az)),
        (9, "\n\t".join(az[3:]) + " q\x1cq é"), (-5, " ".join(az[:20] * 3)), (11, "w" * 300_000 + " x"), (12, " ".join(f"u{i}" for i in range(30_000))), (13, " ".join(f"u{i}" for i in range(29_000))),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert run(df) == want == run(df, hot=3)
    assert run(df.limit(0)) == []


def test_clashing_columns_are_carried(spark):
    df = spark.createDataFrame([(1, "a " * 30, 5, "x", 1, "mine", "k")], "doc_id long, text string, n_words int, cell string, `row` int, `text as it was` string, kept string")
    r = SubstringDedup().run(df, carry=True).first()
    assert r.row.asDict() == {"doc_id": 1, "n_words": 5, "cell": "x", "row": 1, "text as it was": "mine", "kept": "k"} and r.n_words == 30 and r.text == "a " * 30
    assert r.kept == " ".join(["a"] * (30 - r.n_removed))
