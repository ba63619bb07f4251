"""The Jaccard join against all pairs."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import graphs
from veilspark.llm.graphs import connected_components
from veilspark.llm.common import materialise, words_of
from veilspark.llm.nearcopies import HALF, NearCopies, digests, forest, linked, met, recalls, shorter

from ..conftest import SF


def brute(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j > i:
                    shared[j] += 1
        for j, k in shared.items():
            if k >= threshold * (len(s) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    key = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), i), i, key=key)
    return sorted([(rows[i][0], rows[least[find(i)]][0], links[i]) for i in range(len(rows))], key=str)


def run(df, **k):
    return sorted([(r.doc_id, r.class_id, r.n_links) for r in NearCopies(**k).join(df).collect()], key=str)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert run(df, block_texts=2) == want and sum(r[2] for r in want) > 0


def test_a_large_group_in_blocks(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"end{i % 40}"])) for i in range(120)] + [(1000 + i, " ".join(f"{i}_{j}" for j in range(30))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert run(df, block_texts=9) == brute(rows)


def test_edges(spark):
    rows = [
        (1, "a b c d e f g"), (2, None), (3, ""), (None, "a b c d e f g"), (4, "a b c"), (4, "a b c"), (4, "x y z q r s t u v w"), (5, "a\tb\nc"), (6, "x y z q r s t u v w"), (7, " "),
        (8, "k " * 9), (9, " ".join(f"u{i}" for i in range(40_000))), (10, " ".join(f"u{i}" for i in range(39_000))),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS `keys`", "3 AS print")
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []
    kept = NearCopies().keep_one(df)
    assert kept.columns == df.columns and kept.count() == 8


def test_recall_is_told_by_the_pairs_found():
    none = np.zeros(200)
    reach = recalls(none, 0.8, 8, 4, 24)
    assert all(abs(reach[d] - met(0.8, d, 24)) < 1e-9 for d in reach) and reach[5] >= 0.9999 > reach[6]
    high = none.copy()
    high[150] = 1e6  # very many pairs far above the threshold need no shorter prefixes
    assert recalls(high, 0.8, 8, 4, 24)[8] >= 0.9999
    low = none.copy()
    low[0] = 1e6
    assert recalls(low, 0.8, 8, 4, 24)[8] < 0.99


def test_prefixes_shorten_until_the_recall(spark):
    rng = np.random.default_rng(3)
    rows, words = [], [f"v{i}" for i in range(4000)]
    for g in range(150):
        base = rng.choice(words, 100).tolist()
        for k in range(3):
            own = list(base)
            for at in rng.choice(100, 2 if g % 2 else 1, replace=False):
                own[at] = f"x{g}_{k}_{at}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, near = brute(rows), NearCopies()
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in near.join(df).collect()], key=str) == want
    assert near.report["recall"] >= 0.9999 and near.report["depth"] < near.most_depth
    loose = NearCopies(recall=0.5)
    got = {r.doc_id: r.n_links for r in loose.join(df).collect()}
    assert loose.report["depth"] == loose.most_depth and sum(got.values()) >= 0.9 * sum(n for _, _, n in want)


@pytest.mark.parametrize("parts", [1, 7])
def test_the_forest_links_runs_of_equal_prefixes(spark, parts):
    rng = np.random.default_rng(5)
    hi, lo = rng.integers(-2, 2, (300, 3)), rng.integers(0, 3, (300, 3)) << 48 | rng.integers(0, 2, (300, 3)) << 32 | rng.integers(0, 2, (300, 3)) << 16
    df = spark.createDataFrame([(i, h.tolist(), v.tolist()) for i, (h, v) in enumerate(zip(hi, lo))], "id long, hi array<long>, lo array<long>")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = forest(df, 8).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for depth in range(HALF, 9):
        root = list(range(300))

        def find(a, root=root):
            while root[a] != a:
                a = root[a]
            return a

        for r in got:
            if r.prefix >= depth:
                root[find(r.id)] = find(r.hubs[depth - HALF])
        theirs = list(range(300))
        for t in range(3):
            least = {}
            for i in range(300):
                k = (hi[i, t], lo[i, t] >> 16 * (8 - depth))
                theirs[find(i, theirs)] = find(least.setdefault(k, i), theirs)
        groups = lambda rs, f: sorted(map(sorted, {f(i): [j for j in range(300) if f(j) == f(i)] for i in range(300)}.values()))
        assert groups(root, find) == groups(theirs, lambda i, r=theirs: find(i, r))


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_texts_in_thue_morse_order_are_told_apart(spark):
    rows = [(1, " ".join(thue_morse(2048, "p", "q"))), (2, " ".join(thue_morse(2048, "q", "p"))), (3, "".join(thue_morse(2048, "p", "q"))), (4, "".join(thue_morse(2048, "q", "p")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.copy_of for r in NearCopies().join(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id for r in NearCopies().keep_one(df).collect()} >= {3, 4}


def test_digests_are_of_the_words_alone():
    texts = ["a b", " a\tb ", "a  b\n", "ab", "", " ", "b", "a b", "a"]
    got = digests(words_of(pa.array(texts)))
    same = [[x == y for x in got] for y in got]
    words = [t.split() for t in texts]
    assert same == [[x == y for x in words] for y in words]


def test_linked_counts_like_sets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.95], rng.integers(0, 1 << 60, 5).astype(np.uint64)])) for _ in range(60)]
    got = linked(sets, 0.8)
    for i in range(60):
        for j in range(60):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert got[i, j] == (i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 7), (3, 3)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, 9: 7, **{i: 1000 for i in range(1000, 1050)}}


def test_components_of_shorter_prefixes_go_on_from_longer_ones(spark):
    rng = np.random.default_rng(6)
    hi, lo = rng.integers(0, 60, (400, 3)), rng.integers(0, 3, (400, 3)) << 48 | rng.integers(0, 2, (400, 3)) << 32 | rng.integers(0, 2, (400, 3)) << 16 | rng.integers(0, 2, (400, 3))
    hi[:, 1:] += 1000 + np.arange(400)[:, None] // 2 * 100  # two trees meet in pairs at most
    df = spark.createDataFrame([(i, h.tolist(), v.tolist()) for i, (h, v) in enumerate(zip(hi, lo))], "id long, hi array<long>, lo array<long>")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        runs = forest(df, 8).cache()
        runs.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    before, sizes = None, []
    for depth in (8, 7, 5, 4):
        stars = connected_components(shorter(runs, depth, before))
        got = {(r.node, r.root) for r in stars.collect()}
        assert got == {(r.node, r.root) for r in connected_components(shorter(runs, depth, None)).collect()}
        before = (depth, stars)
        sizes.append(len({root for _, root in got}))
    assert len(set(sizes)) > 2


def test_a_round_of_components_plans_no_step_twice(spark, monkeypatch, capsys):
    # what the driver holds follows the exchanges that it plans: no table of a round takes more than a few
    exchanges = []

    def planned(df, name):
        capsys.readouterr()
        df.explain()
        exchanges.append(capsys.readouterr().out.count("Exchange"))
        return materialise(df, name)

    monkeypatch.setattr(graphs, "materialise", planned)
    edges = [(1, i) for i in range(2, 40)] + [(i, i + 40) for i in range(2, 40)] + [(i + 40, i + 80) for i in range(2, 40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for pair in edges for i in pair}
    assert len(exchanges) > 3 and max(exchanges) <= 5
