"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import collections

import corpus_pipeline

from ..conftest import SF
from .test_nearcopies import brute as classes_of
from .test_substrings import brute as removals_of


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        kept[name] = (before.collect(), docs.collect())
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    before, after = kept[names[0]]
    assert good <= {r.doc_id for r in after} and len(after) < len(before)
    before, after = kept[names[1]]
    assert {r.doc_id for r in after} == {c for _, c, _ in classes_of([(r.doc_id, r.text) for r in before])}
    before, after = kept[names[2]]
    removed = {d: n for d, _, n, _ in removals_of([(r.doc_id, r.text) for r in before])}
    was = {r.doc_id: r.text for r in before}
    for r in after:
        assert len(r.text.split()) == len(was[r.doc_id].encode().split()) - removed[r.doc_id] or "\x1c" in was[r.doc_id]
        assert removed[r.doc_id] or r.text == was[r.doc_id]
        assert r.n_chars == len(r.text) or not removed[r.doc_id]
    before, after = kept[names[3]]
    times = collections.Counter(r.doc_id for r in after)
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in before}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert {"doc_id", "piece", "sequence_id", "offset", "ids"} <= set(out[0].asDict())
    bins = collections.defaultdict(list)
    for r in out:
        assert len(r.ids) == r.length
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():  # gapless from 0, and no longer than a sequence
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


EDGES = "doc_id long, text string, lang string, source string, n_chars long, node int, `key of class` int, size int, `row` string, cell int, chunk int, label int"


def edge_rows():
    long = " ".join(f"w{i}" for i in range(9000))
    texts = [(1, None, None), (2, "", "s"), (3, " \n\t", "s"), (None, "a b c d e f g", "t"), (4, long, "t"), (5, long + " more", "t"), (6, "one two three four five six", ""), (6, "one two three four five six", ""), (7, "é" * 70_000, "u")]
    return [(d, t, "en", s, len(t or ""), 1, 2, 3, "r", 4, 5, 6) for d, t, s in texts]


def test_edges_of_all_stages(spark, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame(edge_rows(), EDGES)
    docs.write.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.schema.names == before.schema.names
        rows = docs.collect()
        assert all((r.node, r.size, r["row"], r.cell, r.chunk, r.label) == (1, 3, "r", 4, 5, 6) for r in rows), name
        if name == "quality classifier":
            assert len(rows) == 9  # nothing is known against them
        if name == "n-gram Jaccard join":
            assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [1, 2, 3, None, 4, 6, 7]))
    assert corpus_pipeline.run(spark, sf).count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.collect() == []
        if "text" not in empty.columns:
            break


def test_columns_of_any_name_pass_through(spark, tmp_path):
    """Names that any stage gives to its own columns, as columns of the input."""
    import re
    from pathlib import Path

    from veilspark import llm

    sources = [Path(corpus_pipeline.__file__), *(Path(llm.__file__).parent / f"{m}.py" for m in ("common", "graphs", "nearcopies", "substrings", "mixing", "quality"))]
    used = {n for p in sources for n in re.findall(r'"([A-Za-z_][A-Za-z_ ]{0,24})"', p.read_text())} | {"text as it was", "key of class", "kept"}
    names = sorted({n.lower() for n in used} - {"doc_id", "text", "source", "n_chars"})
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t u v", "s", 43), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y z and more of it", "t", 60), (3, None, None, None)]
    docs = spark.createDataFrame([(*r, *[f"mine {n}" for n in names]) for r in rows], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        got = docs.collect()
        assert got and all(r[n] == f"mine {n}" for r in got for n in names), name


def test_the_mix_keeps_to_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from veilspark.llm.mixing import SourceMixer

    told = {(r.doc_id, r.size): r.taken for r in SourceMixer().report(docs).collect()}
    words = collections.Counter()
    for r in corpus_pipeline.mixed(spark, docs, SF).collect():
        n = len((r.text or "").encode().split())
        words[r.doc_id, n] += n
    assert {k: v for k, v in told.items() if v} == {k: v for k, v in words.items() if v}
