"""Language model, mixing, chat, packing, quality, archives, media and neighbours."""

from __future__ import annotations

import collections
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.llm import entries, media
from veilspark.llm.chat import ChatFormatter, PART, read_loss, read_turns
from veilspark.llm.language import LanguageModel, train
from veilspark.llm.mixing import SourceMixer
from veilspark.llm.neighbours import ProjectionSearch, Shard, chi_square, chi_square_at, norms_of, plane_of, range_of
from veilspark.llm.packing import Packer, fullest, plan_bins
from veilspark.llm.quality import QualityClassifier, features_of, fit
from veilspark.llm.warc import WarcWriter, page_of, read_line, record_id, surt

from ..conftest import SF


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    result = con.execute(entries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    got = sorted([str(r[c]) for c in columns] for r in entries.queries()[name](spark, SF).collect())
    assert got == sorted([str(v) for v in row] for row in result.fetchall())


# ------------------------------------------------------------- language model
def base_scores(rows):
    small = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    tokens = lambda t: [w.translate(small) for w in (t or "").encode().split()] + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    score = lambda ws: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    return [(d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, score(tokens(t))) for d, t in rows]


@pytest.mark.parametrize("edges", [False, True])
def test_language_model(spark, edges):
    if edges:
        df = spark.createDataFrame([(1, None), (2, ""), (None, "A a \x1c É"), (3, "the The THE end"), (3, "the The THE end"), (4, "w " * 3000), (5, "x" * 200_000)], "doc_id long, text string")
    else:
        df = docs_of(spark)
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(map(tuple, LanguageModel(steps=100 if edges else 600).score(df.selectExpr("*", "1 AS cell", "2 AS learn")).collect()), key=key)
    want = sorted(base_scores([(r.doc_id, r.text) for r in df.collect()]), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
    if not edges:
        held = [r for r in got if r[1]]
        assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_language_model_without_rows(spark):
    df = docs_of(spark).select("doc_id", "text")
    assert LanguageModel().score(df.limit(0)).collect() == []
    assert LanguageModel().score(df.filter("doc_id IS NULL")).count() == 0


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    k = 40
    codes = np.array([a * k + (a + 1) % k for a in range(k)] + rng.integers(0, k * k, 50).tolist())
    codes, counts = np.unique(codes, return_counts=True)
    counts = counts * np.where(codes % k == (codes // k + 1) % k, 500, 1)
    table = 10.0 ** train(codes, counts, k).table().astype(float)
    assert np.allclose(table.sum(1), 1, atol=1e-5)
    assert np.mean([table[a].argmax() == (a + 1) % k for a in range(k)]) > 0.8


def test_language_model_counts_the_end_of_one_long_text(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.range(1, 2).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 19999), i -> concat('w', i)), ' ') AS text")  # of known size, so few buckets
    (got,) = LanguageModel(steps=10).score(df).collect()
    (want,) = base_scores([(1, text)])
    assert tuple(got)[:5] == want[:5] == (1, False, 20_001, 20_001, 20_001) and got.base_score == pytest.approx(want[5], rel=1e-9)


def test_language_model_classes_grow_with_the_words(spark):
    word = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(3)) + "ing"  # noqa: E731  all of one suffix
    sizes = []
    for n in (900, 3600):
        texts = [word(i) + " " + word((i + 1) % n) for i in range(n) for _ in range(1 + n // (i + 1))]
        v = LanguageModel().vocabulary(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), 3)
        assert v.tokens == 3 * len(texts) and v.types == n + 1
        assert len(v.keys) - 1 + v.bin_types.sum() == n and (v.in_bin >= v.bin_types).all()
        sizes.append(len(v.keys))
    assert sizes[0] == 901 and sizes[1] >= 1700


def test_training_passes_over_all_pairs():
    k = 20_000
    codes, counts = np.arange(k) * k + (np.arange(k) + 1) % k, np.where(np.arange(k) % 1000, 1, 500)
    begin, got = train(codes[:0], counts[:0], k), train(codes, counts, k, steps=1)
    assert (got.context != begin.context).any(1).all()


@pytest.mark.parametrize("numbers", [[], [0], [5, 255], [256, 1], [1 << 20], [1 << 40, 0, 3]])
def test_pressed_numbers_come_back(numbers):
    from veilspark.llm.language import press, unpress

    assert unpress(press(np.array(numbers, np.int64))).tolist() == numbers


def third_after(n):
    """Texts in which a word tells the one three places on."""
    rng = np.random.default_rng(4)
    out = []
    for _ in range(n):
        w = rng.integers(0, 30, 3).tolist()
        for i in range(30):
            w.append((w[-3] * 7 + 5) % 30)
        out.append(" ".join(f"w{x}" for x in w))
    return out


@pytest.mark.parametrize("held", [None, 300])
def test_language_model_is_normalised_and_uses_all_positions(spark, monkeypatch, held):
    from veilspark.llm import language

    if held:  # tasks send what they hold on in several parts
        monkeypatch.setattr(language, "HELD_PAIRS", held)
    df = spark.createDataFrame([(t, True) for t in third_after(150)], "text string, learn boolean").repartition(3)
    near, far = (LanguageModel(positions=n, steps=400).fit(df) for n in (1, 3))
    for mixture, v in (near, far):
        rng = np.random.default_rng(0)
        for _ in range(20):
            before = rng.integers(0, v.classes, len(mixture.models)).tolist()
            p = mixture.table(before)
            assert p.sum() == pytest.approx(1, abs=1e-5) and (p > 0).all()
        # within a class: its words and one more place
        share = np.append(v.own / np.maximum(v.own, 1), (v.in_bin + 0.1 * v.bin_types + 0.1) / (v.in_bin + 0.1 * (v.bin_types + 1)))
        assert np.allclose(share[v.own.size :], 1)
    text = third_after(151)[-1]
    tokens, starts = language.tokens_of(pa.array([text]))

    def score(model):
        mixture, v = model
        cls = v.class_of(tokens)
        return mixture.log10(v.contexts(cls, starts, len(mixture.models)), cls).sum()

    assert score(far) > score(near) + 5


def test_training_does_not_depend_on_partitions_or_on_what_tasks_hold(spark, monkeypatch):
    from veilspark.llm import language

    df = spark.createDataFrame([(t, True) for t in third_after(40)], "text string, learn boolean")
    models = [LanguageModel(positions=1, steps=40).fit(df.repartition(n))[0].models[0] for n in (1, 7)]
    monkeypatch.setattr(language, "HELD_PAIRS", 100)
    models.append(LanguageModel(positions=1, steps=40).fit(df.repartition(3))[0].models[0])
    for m in models[1:]:
        assert np.array_equal(models[0].reach, m.reach) and np.array_equal(models[0].bias, m.bias)


def test_counting_merges_in_proportion_to_the_words(monkeypatch):
    """What a task has merged is merged again only with as much that is new."""
    from veilspark.llm import language

    merged, merge = [], language._merge
    monkeypatch.setattr(language, "_merge", lambda parts: (merged.append(sum(len(k) for k, _ in parts)), merge(parts))[1])
    monkeypatch.setattr(language, "text_blocks", lambda batch: [batch])
    batches = [pa.record_batch({"text": [" ".join(f"w{b}-{i}" for i in range(50))]}) for b in range(400)]
    (got,) = language._count(1)(iter(batches))
    assert sum(np.frombuffer(c, np.int64).sum() for c in got.column("counts").to_pylist()) == 400 * 51
    assert sum(merged) < 4 * 400 * 51


def test_steps_over_blocks_hold_little_at_once():
    import tracemalloc

    from veilspark.llm import language

    def peak(f):
        f()
        tracemalloc.start()
        try:
            f()
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    texts = pa.array(["word " * 4000] * 100)
    assert peak(lambda: language.tokens_of(texts)) < 8 * texts.nbytes
    rng = np.random.default_rng(0)
    reach, target, bias = (rng.normal(size=s).astype(np.float32) for s in ((200, 8), (30_000, 8), 30_000))
    assert peak(lambda: language.log_sums(reach, target, bias)) < 4 << 20
    s = reach.astype(float) @ target.T.astype(float) + bias
    assert np.allclose(language.log_sums(reach, target, bias), np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1), atol=1e-4)


def test_tokens_do_not_depend_on_pieces(monkeypatch):
    from veilspark.llm import language

    texts = pa.array([None, "", "A a \x1c É", "x" * 500, "Z @[`{ \t\x0b\x0d\x08\x0e a", None, "The end " * 60, "the END"])
    keys, starts = language.tokens_of(texts)
    assert np.diff(starts).tolist() == [1, 1, 5, 2, 5, 1, 121, 3]
    assert keys[2] == keys[3] and keys[starts[7] :].tolist() == [*keys[starts[6] : starts[6] + 2], language.END]
    monkeypatch.setattr(language, "PIECE_BYTES", 7)
    for a, b in zip((keys, starts), language.tokens_of(texts), strict=True):
        assert np.array_equal(a, b)
    assert [len(x) for x in language.tokens_of(texts[:0])] == [0, 1]


def test_places_and_totals():
    from veilspark.llm.language import END, _totals, places

    rng = np.random.default_rng(1)
    for keys in (np.array([END]), np.append(np.arange(1000, 3000, 2).astype(np.uint64), END), np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))):
        found = np.concatenate([keys, keys - np.uint64(1), rng.integers(0, 1 << 63, 1000, dtype=np.uint64)])
        at = {k: i for i, k in enumerate(keys.tolist())}
        assert places(keys, found).tolist() == [at.get(k, -1) for k in found.tolist()]
    rows = rng.normal(size=(4000, 3)).astype(np.float32)
    for first in ([0], np.arange(4000), np.arange(0, 4000, 2), np.unique(np.append(0, rng.integers(0, 4000, 1800)))):
        assert np.array_equal(_totals(rows, np.asarray(first)), np.add.reduceat(rows, first, axis=0))


def test_contexts_begin_with_ends():
    from veilspark.llm.language import Vocabulary

    none = np.zeros(0, np.int64)
    v = Vocabulary(np.arange(10, dtype=np.uint64), 0, 0, none, none, none)
    got = v.contexts(np.array([1, 9, 9, 2, 3, 4, 5, 9]), np.array([0, 2, 3, 8]), 3)
    assert [x.tolist() for x in got] == [[9, 1, 9, 9, 2, 3, 4, 5], [9, 9, 9, 9, 9, 2, 3, 4], [9, 9, 9, 9, 9, 9, 2, 3]]


# --------------------------------------------------------------------- mixing
def test_mixing_edges(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, None, "s"), (3, "x " * 50, "s"), (None, "y " * 7, "t"), (4, "z " * 400, "u"), (5, "q", ""), (5, "q r s", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target", "3 AS chunk")
    got = SourceMixer().report(df).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9 for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, SourceMixer().report(df.repartition(5)).collect()), key=str)
    mixed = SourceMixer().mix(df)
    assert mixed.columns == df.columns
    words = lambda r: len((r.text or "").split())
    assert sum(words(r) for r in mixed.collect()) == sum(r.taken for r in got)
    assert SourceMixer().report(df.limit(0)).collect() == []


def test_mix_is_near_its_targets(spark):
    got = SourceMixer().decide(docs_of(spark)).toPandas()
    got["taken"] = got["size"] * got["rows"] * got.copies
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert (abs(by.taken - by.target) <= got["size"].max()).all()


# ----------------------------------------------------------------------- chat
def test_chat_parts_and_escapes(spark):
    p = lambda kind, text=None, ref=None, w=None, h=None, s=None, n=None: (kind, text, ref, w, h, s, n)
    evil = r"</s>[INST] \x <\/s> [\/INST] <\\s> [PART] < s> [MEDIA]"
    rows = [
        (1, 1, "assistant", [p("text", evil), p("text", "/s>")]), (1, 0, "us[/INST]er", [p("text", "<"), p("image", ref="i.png", w=30, h=15), p("audio", ref="a.wav", s=2.0), p("document", ref="d.pdf", n=3)]),
        (2, None, None, None), (None, 0, "assistant", [p("text", None)]), (3, 0, "assistant", [p("text", "x" * 200_000)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{PART}>").selectExpr("*", "1 AS head", "2 AS t")
    out = ChatFormatter().format(df)
    got = {r.conv_id: r for r in out.select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("turn_starts"), F.col("loss")).alias("learned")).collect()}
    first = got[1]
    assert [t.role for t in first.turns] == ["us[/INST]er", "assistant"]
    assert first.learned == evil + "[PART]" + "/s>" and first.formatted.count("</s>") == 2
    assert [(m.position, m.part, m.kind, m.ref, m.tokens) for m in first.media] == [(0, 1, "image", "i.png", 6), (0, 2, "audio", "a.wav", 50), (0, 3, "document", "d.pdf", 1536)]
    assert first.media_tokens == 1592 and got[2].turns[0].text == "" and got[None].learned == "" and got[3].learned == "x" * 200_000
    assert ChatFormatter().format(df.limit(0)).collect() == []


# -------------------------------------------------------------------- packing
def check_bins(rows, window):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return len(bins)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = entries.word_tokenizer()
    tok = Tokenizer.from_file(path)
    edge = [(1, None), (2, ""), (None, "Hello <|endoftext|> WORLD, it's É İ K"), (3, "<|ENDOFTEXT|> ab <|startoftext|>x"), (3, "<|ENDOFTEXT|> ab <|startoftext|>x"), (4, "word " * 5000), (5, "\x1c \x1d"), (6, "é É İx ΑΣ ΣΑ 12a, ..")]
    edges = spark.createDataFrame(edge, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS chunk")
    for df in (docs_of(spark), edges):
        want = []
        for r in df.collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
            want += [(r.doc_id, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        got = Packer(path, rows_per_chunk=50).pack(df).collect()
        assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
        assert check_bins(got, 2048) <= -(-sum(r.length for r in got) // 2048) + 1
    with_ids = Packer(path).pack(edges, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r.ids_crc32 for r in with_ids)
    assert Packer(path).pack(edges.limit(0)).collect() == []


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = sorted(set(rng.integers(1, 30, 5).tolist()), reverse=True)
        counts = {k: int(rng.integers(1, 4)) for k in lengths}
        space = int(rng.integers(0, 60))
        sums = {0}
        for k in lengths:
            sums = {s + k * m for s in sums for m in range(counts[k] + 1) if s + k * m <= space}
        got = fullest(space, lengths, counts)
        assert sum(k * m for k, m in got.items()) == max(sums) and all(m <= counts[k] for k, m in got.items())


def test_plan_uses_every_piece():
    histogram = {k: (k * 7919) % 50 + 1 for k in range(1, 100)}
    used = collections.Counter()
    for times, items in plan_bins(histogram, 100):
        assert sum(k * m for k, m in items) <= 100
        for k, m in items:
            used[k] += times * m
    assert used == histogram


# -------------------------------------------------------------------- quality
def test_quality_on_held_out_rows(spark):
    got = entries.op8_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 20 and (got.predicted == got.quality).mean() >= 0.95 and got.score.between(0, 1).all()


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "x" * 300_000, 5), (4, "a b", 6), (4, "a b", 6)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, label int")
    c = QualityClassifier()
    assert {r.score for r in c.score(df, c.train(df, none)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (None, 0), (2, None)], "doc_id long, label int")
    model = c.train(df, one)
    assert c.keep(df, model).columns == df.columns and c.keep(df, model).count() == 5
    assert c.score(df.limit(0), model).collect() == []
    import pyarrow as pa

    a, b = features_of(pa.array(["one two three", None, "x"])), features_of(pa.array(["x"]))
    assert (a[2] == b[0]).all()


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((fit(x, y, rounds=10).score(x) > 0.5) == y).mean() > 0.95


def plain_fit(x, y, bins, rounds, rate, ridge):
    """Boosted tables by loops over rows and cells, one feature after another; no pairs."""
    n = len(y)
    base = math.log(sum(y) / (n - sum(y)))
    cuts = [sorted({sorted(r[k] for r in x)[int((n - 1) * i / bins)] for i in range(1, bins)}) for k in range(len(x[0]))]
    cell = [[sum(v <= r[k] for v in cuts[k]) for r in x] for k in range(len(x[0]))]
    tables, z = [[0.0] * (len(c) + 1) for c in cuts], [base] * n
    for _ in range(rounds):
        for k, table in enumerate(tables):
            p = [1 / (1 + math.exp(-v)) for v in z]
            g, h = [0.0] * len(table), [0.0] * len(table)
            for i in range(n):
                g[cell[k][i]] += p[i] - y[i]
                h[cell[k][i]] += p[i] * (1 - p[i])
            parts = [(0, len(table))]
            for _ in range(3):
                best = (1e-9, None, None)
                for a, b in parts:
                    for c in range(a + 1, b):
                        value = lambda s, e: sum(g[s:e]) ** 2 / (sum(h[s:e]) + ridge)  # noqa: B023, E731
                        gain = value(a, c) + value(c, b) - value(a, b)
                        if gain > best[0] * (1 + 1e-12):
                            best = (gain, (a, b), c)
                if best[1] is None:
                    break
                parts.remove(best[1])
                parts = sorted([*parts, (best[1][0], best[2]), (best[2], best[1][1])])
            for a, b in parts:
                step = -rate * sum(g[a:b]) / (sum(h[a:b]) + ridge)
                for c in range(a, b):
                    table[c] += step
                z = [v + step if a <= cell[k][i] < b else v for i, v in enumerate(z)]
    return [1 / (1 + math.exp(-v)) for v in z]


def test_tables_are_those_of_a_plain_version():
    rng = np.random.default_rng(2)
    x = rng.random((90, 3)).round(2)
    y = (x[:, 0] + 0.3 * rng.random(90) > 0.6).astype(float)
    model = fit(x, y, bins=6, rounds=5, pairs=0, rate=0.15, ridge=1.0)
    assert np.allclose(model.score(x), plain_fit(x.tolist(), y.tolist(), 6, 5, 0.15, 1.0), atol=1e-9)


def test_pair_tables_are_added_cell_by_cell():
    rng = np.random.default_rng(3)
    x = rng.random((300, 3))
    model = fit(x, ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float), rounds=4, pairs=2, pair_rounds=6)
    for row, got in zip(x.tolist(), model.score(x), strict=True):
        z = model.base
        for k, table in enumerate(model.tables):
            z += table[sum(c <= row[k] for c in model.cuts[k])]
        for i, j, table in model.pairs:
            z += table[sum(c <= row[i] for c in model.coarse[i])][sum(c <= row[j] for c in model.coarse[j])]
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


# ------------------------------------------------------------------- archives
def test_archive_lookup(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    archive = WarcWriter(block_lines=8).write(pages)
    for r in pages.orderBy("page_id").limit(20).collect():
        found = [x for x in archive.lookup(r.url) if x["page_id"] == r.page_id]
        assert len(found) == 1 and found[0]["payload"] in (None, r.html.encode())
    assert archive.lookup("http://nowhere.example/x") == []


def test_archive_edges(spark):
    rows = [(1, "http://a.b/\tc", "x" * 2000), (2, None, "x" * 2000), (None, "http://www.A.b:8080/Q?z=1", "x" * 2000), (3, "", None), (4, "bad[", "y"), (4, "bad[", "y"), (5, "-", "é" * 600), (6, "%", "é" * 600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS page", "3 AS kind")
    got = sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in WarcWriter(block_lines=2, most_bytes=3000).write(df).read(df).collect()], key=str)
    assert got == [(1, 2000, "revisit", 2), (2, 2000, "response", None), (3, 0, "response", None), (4, 1, "response", None), (4, 1, "response", None), (5, 1200, "revisit", 6), (6, 1200, "response", None), (None, 2000, "revisit", 2)]
    told = {(x["page_id"], x["record_type"], x["refers_to_uri"]) for u in ("http://a.b/\tc", "-", "%") for x in WarcWriter(block_lines=2).write(df).lookup(u)}
    assert told == {(1, "revisit", "urn:none"), (5, "revisit", "%"), (6, "response", None)}
    assert WarcWriter().write(df.limit(0)).read(df).collect() == []
    assert surt("http://www.Example.com:80/A?b=C") == "com,example)/a?b=C" and surt(None) == ""
    assert [page_of(record_id(p, 0)) for p in (0, -7, None, 1 << 62)] == [0, -7, None, 1 << 62]
    with pytest.raises(ValueError):
        read_line("short")


# ---------------------------------------------------------------------- media
def test_media_round_trip():
    rng = np.random.default_rng(0)
    texts = [b"", b"a", b"\xff" * 64, b"\xff" * 900, bytes(range(256)) * 3] + [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (63, 64, 65, 383, 384, 385, 5000)]
    streams = media.write_images(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    for text, stream, (payload, tensor) in zip(texts, streams, media.read_images(streams), strict=True):
        assert payload == text + bytes(max(1, -(-len(text) // 64)) * 64 - len(text))
        frame = media.parse(stream)
        slow, quick = media._read_any(frame), media._by_component(frame)
        assert all((a == b).all() for a, b in zip(slow, quick, strict=True))
        assert tensor.shape == (frame.height, frame.width, 3) and (media.tensor_of(frame, slow) == tensor).all()
    assert media.write_images(np.zeros(0, np.uint8), np.zeros(1, np.int64)) == []


class Bits:
    """An entropy-coded segment, written bit by bit."""

    def __init__(self, codes):
        self.codes, self.bits = codes, ""

    def symbol(self, s):
        self.bits += self.codes[s]

    def number(self, v, n):
        if n:
            self.bits += format(v if v > 0 else v + (1 << n) - 1, f"0{n}b")

    def raw(self, v, n):
        if n:
            self.bits += format(v, f"0{n}b")

    def bytes(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")


def huffman(symbols):
    """A table of canonical codes of 4, 6, 8 ... bits and its marker segment."""
    sizes, code, out, counts = [4, 6, 8, 10, 12, 14, 16], 0, {}, [0] * 16
    todo, last = list(symbols), 0
    for size in sizes:
        code <<= size - last
        last = size
        room = (1 << size) - 1 - code if size < 16 else len(todo)
        take = todo[: max(0, min(len(todo), room // 2 if size < 16 else room))]
        todo = todo[len(take) :]
        for s in take:
            out[s] = format(code, f"0{size}b")
            code += 1
        counts[size - 1] = len(take)
    assert not todo
    return out, bytes(counts) + bytes(out)


def grey_stream(blocks, wide, tall):
    """A greyscale progressive stream of blocks [n, 64] in zigzag order: Huffman tables, EOB runs and refinement."""
    segment = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    dc_codes, dc_table = huffman(range(12))
    ac_codes, ac_table = huffman([r << 4 | s for s in range(11) for r in range(16)])
    out = b"\xff\xd8" + segment(0xDB, bytes([0, *[1] * 64])) + segment(0xC2, bytes([8]) + (8 * tall).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    out += segment(0xC4, b"\x00" + dc_table) + segment(0xC4, b"\x10" + ac_table)
    scan = lambda a, b, h, low, data: segment(0xDA, bytes([1, 1, 0, a, b, h << 4 | low])) + data
    toward = lambda v, n: int(abs(v)) >> n if v >= 0 else -(int(abs(v)) >> n)
    w, before = Bits(dc_codes), 0
    for v in (int(b[0]) >> 1 for b in blocks):
        d, before = v - before, v
        w.symbol(abs(d).bit_length())
        w.number(d, abs(d).bit_length())
    out += scan(0, 0, 0, 1, w.bytes())
    w = Bits(dc_codes)
    for b in blocks:
        w.raw(int(b[0]) & 1, 1)
    out += scan(0, 0, 1, 0, w.bytes())
    for first, last in ((1, 5), (6, 63)):
        w, run = Bits(ac_codes), 0

        def end(w=w):
            nonlocal run
            if run:
                n = run.bit_length() - 1
                w.symbol(n << 4)
                w.raw(run - (1 << n), n)
                run = 0

        for b in blocks:
            values, zeros = [toward(int(v), 1) for v in b[first : last + 1]], 0
            while values and not values[-1]:
                values.pop()
            for v in values:
                if not v:
                    zeros += 1
                    continue
                end()
                while zeros > 15:
                    w.symbol(0xF0)
                    zeros -= 16
                w.symbol(zeros << 4 | abs(v).bit_length())
                w.number(v, abs(v).bit_length())
                zeros = 0
            if len(values) < last + 1 - first:
                run += 1
        end()
        out += scan(first, last, 0, 1, w.bytes())
    w, run, late = Bits(ac_codes), 0, ""  # all AC coefficients get their last bit

    def finish():
        nonlocal run, late
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.raw(run - (1 << n), n)
            w.bits += late
            run, late = 0, ""

    for b in blocks:
        values = [int(v) for v in b[1:]]
        new = [k for k, v in enumerate(values) if abs(v) == 1]
        stop, zeros, fix = (new[-1] + 1 if new else 0), 0, ""
        for v in values[:stop]:
            if abs(v) > 1:
                fix += str(abs(v) & 1)
            elif not v:
                zeros += 1
                if zeros == 16:
                    finish()
                    w.symbol(0xF0)
                    w.bits += fix
                    zeros, fix = 0, ""
            else:
                finish()
                w.symbol(zeros << 4 | 1)
                w.raw(int(v > 0), 1)
                w.bits += fix
                zeros, fix = 0, ""
        rest = fix + "".join(str(abs(v) & 1) for v in values[stop:] if abs(v) > 1)
        if stop < 63 or rest:
            run, late = run + 1, late + rest
            if run == 0x7FFF:
                finish()
    finish()
    return out + scan(1, 63, 1, 0, w.bytes()) + b"\xff\xd9"


def test_media_reads_streams_of_others():
    """Coefficients of a stream with real Huffman tables, EOB runs and correction bits, and its pixels by the definition of the transform."""
    rng = np.random.default_rng(7)
    wide, tall = 4, 3
    blocks = np.zeros((wide * tall, 64), np.int64)
    for b in blocks:
        b[0] = rng.integers(-300, 300)
        at = rng.choice(np.arange(1, 64), rng.integers(0, 14), replace=False)
        b[at] = rng.integers(-40, 41, len(at))
    blocks[3:7, 1:] = 0  # a run of blocks without AC
    frame = media.parse(grey_stream(blocks, wide, tall))
    (got,) = media._read_any(frame)
    assert (got.reshape(-1, 64) == blocks).all()
    k, p = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * p + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    want = np.empty((8 * tall, 8 * wide))
    for i, b in enumerate(blocks):
        square = np.zeros(64)
        square[media.ZIGZAG] = b
        y, x = divmod(i, wide)
        want[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis.T @ square.reshape(8, 8) @ basis + 128
    tensor = media.tensor_of(frame, [got])
    assert tensor.shape == (24, 32, 3) and np.abs(tensor[..., 0] - np.clip(want, 0, 255)).max() <= 2


def test_media_wide_image():
    big = np.random.default_rng(1).integers(0, 256, 1_600_000, dtype=np.uint8)
    stream = media.write_images(big, np.array([0, len(big)]))
    ((payload, tensor),) = media.read_images(stream)
    assert payload == big.tobytes() and tensor.shape[1] == 32


def test_media_damage_is_noticed():
    (stream,) = media.write_images(np.frombuffer(b"hello", np.uint8), np.array([0, 5]))
    with pytest.raises(ValueError):
        media.parse(b"no" + stream)


def test_media_columns(spark):
    df = spark.createDataFrame([(1, None), (None, "é" * 70), (2, ""), (2, ""), (3, "x" * 200_000)], "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    out = media.load(media.store(df), tensors=True).collect()
    by = collections.defaultdict(set)
    for r in out:
        by[r.n_bytes].add((r.payload_sha256, r.media_sha256, r.feature))
        assert r.payload_bytes == max(1, -(-r.n_bytes // 64)) * 64 and len(r.tensor) == np.prod(r["shape"])
    assert len(out) == 5 and all(len(v) == 1 for v in by.values())
    assert media.load(media.store(df.limit(0))).collect() == []


# ----------------------------------------------------------------- neighbours
def exact_nearest(x, ids, q, k=20):
    s = x @ x[q]
    s[ids == ids[q]] = -np.inf
    return ids[np.lexsort((ids, -s))[: min(k, int((ids != ids[q]).sum()))]]


def recall_of(got, x, ids, asked, k=20):
    hits = total = 0
    for q in asked:
        want = exact_nearest(x, ids, q, k)
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert list(own["rank"]) == list(range(1, len(want) + 1)) and (np.diff(own.score) <= 0).all()
        hits, total = hits + len(set(want) & set(own.vec_id)), total + len(want)
    return hits / total


@pytest.mark.parametrize("shard", [60, 25_000])
def test_neighbours_recall(spark, shard):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = df.toPandas()
    x, ids = np.array([np.array(v, float) for v in p.embedding]), p.vec_id.to_numpy()
    got = ProjectionSearch(shard_rows=shard, leaf=24, query_rows=7).search(df, every=10).toPandas()
    assert recall_of(got, x, ids, np.flatnonzero(ids % 10 == 0)) >= 0.9


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((200, 64))
    x = centres[rng.integers(0, 200, n)] + 0.3 * rng.standard_normal((n, 64))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("kind", ["clustered", "outliers", "unclustered"])
def test_a_shard_stops_early_and_finds_most(kind):
    n, k = 20_000, 20
    x = clustered(n) if kind != "unclustered" else np.random.default_rng(1).standard_normal((n, 64))
    if kind == "unclustered":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "outliers":
        x[[5, 77]] *= 1e4
    ids, asked, hits, verified = np.arange(n) * 3, np.arange(0, n, 250), 0, 0
    shards = []
    scale = range_of(norms_of(x))
    for e in np.unique(scale)[::-1]:
        shards.append(Shard(ids[scale == e], x[scale == e], int(e), plane_of(64, 24, 5), 0.9, 64))
    best = {q: [] for q in asked}
    kth = np.full(len(asked), -np.inf)
    for shard in shards:
        i, names, score = shard.search(ids[asked], x[asked], kth, k)
        for j, q in enumerate(asked):
            best[q] = sorted(best[q] + list(zip(-score[i == j], names[i == j])))[:k]
            kth[j] = -best[q][-1][0] if len(best[q]) == k else -np.inf
        verified += shard.verified
    for q in asked:
        hits += len(set(exact_nearest(x, ids, q)) & {m for _, m in best[q]})
    assert hits / (k * len(asked)) >= 0.9
    assert verified / (n * len(asked)) < {"clustered": 0.1, "outliers": 0.1, "unclustered": 0.9}[kind]


def test_neighbours_over_many_shards(spark):
    x = clustered(6000, 3)
    x[::7] *= 3.0
    x[17] *= 1e4
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    search = ProjectionSearch(shard_rows=500, query_rows=10)
    placed, directory = search.index(df)
    assert len(directory.of) >= 12 and directory.of["n"].sum() == len(x) and placed.count() == len(x)
    got = search.search(df, every=100).toPandas()
    assert recall_of(got, x, ids, ids[::100]) >= 0.9


def test_neighbours_ties_take_the_smaller_id(spark):
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(60)] + [(100 + i, [0.5, 0.5, float(i) / 7]) for i in range(40)]
    got = ProjectionSearch().search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    for q in (0, 20, 40):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == exact_nearest(x, ids, int(np.flatnonzero(ids == q)[0])).tolist()


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [nan, 1.0]), (3, [1.0, None]), (4, [1.0, 1.0, 1.0]), (1, [3.0, 0.0]), (60, [-1.0, 0.0]),
        (80, [2.0, 0.0, 0.0]), (5, []), (6, [float("inf"), 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS shard", "3 AS `row`")
    got = [tuple(r) for r in ProjectionSearch().search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 2.0), (0, 3, 60, -1.0), (60, 1, 0, -1.0), (60, 2, 1, -2.0), (60, 3, 1, -3.0), (80, 1, 4, 2.0)]
    assert ProjectionSearch().search(df.limit(0)).collect() == []
    tiny = spark.createDataFrame([(0, [1e-310, 0.0]), (1, [1e300, 1e300]), (2, [1e-300, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ProjectionSearch().search(tiny).orderBy("rank").collect()] == [1, 2]
    assert chi_square(np.array([0.0, 7.344, np.inf]), 8).round(3).tolist() == [0.0, 0.5, 1.0]
    assert abs(chi_square_at(0.5, 8) - 7.344) < 1e-3


@pytest.mark.parametrize("longer", [10.0, 1000.0, None])
def test_neighbours_recall_with_few_long_vectors(spark, longer):
    rng = np.random.default_rng(11)
    n, k = 6000, 20
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if longer:
        x[[1, 1234, 4321]] *= longer
    else:
        x *= np.exp(rng.standard_normal(n))[:, None]
    asked = np.arange(0, n, 100)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ProjectionSearch().search(df, every=100).toPandas()
    hits = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:k]) & set(got[got.query_id == q].vec_id))
    assert len(got) == k * len(asked) and hits / (k * len(asked)) >= 0.9
