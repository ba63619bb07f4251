"""Cross-tokenizer alignment against both tokenizers over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilspark.llm import alignment
from veilspark.llm.alignment import Aligner, byte_level

from ..conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    a_all, b_all, of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_level()
    a_all.encode_special_tokens = True
    docs, counts = [], Counter()
    for doc, text in rows:
        groups, links = [], []
        if text:
            want = (" " + text).encode()
            a = a_all.encode(" " + text, add_special_tokens=False).ids
            b = b_all.encode(text)
            a_bytes = [bytes(of[c] for c in a_all.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_all.id_to_piece(i)[3:5], 16)]) if b_all.is_byte(i) else b_all.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == want == b"".join(b_bytes):
                ends = defaultdict(lambda: [[], []])
                for side, (ids, said) in enumerate(((a, a_bytes), (b, b_bytes))):
                    at = 0
                    for i, x in zip(ids, said):
                        at += len(x)
                        ends[at][side].append(i)
                links = [(i, j) for p in sorted(ends) for i in ends[p][0] for j in ends[p][1]]
                group = [[], []]
                for p in sorted(ends):
                    group[0] += ends[p][0]
                    group[1] += ends[p][1]
                    if all(ends[p]):
                        groups.append(group)
                        group = [[], []]
                counts.update(links)
            else:
                a = b = []
        else:
            a = b = []
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((doc, len(a), len(b), len(groups), links, said))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = [(d, a, b, g, len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(s.encode()).hexdigest() if s else "") for d, a, b, g, k, s in docs]
    return sorted(out, key=str), sorted((a, b, n, n == best[b]) for (a, b), n in counts.items()), sorted(((d, s) for d, *_, s in docs), key=str)


def got(df, **k):
    return sorted(map(tuple, Aligner(A, B, **k).report(df).collect()), key=str)


@pytest.mark.parametrize("block", [8 << 20, 20_000])
def test_documents(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    want, pairs, said = brute([(r.doc_id, r.text) for r in df.collect()])
    assert got(df) == want and sum(r[3] for r in want) > 10_000
    assert sorted(map(tuple, Aligner(A, B).pairs(df).collect())) == pairs
    assert sorted(((r.doc_id, r.groups) for r in Aligner(A, B).groups(df).collect()), key=str) == said


ROWS = [
    (1, None), (2, ""), (3, " "), (4, " leading and  two   spaces \n\t mixed \r\n end "), (5, "a <|endoftext|> b <s> c </s> <unk> <0x41>"), (6, "▁ is a space ▁ to B"), (7, "naïve café ①ﬁ é  nbsp  em 　wide \x1c sep \x85 nel"),
    (8, "日本語 テキスト 😀 emoji 👩‍👩‍👧"), (9, "x\x00y \x00 z"), (None, "same text"), (None, "same text"), (10, "same text"), (11, "don't we'll I'M  'tis"), (12, "w" * 50_000 + " a"), (13, "for you " * 20_000), (14, "1234567890 12 3.14 $5"), (15, "\n\n \n x"), (16, "end space "), (17, "a▁ b"), (18, "क्या है"),
]


def test_edges(spark):
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in ROWS], "doc_id long, text string, block int, parts string, n_a int")
    want, pairs, said = brute(ROWS)
    assert got(df) == want
    assert {r[0]: r[1] for r in want}[6] == 0
    assert got(df.limit(0)) == []
    assert got(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_documents_as_weights(spark):
    rows = [(1, "of of of of it"), (2, "it"), (3, "it it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = {(r.a, r.b): r["count"] for r in Aligner(A, B, weight="documents").pairs(df).collect()}
    assert sorted(out.values()) == [1, 3] and sorted(r["count"] for r in Aligner(A, B).pairs(df).collect()) == [4, 4]
    with pytest.raises(ValueError):
        Aligner(A, B, weight="words")
