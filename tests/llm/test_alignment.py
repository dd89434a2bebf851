"""Alignment of tokenizers against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers as P  # noqa: E402

from tertulia.llm import alignment, queries  # noqa: E402
from tertulia.llm.common import table  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
AWKWARD = [None, "", " ", "a", "  two  blanks ", "Ä b\x1c c\x85d", "😀 <|endoftext|> x", "▁ sign", "</s> <0x41> <unk>", "x" * 3000, "tab\there\n\nthere", "a\x00b", "﻿é é",
           "word " * 30, "日本語 текст", "ﬁ １２ ①"]


def slow(rows):
    """Per row the contract's columns, with tokenizers loaded afresh."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {}
    extra = 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            byte[chr(x)] = x
        else:
            byte[chr(extra)] = x
            extra += 1

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    encoded, counts = [], Counter()
    for _, text in rows:
        want = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xb, yb = [bytes(byte[c] for c in a.id_to_token(i)) for i in x], [of_b(i) for i in y]
        if not text or b"".join(xb) != want or b"".join(yb) != want:
            x, y, xb, yb = [], [], [], []
        xe, ye = np.cumsum([0, *map(len, xb)]).tolist(), np.cumsum([0, *map(len, yb)]).tolist()
        links, j0 = [], 0
        for i in range(len(x)):
            while j0 < len(y) and ye[j0 + 1] <= xe[i]:
                j0 += 1
            j = j0
            while j < len(y) and ye[j] < xe[i + 1]:
                links.append((x[i], y[j]))
                j += 1
        cuts = set(xe[1:]) & set(ye[1:])
        sides = []
        for ids, ends in ((x, xe), (y, ye)):
            groups = [[]]
            for i, end in zip(ids, ends[1:]):
                groups[-1].append(str(i))
                if end in cuts:
                    groups.append([])
            sides.append([",".join(g) for g in groups[:-1]])
        parts = ["|".join(p) for p in zip(*sides)]
        encoded.append((len(x), len(y), len(cuts), links, ";".join(parts)))
        counts.update(set(links))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    return [(key, n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(text.encode()).hexdigest() if links else "") for (key, _), (n_a, n_b, n_groups, links, text) in zip(rows, encoded)], counts, most


def stored(spark, tmp_path_factory, rows, schema, parts=3):
    path = str(tmp_path_factory.mktemp("table") / "t")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    words = ["".join(r.choice("abcdeéß ,.\n1") for _ in range(r.randrange(1, 9))) for _ in range(80)]
    texts = [*AWKWARD, *(" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(60))]
    return [(i, t) for i, t in enumerate(texts)] + [(70, texts[-1]), (None, "no id"), (None, "no id")]


def by_row(found):
    return sorted((tuple(r) for r in found), key=repr)


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    return stored(spark, tmp_path_factory, [(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, run long, n_a long, key string")


def test_alignment(spark, docs, rows):
    got = alignment.align(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert by_row(got.collect()) == by_row(slow(rows)[0])


def test_many_runs_and_levels(spark, docs, rows, monkeypatch):
    """Runs of a few documents, merged three at a time over several levels."""
    monkeypatch.setattr(alignment, "RUN_RECORDS", 60)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 200)
    monkeypatch.setattr(alignment, "FAN", 6)
    runs = alignment.encode(docs, A, B)
    assert runs.filter("radix is not null").select("run").distinct().count() > 18
    got = alignment.contribute(runs, alignment.count_links(runs, 32_000, fan=6))
    assert by_row(got.collect()) == by_row(slow(rows)[0])


def test_counts_of_pairs(spark, docs, rows):
    _, counts, most = slow(rows)
    want = sorted((a, b, n, n == most[a]) for (a, b), n in counts.items())
    assert sorted(tuple(r) for r in alignment.link_counts(docs, A, B).collect()) == want


def test_over_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert by_row(queries.op11_tokenizer_alignment(spark, sf_dir).collect()) == by_row(slow(rows)[0])


def test_a_long_text_in_stretches(spark, tmp_path_factory):
    r = random.Random(4)
    long = " ".join("".join(r.choice("abcdefghi,.\n") for _ in range(r.randrange(1, 9))) + (" " * (r.random() < 0.05)) for _ in range(60_000))
    both = alignment.aligner(A, B)
    assert both.whole and len(both.stretches(long)) > 3 and " ".join(both.stretches(long)) == long
    rows = [(1, long), (2, "short")]
    assert by_row(alignment.align(stored(spark, tmp_path_factory, rows, "doc_id long, text string", 1), A, B).collect()) == by_row(slow(rows)[0])


def test_empty_table(spark, tmp_path_factory):
    empty = stored(spark, tmp_path_factory, [], "doc_id long, text string", 1)
    assert alignment.align(empty, A, B).collect() == [] and alignment.link_counts(empty, A, B).collect() == []
    blank = stored(spark, tmp_path_factory, [(1, None), (2, "")], "doc_id long, text string", 1)
    assert by_row(alignment.align(blank, A, B).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_compressed_numbers():
    r = np.random.default_rng(1)
    for kind in ("<u1", "<u4", "<u8"):
        v = np.sort(r.integers(0, 200, 1000)).astype(kind)
        assert (alignment.expand(alignment.squeeze(v), kind) == v).all()
        w = r.permutation(v)
        assert (alignment.from_steps(alignment.squeeze(alignment.steps(w)), kind) == w).all()
    assert len(alignment.expand(alignment.squeeze(np.zeros(0, np.uint32)), "<u4")) == 0
