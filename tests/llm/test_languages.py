"""Codewords, n-grams, decoding, and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest

from plantpulse.llm import languages


@pytest.mark.parametrize("k, near", [(2, 1), (3, 2), (4, 4), (5, 8), (7, 32), (30, 8)])
def test_codewords_lie_apart(k, near):
    code = languages.codewords(k)
    assert code.shape[0] == k and set(np.unique(code)) == {-1, 1}
    assert (np.abs(code.sum(axis=0)) < k).all()
    apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
    assert apart >= near and languages._nearest(code) == apart


def plain_grams(text):
    data = " " + " ".join("".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).split(" ")) + " "
    data = data.encode()
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    out = Counter()
    for n in languages.ORDERS:
        for i in range(len(data) - n + 1):
            code = int.from_bytes(data[i : i + n], "big")
            out[((code * 2654435761 + n * 40503) % 2**32) >> (32 - languages.BITS)] += 1
    return out


@pytest.mark.parametrize("piece", [5, 64, 1 << 20])
def test_n_grams_of_texts_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(languages, "PIECE", piece)
    texts = ["", "a", "Ab c", "naïve  %% CAFÉ 12 x", "the end. " * 30, "日本語 テ", "\x00\n"]
    got = [Counter() for _ in texts]
    for codes, owner in languages.grams(texts):
        for c, o in zip(codes.tolist(), owner.tolist()):
            got[o][c] += 1
    assert got == [plain_grams(t) for t in texts]


def test_a_wrong_bit_is_corrected():
    code = languages.codewords(5)
    k, b = code.shape
    model = languages.Model(list("abcde"), code, np.zeros((1, b)), np.tile([1.0, 0.0], (b, 1)), np.ones((k, b)))
    for r in range(k):
        for bit in range(b):
            found = code[r].astype(float) * 2
            found[bit] *= -1
            best, score, unsure = languages.decode(model, found[None])
            assert best[0] == r and 0.6 < score[0] <= 1 and not unsure[0]
    best, score, unsure = languages.decode(model, np.zeros((1, b)))
    assert best[0] == 0 and score[0] == pytest.approx(1 / k) and unsure[0]  # a tie goes to the first


@pytest.fixture(scope="module")
def answers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.train(docs)
    rows = {r.doc_id: r for r in languages.languages(docs, model).collect()}
    return docs.select("doc_id", "lang", "text").collect(), rows, model


def test_held_out_accuracy(answers):
    docs, rows, model = answers
    assert model.languages == sorted({d.lang for d in docs}) and len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {i for i, r in rows.items() if r.held_out}
    right = [rows[d.doc_id].lang_pred == d.lang for d in held]
    assert sum(right) / len(right) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_wrong_labels_of_held_out_rows_change_nothing(spark, answers):
    docs, _, model = answers
    twisted = spark.createDataFrame(
        [(d.doc_id, "xx" if zlib.crc32(str(d.doc_id).encode()) % 4 == 2 else d.lang, d.text) for d in docs],
        "doc_id long, lang string, text string",
    )
    again = languages.train(twisted)
    assert again.languages == model.languages and np.allclose(again.weights, model.weights) and np.allclose(again.bits, model.bits)


def test_odd_texts(spark, docs, answers):
    _, _, model = answers
    rows = languages.languages(docs, model).collect()
    assert len(rows) == docs.count()
    by_text = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (1, 2, 3):
        assert by_text[i].lang_pred == "und" and by_text[i].score == 0 and by_text[i].ambiguous
    assert by_text[10].lang_pred in model.languages and not [r for r in rows if r.doc_id is None][0].held_out


def test_nothing_to_learn_from(docs, no_docs):
    empty = languages.train(no_docs.withColumnRenamed("label", "lang"))
    assert empty.languages == []
    assert {r.lang_pred for r in languages.languages(docs, empty).collect()} == {"und"}
    assert languages.languages(no_docs, empty).collect() == []


def test_one_and_two_languages(spark):
    rows = [(i, "aa" if i % 2 else "bb", ("lorem ipsum dolor " if i % 2 else "quux wizzle frob ") * 4 + str(i)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    two = languages.train(docs)
    assert all(r.lang_pred == rows[r.doc_id][1] for r in languages.languages(docs, two).collect())
    one = languages.train(docs.filter("lang = 'aa'"))
    assert {r.lang_pred for r in languages.languages(docs, one).collect()} == {"aa"}
