"""Token counts, the word table and packing against the tokenizers themselves."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from plantpulse.llm import packing, token_counts, word_table
from plantpulse.llm.codec import WordIds


def encoded(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_tokenizer(docs, texts, byte_file):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, byte_file).collect())
    want = Counter()
    for i, t in texts:
        n = len(encoded(byte_file, t))
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert got == want


@pytest.mark.parametrize("overlap", [8, 64])
def test_chunks_come_back_in_step(docs, texts, byte_file, overlap):
    """Tiny chunks and overlaps, so that widening happens and long runs have no boundary at all."""
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, byte_file, chunk=100, overlap=overlap).collect())
    assert got == Counter((i, len(encoded(byte_file, t))) for i, t in texts)


def test_splice_over_random_texts(byte_file):
    draw = random.Random(3)
    alphabet = ["a", "bc", " ", "  ", "\n", "!", "'s", "12", "é", "<|endoftext|>", "\t", "word", "、"]
    for _ in range(60):
        text = "".join(draw.choice(alphabet) for _ in range(400))
        want, overlap = len(encoded(byte_file, text)), 32
        while True:
            step = 4 * overlap
            rows = []
            for start, piece in token_counts.cut(text, step, overlap):
                tokens, left, right = token_counts.edges(byte_file, piece, start, overlap, step)
                rows.append({
                    "tokens": tokens, "left_at": [x for x, _ in left], "left_before": [n for _, n in left],
                    "right_at": [x for x, _ in right], "right_before": [n for _, n in right],
                })
            if (total := token_counts.splice(rows)) is not None:
                break
            overlap *= 8
        assert total == want


def test_units_match_the_tokenizer(byte_file):
    draw = random.Random(5)
    alphabet = ["a", "bc", " ", " ", "  ", "\n", "!", "'s", "12", "é", "<|endoftext|>", " ", "\x1c", "\x85", "word"]
    texts = ["".join(draw.choice(alphabet) for _ in range(60)) for _ in range(200)]
    assert token_counts.UnitCounts(byte_file).of_texts(texts) == [len(encoded(byte_file, t)) for t in texts]


def test_word_ids_match_the_tokenizer(word_file):
    draw = random.Random(7)
    alphabet = ["A", "bc", " ", " ", "\n", "!", "'s", "12", "É", "é", "<|endoftext|>", " ", "\x1c", "İ", "ß", "≠", "日"]
    texts = ["".join(draw.choice(alphabet) for _ in range(60)) for _ in range(200)]
    got = [np.frombuffer(b, "<u4").tolist() for b in WordIds(word_file, limit=300).of_texts(texts)]
    assert got == [encoded(word_file, t) for t in texts]


def test_word_table_round_trip(docs, texts, word_file):
    rows = word_table.encode_decode(docs, word_file, digests=True, batch_bytes=200_000, bucket_bytes=300_000).collect()
    tok, want = Tokenizer.from_file(word_file), Counter()
    for i, t in texts:
        ids = encoded(word_file, t)
        decoded = tok.decode(ids, skip_special_tokens=False)
        want[i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_word_table_gives_texts(docs, word_file):
    row = word_table.encode_decode(docs.filter("doc_id = 5"), word_file).first()
    assert row.ids == " ".join(map(str, encoded(word_file, "two words"))) and row.decoded == "two</w> words</w>"


def test_packing_keeps_every_id_once(docs, texts, word_file):
    rows = packing.pack(docs, word_file, capacity=64, group_rows=4).collect()
    want = Counter()
    for i, t in texts:
        ids = encoded(word_file, t) + [2]
        for a in range(0, len(ids), 64):
            some = np.array(ids[a : a + 64], dtype="<u4")
            want[i, a, len(some), zlib.crc32(some.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_first_fit_decreasing_is_that():
    draw = np.random.default_rng(1)
    for _ in range(50):
        sizes = draw.integers(1, 50, size=40)
        bins, offsets, used = packing.first_fit_decreasing(sizes, 50)
        room, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            at = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
            if at == len(room):
                room.append(50)
            want[i] = at
            room[at] -= sizes[i]
        assert bins.tolist() == [want[i] for i in range(len(sizes))] and used == len(room)


def test_nothing_from_nothing(no_docs, word_file, byte_file):
    assert token_counts.token_counts(no_docs, byte_file).collect() == []
    assert word_table.encode_decode(no_docs, word_file, digests=True).collect() == []
    assert packing.pack(no_docs, word_file).collect() == []


def test_fewer_remembered_words_pack_the_same(docs, word_file):
    """The pipeline's workers remember fewer words; that costs time and changes no row."""
    import corpus_pipeline
    from plantpulse.llm import codec

    few = packing.pack(docs, word_file, remembered=40).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    many = packing.pack(docs, word_file).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert Counter(few) == Counter(many)
    assert corpus_pipeline.REMEMBERED <= codec.REMEMBERED // 3


def test_words_are_cut_from_what_is_written_for_their_ids(word_file):
    """Also words without ids, at both ends and in a row."""
    made = word_table.Written([b"zero", b"", "é".encode(), b"3"])
    sizes = np.array([0, 2, 0, 0, 1, 3, 0])
    got = made.of_words(np.array([0, 2, 1, 3, 3, 0]), sizes)
    assert got == [b"", "zero é".encode(), b"", b"", b"", b"3 3 zero", b""]
    assert made.of_words(np.array([], dtype=np.int64), np.array([0, 0])) == [b"", b""]
    assert made.of_words(np.array([], dtype=np.int64), np.array([], dtype=np.int64)) == []
