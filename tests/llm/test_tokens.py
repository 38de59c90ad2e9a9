import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import packing, transducer
from ledgerloom.llm.bpe import Merges
from ledgerloom.llm.queries import vocabulary_path

from .conftest import ordered

ODD = ["", " ", "  a", "a  b\n\n c", "don't we'll I'M", "<|endoftext|>x<|endoftext|>", "日本語 тест é\U0001f600‍", " 　x", "9" * 300, "ab" * 3000, "x" * 70 + " y", "a\r\n\tb", "<|endoftext"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def all_docs(spark, docs):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return docs.unionByName(odd, allowMissingColumns=True)


def expected(tokenizer, frame):
    return [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("size", [0, 5, 40_000])
def test_ids_equal_the_library(spark, all_docs, none, tokenizer, size):
    found = transducer.encode(all_docs, vocabulary_path(), lexicon_size=size, digest=True).collect()
    want = [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, ids in expected(tokenizer, all_docs)]
    assert ordered([tuple(r) for r in found]) == ordered(want)
    assert transducer.encode(none, vocabulary_path()).count() == 0


def test_texts_come_back(all_docs):
    back = transducer.decode(transducer.encode(all_docs, vocabulary_path()), vocabulary_path())
    assert ordered([(r.doc_id, r.text) for r in back.collect()]) == ordered([(r.doc_id, r.text or "") for r in all_docs.select("doc_id", "text").collect()])


def test_lexicon_is_minimal_and_exact():
    with open(vocabulary_path(), "rb") as f:
        merges = Merges(f.read())
    words = [b"walks", b"talks", b"walking", b"talking", b"", b"walks"]
    lexicon = transducer.Lexicon(transducer.compile_lexicon(words, merges))
    assert lexicon.ranks([b"talking", b"talks", b"walking", b"walks", b"walk", b"", b"walkss"]).tolist() == [0, 1, 2, 3, -1, -1, -1]
    assert [np.frombuffer(lexicon.ids_of(i), "<u4").tolist() for i in range(4)] == [merges.merge(w) for w in (b"talking", b"talks", b"walking", b"walks")]
    assert len(lexicon.final) == 8  # both stems share all that follows their first letter


def test_long_and_short_merges_agree(tokenizer):
    with open(vocabulary_path(), "rb") as f:
        merges = Merges(f.read())
    rng = random.Random(8)
    words = [bytes(rng.choice(b"aeinrstlo ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.merge_many(words)] == [merges.merge(w) for w in words] == [merges._merge_long([merges.start[b] for b in w]) for w in words]


def brute_best_fit(sizes, window):
    """Longest first into the fullest sequence with room, by looking at every one."""
    room = []
    for n in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(window - n)
    return sorted(room)


def test_best_fit_equals_looking_at_all():
    rng = random.Random(6)
    for _ in range(60):
        window = rng.choice([1, 2, 7, 64, 100])
        sizes = [rng.randint(1, window) for _ in range(rng.randint(0, 80))]
        placed, offsets = packing.best_fit(np.array(sizes, np.int64), window)
        filled = {}
        for s, o, n in sorted(zip(placed.tolist(), offsets.tolist(), sizes, strict=True)):
            assert o == filled.get(s, 0)
            filled[s] = o + n
        assert sorted(window - n for n in filled.values()) == brute_best_fit(sizes, window)


def test_pieces_hold_every_id_once(all_docs, none, tokenizer):
    found = packing.pack(all_docs, vocabulary_path()).collect()
    want = [(i, start, len(ids[start : start + 2048]), zlib.crc32(np.array(ids[start : start + 2048], "<u4").tobytes()), len(ids)) for i, coded in expected(tokenizer, all_docs) for ids in [[*coded, 1]] for start in range(0, len(ids), 2048)]
    assert ordered([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found]) == ordered(want)
    by = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048
    assert len(by) <= sum(by.values()) / 2048 + 2
    assert packing.pack(none, vocabulary_path()).count() == 0


@pytest.mark.parametrize("run", [" " * 1_000_000 + "x", "\n" * 300_000, "a" + "\t " * 200_000, "=" * 300_000, "ab" * 30_000 + " <|endoftext|>" + " " * 50_000 + "'s", "don't " + " " * 30_000 + "\n\n we'll"])
def test_long_runs_are_encoded_like_the_library(tokenizer, run):
    with open(vocabulary_path(), "rb") as f:
        encode = packing.encoder(f.read())
    assert list(encode(run)) == tokenizer.encode(run, add_special_tokens=False).ids
