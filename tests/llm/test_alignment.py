import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import alignment
from ledgerloom.llm.queries import QUERIES, vocabulary_path

from .conftest import DOCS, ordered

BYTES, PIECES = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    """All results by loops over tokens, with the libraries' own encoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder = Tokenizer.from_file(BYTES)
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def groups_of(text):
        want = b" " + (text or "").encode()
        if not text:
            return []
        a = [(i, bytes(byte[c] for c in a_coder.id_to_token(i))) for i in a_coder.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode()) for i in b_coder.encode(text)]
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return []
        ends = []
        for tokens in (a, b):
            at, own = 0, []
            for _, x in tokens:
                at += len(x)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = {cut: i for i, cut in enumerate(cuts)}
        out = [([], []) for _ in cuts]
        for side, tokens in enumerate((a, b)):
            k = 0
            for (i, _), end in zip(tokens, ends[side], strict=True):
                out[k][side].append(i)
                k += end in group
        return out

    def run(rows):
        found = [(doc_id, groups_of(text)) for doc_id, text in rows]
        links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
        count = Counter(p for own in links for p in own)
        most = Counter()
        for (x, _), n in count.items():
            most[x] = max(most[x], n)
        out = []
        for (doc_id, groups), own in zip(found, links, strict=True):
            said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
            numbers = [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values())]
            out.append((doc_id, *numbers, sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()), said))
        return out

    return run


AWKWARD = ["a  b", " lead", "trail ", "x\ny\r\n\r\n", "\t", "é▁", "ﬁ①", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00a", " ", "🙂🙂 naïve", "石头河流stone", "a" * 300, "=-" * 400, "ab" * 500, " " * 50, "word word", "<|endoftext|>"]


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(5)
    return [(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 60_000] + [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(2000 + i, "".join(rng.choice("ab c\n.é石🙂0") for _ in range(rng.randint(1, 80)))) for i in range(60)]


@pytest.mark.parametrize("head_pairs,links", [(250_000, 4096), (0, 4096), (40, 0), (700, 3)])
def test_equals_brute_force(spark, texts, brute, monkeypatch, head_pairs, links):
    """Any number of pairs held, groups by links or by distinct ids: the same results."""
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("uid", F.lit(1)).withColumn("pair", F.lit("x")).repartition(3)
    if links != alignment.LINKS_A_GROUP:  # tasks read the module again, so this branch is held against brute force here
        with open(BYTES, "rb") as v, open(PIECES, "rb") as p:
            tokens = alignment.Tokenizers(v.read(), p.read())
        some = [t or "" for _, t in texts]
        one, two = alignment.align_run(tokens, some), alignment.align_run(tokens, some, links)
        for x, y in zip(vars(one).values(), vars(two).values(), strict=True):
            assert np.array_equal(x, y)
    got = alignment.linked(df, BYTES, PIECES, head_pairs=head_pairs).collect()
    assert ordered([tuple(r) for r in got]) == ordered(brute(texts))


def test_few_pairs_at_once(spark, texts, brute, monkeypatch):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    aligned = alignment.align(df, BYTES, PIECES)
    want = Counter(p for r in aligned.collect() for p in zip(r.a, r.b, strict=True))
    got = {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.n for r in alignment.pair_counts(aligned).collect()}
    assert got == want


def test_query_on_awkward_rows(spark, docs, rows, brute, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute([(r[0], r[1]) for r in rows])]
    got = QUERIES["op13_token_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered([tuple(r) for r in got.collect()]) == ordered(want)


def test_empty_table_and_texts(spark):
    none = spark.createDataFrame([], DOCS)
    assert alignment.linked(none, BYTES, PIECES).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "é▁")], "doc_id long, text string")
    assert ordered([tuple(r) for r in alignment.linked(blank, BYTES, PIECES).collect()]) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
