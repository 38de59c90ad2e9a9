import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import matroska as m


@pytest.mark.parametrize("value", [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**35, 2**55])
def test_numbers_round_trip(value):
    coded = m._vint(value)
    assert m.read_vint(coded, 0) == (value, len(coded))


@pytest.mark.parametrize("lacing", ["xiph", "fixed", "ebml"])
def test_lacing_round_trip(lacing):
    rng = random.Random(3)
    for _ in range(50):
        sizes = [64] * 5 if lacing == "fixed" else [rng.choice([0, 1, 200, 255, 256, 600, 20_000]) for _ in range(rng.randint(2, 9))]
        frames = [rng.randbytes(n) for n in sizes]
        data = m.block(1, -5, frames, lacing)
        got, at = m.laced_sizes(data, 4, len(data), m.LACINGS.index(lacing))
        assert got == sizes
        assert data[at:] == b"".join(frames)


def test_packets_of_a_file():
    payload = random.Random(1).randbytes(64 * 8 * 32 * 2 + 640)
    media = m.parse(m.store_samples(payload))
    assert [p.time_ns for p in media.packets] == [i * 8_000_000 for i in range(len(payload) // 64)]
    assert len(media.clusters) == len(media.cues) == 3
    assert media.tracks[1].codec == "A_PCM/INT/LIT"


def test_clusters_of_unknown_size_and_block_groups():
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(1, 3, [b"ab", b"cde"], "xiph")) + m.element(0xFB, b"\1"))
    body = m._number(m.CLUSTER_TIME, 10) + group
    open_cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + body
    data = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm")) + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + open_cluster * 2
    media = m.parse(data)
    assert [(p.time_ns, p.size, p.keyframe, p.cluster) for p in media.packets] == [(13_000_000, n, False, c) for c in (0, 1) for n in (2, 3)]


def test_cut_off_files_are_errors_or_shorter(spark):
    data = m.store_samples(b"x" * 640)
    for end in range(1, len(data)):
        with pytest.raises(m.MatroskaError):
            m.parse(data[:end])
    got = m.packets(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:50])), (3, None), (4, bytearray(b""))], "doc_id long, media binary")).collect()
    assert sum(r.doc_id == 1 for r in got) == 10
    assert [r.error is not None for r in got if r.doc_id == 2] == [True]
    assert not [r for r in got if r.doc_id == 3]


def test_every_text_comes_back(spark, docs, none, rows):
    got = m.read_back(m.store_texts(docs)).collect()
    want = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        full = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        want.append((doc_id, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], key=key) == sorted(want, key=key)
    assert m.read_back(m.store_texts(none)).count() == 0


def test_corrupt_files_are_errors_and_nothing_else():
    """Bytes changed, cut out and put in anywhere: a file is read or refused, and what was read can be described."""
    rng = random.Random(12)
    whole = [m.store_samples(rng.randbytes(64 * 70), lacing) for lacing in ("xiph", "fixed", "ebml")]
    read = 0
    for _ in range(4000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data)) if rng.random() < 0.4 else rng.randrange(min(len(data), 160))
            kind = rng.randrange(3)
            data[at : at + (kind != 2)] = b"" if kind == 1 else bytes([rng.choice([0, 1, 0x1F, 0x7F, 0x80, 0xFF, rng.randrange(256)])])
        try:
            media = m.parse(bytes(data))
        except m.MatroskaError:
            continue
        read += 1
        samples = b"".join(bytes(data[p.offset : p.offset + p.size]) for p in sorted(media.packets, key=lambda p: (p.track, p.time_ns)))
        assert m.describe(media, samples)
        assert all(-(1 << 63) <= p.time_ns < 1 << 63 for p in media.packets)
    assert read > 100


@pytest.mark.parametrize(
    "head",
    [
        m.element(m.INFO, m.element(m.DURATION, b"abc")),
        m.element(m.INFO, m.element(m.TIMESTAMP_SCALE, b"\xff" * 9)),
        m.CLUSTER.to_bytes(4, "big") + b"\xff" + m._number(m.CLUSTER_TIME, (1 << 64) - 1) + m.element(m.SIMPLE_BLOCK, m.block(1, 0, [b"a"])),
        m.BLOCK_GROUP.to_bytes(1, "big") + b"\xff",
        m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, b"\xff\0\0\x80")),
    ],
)
def test_odd_elements_are_errors(spark, head):
    data = m.element(m.EBML, m.element(m.DOC_TYPE, b"\xff\xfe")) + m.element(m.SEGMENT, head)
    with pytest.raises(m.MatroskaError):
        m.parse(data)
    files = spark.createDataFrame([(1, 1, bytearray(data)), (2, 1, bytearray(m.store_samples(b"x" * 64)))], "doc_id long, n_bytes long, media binary")
    assert {r.doc_id: r.feature.startswith("error=") for r in m.read_back(files).collect()} == {1: True, 2: False}
    assert {r.doc_id: r.error is not None for r in m.packets(files).collect()} == {1: True, 2: False}


def test_open_clusters_one_after_another_are_read_in_one_go():
    body = m._number(m.CLUSTER_TIME, 10) + m.element(m.SIMPLE_BLOCK, m.block(1, 3, [b"ab"]))
    data = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm")) + m.SEGMENT.to_bytes(4, "big") + b"\xff" + (m.CLUSTER.to_bytes(4, "big") + b"\xff" + body) * 5000
    media = m.parse(data)
    assert len(media.packets) == len(media.clusters) == 5000
    assert m.describe(media, b"ab" * 5000)  # its track is declared nowhere
