"""Matroska media columns: containers in a binary column become tables of packets.

The reader walks EBML elements with variable-length ids and sizes, clusters (also of unknown
size), block groups and simple blocks with every kind of lacing, and cues. A packet knows its
track, its time and the bytes it takes in the file. The writer stores raw 8-bit mono samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, bounded, rows_out, type_of, whole_texts

# Element ids of the Matroska specification.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

#: Bytes of a frame, frames of a block, blocks of a cluster that the writer makes; samples a second.
FRAME, LACED, BLOCKS, RATE = 64, 8, 32, 8000
LACINGS = ("none", "xiph", "fixed", "ebml")


class MatroskaError(ValueError):
    """The bytes are no complete Matroska file."""


# -- reading ---------------------------------------------------------------------------------


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, length) of the variable-length number at ``at``; the value is None if all its bits are set
    (an unknown size). Ids keep their length marker."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no variable-length number at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise MatroskaError(f"a number is cut off at byte {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return value, length
    value &= (1 << 7 * length) - 1
    return (None if value == (1 << 7 * length) - 1 else value), length


def elements(data: bytes, start: int, end: int, closed_by: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, first byte of content, end of content) of the elements in a range. Segments and clusters may have
    an unknown size; one ends where an element begins that can't lie in it, or the range ends. As a cluster
    is closed by the next and a segment by the next, they never nest."""
    at = start
    while at < end:
        kind, n = read_vint(data, at, keep_marker=True)
        if kind in closed_by:
            return
        size, m = read_vint(data, at + n)
        body = at + n + m
        if size is None and kind not in (SEGMENT, CLUSTER):
            raise MatroskaError(f"element {kind:#x} at byte {at} has an unknown size")
        stop = _unknown_end(data, body, end, kind) if size is None else body + size
        if stop > end:
            raise MatroskaError(f"element {kind:#x} at byte {at} runs past its parent")
        yield kind, body, stop
        at = stop


def _unknown_end(data: bytes, body: int, end: int, kind: int) -> int:
    closers = frozenset(_TOP | {SEGMENT, EBML}) if kind == CLUSTER else frozenset({SEGMENT, EBML})
    at = body
    for _, _, at in elements(data, body, end, closers):
        pass
    return at


def _uint(data: bytes, start: int, end: int) -> int:
    if end - start > 8:
        raise MatroskaError(f"a number of {end - start} bytes at byte {start}")
    return int.from_bytes(data[start:end], "big")


def _float(data: bytes, start: int, end: int) -> float:
    if end - start not in (0, 4, 8):
        raise MatroskaError(f"a float of {end - start} bytes at byte {start}")
    return struct.unpack(">f" if end - start == 4 else ">d", data[start:end])[0] if end > start else 0.0


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    frame_ns: int = 0
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0


@dataclass(frozen=True, slots=True)
class Packet:
    track: int
    time_ns: int
    offset: int
    size: int
    keyframe: bool
    lacing: str
    cluster: int


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def laced_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """(sizes of the frames, first byte of the first) of a block's payload."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise MatroskaError(f"a laced block ends at byte {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:  # xiph: runs of 255 and a rest
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError("a lace is cut off")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    elif lacing == 3:  # ebml: the first size, then signed differences
        for i in range(n - 1):
            value, length = read_vint(data, at)
            if value is None:
                raise MatroskaError("a lace has an unknown size")
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * length - 1) - 1))
            at += length
    else:
        if (end - at) % n:
            raise MatroskaError("a fixed lace doesn't divide its block")
        return [(end - at) // n] * n, at
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("a lace runs past its block")
    return sizes, at


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of one file; raises :class:`MatroskaError` for anything cut off or inconsistent."""
    media, segments = Media(), 0
    for kind, start, end in elements(data, 0, len(data)):
        if kind == EBML:
            media.doc_type = next((data[a:b].rstrip(b"\0").decode("ascii", "replace") for k, a, b in elements(data, start, end) if k == DOC_TYPE), "matroska")
        elif kind == SEGMENT:
            segments += 1
            _segment(data, start, end, media)
    if not media.doc_type or not segments:
        raise MatroskaError("no EBML header" if segments else "no segment")
    return media


def _segment(data: bytes, start: int, end: int, media: Media) -> None:
    for kind, a, b in elements(data, start, end):
        if kind == INFO:
            for k, x, y in elements(data, a, b):
                if k == TIMESTAMP_SCALE:
                    media.scale = _uint(data, x, y)
                elif k == DURATION:
                    media.duration = _float(data, x, y)
        elif kind == TRACKS:
            for k, x, y in elements(data, a, b):
                if k == TRACK_ENTRY:
                    track = _track(data, x, y)
                    media.tracks[track.number] = track
        elif kind == CLUSTER:
            _cluster(data, a, b, media)
        elif kind == CUES:
            for k, x, y in elements(data, a, b):
                if k == CUE_POINT:
                    _cue(data, x, y, start, media)


def _track(data: bytes, start: int, end: int) -> Track:
    track = Track()
    for k, a, b in elements(data, start, end):
        if k == TRACK_NUMBER:
            track.number = _uint(data, a, b)
        elif k == TRACK_TYPE:
            track.kind = _uint(data, a, b)
        elif k == CODEC_ID:
            track.codec = data[a:b].decode("ascii", "replace")
        elif k == DEFAULT_DURATION:
            track.frame_ns = _uint(data, a, b)
        elif k == AUDIO:
            for j, x, y in elements(data, a, b):
                if j == SAMPLING:
                    track.rate = _float(data, x, y)
                elif j == CHANNELS:
                    track.channels = _uint(data, x, y)
                elif j == BIT_DEPTH:
                    track.bits = _uint(data, x, y)
    return track


def _cluster(data: bytes, start: int, end: int, media: Media) -> None:
    number, base = len(media.clusters), 0
    media.clusters.append(start)
    for kind, a, b in elements(data, start, end):
        if kind == CLUSTER_TIME:
            base = _uint(data, a, b)
        elif kind == SIMPLE_BLOCK:
            _block(data, a, b, base, number, True, media)
        elif kind == BLOCK_GROUP:
            inner = list(elements(data, a, b))
            for k, x, y in inner:
                if k == BLOCK:
                    _block(data, x, y, base, number, not any(j == 0xFB for j, _, _ in inner), media)


def _block(data: bytes, start: int, end: int, base: int, cluster: int, keyframe: bool, media: Media) -> None:
    number, n = read_vint(data, start)
    if number is None or start + n + 3 > end:
        raise MatroskaError(f"a block is cut off at byte {start}")
    relative, flags = struct.unpack_from(">hB", data, start + n)
    lacing = flags >> 1 & 3
    sizes, at = laced_sizes(data, start + n + 3, end, lacing)
    time, step = (base + relative) * media.scale, media.tracks[number].frame_ns if number in media.tracks else 0
    if not -(1 << 63) <= time <= time + len(sizes) * step < 1 << 63:
        raise MatroskaError(f"the time of the block at byte {start} is out of range")
    for i, size in enumerate(sizes):
        media.packets.append(Packet(number, time + i * step, at, size, keyframe, LACINGS[lacing], cluster))
        at += size


def _cue(data: bytes, start: int, end: int, segment: int, media: Media) -> None:
    time = 0
    for k, a, b in elements(data, start, end):
        if k == CUE_TIME:
            time = _uint(data, a, b)
        elif k == CUE_POSITIONS:
            inner = {j: _uint(data, x, y) for j, x, y in elements(data, a, b)}
            media.cues.append((time * media.scale, inner.get(CUE_TRACK, 0), segment + inner.get(CUE_CLUSTER, 0)))


# -- writing ---------------------------------------------------------------------------------


def _vint(value: int, length: int = 0) -> bytes:
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, content: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _vint(len(content)) + content


def _number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: str = "fixed") -> bytes:
    """Content of a (simple) block that holds ``frames``."""
    sizes = list(map(len, frames))
    kind = LACINGS.index(lacing) if len(frames) > 1 else 0
    head = _vint(track) + struct.pack(">hB", relative, 0x80 | kind << 1)
    if kind:
        head += bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += _vint(sizes[0])
        for before, now in zip(sizes, sizes[1:-1], strict=False):
            n = next(n for n in range(1, 9) if abs(now - before) < (1 << 7 * n - 1) - 1)
            head += _vint(now - before + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


def store_samples(payload: bytes, lacing: str = "fixed") -> bytes:
    """A Matroska file with ``payload`` as 8-bit mono samples at RATE a second, FRAME samples a frame."""
    frame_ns, step = FRAME * 1_000_000_000 // RATE, FRAME * LACED * 1000 // RATE
    per_block, per_cluster = FRAME * LACED, FRAME * LACED * BLOCKS
    info = element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    entry = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + _number(DEFAULT_DURATION, frame_ns) + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    for c in range(0, len(payload), per_cluster):
        time = c * 1000 // RATE
        blocks = [_number(CLUSTER_TIME, time)]
        for i, b in enumerate(range(c, min(c + per_cluster, len(payload)), per_block)):
            piece = payload[b : b + per_block]
            blocks.append(element(SIMPLE_BLOCK, block(1, i * step, [piece[f : f + FRAME] for f in range(0, len(piece), FRAME)], lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, _number(CUE_TIME, time) + element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    header = element(EBML, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
    return header + element(SEGMENT, b"".join(parts))


def padded(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes with zeros up to a positive multiple of 64, bytes before that)."""
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"), len(data)


# -- on Spark --------------------------------------------------------------------------------


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lacing: str = "fixed") -> DataFrame:
    """(doc_id, n_bytes, media binary): every whole text as samples of a Matroska file; null text is empty."""
    source = whole_texts(docs, id_col, text_col)
    ddl = f"doc_id {type_of(source, 'doc_id')}, n_bytes long, media binary"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            made = [padded(t) for t in batch.column("text").to_pylist()]
            yield rows_out(schema, [batch.column("doc_id"), [n for _, n in made], [store_samples(p, lacing) for p, _ in made]])

    return source.mapInArrow(run, ddl)


def packets(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a packet: id, track, codec, packet, time_ns, byte_start, byte_end, keyframe, lacing, cluster, cued, error.

    ``cued`` tells whether a cue points at the packet's cluster. Null media has no packets; bytes
    that can't be parsed give one row with ``error`` and nulls. A file is parsed by one task;
    its rows leave in bounded batches.
    """
    source = files.select(F.col(id_col).alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    ddl = f"doc_id {type_of(source, 'doc_id')}, track long, codec string, packet long, time_ns long, byte_start long, byte_end long, keyframe boolean, lacing string, cluster int, cued boolean, error string"
    schema = arrow_of(ddl)

    def table_of(doc_id: object, data: bytes) -> Iterator[tuple]:
        try:
            media = parse(data)
        except MatroskaError as e:
            yield (doc_id, *(None,) * 10, str(e))
            return
        cued = {at for _, _, at in media.cues}
        heads = [any(0 < start - at <= 12 for at in cued) for start in media.clusters]
        for i, p in enumerate(media.packets):
            codec = media.tracks[p.track].codec if p.track in media.tracks else None
            yield doc_id, p.track, codec, i, p.time_ns, p.offset, p.offset + p.size, p.keyframe, p.lacing, p.cluster, heads[p.cluster], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "media"):
            rows = [r for i, d in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True) if d is not None for r in table_of(i, d)]
            for start in range(0, len(rows), 20_000):
                yield rows_out(schema, list(zip(*rows[start : start + 20_000], strict=True)))

    return source.mapInArrow(run, ddl)


def describe(media: Media, samples: bytes) -> str:
    """Features of a file and the samples read from it, as text."""
    wave = np.frombuffer(samples, np.uint8).astype(np.int64)
    centred = wave - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    lacings = "+".join(sorted({p.lacing for p in media.packets}))
    end = max((p.time_ns + (media.tracks[p.track].frame_ns if p.track in media.tracks else 0) for p in media.packets), default=0)
    return (
        f"type={media.doc_type};tracks={len(media.tracks)};clusters={len(media.clusters)};cues={len(media.cues)};packets={len(media.packets)};lacing={lacings};"
        f"ms={end // 1_000_000};mean={int(wave.sum()) / max(1, len(wave)):.4f};rms={(int((centred * centred).sum()) / max(1, len(wave))) ** 0.5:.4f};crossings={crossings}"
    )


def read_back(files: DataFrame) -> DataFrame:
    """Digests of (doc_id, n_bytes, media) rows: the samples of each file's packets in order of time, and its features.

    The samples come from the byte ranges of the packet table. Media that can't be parsed gives
    null digests and the reason as its feature; null media gives nulls.
    """
    ddl = f"doc_id {type_of(files, 'doc_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long"
    schema = arrow_of(ddl)

    def digest(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        try:
            media = parse(data)
        except MatroskaError as e:
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), f"error={e}", None
        view = memoryview(data)
        samples = b"".join([view[p.offset : p.offset + p.size] for p in sorted(media.packets, key=lambda p: (p.track, p.time_ns))])
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), describe(media, samples), len(media.packets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "media"):
            found = [digest(d) for d in batch.column("media").to_pylist()]
            yield rows_out(schema, [batch.column("doc_id"), batch.column("n_bytes"), *zip(*found, strict=True)])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)
