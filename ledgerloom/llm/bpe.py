"""Byte-level BPE pieces shared by encoding and packing: the tokenizer's tables, exact merges, word reuse."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable

import numpy as np
import regex

#: Words of a byte-level BPE before merging (fixed values of the public vocabulary's format).
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

_RUN = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge table of one vocabulary file and the exact merge of single words."""

    def __init__(self, source: str | bytes):
        spec = json.loads(source)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.start = [0] * 256
        for mark, byte in alphabet.items():
            self.start[byte] = vocab[mark]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left], vocab[right]] = (i, vocab[left + right])
        ordered = sorted(self.rank.items(), key=lambda x: x[0])
        self._keys = np.array([left << 32 | right for (left, right), _ in ordered], np.int64)
        self._ranks = np.array([r for _, (r, _) in ordered], np.int64)
        self._joined = np.zeros(len(ordered) + 1, np.int64)
        self._joined[self._ranks] = [j for _, (_, j) in ordered]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for mark, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in mark)
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank, leftmost first, is joined until none is left."""
        ids = [self.start[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank = self.rank
        while len(ids) > 1:
            best, at, joined = 1 << 60, -1, 0
            left = ids[0]
            for i in range(1, len(ids)):
                right = ids[i]
                found = rank.get((left, right))
                if found is not None and found[0] < best:
                    (best, joined), at = found, i
                left = right
            if at < 0:
                break
            ids[at - 1 : at + 1] = (joined,)
        return ids

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; pairs that never merge, and pads (-1), get the number of ranks."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (right >= 0), self._ranks[at], len(self._ranks))

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """:meth:`merge` of many words, as little-endian 32-bit ids: all words of about a length take each step together."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_width.setdefault(8 if len(w) <= 8 else 16 if len(w) <= 16 else 32 if len(w) <= 32 else 0, []).append(i)
        for i in by_width.pop(0, ()) if len(self._keys) else range(len(words)):
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        start, none = np.array(self.start, np.int64), len(self._ranks)
        blocks = [(width, own[i : i + 2048]) for width, own in by_width.items() for i in range(0, len(own), 2048)]
        for width, own in blocks if none else ():
            sizes = np.fromiter((len(words[i]) for i in own), np.int64, len(own))
            ids = np.full((len(own), width), -1, np.int64)
            ids[np.arange(width) < sizes[:, None]] = start[np.frombuffer(b"".join([words[i] for i in own]), np.uint8)]
            rank, where = self._rank_of(ids[:, :-1], ids[:, 1:]), np.array(own)
            while len(where):
                best = rank.argmin(1)
                lowest = np.take_along_axis(rank, best[:, None], 1)[:, 0]
                live = lowest < none
                for i, row in zip(where[~live].tolist(), ids[~live].astype("<i4"), strict=True):
                    out[i] = row[row >= 0].tobytes()
                ids, rank, where, best, lowest = ids[live], rank[live], where[live], best[live], lowest[live]
                if not len(where):
                    break
                line, columns = np.arange(len(where)), np.arange(ids.shape[1])
                ids[line, best] = self._joined[lowest]
                ids = np.take_along_axis(ids, np.minimum(columns + (columns > best[:, None]), ids.shape[1] - 1), 1)
                ids[:, -1] = -1
                columns = columns[:-1]
                rank = np.take_along_axis(rank, np.minimum(columns + (columns > best[:, None]), len(columns) - 1), 1)
                rank[:, -1] = none
                last = len(columns) - 1
                rank[line, np.minimum(best, last)] = self._rank_of(ids[line, np.minimum(best, last)], ids[line, np.minimum(best, last) + 1])
                inner = line[best > 0]
                rank[inner, best[inner] - 1] = self._rank_of(ids[inner, best[inner] - 1], ids[inner, best[inner]])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        n, rank = len(ids), self.rank
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(*rank[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in rank]
        heap = [(r, i, a, b, j) for r, j, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = joined, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (found := rank.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right], found[1]))
        return [x for x, here in zip(ids, alive, strict=True) if here]


def segments(text: str) -> list[str]:
    """Parts of ``text`` that never share a BPE word, cut at single spaces between other characters; the
    space is left out and belongs to the front of every part but the first."""
    return _SAFE_CUT.split(text) if _RUN.search(text) else text.split(" ")


class WordCache:
    """Ids of whole texts as little-endian 32-bit bytes, each distinct word resolved once.

    ``resolve`` gets the distinct words that are not held yet and returns their ids. At
    ``limit`` held words the cache starts anew, so memory is bounded.
    """

    def __init__(self, resolve: Callable[[list[bytes]], list[bytes]], limit: int = 700_000):
        self.resolve, self.limit, self.held = resolve, limit, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split, held = [WORDS.findall(t) for t in texts], self.held
        lacking = set().union(*split) - held.keys()
        if len(held) + len(lacking) > self.limit:
            held.clear()
            lacking = set().union(*split)
        order = list(lacking)
        held.update(zip(order, self.resolve([w.encode() for w in order]), strict=True))
        return [b"".join(map(held.__getitem__, words)) for words in split]
