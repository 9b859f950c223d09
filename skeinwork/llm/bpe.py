"""Byte-pair encoding and decoding of whole texts with the merges of a public vocabulary file.

A word is a row of a matrix: its parts and, beside them, the rank of every
adjacent pair. Each step scans the ranks for the minimum (the leftmost on ties),
deletes that boundary and looks up the two neighbouring pairs again. All words of
one length step together, so the arrays stay contiguous. Words over LONG bytes
take a heap instead, which keeps junk runs from costing the square of their length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from skeinwork.llm import ragged

LONG = 48
#: Entries and ids a worker's cache of encoded chunks may hold before it starts anew, some 25 MB: a worker that lives through the stages of a pipeline keeps it.
CACHE_CHUNKS, CACHE_IDS = 300_000, 4_000_000

# The split of the vocabulary's pre-tokenizer, over lower-cased text, and white space as it has it.
# A line feed comes out as a piece of its own here: it stands between chunks.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _WHITE + r"\p{L}\p{N}]+")
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, self.end = file["model"]["vocab"], file["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        letters = byte_letters()
        self.byte = np.array([ids[c] for c in letters], dtype=np.int32)
        self.last = np.array([ids[c + self.end] for c in letters], dtype=np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        keys = np.array([ids[a] << 16 | ids[b] for a, b in merges], dtype=np.uint32)
        self._table(keys)
        self.pairs = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = [b""] * self.size
        for text, i in [*ids.items(), *self.special.items()]:
            names[i] = text.encode()
        self.name_bytes = np.frombuffer(b"".join(x + b" " for x in names), dtype=np.uint8)
        self.name_len = np.array([len(x) + 1 for x in names], dtype=np.int64)
        self.name_at = np.concatenate([[0], np.cumsum(self.name_len)])[:-1]

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing; a key is looked up along the same slots as it was put."""
        self.bits = 20
        self.slot_key = np.full(1 << self.bits, 0xFFFFFFFF, dtype=np.uint32)
        self.slot_rank = np.full(1 << self.bits, _NONE, dtype=np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.slot_key[slot] not in (0xFFFFFFFF, key):
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.slot_key[slot] != key:
                self.slot_key[slot], self.slot_rank[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        slot = self._slot(keys)
        held = self.slot_key[slot]
        out = self.slot_rank[slot]
        other = np.flatnonzero((held != keys).ravel() & (held != 0xFFFFFFFF).ravel())
        if other.size:
            out, flat_keys, flat_slot = out.copy(), keys.ravel(), slot.ravel()
            while other.size:
                flat_slot[other] = (flat_slot[other] + 1) & ((1 << self.bits) - 1)
                held = self.slot_key[flat_slot[other]]
                out.ravel()[other] = self.slot_rank[flat_slot[other]]
                other = other[(held != flat_keys[other]) & (held != 0xFFFFFFFF)]
        return out

    def _same_length(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids) of the words of one length, as they end."""
        rows = np.arange(len(parts))
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while rows.size and parts.shape[1] > 1:
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(rows)), best]
            over = rank == _NONE
            if over.any():
                yield rows[over], parts[over]
                go = ~over
                rows, parts, ranks, best, rank = rows[go], parts[go], ranks[go], best[go], rank[go]
                if not rows.size:
                    return
            n, k = parts.shape
            line = np.arange(n)
            parts[line, best] = self.merged[rank]
            keep = np.arange(k - 1)[None, :] + (np.arange(k - 1)[None, :] > best[:, None])
            parts = np.take_along_axis(parts, keep, axis=1)
            if k == 2:
                break
            keep = np.arange(k - 2)[None, :] + (np.arange(k - 2)[None, :] >= best[:, None])
            ranks = np.take_along_axis(ranks, keep, axis=1)
            has = np.flatnonzero(best > 0)
            ranks[has, best[has] - 1] = self.ranks(parts[has, best[has] - 1], parts[has, best[has]])
            has = np.flatnonzero(best < k - 2)
            ranks[has, best[has]] = self.ranks(parts[has, best[has]], parts[has, best[has] + 1])
        if rows.size:
            yield rows, parts

    def _long(self, word: bytes) -> list[int]:
        part = self.byte[np.frombuffer(word, np.uint8)].tolist()
        part[-1] = int(self.last[word[-1]])
        n = len(part)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n and (rank := self.pairs.get(part[i] << 16 | part[after[i]])) is not None:
                heapq.heappush(heap, (rank, i, part[i], part[after[i]]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue
            part[i], part[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in part if x >= 0]

    def encode_words(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and where each word's ids start (one more at the end)."""
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        flat = np.frombuffer(b"".join(found), dtype=np.uint8)
        start = np.concatenate([[0], np.cumsum(sizes)])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == k)
            if k > LONG:
                done += [(rows[i : i + 1], np.array([self._long(found[r])], dtype=np.int32)) for i, r in enumerate(rows.tolist())]
                continue
            letters = flat[start[rows][:, None] + np.arange(k)[None, :]]
            parts = self.byte[letters]
            parts[:, -1] = self.last[letters[:, -1]]
            done += [(rows[r], ids) for r, ids in self._same_length(parts)] if k > 1 else [(rows, parts)]
        lengths = np.zeros(len(found) + 1, dtype=np.int64)
        for rows, ids in done:
            lengths[rows + 1] = ids.shape[1]
        at = np.cumsum(lengths)
        out = np.empty(at[-1], dtype=np.uint16 if self.size <= 65536 else np.int32)
        for rows, ids in done:
            out[at[rows][:, None] + np.arange(ids.shape[1])[None, :]] = ids
        return out, at

    def pieces(self, chunks: list[bytes]) -> tuple[list[str], np.ndarray]:
        """All pieces of the chunks in order, a line feed after each chunk; and of each piece the id, if it is a special token, or -1."""
        text = b"\n".join(chunks).decode("utf-8", "replace") + "\n"
        if self.special_pattern is None or not self.special_pattern.search(text):
            found = self._pieces(text)
            return found, np.full(len(found), -1, dtype=np.int64)
        found, special = [], []
        for part in filter(None, self.special_pattern.split(text)):
            own = [part] if part in self.special else self._pieces(part)
            found += own
            special += [self.special.get(part, -1)] * len(own)
        return found, np.array(special, dtype=np.int64)

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # a last sigma is lower-cased like any other
        return _PIECES.findall(text.lower())

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' names, one space between them, in UTF-8."""
        ids = ids.astype(np.int64)
        return self.name_bytes[ragged.spread(self.name_at[ids], self.name_len[ids])].tobytes()[:-1] if len(ids) else b""


def longer(kept: np.ndarray, used: int, more: int) -> np.ndarray:
    """The used part of an array, with room for more and half as much again."""
    out = np.empty((used + more) * 3 // 2, dtype=kept.dtype)
    out[:used] = kept[:used]
    return out


class Encoder:
    """Encodes texts by their chunks between ASCII white space; known chunks are looked up by hash, and by their bytes on a hit."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.empty(0, dtype=np.uint64)
        self.start = self.count = self.text_start = self.text_end = np.empty(0, dtype=np.int64)
        self.text, self.text_used = np.empty(1 << 16, dtype=np.uint8), 0
        self.ids = np.empty(1 << 16, dtype=np.uint16 if self.v.size <= 65536 else np.int32)
        self.used = 0

    def _keep(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keep the chunks' bytes; where they start and end."""
        new = data[ragged.spread(starts, ends - starts)]
        if self.text_used + len(new) > len(self.text):
            self.text = longer(self.text, self.text_used, len(new))
        self.text[self.text_used : self.text_used + len(new)] = new
        at = self.text_used + np.cumsum(ends - starts)
        self.text_used += len(new)
        return at - (ends - starts), at

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode the chunks of data; where each one's ids start, and how many they are."""
        text = data.tobytes()
        found, special = self.v.pieces([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        seen = {"\n": 0}
        number = np.array([seen.setdefault(x, len(seen)) for x in found], dtype=np.int64)
        flat, at = self.v.encode_words([x.encode() for x in list(seen)[1:]])
        at = np.concatenate([[0], at])
        lengths, starts = np.diff(at)[number], at[number]
        for k in np.flatnonzero(special >= 0).tolist():
            flat = np.append(flat, flat.dtype.type(special[k]))
            starts[k], lengths[k] = len(flat) - 1, 1
        ends = np.concatenate([[0], np.cumsum(lengths)[number == 0]])
        new = flat[ragged.spread(starts, lengths)]
        if self.used + len(new) > len(self.ids):
            self.ids = longer(self.ids, self.used, len(new))
        self.ids[self.used : self.used + len(new)] = new
        ends += self.used
        self.used += len(new)
        return ends[:-1], np.diff(ends)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a slice of rows, and where each row's ids start (one more at the end)."""
        starts, ends, row = ragged.words(data, at)
        if not starts.size:
            return self.ids[:0], np.zeros(len(at), np.int64)
        hashes, sample, inverse = np.unique(ragged.hash_words(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_CHUNKS or self.used > CACHE_IDS:
            self._clear()
        slot = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = slot < len(self.hashes)
        known[inside] = self.hashes[slot[inside]] == hashes[inside]
        if not known.all():
            fresh = np.flatnonzero(~known)
            take = sample[fresh]
            start, count = self._learn(data, starts[take], ends[take])
            kept_start, kept_end = self._keep(data, starts[take], ends[take])
            for name, new in (("start", start), ("count", count), ("text_start", kept_start), ("text_end", kept_end), ("hashes", hashes[fresh])):
                setattr(self, name, np.insert(getattr(self, name), slot[fresh], new))
            slot = np.searchsorted(self.hashes, hashes)
        begin, lengths, own = self.start[slot][inverse], self.count[slot][inverse], slot[inverse]
        # Chunks that have the hash of another one are encoded for themselves.
        clash = np.flatnonzero(~ragged.equal(data, starts, ends, self.text, self.text_start[own], self.text_end[own]))
        if clash.size:
            begin[clash], lengths[clash] = self._learn(data, starts[clash], ends[clash])
        ids = self.ids[ragged.spread(begin, lengths)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])[row]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    return Encoder(Vocabulary(path))
