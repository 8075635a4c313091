"""Token ids of texts by a given tokenizer, each distinct chunk of text encoded once per worker.

The tokenizers used here first cut a text into letters, digits, marks and white space, each with a
space before it at most, and encode these pieces on their own. Chunks are cut at some of these
places only, where bytes alone tell that the tokenizer cuts there too:

* before a space between two characters that are no white space;
* before and after a line feed between two such characters;
* between a letter and an ASCII mark other than the apostrophe, in either order.

Chunks are known by 64-bit hash and length, so a text costs array operations only, but for chunks
not seen before. A text that holds the string of an added token, such as ``<|endoftext|>``, is given
to the tokenizer as it is.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from tidings.llm.common import BYTE_HASH, WIDE, _power_tables, mixed

# Chunks remembered per worker (about 40 bytes each); the memory starts anew when it is full.
MOST_CHUNKS = 2_000_000

MARKS = np.zeros(256, bool)
MARKS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
SOLID = np.zeros(256, bool)
SOLID[[*range(33, 127), *range(128, 256)]] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks of UTF-8 text begin; every text that is not empty begins one."""
    size = len(data)
    cut = np.zeros(size + 1, bool)
    solid, letter, mark = SOLID[data], LETTERS[data], MARKS[data]
    if size and data.max() >= 0x80:
        # Two-byte letters of the Latin alphabet.
        for lead in (0xC3, 0xC5):
            at = np.flatnonzero(data[:-1] == lead)
            at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)] if lead == 0xC3 else at
            letter[at] = letter[at + 1] = True
        # What may be white space outside ASCII is not told apart from it.
        for lead, width in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
            at = np.flatnonzero(data == lead)
            for step in range(width):
                solid[np.minimum(at + step, size - 1)] = False
    if size > 2:
        lone = np.zeros(size, bool)
        lone[1:-1] = solid[:-2] & solid[2:]
        cut[:-1] |= lone & (data == 32)
        feed = np.flatnonzero(lone & (data == 10))
        cut[feed] = cut[feed + 1] = True
        cut[1:-1] |= (mark[1:] & letter[:-1]) | (letter[1:] & mark[:-1])
    edges = offsets[:-1][offsets[1:] > offsets[:-1]]
    # Rules that looked over the edge of a text are undone there and one byte before it.
    before = edges[edges > 0] - 1
    cut[before] &= (mark[before] & letter[np.maximum(before - 1, 0)]) | (
        letter[before] & mark[np.maximum(before - 1, 0)]
    )
    after = edges[edges < size - 1] + 1
    odd = after[(data[after - 1] == 32) | (data[after - 1] == 10)]
    cut[odd] = False
    cut[edges] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Ids of whole texts by a tokenizers file as it is."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content.encode() for token in added if token.content]
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, WIDE)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """Add new chunks; ``hashes`` are in order."""
        found = [one.ids for one in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = [one for ids in found for one in ids]
        start = self.used + np.cumsum(size) - size
        self.used += total
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.start = np.insert(self.start, place, start)
        self.size = np.insert(self.size, place, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and their number per text."""
        marked = self._with_added(data, offsets)
        if not marked:
            return self._encode(data, offsets)
        ids, counts, done = [], [], 0
        for text in [*marked, len(offsets) - 1]:
            own = offsets[done : text + 1]
            some, sizes = self._encode(data[own[0] : own[-1]], own - own[0])
            ids.append(some)
            counts.append(sizes)
            if text in marked:
                whole = data[offsets[text] : offsets[text + 1]].tobytes().decode("utf-8", "replace")
                found = self.tokenizer.encode(whole, add_special_tokens=False).ids
                ids.append(np.array(found, np.uint32))
                counts.append(np.array([len(found)]))
            done = text + 1
        return np.concatenate(ids), np.concatenate(counts)

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The texts that hold the string of an added token, in order."""
        whole, found = data.tobytes(), set()
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[text + 1]:
                    found.add(text)
                at = whole.find(token, at + 1)
        return sorted(found)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        ups, downs = _power_tables(1 << max(20, int(len(data)).bit_length()))
        sums = np.zeros(len(data) + 1, WIDE)
        np.cumsum(BYTE_HASH[data] * ups[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype(WIDE)
        distinct, first, back = np.unique(mixed(hashes), return_index=True, return_inverse=True)
        if len(self.known) > MOST_CHUNKS:
            self.clear()
        place = np.searchsorted(self.known, distinct)
        seen = np.zeros(len(distinct), bool)
        inside = place < len(self.known)
        seen[inside] = self.known[place[inside]] == distinct[inside]
        if not seen.all():
            new = first[~seen]
            whole = data.tobytes()
            chunks = [
                whole[a:b].decode("utf-8", "replace")
                for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)
            ]
            self._learn(distinct[~seen], chunks)
            place = np.searchsorted(self.known, distinct)
        size = self.size[place][back]
        total = np.cumsum(size)
        at = np.repeat(self.start[place][back] - total + size, size) + np.arange(total[-1])
        owner = np.searchsorted(offsets, starts, "right") - 1
        counts = np.bincount(owner, size, minlength=len(offsets) - 1).astype(np.int64)
        return self.ids[at], counts


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each text."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    ends = np.cumsum(counts) + np.arange(len(counts))
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = ids
    return out, counts + 1
