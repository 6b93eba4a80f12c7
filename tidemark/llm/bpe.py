"""Byte-level BPE ids of many texts at once: pieces are cut by array operations, and each distinct piece is encoded once.

The tokenizer's own model encodes the pieces. Cutting follows its pre-tokenizer: contractions, an optional space before letters,
digits or other characters, runs of white space without the last character before something else. Texts with characters at or
above U+0280 go to the tokenizer whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm.kit import Spans

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
FIRST_SLOW_LEAD = 0xCA
MOST_CACHED = 1_000_000  # pieces; some 40 bytes each


def _kinds() -> np.ndarray:
    kinds = np.zeros(0x280, np.uint8)
    for c in range(0x280):
        major = unicodedata.category(chr(c))[0]
        kinds[c] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
    kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = BLANK
    return kinds


KINDS = _kinds()


def _byte_letters() -> list[str]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to; all of its bytes have it."""
    kinds = KINDS[np.minimum(data, 127)]
    leads = np.flatnonzero((data >= 0xC2) & (data < FIRST_SLOW_LEAD))
    leads = leads[leads + 1 < len(data)]
    kinds[leads] = kinds[leads + 1] = KINDS[((data[leads].astype(np.int32) & 0x1F) << 6) | (data[leads + 1] & 0x3F)]
    return kinds


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts start, by the pre-tokenizer's rules; a text's first byte always starts one."""
    n = len(data)
    kinds = byte_kinds(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    edge = first.copy()
    edge[1:n] |= kinds[1:] != kinds[:-1]
    at = np.flatnonzero(edge[:n])
    ends = np.append(at[1:], n)
    start = np.zeros(n + 1, bool)
    blank = kinds[at] == BLANK
    # White space: what precedes its last character is one piece; the last one joins what follows if it is a space.
    a, e = at[blank], ends[blank]
    start[a] = True
    inner = ~first[e]
    last = e - 1 - ((data[e - 1] >= 0x80) & (data[e - 1] < 0xC0))
    start[last[inner]] = True
    a = at[~blank]
    joined = ~first[a] & (data[np.maximum(a, 1) - 1] == 0x20)
    start[a[~joined]] = True
    # Contractions: an apostrophe alone, that no space leads, takes the letters of its ending along.
    e = ends[~blank]
    quote = a[(data[a] == 0x27) & (e == a + 1) & ~joined & ~first[e]]
    padded = np.append(data, np.zeros(3, np.uint8))
    same = np.append(kinds, np.full(3, 255, np.uint8))
    stop = np.append(first, np.ones(3, bool))
    one = np.isin(padded[quote + 1], np.frombuffer(b"stmd", np.uint8))
    pairs = (padded[quote + 1].astype(np.int32) << 8) | padded[quote + 2]
    two = np.isin(pairs, [0x7265, 0x7665, 0x6C6C]) & ~stop[quote + 2]
    for hit, k in ((one, 2), (two & ~one, 3)):
        q = quote[hit]
        start[q + 1] = False
        nxt = q + k
        more = nxt < n
        start[nxt[more & ~stop[nxt] & (same[nxt] == LETTER)]] = True
    start[:n] |= first[:n]
    return np.flatnonzero(start[:n])


class Encoder:
    """Keeps the ids of the pieces it has met, as arrays sorted by the pieces' hashes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.keys, self.offsets, self.lengths, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        tokenize, letters = self.model.tokenize, BYTE_LETTERS
        found = [[t.id for t in tokenize("".join([letters[b] for b in piece]))] for piece in pieces]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        offsets = np.cumsum(lengths) - lengths + len(self.ids)
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.offsets, self.lengths = (np.insert(x, at, y) for x, y in ((self.keys, keys), (self.offsets, offsets), (self.lengths, lengths)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of each text's ids."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.keys) > MOST_CACHED:
            self.clear()
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, index, inverse = np.unique(Spans(data).hash(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            raw = data.tobytes()
            new = index[~known]
            self._learn(keys[~known], [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        at = at[inverse]
        lengths = self.lengths[at]
        done = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.offsets[at] - (done - lengths), lengths) + np.arange(done[-1])]
        of = np.append(0, done)[np.searchsorted(starts, offsets)]
        slow = np.flatnonzero(np.add.reduceat(np.append(data, 0) >= FIRST_SLOW_LEAD, np.minimum(offsets[:-1], len(data))) * (offsets[1:] > offsets[:-1])) if len(offsets) > 1 else []
        if len(slow):
            parts, counts, raw = [], of[1:] - of[:-1], data.tobytes()
            parts = [ids[of[i] : of[i + 1]] for i in range(len(of) - 1)]
            for i in slow:
                text = raw[offsets[i] : offsets[i + 1]].decode()
                parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                counts[i] = len(parts[i])
            ids, of = np.concatenate(parts), np.append(0, np.cumsum(counts))
        return ids, of


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; it lives as long as the worker is reused."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
