"""Pre-tokens of the public byte-level vocabularies, segmented with numpy.

The published split pattern (``public_tokenizers.PATTERN``) is

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

A token is a run of one character class, so its boundaries follow from the
class of each code point and its neighbours.  Only the contractions need a
second look, at single apostrophes.  Tests hold the result against the
library on random Unicode strings.

The tokenizer library's own BPE model encodes each distinct pre-token once
per worker; texts are then put together from those pieces.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from tessera.llm.textvec import blocks, span_hash
from tessera.llm.worker import held

LETTER, NUMBER, OTHER, SPACE, BLANK = 0, 1, 2, 3, 4  # BLANK is U+0020

#: Pieces kept per worker before the cache starts afresh.
CACHE_LIMIT = 1_500_000
FRONT_BITS = 20
#: Pre-tokens in the dictionary of recent ones before they join the sorted arrays.
RECENT = 50_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, from the regex library's Unicode tables."""
    import regex

    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for lo in range(0, 0x110000, 0x8000):
        chars = "".join(chr(c) for c in range(lo, lo + 0x8000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            found = "".join(regex.findall(pattern, chars))
            out[np.frombuffer(found.encode("utf-32-le"), dtype="<u4")] = kind
    out[[0x1C, 0x1D, 0x1E, 0x1F]] = OTHER  # no White_Space in Unicode
    out[0x20] = BLANK
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position of every pre-token's start, and how many each text has.

    ``data`` is UTF-8 of all texts, ``offsets`` their byte offsets.
    """
    n_texts = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(n_texts, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte position of each code point
    if len(lead) == len(data):
        code = data
    else:
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
    kind = _classes()[code]
    n = len(kind)
    is_space = kind >= SPACE
    first = np.zeros(n + 1, dtype=bool)  # first code point of a text; the end counts
    first[np.searchsorted(lead, offsets)] = True
    flat = np.minimum(kind, SPACE)
    change = np.ones(n, dtype=bool)
    change[1:] = flat[1:] != flat[:-1]
    change |= first[:n]
    start = change.copy()
    run_end = np.ones(n, dtype=bool)  # last code point of a run
    run_end[:-1] = change[1:]
    # The last blank of a run before a visible character leaves the run: a
    # U+0020 opens the next token, any other white space is a token itself.
    last_space = is_space & run_end & ~first[1:]
    after = np.flatnonzero(last_space) + 1
    start[after - 1] = True
    start[after[kind[after - 1] == BLANK]] = False
    # Contractions: an apostrophe that is a token of its own.
    quote = np.flatnonzero((code == 0x27) & start & run_end)
    quote = quote[(quote + 1 < n)]
    quote = quote[~first[quote + 1]]
    if len(quote):
        one = code[quote + 1]
        pair = np.isin(one, [ord(c) for c in "stmd"])
        nxt = np.where(quote + 2 < n, code[np.minimum(quote + 2, n - 1)], 0)
        nxt = np.where(first[np.minimum(quote + 2, n)], 0, nxt)
        triple = ((one == ord("r")) & (nxt == ord("e"))) | ((one == ord("v")) & (nxt == ord("e"))) | ((one == ord("l")) & (nxt == ord("l")))
        for hit, size in ((pair, 2), (triple, 3)):
            q = quote[hit]
            start[q + 1] = False
            stop = q + size
            stop = stop[(stop < n)]
            # what follows begins a token unless it is a blank's own affair
            letters = stop[(kind[stop] == LETTER) & ~first[stop]]
            start[letters] = True
    at = np.flatnonzero(start)
    return lead[at], np.diff(np.searchsorted(at, np.searchsorted(lead, offsets)))


def keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit key of every pre-token, how many each text has, and a second, independent key."""
    start, count = boundaries(data, offsets)
    end = np.append(start[1:], len(data)) if len(start) else start
    block = blocks(data)
    return start, end, count, span_hash(block, start, end), span_hash(block, start, end, 0x51)


def byte_letters() -> list[str]:
    """The printable character that the byte-level alphabet gives each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


class Pieces:
    """Token ids of pre-tokens through the library's model, each encoded once."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_pattern = re.compile("|".join(map(re.escape, self.special)).encode()) if self.special else None
        self.alphabet = dict(enumerate(byte_letters()))
        self._forget()

    def _forget(self) -> None:
        # Known pre-tokens: sorted keys with their slots, and a small
        # dictionary of recent ones that is merged in from time to time.
        # Plain arrays take some 20 bytes a pre-token.
        self.known, self.known_slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.recent: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, "<u4")
        self.begin = np.zeros(1 << 14, np.int32)
        self.size = np.zeros(1 << 14, np.int32)
        self.check = np.zeros(1 << 14, np.uint64)
        self.slots = self.used = 0
        # A direct-mapped table in front: most pre-tokens are found here
        # without sorting or per-word Python.
        self.front_key = np.zeros(1 << FRONT_BITS, np.uint64)
        self.front_slot = np.full(1 << FRONT_BITS, -1, np.int32)

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.alphabet))]

    def _add(self, key: int, check: int, raw: bytes) -> int:
        ids, k = self.piece(raw), self.slots
        if k >= len(self.begin):
            self.begin, self.size, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.check))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(ids)), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[k], self.size[k], self.check[k] = self.used, len(ids), check
        self.used += len(ids)
        self.slots += 1
        self.recent[key] = k
        return k

    def _merge(self) -> None:
        key = np.concatenate([self.known, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))])
        slot = np.concatenate([self.known_slot, np.fromiter(self.recent.values(), np.int32, len(self.recent))])
        order = np.argsort(key, kind="stable")
        self.known, self.known_slot, self.recent = key[order], slot[order], {}

    def _slots(self, key: np.ndarray, check: np.ndarray, start: np.ndarray, end: np.ndarray, raw: bytes) -> np.ndarray:
        """Slots of different, sorted keys; texts of unknown ones are encoded."""
        out = np.full(len(key), -1, np.int32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
            out = np.where(self.known[at] == key, self.known_slot[at], -1)
        for i in np.flatnonzero(out < 0).tolist():
            h = int(key[i])
            s = self.recent.get(h)
            out[i] = self._add(h, int(check[i]), raw[start[i] : end[i]]) if s is None else s
        return out

    def special_texts(self, raw: bytes, offsets: np.ndarray) -> set[int]:
        """Numbers of the texts in which a special string occurs."""
        if self.special_pattern is None:
            return set()
        return {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in self.special_pattern.finditer(raw)}

    def encode(self, data: np.ndarray, offsets: np.ndarray, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice (little-endian uint32) and n + 1 offsets.

        Equals the library's ``encode(text, add_special_tokens=False).ids``;
        texts that hold a special string go through the library whole, unless
        ``special`` is off: then such strings are ordinary text.  A pre-token
        that shares a key with another one shows by its second key; its text
        is put together without the cache.
        """
        if self.slots > CACHE_LIMIT:
            self._forget()
        elif len(self.recent) > RECENT:
            self._merge()
        start, end, count, key, check = keys(data, offsets)
        at = (key >> np.uint64(64 - FRONT_BITS)).astype(np.int64)
        slot = self.front_slot[at]
        miss = np.flatnonzero((slot < 0) | (self.front_key[at] != key))
        raw = data.tobytes()
        if len(miss):
            uniq, where, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            w = miss[where]
            slots = self._slots(uniq, check[w], start[w], end[w], raw)
            slot[miss] = slots[inverse]
            self.front_key[at[miss]], self.front_slot[at[miss]] = key[miss], slot[miss]
        size = self.size[slot]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.begin[slot] - (ends - size), size) + np.arange(total)]
        first = np.concatenate([[0], np.cumsum(count)])
        text_end = np.concatenate([[0], ends])[first]
        hits = self.special_texts(raw, offsets) if special else set()
        other = np.flatnonzero(self.check[slot] != check)
        mixed = set((np.searchsorted(first, other, "right") - 1).tolist())
        if hits or mixed:
            parts = []
            for t in range(len(offsets) - 1):
                if t in mixed - hits:
                    own = [i for k in range(first[t], first[t + 1]) for i in self.piece(raw[start[k] : end[k]])]
                    parts.append(np.array(own, "<u4"))
                elif t in hits:
                    text = raw[offsets[t] : offsets[t + 1]].decode("utf-8")
                    parts.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"))
                else:
                    parts.append(ids[text_end[t] : text_end[t + 1]])
            text_end = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts) if parts else ids[:0]
        return ids, text_end


def worker_pieces(tokenizer_file: str) -> Pieces:
    """The cache of this Python worker."""
    return held("tokens", "pieces", tokenizer_file, lambda: Pieces(tokenizer_file))
