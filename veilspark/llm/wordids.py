"""Ids of whole texts by a table of words in numpy arrays: a word's ids are worked out once, a text's are gathered.

A slab's words are found by byte classes and looked up by their 64-bit hash in a table of two places a word; only words that
are not there reach ``learn``, which returns their ids (and, if asked for, what they decode to). The table holds ``2**bits``
words and their ids in flat arrays of bounded size and is emptied when these are full, so a worker's memory is bounded
whatever the input. A slab never depends on what the table still holds.

Texts with other characters than ASCII and the Latin letters U+00C0 to U+00FF, and texts with an added token, are cut by the
regular expression, one by one, and take part in the same table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import textops as X

U = np.uint64
OTHER, LETTER, DIGIT, BLANK, ODD = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_CLASS[128:] = ODD
_LATIN = 0xC3


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased bytes, class of each byte); the two bytes of a Latin letter are letters."""
    kind = _CLASS[data]
    low = X.LOWER[data]
    lead = np.flatnonzero(data == _LATIN)
    lead = lead[lead + 1 < len(data)]
    if len(lead):
        nxt = data[lead + 1]
        good = (nxt >= 0x80) & (nxt < 0xC0) & (nxt != 0x97) & (nxt != 0xB7)
        lead, nxt = lead[good], nxt[good]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = np.where(nxt < 0x9F, nxt | 0x20, nxt)
    return low, kind


def bounds(low: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: an apostrophe with its ending, a run of letters, a digit, a run of other signs."""
    n = len(low)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = np.ones(n + 1, bool)
    begin[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin |= first
    mark = np.flatnonzero(low == 39)
    if len(mark):
        mark = mark[begin[mark]]
        at = lambda k: np.where(mark + k < n, low[np.minimum(mark + k, n - 1)], 0)
        same = lambda k: ~np.logical_or.reduce([first[np.minimum(mark + j, n)] for j in range(1, k + 1)])
        one, two = at(1), at(2)
        short = same(1) & np.isin(one, [115, 116, 109, 100])
        long = same(2) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for m, k in ((mark[short], 2), (mark[long], 3)):
            begin[m + 1] = False
            begin[np.minimum(m + k, n)] = True
    begin[:n] &= kind != BLANK
    stop = np.ones(n + 1, bool)
    stop[:n] = begin[:n] | (kind == BLANK)
    stop[offsets] = True
    starts = np.flatnonzero(begin[:n])
    edges = np.flatnonzero(stop)
    return starts, edges[np.searchsorted(edges, starts, side="right")]


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that begin at ``at``, one after the other."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(size)
    return flat[np.repeat(at - (ends - size), size) + np.arange(total)]


class WordTable:
    """``learn(words)`` gives lists of the words' ids; ``cut(text)`` the words of a text that the fast way can't cut;
    ``spell`` the bytes that a list of ids decodes to, each token's followed by a blank."""

    def __init__(self, learn: Callable, cut: Callable, added: list[str], spell: Callable | None = None, kind: str = "<u4", bits: int = 19, room: int = 1 << 22):
        self.learn, self.cut, self.spell, self.kind, self.bits, self.room = learn, cut, spell, kind, bits, room
        self.special = re.compile(b"|".join(re.escape(a.encode()) for a in added)) if added else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(2 << self.bits, U)
        self.at, self.size = np.zeros(2 << self.bits, np.int32), np.zeros(2 << self.bits, np.int32)
        self.flat, self.used = np.zeros(self.room, self.kind), 0
        self.say_at, self.say_size = (np.zeros(2 << self.bits, np.int32), np.zeros(2 << self.bits, np.int32)) if self.spell else (None, None)
        self.said, self.spoken = np.zeros(self.room * 4 if self.spell else 0, np.uint8), 0

    def _add(self, words: list[str]) -> tuple:
        """(at, size, say_at, say_size) of new words, whose ids are put at the end of the flat arrays."""
        ids = self.learn(words)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), self.kind, int(size.sum()))
        said = [self.spell(x) for x in ids] if self.spell else []
        many = sum(map(len, said))
        if self.used + len(flat) > self.room or self.spoken + many > len(self.said):
            self.room = max(self.room, len(flat), -(-many // 4))
            self.clear()
            return None
        at = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        if not self.spell:
            return at, size, at, size
        say = np.fromiter(map(len, said), np.int64, len(said))
        say_at = self.spoken + np.cumsum(say) - say
        self.said[self.spoken : self.spoken + many] = np.frombuffer(b"".join(said), np.uint8)
        self.spoken += many
        return at, size, say_at, say

    def look(self, keys: np.ndarray, word: Callable[[np.ndarray], list[str]]) -> tuple:
        """(at, size, say_at, say_size) of each hashed word; ``word`` spells those at some places out."""
        while True:
            place = ((keys >> U(64 - self.bits)) << U(1)).astype(np.int64)
            place += self.keys[place] != keys
            miss = np.flatnonzero(self.keys[place] != keys)
            out = [c[place] for c in ((self.at, self.size, self.say_at, self.say_size) if self.spell else (self.at, self.size))]
            if not len(miss):
                return out
            new, first, inv = np.unique(keys[miss], return_index=True, return_inverse=True)
            got = self._add(word(miss[first]))
            if got is None:
                continue  # the table is empty now, and all words are looked up again
            for c, g in zip(out, got):
                c[miss] = g[inv]
            to = ((new >> U(64 - self.bits)) << U(1)).astype(np.int64)
            to += (self.keys[to] != 0) & ((self.keys[to + 1] == 0) | (new & U(1) == 1))
            self.keys[to] = new
            to, last = to[::-1], slice(None, None, -1)
            to, pick = np.unique(to, return_index=True)
            for c, g in zip((self.at, self.size, self.say_at, self.say_size), got):
                if c is not None:
                    c[to] = g[last][pick]
            self.keys[to] = new[last][pick]
            return out

    def words(self, slab: X.Slab) -> tuple[np.ndarray, np.ndarray, Callable]:
        """(hash of each word, document of each, how to spell words out)."""
        low, kind = classes(slab.data)
        odd = np.zeros(slab.n, bool)
        doc_of = lambda at: np.searchsorted(slab.offsets, at, side="right") - 1
        strange = np.flatnonzero(kind == ODD)
        odd[doc_of(strange)] = True
        raw = slab.data.tobytes()
        if self.special is not None:
            odd[[int(doc_of(m.start())) for m in self.special.finditer(raw)]] = True
        lost = np.flatnonzero(odd)
        for d in lost:
            kind[slab.offsets[d] : slab.offsets[d + 1]] = BLANK
        starts, ends = bounds(low, kind, slab.offsets)
        keys, doc, text = X.range_hash(low, starts, ends), doc_of(starts), low.tobytes()
        extra: list[str] = []
        if len(lost):
            cuts = [self.cut(raw[slab.offsets[d] : slab.offsets[d + 1]].decode()) for d in lost]
            extra = [w for c in cuts for w in c]
            body = [w.encode() for w in extra]
            size = np.fromiter(map(len, body), np.int64, len(body))
            end = np.cumsum(size)
            more = X.range_hash(np.frombuffer(b"".join(body), np.uint8), end - size, end) if body else np.zeros(0, U)
            doc = np.concatenate([doc, np.repeat(lost, [len(c) for c in cuts])])
            by = np.argsort(doc, kind="stable")
            keys, doc = np.concatenate([keys, more])[by], doc[by]
        else:
            by = None
        plain = len(starts)

        def spelt(at: np.ndarray) -> list[str]:
            at = at if by is None else by[at]
            return [text[starts[i] : ends[i]].decode() if i < plain else extra[i - plain] for i in at.tolist()]

        # no word has hash 0: that stands for an empty place
        return np.maximum(keys, U(1)), doc, spelt

    def encode(self, slab: X.Slab, end: int | None = None) -> tuple[np.ndarray, np.ndarray, tuple | None]:
        """(ids of the slab's documents, bounds of each document's, (decoded bytes, bounds) if ``spell`` was given)."""
        keys, doc, spelt = self.words(slab)
        found = self.look(keys, spelt)
        at, size = found[:2]
        each = np.bincount(doc, size, slab.n).astype(np.int64) if len(doc) else np.zeros(slab.n, np.int64)
        ids = gather(self.flat, at, size)
        if end is not None:
            whole = np.full(len(ids) + slab.n, end, self.kind)
            whole[np.arange(len(ids)) + np.repeat(np.arange(slab.n), each)] = ids
            ids, each = whole, each + 1
        cut = np.concatenate([[0], np.cumsum(each)])
        if not self.spell:
            return ids, cut, None
        many = np.bincount(doc, found[3], slab.n).astype(np.int64) if len(doc) else np.zeros(slab.n, np.int64)
        return ids, cut, (gather(self.said, found[2], found[3]), np.concatenate([[0], np.cumsum(many)]))


def binary(data: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A binary column of the pieces of ``data``."""
    size = data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(np.ascontiguousarray(cut * size, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
