"""BPE encoding and decoding by a prefix-sharing trie.

The distinct new words of a batch, sorted, are a trie in depth-first order. Every node keeps one number, the last token of
its prefix's encoding; a prefix shared by many words is worked out once. A token ends a prefix's encoding if it stands
where the prefix ends, is its own encoding, and forms a stable pair with the last token of the prefix before it: no merge
across the border would come before the merges that build the two. Exactly one token does, and following last tokens
backwards from a word's end gives its ids. A worker keeps words' ids, and what they decode to, in a table of bounded size.

The tokenizer is read from its JSON on each worker: BPE by merge rank, byte-level symbols, an end-of-word suffix; NFC and
lower case before; tokens of the file's ``added_tokens`` are cut out of the raw text first. Decoding joins the tokens'
strings by a space, as the library does when the file names no decoder.

Defined results: null and empty texts have no ids; the hash is that of no bytes; repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import textops as X
from . import wordids as W

NAME = "word_bpe_49k.json"
INF = 1 << 60
PAIRS = 250_000
#: Unicode white space
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CUT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
#: For texts without characters beyond U+024F, without superscripts and fractions: the same, faster.
PLAIN = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\w\s]|_)+")
RARE = re.compile("[^\\x00-\\x1b\\x20-\\u024f]|[\\x85\\xa0\\xb2\\xb3\\xb9\\xbc-\\xbe]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(extra))
        extra += b not in own
    return out


class Codec:
    def __init__(self, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.top = max(self.text) + 1
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (self.vocab[a], self.vocab[b]), self.vocab[a + b]
            self.rank[pair] = r
            if whole not in self.born:
                self.halves[whole], self.born[whole] = pair, r
        self.width = {i: len(t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix) else t) for t, i in self.vocab.items()}
        # the widths of tokens of three symbols and more by their last three, the widest first, inside words and at their ends
        widths: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
        for t, i in self.vocab.items():
            ends = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            if self.width[i] >= 3:
                body = t[: self.width[i]]
                widths[ends].setdefault(body[-3:], set()).add(self.width[i])
        self.sizes = tuple({k: (*sorted(v, reverse=True), 2, 1) for k, v in w.items()} for w in widths)
        self.symbols = dict(enumerate(byte_symbols()))
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.table = W.WordTable(self.learn, self.cut, list(self.added), self.spell)

    def border(self, left: int, right: int) -> tuple[bool, int]:
        """(no merge crosses the border before both tokens are built, the rank of the merge of the two)."""
        a, b = [left], [right]
        while a[-1] in self.halves:
            a.append(self.halves[a[-1]][1])
        while b[-1] in self.halves:
            b.append(self.halves[b[-1]][0])
        i, j = len(a) - 1, len(b) - 1
        while True:
            across = self.rank.get((a[i], b[j]), INF)
            up_a = self.born[a[i - 1]] if i else INF
            up_b = self.born[b[j - 1]] if j else INF
            if not i and not j:
                return True, across
            if across < up_a and across <= up_b:
                return False, across
            if up_a <= up_b:
                i -= 1
            else:
                j -= 1

    def stable(self, left: int, right: int) -> bool:
        key = (left, right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            quiet, across = self.border(left, right)
            ok = self.pairs[key] = quiet and across == INF
        return ok

    def reached(self, token: int) -> bool:
        """The token's own text encodes to it."""
        ok = self.whole.get(token)
        if ok is None:
            if token in self.halves:
                a, b = self.halves[token]
                ok = self.reached(a) and self.reached(b) and self.border(a, b)[0]
            else:
                ok = True
            self.whole[token] = ok
        return ok

    def ending(self, word: str, n: int, last: list[int], tail: str) -> int:
        """The last token of the encoding of word[:n] + tail, given those of all shorter prefixes."""
        vocab, whole, pairs = self.vocab, self.whole, self.pairs
        for size in self.sizes[tail != ""].get(word[n - 3 : n], (2, 1)) if n > 2 else (2, 1):
            if size > n:
                continue
            t = vocab.get(word[n - size : n] + tail)
            if t is None or not (whole.get(t) or self.reached(t)):
                continue
            if size == n:
                return t
            before = last[n - size]
            ok = pairs.get((before, t))
            if ok or (ok is None and self.stable(before, t)):
                return t
        raise ValueError("a symbol is not in the vocabulary")

    def learn(self, words: list[str]) -> list[list[int]]:
        """The ids of words: a depth-first walk of their trie."""
        keyed = sorted((w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols), i) for i, w in enumerate(words) if w not in self.added)
        ids: list[list[int]] = [[self.added.get(w, -1)] for w in words]
        last: list[int] = [-1]
        before = ""
        for key, place in keyed:
            n = len(key)
            same = 0
            top = min(len(last) - 1, n - 1)
            while same < top and before[same] == key[same]:
                same += 1
            del last[same + 1 :]
            for i in range(same + 1, n):
                last.append(self.ending(key, i, last, ""))
            t, at, out = self.ending(key, n, last, self.suffix), n, []
            while True:
                out.append(t)
                at -= self.width[t]
                if at <= 0:
                    break
                t = last[at]
            out.reverse()
            ids[place] = out
            before = key
        return ids

    def spell(self, ids: list[int]) -> bytes:
        """What ids decode to, each token's string followed by a blank."""
        return "".join([self.text[i] + " " for i in ids]).encode()

    def cut(self, text: str) -> list[str]:
        """Words in order, and added tokens; none of them is a word, for a word doesn't mix letters and signs."""
        if self.special is not None and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += self.split(text[at : m.start()])
                out.append(m[0])
                at = m.end()
            return out + self.split(text[at:])
        return self.split(text)

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # capital sigma has one lower form, wherever it stands
        text = text.lower()
        return (CUT if RARE.search(text) else PLAIN).findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out = []
        for slab in X.slabs(pa.array(texts, pa.string())):
            ids, cut, _ = self.table.encode(slab)
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join([self.text[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    key = path or default_path()
    if key not in _codecs:
        _codecs[key] = Codec(key)
    return _codecs[key]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; one narrow pass, no shuffle."""

    def run(batches):
        table = codec(path).table
        for b in batches:
            n, ids, shown = [np.zeros(0, np.int64)], [], []
            for slab in X.slabs(b.column("text")):
                flat, cut, (said, spoken) = table.encode(slab)
                raw, words = memoryview(flat.tobytes()), memoryview(said.tobytes())
                n.append(np.diff(cut))
                ids += [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
                # the last token's blank isn't part of the text
                shown += [hashlib.sha256(words[i : max(i, j - 1)]).hexdigest() for i, j in zip(spoken[:-1].tolist(), spoken[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(n)), pa.array(ids, pa.string()), pa.array(shown, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        X.release()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(C.table(spark, sf_dir, "documents"))
