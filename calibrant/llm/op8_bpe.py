"""Operator 8: byte-level BPE encoding and decoding with batched numpy merge rounds.

A task loads the vocabulary file once.  Texts are cut at the special tokens and by the pre-tokeniser's pattern;
words that this worker has not met yet are encoded together: the symbols of all of them lie in one flat array, each
round looks up all neighbouring pairs by binary search in the sorted pair keys, takes each word's pair of least rank and
merges its occurrences from the left, and words without a mergeable pair leave the array.  A word of over ``LONG`` bytes is an array of its own:
its pairs are kept by rank, a round takes the least rank, merges its occurrences and looks up only the pairs that this makes.

Edge cases: null text is empty (no ids); special tokens in a text get their own ids, as the library does; any text of
valid UTF-8 decodes to itself; null and repeated ids are ordinary rows; an empty table gives an empty one; columns other than
``doc_id``, ``text`` and those carried are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

#: The byte-level pre-tokeniser's published pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Of words whose ids are kept, the bytes in a worker: an entry of the cache costs about ``ENTRY_BYTES`` besides the word and its ids.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 200
#: Bytes of a word from which on it is merged by itself.
LONG = 256
NONE = np.int64(1 << 60)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level vocabularies are supported")
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: np.uint32(v).tobytes() for k, v in special.items()}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        to = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.to = key[order], order.astype(np.int64), to[order]
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NONE``: no merge) and its place in the sorted keys."""
        key = left * self.size + right
        pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[pos] == key, self.rank[pos], NONE), pos

    def merge_long(self, raw: bytes) -> bytes:
        """Ids of one word; every occurrence is looked at a few times, not once a round."""
        sym = self.of_byte[np.frombuffer(raw, np.uint8)]
        n = len(sym)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank, to = np.full(n, NONE), np.zeros(n, np.int64)  # of the pair that begins here
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> None:
            at = at[alive[at]]
            rank[at] = NONE
            at = at[after[at] < n]
            r, pos = self.ranks(sym[at], sym[after[at]])
            rank[at], to[at] = r, self.to[pos]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else []
            for i, j in zip(cut, [*cut[1:], len(r)], strict=True):
                if (value := int(r[i])) != NONE:
                    if value not in waiting:
                        heapq.heappush(heap, value)
                    waiting.setdefault(value, []).append(at[i:j])

        look(np.arange(n))
        while heap:
            least = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(least)))
            at = at[alive[at] & (rank[at] == least)]
            # of occurrences that overlap every second one, from the left
            start = np.append(True, after[at[:-1]] != at[1:])
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(start, index, 0))) % 2 == 0] if len(at) else at
            if not len(at):
                continue
            gone = after[at]
            alive[gone] = False
            sym[at] = to[at]
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            touched = np.append(at, before[at])
            look(np.unique(touched[touched >= 0]))
        return sym[alive].astype("<u4").tobytes()

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        if any(len(w) > LONG for w in raw):
            short = iter(self.merge([w for w, b in zip(words, raw, strict=True) if len(b) <= LONG]))
            return [self.merge_long(b) if len(b) > LONG else next(short) for b in raw]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        out: list[bytes] = [b""] * len(raw)
        while len(sym):
            pair = np.full(len(sym), NONE)
            at = np.zeros(len(sym), np.int64)
            rank, at[:-1] = self.ranks(sym[:-1], sym[1:])
            same = word[:-1] == word[1:]
            pair[:-1][same] = rank[same]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(pair, first)
            size = np.diff(np.append(first, len(sym)))
            ended = least == NONE
            if ended.any():
                ids = sym.astype("<u4")
                for i in np.flatnonzero(ended).tolist():
                    out[word[first[i]]] = ids[first[i] : first[i] + size[i]].tobytes()
            hit = pair == np.repeat(least, size)
            hit &= ~np.repeat(ended, size)
            # overlapping occurrences (a a a): every second one of a stretch, from its left end
            start = hit.copy()
            start[1:] &= ~hit[:-1]
            index = np.arange(len(sym))
            origin = np.maximum.accumulate(np.where(start, index, 0))
            hit &= (index - origin) % 2 == 0
            sym = np.where(hit, self.to[at], sym)
            keep = ~np.repeat(ended, size)
            keep[1:] &= ~hit[:-1]
            sym, word = sym[keep], word[keep]
        return out

    def forget(self) -> None:
        """Empty the cache of words."""
        self.words, self.held = {}, 0

    def encode_all(self, texts: list[str]) -> list[bytes]:
        pieces: list[list[str | bytes]] = []
        new: dict[str, None] = {}
        for text in texts:
            parts = self.cut(text) if self.cut else [text]
            found: list = []
            for k, part in enumerate(parts):
                if k % 2:
                    found.append(self.special[part])
                elif part:
                    found += self.find(part)
            pieces.append(found)
            new.update(dict.fromkeys(w for w in set(found) if type(w) is str and w not in self.words))
        if self.held > CACHE_BYTES:
            self.forget()
            new = dict.fromkeys(w for found in pieces for w in found if type(w) is str)
        todo = list(new)
        for i in range(0, len(todo), 1 << 17):
            part = todo[i : i + (1 << 17)]
            ids = self.merge(part)
            self.words.update(zip(part, ids, strict=True))
            self.held += sum(map(len, part)) + sum(map(len, ids)) + ENTRY_BYTES * len(part)
        get = self.words.__getitem__
        return [b"".join(map(get, found)) if len(p) == 1 else b"".join(w if type(w) is bytes else get(w) for w in found) for found, p in zip(pieces, ([0] if not any(t in x for t in self.special) else [0, 1] for x in texts), strict=True)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(file: str) -> Bpe:
    return Bpe(file)


def encode_decode(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        try:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    names = part.schema.names
                    texts = [t or "" for t in part.column(names.index("text")).to_pylist()]
                    ids = bpe.encode_all(texts)
                    rest = [i for i, k in enumerate(names) if k != "text"]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i) for i in rest), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                        names=[*(names[i] for i in rest), "n_tokens", "ids", "decoded"],
                    )
        finally:
            bpe.forget()

    return run


def bpe_round_trip(docs: DataFrame, file: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``carry``, ``n_tokens, ids`` (binary, unsigned 32-bit little-endian) ``, decoded`` of every row."""
    base = docs.select("doc_id", *carry, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text")
    return base.mapInArrow(tidy(encode_decode(file)), f"{types}, n_tokens long, ids binary, decoded string")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def by_library(rows: list[tuple], file: str) -> list[tuple]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out
