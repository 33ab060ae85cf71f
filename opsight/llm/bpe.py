"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a vocabulary entry as a whole is found by a minimal perfect hash (hash
and displace), many at a time. Every other pre-token is merged over a linked list of its
bytes, lowest rank first and leftmost among equals: those of up to ``SHORT`` bytes many at
once, one merge of each in a step on arrays, longer ones by a heap of ranked pairs in
``n log n`` steps. Results are remembered in a memo of bounded size.

The vocabulary is a parameter: a rank file (base64 token and rank in each line). Ids of
texts equal those of the usual rank-file encoder; no special tokens are made.

Null texts are empty and have no ids. An empty table gives an empty result. Extra columns
are carried along by ``encode`` and ``decode``; clashing ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from opsight.llm.common import by_batch, text_groups
from opsight.llm.words import mixed

#: Fixed value: the characters with the property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Cuts that the pre-token pattern always makes: between letters and a stop, before a space
#: that a word follows, and around white space. Equal pieces have equal ids wherever they
#: stand.
PIECES = re.compile(
    f" ?[{_LATIN}]++(?=[{WHITE}.,;:!?|]|$)| ?[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}][^{WHITE}])|[{WHITE}]+"
)
#: Bytes of a pre-token that is merged together with others; a place has to fit in 6 bits.
SHORT = 60
#: In place of a rank: the pair is no token. In place of an id: there is no part.
_NO_PAIR, _NO_PART = 1 << 30, 0xFFFF
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = np.random.default_rng(20240302).integers(0, 2**64, 256, dtype=np.uint64)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def byte_hashes(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes of non-empty byte strings."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    data = np.frombuffer(b"".join(keys), np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE, np.uint64))
    return mixed(np.add.reduceat(_CODES[data] * powers[place], starts) + lengths.astype(np.uint64))


class PerfectHash:
    """A minimal perfect hash: keys fall in small buckets, and each bucket has a number that
    moves its keys to free slots. Buckets of one key hold their slot itself."""

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // 3)
        hashes = byte_hashes(keys)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys share a hash")
        groups = (hashes >> np.uint64(33)) % np.uint64(self.buckets)
        order = np.argsort(groups, kind="stable")
        counts = np.bincount(groups.astype(np.int64), minlength=self.buckets)
        begins = np.cumsum(counts) - counts
        self.moves = np.zeros(self.buckets, np.int64)
        self.index = np.full(self.size, -1, np.int64)
        tries = np.arange(1, 257, dtype=np.uint64)
        for bucket in np.argsort(-counts, kind="stable"):
            members = order[begins[bucket] : begins[bucket] + counts[bucket]]
            if len(members) < 2:
                break
            first = np.uint64(0)
            while True:
                slots = self._slots(hashes[members][None, :], (tries + first)[:, None])
                free = (self.index[slots] < 0).all(1)
                if len(members) == 2:
                    free &= slots[:, 0] != slots[:, 1]
                else:
                    ordered = np.sort(slots, axis=1)
                    free &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if free.any():
                    at = int(np.argmax(free))
                    self.moves[bucket] = int(tries[at] + first)
                    self.index[slots[at]] = members
                    break
                first += np.uint64(len(tries))
        singles = np.flatnonzero(counts == 1)
        slots = np.flatnonzero(self.index < 0)
        self.moves[singles] = -1 - slots
        self.index[slots] = order[begins[singles]]

    def _slots(self, hashes: np.ndarray, moves: np.ndarray) -> np.ndarray:
        return (mixed(hashes + moves * _BASE) % np.uint64(self.size)).astype(np.int64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each key the only entry that can equal it."""
        hashes = byte_hashes(keys)
        moves = self.moves[((hashes >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(moves < 0, -1 - moves, self._slots(hashes, np.maximum(moves, 0).astype(np.uint64)))
        return self.index[slots]


class Pairs:
    """Ranks of pairs of ids, looked up many at a time in small sorted buckets."""

    def __init__(self, ranks: dict[int, int]):
        keys = np.fromiter(ranks.keys(), np.uint32, len(ranks))
        self.shift = np.uint32(32 - max(len(ranks), 1).bit_length() - 2)
        buckets = self._buckets(keys)
        order = np.argsort(buckets, kind="stable")
        # The entry behind the last one is met by empty buckets at the end.
        self.keys = np.append(keys[order], np.uint32(0))
        self.ranks = np.append(np.fromiter(ranks.values(), np.int32, len(ranks))[order], np.int32(_NO_PAIR))
        counts = np.bincount(buckets, minlength=(1 << (32 - int(self.shift))))
        self.begins = np.concatenate(([0], np.cumsum(counts)))

    def _buckets(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        buckets = self._buckets(keys)
        at, ends = self.begins[buckets], self.begins[buckets + 1]
        out = np.where((at < ends) & (self.keys[at] == keys), self.ranks[at], np.int32(_NO_PAIR))
        rest = np.flatnonzero((at + 1 < ends) & (out == _NO_PAIR))
        while len(rest):
            at[rest] += 1
            same = self.keys[at[rest]] == keys[rest]
            out[rest[same]] = self.ranks[at[rest[same]]]
            rest = rest[~same & (at[rest] + 1 < ends[rest])]
        return out


class Encoder:
    def __init__(self, tokens: list[bytes], perfect: PerfectHash, pattern: str, remembered: int = 400_000):
        self.tokens, self.perfect = tokens, perfect
        ranks = {token: rank for rank, token in enumerate(tokens)}
        self.byte_ids = [ranks[bytes((byte,))] for byte in range(256)]
        # Every way to put a token together from two others.
        self.pairs = {
            ranks[token[:at]] << 16 | ranks[token[at:]]: rank
            for rank, token in enumerate(tokens)
            for at in range(1, len(token))
            if token[:at] in ranks and token[at:] in ranks
        }
        self.rank_of = Pairs(self.pairs)
        self.pre_tokens = regex.compile(pattern).findall
        self.remembered = remembered
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge pairs of the linked bytes in the order of their ranks.

        A part is the id at its first byte; ``after`` and ``before`` link the parts. An
        entry of the heap is void once the rank noted for its place has changed.
        """
        rank_of, n = self.pairs.get, len(piece)
        ids = [self.byte_ids[byte] for byte in piece]
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        ranks = [rank_of(a << 16 | b) for a, b in zip(ids, ids[1:])]  # noqa: B905
        heap = [rank << 32 | i for i, rank in enumerate(ranks) if rank is not None]
        ranks.append(None)
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if ranks[i] != rank:
                continue
            j = after[i]
            end = after[i] = after[j]
            ids[i], ranks[j] = rank, None
            before[end] = i
            if end < n:
                found = ranks[i] = rank_of(rank << 16 | ids[end])
                if found is not None:
                    heappush(heap, found << 32 | i)
            else:
                ranks[i] = None
            left = before[i]
            if left >= 0:
                found = ranks[left] = rank_of(ids[left] << 16 | rank)
                if found is not None:
                    heappush(heap, found << 32 | left)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of non-empty pieces; short ones of about one length are merged together."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for at in np.flatnonzero(lengths > SHORT).tolist():
            out[at] = tuple(self.merge(pieces[at]))
        bands = np.where(lengths > SHORT, 0, -(-lengths // 4))
        for band in np.unique(bands[bands > 0]).tolist():
            places = np.flatnonzero(bands == band)
            for start in range(0, len(places), 1 << 16):
                chosen = places[start : start + (1 << 16)].tolist()
                for at, ids in zip(chosen, self._merge_short([pieces[at] for at in chosen]), strict=True):
                    out[at] = ids
        return out

    def _merge_short(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Merge the best pair of every piece again and again, all pieces at once.

        A column is a piece, a row a byte, with an empty row before and behind. ``best``
        holds rank and place of the pair that begins at a part, so the least of a column is
        the pair with the lowest rank, leftmost among equals.
        """
        n, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows = int(lengths.max()) + 2
        column = np.repeat(np.arange(n), lengths)
        row = np.arange(len(column)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        ids = np.full((rows, n), _NO_PART, np.int32)
        ids[row, column] = np.array(self.byte_ids, np.int32)[np.frombuffer(b"".join(pieces), np.uint8)]
        places = np.arange(rows, dtype=np.int32)[:, None]
        best = np.full((rows, n), _NO_PAIR, np.int32)
        ranks = self.rank_of(ids[1:-2].ravel(), ids[2:-1].ravel()).reshape(rows - 3, n)
        best[1:-2] = np.where(ranks == _NO_PAIR, _NO_PAIR, ranks << 6 | places[1:-2])
        before, after = np.repeat(places - 1, n, 1).ravel(), np.repeat(places + 1, n, 1).ravel()
        flat_ids, flat_best = ids.ravel(), best.ravel()

        def note(i: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> None:
            flat_best[at] = np.where(ranks == _NO_PAIR, _NO_PAIR, ranks << 6 | i)

        live = np.arange(n)
        while True:
            lowest = best.min(0) if len(live) > n // 2 else best[:, live].min(0)
            if len(live) > n // 2:
                lowest = lowest[live]
            live, lowest = live[lowest < _NO_PAIR], lowest[lowest < _NO_PAIR]
            if not len(live):
                break
            i, rank = lowest & 63, lowest >> 6
            at = i * n + live
            j = after[at] * n + live
            end = after[j]
            after[at] = end
            before[end * n + live] = i
            flat_ids[at], flat_ids[j], flat_best[j] = rank, _NO_PART, _NO_PAIR
            note(i, at, self.rank_of(rank, flat_ids[end * n + live]))
            left = before[at]
            note(left, left * n + live, self.rank_of(flat_ids[left * n + live], rank))
        by_piece = ids.T
        there = by_piece != _NO_PART
        found = by_piece[there].tolist()
        ends = np.cumsum(there.sum(1)).tolist()
        return [tuple(found[a:b]) for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into the memo; letters alone are one pre-token."""
        memo, tokens = self.memo, self.tokens
        words = [p for p in pieces if p.isalpha() or p[1:].isalpha() and p[0] == " "]
        mixtures = {p: self.pre_tokens(p) for p in pieces.difference(words)}
        words += set(chain.from_iterable(mixtures.values())).difference(memo, words)
        if words:
            data = [word.encode("utf-8", "surrogatepass") for word in words]
            whole = self.perfect.candidates(data).tolist()
            rest = [n for n, (key, at) in enumerate(zip(data, whole, strict=True)) if tokens[at] != key]
            memo.update(zip(words, zip(whole), strict=True))
            merged = self.merge_many([data[n] for n in rest])
            memo.update(zip([words[n] for n in rest], merged, strict=True))
        for piece, parts in mixtures.items():
            memo[piece] = tuple(chain.from_iterable(map(memo.__getitem__, parts)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; new pieces of about a megabyte of text are learnt together."""
        out = []
        for group in text_groups([text or "" for text in texts]):
            pieces = [PIECES.findall(text) for text in group]
            new = set().union(*pieces).difference(self.memo)
            if new:
                if len(self.memo) + len(new) > self.remembered:
                    self.memo.clear()
                    new = set().union(*pieces)
                self._learn(new)
            out += [list(chain.from_iterable(map(self.memo.__getitem__, own))) for own in pieces]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoder_maker(path: str, pattern: str):
    """A function that makes the encoder; it carries the vocabulary to the tasks."""
    tokens = read_ranks(path)
    perfect = PerfectHash(tokens)
    return lambda: Encoder(tokens, perfect, pattern)


def _with(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """Add ``ids``, the token ids of each whole text."""
    make = encoder_maker(path, pattern)
    kept = [c for c in docs.columns if c != "ids"]
    state: list[Encoder] = []

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        if not state:
            state.append(make())
        return {c: batch.column(c) for c in kept} | {"ids": state[0].encode(batch.column(text_column).to_pylist())}

    return by_batch(docs, run, _with(docs, "ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes that ``ids`` stand for."""
    tokens = read_ranks(path)
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        ids = batch.column("ids").to_pylist()
        return {c: batch.column(c) for c in kept} | {"decoded": [b"".join(tokens[i] for i in x or ()) for x in ids]}

    return by_batch(encoded, run, _with(encoded, "decoded", T.BinaryType()))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, hash both."""
    make = encoder_maker(path, pattern)
    state: list = []

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        if not state:
            encoder = make()
            state.extend((encoder, [str(i) for i in range(len(encoder.tokens))]))
        encoder, decimal = state
        encoded = encoder.encode(batch.column("text").to_pylist())
        sha = hashlib.sha256
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(ids) for ids in encoded],
            "ids_sha256": [sha(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest() for ids in encoded],
            "decoded_sha256": [sha(encoder.decode(ids)).hexdigest() for ids in encoded],
        }

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return by_batch(docs.select("doc_id", "text"), run, schema)
