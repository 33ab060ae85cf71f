"""Packing of token pieces into sequences, shortest pack first over the length histogram.

Every document is tokenised, closed by id 0 and cut into full pieces of ``size`` ids and
one rest. The histogram of the rests (at most ``size`` numbers) is packed on the driver:
lengths are placed longest first, each into the open pattern with the shortest sum that
still has room, many equal packs at a time; patterns and their counts follow from the
histogram alone, however many documents there are. Pieces get a rank among those of their
length and find pattern, sequence and offset by it.

Null text is empty and has only the closing id. Rows that repeat an id are packed once each.
Equal lengths are interchangeable: pieces of one length go to their places in the order of a
hash of id and start, then of id, start and content; equal rows may swap places. Very long
texts are cut like all others, a task holds the ids of about a megabyte of text. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections import defaultdict
from collections.abc import Callable, Collection
from types import ModuleType
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsight.llm.bpe import PIECES
from opsight.llm.common import by_batch, text_groups, written

RUN = 500
PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
)


class Memo(dict[str, bytes]):
    """Ids of pieces; ``older`` has those known before, ``new`` empty holders for the others."""

    def __init__(self, older: dict[str, bytes]):
        super().__init__()
        # Not the memo itself: that would keep the one before it as well.
        self.older, self.new = dict(older), {}

    def __missing__(self, piece: str) -> bytes | bytearray:
        found = self.older.get(piece)
        if found is None:
            found = self.new[piece] = bytearray()
        self[piece] = found
        return found


class Tokens:
    """Token ids as little-endian 32-bit numbers, by the ``tokenizers`` library.

    Texts are cut where the tokenizer always cuts; equal cuts have equal ids, which a memo
    of bounded size keeps.
    """

    def __init__(self, model: str, remembered: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        # In this vocabulary each character of a token stands for one byte.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.sizes[number] = len(token)
        self.memo = Memo({})
        self.remembered = remembered

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; new pieces of all texts are learnt together.

        Every piece is looked up once: a new one gives a holder that is filled afterwards.
        A full memo becomes the older one, from which pieces come back as they are met, so
        frequent pieces are never learnt again.
        """
        if len(self.memo) > self.remembered:
            self.memo = Memo(self.memo)
        known = self.memo.__getitem__
        parts = [list(map(known, PIECES.findall(text or ""))) for text in texts]
        new, self.memo.new = self.memo.new, {}
        if new:
            self.learn(new)
            for piece, holder in new.items():
                holder += known(piece)
        return [b"".join(own) for own in parts]

    def learn(self, pieces: Collection[str]) -> None:
        """Ids of new pieces.

        Pieces that begin with a space and a word are encoded many at once, one behind the
        other, since the tokenizer cuts before such a space; the bytes of the tokens tell
        which ids belong to which piece. The others are encoded one by one.
        """
        joined = [p for p in pieces if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        alone = list(set(pieces).difference(joined))
        for piece, found in zip(alone, self._batch(alone), strict=True):
            self.memo[piece] = np.asarray(found.ids, "<u4").tobytes()
        runs = [joined[at : at + RUN] for at in range(0, len(joined), RUN)]
        texts = ["".join(run) for run in runs]
        for run, text, found in zip(runs, texts, self._batch(texts), strict=True):
            ids = np.asarray(found.ids, "<u4")
            sizes = map(len, run) if text.isascii() else (len(p.encode("utf-8", "surrogatepass")) for p in run)
            ends = np.cumsum(list(sizes))
            cuts = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="left") + 1)).tolist()
            places = map(slice, [0, *cuts], cuts)
            self.memo.update(zip(run, map(ids.tobytes().__getitem__, places), strict=True))

    def _batch(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)


def cut(ids: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(start, length, crc32, ids in all) of the pieces of a document with these ids and id 0."""
    ids += b"\0\0\0\0"
    parts = [ids[at : at + 4 * size] for at in range(0, len(ids), 4 * size)]
    return [(n * size, len(part) // 4, zlib.crc32(part), len(ids) // 4) for n, part in enumerate(parts)]


def _kept(key: str, make: Callable[[], Tokens]) -> Tokens:
    """One encoder for each worker process: the next task finds it with what it has learnt.

    Its memo is bounded; a new process starts with an empty one and gives the same ids.
    """
    held = sys.modules.setdefault("_packing_tokens", ModuleType("_packing_tokens")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 1024) -> DataFrame:
    """Tokenise all documents and cut them; only numbers leave the tasks."""
    with open(tokenizer, encoding="utf-8") as source:
        model = source.read()
    key = f"{len(model)}-{zlib.crc32(model.encode())}"

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        tokens = _kept(key, lambda: Tokens(model))
        texts = [text or "" for text in batch.column("text").to_pylist()]
        # Equal texts of a batch are encoded once.
        found = {}
        for group in text_groups(list(dict.fromkeys(texts))):
            for text, ids in zip(group, tokens.encode_many(group), strict=True):
                found[text] = cut(ids, size)
        docs_of = batch.column("doc_id").to_pylist()
        rows = [(doc, *piece) for doc, text in zip(docs_of, texts, strict=True) for piece in found[text]]
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        columns = zip(*rows, strict=True) if rows else ([] for _ in names)
        return dict(zip(names, map(list, columns), strict=True))

    return by_batch(docs.select("doc_id", "text"), run, PIECE_SCHEMA)


def shortest_pack_first(counts: dict[int, int], size: int) -> dict[tuple[int, ...], int]:
    """Patterns (lengths in the order they were placed) and how often each is used."""
    done: dict[tuple[int, ...], int] = defaultdict(int)
    open_packs: dict[tuple[int, ...], int] = defaultdict(int)
    heap: list[tuple[int, tuple[int, ...]]] = []

    def put(pattern: tuple[int, ...], total: int, packs: int) -> None:
        if total == size:
            done[pattern] += packs
            return
        if not open_packs[pattern]:
            heappush(heap, (total, pattern))
        open_packs[pattern] += packs

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if heap and heap[0][0] + length <= size:
                total, pattern = heap[0]
                packs = min(left, open_packs[pattern])
                open_packs[pattern] -= packs
                if not open_packs[pattern]:
                    heappop(heap)
                put((*pattern, length), total + length, packs)
                left -= packs
                continue
            # No open pack has room: as many new ones as pieces are left, but short
            # lengths share a pack from the start.
            room = size // length
            packs, rest = divmod(left, room)
            put((length,) * room, room * length, packs) if packs else None
            put((length,) * rest, rest * length, 1) if rest else None
            left = 0
    for pattern, packs in open_packs.items():
        if packs:
            done[pattern] += packs
    return dict(done)


def slots(patterns: dict[tuple[int, ...], int]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): which pieces go where.

    The pieces of one length are numbered from 0; those from the first to before the end
    rank go, one each, to the sequences from the first on, at the offset.
    """
    out, used, sequence = [], defaultdict(int), 0
    for pattern in sorted(patterns, reverse=True):
        packs, offset = patterns[pattern], 0
        for length in pattern:
            out.append((length, used[length], used[length] + packs, sequence, offset))
            used[length] += packs
            offset += length
        sequence += packs
    return out


def ranked(pieces: DataFrame, parts: int) -> DataFrame:
    """Number the pieces of each length from 0.

    Pieces are numbered inside ``parts`` groups of a length, chosen by the id, and each
    group starts where the ones before it end; a length that a third of all pieces have is
    so spread over ``parts`` tasks.
    """
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    sizes = pieces.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = pieces.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "salt"]).withColumn("rank", F.col("begin") + F.col("place"))


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, parts: int | None = None) -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = written(token_pieces(docs, tokenizer, size), "pieces")
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    places = spark.createDataFrame(
        slots(shortest_pack_first(counts, size)),
        "slot_length bigint, first_rank bigint, end_rank bigint, first_sequence bigint, offset bigint",
    )
    # The number of slots follows from the histogram, which has ``size`` lengths at most.
    found = ranked(pieces, parts).join(
        F.broadcast(places),
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("end_rank")),
    )
    return found.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
    )
