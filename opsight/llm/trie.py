"""The prefix trie of rebuilt conversations, from fingerprints that compose.

A conversation may be rebuilt: its first turns are taken from a base conversation, the rest
from itself. The texts of rebuilt conversations are never put together. A sequence of turns
has the fingerprint ``F(t1..tn) = (sum of x(t_j) * B**j mod P, n)`` in four lanes of 31 bits,
with ``x`` from a seeded hash of role and text. Fingerprints form a monoid,
``F(uv) = F(u) + B**|u| F(v)``, and B can be inverted, so that every prefix of a rebuilt
conversation follows from running sums over the stored turns alone: those of the base's head
up to there, then ``F(head) + B**(m-h) (S(h+k) - S(h))`` for the own turns behind it.

Rows of prefixes are numbers: conversation, depth, fingerprint and a reference to the stored
turn that ends the prefix. Prefixes of one depth and fingerprint are a group, that is a node.
A group is verified, not believed: its prefixes must come from one parent group and refer to
turns with one symbol, and the stored texts of a symbol must all be equal; by induction equal
fingerprints are then equal sequences. If a check fails the trie is made again with other
seeds, so results never depend on hashes.

Running sums go over range-partitioned, sorted turns in one pass; the state at the end of each
partition (one row) is composed on the driver and added by a join, so a conversation with a
third of all turns is spread over many tasks. Sums over subtrees need no walk through the
levels: a node belongs to the path of its smallest member, the path of a conversation is a
run of depths, and the sum over a subtree is the sum of its members' paths less what lies
above the node on the path of its own member. Ids that end at a node are joined into text
in blocks of 65 536 values and hashed in order as a stream.

Turns are ordered by ``turn``, nulls first; ties by role and then by SHA-256 of the text, so
that repeated rows lie next to each other and stay. Null roles and texts are empty. Rows with a
null conversation id belong to no conversation and are left out. Very long texts are read
once, for their hashes and length, and once for the verification. An empty table has no root.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from opsight.llm.common import arrow_schema, written

#: Modulus of a lane, a prime.
PRIME = (1 << 31) - 1
LANES = 4
ID_BLOCK_BITS = 16


@dataclass(frozen=True)
class Seeds:
    """What a try depends on: the hash seed, the bases, and bits of a symbol that are used."""

    hash_seed: int
    bases: tuple[int, ...]
    symbol_bits: int = 64


def drawn(number: int) -> Seeds:
    values = np.random.default_rng(number).integers(1 << 20, PRIME - 1, LANES + 1)
    return Seeds(int(values[0]), tuple(int(v) for v in values[1:]))


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row each. ``rows``: one for each conversation and depth. ``convs``: how
    each conversation is rebuilt."""

    nodes: DataFrame
    rows: DataFrame
    convs: DataFrame


# Running sums over sorted rows ---------------------------------------------------------


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out = np.ones(len(exponents), np.int64)
    left, square = exponents.copy(), base
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = out[odd] * square % PRIME
        square = square * square % PRIME
        left >>= 1
    return out


def running(
    frame: DataFrame,
    key: str,
    order: list[Column],
    values: Callable[[pa.RecordBatch], list[np.ndarray]],
    bases: tuple[int, ...] | None,
    lanes: int,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``place`` (from 1) in the rows of a key, and running sums ``to_i`` and ``before_i``.

    With bases a sum is that of ``value * base**place`` modulo the prime, else a plain one.
    """
    columns = [f for f in frame.schema.fields if f.name not in drop]
    sums = [f"{kind}_{i}" for kind in ("to", "before") for i in range(lanes)]
    schema = StructType(
        [
            *(StructField(f.name, f.dataType) for f in columns),
            StructField("part", IntegerType()),
            StructField("edge", BooleanType()),
            StructField("place", LongType()),
            *(StructField(name, LongType()) for name in sums),
        ]
    )
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, place, state = None, 0, [0] * lanes
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            segment = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            goes_on = (segment == 0) & (last is not None and keys[0] == last)
            places = np.arange(len(keys)) - starts[segment] + 1
            places[goes_on] += place
            to, before = [], []
            for lane, value in enumerate(values(batch)):
                term = value if bases is None else value % PRIME * _powers(bases[lane], places) % PRIME
                total = np.cumsum(term)
                total -= (total[starts] - term[starts])[segment]
                total[goes_on] += state[lane]
                before.append(total - term if bases is None else (total - term) % PRIME)
                to.append(total if bases is None else total % PRIME)
            last, place, state = keys[-1], int(places[-1]), [int(x[-1]) for x in to]
            made = {"part": np.full(len(keys), part, np.int32), "edge": np.zeros(len(keys), bool), "place": places}
            made |= dict(zip(sums, [*to, *before], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in arrow], schema=arrow
            )
        if last is not None:
            row = {key: int(last), "part": part, "edge": True, "place": place}
            yield pa.RecordBatch.from_pylist([row | {f"to_{i}": s for i, s in enumerate(state)}], schema=arrow)

    ranged = frame.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    table = written(ranged.mapInArrow(run, schema), "running")
    carried = _carried(table, key, bases, lanes)
    if carried is None:
        return table.filter("not edge").drop("part", "edge")
    whole = table.filter("not edge").join(F.broadcast(carried), ["part", key], "left")

    def moved(name: str, lane: int) -> Column:
        start = F.coalesce(F.col(f"start_{lane}"), F.lit(0))
        if bases is None:
            return start + F.col(name)
        return F.pmod(start + F.coalesce(F.col(f"factor_{lane}"), F.lit(1)) * F.col(name), F.lit(PRIME))

    return whole.select(
        *(F.col(f.name) for f in columns),
        (F.col("place") + F.coalesce("first", F.lit(0))).alias("place"),
        *(moved(name, int(name.rpartition("_")[2])).alias(name) for name in sums),
    )


def _carried(table: DataFrame, key: str, bases: tuple[int, ...] | None, lanes: int) -> DataFrame | None:
    """What partitions add to the rows of the key that began before them: a row each."""
    ends = table.filter("edge").select("part", key, "place", *(f"to_{i}" for i in range(lanes)))
    found, state = [], None
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        factors = [1] * lanes
        if state is not None:
            if bases is not None:
                factors = [pow(b, state[1], PRIME) for b in bases]
            found.append((row["part"], state[0], state[1], *state[2], *factors))
        place, sums = row["place"], [row[f"to_{i}"] for i in range(lanes)]
        if state is not None and state[0] == row[key]:
            place += state[1]
            sums = [a + f * b for a, f, b in zip(state[2], factors, sums, strict=True)]
            sums = sums if bases is None else [s % PRIME for s in sums]
        state = (row[key], place, sums)
    if not found:
        return None
    more = [f"{kind}_{i} bigint" for kind in ("start", "factor") for i in range(lanes)]
    schema = ", ".join(["part int", f"{key} bigint", "first bigint", *more])
    return table.sparkSession.createDataFrame(found, schema)


# Prefixes and nodes --------------------------------------------------------------------


def _texts(conversations: DataFrame, seeds: Seeds) -> DataFrame:
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    for at, name in enumerate(("high", "low")):
        symbol = F.xxhash64(F.lit(seeds.hash_seed + at), "role", "text")
        if seeds.symbol_bits < 64:
            symbol = symbol.bitwiseAND(F.lit((1 << seeds.symbol_bits) - 1))
        rows = rows.withColumn(name, symbol)
    return rows


def _symbol_lanes(batch: pa.RecordBatch) -> list[np.ndarray]:
    symbols = [batch.column(name).to_numpy() for name in ("high", "low")]
    return [part for s in symbols for part in (s & PRIME, (s >> 32) & PRIME)]


def _lane(column: Column) -> Column:
    return F.pmod(column, F.lit(PRIME))


def _packed(lanes: list[Column]) -> tuple[Column, Column]:
    return tuple(a + F.shiftleft(b, 31) for a, b in (lanes[:2], lanes[2:]))


def _prefixes(turns: DataFrame, base: Column, head: Column, seeds: Seeds) -> tuple[DataFrame, DataFrame]:
    """How conversations are rebuilt, and their prefixes, from the running sums of turns."""
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    lengths = lengths.select("conv_id", "own", base.alias("base"), head.cast("bigint").alias("head"))
    lengths = written(lengths, "lengths")
    most = lengths.agg(F.max("head")).first()[0] or 0
    sums = [f"to_{i}" for i in range(LANES)]
    # Only these few turns of each conversation can be in a head.
    heads = turns.filter(F.col("place") <= most)
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    convs = lengths.join(bases, "base", "left").withColumn(
        "taken", F.least("head", F.coalesce("base_turns", F.lit(0)))
    )
    points = heads.select(F.col("conv_id").alias("at"), F.col("place").alias("at_place"), *sums)

    def sums_at(name: str) -> DataFrame:
        return points.select("at", "at_place", *(F.col(s).alias(f"{name}_{s}") for s in sums))

    convs = convs.join(
        sums_at("base"), (F.col("base") == F.col("at")) & (F.col("taken") == F.col("at_place")), "left"
    ).drop("at", "at_place")
    convs = convs.join(
        sums_at("own"), (F.col("conv_id") == F.col("at")) & (F.col("head") == F.col("at_place")), "left"
    ).drop("at", "at_place")
    shift = (F.col("head") - F.col("taken") + 1).cast("int")
    inverse = [[pow(b, -k, PRIME) for k in range(most + 1)] for b in seeds.bases]
    factors = [F.element_at(F.array(*map(F.lit, powers)), shift).cast("bigint") for powers in inverse]
    for lane, factor in enumerate(factors):
        start, own = (F.coalesce(f"{name}_to_{lane}", F.lit(0)) for name in ("base", "own"))
        convs = convs.withColumn(f"factor_{lane}", factor)
        convs = convs.withColumn(f"start_{lane}", _lane(start - F.col(f"factor_{lane}") * own))
    convs = written(
        convs.select(
            "conv_id",
            "base",
            "head",
            "taken",
            (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("turns"),
            *(f"{kind}_{lane}" for kind in ("start", "factor") for lane in range(LANES)),
        ),
        "convs",
    )

    def rows(depth: Column, sums_of: Callable[[str], list[Column]], ref_conv: str, frame: DataFrame) -> DataFrame:
        here, above = (_packed(sums_of(kind)) for kind in ("to", "before"))
        return frame.select(
            F.col("conv_id"),
            depth.alias("depth"),
            here[0].alias("f1"),
            here[1].alias("f2"),
            above[0].alias("p1"),
            above[1].alias("p2"),
            "high",
            "low",
            "bytes",
            F.col(ref_conv).alias("ref_conv"),
            F.col("place").alias("ref_place"),
            (depth == F.col("turns")).alias("ends"),
        )

    of_base = convs.join(heads.withColumnRenamed("conv_id", "of"), F.col("base") == F.col("of")).filter(
        F.col("place") <= F.col("taken")
    )
    of_own = turns.join(convs, "conv_id").filter(F.col("place") > F.col("head"))
    found = rows(
        F.col("place"), lambda kind: [F.col(f"{kind}_{i}") for i in range(LANES)], "base", of_base
    ).unionByName(
        rows(
            F.col("place") - F.col("head") + F.col("taken"),
            lambda kind: [
                _lane(F.col(f"start_{i}") + F.col(f"factor_{i}") * F.col(f"{kind}_{i}")) for i in range(LANES)
            ],
            "conv_id",
            of_own,
        )
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    roots = convs.select(
        "conv_id",
        *(zero.alias(name) for name in ("depth", "f1", "f2")),
        *(none.alias(name) for name in ("p1", "p2", "high", "low")),
        zero.alias("bytes"),
        *(none.alias(name) for name in ("ref_conv", "ref_place")),
        (F.col("turns") == 0).alias("ends"),
    )
    return convs, written(found.unionByName(roots), "prefixes")


NODE = ["depth", "f1", "f2"]


def _groups(rows: DataFrame) -> DataFrame:
    """Nodes, with what their prefixes must agree in."""
    agreed = ("p1", "p2", "high", "low", "bytes")
    return written(
        rows.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            *(F.min(name).alias(name) for name in agreed),
            *(F.max(name).alias(f"most_{name}") for name in agreed),
        ),
        "nodes",
    )


def _is_exact(nodes: DataFrame, texts: DataFrame) -> bool:
    """Whether groups are equal sequences: one parent, one symbol, one text for a symbol."""
    differs = [F.col(name) != F.col(f"most_{name}") for name in ("p1", "p2", "high", "low", "bytes")]
    if not nodes.filter(F.coalesce(F.greatest(*differs), F.lit(False))).isEmpty():
        return False
    contents = texts.select("high", "low", "role", "text").distinct()
    return contents.groupBy("high", "low").count().filter("count > 1").isEmpty()


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, joined by commas in numeric order."""
    blocks = rows.filter("ends").groupBy(*NODE, F.shiftright("conv_id", ID_BLOCK_BITS).alias("block"))
    texts = blocks.agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    schema = "depth bigint, f1 bigint, f2 bigint, ends_sha256 string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []

        def close():
            if node is not None:
                out.append((*node, digest.hexdigest()))

        def flushed():
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if own != node:
                    close()
                    node, digest = own, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield flushed()
                out.clear()
        close()
        if out:
            yield flushed()

    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(run, schema)


def build(conversations: DataFrame, base: Column, head: Column, first_seeds: Seeds | None = None) -> Trie:
    """The trie of all conversations; ``base`` and ``head`` are expressions of ``conv_id``."""
    number = 0
    while True:
        seeds = first_seeds if first_seeds and not number else drawn(number)
        texts = _texts(conversations, seeds)
        narrow = texts.select(
            "conv_id",
            "turn",
            "role",
            F.unhex(F.sha2("text", 256)).alias("digest"),
            "high",
            "low",
            F.octet_length("text").cast("bigint").alias("bytes"),
        )
        order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
        turns = running(
            narrow, "conv_id", order, _symbol_lanes, seeds.bases, LANES, drop=("turn", "role", "digest")
        )
        convs, rows = _prefixes(turns, base, head, seeds)
        nodes = _groups(rows)
        if _is_exact(nodes, texts):
            return Trie(_summed(nodes, rows), rows, convs)
        number += 1


def _weights(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [(batch.column("n_convs").to_numpy() - 1) * batch.column("bytes").to_numpy()]


def _summed(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Add parents, children and sums over subtrees to the nodes."""
    own = nodes.select(*NODE, "conv_id", "n_convs", "bytes", "p1", "p2")
    own = running(own, "conv_id", [F.col("depth")], _weights, None, 1)
    children = (
        nodes.filter("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
        .agg(F.count("*").alias("n_children"))
    )
    own = written(
        own.join(children, NODE, "left").select(
            *own.columns, F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children")
        ),
        "trie-nodes",
    )
    # The path of a conversation: the nodes whose smallest member it is.
    paths = own.groupBy(F.col("conv_id")).agg(
        F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("path_tokens"),
        F.count(F.when(F.col("n_children") == 0, 1)).alias("path_leaves"),
        F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).alias("alone_from"),
    )
    shared = rows.select("conv_id", *NODE).join(paths, "conv_id")
    shared = shared.filter(F.col("alone_from").isNull() | (F.col("depth") < F.col("alone_from")))
    sums = shared.groupBy(*NODE).agg(
        F.sum("path_tokens").alias("member_tokens"), F.sum("path_leaves").alias("member_leaves")
    )
    tops = own.filter("place = 1 and depth > 0").select("conv_id", (F.col("depth") - 1).alias("depth"), "p1", "p2")
    parents = own.select("depth", F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("top_parent"))
    parents = tops.join(parents, ["depth", "p1", "p2"]).select("conv_id", (F.col("depth") + 1).alias("depth"), "top_parent")
    alone = F.col("n_convs") == 1
    return (
        own.join(sums, NODE, "left")
        .join(_ends(rows), NODE, "left")
        .join(parents, ["conv_id", "depth"], "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") == 0, F.lit(None))
            .otherwise(F.coalesce("top_parent", "conv_id"))
            .cast("bigint")
            .alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.when(alone, F.lit(1)).otherwise(F.col("member_leaves")).cast("bigint").alias("n_leaves"),
            F.when(alone, F.lit(0)).otherwise(F.col("member_tokens") - F.col("before_0")).cast("bigint").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
            "f1",
            "f2",
        )
    )


def last_turns(trie: Trie, conversations: DataFrame) -> DataFrame:
    """Role and text of the turn that ends each node, through the stored references."""
    seeds = drawn(0)
    texts = _texts(conversations, seeds)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.sha2("text", 256)]
    placed = running(
        texts.withColumn("digest", F.sha2("text", 256)), "conv_id", order, lambda batch: [], None, 0, drop=("turn", "digest", "high", "low")
    )
    placed = placed.select(F.col("conv_id").alias("ref_conv"), F.col("place").alias("ref_place"), "role", "text")
    refs = trie.nodes.select("conv_id", "depth").join(
        trie.rows.select("conv_id", "depth", "ref_conv", "ref_place"), ["conv_id", "depth"]
    )
    return refs.join(placed, ["ref_conv", "ref_place"], "left").select("conv_id", "depth", "role", "text")
