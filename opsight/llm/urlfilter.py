"""URL filters: a rule list as sorted digest arrays that tasks memory-map and search.

A rule is a host and the beginning of a path. It fits the urls of its host and of all its
subdomains whose path begins with the rule's; of the rules that fit a url the longest one
(code points of host and path together, then of the host) decides, and a url without a rule
gets ``default``: a listed url is judged by the list, any other by that parameter.

``build`` writes the list by Spark tasks. Its rules are dealt to shards by the upper bits of
their 64-bit xxhash keys; a shard is a file of sorted keys, the offsets of the full rules and
the rules themselves. ``judge`` maps the shards from the shared folder, so a task holds only
the pages of the file that its searches touch, however long the list is. A url is looked up
once for each shape (labels of the host, bytes of the path) that occurs among the rules: the
keys of a whole batch go through one binary search, and a key that is found counts only when
the stored rule equals the text; equal keys of different rules lie next to each other and
are tried in turn. Judging needs no shuffle, so repeated urls and hosts do no harm.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path:
from there up to ``?``, ``#`` or the end. A null url, or one without ``://``, has both empty
and no rule. Rules: hosts are lower-cased too, a null path is empty, rules without host or
with another verdict than ``allow`` and ``block`` are left out, repeated ones count once, and
where both verdicts are given for one rule ``block`` holds. An empty list leaves every url to
``default``; an empty table gives an empty result. Rows that repeat an id are judged each on
its own, a null id stays null, urls of any length are looked at whole, and extra columns
are ignored. Ties cannot occur: two different rules that fit one url and have equal lengths
of both parts are the same rule.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from opsight.llm.common import arrow_schema, sliced, written
from opsight.session import scratch_path

#: The seed of the engine's own ``xxhash64``, which computes the keys of the list.
SEED = 42
ALLOW, BLOCK = "allow", "block"
#: Rules a shard holds on average.
SHARD_RULES = 4 << 20
HEADER = "<QQ"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The two parts of a url that rules look at."""
    text = F.coalesce(url, F.lit(""))
    start = F.locate("://", text)
    rest = F.when(start > 0, F.substr(text, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


@dataclass(frozen=True)
class Index:
    """Where the shards are, and which shapes the rules have.

    ``shapes`` are the distinct pairs (labels of the host, bytes of the path); their number
    depends on the lengths of the rules, not on how many there are.
    """

    paths: dict[int, str]
    shard_bits: int
    key_bits: int
    shapes: tuple[tuple[int, int], ...]


def _rules(rules: DataFrame) -> DataFrame:
    host = F.translate(F.col("host"), _UPPER, _UPPER.lower())
    known = rules.filter(F.col("host").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK))
    path = F.coalesce(F.col("path"), F.lit(""))
    return (
        known.select(host.alias("host"), path.alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )


def _shard_bytes(keys: np.ndarray, rules: list[tuple[bytes, bytes]], blocks: list[bool]) -> bytes:
    """Keys, offsets, host lengths, ranks, verdicts and texts, one array after the other."""
    texts = [host + path for host, path in rules]
    ends = np.cumsum([0, *map(len, texts)], dtype=np.uint64)
    hosts = np.array([len(host) for host, _ in rules], np.uint32)
    ranks = np.array([(len((h + p).decode()) << 32) + len(h.decode()) for h, p in rules], np.uint64)
    arrays = (keys.astype(np.uint64), ends, ranks, hosts, np.array(blocks, np.uint8))
    body = b"".join(a.tobytes() for a in arrays)
    return struct.pack(HEADER, len(rules), len(b"".join(texts))) + body + b"".join(texts)


class Shard:
    """One mapped file of the list."""

    def __init__(self, data: pa.Buffer):
        count, _ = struct.unpack(HEADER, data[: struct.calcsize(HEADER)].to_pybytes())
        at = struct.calcsize(HEADER)

        def array(kind, size):
            nonlocal at
            found = np.frombuffer(data, kind, size, at)
            at += found.nbytes
            return found

        self.keys = array(np.uint64, count)
        self.ends = array(np.uint64, count + 1)
        self.ranks = array(np.uint64, count)
        self.hosts = array(np.uint32, count)
        self.blocks = array(np.uint8, count)
        self.texts = memoryview(data)[at:]

    def text(self, place: int) -> bytes:
        return bytes(self.texts[int(self.ends[place]) : int(self.ends[place + 1])])

    def rule(self, place: int) -> tuple[str, str]:
        return self.text(place).decode(), BLOCK if self.blocks[place] else ALLOW

    def find(self, keys: np.ndarray, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """The place of each (host, path), or -1; ``keys`` are their hashes."""
        places = np.searchsorted(self.keys, keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            inside = places[open_] < len(self.keys)
            open_ = open_[inside]
            open_ = open_[self.keys[places[open_]] == keys[open_]]
            same = np.fromiter(
                (
                    self.hosts[places[i]] == len(hosts[i]) and self.text(places[i]) == hosts[i] + paths[i]
                    for i in open_
                ),
                bool,
                len(open_),
            )
            out[open_[same]] = places[open_[same]]
            open_ = open_[~same]
            places[open_] += 1
        return out


def _mapped(path: str) -> Shard:
    store, name = arrow_fs.FileSystem.from_uri(path)
    if isinstance(store, arrow_fs.LocalFileSystem):
        return Shard(pa.memory_map(name).read_buffer())
    # A store that can't be mapped: its bytes are read instead.
    with store.open_input_file(name) as source:
        return Shard(source.read_buffer())


def build(rules: DataFrame, key_bits: int = 64, shard_rules: int = SHARD_RULES) -> Index:
    """Write the list (host, path, verdict) to the shared folder.

    Fewer ``key_bits`` make keys collide; results do not depend on it.
    """
    spark = rules.sparkSession
    folder = scratch_path(spark, "url-rules")
    whole = _rules(rules).withColumn("key", F.xxhash64(F.concat("host", "path")))
    if key_bits < 64:
        whole = whole.withColumn("key", F.col("key").bitwiseAND(F.lit((1 << key_bits) - 1)))
    whole = written(whole, "url-rules")
    count = whole.count()
    bits = min(max(0, -(-count // shard_rules) - 1).bit_length(), 16, key_bits - 1)
    shard = F.shiftrightunsigned("key", key_bits - bits) if bits else F.lit(0)
    index = "shard int, path string"
    schema = arrow_schema(index)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {"shard": [], "key": [], "host": [], "path": [], "verdict": []}
        for batch in batches:
            for name, held in columns.items():
                held += batch.column(name).to_pylist()
        numbers = np.array(columns["shard"], np.int64)
        keys = np.array(columns["key"], np.int64).view(np.uint64)
        made = []
        for number in np.unique(numbers):
            own = np.flatnonzero(numbers == number)
            own = own[np.argsort(keys[own], kind="stable")]
            pairs = [(columns["host"][i].encode(), columns["path"][i].encode()) for i in own]
            data = _shard_bytes(keys[own], pairs, [columns["verdict"][i] == BLOCK for i in own])
            store, root = arrow_fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            # A task that runs again writes the same rules under a name of its own.
            name = f"shard-{number:05d}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(f"{root}/{name}.tmp", compression=None) as out:
                out.write(data)
            store.move(f"{root}/{name}.tmp", f"{root}/{name}")
            made.append({"shard": int(number), "path": f"{folder}/{name}"})
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    sharded = whole.withColumn("shard", shard.cast("int")).repartition(1 << bits, "shard").mapInArrow(write, index)
    paths = {row["shard"]: row["path"] for row in written(sharded, "url-shards").collect()}
    labels = F.size(F.split("host", r"\.", -1))
    shapes = whole.select(labels.alias("labels"), F.octet_length("path").alias("size")).distinct().collect()
    return Index(paths, bits, key_bits, tuple(sorted(map(tuple, shapes))))


def _suffixes(hosts: list[bytes], labels: int) -> tuple[np.ndarray, list[bytes]]:
    """Rows whose host has that many labels at least, and its last ones."""
    rows, out = [], []
    for row, host in enumerate(hosts):
        parts = host.rsplit(b".", labels)
        if len(parts) > labels:
            rows.append(row)
            out.append(host[len(parts[0]) + 1 :])
        elif len(parts) == labels:
            rows.append(row)
            out.append(host)
    return np.array(rows, np.int64), out


def _judge_batch(
    hosts: list[bytes], paths: list[bytes], has_host: np.ndarray, index: Index, shards: dict[int, Shard]
) -> tuple[list[str | None], list[str | None]]:
    """The rule and verdict of each row; both None where no rule fits. ``shards`` are mapped."""
    best = np.zeros(len(hosts), np.uint64)
    rules: list[str | None] = [None] * len(hosts)
    verdicts: list[str | None] = [None] * len(hosts)
    mask = np.uint64((1 << index.key_bits) - 1)
    suffixes: dict[int, tuple[np.ndarray, list[bytes]]] = {}
    lengths = np.array([len(p) for p in paths], np.int64)
    for labels, size in index.shapes:
        if labels not in suffixes:
            suffixes[labels] = _suffixes(hosts, labels)
        rows, ends = suffixes[labels]
        fits = np.flatnonzero((lengths[rows] >= size) & has_host[rows]) if len(rows) else rows
        if not len(fits):
            continue
        rows, ends = rows[fits], [ends[i] for i in fits]
        starts = [paths[i][:size] for i in rows]
        keys = np.fromiter(
            (xxhash.xxh64_intdigest(e + s, SEED) for e, s in zip(ends, starts, strict=True)), np.uint64, len(rows)
        )
        keys &= mask
        numbers = (
            (keys >> np.uint64(index.key_bits - index.shard_bits)).astype(np.int64)
            if index.shard_bits
            else np.zeros(len(keys), np.int64)
        )
        for number in np.unique(numbers):
            if (path := index.paths.get(int(number))) is None:
                continue
            if number not in shards:
                shards[number] = _mapped(path)
            shard = shards[number]
            own = np.flatnonzero(numbers == number)
            found = shard.find(keys[own], [ends[i] for i in own], [starts[i] for i in own])
            for i, place in zip(own[found >= 0], found[found >= 0], strict=True):
                row = rows[i]
                if verdicts[row] is None or shard.ranks[place] > best[row]:
                    best[row] = shard.ranks[place]
                    rules[row], verdicts[row] = shard.rule(place)
    return rules, verdicts


def judge(
    pages: DataFrame, index: Index, default: str = ALLOW, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict) of each row of ``pages``; ``rule`` is host and path."""
    host, path = host_and_path(F.col(url_column))
    narrow = pages.select(F.col(id_column), F.col(url_column).alias("url")).select(
        id_column, host.alias("host"), path.alias("path"), (F.instr(F.col("url"), "://") > 0).alias("whole")
    )
    texts = [StructField(name, StringType()) for name in ("host", "path", "rule", "verdict")]
    schema = StructType([pages.schema[id_column], *texts])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, Shard] = {}
        for batch in batches:
            for part in sliced(batch):
                _, hosts, paths, whole = part.columns
                has_host = whole.fill_null(False).to_numpy(zero_copy_only=False)
                raw = [c.cast(pa.binary()).to_pylist() for c in (hosts, paths)]
                rules, verdicts = _judge_batch(*raw, has_host, index, shards)
                verdicts = [default if v is None else v for v in verdicts]
                columns = [part.column(0), hosts, paths, rules, verdicts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)],
                    schema=arrow,
                )

    return narrow.mapInArrow(run, schema)
