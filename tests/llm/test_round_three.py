"""URL rules, the conversation trie and vector codes against brute force."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opsight.llm import codes, queries, trie, urlfilter

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_urlfilter", "op12_trie", "op13_codes"])
def test_query_equals_its_sql(spark, name):
    query, sql = queries.REGISTRY[name]
    database = duckdb.connect()
    for table in ("pages", "conversations", "embeddings"):
        database.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    found = query(spark, SF_DIR)
    result = database.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


# URL rules


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def _judged(url, rules):
    host, path = _parts(url)
    fits = [
        (len(h + p), len(h), h + p, v)
        for (h, p), v in rules.items()
        if url is not None and "://" in url and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


URLS = [
    None, "", "no url", "http://", "http:///x", "http://org", "http://org?x=/", "HTTP://A.ORG/", "https://example.org/es/1",
    "https://a.b.example.org/en/1x?y#z", "https://badexample.org/en/1", "http://x.com/fr/", "http://x.com/de", "http://x.com/de/",
    "http://x.com/DE/", "http://user@x.com:80/fr/", "http://é.com/fr/ü", "http://ÉX.com/de/\n?\n", "http://.org/", "http://a..org/",
    "http://first://x.org/", "http://x.com/fr/" + "long/" * 50_000, "http://" + "a." * 5_000 + "org/", "http://org./", "x://org/\x00",
]


@pytest.mark.parametrize(("key_bits", "shard_rules"), [(64, 1 << 20), (64, 2), (2, 3), (1, 1)])
def test_urls_are_judged_by_their_longest_rule(spark, key_bits, shard_rules):
    given = [*queries.URL_RULES, ("ORG", "/", "allow"), ("é.com", "/fr/ü", "block"), ("com", "/fr/", "block"), ("first:", None, "block"), ("x.com", "", "allow"), (None, "/", "block"), ("org", "/x", "maybe")]
    rules = {}
    for host, path, verdict in given:
        if host is not None and verdict in ("allow", "block"):
            key = (host.lower(), path or "")
            rules[key] = max(verdict, rules.get(key, ""))
    index = urlfilter.build(spark.createDataFrame(given, "host string, path string, verdict string"), key_bits, shard_rules)
    rows = [*enumerate(URLS), (None, "http://org/"), (3, "http://org/"), (3, "http://org/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    found = [tuple(r) for r in urlfilter.judge(pages, index).collect()]
    assert sorted(map(repr, found)) == sorted(repr((i, *_judged(u, rules))) for i, u in rows)
    assert urlfilter.judge(pages.limit(0), index).count() == 0


def test_an_empty_list_leaves_all_to_the_default(spark):
    index = urlfilter.build(spark.createDataFrame([], "host string, path string, verdict string"))
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string")
    assert [tuple(r) for r in urlfilter.judge(pages, index, default="block").collect()] == [(1, "a.org", "/x", None, "block")]


# Conversations


def _brute_trie(rows, base, head):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest())
            turns[conv].append((key, (role or "", text or "")))
    turns = {c: [t for _, t in sorted(own)] for c, own in turns.items()}
    whole = {c: tuple(turns.get(base(c), [])[: head(c)] + own[head(c) :]) for c, own in turns.items()}
    members = defaultdict(set)
    for conv, sequence in whole.items():
        for depth in range(len(sequence) + 1):
            members[sequence[:depth]].add(conv)
    out = {}
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        ends = sorted(c for c in convs if whole[c] == node)
        out[(min(convs), len(node))] = (
            min(members[node[:-1]]) if node else None,
            len(convs),
            len(kids),
            sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def _conversations():
    numbers = np.random.default_rng(3)
    rows = []
    for conv in range(40):
        kind = int(numbers.integers(0, 4))
        for turn in range(int(numbers.integers(1, 14))):
            rows.append((conv, turn, "user" if turn % 2 else "ä", f"text {min(turn, 3) * kind}" + "é" * (turn % 3)))
    rows += [(100, turn, "user", "same") for turn in range(300)] + [(105, turn, "user", "same") for turn in range(290)]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(3)]
    # Ties, nulls, repeated rows, a base that is absent, negative and huge ids.
    rows += [(300, None, None, None), (300, None, "", ""), (300, 1, "b", "x"), (300, 1, "a", "y"), (300, 1, "a", "y"), (300, 1, "a", "x")]
    rows += [(None, 1, "user", "nobody"), (402, 1, "user", "short"), (-7, 1, "user", "minus"), (-5, 1, "user", "base")]
    rows += [(1 << 62, 1, "user", "far"), (501, 1, "user", "long " * 100_000), (500, 1, "user", "long " * 100_000)]
    return rows


def _base(conv):
    return conv - int(np.fmod(conv, 5)) if abs(conv) < 1 << 50 else conv - conv % 5


def _head(conv):
    return zlib.crc32(str(conv).encode()) % 9


@pytest.mark.parametrize("seeds", [None, trie.Seeds(7, (11, 13, 17, 19), 3), trie.Seeds(7, (1, 1, 1, 1))])
def test_trie(spark, seeds):
    """Also with symbols or bases that collide, which must be noticed."""
    rows = _conversations()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    frame = frame.withColumn("depth", F.lit("clash")).repartition(5)
    conv = F.col("conv_id")
    found = trie.build(frame, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, seeds)
    columns = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = {(r.conv_id, r.depth): tuple(r[c] for c in columns) for r in found.nodes.collect()}
    assert nodes == _brute_trie(rows, _base, _head)
    if seeds is None:
        texts = {(r.conv_id, r.depth): (r.role, r.text) for r in trie.last_turns(found, frame).collect()}
        assert texts.keys() == nodes.keys() and texts[(200, 3)] == ("user", "copy 2")


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([(None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert trie.build(frame, F.col("conv_id"), F.lit(3)).nodes.count() == 0


def test_running_sums_go_over_partitions(spark):
    rows = [(1, i, i * 7) for i in range(500)] + [(2, 0, 5)] + [(9, i, 3) for i in range(300)]
    frame = spark.createDataFrame(rows, "key bigint, at bigint, value bigint").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for bases in (None, (12345,)):
            found = trie.running(frame, "key", [F.col("at")], lambda b: [b.column("value").to_numpy()], bases, 1)
            states = {}
            for row in found.orderBy("key", "at").collect():
                place, total = states.get(row.key, (0, 0))
                term = row.value if bases is None else row.value * pow(bases[0], place + 1, trie.PRIME)
                after = total + term if bases is None else (total + term) % trie.PRIME
                assert (row.place, row.before_0, row.to_0) == (place + 1, total, after)
                states[row.key] = (place + 1, after)
            assert states[1][0] == 500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Vector codes


def _brute_codes(rows, parts, entries, rounds, scale):
    usable = [(i, label, [int(np.floor(np.float64(x) * scale)) if abs(x) < 1e10 else int(x) * scale for x in v]) for i, label, v in rows]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = len(usable[0][2])
    sizes = [length // parts + (p < length % parts) for p in range(parts)]
    cuts = [(sum(sizes[:p]), sum(sizes[: p + 1])) for p in range(parts)]
    first = [v for _, _, v in usable[:entries] if len(v) == length]
    books = [[v[a:b] for v in first] for a, b in cuts]

    def assign(v):
        out = []
        for (a, b), book in zip(cuts, books, strict=True):
            out.append(min((sum((x - y) ** 2 for x, y in zip(v[a:b], entry, strict=True)), k) for k, entry in enumerate(book)))
        return out

    own = [r for r in usable if len(r[2]) == length]
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, v in own:
            for p, (_, k) in enumerate(assign(v)):
                groups[p, k].append(v[cuts[p][0] : cuts[p][1]])
        for (p, k), members in groups.items():
            books[p][k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    coded = []
    for i, label, v in usable:
        found = assign(v) if len(v) == length else None
        error = sum(d for d, _ in found) if found else None
        coded.append((i, label, bytes(k for _, k in found).hex() if found else None, error if error is None or error < 1 << 63 else None))
    sums = defaultdict(list)
    for _, label, _, error in coded:
        sums[label].append(error)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(*row, None if None in sums[row[1]] else sum(sums[row[1]])) for row in coded], digest


@pytest.mark.parametrize("case", ["plain", "huge", "ragged", "few", "short"])
def test_codes(spark, case):
    numbers = np.random.default_rng(11)
    length = {"ragged": 19, "short": 5}.get(case, 32)
    vectors = numbers.normal(size=(3 if case == "few" else 150, length))
    if case == "huge":
        vectors[5] *= 1e38
        vectors[70] *= -1e20
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    rows = [(i, int(i % 3) if i % 7 else None, v) for i, v in enumerate(vectors)]
    rows += [(1, 2, vectors[0]), (1, 2, vectors[0]), (None, None, vectors[1])]
    if case == "ragged":
        rows += [(900, 9, [1.0]), (901, 9, [])]
    odd = [(-3, 1, None), (-2, 1, [None] * length), (-1, 1, [float("nan")] * length), (950, 1, [float("-inf")] * length)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, label int, embedding array<float>")
    frame = frame.withColumn("code", F.lit("clash")).repartition(4)
    expected, digest = _brute_codes(rows, 16, 64, 2, 256)
    books = codes.train(frame)
    assert books.digest() == digest
    found = codes.with_label_error(codes.encode(frame, books))
    assert found.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    assert codes.train(frame.limit(0)) is None
