"""Documents joined by the Jaccard similarity of their word shingles, as components.

Candidates come from token-combination prefixes. Tokens (hashes of shingles) have one global
order, rare ones first; a document's prefix is extended until it must share enough tokens with any partner:
a class of tokens that are frequent asks for ``k`` shared tokens at once and is indexed by
combinations of ``k`` prefix tokens, rare tokens are indexed alone. With ``n_c`` prefix
tokens of a part ``c`` that asks for ``k_c``, a partner that shares no signature misses
``sum(max(0, n_c - k_c + 1))`` of them, so the prefix ends where this exceeds the number of
tokens a partner may miss. The tokens of a frequent class are dealt by their hash into small
parts of their own, so combinations stay linear in the length of the prefix; as the number
of parts follows the set's size, a set is indexed for each number that a partner can have.

Before that, two exact filters use up most documents. Equal sets are one class, represented
by the smallest id. And a set that has more tokens of its own, shared with no other set,
than a partner may miss has no partner; some tokens of each set are counted first, those
of the whole set only for what is left. Only this rest is ordered and indexed.

Candidates are verified on whole sets. Large groups are not enumerated: every signature
first meets only its hub, the set with the fewest tokens before it. Pairs of the others are
formed where both are not connected yet, and where sizes, the tokens before the signature,
the known differences to the hub and the parity bits leave the similarity possible. The
tokens before are a valid bound at the first signature that a pair shares, so no pair is lost
by them. Parity bits tell for each of several cells whether it holds an odd number of a set's
tokens; every cell that differs proves a token that one set lacks, so they lose no pair
either. There are at least two cells for each token, whatever the size. No partner or
candidate is capped.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; fewer words than a shingle has form
one shingle, no word or null text is an empty set, linked with nothing. Rows with a null id
or a repeated id are kept: null ids have no component; rows that repeat an id are one node.
Very long texts are read whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import by_batch, discard, written
from opsight.llm.components import connected
from opsight.llm.words import as_bytes, ascii_lower, mixed, shingle_hashes, word_hashes

#: Documents with a token at most -> shared tokens asked for; beyond the last: one more.
CLASSES = ((64, 1), (2048, 2))
PART_TOKENS = 5
SMALLEST_THRESHOLD = 80
#: Words of 64 bits of a filter that goes to all rows.
MOST_WORDS = 1 << 18


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of the shingles, ascending as unsigned numbers."""
    return np.unique(shingle_hashes(word_hashes(ascii_lower(as_bytes(text))), words))


def may_miss(size: int, percent: int) -> int:
    """How many tokens of a set of ``size`` a partner of any size may lack."""
    return size - -(-percent * size // 100)


def filter_size(size: int, percent: int) -> int:
    """Tokens that the first filter looks at: half as many again as a partner may lack."""
    return min(size, 3 * (may_miss(size, percent) + 1) // 2 + 8)


def identity(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    with np.errstate(over="ignore"):
        first = mixed(tokens + np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
        second = mixed(tokens ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """For each of a power of two of cells whether an odd number of tokens falls into it.

    Halves that are xored give the bits for half as many cells.
    """
    longs = 1 << max(-(-len(tokens) // 32) - 1, 0).bit_length()
    spread = mixed(tokens ^ np.uint64(0x6A09E667F3BCC909)) & np.uint64(64 * longs - 1)
    odd = (np.bincount(spread.astype(np.int64), minlength=64 * longs) & 1).astype(np.uint64).reshape(longs, 64)
    return (odd << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, size, first, second) of each row."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"doc_id": batch.column("doc_id"), "size": [], "first": [], "second": []}
        for text in batch.column("text").to_pylist():
            tokens = shingle_set(text, words)
            first, second = identity(tokens)
            out["size"].append(len(tokens))
            out["first"].append(first)
            out["second"].append(second)
        return out

    schema = "doc_id bigint, size bigint, first bigint, second bigint"
    return by_batch(docs.select("doc_id", "text"), run, schema)


def prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(first, prefix): the tokens that the first filter looks at.

    They are worked out in the pass that counts them and are not stored: the texts are
    read once more instead.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = [shingle_set(text, words) for text in batch.column("text").to_pylist()]
        return {
            "first": [identity(tokens)[0] for tokens in found],
            "prefix": [tokens[: filter_size(len(tokens), percent)].view(np.int64) for tokens in found],
        }

    return by_batch(docs.filter("doc_id is not null").select("text"), run, "first bigint, prefix array<bigint>")


def own_tokens(rows: DataFrame, tokens: str) -> DataFrame:
    """(first, own): how many of a set's tokens no other set has; sets without one are left out.

    A token has one owner if smallest and largest set number agree; both are combined before
    the shuffle, so frequent tokens do no harm.
    """
    owners = rows.select("first", F.explode(tokens).alias("token")).groupBy("token")
    owners = owners.agg(F.min("first").alias("first"), F.max("first").alias("other"))
    return owners.filter(F.col("first") == F.col("other")).groupBy("first").agg(F.count("*").alias("own"))


def _missable(percent: int) -> Column:
    return F.col("size") - F.ceil(F.lit(percent) * F.col("size") / F.lit(100))


def _with_few_own(rows: DataFrame, owned: DataFrame, percent: int) -> DataFrame:
    joined = rows.join(owned, "first", "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))
    return joined.filter(F.col("own") <= _missable(percent))


def part_levels(size: int, percent: int) -> range:
    """The numbers of parts, as powers of two, that partners of a set may use."""

    def level(n: int) -> int:
        return max(((may_miss(n, percent) + 1) // PART_TOKENS).bit_length() - 1, 0)

    return range(level(-(-percent * size // 100)), level(100 * size // percent) + 1)


def _combined(group: np.ndarray, asked: int, level: int) -> np.ndarray:
    """Hashes of all combinations of ``asked`` tokens of one part."""
    if len(group) < asked:
        return np.zeros(0, np.uint64)
    chosen = np.array(list(combinations(range(len(group)), asked)))
    mark = np.full(len(chosen), np.uint64(asked << 8 | level), np.uint64)
    for at in range(asked):
        mark = mixed(mark * np.uint64(0x9E3779B97F4A7C15) + group[chosen[:, at]])
    return mark


def signatures(
    tokens: np.ndarray, sets_with: np.ndarray, size: int, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of ``size`` tokens, of which ``tokens`` are in other sets too.

    With each comes how many tokens stand before it. A partner that shares this signature
    and none before lacks them all: for a rare token those that precede it, for a
    combination those of the rare class, as classes follow each other in the order.

    ``sets_with`` counts the sets that have each of these. The order is by that count, then
    by the token; tokens that no other set has come first and are missed by any partner.
    """
    need = may_miss(size, percent) + 1
    own = size - len(tokens)
    if own >= need:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.lexsort((tokens, sets_with))
    tokens = tokens[order]
    asked = 1 + np.searchsorted([most for most, _ in CLASSES], sets_with[order], side="left")
    rare = own + int((asked == 1).sum())
    found, before = [], []
    for level in part_levels(size, percent):
        part = np.where(asked > 1, mixed(tokens) & np.uint64((1 << level) - 1), np.uint64(0))
        held: dict[tuple[int, int], int] = defaultdict(int)
        missed, end = own, 0
        for key in zip(asked.tolist(), part.tolist(), strict=True):
            held[key] += 1
            missed += held[key] >= key[0]
            end += 1
            if missed == need:
                break
        asked_here, part_here = asked[:end], part[:end]
        found.append(tokens[:end][asked_here == 1])
        before.append(own + np.flatnonzero(asked_here == 1))
        for k, p in held:
            if k > 1:
                found.append(_combined(tokens[:end][(asked_here == k) & (part_here == p)], k, level))
                before.append(np.full(len(found[-1]), rare))
    found, first = np.unique(np.concatenate(found), return_index=True)
    return found, np.concatenate(before)[first]


def _perhaps_in(rows: DataFrame, chosen: DataFrame, key: str, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows whose key is among the chosen ones, and a few others.

    Bits of hashed keys, 64 in a word for four keys or so, go to the rows: a join that
    follows needn't move the others. The table of bits is bounded; with very many keys more
    of the other rows pass.
    """
    words = min(most_words, 1 << (chosen.count() // 4).bit_length())
    place = F.xxhash64(key)

    def word() -> Column:
        return F.pmod(F.shiftrightunsigned(place, 6), F.lit(words)).cast("int")

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    bits = chosen.select(word().alias("bit_word"), bit.alias("bit")).groupBy("bit_word").agg(F.bit_or("bit").alias("bits"))
    met = rows.join(F.broadcast(bits), word() == F.col("bit_word"))
    return met.filter(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _whole_sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(rep, first, size, tokens) of the chosen sets, from the texts."""
    chosen = chosen.select(F.col("rep").alias("doc_id"), "first", "second")

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"rep": [], "first": [], "size": [], "tokens": []}
        for doc, text, first, second in zip(
            *(batch.column(c).to_pylist() for c in ("doc_id", "text", "first", "second")), strict=True
        ):
            tokens = shingle_set(text, words)
            if identity(tokens) == (first, second):
                for name, value in zip(out, (doc, first, len(tokens), tokens.view(np.int64)), strict=True):
                    out[name].append(value)
        return out

    texts = _perhaps_in(docs.select("doc_id", "text"), chosen, "doc_id").join(chosen, "doc_id")
    return by_batch(texts, run, "rep bigint, first bigint, size bigint, tokens array<bigint>")


def _signed(candidates: DataFrame, percent: int) -> DataFrame:
    """(sig, rep, size, before): the index of the candidates."""
    tokens = candidates.select("rep", "size", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1")
    shared = tokens.join(counts, "token").groupBy("rep", "size")
    shared = shared.agg(F.collect_list("token").alias("tokens"), F.collect_list("sets").alias("sets"))

    def sign(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"rep": batch.column("rep"), "size": batch.column("size"), "sigs": [], "before": []}
        for size, tokens, sets_with in zip(*(batch.column(c).to_pylist() for c in ("size", "tokens", "sets")), strict=True):
            sigs, before = signatures(np.array(tokens, np.int64).view(np.uint64), np.array(sets_with), size, percent)
            out["sigs"].append(sigs.view(np.int64))
            out["before"].append(before)
        return out

    signed = by_batch(shared, sign, "rep bigint, size bigint, sigs array<bigint>, before array<bigint>")
    return signed.select("rep", "size", F.inline(F.arrays_zip("sigs", "before"))).withColumnRenamed("sigs", "sig")


def _buckets(index: DataFrame) -> DataFrame:
    """The index without buckets of one set, with each bucket's hub.

    Buckets with the same members are one; a member keeps the smallest ``before`` of them.
    """
    buckets = index.groupBy("sig").agg(
        F.count("*").alias("members"),
        F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("mark"),
        F.sum(F.xxhash64(F.lit(7), "rep").cast("decimal(20,0)")).alias("second_mark"),
    )
    buckets = written(buckets.filter("members > 1"), "buckets")
    alike = ["members", "mark", "second_mark"]
    named = buckets.join(buckets.groupBy(*alike).agg(F.min("sig").alias("bucket")), alike).select("sig", "bucket")
    rows = index.join(named, "sig").groupBy("bucket", "rep", "size").agg(F.min("before").alias("before"))
    rows = written(rows.withColumnRenamed("bucket", "sig"), "bucket-rows")
    hubs = rows.groupBy("sig").agg(F.min(F.struct("before", "rep", "size")).alias("hub"))
    hubs = hubs.select(
        "sig", F.col("hub.rep").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.before").alias("hub_before")
    )
    return rows.join(hubs, "sig")


def _possible(size: Column, other_size: Column, missing: Column, percent: int) -> Column:
    """Whether sets of these sizes that differ in ``missing`` tokens or more may be similar."""
    return (
        (100 * F.least(size, other_size) >= percent * F.greatest(size, other_size))
        & ((100 + percent) * missing <= (100 - percent) * (size + other_size))
    )


def _bits(candidates: DataFrame) -> DataFrame:
    """(rep, bits): the parity bits of each candidate."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        tokens = batch.column("tokens").to_pylist()
        bits = [parity_bits(np.array(t, np.int64).view(np.uint64)).view(np.int64) for t in tokens]
        return {"rep": batch.column("rep"), "bits": bits}

    return by_batch(candidates.select("rep", "tokens"), run, "rep bigint, bits array<bigint>")


def _odd_cells(bits: Column, other: Column) -> Column:
    """In how many cells two sets differ; similar sets have as many cells or twice as many."""

    def halved(wide: Column) -> Column:
        half = (F.size(wide) / 2).cast("int")
        return F.zip_with(F.slice(wide, 1, half), F.slice(wide, half + 1, half), lambda a, b: a.bitwiseXOR(b))

    def differing(a: Column, b: Column) -> Column:
        cells = F.zip_with(a, b, lambda m, n: F.bit_count(m.bitwiseXOR(n)))
        return F.aggregate(cells, F.lit(0), lambda total, n: total + n)

    return (
        F.when(F.size(bits) == F.size(other), differing(bits, other))
        .when(F.size(bits) == 2 * F.size(other), differing(halved(bits), other))
        .when(2 * F.size(bits) == F.size(other), differing(bits, halved(other)))
        .otherwise(F.lit(0))
    )


def _verified(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the sizes and the exact number of shared tokens.

    The pairs are a narrow table, whose size Spark knows: while it is small it goes to the
    token lists, and these move only as the lists of a pair, to meet each other.
    """
    pairs = written(pairs, "pairs")
    tokens = candidates.select("rep", "tokens")
    left = pairs.join(tokens.select(F.col("rep").alias("a"), F.col("tokens").alias("left")), "a")
    right = pairs.join(tokens.select(F.col("rep").alias("b"), F.col("tokens").alias("right")), "b")
    both = left.join(right, ["a", "b"])
    shared = F.size(F.array_intersect("left", "right")).cast("long")
    checked = both.select("a", "b", F.size("left").cast("long").alias("a_size"), F.size("right").cast("long").alias("b_size"), shared.alias("shared"))
    union = F.col("a_size") + F.col("b_size") - F.col("shared")
    return checked.withColumn("linked", 100 * F.col("shared") >= percent * union)


def _candidates(docs: DataFrame, filled: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(rep, first, size, tokens) of the sets that may have a partner, one row each.

    Which of them are left is decided on ids; the token lists are only filtered by it.
    """
    own = own_tokens(prefixes(docs, words, percent), "prefix")
    chosen = written(_with_few_own(classes, own, percent), "chosen")
    whole = written(_whole_sets(docs, chosen, words), "whole")
    few = _with_few_own(whole.select("rep", "first", "size"), own_tokens(whole, "tokens"), percent)
    few = written(few.select("rep").distinct(), "few")
    found = whole.join(few, "rep", "left_semi")
    # Only rows that repeat an id with an equal set give a set twice.
    if not filled.groupBy("doc_id", "first", "second").count().filter("count > 1").isEmpty():
        found = found.dropDuplicates(["rep"])
    candidates = written(found, "candidates")
    discard(chosen, whole, few)
    return candidates


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows; similarity from ``percent`` hundredths on.

    ``percent`` goes from 80 to 100, below which prefixes would no longer be short; other
    values raise ValueError. At 100 the components are the classes of equal sets.
    """
    if not SMALLEST_THRESHOLD <= percent <= 100:
        raise ValueError(f"percent must be from {SMALLEST_THRESHOLD} to 100")
    rows = written(sets(docs, words), "sets")
    filled = rows.filter((F.col("size") > 0) & F.col("doc_id").isNotNull())
    classes = filled.groupBy("first", "second", "size").agg(F.min("doc_id").alias("rep"))

    narrow = rows.select("doc_id", "first", "second", "size")
    if percent == 100:
        return _labelled(narrow, classes.withColumn("component", F.col("rep")))
    candidates = _candidates(docs, filled, classes, words, percent)
    signed = written(_signed(candidates, percent), "signatures")
    index = written(_buckets(signed), "index")

    # Every set of a bucket meets the hub.
    to_hub = index.filter("rep != hub").filter(
        _possible(F.col("size"), F.col("hub_size"), F.col("before") + F.col("hub_before"), percent)
    )
    to_hub = to_hub.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    hub_pairs = written(_verified(to_hub, candidates, percent), "hubs")
    links = hub_pairs.filter("linked").select("a", "b")
    so_far = connected(links)

    # The others meet where a set is not connected with the hub.
    component = so_far.select(F.col("node").alias("rep"), "component")
    members = index.filter("rep != hub").join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = members.join(
        component.select(F.col("rep").alias("hub"), F.col("component").alias("hub_component")), "hub", "left"
    ).withColumn("outside", F.col("component") != F.coalesce("hub_component", "hub"))
    known = hub_pairs.select(
        F.col("a").alias("hub"), F.col("b").alias("rep"),
        (F.col("a_size") - F.col("shared")).alias("lack"), (F.col("b_size") - F.col("shared")).alias("extra"),
    )
    members = written(
        members.join(known, ["hub", "rep"], "left").select("sig", "rep", "size", "before", "component", "outside", "lack", "extra"),
        "members",
    )
    open_buckets = members.filter("outside").select("sig").distinct()
    members = written(members.join(open_buckets, "sig", "left_semi").join(_bits(candidates), "rep"), "open-members")
    left = members.filter("outside").alias("x")
    right = members.alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    nothing = F.lit(0)
    more_left = F.greatest(x("before"), F.coalesce(y("lack") - x("lack"), nothing), F.coalesce(x("extra") - y("extra"), nothing))
    more_right = F.greatest(y("before"), F.coalesce(x("lack") - y("lack"), nothing), F.coalesce(y("extra") - x("extra"), nothing))
    rest = left.join(
        right,
        (x("sig") == y("sig"))
        & (x("component") != y("component"))
        & (~y("outside") | (x("rep") < y("rep")))
        & _possible(x("size"), y("size"), more_left + more_right, percent)
        & _possible(x("size"), y("size"), _odd_cells(x("bits"), y("bits")), percent),
    ).select(F.least(x("rep"), y("rep")).alias("a"), F.greatest(x("rep"), y("rep")).alias("b"))
    others = _verified(rest.distinct(), candidates, percent).filter("linked").select("a", "b")
    labels = written(connected(links.unionByName(others)), "labels").withColumnRenamed("node", "rep")
    discard(candidates, signed, index, hub_pairs, members)
    joined = classes.join(labels, "rep", "left")
    return _labelled(narrow, joined.withColumn("component", F.coalesce("component", "rep")))


def _labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Each row with the component of its class."""
    classes = classes.select("first", "second", "size", "component")
    return rows.join(classes, ["first", "second", "size"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id").alias("component_id")
    )
