"""The operators on documents against brute force, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from opsight.llm import bpe, fingerprint, jaccard, language, linededup, packing, quality, toxicity
from opsight.llm.components import connected

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ("score", "rank", "length", "size", "token", "place", "part", "first", "sig", "keep", "ids", "grade")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _texts():
    pick = random.Random(5)
    words = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 7))) for _ in range(60)]
    base = [" ".join(pick.choice(words) for _ in range(pick.randint(40, 160))) for _ in range(8)]
    shared = "This line stands in many of the documents"
    texts = [None, "", " \t\n ", "\n", "x", "One two", "one TWO ", "a\n\n b", "!!! 123", "é" * 3]
    for text in base:
        texts += [text, text.upper(), f"{text}\n{shared}\n\t{shared.upper()} \n", f"{shared}\n{text}"]
        for changes in (1, 2, 4, 9):
            changed = text.split(" ")
            for _ in range(changes):
                changed[pick.randrange(len(changed))] = pick.choice(words)
            texts.append(" ".join(changed))
    texts += [f"{shared}\n", " ".join(words * 3000), "long line " * 9000 + "\n" + "z" * 100_000]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    return [(3 * i - 20, text) for i, text in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Ids in no order, a repeated row, and extra columns whose names clash."""
    data = [(i, t, "en", "s", len(t or "")) for i, t in [*rows, rows[12]]]
    frame = spark.createDataFrame(data, SCHEMA).repartition(5)
    return frame.withColumns({name: F.lit("extra") for name in EXTRA})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, n % 2, n % 3 == 0) for n, (i, _) in enumerate(rows)], "doc_id bigint, quality int, flag boolean").withColumn("toxic", F.col("flag").cast("int"))


def test_language_families_and_pairs(spark, empty):
    pick = random.Random(1)
    sounds = {"en": "the and of ing ould wh", "de": "der und sch ung keit ei", "fr": "eau eux ment le que ou", "es": "cion el ado os que ar", "zz": "kx qz wv jj xq zk"}
    rows = []
    for i in range(250):
        lang = sorted(sounds)[i % 5]
        rows.append((i, " ".join(pick.choice(sounds[lang].split()) for _ in range(30)), lang, "s", 1))
    rows += [(900, None, "en", "s", 0), (901, "12 !", "en", "s", 0), (None, "the and of", None, "s", 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x"))
    learn = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    model = language.train(frame, learn, per_language=20)
    assert set(model.families) == {"germanic", "romance", "zz"}
    found = {r.doc_id: r for r in language.identify(frame, model).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].lang_pred == found[i].lang for i in range(250))
    assert [found[i].lang_pred for i in (900, 901, None)] == ["und", "und", "en"]
    assert language.train(empty, F.lit(True)) is None
    assert language.identify(empty, None).count() == 0


def test_language_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    rows = [(7 if i % 3 else i, f"text number {i}", "en" if i % 5 else "de") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    chosen = []
    for parts in (1, 7):
        found = language.training_rows(frame.repartition(parts), F.lit(True), "doc_id", "text", "lang", 100)
        chosen.append(sorted((r.lang, r.hash, r.id) for r in found.collect()))
    assert chosen[0] == chosen[1]
    for lang in ("de", "en"):
        assert 100 <= sum(x[0] == lang for x in chosen[0]) <= 200
    languages = np.array([x[0] for x in chosen[0]])
    kept = language._first_of_each(languages, np.arange(len(languages)), 100)
    assert sorted(languages[kept]) == ["de"] * 100 + ["en"] * 100
    assert [language._cut(n, 100) for n in (0, 5, 133)] == [2**63 - 1] * 3 and language._cut(1330, 100) < 0


def test_quality_and_toxicity(spark, docs, empty, labels):
    pick = random.Random(2)
    fine, odd = "plain good words here now".split(), "BAD!! ### loud|| ***".split()
    data = [(i, " ".join(pick.choice(odd if i % 4 == 0 else fine) for _ in range(20)) + (" scum" if i % 3 == 0 else "")) for i in range(240)]
    frame = spark.createDataFrame(data, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i, _ in data], "doc_id bigint, quality int, toxic int")
    model = quality.train(frame, marks, F.col("doc_id") % 5 != 0)
    scored = quality.score(frame, model).collect()
    assert all((r.predicted == 1) == (r.doc_id % 4 != 0) for r in scored)
    graded = toxicity.severity(frame, toxicity.train(frame, marks, F.lit(True))).collect()
    assert all((r.toxic_probability >= toxicity.TOXIC_FROM) == (r.doc_id % 3 == 0) for r in graded)
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.grade <= 3 for r in graded)
    for train, apply in ((quality.train, quality.score), (toxicity.train, toxicity.severity)):
        awkward = apply(docs, train(docs, labels, F.lit(True))).collect()
        assert len(awkward) == docs.count()
        nothing = train(empty, labels.limit(0), F.lit(True))
        assert apply(empty, nothing).count() == 0 and apply(docs, nothing).count() == docs.count()


def test_thresholds_are_ordered():
    rows = [np.array([1, 2]), np.array([1]), np.array([3]), np.array([3, 4])] * 20
    model = toxicity.fit(rows, np.array([True, True, False, False] * 20), {0: 40, 1: 40})
    assert (np.diff(model.thresholds) > 0).all()


def test_fingerprint_is_a_multiset_hash():
    one = fingerprint.Fingerprint("a b\nc d\ne f")
    assert one == fingerprint.Fingerprint("e f\na b\nc d")
    assert one != fingerprint.Fingerprint("a b\nc d\ne f\ne f")
    grown = fingerprint.Fingerprint("a b\nc d").update(["e f"], 1)
    assert grown.text() == one.text() and grown.update(["e f"], -1) == fingerprint.Fingerprint("c d\na b")
    assert fingerprint.Fingerprint.parse(one.text()) == one and one.likeness(one) == 1.0


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_of_edited_texts(docs, rows, parts):
    ordered = [t or "" for _, t in sorted([*rows, rows[12]], key=lambda r: (r[0], r[1] or ""))]
    expected = Counter()
    for i, text in enumerate(ordered):
        following, cut = ordered[(i + 1) % len(ordered)], len(text) // 4
        new = text[: len(text) - cut] + following[:cut]
        expected[len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprint.Fingerprint(text).text(), fingerprint.Fingerprint(new).text()] += 1
    found = fingerprint.fingerprints(docs, parts).collect()
    assert Counter((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in found) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def _lines(rows):
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(strip).translate(lower)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(x.strip(strip).translate(lower), ())) < 3 or i == max(h)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs, rows):
    expected = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in _lines([*rows, rows[12]]))
    bitmaps = linededup.keep_bitmaps(docs)
    assert Counter(map(tuple, linededup.digests(docs, bitmaps).collect())) == expected
    cut = linededup.without_dropped(docs, bitmaps)
    assert cut.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in cut.collect()) == Counter((i, t) for i, _, _, t in _lines([*rows, rows[12]]))


def test_a_line_over_many_partitions(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the very same line everywhere\nown").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = linededup.keep_bitmaps(many).groupBy("n_lines", "n_dropped").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, found)) == [(2, 0, 1, 3999), (2, 1, 3999, 3998)]


def _components(rows, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        k = min(words, len(found))
        sets[i] = {tuple(found[j : j + k]) for j in range(len(found) - k + 1)} if found else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {(i, len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("classes", [((64, 1), (2048, 2)), ((2, 1), (4, 2))])
def test_jaccard_components(docs, rows, words, percent, classes, monkeypatch):
    monkeypatch.setattr(jaccard, "CLASSES", classes)
    assert set(map(tuple, jaccard.components(docs, words, percent).collect())) == _components(rows, words, percent)


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_similar_sets_share_a_signature(percent, monkeypatch):
    monkeypatch.setattr(jaccard, "CLASSES", ((2, 1), (4, 2)))
    numbers = np.random.default_rng(percent)
    for _ in range(300):
        size = int(numbers.integers(10, 400))
        union = np.unique(numbers.integers(0, 2**64, size, dtype=np.uint64))
        counts = dict(zip(union.tolist(), numbers.choice([2, 3, 9], len(union)).tolist(), strict=True))
        spare = len(union) * (100 - percent) // 100
        missing = numbers.permutation(len(union))[:spare]
        cut = int(numbers.integers(0, spare + 1))
        sides = [np.delete(union, missing[:cut]), np.delete(union, missing[cut:])]
        found = [
            set(jaccard.signatures(s, np.array([counts[t] for t in s.tolist()]), len(s), percent)[0].tolist()) for s in sides
        ]
        assert found[0] & found[1]


@pytest.mark.parametrize("size", [1, 31, 33, 64, 65, 500, 3000])
def test_parity_bits_never_exceed_the_difference(spark, size):
    random = np.random.default_rng(size)
    rows, differing = [], []
    for _ in range(20):
        left = np.unique(random.integers(0, 2**64, size, dtype=np.uint64))
        cut = int(random.integers(0, size // 5 + 1))
        right = np.unique(np.concatenate((left[cut:], random.integers(0, 2**64, cut + 2, dtype=np.uint64))))
        rows.append([jaccard.parity_bits(side).view(np.int64).tolist() for side in (left, right)])
        differing.append(len(np.setxor1d(left, right)))
    frame = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").coalesce(1)
    odd = [row[0] for row in frame.select(jaccard._odd_cells(F.col("a"), F.col("b"))).collect()]
    assert all(o <= d and (d - o) % 2 == 0 for o, d in zip(odd, differing, strict=True))


def test_connected(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 100), (7, 7)]
    found = dict(map(tuple, connected(spark.createDataFrame(chain, "a bigint, b bigint")).collect()))
    assert found == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


@pytest.fixture(scope="module")
def reference_encoder():
    ranks = {token: rank for rank, token in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_on_random_text(reference_encoder):
    make = bpe.encoder_maker(RANKS, public_tokenizers.PATTERN)
    encoder = make()
    assert sorted(encoder.perfect.index.tolist()) == list(range(len(encoder.tokens)))
    assert encoder.perfect.candidates(encoder.tokens).tolist() == list(range(len(encoder.tokens)))
    pick = random.Random(0)
    letters = "ab \n\t  'sét\x1c\x1f日1😀.,|\r\x85　"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 9000, " " * 500 + "x", "<|endoftext|> it's we'LL", None]
    ids = encoder.encode(texts)
    assert ids == [reference_encoder.encode_ordinary(t or "") for t in texts]
    assert [encoder.decode(i).decode() for i in ids] == [t or "" for t in texts]
    tokens = packing.Tokens(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert [np.frombuffer(tokens.encode(t), "<u4").tolist() for t in texts] == ids


def test_bpe_tables(docs, empty, reference_encoder):
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, RANKS).collect()
    assert all(r.ids == reference_encoder.encode_ordinary(r.text or "") and r.decoded.decode() == (r.text or "") for r in back)
    short = {r.doc_id: r for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for r in back:
        assert short[r.doc_id].n_tokens == len(r.ids)
        assert short[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert short[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing(docs, empty, reference_encoder):
    model = public_tokenizers.path("byte_bpe_50k.json")
    found = [r for r in packing.pack(docs, model, 64).collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    sequences, used = {}, Counter()
    whole = {doc: [*reference_encoder.encode_ordinary(text or ""), 0] for doc, text in texts.items()}
    for r in found:
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        used[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    copies = Counter(r.doc_id for r in docs.collect())
    assert used == Counter({r.doc_id: r.doc_tokens * copies[r.doc_id] for r in found}) and set(used) == set(texts)
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert packing.pack(empty, model, 64).count() == 0


def test_shortest_pack_first_places_everything():
    pick = random.Random(4)
    for _ in range(50):
        counts = {n: pick.randint(1, 50) for n in pick.sample(range(1, 65), pick.randint(1, 40))}
        patterns = packing.shortest_pack_first(counts, 64)
        placed = Counter()
        for pattern, packs in patterns.items():
            assert sum(pattern) <= 64
            for length in pattern:
                placed[length] += packs
        assert placed == counts


def test_every_stage_takes_awkward_rows(spark, docs, empty, labels, tmp_path):
    plain = docs.select(*SCHEMA.replace(" bigint", "").replace(" string", "").split(", "))
    for name, source in (("full", plain), ("empty", empty)):
        folder = str(tmp_path / name)
        source.write.parquet(f"{folder}/documents.parquet")
        labels.select("doc_id", "quality", "toxic").write.parquet(f"{folder}/labels.parquet")
        rows = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, folder).columns == rows.columns
        assert corpus_pipeline.run(spark, folder).columns[0] == "doc_id"


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, rows):
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {c for _, _, c in _components(rows, 5, 80)}


def _thue_morse(length, first, second):
    return "".join((first, second)[bin(n).count("1") % 2] for n in range(length))


@pytest.mark.parametrize("length", [64, 1024, 2048, 4096])
def test_patterned_words_do_not_collide(spark, length):
    """Words that a polynomial hash modulo a power of two confuses."""
    from opsight.llm.words import as_bytes, word_hashes

    words = [_thue_morse(length, *pair) for pair in (("a", "b"), ("b", "a"))]
    words += [w + "c" for w in words] + [words[0][::-1], words[0][64:] + words[0][:64]]
    words = list(dict.fromkeys(words))
    hashes = word_hashes(as_bytes(" ".join(words)))
    assert len(set(hashes.tolist())) == len(words)
    rows = [(i, f"{w} one two") for i, w in enumerate(words)]
    found = jaccard.components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()
    assert all(r.component_id == r.doc_id for r in found)


def test_word_hashes_do_not_depend_on_the_cut(monkeypatch):
    from opsight.llm import words

    text = " ".join("x" * (n % 150) + str(n) for n in range(400))
    whole = words.words_at(words.as_bytes(text))
    monkeypatch.setattr(words, "SLICE", 37)
    cut = words.words_at(words.as_bytes(text))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert len(set(whole[0].tolist())) == 400


def test_equal_sets_are_the_components_at_one_hundred(docs, rows):
    assert set(map(tuple, jaccard.components(docs, 3, 100).collect())) == _components(rows, 3, 100)
    with pytest.raises(ValueError):
        jaccard.components(docs, 3, 70)


def _plain_fingerprint(text):
    """The lanes paragraph by paragraph, from the hashes of single words and pairs."""
    from opsight.llm.words import as_bytes, mixed, shingle_hashes, word_hashes

    exact, near = np.zeros(fingerprint.EXACT, np.uint64), np.zeros(fingerprint.NEAR, np.int64)
    for paragraph in text.split("\n"):
        data = paragraph.encode()
        exact += np.frombuffer(hashlib.shake_128(data).digest(8 * fingerprint.EXACT), "<u8")
        for key in mixed(shingle_hashes(word_hashes(as_bytes(paragraph)), 2)).tolist():
            near[key % fingerprint.NEAR] += -1 if key >> 32 & 1 else 1
    return exact, near


def test_fingerprints_and_likeness_equal_a_plain_computation(rows):
    texts = [t or "" for _, t in rows if len(t or "") < 20_000] + ["a\nb\n\nc d\ne", "one two\n" * 50, "\n\n"]
    plain = [_plain_fingerprint(t) for t in texts]
    made = [fingerprint.Fingerprint(t) for t in texts]
    for (exact, near), own in zip(plain, made, strict=True):
        assert (own.exact == exact).all() and (own.near.view(np.int16) == near).all()
    for (exact, near), own, (other_exact, other_near), other in zip(plain, made, plain[1:], made[1:], strict=False):
        norm = float(np.sqrt(float(near @ near) * float(other_near @ other_near)))
        cosine = max(0.0, min(1.0, float(near @ other_near) / norm)) if norm else 0.0
        wanted = 1.0 if (exact == other_exact).all() else cosine
        assert abs(own.likeness(other) - wanted) < 1e-12


def test_whole_words_are_features():
    base = "x" * 30
    assert set(toxicity.features(base + "a").tolist()) != set(toxicity.features(base + "b").tolist())
    ends = [set(toxicity.features("y" * n).tolist()) for n in range(20, 80)]
    assert len({frozenset(e) for e in ends}) == len(ends)


def test_linear_machine_reaches_the_plain_optimum():
    """Dual coordinate descent against plain subgradient steps on the same objective."""
    from opsight.llm.linear import dual_coordinate_descent, margins

    numbers = np.random.default_rng(8)
    width, cost = 12, 1.0
    dense = (numbers.random((60, width)) < 0.4).astype(float)
    labels = np.where(dense[:, 0] + dense[:, 1] - dense[:, 2] + 0.3 * numbers.normal(size=60) > 0.4, 1.0, -1.0)
    rows = [(np.flatnonzero(row), row[np.flatnonzero(row)]) for row in dense]

    design = np.hstack((dense, np.ones((60, 1))))  # the last weight is the bias

    def objective(weights):
        return 0.5 * weights @ weights + cost * np.maximum(0, 1 - labels * (design @ weights)).sum()

    found = dual_coordinate_descent(rows, labels, width, cost, epochs=500, tolerance=1e-6)
    best, weights = np.inf, np.zeros(width + 1)
    for step in range(1, 20_001):
        inside = labels * (design @ weights) < 1
        weights = weights - (weights - cost * (labels[inside, None] * design[inside]).sum(0)) / (step + 20)
        best = min(best, objective(weights))
    assert objective(found) <= best * 1.001
    assert np.allclose(margins(rows, found), design @ found)


def test_shortest_pack_first_wastes_no_more_than_one_at_a_time():
    """Against a packer that places single pieces, longest first, into the fullest open pack."""
    pick = random.Random(9)
    for _ in range(30):
        counts = {n: pick.randint(1, 40) for n in pick.sample(range(1, 65), pick.randint(2, 40))}
        packs = sum(packing.shortest_pack_first(counts, 64).values())
        least = -(-sum(n * c for n, c in counts.items()) // 64)
        single = []
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            room = [at for at, used in enumerate(single) if used + length <= 64]
            if room:
                at = min(room, key=lambda at: single[at])
                single[at] += length
            else:
                single.append(length)
        assert least <= packs <= max(len(single), int(least * 1.25) + 1)
