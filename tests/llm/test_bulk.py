"""Steps of the document operators that take many words or rows at once."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from opsight.llm import bpe, jaccard, packing


def test_many_words_are_merged_like_single_ones():
    encoder = bpe.encoder_maker(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)()
    pick = random.Random(4)
    words = [bytes(pick.choice(b"aeinrst") for _ in range(pick.randint(1, 90))) for _ in range(3000)]
    words += [bytes(pick.randrange(256) for _ in range(pick.randint(1, 60))) for _ in range(2000)]
    words += [b"a" * n for n in range(1, 80)]
    merge, alone = encoder.merge, []
    encoder.merge = lambda piece: alone.append(piece) or merge(piece)
    assert encoder.merge_many(words) == [tuple(merge(word)) for word in words]
    # Only long words are merged one by one.
    assert alone == [word for word in words if len(word) > bpe.SHORT]
    assert encoder.merge_many([]) == []


def test_a_piece_is_looked_up_once_and_full_memos_are_kept():
    tokens = packing.Tokens(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), remembered=3)
    learnt = []
    learn = tokens.learn
    tokens.learn = lambda pieces: learnt.append(set(pieces)) or learn(pieces)
    texts = [" one two qqzx qqzx", " qqzx one", "", None, " three four five é"]
    first = tokens.encode_many(texts)
    assert tokens.encode_many(texts) == first and len(learnt) == 1
    assert first == [tokens.tokenizer.encode(t or "").ids and np.array(tokens.tokenizer.encode(t or "").ids, "<u4").tobytes() or b"" for t in texts]
    assert tokens.memo.older and not tokens.memo.new
    assert not any(isinstance(ids, bytearray) for ids in tokens.memo.values())


def test_texts_without_a_partner_do_not_move(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(None, "y"), (700, "twice")], "doc_id long, text string"))
    chosen = spark.createDataFrame([(n,) for n in [None, *range(0, 20_000, 100)]], "doc_id long")
    found = [r.doc_id for r in jaccard._perhaps_in(rows, chosen, "doc_id").collect()]
    assert {*range(0, 20_000, 100)} <= set(found) and found.count(700) == 2
    assert len(found) < 2_000
    # A filter that is too small lets more rows pass, but loses none.
    found = {r.doc_id for r in jaccard._perhaps_in(rows, chosen, "doc_id", most_words=1).collect()}
    assert {*range(0, 20_000, 100)} <= found
    assert jaccard._perhaps_in(rows, chosen.limit(0), "doc_id").count() == 0
