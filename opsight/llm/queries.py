"""The registered queries: each applies its operator to the whole intended table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.llm import (
    bpe,
    codes,
    fingerprint,
    jaccard,
    language,
    linededup,
    packing,
    quality,
    topk,
    toxicity,
    trie,
    urlfilter,
    warc,
)
from opsight.llm.common import fold, table


def _in_fold(folds: int, number: int) -> Column:
    return F.coalesce(fold("doc_id", folds) == number, F.lit(False)).alias("held_out")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, ~_in_fold(4, 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", _in_fold(4, 2), "lang_pred", "score")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~_in_fold(5, 0))
    return quality.score(docs, model).select("doc_id", _in_fold(5, 0), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(r as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s
) where r <= 20
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~_in_fold(5, 0))
    return toxicity.severity(docs, model).select(
        "doc_id",
        _in_fold(5, 0),
        "expected_severity",
        "grade",
        "toxic_probability",
        (F.col("toxic_probability") >= toxicity.TOXIC_FROM).alias("toxic"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.roundtrip(spark, pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"
    )


OP9_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest
)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when f.first_id < p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id < p.page_id then f.first_id end as refers_to, cast(null as varchar) as error
from p left join f on f.payload_digest = p.payload_digest
"""


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = linededup.keep_bitmaps(docs)
    return linededup.digests(docs, bitmaps)


OP10_SQL = """
with line as (
  select doc_id, idx, l, trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) as k0
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as idx
        from documents)
), keyed as (
  select doc_id, idx, l, translate(k0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from line
), hot as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20
  group by k having count(distinct doc_id) >= 3
), marked as (
  select a.doc_id, a.idx, a.l, (h.k is not null and a.doc_id <> h.keeper) as gone
  from keyed a left join hot h on a.k = h.k
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(l, chr(10) order by idx) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

#: The rules of the url query.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op11_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.build(rules))


OP11_SQL = f"""
with rules(host, path, verdict) as (values {", ".join(str(rule) for rule in URL_RULES)}),
u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest,
         row_number() over () as n
  from pages
), p as (
  select n, page_id, regexp_extract(rest, '^[^/?#]*') as h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), q as (
  select n, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p
), best as (
  select n, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from q join rules r on (q.host = r.host or ends_with(q.host, '.' || r.host)) and starts_with(q.path, r.path)
  group by n
)
select q.page_id, q.host, q.path, best.rule, coalesce(best.verdict, 'allow') as verdict from q left join best using (n)
"""


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    found = trie.build(
        table(spark, sf_dir, "conversations"),
        base=conv - conv % 5,
        head=F.crc32(conv.cast("string").cast("binary")) % 9,
    )
    return found.nodes.drop("f1", "f2")


#: CRC-32 by single bits: each byte of the decimal id is followed by eight shifts.
_CRC32 = """
xor(list_reduce(
  [4294967295] || flatten(list_transform(string_split(cast(conv_id as varchar), ''),
                                         lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, b: case when b >= 0 then xor(a, b) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end
), 4294967295)
"""

OP12_SQL = f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as pos
  from conversations where conv_id is not null
), c as (
  select conv_id, conv_id - conv_id % 5 as base, {_CRC32} % 9 as h from (select distinct conv_id from t)
), rebuilt as (
  select c.conv_id, t.pos as k, 0 as own, t.role, t.text from c join t on t.conv_id = c.base and t.pos <= c.h
  union all
  select c.conv_id, t.pos as k, 1 as own, t.role, t.text from c join t on t.conv_id = c.conv_id and t.pos > c.h
), turn as (
  select conv_id, row_number() over w as depth, strlen(text) as bytes,
         sha256(string_agg(sha256(role) || sha256(text), ',') over w) as key
  from rebuilt window w as (partition by conv_id order by own, k rows between unbounded preceding and current row)
), member as (
  select * from turn union all select conv_id, 0, 0, 'root' from c
), length as (
  select conv_id, max(depth) as n from member group by conv_id
), node as (
  select depth, key, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes from member group by depth, key
), child as (
  select n.depth, n.key, n.conv_id, p.key as parent_key, q.conv_id as parent_conv_id
  from node n join member p on p.conv_id = n.conv_id and p.depth = n.depth - 1
  join node q on q.depth = p.depth and q.key = p.key
), children as (
  select depth - 1 as depth, parent_key as key, count(*) as n_children from child group by all
), above as (
  select a.depth, a.key, sum((n.n_convs - 1) * n.bytes) as saved_tokens, count(*) filter (where k.n_children is null) as n_leaves
  from node n join member a on a.conv_id = n.conv_id and a.depth <= n.depth
  left join children k on k.depth = n.depth and k.key = n.key
  group by a.depth, a.key
), ends as (
  select m.depth, m.key, sha256(string_agg(cast(m.conv_id as varchar), ',' order by m.conv_id)) as ends_sha256
  from member m join length l on l.conv_id = m.conv_id and l.n = m.depth group by m.depth, m.key
)
select n.conv_id, cast(n.depth as bigint) as depth, c.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children,
       a.n_leaves, cast(a.saved_tokens as bigint) as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from node n join above a using (depth, key)
left join child c using (depth, key) left join children k using (depth, key) left join ends e using (depth, key)
"""


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = codes.train(vectors)
    if books is None:
        empty = vectors.limit(0).select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")))
        return empty.withColumn("codebooks_sha256", F.lit(""))
    found = codes.with_label_error(codes.encode(vectors, books)).drop("label")
    return found.withColumn("codebooks_sha256", F.lit(books.digest()))


def _assigned(number: int) -> str:
    """Distances of all parts to the entries of codebook ``number``, and the nearest one."""
    return f"""
a{number} as (
  select n, p, any_value(s) as s, min({{'d': d, 'k': k}}) as best from (
    select part.n, part.p, part.s, e.k,
           list_sum(list_transform(list_zip(part.s, e.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
    from part join c{number} e on e.p = part.p
  ) group by n, p
)"""


def _moved(number: int) -> str:
    """Codebook ``number`` from the one before."""
    last = number - 1
    return f"""
m{number} as (
  select p, best.k as k, j, sum(s[j]) as total, count(*) as uses
  from a{last}, (select unnest(generate_series(1, (select any_value(len(s)) from part))) as j) group by all
), u{number} as (
  select p, k, list(cast((total - ((total % uses) + uses) % uses) // uses as bigint) order by j) as s from m{number} group by p, k
), c{number} as (
  select e.p, e.k, coalesce(u.s, e.s) as s from c{last} e left join u{number} u on u.p = e.p and u.k = e.k
)"""


OP13_SQL = f"""
with v as (
  select vec_id, label, row_number() over (order by vec_id) as n,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), part as (
  select n, p, e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)] as s
  from v, (select unnest(generate_series(0, 15)) as p)
), c0 as (
  select p, n - 1 as k, s from part where n <= 64
), {_assigned(0)}, {_moved(1)}, {_assigned(1)}, {_moved(2)}, {_assigned(2)},
coded as (
  select n, string_agg(printf('%02x', best.k), '' order by p) as code, cast(sum(best.d) as bigint) as error from a2 group by n
), sums as (
  select label, cast(sum(error) as bigint) as label_error from coded join v using (n) group by label
), books as (
  select sha256(string_agg(array_to_string(s, ','), ',' order by p, k)) as codebooks_sha256 from c2
)
select v.vec_id, coded.code, coded.error, sums.label_error, books.codebooks_sha256
from v join coded using (n) join sums on sums.label is not distinct from v.label, books
"""

REGISTRY = {
    "op1_language": (op1_language, None),
    "op2_fingerprint": (op2_fingerprint, None),
    "op3_quality": (op3_quality, None),
    "op4_packing": (op4_packing, None),
    "op5_jaccard": (op5_jaccard, None),
    "op6_bpe": (op6_bpe, None),
    "op7_topk": (op7_topk, OP7_SQL),
    "op8_toxicity": (op8_toxicity, None),
    "op9_warc": (op9_warc, OP9_SQL),
    "op10_linededup": (op10_linededup, OP10_SQL),
    "op11_urlfilter": (op11_urlfilter, OP11_SQL),
    "op12_trie": (op12_trie, OP12_SQL),
    "op13_codes": (op13_codes, OP13_SQL),
}
