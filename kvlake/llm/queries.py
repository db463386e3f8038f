"""The queries op1 to op10, each over its whole table, and what DuckDB says they return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, lm, mixing, near_dedup, packing, secrets, sharding, substring, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), width=2)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document isn't learned from. A row without an id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.fit(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found")


QUERIES = {f.__name__: f for f in (op1_substring, op2_near_dedup, op3_exact_dedup, op4_sharding, op5_langid, op6_mixing, op7_topk, op8_lm_score, op9_packing, op10_secrets)}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = r"select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from (select doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') as w from documents)"

ORACLES = {
    "op1_substring": f"""
        with words as ({WORDS.format(text="coalesce(text, '')")}),
        windows as (select doc_id, p, count(*) over w as n, md5(string_agg(word, ' ') over w) as h from words
            window w as (partition by doc_id order by p rows between current row and 19 following)),
        ranked as (select doc_id, p, row_number() over (partition by h order by doc_id, p) as r from windows where n = 20),
        gone as (select distinct doc_id, unnest(range(p, p + 20)) as p from ranked where r > 1),
        told as (select doc_id, count(*) as n_words, count(g.p) as n_removed, string_agg(word, ' ' order by p) filter (g.p is null) as kept
            from words left join gone g using (doc_id, p) group by doc_id)
        select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from documents left join told using (doc_id)""",
    "op2_near_dedup": f"""
        with recursive words as ({WORDS.format(text=LOWERED)}),
        pairs as (select doc_id, p, word, lead(word) over (partition by doc_id order by p) as following from words),
        sets as (select distinct doc_id, word || ' ' || following as s from pairs where following is not null
            union select doc_id, any_value(word) from words group by doc_id having count(*) = 1),
        sizes as (select doc_id, count(*) as n from sets group by doc_id),
        common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b using (s) where a.doc_id < b.doc_id group by 1, 2),
        links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        edges as (select a, b from links union all select b, a from links),
        reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join edges e on r.b = e.a),
        least as (select a as doc_id, min(b) as component_id from reach group by 1)
        select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
        from documents left join sizes using (doc_id) join least using (doc_id)""",
    "op3_exact_dedup": f"""
        with d as (select doc_id, sha256({LOWERED}) as text_sha256 from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)""",
    "op4_sharding": """
        with bits as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, n: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) as t),
        d as (select doc_id, coalesce(text, '') as text, cast('0x' || substr(md5(coalesce(text, '')), 1, 15) as bigint) as key, octet_length(encode(coalesce(text, ''))) + 1 as size, hex(encode(coalesce(text, ''))) as x from documents),
        b as (select *, list_transform(range(size - 1), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint)) as bytes from d),
        c as (select b.* exclude (bytes, x), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, n: xor(c >> 8, t[(xor(c, n) & 255) + 1])), 4294967295) as text_crc32 from b, bits),
        o as (select *, sum(size) over (order by key, doc_id) - size as start, sum(size) over () as total, max(size) over () as largest, sum(size) over (partition by key) as own from c),
        p as (select *, case when own <= largest then min(start) over (partition by key) else start end as place from o),
        s as (select *, cast(least(7, place * 8 // total) as int) as shard from p)
        select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by key, doc_id) - 1 as slot, cast(null as int) as grown_shard from s""",
    "op7_topk": f"""
        with codes as (select vec_id, list_reduce(list_transform(range(1, 65), lambda i: if(embedding[i] > 0, '1', '0')), lambda a, b: a || b)::bit as code from embeddings),
        pairs as (select q.vec_id as query_id, d.vec_id, bit_count(xor(q.code, d.code))::int as distance from codes q, codes d where q.vec_id % 100 = 0),
        ranked as (select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from pairs)
        select query_id, rank, vec_id, distance from ranked where rank <= 10""",
}
