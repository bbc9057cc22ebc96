"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetable.llm import (
    divergence, exact_dedup, hilbert_shards, jaccard_join, mixing, ordinal, packing, resample, sentence_pieces, simhash, tool_calls,
    topk, warc,
)
from casetable.llm.common import stored
from casetable.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register


@query("op3_hilbert_shards")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert_shards.shard_documents(table(spark, folder, "documents"))


@query("op6_exact_dedup", r"""
    with t as (
        select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
    ), g as (
        select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
    from t join g using (norm)
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def vocabulary(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_warc_salvage", """
    with p as (
        select page_id, coalesce(html, '') as html from pages
    ), f as (
        select html, min(page_id) as first from p where strlen(html) >= 100 group by html
    )
    select page_id, strlen(p.html)::bigint as payload_bytes, sha256(p.html) as payload_digest,
        case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
        case when first <> page_id then first end as refers_to
    from p left join f on p.html = f.html
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(warc.page_records(table(spark, folder, "pages")), path, torn_every=50)
    return warc.resolve_pages(stored(warc.read_archives(spark, path, payloads=False), "records"))


@query("op8_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    added = packing.added_tokens(vocabulary("byte_bpe_50k.json"))
    packed = packing.pack_documents(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"), added)
    return packed.select(
        "doc_id", "start", packing.piece_length(F.col("ids")).alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


@query("op9_jaccard_join", r"""
    with recursive t as (
        select row_number() over () as row, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
        from documents
    ), s as (
        select row, unnest(case when len(w) between 1 and 4 then [array_to_string(w, ' ')] else list_distinct(
            list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as shingle from t
    ), n as (
        select row, count(*) as n from s group by row
    ), p as (
        select a.row as x, b.row as y, count(*) as shared from s a join s b on a.shingle = b.shingle and a.row < b.row group by all
    ), l as (
        select x, y from p join n a on a.row = x join n b on b.row = y where 100 * shared >= 80 * (a.n + b.n - shared)
    ), e as (
        select x, y from l union all select y, x from l
    ), r(row, seen) as (
        select row, row from t union select e.y, r.seen from r join e on e.x = r.row
    )
    select t.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(o.doc_id) as component_id
    from t left join n using (row) join r on r.row = t.row join t o on o.row = r.seen group by t.row, t.doc_id
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, folder, "documents"))


@query("op4_ordinal_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    graded = ordinal.select_by_grade(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return graded.select("doc_id", "graded.*")


@query("op5_exact_top_k", """
    with v as (
        select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as cells from embeddings
        where embedding is not null and list_count(embedding) = len(embedding)
            and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
    ), s as (
        select q.vec_id as query_id, c.vec_id, list_inner_product(q.cells::double[], c.cells::double[])::bigint as score
        from v q join v c on q.vec_id <> c.vec_id and len(q.cells) = len(c.cells) where q.vec_id % 20 = 0
    ), r as (
        select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
    )
    select query_id, rank, vec_id, score from r where rank <= 20
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


@query("op10_context_mixing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.score_documents(table(spark, folder, "documents"))


@query("op1_sentence_pieces")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    encoded = sentence_pieces.encode(docs, vocabulary("piece_bpe_32k.model"), check=True)
    return encoded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "round_trip")


#: Fields of the two tools that turns are read as.
TOOL_FIELDS = """
    select * from values
        ('user', 'text', 'string', true, null, null, null), ('user', 'turn', 'integer', true, null, 0.0D, null),
        ('user', 'characters', 'integer', true, null, 1.0D, 500.0D),
        ('system', 'text', 'string', true, null, null, null), ('system', 'turn', 'integer', true, null, 0.0D, 0.0D)
    as t(name, field, kind, required, choices, least, most)
"""


@query("op2_tool_calls", """
    with recursive c as (
        select conv_id, turn, role, text, case role when 'user' then turn - 2 else turn + 1 end as dep
        from conversations where role in ('user', 'system')
    ), e as (
        select c.conv_id, c.turn, c.dep from c join c d on c.conv_id = d.conv_id and c.dep = d.turn
    ), late as (
        select distinct conv_id from e where dep >= turn
    ), p as (
        select conv_id, turn, 0 as depth from c where conv_id in (from late)
        union all
        select e.conv_id, e.turn, p.depth + 1 from p join e on p.conv_id = e.conv_id and p.turn = e.dep
    ), deep as (
        select conv_id, turn, max(depth) as depth from p group by all
    ), a as (
        select * from conversations where role not in ('user', 'system')
    ), rows as (
        select c.conv_id, c.turn as place, coalesce(depth, 0)::int as depth, c.role as name,
            case when c.role = 'system' then 'unknown:characters' || case when c.turn <> 0 then ',range:turn' else '' end
                when length(c.text) not between 1 and 500 then 'range:characters' else '' end as broken,
            a.conv_id is not null as met, c.turn as id, coalesce(a.text, '') as answer,
            '{"characters":' || length(c.text) || ',"text":' || to_json(c.text) || ',"turn":' || c.turn || '}' as given
        from c left join deep using (conv_id, turn) left join a on a.conv_id = c.conv_id and a.turn = c.turn + 1
        union all
        select a.conv_id, a.turn, 0, null, '', false, a.turn - 1, coalesce(a.text, ''), 'null'
        from a where not exists (select 1 from c where c.conv_id = a.conv_id and c.turn = a.turn - 1)
    )
    select conv_id, id::varchar as call_id, place, depth, name,
        case when name is null then 'orphan' when broken <> '' then 'invalid' when met then 'answered' else 'open' end as status,
        array_to_string(list_sort(string_split(broken, ',')), ',') as violations,
        '{"arguments":' || given || ',"call_id":"' || id || '","name":' || coalesce(to_json(name), 'null') || ',"result":'
            || case when met or name is null then to_json(answer) else 'null' end || '}' as record
    from rows
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """User and system turns as calls; any other turn is the result of the turn before it.

    A user turn depends on the one two turns before; a system turn on the turn after it.
    """
    turns = table(spark, folder, "conversations")
    called = F.col("role").isin("user", "system")
    on = F.when(F.col("role") == "user", F.col("turn") - 2).otherwise(F.col("turn") + 1)
    calls = turns.where(called).select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), F.col("turn").alias("place"), F.col("role").alias("name"),
        F.to_json(F.struct("text", "turn", F.char_length("text").alias("characters"))).alias("arguments"),
        F.array(on.cast("string")).alias("depends_on"),
    )
    results = turns.where(~F.coalesce(called, F.lit(False))).select(
        "conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("turn").alias("place"), F.col("text").alias("content")
    )
    linked = tool_calls.link_tool_calls(calls, results, spark.sql(TOOL_FIELDS))
    return linked.withColumn("violations", F.array_join("violations", ","))


@query("op11_simhash")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.fingerprint_documents(table(spark, folder, "documents"))


@query("op12_source_divergence", r"""
    with d as (
        select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
        from documents
    ), w as (
        select row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
    ), k as (
        select lang, term from w group by lang, term having count(distinct row) >= 10
    ), c as (
        select lang, source, term, count(*) as n from w join k using (lang, term) group by all
    ), v as (
        select lang, count(*) as v from k group by lang
    ), g as (
        select lang, source, coalesce(sum(n), 0) as total from (select distinct lang, source from d) left join c using (lang, source)
        group by all
    ), l as (
        select lang, term, sum(n) as n from c group by all
    ), lt as (
        select lang, sum(total) as total from g group by lang
    ), p as (
        select lang, source, term, coalesce(n, 0)::bigint as n,
            1 + 1000000000::hugeint * (coalesce(n, 0) + 2) // (total + 2 * v)::hugeint as p
        from g join v using (lang) join k using (lang) left join c using (lang, source, term)
    ), q as (
        select lang, term, 1 + 1000000000::hugeint * (n + 2)::hugeint // (total + 2 * v)::hugeint as q
        from l join lt using (lang) join v using (lang)
    ), s as (
        select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
        from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
    ), pairs as (
        select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
        from g a join g b on a.lang = b.lang and a.source <> b.source
        left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
    ), terms as (
        select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
        from p join q using (lang, term) where n > 0 and p > q
    ), r as (
        select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
        from (select * from pairs union all select * from terms)
    )
    select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


@query("op13_resample_target", r"""
    with step as (
        select list(list_reduce([b::bigint] || list_transform(range(8), lambda i: i::bigint),
            lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) order by b) as crc
        from range(256) t(b)
    ), w as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words, row_number() over () as row from documents
    ), tw as (
        select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark
    ), dw as (
        select row, unnest(words) as word from w
    ), h as (
        select word, xor(list_reduce([4294967295::bigint] || list_transform(range(strlen(word)),
            lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint),
            lambda x, b: xor(x // 256, crc[xor(x % 256, b) + 1])), 4294967295) % 10000 as bucket
        from (select word from dw union select word from tw), step
    ), s as (
        select bucket, count(*) as n from dw join h using (word) group by bucket
    ), t as (
        select bucket, count(*) as n from tw join h using (word) group by bucket
    ), gain as (
        select b as bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double
            / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain
        from range(10000) r(b) left join s on s.bucket = b left join t on t.bucket = b
    ), f as (
        select row, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight
        from dw join h using (word) join gain using (bucket) group by row
    ), x as (
        select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
            coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint
                + 0.5::double) / 4294967296::double)))::bigint as score
        from w left join f using (row)
    ), r as (
        select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place from x
    )
    select doc_id, n_features, weight, score,
        case when n_features >= 20 and place <= (select count(*) * 10 // 100 from x where n_features >= 20) then place end as rank
    from r
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
