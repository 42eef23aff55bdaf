"""The numbered queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import chat, decontaminate, language, lines, near, negatives, neighbours, phrases, pieces, repeats, shards, tokens, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op1_benchmark_decontamination", f"""
with d as (select doc_id, {WORDS_SQL} as ws from documents),
b as (select item_id, {WORDS_SQL} as ws from benchmark),
bw as (select item_id, ws, unnest(range(1, 1 + case when len(ws) = 0 then 0 else greatest(len(ws) - 9, 1) end)) as i from b),
w as (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i:i + 9], ' ') as k from bw),
dw as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from w) l),
dk as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as k from dw),
h as (select dk.doc_id, dk.n, dk.i, w.item_id from dk join w on dk.k = w.k and dk.n = w.n),
hw as (select doc_id, count(distinct p) as n_hit
       from (select doc_id, unnest(range(i, i + n)) as p from h) x group by doc_id),
hi as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
       from (select distinct doc_id, cast(item_id as varchar) as item_id from h) y group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)""")  # fmt: skip
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_passages(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), keep_text=False
    )
    hit = F.aggregate("passages.spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select(
        "doc_id", "passages.n_words", hit.alias("n_hit"), F.size("passages.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("passages.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in chat.CONTROLS:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


@query("op9_chat_formatting", f"""
with c as (select conv_id, turn, role as r0, text as t0, coalesce(role, '') as r, coalesce(text, '') as t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first)) as turns_sha256,
  cast(sum(case when r = 'assistant' then length(t) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (where r = 'assistant'), '')) as loss_sha256,
  cast(sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_escaped_sql("r")}) + length({_escaped_sql("t")})) as bigint) as formatted_chars
from c group by conv_id""")  # fmt: skip
def op9(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    fixed = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    out = chat.formatted(chat.linked(turns.unionByName(fixed)))
    back = out.withColumn("said", chat.read_turns(F.col("formatted")))
    back = back.withColumn("loss", F.array_join(chat.read_masked(F.col("formatted"), F.col("mask")), ""))
    whole = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("said").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_sharding")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = shards.sharded(table(spark, folder, "documents"), 8)
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, tokenizer("byte_bpe_50k.json"), keep_text=False)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = language.remainder("doc_id", 5) == 0
    model = language.learn(docs.where(~held_out))
    found = language.labelled(docs.select("doc_id", "text"), model, keep_text=False, spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = language.remainder("doc_id", 4) == 2
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~held_out)
    found = toxicity.scored(docs, labels, keep_text=False)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = near.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), words=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.repeated_spans(table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    removed = F.aggregate("repeats.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "repeats.n_bytes", removed.alias("n_removed"), F.size("repeats.spans").cast("long").alias("n_spans"),
        "repeats.kept_sha256",
    )


@query("op4_nearest_neighbours", """
with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
    and list_bool_or(list_transform(embedding, lambda x: coalesce(x <> 0, false)))),
p as (select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1),
    lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, rows.where("vec_id % 100 = 0"), 10)


@query("op6_sentencepiece")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                       F.xxhash64(F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.BLANK), F.lit(" "))).alias("plain"))
    back = pieces.encode(docs, path, keep_text=False, decoded="decoded")
    return back.select(
        "doc_id", "n_bytes", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.xxhash64("decoded") == F.col("plain")).alias("round_trip"),
    )


LOW_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_line_dedup", f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from d),
k as (select *, {LOW_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from e),
m as (select key, max(doc_id) as top from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (where doc_id <> top) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where top is null or doc_id = top), '')) as kept_sha256
from k left join m using (key) group by doc_id""")  # fmt: skip
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = lines.without_lines(docs, lines.dropped_lines(docs))
    return kept.select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


@query("op12_phrase_collocations", f"""
with t as (select coalesce(lang, 'und') as lang, doc_id, {LOW_SQL.format("coalesce(text, '')")} as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from t),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from w, (select unnest([1, 2, 3]) as k) s where len(ws) >= k),
f as (select lang, k, phrase, count(*) as a from g group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as (select *, string_split(phrase, ' ') as ws from f where k > 1 and a >= 10),
cut as (select c.lang, c.k, c.phrase, c.a, c.ws, j, array_to_string(ws[1:j], ' ') as head, array_to_string(ws[j + 1:], ' ') as tail
  from c, (select unnest([1, 2]) as j) s where j < c.k),
s as (select cut.*, h.a as l, q.a as r, (cut.a::hugeint * cut.a::hugeint * 1000000) // (h.a::hugeint * q.a::hugeint) as score
  from cut join f h on h.lang = cut.lang and h.phrase = head and h.k = j
  join f q on q.lang = cut.lang and q.phrase = tail and q.k = cut.k - j),
b as (select *, row_number() over (partition by lang, k, phrase order by score, j) as best from s),
o as (select lang, phrase, max(a) as longer from (
    select lang, array_to_string(ws[1:2], ' ') as phrase, a from c where k = 3
    union all select lang, array_to_string(ws[2:3], ' '), a from c where k = 3) x group by all),
x as (select b.lang, b.phrase, b.a, l, r, score from b left join o on b.k = 2 and o.lang = b.lang and o.phrase = b.phrase
  where best = 1 and (longer is null or 100 * longer < 50 * b.a)),
y as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from x)
select lang, rank, phrase, a, l, r, n, score::bigint as score from y join n using (lang) where rank <= 2000""")  # fmt: skip
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents").select("text", "lang"))


@query("op13_hard_negatives", """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where label is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s as (select q.vec_id as anchor_id, c.vec_id as id, q.label = c.label as same,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from e q join e c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
p as (select anchor_id, id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, id) as r from s where same) x where r <= 5),
n as (select p.*, s.id as negative_id, score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from n where rank <= 10""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))
