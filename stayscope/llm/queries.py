"""Registered queries of the operators, each over whole tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.sources.literal import literal_table

from . import bitplane, chat_format, decontaminate, hard_negatives, jaccard_join, license_index, prefix_bpe, quality_rules, rendezvous, secrets, spelling, url_rules, warc_dict
from .text import ascii_lower


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


#: A conversation that speaks the template's own language.
TRICKY = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = literal_table(
        spark,
        [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)],
        "conv_id long, turn long, role string, text string",
    )
    done = chat_format.format_conversations(turns.unionByName(tricky))
    trained = chat_format.loss_text(F.col("turns"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        chat_format.turns_digest(F.col("turns")).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
        "identical",
    )


OP1_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), c as (
  select *, len(regexp_extract_all(text, '### |</turn>')) as n_controls from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(role) + 2 + length(text) + n_controls + 9)::bigint as formatted_chars,
  sum((n_controls > 0)::int)::bigint as n_escaped, true as identical
from c group by conv_id
"""

def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    rules = quality_rules.fit_rules(docs, read(spark, folder, "labels"))
    judged = quality_rules.judge(docs, rules, ["doc_id"])
    return judged.select(
        "kept.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.col("passed").alias("kept"),
        "rule",
    )


#: (verdict, host and path) of the curated list.
URL_LIST = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op3_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url")
    labels = read(spark, folder, "labels").select(
        "doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow").alias("label")
    )
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", "label")
    return url_rules.judge_urls(pages, URL_LIST, url_rules.mine_rules(labelled))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, read(spark, folder, "benchmark"), ["doc_id"])
    return found.select(
        "kept.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
with w as (
  select 'd' as kind, doc_id as id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents
  union all
  select 'i', item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') from benchmark
), items as (
  select id, words, least(len(words), 10) as n, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as pos
  from w where kind = 'i' and len(words) > 0
), windows as (
  select distinct id, n, array_to_string(list_slice(words, pos, pos + n - 1), ' ') as passage from items
), places as (
  select d.id, s.n, p.pos, array_to_string(list_slice(d.words, p.pos, p.pos + s.n - 1), ' ') as passage
  from w d, (select distinct n from windows) s, unnest(range(1, len(d.words) - s.n + 2)) p(pos)
  where d.kind = 'd'
), hits as (
  select p.id, p.pos, p.n, i.id as item from places p join windows i on i.n = p.n and i.passage = p.passage
), words_hit as (
  select id, count(distinct k) as n_hit from (select id, unnest(range(pos, pos + n)) as k from hits) group by id
), found as (
  select id, count(distinct item) as n_items,
    string_agg(distinct item::varchar, ',' order by item::varchar) as items from hits group by id
)
select d.id as doc_id, len(d.words)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit,
  coalesce(f.n_items, 0)::bigint as n_items, sha256(coalesce(f.items, '')) as items_sha256,
  coalesce(h.n_hit, 0) > 0 as contaminated
from w d left join words_hit h on h.id = d.id left join found f on f.id = d.id where d.kind = 'd'
"""


def encoded(docs: DataFrame) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = prefix_bpe.encode_texts(docs, path, public_tokenizers.PATTERN, ["doc_id"], decode=True)
    return done.select(
        "kept.doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(read(spark, folder, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return license_index.scan_licenses(docs, license_index.document_frequencies(docs)).drop("found")


def op7_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return rendezvous.assign_shards(docs, 16).withColumn("law", F.lit("key"))


def op8_warc_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    files = warc_dict.write_archives(read(spark, folder, "pages").select("page_id", "url", "html"))
    return warc_dict.read_archives(files).drop("url")


OP8_SQL = r"""
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as payload_digest,
    strlen(coalesce(html, '')) as payload_bytes from pages
), g as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as last from p
)
select page_id, payload_bytes, payload_digest,
  case when last is not null and page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from last then last end as refers_to from g
"""


def op9_bitplane_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = bitplane.tokenizer_encoder(f.read(), public_tokenizers.PATTERN)
    files = bitplane.write_ids(docs, encoder, end_id=2)
    documents = bitplane.read_ids(files, docs.schema["doc_id"])
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    linked = jaccard_join.link_texts(docs, k=3, percent=90)
    return linked.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


OP10_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), s as (
  select distinct doc_id, array_to_string(list_slice(words, pos, pos + 2), ' ') as shingle
  from w, unnest(range(1, greatest(len(words) - 2, least(len(words), 1)) + 1)) p(pos)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), c as (
  select a.doc_id as a, b.doc_id as b, count(*) as inter
  from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b
  where 100 * inter >= 90 * (x.n + y.n - inter)
), reach(a, b) as (
  select doc_id, doc_id from w union select r.a, l.b from reach r join links l on l.a = r.b
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.b) as component_id
from w left join n on n.doc_id = w.doc_id join reach r on r.a = w.doc_id group by 1, 2
"""


def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, secrets.fit_models(secrets.label_samples(docs)))
    return found.select(
        "doc_id",
        *[secrets.n_of_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", relabelled), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


OP12_SQL = r"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, e.vec_id, a.label = e.label as same, list_dot_product(a.q, e.q)::bigint as score
  from e a join e on a.vec_id <> e.vec_id where a.vec_id % 50 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id,
  row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same
  and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""


def runs_with_typos(docs: DataFrame) -> DataFrame:
    """Lower-cased runs of letters that can have seven; one in 31 runs of a document lacks a character."""
    run = ascii_lower(F.col("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    place = (F.col("h") % F.length("word")).cast("int")
    typo = F.concat(F.substring("word", F.lit(1), place), F.substring(F.col("word"), place + 2, F.length("word")))
    return (
        docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z\x{C0}-\x{FF}]{7,}"), F.lit(0))).alias("run"))
        .select("doc_id", run.alias("word"))
        .withColumn("h", h)
        .select(F.when(F.col("h") % 31 == 0, typo).otherwise(F.col("word")).alias("word"))
    )


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return spelling.group_variants(spelling.count_words(runs_with_typos(docs)))


OP13_SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as crcs
), runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), counted as (
  select doc_id, run, count(*) as times from runs group by all
), hashed as (
  select run, times, xor(list_reduce([4294967295] || flatten(list_transform(
      string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
      lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195, unicode(c)::bigint - 64] end)),
    lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295) as h from counted, crc
), w as (
  select word, sum(times)::bigint as n from (
    select case when h % 31 = 0 then run[:(h % length(run))] || run[(h % length(run)) + 2:] else run end as word, times
    from hashed) where length(word) >= 7 group by word having sum(times) >= 2
), cut as (
  select word, n, pos, word[:pos - 1] || word[pos + 1:] as rest from w, unnest(range(1, length(word) + 1)) p(pos)
), pairs as (
  select a.word, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.pos = b.pos and a.word <> b.word
  union select cut.word, w.word, w.n from cut join w on w.word = cut.rest
  union select w.word, cut.word, cut.n from cut join w on w.word = cut.rest
), best as (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pairs group by word
), forms as (
  select w.word, case when near_n >= 10 * n then near end as form, n, coalesce(n_near, 0)::bigint as n_near,
    case when near_n >= 10 * n then near_n end as form_n from w left join best using (word)
), way(word, last, step) as (
  select word, word, 0 from forms
  union all select way.word, f.form, step + 1 from way join forms f on f.word = way.last where f.form is not null
)
select f.word, form, arg_max(way.last, step) as root, n, n_near, form_n
from forms f join way on way.word = f.word group by all
"""


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_rules": op3_url_rules,
    "op4_decontaminate": op4_decontaminate,
    "op5_prefix_bpe": op5_prefix_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_rendezvous_shards": op7_rendezvous_shards,
    "op8_warc_dictionary": op8_warc_dictionary,
    "op9_bitplane_ids": op9_bitplane_ids,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_secret_scan": op11_secret_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL = {
    "op1_chat_format": OP1_SQL,
    "op4_decontaminate": OP4_SQL,
    "op8_warc_dictionary": OP8_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
