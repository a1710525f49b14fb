"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, balltree, huffman, language, lexicon, nearcopies, packing, replytree, suffixes, tokencount


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replytree.chosen_conversations(replytree.reply_tree_of_threads(_table(spark, sf_dir, "conversations")))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound: each page's bytes are played as a clip of 8-bit PCM."""
    return audio.audio_features(_table(spark, sf_dir, "pages"), "page_id", "html").withColumnRenamed("id", "page_id")


def op4_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.archive(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train_profiles(docs))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100; all rows are searched."""
    found = balltree.exact_top_k(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("score", F.round("score", 9))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_chat_formatting, op3_audio_features, op4_huffman, op5_suffix_dedup, op6_language_id, op7_bpe, op8_best_fit_packing, op9_exact_topk, op10_minhash)}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": r"""
with recursive m as (select conv_id, turn, role, text, case when length(text) % 4 = 0 and turn >= 3 then turn - 3 when turn > 0 then turn - 1 end as parent,
                            case when role = 'assistant' then length(text)::double end as score from conversations),
leaf as (select conv_id, turn from m where not exists (select 1 from m c where c.conv_id = m.conv_id and c.parent = m.turn)),
path as (select conv_id, turn as leaf, turn as node, 0 as dist from leaf
         union all select p.conv_id, p.leaf, m.parent, p.dist + 1 from path p join m on m.conv_id = p.conv_id and m.turn = p.node where m.parent is not null),
per as (select p.conv_id, p.leaf, max(case when m.parent is null then p.node end) as root, coalesce(avg(m.score), 0) as score, count(*) as n_messages,
               string_agg('<|im_start|>' || coalesce(m.role, 'user') || chr(10) || coalesce(m.text, '') || '<|im_end|>', chr(10) order by p.dist desc) as text
        from path p join m on m.conv_id = p.conv_id and m.turn = p.node group by p.conv_id, p.leaf)
select conv_id, root, leaf, row_number() over (partition by conv_id, root order by score desc, leaf)::integer as branch, n_messages, score, text from per qualify branch <= 1""",
    "op9_exact_topk": r"""
with v as (select vec_id, embedding::double[] as e from embeddings),
s as (select a.vec_id as query_id, b.vec_id as neighbor_id, list_inner_product(a.e, b.e) as score from v a join v b on a.vec_id <> b.vec_id and a.vec_id % 100 = 0)
select query_id, neighbor_id, row_number() over (partition by query_id order by score desc, neighbor_id)::integer as rank, round(score, 9) as score from s qualify rank <= 10""",
    "op5_suffix_dedup": r"""
with w as (select doc_id, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as words from documents where text is not null and doc_id is not null),
p as (select doc_id, words, unnest(range(0, len(words) - 50 + 1)) as i from w where len(words) >= 50),
h as (select doc_id, i, md5(array_to_string(words[i + 1 : i + 50], ' ')) as h from p),
r as (select doc_id, i, row_number() over (partition by h order by doc_id, i) > 1 as later from (select *, count(*) over (partition by h) as n from h) where n > 1),
m as (select doc_id, later, i, case when i <= max(i + 50) over (partition by doc_id, later order by i rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from r),
s as (select *, sum(opens) over (partition by doc_id, later order by i) as span from m)
select doc_id, null::varchar as content, later, min(i)::integer as start_word, (max(i) + 50)::integer as end_word from s group by doc_id, later, span""",
    "op6_language_id": r"""
with n as (select doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' as s from documents),
pos as (select doc_id, lang, s, unnest(range(1, length(s) + 1)) as i from n where length(s) > 2),
g as (select doc_id, lang, substr(s, i, 1) as gram from pos where substr(s, i, 1) <> ' '
      union all select doc_id, lang, substr(s, i, 2) from pos where i < length(s)
      union all select doc_id, lang, substr(s, i, 3) from pos where i < length(s) - 1 and substr(s, i + 1, 1) <> ' '),
c as (select doc_id, lang, gram, count(*) as n from g group by all),
chosen as (select doc_id from documents where doc_id is not null and text is not null and lang is not null
           qualify row_number() over (partition by lang order by md5(doc_id::varchar)) <= 500),
prof as (select lang, gram, row_number() over (partition by lang order by n desc, gram) - 1 as rank
         from (select lang, gram, sum(n) as n from c semi join chosen using (doc_id) where lang is not null group by all)
         qualify rank < 300),
top as (select doc_id, gram, row_number() over (partition by doc_id order by n desc, gram) - 1 as rank from c qualify rank < 300),
langs as (select distinct lang from prof),
dist as (select t.doc_id, l.lang, sum(coalesce(abs(t.rank - p.rank), 300))::bigint as d, count(*)::integer as k
         from top t cross join langs l left join prof p on p.lang = l.lang and p.gram = t.gram group by all),
best as (select doc_id, lang, d, k, row_number() over (partition by doc_id order by d, lang) as r, lead(d) over (partition by doc_id order by d, lang) as second from dist)
select x.doc_id, b.lang as predicted, b.d as distance, coalesce(b.k, 0)::integer as n_grams, b.d / (b.k * 300)::double as score,
       (b.second - b.d) / (b.k * 300)::double as margin, coalesce(b.d / (b.k * 300)::double > 0.72, true) as rejected
from documents x left join best b on b.doc_id = x.doc_id and b.r = 1""",
    "op10_minhash": r"""
with recursive v as (select doc_id, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as words from documents where text is not null and doc_id is not null and text ~ '\S'),
c as (select doc_id, words, min(doc_id) over (partition by words) as rep, count(*) over (partition by words) - 1 as n_copies from v),
w as (select doc_id, words from c where doc_id = rep),
s as (select distinct doc_id, array_to_string(words[i + 1 : i + 3], ' ') as g from (select doc_id, words, unnest(range(0, greatest(len(words) - 2, 1))) as i from w)),
n as (select doc_id, count(*) as n from s group by 1),
f as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from f join n x on x.doc_id = a join n y on y.doc_id = b where common / (x.n + y.n - common)::double >= 0.6),
u as (select a, b from e union all select b, a from e),
reach as (select a as node, a as root from u union select u.b, r.root from reach r join u on u.a = r.node),
class as (select node, min(root) as root from reach group by node),
links as (select a as node, count(*) as n_links from u group by 1)
select d.doc_id, null::varchar as content, coalesce(k.root, c.rep, d.doc_id) as class_id, coalesce(n_links, 0) as n_links, coalesce(n_copies, 0) as n_copies
from documents d left join c on c.doc_id = d.doc_id left join class k on k.node = c.rep left join links l on l.node = c.rep where d.doc_id is not null and d.text is not null""",
}
