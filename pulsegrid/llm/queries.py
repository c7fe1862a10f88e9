"""The registered query of each operator, with its oracle SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pulsegrid.llm.cutting_stock import pack_patterns
from pulsegrid.llm.decontaminate import contaminated_spans, judged
from pulsegrid.llm.hard_negatives import mine
from pulsegrid.llm.hard_negatives import usable as labelled_vectors
from pulsegrid.llm.hmm_lm import score_documents
from pulsegrid.llm.html_text import main_text, weights
from pulsegrid.llm.language_id import identified, labelled_part
from pulsegrid.llm.license_scan import LEAST, LICENSE_FILE, STOP, TEMPLATES, license_scan
from pulsegrid.llm.ngram_join import similar_documents
from pulsegrid.llm.numbered import numbered
from pulsegrid.llm.packing import pack, pieces
from pulsegrid.llm.prefix_trie import trie
from pulsegrid.llm.substring_dedup import repeated_passages
from pulsegrid.llm.token_files import read_token_files, write_token_files
from pulsegrid.llm.vp_search import nearest, usable
from pulsegrid.session import cut_lineage


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_tokens(spark, sf_dir):
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "dropped", 2)
    return read_token_files(manifest)


def q_hmm(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


def q_nearest(spark, sf_dir):
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def q_ngram_join(spark, sf_dir):
    found = similar_documents(numbered(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "class_id", "n_links")


def language_of(docs):
    return identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def q_language(spark, sf_dir):
    found = language_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", labelled_part().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def q_substring_dedup(spark, sf_dir):
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = docs.select("__row", "doc_id")
    found = repeated_passages(docs).join(ids.withColumnRenamed("__row", "row"), "row").drop("row")
    found = found.join(ids.select(F.col("__row").alias("of"), F.col("doc_id").alias("of_doc_id")), "of")
    return found.select("doc_id", F.col("first").alias("first_word"), (F.col("last") - F.col("first") + 1).alias("n_words"), "of_doc_id", F.col("of_first").alias("of_first_word"))


def q_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, weights(pages)).select("page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))


def q_license_scan(spark, sf_dir):
    """The documents as a file tree: sources hold directories of 1,000 and of 100 documents, each hundredth document is a licence file."""
    i = F.col("doc_id")
    name = F.when(i % 100 == 0, "LICENSE").otherwise(F.concat(F.lit("doc"), i.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(i / 1000).cast("string"), F.floor(i % 1000 / 100).cast("string"), name)
    files = table(spark, sf_dir, "documents").select(i.alias("__file"), path.alias("path"), "text")
    return license_scan(files).withColumnRenamed("__file", "doc_id")


def packed(docs):
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), "kept", 0))


def q_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


def q_pattern_packing(spark, sf_dir):
    return pack_patterns(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "kept", 1).drop("ids")


def q_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cut_lineage(labelled_vectors(table(spark, sf_dir, "embeddings"), label))
    return mine(rows, rows.filter(F.col("vec_id") % 50 == 0))


def q_trie(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations"))


def q_decontaminate(spark, sf_dir):
    return judged(contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


# words of a text, lower-cased A-Z only
def sql_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATE_SQL = f"""
with d as (select doc_id, {sql_words('text')} as w from documents),
b as (select item_id, {sql_words('text')} as w from benchmark),
bw as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from b where len(w) > 0)
),
sizes as (select distinct n from bw),
dw as (
  select doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)
),
m as (select distinct doc_id, item_id, n, s from dw join bw using (n, win)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from m) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(i, ',' order by i)) as items_sha256 from (select distinct doc_id, cast(item_id as varchar) as i from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


def sql_license_words(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    return f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda w: w <> '' and w not in ({stop}))"


LICENSE_SQL = f"""
with recursive t as (select * from (values {', '.join(f"('{k}', '{v}')" for k, v in TEMPLATES)}) as v(license, template)),
tw as (select license, word, count(*) as tf from (select license, unnest({sql_license_words('template')}) as word from t) group by all),
f as (
  select doc_id, text, source || '/' || (doc_id // 1000) || '/' || (doc_id % 1000 // 100) || '/' || (case when doc_id % 100 = 0 then 'LICENSE' else 'doc' || doc_id || '.txt' end) as path from documents
),
fw as (select distinct doc_id, word from (select doc_id, unnest({sql_license_words('text')}) as word from f)),
df as (select word, count(*) as df from fw group by word),
total as (select count(*) as n from f),
tv as (select license, word, tf * (ln((n + 1.0) / (coalesce(df, 0) + 1)) + 1) as w, ln((n + 1.0) / (coalesce(df, 0) + 1)) + 1 as idf from tw left join df using (word), total),
unit as (select license, word, w / sqrt(sum(w * w) over (partition by license)) as weight from tv),
units as (
  select doc_id, path, i - 1 as line, lines[i] as x from (
    select doc_id, path, lines, unnest(range(1, len(lines) + 1)) as i from (
      select doc_id, path, case when regexp_matches(lower(regexp_extract(path, '[^/]*$')), '{LICENSE_FILE}') then [text] else string_split(text, chr(10)) end as lines from f
    )
  )
),
uw as (select doc_id, line, word, count(*) as tf from (select doc_id, line, unnest({sql_license_words('x')}) as word from units) group by all),
uv as (select doc_id, line, uw.word, uw.tf * coalesce(idf, ln(n + 1.0) + 1) as w from uw left join (select distinct word, idf from tv) k on k.word = uw.word, total),
len as (select doc_id, line, sqrt(sum(w * w)) as l from uv group by all),
sc as (select doc_id, line, license, round(sum(w * weight) / any_value(l), 6) as score from uv join unit using (word) join len using (doc_id, line) group by all having score >= {LEAST}),
own as (select doc_id, license as own_license, score as own_score from sc qualify row_number() over (partition by doc_id order by score desc, line, license) = 1),
grant_ as (
  select dir, own_license as license from (select regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, own_license, own_score from own join f using (doc_id) where path like '%/LICENSE')
  qualify row_number() over (partition by dir order by own_score desc, own_license) = 1
),
up as (
  select doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, 0 as step from f
  union all select doc_id, case when dir like '%/%' then regexp_extract(dir, '^(.*)/[^/]*$', 1) else '' end, step + 1 from up where dir <> ''
),
given as (select doc_id, license, dir from up join grant_ using (dir) qualify row_number() over (partition by doc_id order by step) = 1)
select f.doc_id, path, own_license, own_score, coalesce(own_license, given.license) as license, case when own_license is null then given.dir end as license_dir
from f left join own using (doc_id) left join given using (doc_id)
"""

NGRAM_JOIN_SQL = f"""
with recursive d as (select doc_id, {sql_words('text')} as w from documents),
sh as (
  select distinct doc_id, array_to_string(list_slice(w, s, s + 4), ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as s from d where len(w) > 0)
),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by all
),
l as (select x, y from p join n as i on i.doc_id = x join n as j on j.doc_id = y where 9 * c >= 4 * (i.n + j.n)),
reach as (select doc_id as x, doc_id as y from d union select reach.x, l.y from reach join l on l.x = reach.y),
cls as (select x as doc_id, min(y) as class_id from reach group by x)
select cls.doc_id, class_id, (select count(*) from l where l.x = cls.doc_id) as n_links from cls
"""

NEAREST_SQL = """
with e as (
  select vec_id, [x::double for x in embedding] as v from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from e q join e c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 20
"""

HARD_NEGATIVES_SQL = """
with e as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(256 * x::double) as double) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
),
s as (
  select a.r as ar, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id % 50 = 0 and a.r <> b.r and len(a.v) = len(b.v)
),
p as (select *, row_number() over (partition by ar order by score desc, vec_id) as place from s where same qualify place <= 5)
select p.anchor_id, p.vec_id as positive_id, cast(row_number() over (partition by p.ar, place order by n.score desc, n.vec_id) as integer) as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.ar = p.ar and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify rank <= 3
"""

# unsigned crc32 of a decimal number, bit by bit
SQL_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(c::varchar) + 1), lambda i: ascii((c::varchar)[i])::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

TRIE_SQL = f"""
with t as (select conv_id as c, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
o as (select c, list({{'r': r, 'x': x}} order by turn nulls first, md5(concat(md5(r), x))) as ts from t group by c),
oh as (select c, ts, {SQL_CRC} % 4 as h from o),
rb as (
  select oh.c, list_concat(coalesce(list_slice(b.ts, 1, h), []), list_slice(oh.ts, h + 1, len(oh.ts))) as ts
  from oh left join o b on b.c = oh.c - oh.c % 20
),
mem as (select c, d, list_slice(ts, 1, d) as k, d = len(ts) as is_end from (select c, ts, unnest(range(0, len(ts) + 1)) as d from rb)),
node as (
  select d, k, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (is_end), '')) as ends_sha256,
    case when d = 0 then 0 else len(regexp_extract_all(k[d].x, '[^\\x20\\x09-\\x0D]+')) end as words
  from mem group by d, k
),
kid as (select list_slice(k, 1, d - 1) as k, d - 1 as d, count(*) as n from node where d > 0 group by all),
tot as (
  select list_slice(k, 1, e) as k, e as d, sum((n_convs - 1) * words) as saved_tokens, count(*) filter (n = 0) as n_leaves
  from (select node.d, node.k, n_convs, words, coalesce(n, 0) as n, unnest(range(0, node.d + 1)) as e from node left join kid using (d, k)) group by all
)
select node.conv_id, node.d as depth, p.conv_id as parent_conv_id, node.n_convs, coalesce(kid.n, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, node.ends_sha256
from node left join node p on p.d = node.d - 1 and p.k = list_slice(node.k, 1, node.d - 1) left join kid on kid.d = node.d and kid.k = node.k join tot on tot.d = node.d and tot.k = node.k
"""

QUERIES = {
    "op1_substring_dedup": (q_substring_dedup, None),
    "op2_token_files": (q_tokens, None),
    "op3_language_id": (q_language, None),
    "op4_license_scan": (q_license_scan, LICENSE_SQL),
    "op5_ngram_join": (q_ngram_join, NGRAM_JOIN_SQL),
    "op6_packing": (q_packing, None),
    "op7_html_text": (q_html_text, None),
    "op8_decontaminate": (q_decontaminate, DECONTAMINATE_SQL),
    "op9_vp_search": (q_nearest, NEAREST_SQL),
    "op10_hmm_lm": (q_hmm, None),
    "op11_cutting_stock": (q_pattern_packing, None),
    "op12_hard_negatives": (q_hard_negatives, HARD_NEGATIVES_SQL),
    "op13_prefix_trie": (q_trie, TRIE_SQL),
}
