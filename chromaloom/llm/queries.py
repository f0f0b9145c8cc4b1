"""The thin queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm import bpe_transducer, decontamination, importance, language_model, lexical, line_dedup, quality, secrets, simhash, token_counts, topk, toxicity, warc
from chromaloom.llm.common import id_remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the Pitman-Yor model of the training documents."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a factorisation machine fitted on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit_machine(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs.select("doc_id", "text", "n_chars"), machine)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a WARC record per page with its index, and read all records back by coalesced ranges."""
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(pages)
    index = warc.write_archives(pages, folder)
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of benchmark windows."""
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the byte-level vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)

def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and how many of them are boilerplate of its source."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector against all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by the base patterns and the Markov ratio."""
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.MarkovRatio(*secrets.labelled_samples(docs)))


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the transducer, and the digest of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_transducer.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).drop("same_text")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and the tenth that is drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a recurrent network fitted on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    network = toxicity.fit_network(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), network)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_language_model": op1_language_model,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_topk": op7_topk,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_bpe_transducer": op10_bpe_transducer,
    "op11_importance": op11_importance,
    "op12_toxicity": op12_toxicity,
    "op13_lexical": op13_lexical,
}

_OP3 = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) || '0' as hex
  from pages where page_id is not null),
k as (select *, max(page_id) over (partition by html) as keeper from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(((((strpos('0123456789abcdef', substr(hex, cast(i * 5 // 4 as int) + 1, 1)) - 1) * 16
         + strpos('0123456789abcdef', substr(hex, cast(i * 5 // 4 as int) + 2, 1)) - 1) >> cast(3 - (i * 5) % 4 as int)) & 31) as int) + 1, 1)), '') as payload_digest,
  case when keeper = page_id then 'response' else 'revisit' end as record_type,
  case when keeper = page_id then null else keeper end as refers_to
from k
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP4 = f"""
with d as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as w from benchmark),
bw as (
  select distinct item, size, array_to_string(list_slice(w, k, k + size - 1), ' ') as words
  from (select item, w, size, unnest(range(1, len(w) - size + 2)) as k from (select *, least(10, len(w)) as size from b where len(w) > 0))),
sizes as (select distinct size from bw),
dw as (
  select row, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') as words
  from (select row, w, size, unnest(range(1, len(w) - size + 2)) as k from d, sizes where len(w) >= size)),
m as (select dw.row, dw.size, dw.k, bw.item from dw join bw on dw.size = bw.size and dw.words = bw.words),
hit as (select row, count(distinct k) as n_hit from (select row, unnest(range(k, k + size)) as k from m) group by row),
items as (select row, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct row, item from m) group by row)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (row) left join items using (row)
"""

_OP6 = f"""
with d as (select row_number() over () as row, doc_id, coalesce(source, '') as host, text, string_split(text, chr(10)) as lines from documents),
l as (select row, doc_id, host, unnest(lines) as line, unnest(range(len(lines))) as k from d where text is not null),
pages as (select host, count(*) as pages from d group by host),
held as (select host, trim(line) as line, count(distinct row) as holding from l where trim(line) <> '' group by 1, 2),
plate as (select host, line from held join pages using (host) where holding > cast({line_dedup.RATIO} as double) * pages and holding >= {line_dedup.MIN_PAGES}),
marked as (select l.*, plate.line is not null as dropped from l left join plate on l.host = plate.host and trim(l.line) = plate.line),
sums as (
  select row, count(*) as n_lines, count_if(dropped) as n_dropped, string_agg(case when not dropped then line end, chr(10) order by k) as kept
  from marked group by row)
select doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_dropped, 0) as bigint) as n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from d left join sums using (row)
"""

_OP7 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, unnest(x) as a, unnest(range(len(x))) as k from v where vec_id % 50 = 0),
c as (select vec_id, unnest(x) as b, unnest(range(len(x))) as k from v),
s as (select query_id, vec_id, cast(sum(a * b) as bigint) as score from q join c using (k) where query_id <> vec_id group by query_id, vec_id)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

#: CRC-32 of a word from a table of the 256 steps of one byte; DuckDB has no function for it.
_OP11 = f"""
with steps as materialized (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
d as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
b as (select {_WORDS} as w from benchmark),
dw as materialized (select row, word, count(*) as n from (select row, unnest(w) as word from d) group by 1, 2),
bw as materialized (select word, count(*) as n from (select unnest(w) as word from b) group by 1),
hexed as (select word, hex(encode(word)) as x from (select word from dw union select word from bw)),
buckets as materialized (
  select word, xor(list_reduce(list_transform(range(len(x) // 2), lambda k: (strpos('0123456789ABCDEF', substr(x, cast(2 * k + 1 as int), 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, cast(2 * k + 2 as int), 1)) - 1),
    lambda c, y: xor(c >> 8, t[cast((xor(c, y) & 255) + 1 as int)]), 4294967295), 4294967295) % 10000 as bucket
  from hexed, steps),
s as (select bucket, sum(n) as s from dw join buckets using (word) group by 1),
t as (select bucket, sum(n) as t from bw join buckets using (word) group by 1),
gains as materialized (
  select bucket, cast(floor(1000 * ln(cast((coalesce(t, 0) + 1) * ((select coalesce(sum(n), 0) from dw) + 10000) as double) / cast((coalesce(s, 0) + 1) * ((select coalesce(sum(n), 0) from bw) + 10000) as double))) as bigint) as gain
  from s full join t using (bucket)),
weights as (select row, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as weight from dw join buckets using (word) join gains using (bucket) group by row),
h as (select row, doc_id, substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as x from d),
scored as (
  select row, doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((list_reduce(list_transform(range(8), lambda k: cast(strpos('0123456789abcdef', substr(x, cast(k + 1 as int), 1)) - 1 as bigint)), lambda u, v: u * 16 + v) + 0.5e0) / 4294967296e0))) as bigint) as score
  from h left join weights using (row)),
placed as (select *, n_features >= 20 as eligible, row_number() over (order by n_features >= 20 desc, score desc, doc_id) as place from scored)
select doc_id, n_features, weight, score, case when place <= (select count(*) from scored where n_features >= 20) * 10 // 100 then place end as rank from placed
"""

_OP13 = f"""
with d as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
e as (select row, doc_id, cast(len(w) as bigint) as n from d where len(w) > 0),
c as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as all_terms from e),
q as (select distinct item_id, unnest({_WORDS}) as term from benchmark),
tf as materialized (select row, term, count(*) as tf from (select row, unnest(w) as term from d) where term in (select term from q) group by 1, 2),
w as (select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from (select term, count(*) as df from tf group by 1), c),
s as (
  select item_id, doc_id, row, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // all_terms))))) as bigint) as score
  from q join tf using (term) join w using (term) join e using (row), c group by 1, 2, 3)
select item_id, cast(rank as int) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
"""

#: DuckDB text for the queries that SQL can express.
ORACLE: dict[str, str] = {"op3_warc": _OP3, "op4_decontamination": _OP4, "op6_line_dedup": _OP6, "op7_topk": _OP7, "op11_importance": _OP11, "op13_lexical": _OP13}
