"""Queries over intervals, sequences and numbers, each with its DuckDB check."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chromaloom.functions import intervals as I
from chromaloom.functions import numbers as N
from chromaloom.functions import sequences as S
from chromaloom.plans.adapters import duckdb_text, view
from chromaloom.sources import records as R

_PAIRED = "select id as id1, chr_id, a as a1, b as b1, lead(id) over w as id2, lead(chr_id) over w as chr2, lead(a) over w as a2, lead(b) over w as b2 from intervals window w as (partition by id % 50 order by id)"


def _paired(s, d):
    w = Window.partitionBy(F.col("id") % 50).orderBy("id")
    rows = view(s, d, "intervals")
    cols = [F.lead(c).over(w).alias(n) for c, n in (("id", "id2"), ("chr_id", "chr2"), ("a", "a2"), ("b", "b2"))]
    return rows.select(F.col("id").alias("id1"), "chr_id", F.col("a").alias("a1"), F.col("b").alias("b1"), *cols).where("id2 is not null")


def _pair(function):
    def query(s, d):
        return _paired(s, d).select("id1", *function(F.col("chr_id") == F.col("chr2"), *(F.col(c) for c in ("a1", "b1", "a2", "b2"))))

    return query


def _sides(s, d):
    rows = view(s, d, "intervals")
    left = rows.where("cn = 0").select("chr_id", F.col("id").alias("id1"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    right = rows.where("cn = 1").select("chr_id", F.col("id").alias("id2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return left, right


def _lookup(s, d):
    rows = view(s, d, "intervals")
    points = rows.select(F.col("id").alias("pid"), "chr_id", (F.col("a") + 300).alias("pos"))
    return I.point_lookup(points, rows.where("cn > 0").select("chr_id", "a", "b", "cn"), "chr_id")


def _texts(s, d):
    rows = view(s, d, "intervals").select("id", F.concat(F.lit("chr"), F.col("chr_id")).alias("c"), "a", "b")
    text = I.as_text(F.col("c"), F.col("a"), F.col("b"))
    back = I.parsed(text)
    return rows.select("id", text.alias("colon"), I.as_dashed(F.col("c"), F.col("a"), F.col("b")).alias("dashed"), I.as_bed(F.col("c"), F.col("a"), F.col("b")).alias("bed"), back["chrom"].alias("chrom"), back["start"].alias("start"), back["stop"].alias("stop"))


def _seqs(s, d):
    return view(s, d, "sequences")


def _complement(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.translate(F.md5(F.col("doc_id").cast("string")), "0123456789abcdef", "ACGTRYKMSWBDHVNa").alias("seq"))
    return rows.select("doc_id", S.reverse_complement(F.col("seq")).alias("rc"))


def _extent(s, d):
    rows = view(s, d, "intervals").withColumn("p", F.col("a") - 40 + F.col("id") % 700)
    e = I.extended(F.col("a"), F.col("b"), F.col("p"))
    return rows.select("id", e["start"].alias("start"), e["stop"].alias("stop"))


def _grown(s, d):
    turned = F.col("hit") % 3 == 0
    hits = view(s, d, "hits").select("query_id", "target", (F.col("hit") * 10000 + F.col("q_start")).alias("hit"), F.when(turned, F.col("q_end")).otherwise(F.col("q_start")).alias("t_start"), F.when(turned, F.col("q_start")).otherwise(F.col("q_end")).alias("t_end"))
    return I.grown_region(hits, view(s, d, "contigs").select(F.col("tid").alias("query_id"), F.lit(2500).alias("size")))


def _fasta_sizes(s, d):
    """Conversations as sequences of a FASTA file: a header each, a line a turn."""
    rows = s.read.parquet(f"{d}/conversations.parquet")
    body = rows.select(F.lit("f").alias("file"), F.struct("conv_id", (F.col("turn") + 1).cast("long").alias("turn")).alias("row_no"), F.concat(F.lit("s"), F.translate(F.coalesce("text", F.lit("")), "\n", " "), F.lit("e")).alias("value"))
    heads = rows.select("conv_id").distinct().select(F.lit("f").alias("file"), F.struct("conv_id", F.lit(-1).cast("long").alias("turn")).alias("row_no"), F.concat(F.lit(">c"), "conv_id", F.lit(" x")).alias("value"))
    return R.fasta_sizes(body.unionByName(heads)).select("name", "size")


def _haplotypes(s, d):
    rows = view(s, d, "intervals").select("chr_id", "a", "b", F.floor((F.col("cn") + 1) / 2).cast("int").alias("major"), F.floor(F.col("cn") / 2).cast("int").alias("minor"))
    return I.haplotype_calls(rows, "chr_id", "a", "b", 20)


_HRCN = """select chr_id, min(a) as start, max(b) as stop, major + minor as cn, major, minor from (
  select *, sum(new) over (partition by chr_id, run order by a, b) as island from (
    select *, case when a - 20 <= max(b) over (partition by chr_id, run order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from (
      select *, sum(change) over (partition by chr_id order by a, b, major, minor rows unbounded preceding) as run from (
        select *, case when major = lag(major) over w and minor = lag(minor) over w then 0 else 1 end as change
        from (select distinct on (chr_id, a, b, cn) chr_id, a, b, cast((cn + 1) // 2 as int) as major, cast(cn // 2 as int) as minor from intervals) x window w as (partition by chr_id order by a, b, major, minor)) y) z) u) v
  group by chr_id, run, island, major, minor"""

REGISTRY = {
    "interval_overlap_join": (lambda s, d: I.overlap_join(*_sides(s, d), "chr_id").select("id1", "id2", "start", "stop"), duckdb_text("""select x.id as id1, y.id as id2, greatest(x.a, y.a) as start, least(x.b, y.b) as stop
      from intervals x join intervals y on x.chr_id = y.chr_id and x.a < y.b and y.a < x.b where x.cn = 0 and y.cn = 1""")),
    "cn_lookup": (_lookup, duckdb_text("""select p.id as pid, p.chr_id, p.a + 300 as pos, coalesce((select arg_min(c.cn, {'a': c.a, 'b': c.b, 'c': c.cn}) from intervals c where c.cn > 0 and c.chr_id = p.chr_id and c.a <= p.a + 300 and c.b > p.a + 300), -1) as cn from intervals p""")),
    "interval_contains": (_pair(lambda same, a, b, c, d: [(same & I.contains(a, b, c, d)).alias("whole"), (same & I.contains_point(a, b, c)).alias("point")]), duckdb_text("select id1, chr_id = chr2 and a2 >= a1 and b2 <= b1 as whole, chr_id = chr2 and a2 >= a1 and a2 < b1 as point from p where id2 is not null", p=_PAIRED)),
    "interval_overlaps": (_pair(lambda same, a, b, c, d: [(same & I.overlaps(a, b, c, d)).alias("shared"), (same & I.abuts(a, b, c, d)).alias("touching")]), duckdb_text("select id1, chr_id = chr2 and a1 < b2 and a2 < b1 as shared, chr_id = chr2 and (a1 = b2 or a2 = b1) as touching from p where id2 is not null", p=_PAIRED)),
    "interval_distance": (_pair(lambda same, a, b, c, d: [I.distance(same, a, b, c, d).cast("bigint").alias("between")]), duckdb_text("select id1, cast(case when chr_id <> chr2 then -1 else greatest(greatest(a1, a2) - least(b1, b2), 0) end as bigint) as between from p where id2 is not null", p=_PAIRED)),
    "interval_intersection": (_pair(lambda same, a, b, c, d: [F.when(same, I.intersection(a, b, c, d)["start"]).alias("start"), F.when(same, I.intersection(a, b, c, d)["stop"]).alias("stop")]), duckdb_text("select id1, case when s then greatest(a1, a2) end as start, case when s then least(b1, b2) end as stop from (select *, chr_id = chr2 and a1 < b2 and a2 < b1 as s from p where id2 is not null) x", p=_PAIRED)),
    "interval_union": (_pair(lambda same, a, b, c, d: [F.when(same, I.union(a, b, c, d, False)["start"]).alias("start"), F.when(same, I.union(a, b, c, d, False)["stop"]).alias("stop"), F.when(same, I.union(a, b, c, d, True)["start"]).alias("wide_start"), F.when(same, I.union(a, b, c, d, True)["stop"]).alias("wide_stop")]),
      duckdb_text("select id1, case when s then least(a1, a2) end as start, case when s then greatest(b1, b2) end as stop, case when chr_id = chr2 then least(a1, a2) end as wide_start, case when chr_id = chr2 then greatest(b1, b2) end as wide_stop from (select *, chr_id = chr2 and a1 <= b2 and a2 <= b1 as s from p where id2 is not null) x", p=_PAIRED)),
    "interval_extend": (_extent, duckdb_text("select id, least(a, a - 40 + id % 700) as start, greatest(b, a - 40 + id % 700) as stop from intervals")),
    "interval_text": (_texts, duckdb_text("select id, 'chr' || chr_id || ':' || a || '-' || b as colon, 'chr' || chr_id || '-' || a || '-' || b as dashed, 'chr' || chr_id || chr(9) || a || chr(9) || b as bed, 'chr' || chr_id as chrom, a as start, b as stop from intervals")),
    "merge_islands": (lambda s, d: I.merged(view(s, d, "intervals"), "chr_id", "a", "b"), duckdb_text("""select chr_id, min(a) as start, max(b) as stop, count(*) as n from (select *, sum(new) over (partition by chr_id order by a, b, id) as island from (
      select *, case when a <= max(b) over (partition by chr_id order by a, b, id rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from intervals) x) y group by chr_id, island""")),
    "merge_equal_calls": (lambda s, d: I.merged(view(s, d, "intervals"), "chr_id", "a", "b", gap=20, same=["cn"]), duckdb_text("""select chr_id, cn, min(a) as start, max(b) as stop, count(*) as n from (select *, sum(new) over (partition by chr_id, cn order by a, b, id) as island from (
      select *, case when a - 20 <= max(b) over (partition by chr_id, cn order by a, b, id rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from intervals) x) y group by chr_id, cn, island""")),
    "hrcn_calls": (_haplotypes, duckdb_text(_HRCN)),
    "hrcn_stats": (lambda s, d: _haplotypes(s, d).groupBy("chr_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("len")), duckdb_text("select chr_id, count(*) as n, cast(sum(stop - start) as bigint) as len from h group by 1", h=_HRCN)),
    "merge_windows": (lambda s, d: I.windows_of(view(s, d, "intervals"), "chr_id", "a", "b", 25), duckdb_text("""select chr_id, start, stop from (select *, row_number() over (order by chr_id desc, w desc) as back from (
      select chr_id, w, min(a) as start, max(b) as stop from (select *, (row_number() over (partition by chr_id order by a, b) - 1) // 25 as w from intervals) x group by 1, 2) y) z where back > 1""")),
    "cn_stats": (lambda s, d: I.call_stats(view(s, d, "intervals"), "chr_id", "a", "b", "cn"), duckdb_text("select chr_id, cn, count(*) as n, cast(sum(b - a) as bigint) as len from intervals group by 1, 2")),
    "interval_sort": (lambda s, d: view(s, d, "intervals").orderBy("chr_id", "a", "b", "id").select("id", "chr_id", "a", "b"), duckdb_text("select id, chr_id, a, b from intervals order by chr_id, a, b, id")),
    "best_target": (lambda s, d: I.best_target(view(s, d, "hits")), duckdb_text("""select query_id, target, best_len, unique_len, cast(best_len as double) / unique_len as specificity from (
      select query_id, target, n as best_len, cast(sum(n) over (partition by query_id) as bigint) as unique_len, row_number() over (partition by query_id order by n desc, target) as k from (
        select query_id, target, count(*) as n from (select query_id, base, min(target) as target from (select query_id, target, unnest(range(q_start, q_end)) as base from hits) x group by 1, 2 having count(*) = 1) y group by 1, 2) z) u where k = 1""")),
    "grow_region": (_grown, None),
    "motif_count": (lambda s, d: _seqs(s, d).select("sid", S.motif_count(F.col("seq"), "THRE_ANDT").cast("bigint").alias("n")), duckdb_text("select sid, cast(len(regexp_extract_all(seq, 'T[ACT][AG]E')) + len(regexp_extract_all(seq, 'A[ACGT][AGT]T')) as bigint) as n from sequences")),
    "motif_windows": (lambda s, d: S.motif_windows(_seqs(s, d), "sid", "seq", "EE", 30).select("sid", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop")), duckdb_text("""select sid, greatest(min(p) - 30, 0) as start, least(max(p) + 30, max(length(seq))) as stop from (
      select *, sum(new) over (partition by sid order by p) as island from (select *, case when p - lag(p) over (partition by sid order by p) <= 60 then 0 else 1 end as new from (
        select sid, seq, cast(list_sum(list_slice(lens, 1, k)) as bigint) + 2 * (k - 1) as p from (select sid, seq, list_transform(string_split(seq, 'EE'), lambda x: length(x)) as lens from sequences) a, lateral (select unnest(range(1, len(lens))) as k) b) c) e) f group by sid, island""")),
    "reverse_complement": (_complement, duckdb_text("select doc_id, translate(reverse(translate(md5(cast(doc_id as STR)), '0123456789abcdef', 'ACGTRYKMSWBDHVNa')), 'ACGTRYKMSWBDHVNa', 'TGCAYRMKSWVHDBNt') as rc from documents")),
    "wrapped_lines": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").where("length(text) > 0").select("doc_id", F.md5(S.wrapped(F.regexp_replace("text", "\n", " "), 80)).alias("md5")), duckdb_text("select doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '(.{80})', '\\1' || chr(10), 'g'), chr(10) || '$', '')) as md5 from documents where length(text) > 0")),
    "fasta_sizes": (_fasta_sizes, duckdb_text("select 'c' || conv_id as name, cast(sum(length(coalesce(text, '')) + 2) as bigint) as size from conversations group by 1")),
    "n50": (lambda s, d: N.n50(view(s, d, "contigs"), "len"), duckdb_text("""select case when 2 * cum = total and nx is not null then (v + nx) // 2 else v end as n50 from (
      select v, sum(v) over w as cum, sum(v) over () as total, lead(v) over w as nx, row_number() over w as k from (select len as v, tid from contigs) x window w as (order by v desc, tid rows unbounded preceding)) y where 2 * cum >= total order by k limit 1""")),
    "pearson": (lambda s, d: N.pearson(view(s, d, "intervals").selectExpr("a", "case when id % 7 = 0 then double('nan') else double(b) end as y"), "a", "y").select(F.round("r", 9).alias("r")), duckdb_text("select round(corr(cast(a as double), cast(b as double)), 9) as r from intervals where id % 7 <> 0")),
    "logsumexp": (lambda s, d: view(s, d, "intervals").select("id", F.round(N.log_sum_exp(F.when(F.col("id") % 5 == 0, F.lit(float("-inf"))).otherwise(-F.col("a") / 1000.0), -F.col("b") / 1000.0), 9).alias("v")), duckdb_text("select id, round(case when id % 5 = 0 then -b / 1000.0e0 else ln(exp(-a / 1000.0e0) + exp(-b / 1000.0e0)) end, 9) as v from intervals")),
    "normalise_counts": (lambda s, d: N.normalised_counts(view(s, d, "observations").groupBy("symbol").count(), "symbol", "count"), duckdb_text("select symbol, count(*) / cast((select count(*) from observations) as double) as p from observations group by 1")),
    "int_ranges": (lambda s, d: N.int_ranges(view(s, d, "clusters"), "cluster_id", "tid"), duckdb_text("""select cluster_id, '[' || string_agg(case when x = y then cast(x as STR) else x || '-' || y end, ',' order by x) || ']' as ranges from (
      select cluster_id, min(tid) as x, max(tid) as y from (select *, tid - row_number() over (partition by cluster_id order by tid) as g from clusters) a group by cluster_id, g) b group by 1""")),
    "probability_check": (lambda s, d: N.checked_probabilities(s.read.parquet(f"{d}/part.parquet").select("p_brand", (F.col("p_size") / 1000.0).alias("p")), "p_brand", "p"), duckdb_text("select p_brand, min(p_size) >= 0 and abs(sum(p_size / 1000.0e0) - 1) <= 1e-6 as ok from part group by 1")),
}
