"""Queries over orderings and the reference placement, each with its DuckDB check."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaloom.operators import links as L
from chromaloom.operators import orderings as O
from chromaloom.operators import truth as T
from chromaloom.plans.adapters import duckdb_text, view
from chromaloom.plans.link_queries import GLM, GROUPED, LOCAL, NORM, grouped, norm

CELLS = """select q.cluster_id, l.c1, l.rc1, l.c2, l.rc2, l.dist from (
  select g.*, r1, r2, 100 + case when r1 then pos1 else a.len - pos1 end + case when r2 then b.len - pos2 else pos2 end as dd from grouped g join contigs a on tid1 = a.tid join contigs b on tid2 = b.tid
    cross join (values (true), (false)) x(r1) cross join (values (true), (false)) y(r2) where c1 <> c2) q,
  lateral (select q.c1, q.r1 as rc1, q.c2, q.r2 as rc2, q.dd as dist union all select q.c2, not q.r2, q.c1, not q.r1, q.dd) l(c1, rc1, c2, rc2, dist)"""
ORD = "select o.*, k.len, sum(k.len) over (partition by o.cluster_id order by o.pos) as cum, l.local_id from ordering o join contigs k on o.tid = k.tid join local l on l.tid = o.tid"
BETWEEN = "select c.cluster_id, c.dist, b.len, b.cum - b.len - a.cum as gap from cells c join ord a on a.cluster_id = c.cluster_id and a.local_id = c1 and a.rc = rc1 join ord b on b.cluster_id = c.cluster_id and b.local_id = c2 and b.rc = rc2 where a.pos < b.pos"
FORWARD = BETWEEN.replace("and a.rc = rc1", "and not rc1").replace("and b.rc = rc2", "and not rc2")
CHAIN = {"local": LOCAL, "grouped": GROUPED, "cells": CELLS, "ord": ORD}
FLAGS = """select cluster_id, tid, pos, q is null or q >= 3 as high_quality, chrom is null as unaligned,
  coalesce(chrom <> lag(chrom) over w, false) or coalesce(chrom <> lead(chrom) over w, false) as chr_mismatch,
  coalesce(chrom = lag(chrom) over w, false) and case when trc <> rc then go = 1 else go = -1 end as orient_error,
  coalesce(chrom = lag(chrom) over w and chrom = lead(chrom) over w and go <> 0 and lead(go) over w <> 0 and go <> lead(go) over w, false) as order_error
  from (select o.*, t.chrom, t.rc as trc, case when t0 > lag(t0) over v and t1 > lag(t1) over v then 1 when t0 < lag(t0) over v and t1 < lag(t1) over v then -1 else 0 end as go
    from ordering o join truth t on o.tid = t.tid window v as (partition by cluster_id order by pos)) x window w as (partition by cluster_id order by pos)"""
_SEQ = "translate(md5(name), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def cells(s, d):
    return L.oriented_distances(grouped(s, d), view(s, d, "contigs"))


def heatmap_cells(s, d):
    contigs = view(s, d, "contigs")
    # links of contigs that are plotted only: the others' are neither summed nor moved
    plotted = O.top_contigs(contigs, O.PLOT_N).select("tid")
    pairs = view(s, d, "pairs")
    for k in ("tid1", "tid2"):
        pairs = pairs.join(plotted.withColumnRenamed("tid", k), k, "left_semi")
    links = L.mirrored(L.normalise(L.half_matrix(pairs), contigs).withColumnsRenamed({"i": "a", "j": "b"}))
    return O.heatmap_cells(links, view(s, d, "ordering"), contigs, O.PLOT_N)


def _scored(function, column):
    return lambda s, d: function(cells(s, d), view(s, d, "ordering"), view(s, d, "clusters"), view(s, d, "contigs")).withColumn(column, F.round(column, 6))


def flags(s, d):
    return O.error_flags(view(s, d, "ordering"), view(s, d, "truth"), 3.0)


def _v(names, function):
    return lambda s, d: function(*(view(s, d, n) for n in names.split()))


def _gaps(s, d):
    gaps = view(s, d, "ordering").select("cluster_id", "pos", (F.col("tid") * 37 % 5000).alias("gap"))
    return O.gap_errors(view(s, d, "ordering"), view(s, d, "truth"), view(s, d, "contigs"), gaps).withColumn("log_error", F.round("log_error", 9))


def _sizes(s, d):
    return view(s, d, "truth").where("chrom is not null").groupBy("chrom").agg(F.max("t1").alias("size"))


def _names(s, d):
    nations = s.read.parquet(f"{d}/nation.parquet")
    chromosomes = nations.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("chr"), "n_name")).alias("name"), F.col("n_nationkey").alias("chrom_id")).where("chrom_id % 5 <> 0")
    return T.match_names(nations.select(F.col("n_name").alias("name")), chromosomes)


def _placed(s, d):
    sequences = view(s, d, "contigs").select("tid", F.translate(F.md5("name"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    return view(s, d, "ordering").withColumn("gap", F.when(F.col("tid") % 4 > 0, F.col("tid") % 6)), sequences, 10


def _scaffolds(s, d):
    return O.scaffolds(*_placed(s, d)).select("cluster_id", F.md5("seq").alias("md5"), F.length("seq").cast("bigint").alias("size"))


def _scaffold_lines(s, d):
    return O.scaffold_lines(O.scaffold_pieces(*_placed(s, d)))


_ORDERED = ("cluster_id", "tid", "pos", "rc")
_PCT = "select 100.0e0 * count_if(x) / count_if(y) as pct_n, 100.0e0 * sum(case when x then len else 0 end) / sum(case when y then len else 0 end) as pct_len from f"
_KINDS = {"chr_mismatch": ("chr_mismatch", "not unaligned"), "order_error": ("order_error", "not unaligned"), "order_error_hq": ("order_error and high_quality", "high_quality"), "orient_error": ("orient_error", "not unaligned"), "orient_error_hq": ("orient_error and high_quality", "high_quality")}
_CHART = " union all ".join("select '" + k + "' as kind, * from (" + _PCT.replace("count_if(x)", f"count_if({x})").replace("count_if(y)", f"count_if({y})").replace("when x", f"when {x}").replace("when y", f"when {y}") + ")" for k, (x, y) in _KINDS.items())
_FL = "select g.*, k.len, k.re from flags g join contigs k on g.tid = k.tid"

def _gap_correlations(s, d):
    ordering, contigs = view(s, d, "ordering"), view(s, d, "contigs")
    gaps = ordering.select("cluster_id", "pos", (500 + 37 * (F.col("pos") % 50)).alias("gap"))
    covariates = contigs.select("tid", ((F.col("tid") % 100) / 100.0).alias("gc"), ((F.col("tid") % 37) / 37.0).alias("mappability"), (0.5 + (F.col("tid") % 11) / 11.0).alias("enrichment"))
    found = O.gap_correlations(O.gap_errors(ordering, view(s, d, "truth"), contigs, gaps), ordering, contigs, covariates)
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("gaps", "gc", "mappability", "enrichment")))


REGISTRY = {
    "has_links": (lambda s, d: L.has_links(cells(s, d), view(s, d, "clusters")), duckdb_text("select cluster_id, cluster_id in (select cluster_id from cells where not rc1 and not rc2 and c1 < c2) as has_links from clusters group by 1", local=LOCAL, grouped=GROUPED, cells=CELLS)),
    "group_repeat_factors": (lambda s, d: L.group_repeat_factors(cells(s, d), view(s, d, "clusters"), view(s, d, "contigs")).withColumn("factor", F.round("factor", 9)), duckdb_text("""select z.cluster_id, z.local_id, round(coalesce(e.n, 0) / (2 * t.total / z.n_contigs), 9) as factor from (select *, count(*) over (partition by cluster_id) as n_contigs from sized) z
      join (select cluster_id, cast(sum(n) as double) as total from w group by 1) t on t.cluster_id = z.cluster_id left join (select cluster_id, c, sum(n) as n from (select cluster_id, c1 as c, n from w union all select cluster_id, c2, n from w) x group by 1, 2) e on e.cluster_id = z.cluster_id and e.c = z.local_id""",
      local=LOCAL, grouped=GROUPED, cells=CELLS, sized="select l.*, k.re, max(k.re) over (partition by cluster_id) as most from local l join contigs k on l.tid = k.tid", w="select c.cluster_id, c1, c2, count(*) * (max(a.most) // max(a.re)) * (max(b.most) // max(b.re)) as n from cells c join sized a on a.cluster_id = c.cluster_id and a.local_id = c1 join sized b on b.cluster_id = c.cluster_id and b.local_id = c2 where not rc1 and not rc2 group by 1, 2, 3")),
    "gap_correlations": (_gap_correlations, duckdb_text("""select count(*) as n, round(corr(ln(tg + 1), ln(gap + 1)), 6) as gaps, round(corr(err, gc), 6) as gc, round(corr(err, mp), 6) as mappability, round(corr(err, ln(en)), 6) as enrichment from (
      select tg, gap, ln((gap + 1) / cast(tg + 1 as double)) as err, (g * len + g1 * l1) / (len + l1) as gc, (m * len + m1 * l1) / (len + l1) as mp, (e * len + e1 * l1) / (len + l1) as en from (
        select *, greatest(n0 - t1, t0 - n1, 100) as tg from (select o.cluster_id, o.pos, 500 + 37 * (o.pos % 50) as gap, t.chrom, t.t0, t.t1, k.len, (k.tid % 100) / 100.0e0 as g, (k.tid % 37) / 37.0e0 as m, 0.5e0 + (k.tid % 11) / 11.0e0 as e, lead(t.chrom) over w as nc, lead(t.t0) over w as n0, lead(t.t1) over w as n1, lead(k.len) over w as l1,
          lead((k.tid % 100) / 100.0e0) over w as g1, lead((k.tid % 37) / 37.0e0) over w as m1, lead(0.5e0 + (k.tid % 11) / 11.0e0) over w as e1 from ordering o join truth t on o.tid = t.tid join contigs k on o.tid = k.tid window w as (partition by o.cluster_id order by o.pos)) x where chrom = nc) y) z""")),
    "ordering_score": (_scored(O.ordering_score, "score"), duckdb_text("select cluster_id, round(sum(1.0e0 / (dist + gap)), 6) as score from x where gap <= 10000000 group by 1", **CHAIN, x=BETWEEN)),
    "unoriented_score": (_scored(O.unoriented_score, "score"), duckdb_text("select cluster_id, round(sum(1.0e0 / (gap + len)), 6) as score from x where gap + len <= 10000000 group by 1", **CHAIN, x=FORWARD)),
    "enrichment_score": (_scored(O.enrichment_score, "enrichment"), duckdb_text("""select o.cluster_id, round(case when members <= 2 or ns is null or nl is null then 0 else coalesce(score, 0) / (ns * (nl / cast(area as double))) end, 6) as enrichment
      from (select distinct cluster_id from ordering) o join (select cluster_id, count(*) as members from clusters group by 1) m using (cluster_id)
      left join (select a.cluster_id, cast(sum(a.len * b.len) as bigint) as area, cast(sum(cast(a.len * b.len as bigint) // cast(b.cum - a.cum as bigint)) as double) as ns from ord a join ord b on a.cluster_id = b.cluster_id and a.pos < b.pos where b.cum - a.cum <= 10000000 group by 1) n using (cluster_id)
      left join (select cluster_id, count(*) as nl from y where gap + len <= 10000000 group by 1) c using (cluster_id)
      left join (select cluster_id, sum(1.0e0 / (dist + gap)) as score from x where gap <= 10000000 group by 1) s using (cluster_id)""", **CHAIN, x=BETWEEN, y=FORWARD)),
    "orient_loglik": (lambda s, d: O.orient_log_likelihood(cells(s, d)).withColumn("ll", F.round("ll", 6)), duckdb_text("select cluster_id, c1, rc1, c2, rc2, round(-sum(ln(cast(dist as double))), 6) as ll from cells group by 1, 2, 3, 4, 5", local=LOCAL, grouped=GROUPED, cells=CELLS)),
    "link_density_pair": (lambda s, d: O.link_density_pair(norm(s, d), view(s, d, "contigs")), duckdb_text("select i, j, cast(z * (m // a.re) * (m // b.re) as double) as density from norm join contigs a on i = a.tid join contigs b on j = b.tid cross join (select max(re) as m from contigs) x", glm=GLM, norm=NORM)),
    "order_errors": (flags, duckdb_text("select * from flags", flags=FLAGS)),
    "order_usage": (lambda s, d: O.usage(flags(s, d), view(s, d, "clusters"), view(s, d, "contigs")), duckdb_text("""select no as n_ordered, cast(lo as bigint) as len_ordered, 100.0e0 * no / nc as pct_n_of_clustered, 100.0e0 * lo / lc as pct_len_of_clustered, 100.0e0 * no / na as pct_n_of_all, 100.0e0 * lo / la as pct_len_of_all,
      nh as n_high_quality, cast(lh as bigint) as len_high_quality, 100.0e0 * nh / no as pct_n_hq, 100.0e0 * lh / lo as pct_len_hq from
      (select count(*) as no, sum(len) as lo, count_if(high_quality) as nh, sum(case when high_quality then len end) as lh from f) a, (select count(*) as nc, sum(len) as lc from clusters c join contigs k on c.tid = k.tid) b, (select count(*) as na, sum(len) as la from contigs) c""", flags=FLAGS, f=_FL)),
    "order_error_chart": (lambda s, d: O.error_chart(flags(s, d), view(s, d, "contigs")), duckdb_text(_CHART, flags=FLAGS, f=_FL)),
    "hq_and_error": (lambda s, d: O.hq_and_error(flags(s, d)), duckdb_text("select cluster_id, tid from flags where high_quality and order_error", flags=FLAGS)),
    "cluster_chart": (lambda s, d: O.cluster_chart(flags(s, d), view(s, d, "clusters"), view(s, d, "contigs")), duckdb_text("""select cluster_id, n, len, n_ordered, len_ordered, n_chr_mismatch, n_order_error, n_orient_error from (
      select c.cluster_id, count(*) as n, cast(sum(k.len) as bigint) as len, count(g.pos) as n_ordered, cast(sum(case when g.pos is not null then k.len else 0 end) as bigint) as len_ordered, count_if(coalesce(chr_mismatch, false)) as n_chr_mismatch, count_if(coalesce(order_error, false)) as n_order_error, count_if(coalesce(orient_error, false)) as n_orient_error,
        grouping(c.cluster_id) as top from clusters c join contigs k on c.tid = k.tid left join flags g on g.tid = c.tid group by rollup (c.cluster_id)) x where top = 1 or n > 1""", flags=FLAGS)),
    "error_histogram": (lambda s, d: O.error_histogram(flags(s, d), view(s, d, "contigs")), duckdb_text("""select cast(floor(log2(greatest(re, 1))) as int) as bin, count(*) as n, cast(sum(re) as bigint) as size, 100.0e0 * count_if(not order_error and not orient_error) / count(*) as pct_ok, 100.0e0 * count_if(order_error and not orient_error) / count(*) as pct_order,
      100.0e0 * count_if(orient_error and not order_error) / count(*) as pct_orient, 100.0e0 * count_if(order_error and orient_error) / count(*) as pct_both from f where not unaligned group by 1""", flags=FLAGS, f=_FL)),
    "gap_errors": (_gaps, duckdb_text("""select cluster_id, pos, tg as true_gap, round(ln((gap + 1) / cast(tg + 1 as double)), 9) as log_error, weight from (select *, greatest(n0 - t1, t0 - n1, 100) as tg from (
      select o.cluster_id, o.pos, o.tid * 37 % 5000 as gap, t.chrom, t0, t1, lead(t.chrom) over w as nc, lead(t0) over w as n0, lead(t1) over w as n1, k.len + lead(k.len) over w as weight from ordering o join truth t on o.tid = t.tid join contigs k on k.tid = o.tid window w as (partition by o.cluster_id order by o.pos)) x where chrom = nc) y""")),
    "ordering_txt": (_v("ordering clusters contigs", O.ordering_lines), duckdb_text("select o.cluster_id, o.pos, concat_ws(chr(9), local_id, name, cast(cast(rc as int) as STR), cast(q as STR), '.') as line from ordering o join local l on o.tid = l.tid join contigs k on k.tid = o.tid", local=LOCAL)),
    "ordering_string": (_v("ordering clusters", O.ordering_string), duckdb_text("select o.cluster_id, string_agg(local_id || case when rc then '_rc' else '_fw' end, ',' order by pos) as text from ordering o join local l on o.tid = l.tid group by 1", local=LOCAL)),
    "unordered_contigs": (_v("clusters ordering", O.unordered), duckdb_text("select cluster_id, tid from clusters where tid not in (select tid from ordering)")),
    "unclustered_contigs": (_v("contigs clusters", O.unclustered), duckdb_text("select tid, name from contigs where tid not in (select tid from clusters)")),
    "append_unused": (_v("ordering clusters", O.append_unused), duckdb_text("""select cluster_id, tid, pos, rc from ordering union all select c.cluster_id, c.tid, cast(coalesce(m, -1) + row_number() over (partition by c.cluster_id order by c.tid) as int), false
      from clusters c left join (select cluster_id, max(pos) as m from ordering group by 1) x on c.cluster_id = x.cluster_id where tid not in (select tid from ordering)""")),
    "trunk_subset_check": (lambda s, d: O.not_in_full(view(s, d, "ordering").where("q >= 4"), view(s, d, "ordering")), duckdb_text("select count(*) as n_missing from ordering where q >= 4 and tid not in (select tid from ordering)")),
    "excluded_groups": (lambda s, d: O.excluding_groups(view(s, d, "ordering"), [2, 5]).select(*_ORDERED), duckdb_text("select cluster_id, tid, pos, rc from ordering where cluster_id not in (2, 5)")),
    "invert_range": (lambda s, d: O.inverted(view(s, d, "ordering"), 2, 7).select(*_ORDERED), duckdb_text("""select cluster_id, tid, case when pos >= 2 and pos < least(7, n) then cast(least(7, n) - 1 - (pos - 2) as int) else pos end as pos, rc <> (pos >= 2 and pos < least(7, n)) as rc from (select *, count(*) over (partition by cluster_id) as n from ordering) x""")),
    "canonicalize": (lambda s, d: O.canonicalised(view(s, d, "ordering")).select(*_ORDERED), duckdb_text("""select cluster_id, tid, case when turn then cast(n - 1 - pos as int) else pos end as pos, rc <> turn as rc from (select *, count(*) over w as n, arg_min(tid, pos) over w > arg_max(tid, pos) over w as turn from ordering window w as (partition by cluster_id)) x""")),
    "ordering_size": (_v("ordering clusters contigs", O.ordering_size), duckdb_text("select c.cluster_id, 100.0e0 * count(o.tid) / count(*) as pct_n, 100.0e0 * sum(case when o.tid is not null then len else 0 end) / sum(len) as pct_len from clusters c join contigs k on c.tid = k.tid left join ordering o on o.tid = c.tid group by 1")),
    "scaffold_build": (_scaffolds, duckdb_text(f"""select cluster_id, md5(seq) as md5, length(seq) as size from (select cluster_id, regexp_replace(string_agg(case when rc then translate(reverse(s), 'ACGT', 'TGCA') else s end || repeat('N', case when tid % 4 > 0 then tid % 6 else 10 end), '' order by pos), 'N+$', '') as seq
      from (select o.*, {_SEQ} as s from ordering o join contigs k on o.tid = k.tid) x group by 1) y""")),
    "scaffold_lines": (_scaffold_lines, duckdb_text("""select cluster_id, 0 as line_no, '>group' || cluster_id || '__' || n || '_contigs__length_' || length(seq) as line from sc
      union all select cluster_id, k as line_no, substr(seq, cast((k - 1) * 80 + 1 as int), 80) as line from (select cluster_id, seq, unnest(range(1, (length(seq) + 79) // 80 + 1)) as k from sc) y""",
      sc=f"""select cluster_id, count(*) as n, regexp_replace(string_agg(case when rc then translate(reverse(s), 'ACGT', 'TGCA') else s end || repeat('N', case when tid % 4 > 0 then tid % 6 else 10 end), '' order by pos), 'N+$', '') as seq
      from (select o.*, {_SEQ} as s from ordering o join contigs k on o.tid = k.tid) x group by 1""")),
    "genome_order": (_v("truth", O.genome_order), duckdb_text("select tid, row_number() over (order by chrom nulls last, case when chrom is null then 0 else (t0 + t1) // 2 end, tid) - 1 as rank from truth")),
    "top_contigs": (lambda s, d: O.top_contigs(view(s, d, "contigs"), 50).select("tid", "len"), duckdb_text("select tid, len from contigs where len >= (select len from contigs order by len desc limit 1 offset 50)")),
    "heatmap_cells": (heatmap_cells, duckdb_text("""select a.x, b.x as y, coalesce(z, 0) / 1000.0e0 as z from k a cross join k b left join norm on i = a.tid and j = b.tid where a.x <> b.x""", glm=GLM, norm=NORM, k="select o.tid, row_number() over (order by cluster_id, pos) - 1 as x from ordering o join contigs c on o.tid = c.tid where len >= coalesce((select len from contigs order by len desc limit 1 offset 1000), 0)")),
    "dotplot_points": (_v("ordering truth", O.dotplot_points), duckdb_text("select o.cluster_id, o.pos as x, g.rank as y, t.chrom from ordering o join truth t on o.tid = t.tid join (select tid, row_number() over (order by chrom nulls last, case when chrom is null then 0 else (t0 + t1) // 2 end, tid) - 1 as rank from truth) g on g.tid = o.tid")),
    "contig_truth": (_v("contigs truth", T.with_truth), duckdb_text("select k.tid, name, coalesce(chrom, -1) as chrom, case when chrom is null then -1 else t0 end as t0, case when chrom is null then -1 else t1 end as t1 from contigs k left join truth t on k.tid = t.tid")),
    "high_quality": (_v("truth", lambda t: T.high_quality(t).select("tid", "chrom")), duckdb_text("select tid, chrom from truth where alignability >= 0.5 and specificity >= 0.9")),
    "merge_targets": (_v("truth", lambda t: T.merge_targets(T.remove_target(t, 3), 5, 7).select("tid", "chrom")), duckdb_text("select tid, case chrom when 3 then null when 7 then 5 else chrom end as chrom from truth")),
    "first_on_chrom": (_v("truth", T.first_on_chrom), duckdb_text("select chrom, min(tid) as tid from truth where chrom is not null group by 1")),
    "len_on_targets": (_v("truth contigs", T.lengths_on_targets), duckdb_text("select chrom, count(*) as n, cast(sum(len) as bigint) as len, count_if(alignability >= 0.5 and specificity >= 0.9) as n_hq, cast(sum(case when alignability >= 0.5 and specificity >= 0.9 then len else 0 end) as bigint) as len_hq from truth t join contigs k on t.tid = k.tid group by 1")),
    "chrom_name_match": (_names, duckdb_text("""select n.n_name as name, coalesce(a.id, b.id, -1) as chrom_id from nation n left join c a on a.name = n.n_name left join c b on b.name = 'chr' || n.n_name""", c="select case when n_nationkey % 2 = 0 then n_name else 'chr' || n_name end as name, n_nationkey as id from nation where n_nationkey % 5 <> 0")),
    "name_lookup": (lambda s, d: T.look_up(view(s, d, "reads").select(F.concat(F.lit("ctg_"), F.col("tid")).alias("name")).distinct(), view(s, d, "contigs")), duckdb_text("select distinct 'ctg_' || tid as name, tid from reads")),
    "bin_truth": (lambda s, d: T.bin_truth(_sizes(s, d), 10000), duckdb_text("select chrom, cast(bin as int) as bin, bin * 10000 as start, least((bin + 1) * 10000, size) as stop from (select chrom, max(t1) as size from truth where chrom is not null group by 1) x, lateral (select unnest(range((size + 9999) // 10000)) as bin) y")),
    "bin_offsets": (lambda s, d: T.bin_offsets(_sizes(s, d), 10000), duckdb_text("select chrom, bins, cast(sum(bins) over (order by chrom) - bins as bigint) as first from (select chrom, (max(t1) + 9999) // 10000 as bins from truth where chrom is not null group by 1) x")),
    "header_check": (lambda s, d: T.same_targets(view(s, d, "contigs").select("name", "len"), view(s, d, "contigs").where("tid % 9 <> 1").select("name", "len")), duckdb_text("select count(*) as n_differing from contigs where tid % 9 = 1")),
}
