"""Queries over reads, links and clusters, each with its DuckDB check."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaloom.operators import clusters as C
from chromaloom.operators import links as L
from chromaloom.plans.adapters import duckdb_text, view

GLM = """select i, j, count(*) as z from (
  select tid1 as i, tid2 as j, mapq1 as q, pos1, pos2 from pairs union all select tid2, tid1, mapq1, pos1, pos2 from pairs union all
  select tid2, tid1, mapq2, pos1, pos2 from pairs union all select tid1, tid2, mapq2, pos1, pos2 from pairs) x
  where q > 0 and pos1 <> pos2 and i <> j group by i, j"""
NORM = """select g.i, g.j, TRUNC[cast(g.z * m.mx * m.mx as double) / cast(a.re * b.re as double)] as z
  from glm g join contigs a on g.i = a.tid join contigs b on g.j = b.tid cross join (select max(re) as mx from contigs) m"""
REP = """select c.tid, coalesce(r.rs, 0) / t.avg_rs as factor from contigs c
  left join (select i, cast(sum(z) as double) as rs from norm group by i) r on c.tid = r.i
  cross join (select cast(sum(z) as double) / (select count(*) from contigs) as avg_rs from norm) t"""
SIZED = "select c.tid, c.cluster_id, k.len from clusters c join contigs k on c.tid = k.tid"
LINKAGE = """select i as tid, cluster_id, cast(sum(z) as double) / max(n) as linkage from norm join clusters on j = clusters.tid
  join (select cluster_id, count(*) as n from clusters group by 1) s using (cluster_id)
  where i not in (select tid from clusters) group by i, cluster_id"""
CHOSEN = "select cluster_id, chrom, len, row_number() over (partition by cluster_id order by len desc, chrom) as k from (select c.cluster_id, t.chrom, sum(k.len) as len from clusters c join contigs k on c.tid = k.tid join truth t on c.tid = t.tid where t.chrom is not null group by 1, 2) x"
LOCAL = "select cluster_id, tid, row_number() over (partition by cluster_id order by tid) - 1 as local_id from clusters"
GROUPED = "select a.cluster_id, a.local_id as c1, b.local_id as c2, pos1, pos2, tid1, tid2 from pairs join local a on tid1 = a.tid join local b on tid2 = b.tid and a.cluster_id = b.cluster_id where mapq1 > 0 and mapq2 > 0"


def glm(s, d):
    return L.link_matrix(view(s, d, "pairs"))


def norm(s, d):
    return L.mirrored(half_norm(s, d).withColumnsRenamed({"i": "a", "j": "b"}))


def half_norm(s, d):
    """The upper triangle of the normalised matrix; a factor is the same both ways round, so it is as symmetric as the links."""
    return L.normalise(L.half_matrix(view(s, d, "pairs")), view(s, d, "contigs"))


def grouped(s, d):
    return L.group_links(view(s, d, "pairs"), view(s, d, "clusters"))


def _views(names: str, function):
    return lambda s, d: function(*(view(s, d, n) for n in names.split()))


def _skip_repeats(s, d):
    return L.skip_repeats(norm(s, d), view(s, d, "contigs"), 2.0)


def _read_pairs(s, d):
    reads = view(s, d, "reads").where("flag = 0").select(F.concat(F.lit("r"), F.col("qid"), F.lit("."), F.floor(F.col("ord") / 2)).alias("qname"), "ord", "tid", "pos", "mapq", F.col("qid").alias("file"))
    return L.consecutive_pairs(reads.withColumnRenamed("ord", "row_no"))


def _assigned(s, d):
    return C.assign_noninformative(norm(s, d), view(s, d, "clusters"), view(s, d, "contigs"), 2.0)


def _linkage(s, d):
    outside = view(s, d, "contigs").join(view(s, d, "clusters").select("tid"), "tid", "left_anti")
    return C.linkage(norm(s, d), view(s, d, "clusters"), outside).select("tid", "cluster_id", "linkage", "k")


#: name: (query, check)
REGISTRY = {
    "edge_weights": (lambda s, d: L.edge_weights(view(s, d, "pairs"), view(s, d, "contigs")).select("tid1", "pos1", "tid2", "pos2", F.round("weight", 9).alias("weight")), duckdb_text("select tid1, pos1, tid2, pos2, round(2 * (1 - 2 * (least(pos1, abs(a.len - pos1)) + least(pos2, abs(b.len - pos2))) / cast(a.len + b.len as double)), 9) as weight from pairs join contigs a on tid1 = a.tid join contigs b on tid2 = b.tid")),
    "link_matrix": (glm, duckdb_text("select * from glm", glm=GLM)),
    "link_normalise": (norm, duckdb_text("select * from norm", glm=GLM, norm=NORM)),
    "repeat_factor": (lambda s, d: L.repeat_factor(norm(s, d), view(s, d, "contigs")), duckdb_text("select * from rep", glm=GLM, norm=NORM, rep=REP)),
    "density_correct": (lambda s, d: L.density_corrected(n := norm(s, d), L.repeat_factor(n, view(s, d, "contigs"))), duckdb_text("select i, j, TRUNC[z / factor] as z from norm join rep on i = tid", glm=GLM, norm=NORM, rep=REP)),
    "skip_repeats": (_skip_repeats, duckdb_text("select tid, factor, factor >= 2.0e0 as skip from rep", glm=GLM, norm=NORM, rep=REP)),
    "skip_short": (_views("contigs", lambda c: L.skip_short(c, 50000).select("tid", "len", "skip")), duckdb_text("select tid, len, len < 50000 as skip from contigs")),
    "skip_short_summary": (_views("contigs", lambda c: L.skipped_summary(L.skip_short(c, 50000))), duckdb_text("select count(*) as n_skipped, coalesce(avg(len), 0) as avg_len from contigs where len < 50000")),
    "skip_few_re": (_views("contigs", lambda c: L.skip_few_sites(c, 10).select("tid", "re", "skip")), duckdb_text("select tid, re, re < 10 as skip from contigs")),
    "filter_aligned_pairs": (_views("reads", lambda r: L.aligned_pairs(r).select("qid", "ord", "tid", "pos", "mapq")), duckdb_text("select qid, ord, tid, pos, mapq from reads where flag & 12 = 0")),
    "filter_region": (_views("reads", lambda r: L.in_region(r, 7, 2000, 15000).select("qid", "ord", "tid", "pos")), duckdb_text("select qid, ord, tid, pos from reads where tid = 7 and pos between 2000 and 15000")),
    "read_pairs": (_read_pairs, duckdb_text("""select file, qname as qname1, ord as row_no1, tid as tid1, pos as pos1, mapq as mapq1, qname as qname2, ord2 as row_no2, tid2, pos2, mapq2
      from (select qid as file, concat('r', cast(qid as STR), '.', cast(ord // 2 as STR)) as qname, *, row_number() over w as k, lead(ord) over w as ord2, lead(tid) over w as tid2, lead(pos) over w as pos2, lead(mapq) over w as mapq2
        from reads where flag = 0 window w as (partition by qid, ord // 2 order by ord)) x where k = 1 and ord2 is not null""")),
    "filter_funnel": (_views("pairs", L.filter_funnel), duckdb_text("""select count(*) as total, count_if(mapq1 > 0 and mapq2 > 0) as good, count_if(mapq1 > 0 and mapq2 > 0 and tid1 = tid2) as intra,
      count_if(mapq1 > 0 and mapq2 > 0 and tid1 = tid2 and abs(pos1 - pos2) >= 4096) as far from pairs""")),
    "binned_links": (_views("pairs", lambda p: L.binned_links(p, 1000)), duckdb_text("""select chrom, bin1, bin2, count(*) as z from (select tid1 as chrom, pos1 // 1000 as bin1, pos2 // 1000 as bin2 from pairs
      where pos1 <> pos2 and pos1 <= pos2 and mapq1 > 0 and mapq2 > 0 and tid1 = tid2) x where bin1 <> bin2 group by 1, 2, 3""")),
    "flagstat": (_views("reads", L.flagstat), duckdb_text("select count(*) as total, count_if(flag & 4 = 0) as mapped, count_if(flag & 4 = 0 and mapq > 0) as good from reads")),
    "target_coverage": (_views("reads contigs", L.target_coverage), duckdb_text("select c.tid, coalesce(n, 0) as hits, coalesce(n, 0) / cast(len as double) as coverage from contigs c left join (select tid, count(*) as n from reads group by 1) r on c.tid = r.tid")),
    "mappability": (_views("reads contigs", L.mappability), duckdb_text("select c.tid, coalesce(g, 0) / cast(greatest(coalesce(n, 0), 1) as double) as mappability from contigs c left join (select tid, count(*) as n, count_if(mapq > 0) as g from reads group by 1) r on c.tid = r.tid")),
    "candidate_edges": (lambda s, d: L.candidate_edges(norm(s, d)), duckdb_text("select * from norm where i < j and z > 0", glm=GLM, norm=NORM)),
    "contigs_used": (lambda s, d: L.contigs_used(glm(s, d), view(s, d, "contigs")), duckdb_text("""select tid, m and coalesce(lag(m) over (order by tid), true) and coalesce(lead(m) over (order by tid), true) as used
      from (select c.tid, g.i is not null as m from contigs c left join (select distinct i from glm) g on c.tid = g.i) x""", glm=GLM)),
    "local_ids": (_views("clusters", L.local_ids), duckdb_text("select * from local", local=LOCAL)),
    "group_links": (grouped, duckdb_text("select * from grouped", local=LOCAL, grouped=GROUPED)),
    "oriented_distances": (lambda s, d: L.oriented_distances(grouped(s, d), view(s, d, "contigs")), duckdb_text("""select cluster_id, c1, rc1, c2, rc2, dist from (
        select g.*, r1, r2, 100 + case when r1 then pos1 else a.len - pos1 end + case when r2 then b.len - pos2 else pos2 end as dd from grouped g join contigs a on tid1 = a.tid join contigs b on tid2 = b.tid
          cross join (values (true), (false)) x(r1) cross join (values (true), (false)) y(r2) where c1 <> c2) q,
      lateral (select q.c1, q.r1 as rc1, q.c2, q.r2 as rc2, q.dd as dist union all select q.c2, not q.r2, q.c1, not q.r1, q.dd) l(c1, rc1, c2, rc2, dist)""".replace("select cluster_id, c1, rc1, c2, rc2, dist from", "select q.cluster_id, l.c1, l.rc1, l.c2, l.rc2, l.dist from"), local=LOCAL, grouped=GROUPED)),
    "cluster_summary": (_views("clusters contigs", C.cluster_summary), duckdb_text("select cluster_id, count(*) as n, cast(sum(len) as bigint) as len, sum(len) / cast((select sum(len) from contigs) as double) as share from sized group by 1", sized=SIZED)),
    "cluster_totals": (_views("clusters contigs", C.cluster_totals), duckdb_text("""select count(*) as n_clusters, count_if(n = 1) as n_singletons, cast(sum(n) as bigint) as n_clustered, cast(sum(l) as bigint) as len_clustered,
      sum(n) / cast((select count(*) from contigs) as double) as share_n, sum(l) / cast((select sum(len) from contigs) as double) as share_len from (select cluster_id, count(*) as n, sum(len) as l from sized group by 1) x""", sized=SIZED)),
    "cluster_enrichment": (lambda s, d: C.enrichment(half_norm(s, d), view(s, d, "clusters"), view(s, d, "contigs"), half=True), duckdb_text("""select i_wz / i_w as intra_density, o_wz / o_w as inter_density, (i_wz / i_w) / (o_wz / o_w) as enrichment from (
      select cast(sum(case when a.cluster_id = b.cluster_id then w * coalesce(z, 0) end) as double) as i_wz, cast(sum(case when a.cluster_id = b.cluster_id then w end) as double) as i_w,
        cast(sum(case when a.cluster_id <> b.cluster_id then w * coalesce(z, 0) end) as double) as o_wz, cast(sum(case when a.cluster_id <> b.cluster_id then w end) as double) as o_w
      from (select a.tid as ta, b.tid as tb, a.cluster_id as ca, b.cluster_id as cb, (a.len * b.len) >> 20 as w from sized a cross join sized b) p
      left join norm on i = ta and j = tb, lateral (select ca) a(cluster_id), lateral (select cb) b(cluster_id)) x""", glm=GLM, norm=NORM, sized=SIZED)),
    "contig_enrichment_ratio": (lambda s, d: C.contig_enrichment_ratio(norm(s, d), view(s, d, "clusters")), duckdb_text("""select c.tid, (coalesce(zi, 0) / cast(nullif(n - 1, 0) as double)) / nullif(coalesce(zo, 0) / cast(nullif(total - n, 0) as double), 0) as ratio
      from clusters c join (select cluster_id, count(*) as n from clusters group by 1) s on c.cluster_id = s.cluster_id cross join (select count(*) as total from clusters) t
      left join (select i, sum(case when a.cluster_id = b.cluster_id then z else 0 end) as zi, sum(case when a.cluster_id <> b.cluster_id then z else 0 end) as zo from norm join clusters a on i = a.tid join clusters b on j = b.tid group by i) l on c.tid = l.i""", glm=GLM, norm=NORM)),
    "plurality_chrom": (_views("clusters contigs truth", C.plurality), duckdb_text("select cluster_id, chrom, cast(len as bigint) as len from chosen where k = 1", chosen=CHOSEN)),
    "misclustered": (_views("clusters contigs truth", C.misclustered), duckdb_text("""select c.cluster_id, count_if(t.chrom <> p.chrom) as n_bad, cast(coalesce(sum(case when t.chrom <> p.chrom then k.len end), 0) as bigint) as len_bad
      from clusters c join contigs k on c.tid = k.tid join truth t on c.tid = t.tid join chosen p on p.cluster_id = c.cluster_id and p.k = 1 where t.chrom is not null group by 1""", chosen=CHOSEN)),
    "cluster_linkage": (_linkage, duckdb_text("select tid, cluster_id, linkage, row_number() over (partition by tid order by linkage desc, cluster_id) as k from linked where linkage > 0", glm=GLM, norm=NORM, linked=LINKAGE)),
    "assign_noninformative": (_assigned, duckdb_text("""select tid, cluster_id from (select *, row_number() over w as k, coalesce(lead(linkage) over w, 0) as second from linked window w as (partition by tid order by linkage desc, cluster_id)) x
      where k = 1 and linkage > 0 and (second = 0 or linkage / second >= 2)""", glm=GLM, norm=NORM, linked=LINKAGE)),
    "canonical_clusters": (_views("clusters contigs", C.canonical), duckdb_text("select cluster_id as old_id, row_number() over (order by sum(len) desc, cluster_id) - 1 as new_id from sized group by cluster_id", sized=SIZED)),
    "sort_by_median": (_views("clusters", C.sort_by_median), duckdb_text("select *, row_number() over (order by median, cluster_id) - 1 as new_id from (select cluster_id, list_sort(list(tid))[count(*) // 2 + 1] as median from clusters group by 1) x")),
    "sort_by_smallest": (_views("clusters", C.sort_by_smallest), duckdb_text("select cluster_id, row_number() over (order by m) - 1 as new_id from (select cluster_id, list_sort(list(tid)) as m from clusters group by 1) x")),
    "cluster_sets": (_views("clusters", lambda c: C.sorted_members(C.dense_ids(C.without_singletons(c))).select("cluster_id", F.array_join("members", ",").alias("members"))), duckdb_text("""select row_number() over (order by min(tid)) - 1 as cluster_id, string_agg(cast(tid as STR), ',' order by tid) as members from clusters c group by c.cluster_id having count(*) > 1""")),
    "clusters_txt": (_views("clusters contigs", C.cluster_lines), duckdb_text("select cluster_id, string_agg(name, chr(9) order by c.tid) as line from clusters c join contigs k on c.tid = k.tid group by 1")),
}
