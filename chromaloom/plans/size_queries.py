"""Queries over link sizes, text records and state sequences, each with its DuckDB check."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chromaloom.operators import link_sizes as Z
from chromaloom.operators import sequences_of_states as Q
from chromaloom.operators.links import local_ids
from chromaloom.plans.adapters import duckdb_text, view
from chromaloom.plans.link_queries import GROUPED, LOCAL
from chromaloom.plans.ordering_queries import CELLS, cells
from chromaloom.sources import genome
from chromaloom.sources import haplotypes as H
from chromaloom.sources import records as R

BINS = """select cast(k as int) as bin, cast(floor(4096 * pow(2.0e0, k // 16) * pow(2.0e0, (k % 16) / 16.0e0)) as bigint) as start,
  cast(floor(4096 * pow(2.0e0, (k + 1) // 16) * pow(2.0e0, ((k + 1) % 16) / 16.0e0)) as bigint) as stop from (select unnest(range(256)) as k) x"""
# positions are spread over the contig here, so that links within one reach the least distance
FAR = "select tid1 as tid, abs(pos1 - pos2) as apart, mapq1, mapq2 from (select a.tid as tid1, a.tid as tid2, a.pos as pos1, b.pos as pos2, a.mapq as mapq1, b.mapq as mapq2 from numbered a join numbered b on a.tid = b.tid and b.k = a.k + 1) x where mapq1 > 0 and mapq2 > 0 and abs(pos1 - pos2) >= 4096"
NUMBERED = "select *, row_number() over (partition by tid order by qid, ord) as k from reads where flag = 0"
HIST = "select cast(floor(16 * log2(apart / 4096.0e0)) as int) as bin, count(*) as n from far group by 1"
NORMS = "select bin, start, stop, cast(sum(case when len > start then len - start else 0 end) as bigint) as norm from contigs cross join bins group by 1, 2, 3"
DENS = """select bin, start, stop, case when bin >= inner_bin then (select avg(own * (stop - start)) from (select * from w where bin >= (select max(bin) from w where norm > 0 and top >= total // 100) and bin <= inner_bin) q) / (stop - start) else own end as density from w"""
W = """select *, case when norm > 0 then n / cast(norm as double) / (stop - start) * 1e6 end as own, sum(case when norm > 0 then n else 0 end) over (order by bin desc) as top, sum(n) over () as total, max(case when norm > 0 then bin end) over () as inner_bin
  from (select m.*, coalesce(h.n, 0) as n from norms m left join hist h on m.bin = h.bin) x"""
CHAIN = {"bins": BINS, "numbered": NUMBERED, "far": FAR, "hist": HIST, "norms": NORMS, "w": W, "lsd": DENS}
M = """case when stop <= g or start >= g + l1 + l2 then 0 else (case when start < g + least(l1, l2) then (least(stop, g + least(l1, l2)) - greatest(start, g)) * ((greatest(start, g) + least(stop, g + least(l1, l2))) // 2 - g) else 0 end
  + case when stop >= g + least(l1, l2) and start < g + greatest(l1, l2) then (least(stop, g + greatest(l1, l2)) - greatest(start, g + least(l1, l2))) * least(l1, l2) else 0 end
  + case when stop >= g + greatest(l1, l2) then (least(stop, g + l1 + l2) - greatest(start, g + greatest(l1, l2))) * (g + l1 + l2 - (greatest(start, g + greatest(l1, l2)) + least(stop, g + l1 + l2)) // 2) else 0 end) * density / 1e6 end"""

def far_pairs(s, d):
    """Neighbouring reads of a contig as pairs within it."""
    w = Window.partitionBy("tid").orderBy("qid", "ord")
    rows = view(s, d, "reads").where("flag = 0").select(F.col("tid").alias("tid1"), F.col("tid").alias("tid2"), F.col("pos").alias("pos1"), F.lead("pos").over(w).alias("pos2"), F.col("mapq").alias("mapq1"), F.lead("mapq").over(w).alias("mapq2"))
    return rows.where("pos2 is not null")


def lsd(s, d):
    return Z.density(far_pairs(s, d), view(s, d, "contigs"))


def _links(s, d):
    """Links of neighbouring contigs, both as they are."""
    sized = local_ids(view(s, d, "clusters")).join(view(s, d, "contigs").select("tid", "len"), "tid")
    one = sized.select("cluster_id", F.col("local_id").alias("c1"), F.col("len").alias("len1"))
    two = sized.select("cluster_id", F.col("local_id").alias("c2"), F.col("len").alias("len2"))
    near = cells(s, d).where("c2 = c1 + 1 and not rc1 and not rc2").join(one, ["cluster_id", "c1"]).join(two, ["cluster_id", "c2"])
    return near.select(F.struct("cluster_id", F.col("c1").alias("local_id")).alias("pair"), "len1", "len2", F.lit(1.0).alias("enrichment"), "dist")


def _likelihood(s, d):
    return Z.gap_likelihood(_links(s, d), lsd(s, d))


def _gaps(s, d):
    """The gap of every neighbouring pair, over all gaps that the search tries."""
    return Z.gap_size(_links(s, d), lsd(s, d)).select("pair", "gap")


def space_contigs(s, d):
    """The gap after every contig of the orderings."""
    sizes, contigs = lsd(s, d), view(s, d, "contigs")
    enrichment = Z.contig_enrichment(far_pairs(s, d), contigs, sizes)
    return Z.spaced(view(s, d, "ordering").select("cluster_id", "pos", "tid", "rc"), cells(s, d), view(s, d, "clusters"), contigs, enrichment, sizes)


def _expected(s, d):
    rows = view(s, d, "contigs").select("tid", F.col("len").alias("l1"), (F.col("len") + 15000).alias("l2"), (F.col("tid") * 10).cast("bigint").alias("g"))
    return rows.crossJoin(F.broadcast(lsd(s, d))).select("tid", "bin", F.round(Z.expected_between(F.col("g"), F.col("l1"), F.col("l2")), 9).alias("m"))


def _lines(s, d):
    """VCF-like lines out of the line items."""
    rows = s.read.parquet(f"{d}/lineitem.parquet")
    base = lambda c: F.substring(F.lit("ACGTN"), (F.col(c) % 5 + 1).cast("int"), F.lit(1))
    chrom = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("chr"), F.col("l_suppkey") % 24)).otherwise((F.col("l_suppkey") % 24).cast("string"))
    depth = F.concat_ws(",", F.col("l_partkey") % 31, F.col("l_orderkey") % 29)
    values = F.concat_ws(":", F.when(F.col("l_linenumber") % 3 == 0, "0/0").when(F.col("l_linenumber") % 3 == 1, "0/1").otherwise("1/1"), depth, F.concat_ws(",", F.col("l_partkey") % 97, F.col("l_suppkey") % 89, F.col("l_orderkey") % 83))
    info = F.concat(F.lit("AC="), F.col("l_linenumber"), F.lit(";AN="), F.lit(20) + F.col("l_linenumber"))
    return rows.select(F.concat_ws("\t", chrom, F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.lit("rs"), base("l_partkey"), base("l_orderkey"), F.lit("."), F.lit("PASS"), info, F.lit("GT:AD:PL"), values).alias("value"))


VAR = """select case when l_suppkey % 2 = 0 then 'chr' else 'chr' end || (l_suppkey % 24) as chrom, l_orderkey * 10 + l_linenumber as pos, substr('ACGTN', cast(l_partkey % 5 + 1 as int), 1) as ref, substr('ACGTN', cast(l_orderkey % 5 + 1 as int), 1) as alt,
  case l_linenumber % 3 when 0 then 0 when 1 then 1 else 2 end as genotype, cast(l_partkey % 31 as int) as ref_depth, cast(l_orderkey % 29 as int) as alt_depth, cast(l_partkey % 97 as int) as p0, cast(l_suppkey % 89 as int) as p1, cast(l_orderkey % 83 as int) as p2, l_linenumber as ln, l_suppkey as sk from lineitem"""


def _variants(s, d):
    return R.with_fractions(R.vcf(_lines(s, d))).drop("tag", "is_indel")


def _haplotypes(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return rows.select(F.concat_ws("\t", "l_orderkey", F.lit(30), F.array_join(F.transform("x", lambda x: F.concat_ws("\t", F.concat(F.lit("v"), x["l_partkey"]), x["l_suppkey"] % 2)), "\t")).alias("value"))


def _clone_lines(s, d):
    """A matrix of real clones: an order is a clone, its items are calls."""
    items = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").cast("bigint").alias("o"), "l_linenumber", "l_suppkey")
    name = F.concat_ws("_", F.concat(F.lit("chr"), F.col("o") % 24), F.col("o") * 100 + F.col("l_linenumber") % 5, F.lit("A"), F.lit("C"))
    rows = items.select("o", F.concat(name, F.lit(","), F.col("l_suppkey") % 2).alias("c"), name.alias("name"))
    body = rows.groupBy("o").agg(F.array_sort(F.collect_list("c")).alias("c")).select(F.lit("f").alias("file"), F.col("o").alias("row_no"), F.concat_ws("\t", F.concat_ws("_", F.concat(F.lit("chr"), F.col("o") % 24), F.col("o") * 100, F.col("o") * 100 + 100), F.lit(30), F.array_join("c", "\t")).alias("value"))
    top = rows.agg(F.count_distinct("o").alias("a"), F.count_distinct("name").alias("b"), F.count(F.lit(1)).alias("c"))
    said = F.array(*(F.concat(F.lit(t), F.col(k)) for t, k in (("# N CLONES: ", "a"), ("# N VARIANTS: ", "b"), ("# TOTAL N CLONE CALLS OF VARIANTS: ", "c"))))
    return top.select(F.posexplode(said).alias("k", "value")).select(F.lit("f").alias("file"), (F.col("k") - 3).cast("bigint").alias("row_no"), "value").unionByName(body)


def _fragment_lines(s, d):
    """A matrix of simulated fragments: a customer is a fragment of 70 alleles, its number mixed and written in binary."""
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("c"))
    alleles = F.rpad(F.lpad(F.conv(F.col("c") * 7919 % 65536, 10, 2), 16, "0"), 70, "01")
    body = rows.select(F.lit("f").alias("file"), F.col("c").alias("row_no"), F.concat_ws(" ", F.col("c") % 31, alleles, F.substring(F.lit("01E"), (F.col("c") % 3 + 1).cast("int"), F.lit(1))).alias("value"))
    said = F.array(F.concat(F.lit("# N FRAGMENTS: "), F.col("n")), F.lit("# N LOCI: 100"), F.lit("# FRAGMENT SIZE: 70"), F.concat(F.lit("# TRUTH HAPLOTYPE: "), F.repeat(F.lit("01"), F.lit(50))))
    top = rows.agg(F.count(F.lit(1)).alias("n")).select(F.posexplode(said).alias("k", "value"))
    return top.select(F.lit("f").alias("file"), (F.col("k") - 4).cast("bigint").alias("row_no"), "value").unionByName(body)


def _simulated(s, d):
    fragments = H.simulated_fragments(_fragment_lines(s, d))
    return fragments.select("fragment", "offset", H.ones(fragments).cast("bigint").alias("ones"), F.col("bits")[0].alias("first"), "truth")


def _sam_lines(s, d):
    rows = view(s, d, "reads").join(view(s, d, "contigs").select("tid", "name"), "tid")
    return rows.select(F.lit("f").alias("file"), (F.col("qid") * 100 + F.col("ord")).alias("row_no"), F.concat_ws("\t", F.concat(F.lit("r"), "qid"), "flag", "name", F.col("pos") + 1, "mapq", F.lit("10M"), F.lit("="), F.col("pos") + 5, F.lit("0"), F.lit("*"), F.lit("*")).alias("value"))


def _blast_lines(s, d):
    """Tabular BLAST output: a header for each contig, the hits of a contig as a query below it."""
    hits = view(s, d, "hits").select(F.lit("f").alias("file"), F.struct(F.col("query_id").cast("bigint").alias("query_id"), F.col("hit").cast("bigint").alias("hit")).alias("row_no"), F.concat_ws("\t", F.concat(F.lit("q"), "query_id"), F.concat(F.lit("t"), "target"), F.lit("99.5"), F.lit("10\t0\t0"), "q_start", "q_end", F.lit("1\t2\t1e-9\t20.5")).alias("value"))
    heads = view(s, d, "contigs").select(F.lit("f").alias("file"), F.struct(F.col("tid").cast("bigint").alias("query_id"), F.lit(-1).cast("bigint").alias("hit")).alias("row_no"), F.lit("# BLASTN 2.2").alias("value"))
    return hits.unionByName(heads)


def _near_sites(s, d):
    from chromaloom.functions.intervals import overlap_join

    reads = view(s, d, "reads").where("flag = 0").select(F.col("tid").alias("chr_id"), F.concat_ws(".", "qid", "ord").alias("id1"), F.col("pos").alias("a1"), (F.col("pos") + 50).alias("b1"))
    sites = view(s, d, "contigs").select(F.col("tid").alias("chr_id"), F.col("tid").alias("id2"), F.lit(9500).cast("bigint").alias("a2"), (F.lit(10000) + F.col("re_raw")).alias("b2"))
    return overlap_join(reads, sites, "chr_id").select("id1", "chr_id").distinct()


def _chromosomes(s, d):
    """The chromosomes with the contigs that lie on them."""
    placed = view(s, d, "truth").where("chrom is not null").groupBy(F.col("chrom").alias("chrom_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = genome.chromosomes(s).join(genome.centromeres(s), "name").join(placed, "chrom_id", "left")
    return rows.select("chrom_id", "name", F.col("len").alias("size"), "start", "middle", F.coalesce("n", F.lit(0)).alias("n_contigs"))


def _bins(s, d):
    """The bins of link sizes with the links in them."""
    return Z.bins(s).join(Z.histogram(far_pairs(s, d)), "bin", "left").select("bin", "start", "stop", F.coalesce("n", F.lit(0)).alias("n"))


_CHROMS = ", ".join(f"({k}, '{n}', {size}, {genome.CENTROMERES[n]})" for k, (n, size) in enumerate(genome.LENGTHS))

REGISTRY = {
    "chrom_dim": (_chromosomes, duckdb_text(f"select chrom_id, name, cast(size as bigint) as size, cast(start as bigint) as start, cast(start + 1500000 as bigint) as middle, coalesce(n, 0) as n_contigs from (values {_CHROMS}) x(chrom_id, name, size, start) left join (select chrom, count(*) as n from truth where chrom is not null group by 1) t on chrom = chrom_id")),
    "lsd_bins": (_bins, duckdb_text("select b.bin, b.start, b.stop, coalesce(n, 0) as n from bins b left join hist h on b.bin = h.bin", bins=BINS, numbered=NUMBERED, far=FAR, hist=HIST)),
    "link_bin": (lambda s, d: view(s, d, "intervals").select("id", Z.link_bin(F.col("a") * 7 + 1).alias("bin")), duckdb_text("select id, cast(case when a * 7 + 1 < 4096 then -1 else floor(16 * log2((a * 7 + 1) / 4096.0e0)) end as int) as bin from intervals")),
    "link_size_hist": (lambda s, d: Z.histogram(far_pairs(s, d)), duckdb_text("select * from hist", numbered=NUMBERED, far=FAR, hist=HIST)),
    "link_density": (lambda s, d: lsd(s, d).withColumn("density", F.round(F.col("density") * 1e6, 6)), duckdb_text("select bin, start, stop, round(density * 1e6, 6) as density from lsd", **CHAIN)),
    "contig_enrichment": (lambda s, d: Z.contig_enrichment(far_pairs(s, d), view(s, d, "contigs"), lsd(s, d)).withColumn("enrichment", F.round("enrichment", 6)), duckdb_text("""select k.tid, round(case when k.len < 4096 then 1 when n is null then 0 else n / e end, 6) as enrichment from contigs k left join (select tid, count(*) as n from far group by 1) f on f.tid = k.tid
      join (select len, sum(case when start >= len then 0 else (least(stop, len) - start) * (len - (start + least(stop, len)) // 2) * density / 1e6 end) as e from (select distinct len from contigs) c cross join lsd group by 1) x on x.len = k.len""", **CHAIN)),
    "expected_links": (_expected, duckdb_text(f"select tid, bin, round({M}, 9) as m from (select tid, len as l1, len + 15000 as l2, cast(tid * 10 as bigint) as g from contigs) x cross join lsd", **CHAIN)),
    "poisson_ll": (_likelihood, None),
    "gap_size": (_gaps, None),
    "space_contigs": (space_contigs, None),
    "link_variance": (lambda s, d: Z.link_variance(cells(s, d), view(s, d, "contigs")).withColumn("variance", F.round("variance", 9)), duckdb_text("select cluster_id, c1, c2, cast(sum(k) as bigint) as n, round(var_pop(k), 9) as variance from (select cluster_id, c1, c2, dist // 10000 as bin, count(*) as k from cells where not rc1 and not rc2 and c1 < c2 group by 1, 2, 3, 4) x group by 1, 2, 3", local=LOCAL, grouped=GROUPED, cells=CELLS)),
    "trapezoid_deviation": (lambda s, d: Z.trapezoid_deviation(cells(s, d), view(s, d, "clusters"), view(s, d, "contigs")).withColumn("deviation", F.round("deviation", 6)), duckdb_text("""select cluster_id, c1, c2, n, round(sum(power(e - coalesce(k, 0), 2)) / n, 6) as deviation from (
      select p.*, bin, n / cast(len2 as double) * 10000 * case when bin * 10000 < len1 then (bin * 10000 + least((bin + 1) * 10000, len1)) / 2.0e0 / len1 when (bin + 1) * 10000 > len2 then (len1 + len2 - ((bin + 1) * 10000 + greatest(bin * 10000, len2)) / 2.0e0) / len1 else 1 end as e
      from (select *, unnest(range(0, (len1 + len2) // 10000 + 1)) as bin from (select f.cluster_id, c1, c2, a.len as len1, b.len as len2, count(*) as n from fw f join sized a on a.cluster_id = f.cluster_id and a.local_id = c1 join sized b on b.cluster_id = f.cluster_id and b.local_id = c2 group by 1, 2, 3, 4, 5) y) p) q
      left join (select cluster_id, c1, c2, dist // 10000 as bin, count(*) as k from fw group by 1, 2, 3, 4) h using (cluster_id, c1, c2, bin) group by 1, 2, 3, 4""", local=LOCAL, grouped=GROUPED, cells=CELLS, sized="select l.*, len from local l join contigs k on l.tid = k.tid", fw="select * from cells where not rc1 and not rc2 and c1 < c2")),
    "vcf_parse": (_variants, duckdb_text("""select chrom, pos, ref, alt, genotype, ref_depth, alt_depth, greatest(case genotype when 0 then least(p1, p2) - p0 when 1 then least(p0, p2) - p1 else least(p0, p1) - p2 end, 0) as qual, true as is_snv,
      ref_depth / cast(nullif(ref_depth + alt_depth, 0) as double) as raf, alt_depth / cast(nullif(ref_depth + alt_depth, 0) as double) as aaf, least(ref_depth / cast(nullif(ref_depth + alt_depth, 0) as double), alt_depth / cast(nullif(ref_depth + alt_depth, 0) as double)) as maf,
      case genotype when 0 then 'HOM_REF' when 1 then 'HET' else 'HOM_ALT' end as call from v where ref <> 'N' and alt <> 'N'""", v=VAR)),
    "allele_freq": (lambda s, d: R.allele_frequencies(_lines(s, d)), duckdb_text("""select case when sk % 2 = 0 then 'chr' else '' end || (sk % 24) || '_' || pos || '_' || ref || '_' || alt as tag, sum(ln) / cast(sum(20 + ln) as double) as freq from v group by 1""", v=VAR)),
    "flag_known": (lambda s, d: R.flag_known(_variants(s, d).select("chrom", "pos", "genotype"), _variants(s, d).where("genotype = 2 and ref_depth > 10")), duckdb_text("""select chrom, pos, genotype, (chrom, pos) in (select (chrom, pos) from v where genotype = 2 and ref_depth > 10 and ref <> 'N' and alt <> 'N') as known from v where ref <> 'N' and alt <> 'N'""", v=VAR)),
    "hap_inverted_index": (lambda s, d: R.haplotype_index(_haplotypes(s, d)).select("variant", F.size("clones").cast("bigint").alias("n"), F.array_join(F.transform("clones", lambda c: F.concat_ws(":", c["clone"], c["call"].cast("int"))), ",").alias("clones")), duckdb_text("select 'v' || l_partkey as variant, count(*) as n, string_agg(l_orderkey || ':' || (l_suppkey % 2), ',' order by l_orderkey, l_suppkey % 2) as clones from lineitem group by 1")),
    "hap_clone_calls": (lambda s, d: H.clone_calls(_clone_lines(s, d)).select("clone", "chrom", "start", "stop", "q", "variant", "pos", "ref", "alt", "call"), duckdb_text("""select dense_rank() over (order by l_orderkey) - 1 as clone, 'chr' || (l_orderkey % 24) as chrom, cast(l_orderkey * 100 as bigint) as start, cast(l_orderkey * 100 + 100 as bigint) as stop, 30.0e0 as q,
      'chr' || (l_orderkey % 24) || '_' || (l_orderkey * 100 + l_linenumber % 5) || '_A_C' as variant, cast(l_orderkey * 100 + l_linenumber % 5 as bigint) as pos, 'A' as ref, 'C' as alt, l_suppkey % 2 = 1 as call from lineitem""")),
    "hap_clone_alleles": (lambda s, d: H.clone_summary(H.clone_calls(_clone_lines(s, d))).select("clone", "n_calls", F.array_join("alleles", ",").alias("alleles")), duckdb_text("""select clone, cast(sum(n) as bigint) as n_calls, string_agg(pos || ':A_C_' || call, ',' order by pos) as alleles from (
      select clone, pos, count(*) as n, min(call) as call from (select dense_rank() over (order by l_orderkey) - 1 as clone, l_orderkey * 100 + l_linenumber % 5 as pos, l_suppkey % 2 as call from lineitem) x group by 1, 2) y group by 1""")),
    "hap_fragments": (_simulated, duckdb_text("""select row_number() over (order by c) - 1 as fragment, c % 31 as "offset", cast(length(replace(alleles, '0', '')) as bigint) as ones, cast(list_reduce(list_transform(range(60), lambda k: cast(substr(alleles, cast(k + 1 as int), 1) as bigint)), lambda x, y: x * 2 + y) as bigint) as first,
      case c % 3 when 0 then false when 1 then true end as truth from (select c, lpad(ltrim(cast(cast(c * 7919 % 65536 as integer)::bit as varchar), '0'), 16, '0') || repeat('01', 27) as alleles from (select cast(c_custkey as bigint) as c from customer) y) x""")),
    "sam_scan": (lambda s, d: R.alignments(_sam_lines(s, d), view(s, d, "contigs")).select("row_no", "qname", "flag", "tid", "pos", "mapq", "mtid", "mpos"), duckdb_text("select qid * 100 + ord as row_no, 'r' || qid as qname, flag, tid, pos, mapq, tid as mtid, pos + 4 as mpos from reads")),
    "contig_dictionary": (lambda s, d: R.contig_dictionary(view(s, d, "contigs").select(F.col("tid").alias("row_no"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("len")).alias("value"))), duckdb_text("select cast(row_number() over (order by tid) - 1 as int) as tid, name, len from contigs")),
    "tokenize": (lambda s, d: R.tokens(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" \t "), "p_type").alias("value")), compress=True).select("p_partkey", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", "|").alias("joined")), duckdb_text("select p_partkey, len(w) as n, array_to_string(w, '|') as joined from (select p_partkey, regexp_extract_all(p_name || ' ' || p_type, '[^ ]+') as w from part) x")),
    "csv_tokens": (lambda s, d: R.csv_tokens(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat("p_name", F.lit(",  "), "p_type").alias("value"))).select("p_partkey", F.array_join("tokens", "|").alias("joined")), duckdb_text("select p_partkey, p_name || '|' || p_type as joined from part")),
    "column_of": (lambda s, d: R.column_of(s.read.parquet(f"{d}/part.parquet").select(F.concat_ws("\t", "p_partkey", F.col("p_size"), F.lit("x")).alias("value")), 1, "int"), duckdb_text("select cast(p_size as int) as value from part")),
    "fasta_names": (lambda s, d: R.fasta_names(view(s, d, "contigs").select(F.lit("f").alias("file"), F.col("tid").alias("row_no"), F.when(F.col("tid") % 3 == 0, F.concat(F.lit(">"), "name", F.lit(" more"))).otherwise("ACGT").alias("value"))).select("row_no", "name"), duckdb_text("select tid as row_no, name from contigs where tid % 3 = 0")),
    "strip_comments": (lambda s, d: R.without_comments(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("#"), "p_name")).when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("p_name")).alias("value"))).select("p_partkey", "value"), duckdb_text("select p_partkey, p_name as value from part where p_partkey % 3 = 2")),
    "bed_scan": (lambda s, d: R.bed(view(s, d, "intervals").select(F.concat_ws("\t", F.concat(F.lit("chr"), "chr_id"), "a", "b", "cn").alias("value")), "int", "chr7"), duckdb_text("select 'chr7' as chrom, a as start, b as stop, cn from intervals where chr_id = 7")),
    "blast_hits": (lambda s, d: R.blast_hits(_blast_lines(s, d)).groupBy("query_id", "query").agg(F.count(F.lit(1)).alias("n"), F.sum("q_end").alias("ends")), duckdb_text("select cast(query_id as bigint) as query_id, 'q' || query_id as query, count(*) as n, cast(sum(q_end) as bigint) as ends from hits group by 1, 2")),
    "near_site_reads": (_near_sites, duckdb_text("select distinct r.qid || '.' || r.ord as id1, r.tid as chr_id from reads r join contigs c on c.tid = r.tid where flag = 0 and pos < 10000 + re_raw and 9500 < pos + 50")),
    "symbol_encode": (lambda s, d: Q.encode(view(s, d, "observations")), duckdb_text("select seq_id, t, cast(dense_rank() over (order by symbol) - 1 as int) as sid from observations")),
    "transition_matrix": (lambda s, d: Q.transition_matrix(view(s, d, "observations")), duckdb_text("select a, b, n, n / cast(sum(n) over (partition by a) as double) as p from (select symbol as a, nx as b, count(*) as n from (select symbol, lead(symbol) over (partition by seq_id order by t) as nx from observations) x where nx is not null group by 1, 2) y")),
    "state_frequencies": (lambda s, d: Q.state_frequencies(view(s, d, "observations")), duckdb_text("select symbol, count(*) as n, count(*) / cast((select count(*) from observations) as double) as p from observations group by 1")),
}
