"""Lines of text formats to columns: alignments, FASTA, BLAST, BED, VCF, haplotypes, counts.

Each function takes a DataFrame with ``value`` (and, where order matters,
``file`` and ``row_no``; see :func:`chromaloom.sources.files.lines`) and stays in
built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.functions.ordered import dealt, ranked, running_sum

#: How a sequence begins in FASTA, and a query in tabular BLAST output.
FASTA_HEADER, BLAST_HEADER = ">", "# BLAST"

_BLAST = "query subject identity:double length:int mismatches:int gap_opens:int q_start:int q_end:int s_start:int s_end:int evalue:double bitscore:double"


def tokens(lines: DataFrame, delimiters: str = " \t", compress: bool = False) -> DataFrame:
    """``lines`` with ``tokens``; runs of delimiters count as one with ``compress``, when the ends of a line are cut too."""
    kind = f"[{delimiters}]" + ("+" if compress else "")
    value = F.regexp_replace("value", f"^[{delimiters}]+|[{delimiters}]+$", "") if compress else F.col("value")
    return lines.withColumn("tokens", F.split(value, kind, -1))


def column_of(lines: DataFrame, place: int, kind: str) -> DataFrame:
    """``value`` of one column of space- or tab-separated lines; a short line or a bad value is an error."""
    parts = F.split("value", "[ \t]")
    field = F.when(F.size(parts) > place, parts[place]).otherwise(F.raise_error(F.concat(F.lit("too few columns: "), F.col("value"))))
    return lines.select(field.cast(kind).alias("value"))


def csv_tokens(lines: DataFrame) -> DataFrame:
    """``lines`` with ``tokens`` split at commas, spaces before each cut."""
    return lines.withColumn("tokens", F.transform(F.split("value", ",", -1), lambda t: F.ltrim(t)))


def without_comments(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor begin with ``#``."""
    return lines.where(~F.col("value").rlike(r"^(#|$)"))


def contig_dictionary(lines: DataFrame) -> DataFrame:
    """``tid, name, len`` from the ``@SQ`` lines of one header, numbered in file order."""
    found = lines.where(F.col("value").startswith("@SQ"))
    numbered = ranked(found.select("row_no", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("len")), ["row_no"], "tid")
    return numbered.select(F.col("tid").cast("int").alias("tid"), "name", "len")


def below_headers(lines: DataFrame, header: str, parts: int | None = None) -> DataFrame:
    """``lines`` with ``head``: the number, within the file and from 0, of the last line so far that begins with ``header``; -1 before the first.

    Lines of :func:`chromaloom.sources.files.headed` have it already.  Others
    are scanned in ranges of their order, and what each range counts is handed
    on to the next.
    """
    if "head" in lines.columns:
        return lines
    counted = running_sum(dealt(lines, ["file", "row_no"], parts), ["file"], F.col("value").startswith(header).cast("long"), "head")
    return counted.select(*lines.columns, (F.col("head") - 1).alias("head"))


def alignments(lines: DataFrame, contigs: DataFrame) -> DataFrame:
    """Records of SAM lines: ``file, row_no, qname, flag, tid, pos, mapq, mtid, mpos``; positions from 0, -1 for none."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@")).select("file", "row_no", f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), (f[3].cast("bigint") - 1).alias("pos"), f[4].cast("int").alias("mapq"), F.when(f[6] == "=", f[2]).otherwise(f[6]).alias("mname"), (f[7].cast("bigint") - 1).alias("mpos"))
    one, two = (contigs.select(F.col("name").alias(n), F.col("tid").alias(t)) for n, t in (("rname", "tid"), ("mname", "mtid")))
    joined = rows.join(one, "rname", "left").join(two, "mname", "left")
    return joined.select("file", "row_no", "qname", "flag", F.coalesce("tid", F.lit(-1)).alias("tid"), "pos", "mapq", F.coalesce("mtid", F.lit(-1)).alias("mtid"), "mpos")


def fasta_names(lines: DataFrame) -> DataFrame:
    """``file, row_no, name``: the first word of each header line."""
    return lines.where(F.col("value").startswith(">")).select("file", "row_no", F.regexp_extract("value", r"^>(\S*)", 1).alias("name"))


def fasta_sizes(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """``file, tid, name, size``: the letters below each header; no sequence is put together."""
    header = F.col("value").startswith(FASTA_HEADER)
    own = F.when(header, F.regexp_extract("value", r"^>(\S*)", 1))
    sizes = below_headers(lines, FASTA_HEADER, parts).where("head >= 0").groupBy("file", F.col("head").alias("tid"))
    return sizes.agg(F.max(own).alias("name"), F.coalesce(F.sum(F.when(~header, F.length(F.trim("value")))), F.lit(0)).alias("size"))


def fasta_sequences(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """``file, tid, name, seq``: the joined lines below each header."""
    header = F.col("value").startswith(FASTA_HEADER)
    name = F.max(F.when(header, F.regexp_extract("value", r"^>(\S*)", 1)))
    body = F.array_sort(F.collect_list(F.when(~header, F.struct("row_no", F.trim("value").alias("s")))))
    sequences = below_headers(lines, FASTA_HEADER, parts).where("head >= 0").groupBy("file", F.col("head").alias("tid"))
    return sequences.agg(name.alias("name"), F.array_join(F.transform(body, lambda x: x["s"]), "").alias("seq"))


def blast_hits(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of tabular BLAST output with ``query_id``, the number of the query's header over all files in order."""
    headed = below_headers(lines, BLAST_HEADER, parts)
    # headers are counted within a file and shifted by those of the files before; a row for each file
    counts = headed.groupBy("file").agg((F.max("head") + 1).alias("n"))
    before = running_sum(dealt(counts.withColumn("all", F.lit(0)), ["file"]), ["all"], F.col("n"), "upto").select("file", (F.col("upto") - F.col("n")).alias("before"))
    marked = headed.where(~F.col("value").startswith("#")).join(before, "file").withColumnRenamed("head", "own")
    f = F.split("value", "\t")
    columns = []
    for k, field in enumerate(_BLAST.split()):
        name, _, kind = field.partition(":")
        columns.append(f[k].cast(kind or "string").alias(name))
    return marked.select("file", "row_no", (F.col("before") + F.col("own")).alias("query_id"), *columns)


def bed(lines: DataFrame, fourth: str | None = None, chrom: str | None = None) -> DataFrame:
    """``chrom, start, stop`` and, with ``fourth`` (a type), ``cn`` of BED-like lines."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").rlike("^(#|track|$)")).select(f[0].alias("chrom"), f[1].cast("bigint").alias("start"), f[2].cast("bigint").alias("stop"), *([f[3].cast(fourth).alias("cn")] if fourth else []))
    return rows if chrom is None else rows.where(F.col("chrom") == chrom)


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.cast("int"))


def vcf(lines: DataFrame) -> DataFrame:
    """Variants: ``chrom, pos, tag, ref, alt, genotype, ref_depth, alt_depth, qual``.

    FORMAT and values are zipped; the genotype counts alternate alleles; depths
    are AD, else the sums of DP4's pairs; the quality is the second least
    phred-scaled likelihood less the called one, 0 at least.  Lines with other
    bases than ACGT are dropped and ``chr`` goes before a name that lacks it.
    """
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(f[0].alias("c"), f[1].cast("bigint").alias("pos"), f[2].alias("tag"), F.upper(f[3]).alias("ref"), F.upper(f[4]).alias("alt"), f[7].alias("info"), F.map_from_arrays(F.split(f[8], ":"), F.split(f[9], ":")).alias("v"))
    rows = rows.where(F.col("ref").rlike("^[ACGT]+$") & F.col("alt").rlike("^[ACGT]+$"))
    get = lambda k: F.try_element_at("v", F.lit(k))
    genotype = (F.substring(get("GT"), 1, 1) == "1").cast("int") + (F.substring(get("GT"), 3, 1) == "1").cast("int")
    ad, dp4 = _numbers(get("AD")), _numbers(F.nullif(F.regexp_extract("info", r"DP4=([\d,]+)", 1), F.lit("")))
    likelihoods = _numbers(get("PL"))
    rows = rows.select("*", genotype.alias("genotype"), F.coalesce(ad[0], dp4[0] + dp4[1]).alias("ref_depth"), F.coalesce(ad[1], dp4[2] + dp4[3]).alias("alt_depth"), likelihoods.alias("pl"))
    others = F.array_min(F.filter("pl", lambda x, k: k != F.col("genotype")))
    return rows.select(F.when(F.col("c").startswith("chr"), F.col("c")).otherwise(F.concat(F.lit("chr"), "c")).alias("chrom"), "pos", "tag", "ref", "alt", "genotype", "ref_depth", "alt_depth", F.greatest(others - F.col("pl")[F.col("genotype")], F.lit(0)).alias("qual"))


def with_fractions(variants: DataFrame) -> DataFrame:
    """Variants with ``is_snv, is_indel``, allele fractions (``raf, aaf, maf``) and ``call``."""
    depth = F.nullif(F.col("ref_depth") + F.col("alt_depth"), F.lit(0))
    snv = (F.length("ref") == 1) & (F.length("alt") == 1)
    raf, aaf = F.col("ref_depth") / depth, F.col("alt_depth") / depth
    call = F.when(F.col("genotype") == 0, "HOM_REF").when(F.col("genotype") == 1, "HET").otherwise("HOM_ALT")
    return variants.select("*", snv.alias("is_snv"), (~snv).alias("is_indel"), raf.alias("raf"), aaf.alias("aaf"), F.least(raf, aaf).alias("maf"), call.alias("call"))


def allele_frequencies(lines: DataFrame) -> DataFrame:
    """``tag, freq`` of single-base variants: allele counts over allele numbers, summed over files."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(f[0].alias("c"), f[1].alias("p"), f[3].alias("ref"), f[4].alias("alt"), F.regexp_extract(f[7], r"(?:^|;)AC=(\d+)", 1).cast("bigint").alias("ac"), F.regexp_extract(f[7], r"(?:^|;)AN=(\d+)", 1).cast("bigint").alias("an"))
    rows = rows.where((F.length("ref") == 1) & (F.length("alt") == 1))
    return rows.groupBy(F.concat_ws("_", "c", "p", "ref", "alt").alias("tag")).agg((F.sum("ac") / F.sum("an")).alias("freq"))


def flag_known(variants: DataFrame, known: DataFrame) -> DataFrame:
    """Variants with ``known``: whether the place is in the second table."""
    places = known.select("chrom", "pos").distinct().withColumn("known", F.lit(True))
    return variants.join(places, ["chrom", "pos"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def haplotype_index(lines: DataFrame) -> DataFrame:
    """``variant, clones``: from lines ``clone, score, variant, call, variant, call ..`` the clones with their calls for each variant."""
    f = F.split("value", "\t")
    rows = lines.select(f[0].cast("bigint").alias("clone"), F.slice(f, F.lit(3), F.size(f) - 2).alias("x"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda k: F.struct(F.get("x", 2 * k).alias("variant"), (F.get("x", 2 * k + 1) == "1").alias("call")))
    each = rows.select("clone", F.explode(pairs).alias("p")).select("clone", "p.variant", "p.call")
    return each.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("clone", "call"))).alias("clones"))


def count_column(lines: DataFrame) -> DataFrame:
    """``symbol, p``: counts of symbols as shares of all."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select(f[0].alias("symbol"), f[1].cast("bigint").alias("n"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("n").cast("double").alias("total")))).select("symbol", (F.col("n") / F.col("total")).alias("p"))


def alignment_columns(blocks: DataFrame) -> DataFrame:
    """``block, k, symbol``: the columns of three aligned sequences ``s1, s2, s3``, read downward."""
    at = F.sequence(F.lit(1), F.length("s1"))
    symbols = F.transform(at, lambda k: F.concat(F.substring("s1", k, F.lit(1)), F.substring("s2", k, F.lit(1)), F.substring("s3", k, F.lit(1))))
    return blocks.select("block", F.posexplode(symbols).alias("k", "symbol"))
