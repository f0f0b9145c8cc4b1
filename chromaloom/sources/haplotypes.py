"""Haplotype matrices: which of two alleles each fragment of a genome shows at each variant.

Two text formats declare in their first lines how much is to follow.  The
declared numbers are held against what is there by aggregates, and rows of a
file whose numbers differ cannot be read.  Functions take lines with ``file,
row_no, value`` (see :func:`chromaloom.sources.files.lines`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.functions.intervals import overlap_join
from chromaloom.functions.ordered import dealt, running_sum

#: Bits of a fragment that are kept in one long.
WORD_BITS = 60
#: How the numbers are declared.
DECLARED = {
    "n_fragments": r"N FRAGMENTS: (\d+)",
    "n_loci": r"N LOCI: (\d+)",
    "fragment_size": r"FRAGMENT SIZE: (\d+)",
    "haplotype": r"TRUTH HAPLOTYPE: (\d+)",
    "n_clones": r"N CLONES: (\d+)",
    "n_variants": r"N VARIANTS: (\d+)",
    "n_calls": r"TOTAL N CLONE CALLS OF VARIANTS: (\d+)",
}


def _found(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))


def declared(lines: DataFrame) -> DataFrame:
    """``file`` and what its first lines declare, null where they do not; the last of several holds."""
    named = [F.max_by(_found(p), F.when(_found(p).isNotNull(), F.col("row_no"))).alias(name) for name, p in DECLARED.items()]
    return lines.groupBy("file").agg(*named).select("file", "haplotype", *(F.col(n).cast("bigint").alias(n) for n in DECLARED if n != "haplotype"))


def _data(lines: DataFrame) -> DataFrame:
    """Lines that neither declare anything nor are comments, nor blank."""
    kept = lines.where(~F.col("value").contains("#") & (F.trim("value") != ""))
    for pattern in DECLARED.values():
        kept = kept.where(~F.col("value").rlike(pattern))
    return kept


def _numbered(rows: DataFrame, name: str, parts: int | None) -> DataFrame:
    """Rows with their number, from 0, in the order of their file."""
    counted = running_sum(dealt(rows, ["file", "row_no"], parts), ["file"], F.lit(1), name)
    return counted.select(*rows.columns, (F.col(name) - 1).alias(name))


def _refused(problem: Column, value: Column) -> Column:
    """The value, or an error with the first problem that there is."""
    return F.when(problem.isNull(), value).otherwise(F.raise_error(F.concat_ws(": ", F.col("file"), problem)).cast("bigint"))


def _differs(what: str, found: str, expected: str) -> Column:
    return F.when(~F.col(found).eqNullSafe(F.col(expected)), F.concat_ws(" ", F.lit(what), F.col(found).cast("string"), F.lit("of"), F.coalesce(F.col(expected).cast("string"), F.lit("none"))))


def simulated_fragments(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """``file, fragment, offset, size, bits, truth`` of matrices of simulated fragments.

    A line has the first locus of a fragment, its alleles as ones and zeros, and
    the haplotype it is from: 0, 1, or E for an error.  ``bits`` holds the
    alleles in longs of 60 bits, the first allele highest (the last long has
    what is left); ``truth`` is null for an error.  Lines of another form,
    fragments of another size or beyond the last locus, a haplotype of another
    length and numbers other than declared are errors.
    """
    kind = r"^(\d+)\s+([01]+)\s+([01E])$"
    part = lambda k: F.regexp_extract("value", kind, k)
    rows = _data(lines).select("file", "row_no", "value", F.nullif(part(1), F.lit("")).cast("bigint").alias("offset"), part(2).alias("alleles"), part(3).alias("from"))
    expected = declared(lines)
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("found"))
    sides = expected.join(counts, "file", "left").select("file", "n_loci", "fragment_size", F.coalesce(_differs("fragments", "found", "n_fragments"), F.when(~F.length("haplotype").cast("bigint").eqNullSafe(F.col("n_loci")), F.lit("a haplotype of another length"))).alias("problem"))
    # a row a file: beside it lines stay where they are, as those of one file would meet in one task
    numbered = _numbered(rows, "fragment", parts).join(F.broadcast(sides), "file")
    size = F.length("alleles")
    problem = F.coalesce(
        F.col("problem"),
        F.when(F.col("offset").isNull(), F.concat(F.lit("no fragment: "), F.col("value"))),
        F.when(~size.cast("bigint").eqNullSafe(F.col("fragment_size")), F.concat(F.lit("another size: "), F.col("value"))),
        F.when(F.col("offset") + size > F.col("n_loci"), F.concat(F.lit("beyond the last locus: "), F.col("value"))),
    )
    words = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / WORD_BITS).cast("int")), lambda k: F.conv(F.substring("alleles", k * WORD_BITS + 1, F.lit(WORD_BITS)), 2, 10).cast("bigint"))
    truth = F.when(F.col("from") != "E", F.col("from") == "1")
    return numbered.select("file", _refused(problem, F.col("fragment")).alias("fragment"), "offset", size.alias("size"), words.alias("bits"), truth.alias("truth"))


def fragment_calls(fragments: DataFrame) -> DataFrame:
    """``file, fragment, locus, call``: the packed alleles of fragments, a row each."""
    held = F.least(F.lit(WORD_BITS), F.col("size") - F.col("word") * WORD_BITS)
    words = fragments.select("file", "fragment", "offset", "size", F.posexplode("bits").alias("word", "w"))
    each = words.withColumn("k", F.explode(F.sequence(F.lit(0), held - 1)))
    call = F.call_function("shiftright", F.col("w"), (held - 1 - F.col("k")).cast("int")).bitwiseAND(F.lit(1)) == 1
    return each.select("file", "fragment", (F.col("offset") + F.col("word") * WORD_BITS + F.col("k")).alias("locus"), call.alias("call"))


def ones(fragments: DataFrame) -> Column:
    """How many alleles of a fragment are ones, from the packed bits."""
    return F.aggregate("bits", F.lit(0), lambda total, w: total + F.bit_count(w))


def _clones(lines: DataFrame, excluded: DataFrame | None, parts: int | None) -> DataFrame:
    """``file, clone, chrom, start, stop, q, calls, value``: lines of clones with their calls as text; those that overlap an excluded interval go."""
    f = F.split("value", "\t", -1)
    kind = r"^([^_]+)_(\d+)_(\d+)$"
    place = lambda k: F.regexp_extract(f[0], kind, k)
    rows = _data(lines).select("file", "row_no", "value", F.nullif(place(1), F.lit("")).alias("chrom"), F.nullif(place(2), F.lit("")).cast("bigint").alias("start"), F.nullif(place(3), F.lit("")).cast("bigint").alias("stop"), F.coalesce(f[1].try_cast("double"), F.lit(0.0)).alias("q"), F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0))).alias("calls"))
    if excluded is not None:
        left = rows.select("chrom", F.struct("file", "row_no").alias("id1"), F.col("start").alias("a1"), F.col("stop").alias("b1"))
        right = excluded.select("chrom", F.lit(0).alias("id2"), F.col("start").alias("a2"), F.col("stop").alias("b2"))
        gone = overlap_join(left, right, "chrom").select("id1.file", "id1.row_no").distinct()
        rows = rows.join(gone, ["file", "row_no"], "left_anti")
    return _numbered(rows, "clone", parts)


def clone_calls(lines: DataFrame, excluded: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``file, clone, chrom, start, stop, q, variant, pos, ref, alt, call`` of matrices of real clones, a row for each call.

    A line has the clone's place (``chr_start_end``), its quality (0 if it is no
    number) and a ``variant,call`` or more; a variant is ``chr_pos_ref_alt`` and
    lies within the clone.  Lines of another form and numbers of clones, calls
    and variants other than declared are errors; with ``excluded`` intervals
    (``chrom, start, stop``) clones that overlap one are passed over, and the
    numbers are those of what is left.
    """
    clones = _clones(lines, excluded, parts)
    each = clones.select("*", F.explode_outer("calls").alias("text"))
    kind = r"^(([^_]*)_(\d+)_([^_]*)_([^_]*)),([01])$"
    part = lambda k: F.regexp_extract("text", kind, k)
    calls = each.select("file", "clone", "chrom", "start", "stop", "q", "value", "text", F.nullif(part(1), F.lit("")).alias("variant"), F.nullif(part(3), F.lit("")).cast("bigint").alias("pos"), part(4).alias("ref"), part(5).alias("alt"), (part(6) == "1").alias("call"))
    wrong = F.when(F.col("start").isNull() | F.col("stop").isNull() | F.col("text").isNull(), F.concat(F.lit("no clone: "), F.col("value"))).when(F.col("variant").isNull(), F.concat(F.lit("no call: "), F.col("text"))).when(~F.col("pos").between(F.col("start"), F.col("stop") - 1), F.concat(F.lit("outside its clone: "), F.col("text")))
    if excluded is None:
        found = calls.groupBy("file").agg(F.count(F.lit(1)).alias("calls_found"), (F.max("clone") + 1).alias("clones_found"), F.count_distinct("variant").alias("variants_found"))
        problems = [_differs(what, f"{what}_found", f"n_{what}") for what in ("clones", "calls", "variants")]
        sides = declared(lines).join(found, "file", "left").select("file", F.coalesce(*problems).alias("problem"))
        # a row a file: beside it calls stay where they are
        calls = calls.join(F.broadcast(sides), "file")
        wrong = F.coalesce(wrong, F.col("problem"))
    return calls.select("file", _refused(wrong, F.col("clone")).alias("clone"), "chrom", "start", "stop", "q", "variant", "pos", "ref", "alt", "call")


def clone_summary(calls: DataFrame) -> DataFrame:
    """``file, clone, chrom, start, stop, q, n_calls, alleles``: clones with ``pos:ref_alt_call`` of their variants in order, the first of a place."""
    first = calls.groupBy("file", "clone", "pos").agg(F.min(F.struct("ref", "alt", F.col("call").cast("int").alias("call"))).alias("x"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("chrom", "start", "stop", "q")))
    spelled = F.concat(F.col("pos").cast("string"), F.lit(":"), F.concat_ws("_", "x.ref", "x.alt", "x.call"))
    grouped = first.groupBy("file", "clone").agg(*(F.first(c).alias(c) for c in ("chrom", "start", "stop", "q")), F.sum("n").alias("n_calls"), F.array_sort(F.collect_list(F.struct("pos", spelled.alias("s")))).alias("x"))
    return grouped.select("file", "clone", "chrom", "start", "stop", "q", "n_calls", F.transform("x", lambda x: x["s"]).alias("alleles"))


def by_variant(calls: DataFrame) -> DataFrame:
    """``variant, clones``: the clones that hold a variant, with their calls."""
    return calls.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("clone", "call"))).alias("clones"))
