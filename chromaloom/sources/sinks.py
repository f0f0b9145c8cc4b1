"""Writing results: Parquet by group, and text files for other tools.

A text is a folder of part files, dealt by ranges of its order: the parts one
after another, by name, are the text.  The Parquet tables are the form that
later steps read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaloom.functions.sequences import wrapped


def write_table(rows: DataFrame, path: str, by: str | None = None) -> None:
    """A Parquet table, split by a column if asked."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_lines(rows: DataFrame, path: str, order: list[str], line: str = "line", header: list[str] | None = None, parts: int | None = None) -> None:
    """A text of a column's lines in order, below header lines, in as many part files as there are ranges.

    Part files are named in order; those of one text, put one after another, are
    the text in one file (see :func:`part_offsets`).
    """
    body = rows.select(F.lit(1).alias("__part"), *order, F.col(line).alias("value"))
    if header:
        spark = rows.sparkSession
        head = spark.createDataFrame([(0, k, h) for k, h in enumerate(header)], "__part int, __k int, value string")
        body = head.unionByName(body, allowMissingColumns=True)
        order = ["__k", *order]
    keys = ["__part", *order]
    dealt = body.repartitionByRange(parts, *keys) if parts else body.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(path)


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, size``: the part files of a text in order, with the byte of the text where each begins; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    # a row for each part
    before = F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return files.select("file", F.coalesce(before, F.lit(0)).alias("start"), "size")


def write_link_matrix(links: DataFrame, path: str, n_contigs: int, source: str = "") -> None:
    """The matrix as text: a header, then row, column and links, by row; no diagonal and no zeros."""
    kept = links.where("i <> j and z <> 0").select("i", "j", F.concat_ws("\t", "i", "j", "z").alias("line"))
    write_lines(kept, path, ["i", "j"], header=[f"# N_contigs = {n_contigs}", f"# source = {source}", "X\tY\tZ"])


def write_group_links(cells: DataFrame, path: str) -> None:
    """The links of one group as text: bins, a count and all distances of each cell, however long the line."""
    x, y = F.col("c1") * 2 + F.col("rc1").cast("int"), F.col("c2") * 2 + F.col("rc2").cast("int")
    rows = cells.select(x.alias("x"), y.alias("y"), "dist").groupBy("x", "y").agg(F.sort_array(F.collect_list("dist")).alias("d"))
    write_lines(rows.select("x", "y", F.concat_ws("\t", "x", "y", F.size("d"), F.array_join(F.transform("d", lambda v: v.cast("string")), "\t")).alias("line")), path, ["x", "y"], header=["X\tY\tZ\tdists"])


def write_bins(lsd: DataFrame, path: str) -> None:
    """The link size distribution: starts and densities, and a last row for the end."""
    last = lsd.agg(F.max("stop").alias("start")).select("start", F.concat_ws("\t", "start", F.lit("0")).alias("line"))
    write_lines(lsd.select("start", F.concat_ws("\t", "start", "density").alias("line")).unionByName(last), path, ["start"], header=["bin_start\tlink_density"])


def write_fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    """``name, seq`` as FASTA in lines of ``width``."""
    write_lines(sequences.select("name", F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.col("seq"), width)).alias("line")), path, ["name"])


def write_scaffolds(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """The lines of :func:`chromaloom.operators.orderings.scaffold_lines` as FASTA; no scaffold is held whole."""
    write_lines(lines, path, ["cluster_id", "line_no"], parts=parts)


def write_graph(edges: DataFrame, path: str, directed: bool = False) -> None:
    """Edges ``a, b`` as a graph description for plotting tools."""
    arrow = "->" if directed else "--"
    body = edges.select(F.lit(1).alias("part"), "a", "b", F.concat(F.col("a").cast("string"), F.lit(f" {arrow} "), F.col("b").cast("string"), F.lit(";")).alias("line"))
    end = edges.sparkSession.createDataFrame([(2, 0, 0, "}")], "part int, a int, b int, line string")
    write_lines(body.unionByName(end.select("part", F.col("a").cast(edges.schema["a"].dataType), F.col("b").cast(edges.schema["b"].dataType), "line")), path, ["part", "a", "b"], header=[("digraph" if directed else "graph") + " G {"])


def write_bed(rows: DataFrame, path: str) -> None:
    """``chrom, start, stop`` and further columns as BED."""
    rest = [c for c in rows.columns if c not in ("chrom", "start", "stop")]
    write_lines(rows.select("chrom", "start", "stop", F.concat_ws("\t", "chrom", "start", "stop", *rest).alias("line")), path, ["chrom", "start", "stop"])


def write_haplotype_calls(calls: DataFrame, path: str, chromosomes: DataFrame, parts: int | None = None) -> None:
    """The calls of :func:`chromaloom.functions.intervals.haplotype_calls` as BED with the copies, and those of both haplotypes; ``chromosomes`` has ``chrom, name``, and ``chrom`` their order."""
    line = F.concat_ws("\t", "name", "start", "stop", "cn", "major", "minor").alias("line")
    write_lines(calls.join(chromosomes, "chrom").select("chrom", "start", "stop", line), path, ["chrom", "start", "stop"], parts=parts)
