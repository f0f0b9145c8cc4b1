"""Sequences: complement, motifs, windows around sites, line wrapping, FASTA pieces."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chromaloom.functions.ordered import dealt, running_sum

#: IUPAC codes and their complements, and the bases each stands for.
CODES = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENTS = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "[AC]", "R": "[AG]", "W": "[AT]", "S": "[CG]", "Y": "[CT]", "K": "[GT]", "V": "[ACG]", "H": "[ACT]", "D": "[AGT]", "B": "[CGT]", "N": "[ACGT]"}


def reverse_complement(sequence: Column) -> Column:
    """The other strand, by IUPAC codes; case stays and other characters too."""
    return F.translate(F.reverse(sequence), CODES, COMPLEMENTS)


def motif_pattern(motif: str) -> str:
    """A regular expression for an IUPAC motif."""
    return "".join(BASES.get(c, c) for c in motif)


def motif_count(sequence: Column, motifs: str) -> Column:
    """Matches of the motifs, joined by ``_``, that do not overlap; forward strand, case as it is."""
    total = F.lit(0)
    for motif in motifs.split("_"):
        total = total + F.regexp_count(sequence, F.lit(motif_pattern(motif)))
    return total


def wrapped(sequence: Column, width: int = 80) -> Column:
    """The sequence in lines of ``width``."""
    return F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), "\n$", "")


def motif_positions(rows: DataFrame, key: str, sequence: str, motif: str, parts: int | None = None) -> DataFrame:
    """``key, pos``: where matches that do not overlap start, from 0; the sequence is taken in upper case.

    The lengths of the pieces between matches, added up over ranges of them,
    give the positions, so no Python runs and one long sequence takes many tasks
    once it is cut.
    """
    pattern = motif_pattern(motif)
    # letters of sequences are ASCII; others stay, so that positions do
    upper = F.translate(F.col(sequence), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    cut = F.split(upper, pattern)
    # the end of a piece is where a match starts, but for the last piece
    pieces = rows.select(key, F.posexplode(F.transform(cut, lambda p: F.length(p))).alias("k", "n"), (F.size(cut) - 1).alias("last"))
    summed = running_sum(dealt(pieces, [key, "k"], parts), [key], F.col("n"), "ends")
    return summed.where("k < last").select(key, (F.col("ends") + F.col("k") * len(motif)).cast("int").alias("pos"))


def motif_windows(rows: DataFrame, key: str, sequence: str, motif: str, reach: int, parts: int | None = None) -> DataFrame:
    """``key, start, stop``: windows of ``reach`` around motif sites, merged where they touch, cut to the sequence.

    The sites of a text are joined where the text lies, so a text is read once
    and only its windows move; windows of several rows of one key are merged
    too, and cut to the longest.
    """
    pattern = re.compile(motif_pattern(motif))
    upper = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def run(batches):
        for batch in batches:
            at, spans = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                first = last = None
                for found in pattern.finditer(text.translate(upper)) if text else ():
                    here = found.start()
                    if last is not None and here - last > 2 * reach:
                        at.append(row)
                        spans.append((first, last, len(text)))
                        first = None
                    first, last = here if first is None else first, here
                if last is not None:
                    at.append(row)
                    spans.append((first, last, len(text)))
            columns = [pa.array([s[k] for s in spans], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["key", "first", "last", "size"])

    texts = rows.select(F.col(key).alias("key"), F.col(sequence).alias("sequence"))
    schema = StructType([StructField("key", texts.schema["key"].dataType), *(StructField(n, IntegerType()) for n in ("first", "last", "size"))])
    spans = texts.mapInArrow(run, schema)
    spans = spans.repartition(parts, "key") if parts else spans
    in_key = Window.partitionBy("key").orderBy("first", "last")
    before = F.max("last").over(in_key.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("first") - before <= 2 * reach, 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(in_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    windows = islands.groupBy("key", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("size").alias("size"))
    return windows.select(F.col("key").alias(key), F.greatest(F.col("first") - reach, F.lit(0)).alias("start"), F.least(F.col("last") + reach, "size").alias("stop"))
