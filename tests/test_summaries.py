"""Summaries of ranges are few however many groups there are; files and sequences stay spread over tasks."""

from chromaloom.functions import ordered as O
from chromaloom.functions import sequences as S
from chromaloom.operators import links as L
from chromaloom.sources import haplotypes as H
from pyspark.sql import functions as F


def test_summaries_of_many_groups_are_two_a_range(spark):
    rows = spark.range(2000).select((F.col("id") / 4).cast("int").alias("g"), "id")
    placed = O.dealt(rows, ["g", "id"], 5)
    assert O.at_borders(placed, ["g"]).select(O.PART, "g").distinct().count() <= 10
    summed = {r.id: r.s for r in O.running_sum(placed, ["g"], F.lit(1), "s").collect()}
    assert summed == {k: k % 4 + 1 for k in range(2000)}


def test_pairs_of_many_files_move_once_after_they_are_dealt(spark, capsys):
    reads = spark.range(400).select((F.col("id") / 4).cast("int").alias("file"), (F.col("id") % 4).alias("row_no"), F.concat(F.lit("r"), (F.col("id") / 2).cast("int")).alias("qname"))
    pairs = L.consecutive_pairs(reads, parts=5)
    assert pairs.count() == 200
    pairs.explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_lines_of_one_file_are_not_gathered(spark, capsys):
    lines = [("f", 0, "# N CLONES: 2"), ("f", 1, "# N VARIANTS: 1"), ("f", 2, "# TOTAL N CLONE CALLS OF VARIANTS: 2"), ("f", 3, "chr1_0_9\t30\tchr1_5_A_C,1"), ("f", 4, "chr1_1_9\t30\tchr1_5_A_C,0")]
    calls = H.clone_calls(spark.createDataFrame(lines, "file string, row_no long, value string"))
    assert sorted((r.clone, r.call) for r in calls.collect()) == [(0, True), (1, False)]
    calls.explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_motif_windows_do_not_deal_the_pieces(spark, capsys):
    rows = [(1, "ccGATCccccGATCc" + "c" * 40 + "gatcé"), (2, None), (3, ""), (4, "GATC"), (4, "ccccccGATCcc")]
    windows = S.motif_windows(spark.createDataFrame(rows, "key int, seq string"), "key", "seq", "GATC", 5)
    assert sorted((r.key, r.start, r.stop) for r in windows.collect()) == [(1, 0, 15), (1, 50, 60), (4, 0, 11)]
    windows.explain()
    assert "rangepartitioning" not in capsys.readouterr().out
