"""Texts in part files, and scaffolds cut into lines over the borders of pieces."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chromaloom.operators import orderings as O
from chromaloom.sources import sinks


def whole_text(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_parts_one_after_another_are_the_text(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("line")).repartition(5)
    sinks.write_lines(rows, str(tmp_path / "many"), ["k"], header=["# first", "# second"], parts=8)
    sinks.write_lines(rows, str(tmp_path / "one"), ["k"], header=["# first", "# second"], parts=1)
    text = whole_text(tmp_path / "one")
    assert len(list((tmp_path / "many").glob("part-*"))) >= 6 and whole_text(tmp_path / "many") == text
    assert text.startswith("# first\n# second\n") and text.count("\n") == 3002
    for part in sinks.part_offsets(spark, str(tmp_path / "many")).collect():
        own = Path(part.file.removeprefix("file:")).read_text()
        assert len(own) == part.size and text[part.start : part.start + part.size] == own


@pytest.mark.parametrize("width", [1, 7, 80])
def test_scaffold_lines(spark, tmp_path, width):
    rng = random.Random(width)
    sequences = [(k, "".join(rng.choice("ACGTN") for _ in range(rng.choice([1, 5, 79, 80, 81, 400])))) for k in range(40)] + [(40, "NNNN"), (41, "ACNN"), (42, "NN")]
    ordering = [(k % 3, k // 3, k, rng.random() < 0.5, rng.choice([None, 0, 3, 200])) for k in range(40)] + [(0, 50, 40, False, 5), (3, 0, 41, False, 9), (3, 1, 42, True, 9), (4, 0, 43, False, 1)]
    sequences.append((43, "NNN"))
    frame = spark.createDataFrame(ordering, "cluster_id int, pos int, tid int, rc boolean, gap int").repartition(4)
    pieces = O.scaffold_pieces(frame, spark.createDataFrame(sequences, "tid int, seq string"), 30, parts=5)
    sinks.write_scaffolds(O.scaffold_lines(pieces, width), str(tmp_path / "out"), 6)
    seqs, want = dict(sequences), ""
    turn = str.maketrans("ACGT", "TGCA")
    for cluster in range(5):
        own = sorted(r for r in ordering if r[0] == cluster)
        text = re.sub("N+$", "", "".join((seqs[t][::-1].translate(turn) if rc else seqs[t]) + "N" * (30 if gap is None else gap) for _, _, t, rc, gap in own))
        want += f">group{cluster}__{len(own)}_contigs__length_{len(text)}\n" + "".join(text[k : k + width] + "\n" for k in range(0, len(text), width))
    assert whole_text(tmp_path / "out") == want
