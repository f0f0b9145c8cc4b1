import random

import pytest

from chromaloom.sources import haplotypes as H

FRAGMENTS = """# made by hand
# N FRAGMENTS: 4
# N LOCI: 9
# FRAGMENT SIZE: 5
# TRUTH HAPLOTYPE: 010110011
0 01011 0
1\t10110  1
4 11111 E
2 00000 1
"""
CLONES = """# N CLONES: 3
# N VARIANTS: 4
# TOTAL N CLONE CALLS OF VARIANTS: 5
chr1_100_200\t12.5\tchr1_100_A_C,1\tchr1_150_G_T,0
chr1_140_300\tnone\tchr1_150_G_T,1\tchr1_299_C_G,0
chrX_5_9\t3\tchrX_8_T_A,1
"""


def lines(spark, text, file="f"):
    return spark.createDataFrame([(file, k, v) for k, v in enumerate(text.splitlines())], "file string, row_no long, value string").repartition(3)


def test_simulated_fragments(spark):
    fragments = H.simulated_fragments(lines(spark, FRAGMENTS), parts=3)
    got = [(r.fragment, r.offset, r.size, r.bits, r.truth) for r in fragments.orderBy("fragment").collect()]
    assert got == [(0, 0, 5, [0b01011], False), (1, 1, 5, [0b10110], True), (2, 4, 5, [0b11111], None), (3, 2, 5, [0], True)]
    calls = {(r.fragment, r.locus): r.call for r in H.fragment_calls(fragments).collect()}
    assert [calls[1, k] for k in range(1, 6)] == [True, False, True, True, False] and len(calls) == 20
    assert [r.n for r in fragments.orderBy("fragment").select(H.ones(fragments).alias("n")).collect()] == [3, 3, 5, 0]


@pytest.mark.parametrize("size", [1, 59, 60, 61, 200])
def test_long_fragments_keep_every_bit(spark, size):
    rng = random.Random(size)
    alleles = ["".join(rng.choice("01") for _ in range(size)) for _ in range(6)]
    text = f"#N FRAGMENTS: 6\n#N LOCI: {size + 6}\n#FRAGMENT SIZE: {size}\n#TRUTH HAPLOTYPE: {'1' * (size + 6)}\n" + "".join(f"{k} {a} E\n" for k, a in enumerate(alleles))
    calls = H.fragment_calls(H.simulated_fragments(lines(spark, text))).collect()
    found = {(r.fragment, r.locus - r.fragment): r.call for r in calls}
    assert ["".join(str(int(found[n, k])) for k in range(size)) for n in range(6)] == alleles


@pytest.mark.parametrize(
    "change, said",
    [
        (("N FRAGMENTS: 4", "N FRAGMENTS: 5"), "fragments 4 of 5"),
        (("# N FRAGMENTS: 4\n", ""), "fragments 4 of none"),
        (("4 11111 E", "4 1111 E"), "another size"),
        (("4 11111 E", "5 11111 E"), "beyond the last locus"),
        (("4 11111 E", "4 11111 F"), "no fragment"),
        (("010110011", "01011001"), "haplotype of another length"),
    ],
)
def test_fragments_that_are_refused(spark, change, said):
    with pytest.raises(Exception, match=said):
        H.simulated_fragments(lines(spark, FRAGMENTS.replace(*change))).collect()


def test_real_clones(spark):
    calls = H.clone_calls(lines(spark, CLONES), parts=2)
    got = [(r.clone, r.chrom, r.start, r.stop, r.q, r.variant, r.pos, r.ref, r.alt, r.call) for r in calls.orderBy("clone", "pos").collect()]
    assert got == [
        (0, "chr1", 100, 200, 12.5, "chr1_100_A_C", 100, "A", "C", True),
        (0, "chr1", 100, 200, 12.5, "chr1_150_G_T", 150, "G", "T", False),
        (1, "chr1", 140, 300, 0.0, "chr1_150_G_T", 150, "G", "T", True),
        (1, "chr1", 140, 300, 0.0, "chr1_299_C_G", 299, "C", "G", False),
        (2, "chrX", 5, 9, 3.0, "chrX_8_T_A", 8, "T", "A", True),
    ]
    assert {r.variant: [tuple(c) for c in r.clones] for r in H.by_variant(calls).collect()}["chr1_150_G_T"] == [(0, False), (1, True)]
    assert {r.clone: r.alleles for r in H.clone_summary(calls).collect()}[0] == ["100:A_C_1", "150:G_T_0"]
    arms = spark.createDataFrame([("chr1", 0, 120)], "chrom string, start long, stop long")
    left = H.clone_calls(lines(spark, CLONES), arms).orderBy("clone", "pos").collect()
    assert [(r.clone, r.variant) for r in left] == [(0, "chr1_150_G_T"), (0, "chr1_299_C_G"), (1, "chrX_8_T_A")]


@pytest.mark.parametrize(
    "change, said",
    [
        (("N CLONES: 3", "N CLONES: 2"), "clones 3 of 2"),
        (("N VARIANTS: 4", "N VARIANTS: 5"), "variants 4 of 5"),
        (("VARIANTS: 5", "VARIANTS: 6"), "calls 5 of 6"),
        (("chrX_8_T_A,1", "chrX_8_T_A,2"), "no call|variants 3 of 4"),
        (("chrX_8_T_A,1", "chrX_9_T_A,1"), "outside its clone"),
        (("chrX_5_9", "chrX_5"), "no clone"),
    ],
)
def test_clones_that_are_refused(spark, change, said):
    with pytest.raises(Exception, match=said):
        H.clone_calls(lines(spark, CLONES.replace(*change))).collect()
