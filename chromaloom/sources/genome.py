"""Static dimensions of the human reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Chromosome lengths of the human reference (build 37), in order.
LENGTHS = [
    ("chr1", 249250621), ("chr2", 243199373), ("chr3", 198022430), ("chr4", 191154276), ("chr5", 180915260), ("chr6", 171115067), ("chr7", 159138663), ("chr8", 146364022),
    ("chr9", 141213431), ("chr10", 135534747), ("chr11", 135006516), ("chr12", 133851895), ("chr13", 115169878), ("chr14", 107349540), ("chr15", 102531392), ("chr16", 90354753),
    ("chr17", 81195210), ("chr18", 78077248), ("chr19", 59128983), ("chr20", 63025520), ("chr21", 48129895), ("chr22", 51304566), ("chrX", 155270560), ("chrY", 59373566),
]

#: Where the centromeres of the same build start; each is three million bases long.
CENTROMERES = {
    "chr1": 121535434, "chr2": 92326171, "chr3": 90504854, "chr4": 49660117, "chr5": 46405641, "chr6": 58830166, "chr7": 58054331, "chr8": 43838887, "chr9": 47367679, "chr10": 39254935,
    "chr11": 51644205, "chr12": 34856694, "chr13": 16000000, "chr14": 16000000, "chr15": 17000000, "chr16": 35335801, "chr17": 22263006, "chr18": 15460898, "chr19": 24681782, "chr20": 26369569,
    "chr21": 11288129, "chr22": 13000000, "chrX": 58632012, "chrY": 10104553,
}
CENTROMERE_BASES = 3_000_000
#: Chromosome arms of the HeLa line with a loss of heterozygosity.
LOSS_OF_HETEROZYGOSITY = [
    ("chr2", 106690500, 243199373), ("chr3", 94505000, 198022430), ("chr5", 0, 46405641), ("chr6", 0, 57182000), ("chr6", 58830166, 171115067), ("chr11", 102210000, 135006516),
    ("chr13", 19200000, 115169878), ("chr19", 0, 12885000), ("chr22", 17515000, 51304566), ("chrX", 0, 58632012), ("chrX", 61632012, 155270560),
]


def centromeres(spark: SparkSession) -> DataFrame:
    """``name, start, stop, middle``."""
    rows = [(n, a, a + CENTROMERE_BASES, a + CENTROMERE_BASES // 2) for n, a in CENTROMERES.items()]
    return spark.createDataFrame(rows, "name string, start long, stop long, middle long")


def lost_arms(spark: SparkSession) -> DataFrame:
    """``chrom, start, stop`` of arms with a loss of heterozygosity."""
    return spark.createDataFrame(LOSS_OF_HETEROZYGOSITY, "chrom string, start long, stop long")


def chromosomes(spark: SparkSession) -> DataFrame:
    """``chrom_id, name, len``."""
    return spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(LENGTHS)], "chrom_id int, name string, len long")
