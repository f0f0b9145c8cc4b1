"""Reading files: lines with their place, alignments (text and binary), FASTA, BLAST, caches of earlier steps."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from chromaloom.sources import records

#: Compressed bytes of a binary file that a task reads, bytes read at once, and the most that a block has.
STRETCH_BYTES, READ_BYTES, MOST_BLOCK = 32 << 20, 4 << 20, 1 << 16
#: Records in a row that have to make sense where a stretch begins inside a file, and records of a batch.
CHAIN, RECORDS_AT_ONCE, SYNC_BYTES = 16, 10_000, 1 << 17
#: Places of a target share a window of an index if they are equal but for so many low bits.
WINDOW_BITS = 14


#: Splits of the files up to which their first numbers are broadcast.
BROADCAST_BLOCKS = 100_000


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, value``: lines in no order, for formats whose lines stand alone."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")


def _raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with the part of the file that they are read with, and a running number in the order of reading."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value")


def _shifts(raw: DataFrame, header: str) -> list:
    """``file, block, shift, heads`` for each part: what makes running numbers places in the file, and the headers before."""
    own = [F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.count_if(F.col("value").startswith(header)).alias("h")]
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = {c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in "nh"}
    parts = raw.groupBy("file", "block").agg(*own)
    return parts.select("file", "block", (before["n"] - F.col("first")).alias("shift"), before["h"].alias("heads")).collect()  # a row for each split of the input


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, row_no, value``: lines with their number in the file, also where a file is read in parts.

    The lines of each part are counted and the counts added up over a file's
    parts; no line is moved or sorted.  A part is read by one task in order, and
    alike each time, so a line's place in it is its running number less that of
    the part's first line.
    """
    raw = _raw(spark, paths)
    held = _shifts(raw, "\n")
    if not held:
        return raw.select("file", F.col("k").alias("row_no"), "value")
    shifts = spark.createDataFrame(held, "file string, block long, shift long, heads long")
    shifts = F.broadcast(shifts) if len(held) <= BROADCAST_BLOCKS else shifts
    return raw.join(shifts, ["file", "block"]).select("file", (F.col("k") + F.col("shift")).alias("row_no"), "value")


def headed(spark: SparkSession, paths: str | list[str], header: str) -> DataFrame:
    """``file, row_no, value, head``: :func:`lines` with the number of the last header line so far, from 0; -1 before the first.

    Headers are counted in each part like lines, and the counts are handed on
    from part to part.  Inside a part its one reader counts on from what the
    parts before have had; no line is moved, and a record may be cut by the
    border of two parts.
    """
    raw = _raw(spark, paths)
    held = _shifts(raw, header)
    shared = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["shift"], r["heads"]) for r in held})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, heads = shared.value, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column("file"), batch.column("block").to_numpy()
            marks = pc.starts_with(batch.column("value"), header).fill_null(False).to_numpy(zero_copy_only=False)
            out, number = np.empty(batch.num_rows, dtype=np.int64), batch.column("k").to_numpy() + 0
            # a batch seldom holds lines of more than one part, which lie together
            at = files.dictionary_encode().indices.to_numpy()
            for a, b in pairwise([0, *(np.flatnonzero((at[1:] != at[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]):
                part = files[a].as_py(), int(blocks[a])
                if part != now:
                    now, heads = part, known[part][1]
                out[a:b] = heads + np.cumsum(marks[a:b]) - 1
                heads = int(out[b - 1]) + 1
                number[a:b] += known[part][0]
            yield pa.RecordBatch.from_arrays([files, pa.array(number), batch.column("value"), pa.array(out)], names=["file", "row_no", "value", "head"])

    return raw.mapInArrow(run, "file string, row_no long, value string, head long")


def is_binary(path: str) -> bool:
    """Whether a name ends as binary alignments do, in either case."""
    return path.lower().endswith(".bam")


def read_alignments(spark: SparkSession, paths: list[str], index: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Contig dictionary and records of SAM or BAM files in list order; the dictionary is the first file's.

    Conditions on ``tid``, ``pos``, ``mapq`` and ``flag`` of BAM records are
    tested where they are read, and with an ``index`` (see
    :func:`write_bam_index`) only the blocks of the asked region are opened.
    """
    if is_binary(paths[0]):
        spark.dataSource.register(BamSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; without it Spark tests the conditions
        contigs = spark.createDataFrame(bam_header(paths[0])[0], "tid int, name string, len long")
        reader = spark.read.format("bam").option("paths", "\n".join(paths))
        return contigs, (reader.option("index", index) if index else reader).load()
    text = lines(spark, paths)
    first = lines(spark, paths[0])
    contigs = records.contig_dictionary(first)
    return contigs, records.alignments(text, contigs)


def _opened(path: str):
    """A file as a stream that can be read at any place."""
    import pyarrow.fs as pafs

    files, place = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return files.open_input_file(place)


def block_size(head: bytes) -> int:
    """Bytes of the BGZF block (a gzip member whose extra field states its size) that begins with ``head``; 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    place, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while place + 6 <= min(end, len(head)):
        tag, length = head[place : place + 2], struct.unpack_from("<H", head, place + 2)[0]
        if tag == b"BC" and length == 2:
            return struct.unpack_from("<H", head, place + 4)[0] + 1
        place += 4 + length
    return 0


def blocks_of(source, start: int, size: int, near: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each BGZF block from the one at ``start`` on, in a file of ``size`` bytes; no more is read at once than a block beyond ``near``."""
    at, held, first = start, b"", start
    while at < size:
        if at - first + MOST_BLOCK > len(held) and first + len(held) < size:
            most = READ_BYTES if near is None else min(READ_BYTES, max(near - at, 0) + MOST_BLOCK)
            held, first = source.read_at(min(most, size - at), at), at
        here = at - first
        length = block_size(held[here : here + MOST_BLOCK])
        if not length:
            raise ValueError(f"no block at {at}")
        extra = struct.unpack_from("<H", held, here + 10)[0]
        yield at, zlib.decompress(held[here + 12 + extra : here + length - 8], -15)
        at += length


def next_block(source, start: int, size: int) -> int:
    """The first block that begins at ``start`` or later: one that is followed by another or by the file's end."""
    data = source.read_at(min(2 * MOST_BLOCK, size - start), start)
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        length = block_size(data[at : at + MOST_BLOCK])
        if length and (start + at + length == size or block_size(data[at + length : at + length + MOST_BLOCK])):
            return start + at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


def bam_header(path: str) -> tuple[list[tuple[int, str, int]], int]:
    """Number, name and length of a BAM file's targets, and where its first record begins (block offset times 65,536 plus the place in the block).

    Only the blocks of the header are read.
    """
    with _opened(path) as source:
        raw, starts = b"", []
        for at, content in blocks_of(source, 0, source.size()):
            starts.append((len(raw), at))
            raw += content
            if (found := _targets(raw)) is not None:
                targets, end = found
                if end < len(raw):
                    inside, block = max(x for x in starts if x[0] <= end)
                    return targets, (block << 16) + end - inside
    if raw and (found := _targets(raw)) is not None:
        return found[0], source_end(path)
    raise ValueError("not a BAM file")


def source_end(path: str) -> int:
    with _opened(path) as source:
        return source.size() << 16


def _targets(raw: bytes) -> tuple[list[tuple[int, str, int]], int] | None:
    """The targets and where they end; None where the header goes on beyond ``raw``."""
    if raw[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", raw, 4)[0]
        count, at = struct.unpack_from("<i", raw, at)[0], at + 4
        targets = []
        for tid in range(count):
            size = struct.unpack_from("<i", raw, at)[0]
            targets.append((tid, raw[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", raw, at + 4 + size)[0]))
            at += 8 + size
    except struct.error:
        return None
    return targets, at


_RECORD = struct.Struct("<iiiBBHHHiiii")  # size, tid, pos, name, mapq, bin, cigar, flag, bases, mate's tid and pos, span


def _plausible(raw: bytes, at: int, targets: int) -> int:
    """Where the record at ``at`` would end; -1 if there can be none, -2 if ``raw`` is too short to tell."""
    if at + 36 > len(raw):
        return -2
    size, tid, pos, name_size, _, _, cigar, _, bases, mtid, mpos, _ = _RECORD.unpack_from(raw, at)
    fixed = 32 + name_size + 4 * cigar + (bases + 1) // 2 + bases
    if not (name_size and bases >= 0 and fixed <= size < 1 << 28 and -1 <= tid < targets and -1 <= mtid < targets and pos >= -1 and mpos >= -1):
        return -1
    if at + 36 + name_size > len(raw):
        return -2
    name = raw[at + 36 : at + 35 + name_size]
    if raw[at + 35 + name_size] or not all(33 <= c <= 126 for c in name):
        return -1
    return at + 4 + size


def first_record(raw: bytes, targets: int) -> int:
    """Where the first record begins in bytes that may begin inside one: the first place from which several records follow one another."""
    for at in range(len(raw)):
        end, seen = at, 0
        while end >= 0 and seen < CHAIN:
            after = _plausible(raw, end, targets)
            if after == -2:
                break
            end, seen = after, seen + 1
            if end > len(raw):
                break
        if end >= 0 and seen:
            return at
    return -1


class BamSource(DataSource):
    """Python data source ``bam``: a partition for each stretch of a file; option ``paths`` lists the files by line.

    ``row_no`` rises along a file: it is the place of a record, the offset of
    its block times 65,536 plus the place in the block.  Option ``index`` names
    the folder of :func:`write_bam_index`.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "file string, row_no long, qname string, flag int, tid int, pos long, mapq int, mtid int, mpos long"

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options["paths"].split("\n"), int(self.options.get("stretch", str(STRETCH_BYTES))), self.options.get("index"))


class Stretch(InputPartition):
    """Blocks of a file that begin from ``start`` and before ``stop``, where records have to be looked for."""

    def __init__(self, path: str, start: int, stop: int, targets: int, first: int):
        self.path, self.start, self.stop, self.targets, self.first = path, start, stop, targets, first


class Places(InputPartition):
    """Records of a file from one known place to another, in ranges."""

    def __init__(self, path: str, ranges: list[tuple[int, int]]):
        self.path, self.ranges = path, ranges


def _stretches(paths: list[str], stretch: int) -> list[InputPartition]:
    out: list[InputPartition] = []
    for path in paths:
        targets, first = bam_header(path)
        size, start = source_end(path) >> 16, first >> 16
        out += [Stretch(path, at, min(at + stretch, size), len(targets), first) for at in range(start, size, stretch)]
    return out or [Stretch("", 0, 0, 0, 0)]


class BamReader(DataSourceReader):
    def __init__(self, paths: list[str], stretch: int, index: str | None = None):
        self.paths, self.stretch, self.index = paths, stretch, index
        #: Least and greatest value of a field that is asked for, by the field's place in a record.
        self.bounds: dict[int, tuple[int, int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            place = {"flag": 2, "tid": 3, "pos": 4, "mapq": 5}.get(getattr(f, "attribute", ("",))[0])
            if place is None or len(f.attribute) != 1 or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            low, high = self.bounds.get(place, (-(1 << 62), 1 << 62))
            if isinstance(f, EqualTo):
                low, high = max(low, f.value), min(high, f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                low = max(low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                high = min(high, f.value - isinstance(f, LessThan))
            else:
                yield f
                continue
            self.bounds[place] = low, high

    def partitions(self) -> list[InputPartition]:
        if self.index is None:
            return _stretches(self.paths, self.stretch)
        out: list[InputPartition] = []
        for path in self.paths:
            ranges: list[tuple[int, int]] = []
            for first, after in [*_indexed(self.index, path, self.bounds.get(3), self.bounds.get(4)), (None, None)]:
                if ranges and (first is None or after >> 16 > (ranges[0][0] >> 16) + self.stretch):
                    out.append(Places(path, ranges))
                    ranges = []
                if first is not None:
                    ranges = [*ranges[:-1], (ranges[-1][0], max(after, ranges[-1][1]))] if ranges and first >> 16 <= ranges[-1][1] >> 16 else [*ranges, (first, after)]
        return out or [Stretch("", 0, 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Stretch) and partition.start >= partition.stop:
            return
        tests = list(self.bounds.items())
        with _opened(partition.path) as source:
            rows: list[tuple] = []
            for record in _records(source, partition):
                if all(low <= record[place] <= high for place, (low, high) in tests):
                    rows.append((partition.path, *record))
                if len(rows) >= RECORDS_AT_ONCE:
                    yield _record_batch(rows)
                    rows = []
            if rows:
                yield _record_batch(rows)


class BamPlaces(DataSource):
    """Python data source ``bam_places``: for each stretch, target and window of places the first record, where the one after the last begins, and how many there are."""

    @classmethod
    def name(cls) -> str:
        return "bam_places"

    def schema(self) -> str:
        return "file string, stretch long, tid int, window long, first long, after long, n long"

    def reader(self, schema) -> DataSourceReader:
        return PlacesReader(self.options["paths"].split("\n"), int(self.options.get("stretch", str(STRETCH_BYTES))))


class PlacesReader(DataSourceReader):
    def __init__(self, paths: list[str], stretch: int):
        self.paths, self.stretch = paths, stretch

    def partitions(self) -> list[InputPartition]:
        return _stretches(self.paths, self.stretch)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.start >= partition.stop:
            return
        found: dict[tuple[int, int], list[int]] = {}
        with _opened(partition.path) as source:
            last = None
            for place, _, _, tid, pos, *_ in _records(source, partition):
                if last is not None:
                    last[1] = place
                last = found.setdefault((tid, pos >> WINDOW_BITS), [place, place, 0])
                last[2] += 1
            if last is not None:  # nothing of the stretch comes after its last record
                last[1] = max(partition.stop << 16, last[1] + 1)
        for (tid, window), (first, after, n) in found.items():
            yield partition.path, partition.start, tid, window, first, after, n


def write_bam_index(spark: SparkSession, paths: list[str], folder: str, stretch: int = STRETCH_BYTES) -> None:
    """Write where the records of each target's windows are, so that regions can be read without the rest.

    A row for each stretch of a file, target and window of 16,384 places; of
    files in order of place a region is a few rows, of others more, and the
    result is right for both.
    """
    spark.dataSource.register(BamPlaces)
    spark.read.format("bam_places").option("paths", "\n".join(paths)).option("stretch", str(stretch)).load().write.mode("overwrite").parquet(folder)


def _indexed(folder: str, path: str, tids: tuple[int, int] | None, places: tuple[int, int] | None) -> list[tuple[int, int]]:
    """Ranges of a file that hold the records asked for, in order; without a target one for each stretch."""
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    files, place = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    table, wanted = ds.dataset(place, filesystem=files, format="parquet"), pc.field("file") == path
    if tids is not None:
        wanted &= (pc.field("tid") >= tids[0]) & (pc.field("tid") <= tids[1])
        if places is not None:
            wanted &= (pc.field("window") >= places[0] >> WINDOW_BITS) & (pc.field("window") <= places[1] >> WINDOW_BITS)
    rows = table.to_table(columns=["stretch", "first", "after"], filter=wanted)
    if tids is None:
        rows = rows.group_by("stretch").aggregate([("first", "min"), ("after", "max")]).rename_columns(["stretch", "first", "after"])
    return sorted(zip(rows.column("first").to_pylist(), rows.column("after").to_pylist(), strict=True))


def _first_place(source, start: int, targets: int, size: int) -> int:
    """The place of the first record that begins in a block from ``start`` on; the file's end if there is none."""
    raw, starts = b"", []
    for at, content in blocks_of(source, next_block(source, start, size), size, start + 2 * SYNC_BYTES):
        starts.append((len(raw), at))
        raw += content
        # a longer piece tells more surely where a record begins
        if len(raw) >= SYNC_BYTES and (place := first_record(raw, targets)) >= 0:
            break
    else:
        place = first_record(raw, targets)
    if place < 0:
        return size << 16
    inside, block = max(x for x in starts if x[0] <= place)
    return (block << 16) + place - inside


def _walk(source, first: int, end: int, size: int) -> Iterator[tuple]:
    """``row_no, qname, flag, tid, pos, mapq, mtid, mpos`` of the records that begin from ``first`` and before ``end``; returns the place of the next one."""
    raw, starts, place = b"", [], first & 0xFFFF
    blocks = blocks_of(source, first >> 16, size, end >> 16)
    while True:
        at, content = next(blocks, (size, None))
        if content is None:
            return size << 16
        starts.append((len(raw), at))
        raw += content
        last = 0
        while place + 4 <= len(raw):
            while last + 1 < len(starts) and starts[last + 1][0] <= place:
                last += 1
            offset, block = starts[last]
            here = (block << 16) + place - offset
            if here >= end:
                return here
            length = struct.unpack_from("<i", raw, place)[0]
            if place + 4 + length > len(raw):
                break
            _, tid, pos, name_size, mapq, _, _, flag, _, mtid, mpos, _ = _RECORD.unpack_from(raw, place)
            yield here, raw[place + 36 : place + 35 + name_size].decode(), flag, tid, pos, mapq, mtid, mpos
            place += 4 + length
        raw, starts, place = raw[place:], [(offset - place, block) for offset, block in starts[last:]], 0


def _records(source, part: Stretch | Places) -> Iterator[tuple]:
    """The records that begin in a partition; the last may end beyond it.

    A stretch looks for its first record, and holds the place where its last
    record ends against where the next stretch would begin: from the header on
    every stretch so vouches for the one after it, and a wrong guess is an error
    instead of lost or invented records.
    """
    size = source.size()
    if isinstance(part, Places):
        for first, after in part.ranges:
            yield from _walk(source, first, after, size)
        return
    first = part.first if part.first >> 16 == part.start else _first_place(source, part.start, part.targets, size)
    after = first
    if first >> 16 < part.stop:
        after = yield from _walk(source, first, part.stop << 16, size)
    if part.stop < size and after != (expected := _first_place(source, part.stop, part.targets, size)):
        raise ValueError(f"{part.path}: a stretch ends at {after}, the next begins at {expected}")


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = ["file", "row_no", "qname", "flag", "tid", "pos", "mapq", "mtid", "mpos"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``file, tid, name, seq``."""
    return records.fasta_sequences(headed(spark, path, records.FASTA_HEADER))


def read_fasta_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, tid, name, size``, without putting a sequence together."""
    return records.fasta_sizes(headed(spark, paths, records.FASTA_HEADER))


def read_blast(spark: SparkSession, paths: list[str]) -> DataFrame:
    return records.blast_hits(headed(spark, paths, records.BLAST_HEADER))


def read_link_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, z`` of a text matrix: comment lines, a line of names, then rows."""
    f = F.split("value", "\t")
    return texts(spark, path).where(F.col("value").rlike(r"^\d+\t\d+\t\d+$")).select(f[0].cast("int").alias("i"), f[1].cast("int").alias("j"), f[2].cast("bigint").alias("z"))


def read_group_links(spark: SparkSession, path: str) -> DataFrame:
    """``c1, rc1, c2, rc2, dist`` of a text matrix whose rows are two bins, a count and that many distances; a bin is twice the contig plus one if turned."""
    f = F.split("value", "\t")
    rows = texts(spark, path).where(F.col("value").rlike(r"^\d+\t\d+\t\d+\t")).select(f[0].cast("int").alias("x"), f[1].cast("int").alias("y"), F.slice(f, F.lit(4), F.size(f) - 3).alias("d"))
    each = rows.select("x", "y", F.explode("d").alias("dist")).where("dist <> ''")
    return each.select(F.floor(F.col("x") / 2).cast("int").alias("c1"), (F.col("x") % 2 == 1).alias("rc1"), F.floor(F.col("y") / 2).cast("int").alias("c2"), (F.col("y") % 2 == 1).alias("rc2"), F.col("dist").cast("bigint").alias("dist"))


def read_clusters(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """``cluster_id, tid`` of a file with a line per cluster, of numbers or (with ``names``) of names; an unknown name is an error."""
    kept = records.without_comments(lines(spark, path))
    numbered = kept.withColumn("cluster_id", F.row_number().over(Window.partitionBy("file").orderBy("row_no")) - 1)
    numbered = numbered.select("cluster_id", F.explode(F.split("value", "\t")).alias("name"))
    if names is None:
        return numbered.select("cluster_id", F.col("name").cast("int").alias("tid"))
    joined = numbered.join(names.select("name", "tid"), "name", "left")
    known = F.when(F.col("tid").isNotNull(), F.col("tid")).otherwise(F.raise_error(F.concat(F.lit("unknown name: "), F.col("name"))).cast("int"))
    return joined.select("cluster_id", known.alias("tid"))


def read_ordering(spark: SparkSession, path: str) -> DataFrame:
    """``pos, local_id, name, rc, q, gap`` of an ordering file; ``.`` is null."""
    f = F.split("value", "\t")
    kept = records.without_comments(lines(spark, path))
    pos = (F.row_number().over(Window.partitionBy("file").orderBy("row_no")) - 1).alias("pos")

    def optional(k: int, kind: str):
        return F.nullif(f[k], F.lit(".")).cast(kind)

    return kept.select(pos, f[0].cast("int").alias("local_id"), f[1].alias("name"), (f[2] == "1").alias("rc"), optional(3, "double").alias("q"), optional(4, "bigint").alias("gap"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node, role``) and edges (``name, u, v, w``) of a graph file with ``V`` and ``E`` lines."""
    f = F.split("value", "\t")
    rows = texts(spark, path)
    nodes = rows.where(F.col("value").startswith("V\t")).select(f[1].cast("int").alias("node"), F.get(f, F.lit(2)).alias("role"))
    edges = rows.where(F.col("value").startswith("E\t")).select(f[1].alias("name"), f[2].cast("int").alias("u"), f[3].cast("int").alias("v"), f[4].cast("double").alias("w"))
    return nodes, edges
