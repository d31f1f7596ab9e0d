"""Schemas, readers and writers of the text formats, and Parquet tables of bins and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "chrom_sizes": "chrom string, length bigint",
    "genes": "Chromosome string, Start bigint, End bigint, Strand string, GeneName string, Count bigint",
    "fragments": "Chromosome string, Start bigint, End bigint, bin_id bigint",
    "tags_se": "chrom string, start bigint, end bigint, name string, score double, strand string",
    "tags_pe": "chrom string, start bigint, end bigint",
    "nucleosomes": "chrom string, start bigint, end bigint, index string, width bigint, height double, auc double, property string, nlp_peak double, nlp_valley double",
    "bedpe": "chrom1 string, start1 bigint, end1 bigint, chrom2 string, start2 bigint, end2 bigint, intensity bigint",
    "signal": "chrom string, start bigint, end bigint, value double",
}
#: Columns of a pairs file that are used, by position.
_PAIR_COLUMNS = {1: "chrom1", 10: "pos51", 12: "pos31", 5: "strand1", 3: "chrom2", 11: "pos52", 13: "pos32", 6: "strand2", 9: "walk_pair_type"}


def read_table(spark: SparkSession, path: str, kind: str, header: bool = False) -> DataFrame:
    """A tab-separated file (compressed or not) with one of SCHEMAS."""
    return spark.read.schema(SCHEMAS[kind]).options(sep="\t", header=header, comment="#").csv(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Read pairs; lines of the header begin with #. Only the used columns are parsed."""
    schema = ", ".join(f"c{i} {'bigint' if i >= 10 else 'string'}" for i in range(14))
    return spark.read.schema(schema).options(sep="\t", comment="#").csv(path).select(*[F.col(f"c{i}").alias(n) for i, n in _PAIR_COLUMNS.items()])


def read_polished_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Ten named columns, the strands from walk_strand_type such as +-."""
    raw = spark.read.schema("pair_id string, chrom1 string, pos51 bigint, pos31 bigint, chrom2 string, pos52 bigint, pos32 bigint, walk_pair_type string, walk_strand_type string, mapq bigint").options(sep="\t", comment="#").csv(path)
    return raw.withColumn("strand1", F.substring("walk_strand_type", 1, 1)).withColumn("strand2", F.substring("walk_strand_type", 2, 1)).drop("walk_strand_type")


def strip_header_rows(rows: DataFrame, number: str = "start") -> DataFrame:
    """Rows whose number column is a number; header rows of gathered files go."""
    return rows.where(F.col(number).try_cast("bigint").isNotNull())


def parse_manifest(lines: DataFrame, line: str = "value") -> DataFrame:
    """path1, path2, layout and assay of manifest lines, separated by tabs, blanks or bars; # begins a comment line. Without SE or PE the layout follows from the number of paths."""
    parts = F.split(F.trim(F.col(line)), r"[\t| ]+")
    rows = lines.where((F.trim(F.col(line)) != "") & ~F.trim(F.col(line)).startswith("#")).withColumn("p", parts)
    given = F.upper(F.element_at("p", -2)).isin("SE", "PE") & (F.size("p") > 2)
    paths = F.when(given, F.slice("p", 1, F.size("p") - 2)).otherwise(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))))
    rows = rows.withColumn("paths", paths)
    return rows.select(F.col("paths")[0].alias("path1"), F.get("paths", F.lit(1)).alias("path2"), F.when(given, F.upper(F.element_at("p", -2))).otherwise(F.when(F.size("paths") > 1, "PE").otherwise("SE")).alias("layout"), F.element_at("p", -1).alias("assay"))


def base_name(path: Column) -> Column:
    """A file's name without folders, compression, format ending and mate suffix."""
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.(gz|bz2|zst)$", "")
    return F.regexp_replace(F.regexp_replace(name, r"\.(fastq|fq|bam|sam|pairs|bed)$", ""), r"([._](R?[12]|read[12]))$", "")


def regular_chromosomes(rows: DataFrame, chrom: str = "chrom") -> DataFrame:
    return rows.where(~F.col(chrom).rlike("random|chrUn|chrEBV"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig and sequence of FASTA files. A record begins at >; records, not whole files, are the unit that is read."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    return raw.select(F.regexp_extract("value", r"^(\S+)", 1).alias("contig"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("sequence"))


def chunked(rows: DataFrame, text: str, ids: list[str], size: int, overlap: int) -> DataFrame:
    """Texts in chunks of size letters: ids, offset, sequence with the next `overlap` letters. Null and empty texts give none."""
    starts = F.sequence(F.lit(0), F.char_length(text) - 1, F.lit(size)).cast("array<bigint>")
    dealt = rows.where(F.char_length(text) > 0).select(*ids, F.explode(starts).alias("offset"), F.col(text).alias("_text"))
    return dealt.select(*ids, "offset", F.expr(f"substring(_text, cast(offset as int) + 1, {size + overlap})").alias("sequence"))


def read_fasta_chunks(spark: SparkSession, path: str, size: int = 1 << 20, overlap: int = 64) -> DataFrame:
    """FASTA files in chunks of size bases, so that no row or task holds a contig: file, record (its number in the file), contig, offset, sequence with the next `overlap` bases.

    Lines are what is read, of any split of a file; a scan over ranges of lines gives each its record and its place in it. A line that is as long as a contig is one value until it is cut. What stands before the first > of a file is left
    out, and records without bases have no chunk."""
    from tessera.operators.scans import carried

    # in a block of a file lines have growing numbers
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_no"), "value")
    head = F.col("value").startswith(">")
    bases = F.when(~head, F.upper(F.regexp_replace("value", r"\s", "")))
    read = lines.select("file", "_block", "_no", F.when(head, F.regexp_extract("value", r"^>(\S+)", 1)).alias("_name"), bases.alias("_bases"))
    ranges = [F.col("_block"), F.floor(F.col("_no") / 65536)]
    length = F.coalesce(F.char_length("_bases"), F.lit(0)).cast("bigint")
    placed = carried(read, ["file"], ["_block", "_no"], sums={"record": F.when(F.col("_name").isNotNull(), 1).otherwise(0), "_to": length}, latest={"contig": F.col("_name")}, ranges=ranges)
    # where a record begins among all bases of the file
    begins = placed.where(F.col("_name").isNotNull()).select("file", "record", F.col("_to").alias("_from"))
    own = placed.where("record > 0 and _bases <> ''").join(begins, ["file", "record"])
    at, n = F.col("_to") - F.col("_from") - F.char_length("_bases"), F.char_length("_bases")
    first, last = F.floor(F.greatest(at - overlap, F.lit(0)) / size), F.floor((at + n - 1) / size)
    dealt = own.select("file", "record", "contig", at.alias("_at"), "_bases", F.explode(F.sequence(first, last)).alias("_chunk"))
    low, high = F.greatest(F.col("_chunk") * size - F.col("_at"), F.lit(0)), (F.col("_chunk") + 1) * size + overlap - F.col("_at")
    parts = dealt.select("file", "record", "contig", "_chunk", F.greatest("_at", F.col("_chunk") * size).alias("_at"), F.substring("_bases", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("_part")).where("_part <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"]), "")
    chunks = parts.groupBy("file", "record", "contig", "_chunk").agg(joined.alias("sequence"))
    # a chunk that has only letters of the one before it isn't there: each begins with letters of its own
    return chunks.select("file", "record", "contig", (F.col("_chunk") * size).alias("offset"), "sequence")


def write_table(rows: DataFrame, path: str, header: bool = False, mode: str = "overwrite") -> None:
    rows.write.mode(mode).options(sep="\t", header=header).csv(path)


def write_map(bins: DataFrame, pixels: DataFrame, path: str) -> None:
    """Bins and pixels as Parquet, by chromosome, with counts as floats."""
    bins.write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/bins")
    pixels.withColumn("cnt", F.col("cnt").cast("float")).write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/pixels")


def read_map(spark: SparkSession, path: str, chrom: str | None = None, balanced: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bins and pixels; chrom is read by partition pruning, balanced multiplies by both bins' weights."""
    bins, pixels = spark.read.parquet(f"{path}/bins"), spark.read.parquet(f"{path}/pixels")
    if chrom is not None:
        bins, pixels = bins.where(F.col("chrom") == chrom), pixels.where(F.col("chrom") == chrom)
    if balanced:
        from tessera.operators.matrix import bias_multiply

        pixels = bias_multiply(pixels, bins.select("chrom", "bin_id", "weight"), "weight")
    return bins, pixels


SIDE = 4096  # bins along a tile of a stored map


def write_tiles(bins: DataFrame, pixels: DataFrame, path: str, side: int = SIDE) -> None:
    """Bins and pixels as Parquet, pixels in folders by chromosome, distance and row, `side` bins each, so that a region is read from the files that it touches. A folder is written by one task or, where it is large, by several."""
    bins.write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/bins")
    far = F.floor((F.col("bin2_id") - F.col("bin1_id")) / side)
    placed = pixels.withColumns({"cnt": F.col("cnt").cast("float"), "far": far, "row": F.floor(F.col("bin1_id") / side)})
    placed.hint("rebalance", "chrom", "far", "row").write.mode("overwrite").partitionBy("chrom", "far", "row").parquet(f"{path}/pixels")


def read_region(spark: SparkSession, path: str, chrom: str, first: int, last: int, side: int = SIDE, balanced: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bins and pixels of a tiled map with both bins from first to last; balanced multiplies by both bins' weights. side is that of the writer."""
    bins, pixels = spark.read.parquet(f"{path}/bins"), spark.read.parquet(f"{path}/pixels")
    bins = bins.where((F.col("chrom") == chrom) & F.col("bin_id").between(first, last))
    folders = (F.col("chrom") == chrom) & F.col("row").between(first // side, last // side) & (F.col("far") <= (last - first) // side)
    pixels = pixels.where(folders & (F.col("bin1_id") >= first) & (F.col("bin2_id") <= last)).drop("far", "row")
    if balanced:
        from tessera.operators.matrix import bias_multiply

        pixels = bias_multiply(pixels, bins.select("chrom", "bin_id", "weight"), "weight")
    return bins, pixels


def write_signal(track: DataFrame, path: str) -> None:
    """A bedGraph-like track; null and NaN are 0."""
    write_table(track.select("chrom", "start", "end", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))), path)


def with_bin_column(bins: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """bins (chrom, bin_id, ...) with a column added or replaced; values: chrom, bin_id and the column. Bins without a value get null."""
    return bins.drop(name).join(values.select("chrom", "bin_id", name), ["chrom", "bin_id"], "left")


def zipped(left: DataFrame, right: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Two tables side by side, the n-th row of one with the n-th of the other in the order of part and, inside it, of `order`, which both have; the right one's columns get the ending _2 where they clash. A part is what a
    task numbers; what one table has more than the other is left out."""
    from tessera.operators.intervals import number_bins

    other = number_bins(right, part, order, "_no").withColumnsRenamed({c: f"{c}_2" for c in right.columns if c in left.columns})
    return number_bins(left, part, order, "_no").join(other, "_no").drop("_no")


def write_profile(profile: DataFrame, path: str) -> None:
    """The seven columns of a 10-base profile: coordinate, score, smoothed, LoG, minor LoG, tags and height, with three places; profile: slot and these."""
    three = lambda c: F.round(c, 3)
    write_table(profile.select((F.col("slot") * 10 + 1).alias("coordinate"), three("score"), three("smooth"), three("log"), three("minor_log"), "tags", three("height")), path)


def write_nucleosomes(called: DataFrame, path: str) -> None:
    """The ten columns of called nucleosomes, numbered along each chromosome; called: chrom, start, end, height, auc, property, nlp_peak, nlp_valley."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("chrom").orderBy("start", "end"))
    named = called.withColumn("index", F.concat(F.lit("Nucleosome:"), number.cast("string")))
    write_table(named.select("chrom", "start", "end", "index", (F.col("end") - F.col("start") + 10).alias("width"), F.round("height", 3), F.round("auc", 3), "property", "nlp_peak", "nlp_valley"), path)


def tag_statistics(tags: DataFrame, extend: int = 150) -> DataFrame:
    """Tags and the largest coordinate of each chromosome; forward reads count as far as they were extended."""
    return tags.groupBy("chrom").agg(F.count("*").alias("tags"), F.max(F.when(F.col("strand") == "+", F.col("start") + extend).otherwise(F.col("end"))).alias("max_coordinate"))


def property_label(shoulders: Column, doublet: Column, kind: Column) -> Column:
    """The label of a called peak."""
    return F.when(kind == "shoulder", "Shoulder").when(kind != "main", "Other").when(doublet, "MainPeak:doublet").when(shoulders > 0, "MainPeak+Shoulder").otherwise("MainPeak")
