"""Interactions: false discovery by regression, extension, classes by what lies at both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODES = {"Distal": "D1", "Promoter": "P1", "Genebody": "G1"}
#: What the regression gives (FDR, scale) where no known loop is strong enough, and where a chromosome has none.
NO_FIT = (0.01, 0.6155)
NONE_KNOWN = (0.00001, 0.6155)


def genes_in_common(one: Column, two: Column) -> Column:
    """Genes in both comma-joined lists, the mark _bi left out, sorted."""
    names = lambda x: F.transform(F.split(x, ","), lambda g: F.regexp_replace(g, "_bi$", ""))
    return F.array_sort(F.filter(F.array_intersect(names(one), names(two)), lambda g: g != ""))


def loop_class(annot1: Column, annot2: Column, genes1: Column, genes2: Column) -> tuple[Column, Column]:
    """The class of a loop and its genes. Where the ends share genes: by the two kinds, D before G before P; else the first rule that fits."""
    code = lambda a: F.coalesce(*[F.when(a == k, v) for k, v in _CODES.items()], a)
    c1, c2 = code(annot1), code(annot2)
    pair = lambda x, y: ((c1 == x) & (c2 == y)) | ((c1 == y) & (c2 == x))
    common = genes_in_common(genes1, genes2)
    same = F.when(pair("D1", "P1"), "D1P1").when(pair("D1", "G1"), "D1G1").when(pair("D1", "D1"), "D1D1").when(pair("G1", "G1"), "G1G1").when(pair("G1", "P1"), "P1G1").otherwise("unknown")
    both = F.concat_ws(";", genes1, genes2)
    side = lambda k: F.when(c1 == k, genes1).otherwise(genes2)
    some = lambda k: (c1 == k) | (c2 == k)
    other = F.when(pair("P1", "P1"), "P2P1").when(some("P1"), "D1P1").when(pair("G1", "G1"), "G2G1").when(pair("G1", "D1"), "D2G1").when(pair("D1", "D1"), "D2D1").when(some("Desert"), "Desert").otherwise("unknown")
    genes = F.when(pair("P1", "P1"), both).when(some("P1"), side("P1")).when(pair("G1", "G1"), both).when(pair("G1", "D1"), side("G1")).otherwise("Undefined")
    shared = F.size(common) > 0
    return F.when(shared, same).otherwise(other), F.when(shared, F.array_join(common, ",")).otherwise(genes)


def promoter_loops(rows: DataFrame, column: str = "assigned_annotation") -> DataFrame:
    return rows.where(F.col(column).contains("P1"))


def regress_fdr(loops: DataFrame, known: DataFrame) -> DataFrame:
    """loops (chrom, intensity) with fdr and scale on lines fitted to the known ones (chrom, intensity, fdr, scale) of their chromosome that are at least as strong as its weakest loop; fdr from 0, five places.

    Where the known ones all have one intensity, or there is one, the line is flat. NO_FIT is taken where none is strong enough, NONE_KNOWN where the chromosome has none at all."""
    weakest = loops.groupBy("chrom").agg(F.min("intensity").alias("_least"))  # a row a chromosome, as all that is joined here
    there = known.join(F.broadcast(weakest), "chrom").withColumn("_in", F.col("intensity") >= F.col("_least"))
    x = F.when(F.col("_in"), F.col("intensity"))
    fits = [f(y, x).alias(f"_{name}_{y}") for y in ("fdr", "scale") for name, f in (("slope", F.regr_slope), ("level", F.regr_intercept))] + [F.avg(F.when(F.col("_in"), F.col(y))).alias(f"_mean_{y}") for y in ("fdr", "scale")]
    joined = loops.join(F.broadcast(there.groupBy("chrom").agg(F.lit(True).alias("_known"), *fits)), "chrom", "left")
    line = lambda y: F.coalesce(F.col(f"_slope_{y}") * F.col("intensity") + F.col(f"_level_{y}"), F.col(f"_mean_{y}"))
    none = lambda i: F.when(F.col("_known"), NO_FIT[i]).otherwise(NONE_KNOWN[i])
    return joined.withColumns({"fdr": F.round(F.greatest(F.coalesce(line("fdr"), none(0)), F.lit(0.0)), 5), "scale": F.round(F.coalesce(line("scale"), none(1)), 5)}).select(*loops.columns, "fdr", "scale")


def recentre(rows: DataFrame, start: str, end: str, by: int = 3000) -> DataFrame:
    """start and end at `by` on either side of the middle."""
    middle = F.floor((F.col(start) + F.col(end)) / 2)
    return rows.withColumns({"_s": middle - by, "_e": middle + by}).drop(start, end).withColumnsRenamed({"_s": start, "_e": end})


def unique_loops(rows: DataFrame, keys: tuple[str, ...] = ("chrom", "sidx", "eidx"), best: str = "fdr") -> DataFrame:
    """One row for each pair of ends, that with the lowest value of `best`."""
    others = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(best, *[c for c in others if c != best])).alias("_r")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])
