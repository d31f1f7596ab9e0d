"""URL filter: listed rules, and gradient-boosted trees on lexical features for what no rule fits.

Labelled URLs are (url, label) rows with label 1 for blocked ones. Features are lengths, depth, digit share, entropy, hyphens, parameter
counts and the smoothed share of blocked URLs among those whose last two host labels fall in the same of SUFFIX_BINS bins. The trees are fitted
on the driver by plain arithmetic on a bounded sample (SAMPLE rows a class, chosen by a hash of the URL, each weighing as many rows of its class as it
stands for, so that scores keep the true shares at every size) and become one column expression, so that judging is a scan. Only DataFrame expressions run on the executors; the suffix statistics are counted map-side into SUFFIX_BINS rows.

Where no labels are given, host names with a word of UNWANTED are taken as unwanted: weak labels, which the trees carry over to other hosts by form alone. cross_validated() says how well they
do on hosts that they haven't seen.

Defined results: null and URLs without :// have an empty host and path, no rule, and are judged by the trees. Without labelled URLs of both
classes everything that no rule fits is allowed. Repeated rows, and those without page_id (which stays null), are judged each on its own. Labelled rows with a null url or label are ignored. An
empty table gives none."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path); written like net/ in the column rule.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words of host names that label a URL as unwanted, as training labels where no other are given. Fixed values.
UNWANTED = "adult ads bet bets casino cheap click farm free loan loans pill pills poker porn promo seo sex spam track viagra win xxx".split()
FEATURES = ["url_length", "host_length", "path_length", "depth", "host_labels", "hyphens", "digit_share", "host_digits", "entropy", "longest_label", "parameters", "query_length", "fragment", "vowel_share", "suffix_share"]
SUFFIX_BINS = 4096
SAMPLE = 10_000
TREES = 40
DEPTH = 3
RATE = 0.2
BINS = 32
LEAST = 5.0  # rows on each side of a split

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LOWER = (string.ascii_uppercase, string.ascii_lowercase)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(text, _URL, 1), *_LOWER)).withColumn("path", F.regexp_extract(text, _URL, 2))


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first, so it comes last here
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def _suffix_bin(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -2)), F.lit(SUFFIX_BINS)).cast("int")


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages, which has host and path, with the features but suffix_share, and suffix_bin."""
    text, host, path = F.coalesce(F.col(url).cast("string"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.char_length(host), F.lit(1))
    letters = F.array_distinct(F.split(host, ""))
    share = lambda c: (F.char_length(host) - F.char_length(F.replace(host, c, F.lit("")))) / n
    entropy = F.when(host == "", 0.0).otherwise(-F.aggregate(F.transform(letters, share), F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0)))
    values = {
        "url_length": F.char_length(text),
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "depth": _count(path, "/[^/]"),
        "host_labels": _count(host, r"[^.]+"),
        "hyphens": _count(host, "-"),
        "digit_share": _count(text, "[0-9]") / F.greatest(F.char_length(text), F.lit(1)),
        "host_digits": _count(host, "[0-9]"),
        "entropy": F.round(entropy, 6),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.char_length(x))), F.lit(0)),
        "parameters": _count(query, "[^&=]+="),
        "query_length": F.char_length(query),
        "fragment": text.contains("#").cast("int"),
        "vowel_share": _count(host, "[aeiou]") / n,
    }
    return pages.withColumns({f"f_{k}": v.cast("double") for k, v in values.items()} | {"suffix_bin": _suffix_bin(host)})


class Trees:
    """Gradient boosting for the logistic loss: TREES trees of depth DEPTH on binned features."""

    def __init__(self, rows: list[list[float]], labels: list[int], weights: tuple[float, float] = (1.0, 1.0)):
        """weights: how many rows each row of class 0 and of class 1 stands for."""
        import numpy as np

        x, y = np.array(rows, float).reshape(len(labels), len(FEATURES)), np.array(labels, float)
        self.trees: list = []
        self.base = 0.0
        if not 0 < y.sum() < len(y):
            self.base = -1.0
            return
        weight = np.where(y > 0, weights[1], weights[0])
        self.base = math.log(weights[1] * y.sum() / (weights[0] * (len(y) - y.sum())))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
        z = np.full(len(y), self.base)

        def grow(at, depth: int):
            g, h = gradient[at], hessian[at]
            value = RATE * g.sum() / (h.sum() + 1.0)
            best = (1e-9, None, None)
            if depth and len(at) >= 2 * LEAST:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gs, hs, ns = (np.bincount(binned[at, j], w, len(e) + 1).cumsum()[:-1] for w in (g, h, np.ones(len(at))))
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(ns < LEAST) | (len(at) - ns < LEAST)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] is None:
                z[at] += value
                return float(value)
            _, j, k = best
            left = binned[at, j] <= k
            return (j, float(edges[j][k]), grow(at[left], depth - 1), grow(at[~left], depth - 1))

        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            gradient, hessian = weight * (y - p), weight * p * (1 - p)
            self.trees.append(grow(np.arange(len(y)), DEPTH))

    def score(self) -> Column:
        """The probability of label 1 from the columns f_..."""

        def column(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            j, edge, left, right = node
            return F.when(F.col(f"f_{FEATURES[j]}") <= edge, column(left)).otherwise(column(right))

        z = F.aggregate(F.array(F.lit(self.base), *[column(t) for t in self.trees]), F.lit(0.0), lambda a, x: a + x)
        return 1 / (1 + F.exp(-z))


def seed_labels(pages: DataFrame) -> DataFrame:
    """url and label of pages with a host: 1 if a word of the host's labels is UNWANTED."""
    words = F.split(F.col("host"), r"[.-]")
    return with_parts(pages).where("host <> ''").select("url", F.arrays_overlap(words, F.array(*[F.lit(w) for w in UNWANTED])).cast("int").alias("label"))


def fit(labelled: DataFrame) -> tuple[Trees, dict[int, float]]:
    """Trees and suffix shares from labelled URLs (url, label)."""
    parts = with_parts(labelled.where("label is not null and url is not null").select("url", F.col("label").cast("int").alias("label"))).withColumn("suffix_bin", _suffix_bin(F.col("host")))
    counts = parts.groupBy("suffix_bin", "label").count().collect()  # 2 * SUFFIX_BINS rows
    total = {c: sum(r["count"] for r in counts if (r.label > 0) == bool(c)) for c in (0, 1)}
    usual = (total[1] + 1) / (total[0] + total[1] + 2)
    shares: dict[int, list[float]] = {}
    for r in counts:
        own = shares.setdefault(r.suffix_bin, [20 * usual, 20.0])
        own[0] += r["count"] * (r.label > 0)
        own[1] += r["count"]
    suffix = {k: a / b for k, (a, b) in shares.items()}
    draw = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(1 << 30))
    some = F.when(F.col("label") > 0, draw < int((1 << 30) * min(1.0, SAMPLE / max(total[1], 1)))).otherwise(draw < int((1 << 30) * min(1.0, SAMPLE / max(total[0], 1))))
    rows = with_features(parts.where(some).drop("suffix_bin")).select("label", "suffix_bin", *[f"f_{k}" for k in FEATURES[:-1]]).collect()  # about SAMPLE rows a class
    rows.sort()
    labels = [int(r.label > 0) for r in rows]
    drawn = (len(labels) - sum(labels), sum(labels))
    return Trees([[*r[2:], suffix[r.suffix_bin]] for r in rows], labels, (total[0] / max(drawn[0], 1), total[1] / max(drawn[1], 1))), suffix | {-1: usual}


def _scored(rows: DataFrame, trees: Trees, suffix: dict[int, float]) -> DataFrame:
    """rows (with url) with host, path and the trees' score, beside their other columns, which begin with none of the features' names."""
    usual = suffix[-1]
    known = rows.sparkSession.createDataFrame([(k, v) for k, v in suffix.items() if k >= 0] or [(-1, 0.0)], "suffix_bin int, f_suffix_share double")  # SUFFIX_BINS rows at most
    out = with_features(with_parts(rows))
    out = out.join(F.broadcast(known), "suffix_bin", "left").withColumn("f_suffix_share", F.coalesce("f_suffix_share", F.lit(usual)))
    return out.withColumn("score", trees.score())


def cross_validated(labelled: DataFrame, folds: int = 5) -> DataFrame:
    """urls, unwanted, caught (of these) and blamed (of the others), when every URL (url, label) is judged by trees fitted on the hosts of the other folds."""
    parts = with_parts(labelled.where("label is not null and url is not null").select("url", F.col("label").cast("int").alias("label")))
    dealt = parts.select("url", "label", F.pmod(F.xxhash64("host"), F.lit(folds)).alias("fold"))
    out = None
    for k in range(folds):
        own = _scored(dealt.where(F.col("fold") == k), *fit(dealt.where(F.col("fold") != k))).select("label", "score")
        out = own if out is None else out.union(own)
    bad, block = F.col("label") > 0, F.col("score") > 0.5
    count = lambda c: F.count(F.when(c, 1))
    return out.agg(F.count("*").alias("urls"), count(bad).alias("unwanted"), count(bad & block).alias("caught"), count(~bad & block).alias("blamed"))


def judged(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the trees) of every row of pages."""
    rows = _scored(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url"), *fit(seed_labels(pages) if labelled is None else labelled))
    rule, verdict = rule_of(RULES if rules is None else rules, F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
