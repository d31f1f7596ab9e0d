"""Nearest neighbours and URL filter."""

import math
import re

import numpy as np
import pytest

from tessera.llm import projection_forest, url_trees
from tests.llm.data import SF

ODD_URLS = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://A.NET/", "x://q://example.com/de/", "https://sub.EXAMPLE.com/de/1?a=1&b=2#f", "http://example.community/de/", "http://example.net/en/", "http://example.net/enx", "http://évil.org/fr/", "http://org/fr/", "http://cheap-pills.example.com/x", "http://h?x=://y/z", "a\n://b\n/c"]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(ODD_URLS)], "page_id long, url string"))
    got = {r.page_id: r for r in url_trees.judged(pages.selectExpr("*", "1 host", "2 f_depth", "3 score")).collect()}
    for page, url in pages.collect():
        host, path = parts(url)
        fits = [(len(h + p), v, h + p) for v, h, p in url_trees.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[2] if fits else None)
        assert r.verdict in ("allow", "block") and (not fits or r.verdict == max(fits)[1])
    assert url_trees.judged(pages.where("false")).count() == 0


def test_trees_learn_from_labels(spark):
    r = np.random.default_rng(0)
    rows = [(f"http://{'free-cash-now' if bad else 'plain'}{i}.example.com/{'a/' * r.integers(0, 4)}", bad) for i in range(600) for bad in [int(r.random() < 0.3)]]
    labelled = spark.createDataFrame(rows, "url string, label int")
    pages = labelled.selectExpr("monotonically_increasing_id() page_id", "url", "label")
    got = {x.page_id: x.verdict for x in url_trees.judged(pages.drop("label"), labelled, rules=[]).collect()}
    truth = {x.page_id: x.label for x in pages.collect()}
    assert np.mean([(got[p] == "block") == bool(y) for p, y in truth.items()]) > 0.98


def plain_boosting(rows, labels, weights):
    """The same trees, grown by trying every edge on lists of numbers. Returns the scores of rows."""
    n, columns = len(rows), list(zip(*rows, strict=True))
    edges = [sorted(set(np.quantile(c, np.linspace(0, 1, url_trees.BINS + 1)[1:-1]).tolist())) for c in columns]
    w = [weights[y] for y in labels]
    ones = sum(a for a, y in zip(w, labels, strict=True) if y)
    z = [math.log(ones / (sum(w) - ones))] * n

    def grow(at, depth, g, h):
        whole = sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + 1)
        best = None
        for j, own in enumerate(edges if depth else []):
            for e in own:
                left = [i for i in at if columns[j][i] <= e]
                right = [i for i in at if columns[j][i] > e]
                if min(len(left), len(right)) < url_trees.LEAST:
                    continue
                gain = sum(sum(g[i] for i in side) ** 2 / (sum(h[i] for i in side) + 1) for side in (left, right)) - whole
                if gain > (best[0] if best else 0) + 1e-9:
                    best = (gain, left, right)
        if best:
            grow(best[1], depth - 1, g, h)
            grow(best[2], depth - 1, g, h)
            return
        step = url_trees.RATE * sum(g[i] for i in at) / (sum(h[i] for i in at) + 1)
        for i in at:
            z[i] += step

    for _ in range(url_trees.TREES):
        p = [1 / (1 + math.exp(-x)) for x in z]
        grow(list(range(n)), url_trees.DEPTH, [a * (y - q) for a, y, q in zip(w, labels, p, strict=True)], [a * q * (1 - q) for a, q in zip(w, p, strict=True)])
    return [1 / (1 + math.exp(-x)) for x in z]


def test_trees_are_those_of_plain_boosting(spark, monkeypatch):
    monkeypatch.setattr(url_trees, "TREES", 5)
    r = np.random.default_rng(5)
    k = len(url_trees.FEATURES)
    rows = np.round(r.normal(size=(120, k)), 3)
    labels = [int(x[0] + x[1] * x[2] + 0.3 * r.normal() > 0.5) for x in rows]
    trees = url_trees.Trees(rows.tolist(), labels, (2.0, 0.5))
    table = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rows)], "i int, " + ", ".join(f"f_{f} double" for f in url_trees.FEATURES))
    got = [x.s for x in table.select("i", trees.score().alias("s")).orderBy("i").collect()]
    assert np.allclose(got, plain_boosting(rows.tolist(), labels, (2.0, 0.5)), atol=1e-9)


def test_hosts_that_were_not_seen(spark):
    """Cross-validated over hosts: unwanted ones are told by form, none of whose words the features see."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    r = url_trees.cross_validated(url_trees.seed_labels(pages)).first()
    assert r.urls == pages.count() and r.unwanted > 100 and r.caught >= 0.8 * r.unwanted and r.blamed <= 0.01 * r.urls
    assert url_trees.cross_validated(url_trees.seed_labels(pages.where("false"))).first().urls == 0


def test_scores_keep_the_shares_when_classes_are_drawn_at_different_rates(spark, monkeypatch):
    monkeypatch.setattr(url_trees, "SAMPLE", 300)
    r = np.random.default_rng(1)
    labelled = spark.createDataFrame([(f"http://h{r.integers(10**6)}.example.com/{i}", int(r.random() < 0.2)) for i in range(3000)], "url string, label int")
    got = url_trees.judged(labelled.selectExpr("monotonically_increasing_id() page_id", "url"), labelled, rules=[]).collect()
    assert abs(np.mean([x.score for x in got]) - 0.2) < 0.05 and np.mean([x.verdict == "block" for x in got]) < 0.1


def test_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    bad = [(10**6, None), (10**6 + 1, [0.0] * 64), (10**6 + 2, [float("nan")] * 64), (10**6 + 3, [None] * 64), (10**6 + 4, [1.0]), (None, [1.0] * 64)] + [(10**6 + 100 * k, [0.5] * 64) for k in range(1, 16)]
    e = e.union(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    got = {}
    for r in projection_forest.nearest(e.unionAll(e.where("vec_id = 3")).selectExpr("*", "1 ids", "2 leaf")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    usable = {r.vec_id: np.array(r.embedding, float) for r in e.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 64 and None not in r.embedding and np.isfinite(np.array(r.embedding, float)).all() and any(r.embedding)}
    ids = np.array(sorted(usable))
    x = np.array([usable[i] for i in ids])
    hit = total = 0
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    for q in got:
        d = np.sqrt(((x - usable[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        own = [got[q][k] for k in sorted(got[q])]
        assert own == sorted(own, key=lambda v: (v[1], v[0])) and all(abs(np.sqrt(((usable[v] - usable[q]) ** 2).sum()) - s) < 1e-12 for v, s in own)
        hit += len({v for v, _ in own} & {int(ids[i]) for i in order})
        total += len(order)
    assert hit / total >= 0.9
    same = [v for v, s in (got[10**6 + 100][k] for k in sorted(got[10**6 + 100])) if s == 0]
    assert same == [10**6 + 100 * k for k in range(2, 12)]


def found_by(rows, budget_of=None):
    """Recall of 60 points among the others, and the mean share of the rows that they were compared with, in the forest itself."""
    sample = rows[: projection_forest.SAMPLE]
    forest = projection_forest.Forest(sample, leaf=min(projection_forest.LEAF, projection_forest.leaf_size(sample, len(rows))))
    placed = np.array(forest.place(rows))
    forest.held = np.bincount(np.concatenate(forest.place(sample)), minlength=forest.leaves) * len(rows) / len(sample)
    probes = sample[-projection_forest.TRIED :]
    which, at, _ = projection_forest.closest(rows, probes)
    enough = projection_forest.budget(forest, probes, [rows[at[which == i]] for i in range(len(probes))], len(rows))
    hit, seen = 0, 0
    for q, leaves in zip(range(60), forest.reach(rows[:60], enough), strict=True):
        compared = np.isin(placed, leaves).any(axis=0)
        d = ((rows - rows[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += compared[np.argsort(d, kind="stable")[:10]].sum()
        seen += compared.sum()
    return hit / 600, seen / 60


@pytest.mark.parametrize("kind", ["surface", "clusters", "none"])
def test_visits_stay_behind_the_table(kind, monkeypatch):
    """Recall is held at three sizes, and the rows compared grow as the data allow: hardly where they have structure. The largest size is beyond the sample."""
    monkeypatch.setattr(projection_forest, "SAMPLE", 8000)
    r = np.random.default_rng(7)
    n = 32_000
    if kind == "surface":
        rows = r.normal(size=(n, 8)) @ r.normal(size=(8, 64)) + 0.05 * r.normal(size=(n, 64))
    elif kind == "clusters":
        rows = r.normal(size=(n // 100, 64))[r.integers(0, n // 100, n)] + 0.3 * r.normal(size=(n, 64))
    else:
        rows = r.normal(size=(n, 64))
    got = [found_by(rows[:m]) for m in (2000, 8000, 32_000)]
    assert all(recall >= 0.9 for recall, _ in got)
    if kind == "none":
        assert got[1][1] < 0.5 * 8000 and got[2][1] < 0.45 * 32_000 and got[2][1] < 0.9 * 4 * got[1][1] + 2000
    else:
        assert got[2][1] < 0.06 * 32_000 and got[2][1] < 2 * got[1][1]


@pytest.mark.parametrize("kind", ["clusters", "none"])
def test_recall_holds_far_beyond_the_sample(kind, monkeypatch):
    """Thirty times the sample, also in clusters of which the sample shows a few points each."""
    monkeypatch.setattr(projection_forest, "SAMPLE", 2000)
    r = np.random.default_rng(8)
    n = 60_000
    rows = r.normal(size=(50, 64))[r.integers(0, 50, n)] + 0.3 * r.normal(size=(n, 64)) if kind == "clusters" else r.normal(size=(n, 64))
    recall, seen = found_by(rows)
    assert recall >= 0.9 and seen < (0.05 if kind == "clusters" else 0.6) * n


def test_a_walk_looks_at_few_nodes():
    """The nodes whose margin is taken are those on the way to the leaves that are reached."""
    r = np.random.default_rng(9)
    rows = r.normal(size=(80, 64))[r.integers(0, 80, 8000)] + 0.3 * r.normal(size=(8000, 64))
    forest = projection_forest.Forest(rows)
    forest.held = np.bincount(np.concatenate(forest.place(rows)), minlength=forest.leaves).astype(float)

    class Seen(np.ndarray):
        looked = 0

        def item(self, *at):
            Seen.looked += 1
            return super().item(*at)

    nodes = list(zip(forest.left.tolist(), forest.right.tolist(), forest.offsets.tolist(), forest.shrink.tolist(), strict=True))
    along = (rows[:1].astype(np.float32) @ forest.normals().T)[0].view(Seen)
    seen = 0.0
    for leaf in forest._leaves(along, nodes):
        seen += forest.held[leaf]
        if seen >= projection_forest.LEAST_BUDGET:
            break
    assert Seen.looked < 0.2 * len(nodes)


def test_cells_and_copies(spark, monkeypatch):
    """Small cells dealt to several tasks, queries dealt to copies, and two vectors under one id."""
    for name, value in (("PART", 16), ("ASKED", 2)):
        monkeypatch.setattr(projection_forest, name, value)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).tolist()) for i in range(300)] + [(7, [9.0] * 6), (100, [-9.0] * 6)]
    got = projection_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    asked = {q: min(v for i, v in rows if i == q) for q in (0, 100, 200)}
    for q, own in asked.items():
        near = {}
        for i, v in rows:
            if i != q:
                near[i] = min(near.get(i, np.inf), float(np.sqrt(((np.array(v) - own) ** 2).sum())))
        best = sorted((d, i) for i, d in near.items())[:10]
        mine = sorted((x.score, x.vec_id) for x in got if x.query_id == q)
        assert len(mine) == 10 and len({i for _, i in mine} & {i for _, i in best}) >= 8 and all(abs(near[i] - d) < 1e-12 for d, i in mine)


def test_no_vectors(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert projection_forest.nearest(e).count() == 0
    assert projection_forest.nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0
