"""Hard negatives, sharding and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import norm_buckets, prefix_shards, tandem_runs
from tessera.llm._bytes import Words
from tessera.llm.oracle import ORACLE_SQL
from tessera.llm.queries import op11_hard_negatives, op12_sharding, op13_periodic_runs, with_planted_runs
from tests.llm.data import SF, documents, nothing


def plain_negatives(rows, positives=5, negatives=10):
    """rows: vec_id, label, integers."""
    out = []
    for a, label, x in rows:
        if a % 100:
            continue
        score = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), b, other == label) for b, other, y in rows if b != a)
        for p, b, _ in [s for s in score if s[2]][:positives]:
            window = [(s, c) for s, c, same in score if not same and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, b, i + 1, c, -p, -s) for i, (s, c) in enumerate(window)]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, norm_buckets.mined(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_negatives(spark, monkeypatch, spread):
    monkeypatch.setattr(norm_buckets, "PART", (40, 40))
    monkeypatch.setattr(norm_buckets, "BLOCK", 16)
    monkeypatch.setattr(norm_buckets, "ASKED", 2)
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 6)) * np.exp(spread * r.normal(size=(600, 1)))
    x[100:260] = x[7]  # a hot vector
    rows = [(int(i * 20), int(r.integers(0, 3)), v.tolist()) for i, v in enumerate(x)]
    odd = [(100_000, None, rows[0][2]), (100_100, 1, None), (100_200, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (100_300, 1, [math.nan] * 6), (100_400, 1, [math.inf] * 6), (100_500, 1, [1.0]), (None, 1, rows[0][2]), (100_600, 1, [1e30] * 6), (100_700, 99, rows[3][2]), (100_800, 1, [0.0] * 6)]
    df = spark.createDataFrame([*rows, rows[5], *odd], "vec_id bigint, label int, embedding array<double>").selectExpr("*", "1 norm", "2 q", "3 cell")
    truth = [(a, b, [math.floor(256 * v) for v in x]) for a, b, x in [*rows, odd[-2], odd[-1]]]
    want = plain_negatives(truth)
    assert want and mined(df) == want
    assert mined(df.where("false")) == []
    assert mined(df.where("vec_id = 100700")) == []


def test_pruning_leaves_blocks_out(monkeypatch):
    monkeypatch.setattr(norm_buckets, "BLOCK", 10)
    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(400, 4)) * 2.0 ** r.integers(0, 12, (400, 1)))
    norms, ids, labels = np.sqrt((x**2).sum(1)), np.arange(400), np.zeros(400, np.int64)

    class Seen(np.ndarray):
        blocks = 0

        def __matmul__(self, other):
            Seen.blocks += 1
            return np.asarray(self) @ np.asarray(other)

    a = x[:1].view(Seen)
    limits = np.array([-norm_buckets.NO_LIMIT]), np.array([norm_buckets.NO_LIMIT]), np.array([-norm_buckets.NO_LIMIT])
    w, found, score = norm_buckets.best(x, ids, labels, norms, a, ids[:1], labels[:1], norms[:1], np.array([0, 1]), *limits, 5, True)
    want = sorted((-(x[0] @ x[i]), i) for i in range(1, 400))[:5]
    assert list(zip((-score).tolist(), found.tolist(), strict=True)) == want
    assert Seen.blocks < 20  # of 40


def test_large_scores_stay_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i * 50, i % 2, (r.integers(-(2**20), 2**20, 3) * 1.0).tolist()) for i in range(60)]
    truth = [(a, b, [256 * int(v) for v in x]) for a, b, x in rows]
    assert mined(spark.createDataFrame(rows, "vec_id bigint, label bigint, embedding array<double>")) == plain_negatives(truth)


def test_negatives_query(spark):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = c.sql(ORACLE_SQL["op11_hard_negatives"])
    got = op11_hard_negatives(spark, SF).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def plain_shards(rows, shards):
    """rows: (doc_id, text). By doc_id, size and checksum."""
    r = sorted(((d is not None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows))
    whole, before, slots, out = sum(x[2] for x in r), 0, Counter(), Counter()
    for there, d, size, crc in r:
        shard = (2 * before + size) * shards // (2 * whole)
        out[(d if there else None, size, crc, shard, slots[shard])] += 1
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("shards", [1, 7, 40, 5000])
def test_shards(spark, shards):
    docs = documents(spark).selectExpr("*", "0 size", "1 part", "2 before", "3 pos", "4 `a.b`")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = prefix_shards.sharded(docs.repartition(5), shards)
    assert Counter(tuple(r) for r in got.drop("law").collect()) == plain_shards(rows, shards)
    assert prefix_shards.sharded(nothing(spark), shards).count() == 0


def test_equal_rows_are_dealt(spark):
    rows = prefix_shards.sharded(spark.range(3000).selectExpr("cast(null as bigint) doc_id", "'same' text"), 40).collect()
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == 40
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n[s])) for s in n)


def test_sharding_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op12_sharding(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert Counter(tuple(r) for r in got.drop("law", "grown_shard").collect()) == plain_shards([(r.doc_id, r.text) for r in docs.collect()], 40)


def test_written_shards(spark, tmp_path):
    docs = documents(spark).withColumn("shard", docs_lit())
    name = prefix_shards.write_shards(docs, str(tmp_path / "out"), 9)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and back.columns == [*docs.columns, name]
    assert Counter(map(tuple, back.drop(name).collect())) == Counter(map(tuple, docs.collect()))
    want = Counter((k[0], k[3]) for k in plain_shards([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 9).elements())
    assert Counter((r.doc_id, r[name]) for r in back.collect()) == want


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("own")


def plain_runs(w, least=1):
    """start, length and period by start and period: every period at every place; of the periods of one stretch the smallest."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                if j - i + q >= max(least, 2 * q):
                    out.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_all_runs_of_small_strings():
    r = random.Random(1)
    for _ in range(1500):
        w = [r.randrange(r.choice([1, 2, 2, 3, 5])) for _ in range(r.randint(0, 50))]
        if r.random() < 0.4:
            w = w + w[: r.randint(0, 12)] * r.randint(1, 5) + w
        start, length, period = tandem_runs.runs(np.array([10**6, *w, 10**6 + 1]))
        assert list(zip((start - 1).tolist(), length.tolist(), period.tolist(), strict=True)) == plain_runs(w), w


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_of_batches(least):
    r = random.Random(least)
    for _ in range(200):
        texts = []
        for _ in range(r.randint(0, 6)):
            w = [str(r.randrange(r.choice([1, 2, 3, 20]))) for _ in range(r.randint(0, 50))]
            texts.append(" ".join(w + w[: r.randint(0, 20)] * r.randint(0, 5) + w[:3]))
        got = list(zip(*(x.tolist() for x in tandem_runs.runs_of_words(Words(pa.array(texts, pa.string())), least)), strict=True))
        assert got == [(d, *x) for d, t in enumerate(texts) for x in plain_runs(t.split(), least)], texts


def words_of(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(w):
    runs = plain_runs(w, 12)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(((-n, s, q) for s, n, q in runs), default=None)
    listed, kept = "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone)
    best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_query(spark):
    got = op13_periodic_runs(spark, SF)
    assert [t for c, t in got.dtypes if c in COLUMNS] == ["bigint"] * 6 + ["string"] * 2
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    short = [r for r in rows if len((r.text or "").split()) < 1500]  # brute force is quadratic
    assert len(short) > 0.9 * len(rows)
    by_id = {r.doc_id: tuple(r)[1:] for r in got.select(*COLUMNS).collect()}
    assert len(by_id) == len(rows)
    for r in short:
        assert by_id[r.doc_id] == digest(words_of(r.doc_id, r.text)), r.doc_id
    assert any(v[0] for v in by_id.values())


def test_runs_of_odd_documents(spark):
    docs = documents(spark).where("doc_id >= 1000000 or doc_id is null").where("char_length(text) < 20000 or text is null").selectExpr("*", "1 runs", "2 collapsed", "3 n_words")
    planted = with_planted_runs(docs)
    want = Counter((r.doc_id, tuple(plain_runs(words_of(r.doc_id, r.text), 12))) for r in docs.collect())
    rows = tandem_runs.found(planted).collect()
    assert Counter((r.doc_id, tuple(tuple(x) for x in r.runs)) for r in rows) == want
    assert all(r.collapsed is not None and r.n_words is not None for r in rows)
    assert tandem_runs.found(nothing(spark)).count() == 0


def test_long_runs_are_quick():
    w = Words(pa.array([" ".join(["x"] * 100_000), " ".join((["a", "b"] + [str(i) for i in range(20_000)]) * 5)]))
    assert [x.tolist() for x in tandem_runs.runs_of_words(w)] == [[0, 1], [0, 0], [100_000, 5 * 20_002], [1, 20_002]]
