"""The document operators against brute force, on odd documents too."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import _memo, byte_bpe, discriminant, license_scan, log_bilinear, nnls_packing, odd_sketch, rule_ledger, weak_pii
from tests.llm.data import SF, documents, nothing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def held(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum((v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v) for i, c in enumerate(reversed(d))) % 10 == 0
    return 10 <= len(d) <= 15


def test_personal_data(docs, rows):
    got = weak_pii.found(docs)
    want = Counter()
    for i, t in rows:
        s = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE) for m in re.finditer(p, (t or "").replace("x" * 20_000 + "@", "")) if passes(k, m.group()))
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want[(i, *(sum(x[3] == k for x in s) for k, _ in BASE), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert held(got, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]) == want


def test_redaction(docs):
    out = {r.doc_id: r for r in weak_pii.redacted(docs).where("doc_id >= 1000000").collect()}
    assert weak_pii.redacted(docs).columns == docs.columns
    assert out[10**6].text.startswith("<email><email> x@y") and "555-7713" not in out[10**6].text and out[10**6].n_chars == len(out[10**6].text)
    assert out[10**6 + 1].text is None and out[10**6 + 4].text == "one"


def test_redacted_texts_are_what_the_spans_leave(docs, rows):
    """The accepted spans, cut out of the texts one by one."""
    spans = defaultdict(list)
    for r in weak_pii.found(docs).select("doc_id", "details").collect():
        spans[r.doc_id].append(sorted((s.start, s.kind, s.stop) for s in r.details))
    want = Counter()
    for i, t in rows:
        if t is None:
            want[i, None] += 1
            continue
        out, reach = [], 0
        for a, k, b in spans[i][0]:
            out += [t[reach:a] if a > reach else "", f"<{weak_pii.KINDS[k]}>"]
            reach = max(reach, b)
        want[i, "".join(out) + t[reach:]] += 1
    assert held(weak_pii.redacted(docs), ["doc_id", "text"]) == want


def test_many_spans_are_held_apart_as_few_are(spark, monkeypatch):
    r = np.random.default_rng(1)
    bits = ["4485 2757 4230 8327", "4485-2757--4230-8327", "+1 (017) 555-7713", "+49 . 30 . 1234567", "a@b.com", "a at b dot com", "1.2.3.4", "word", "9" * 16, "é", "😀"]
    docs = spark.createDataFrame([(i, " ".join(r.choice(bits, 300))) for i in range(12)], "doc_id long, text string")
    few = sorted(map(str, weak_pii.with_candidates(docs).collect()))
    monkeypatch.setattr(weak_pii, "FEW", 0)
    assert sorted(map(str, weak_pii.with_candidates(docs).collect())) == few


def test_many_spans_take_time_in_proportion(spark):
    took = []
    for n in (4000, 16_000):
        docs = spark.createDataFrame([(1, "card 4485 2757 4230 8327 and +1 (017) 555-7713; " * n)], "doc_id long, text string")
        began = time.time()
        assert weak_pii.redacted(docs).collect()[0].text == "card <card> and <phone>; " * n
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 2


def test_posteriors_follow_the_votes():
    m = weak_pii.Model([(3, (1, 1, 1, 1, 1), 50), (3, (-1, -1, 0, -1, -1), 50), (2, (1, 1, 0, 1, 1), 9), (2, (-1, 0, 0, 0, -1), 9)])
    assert m.posterior[3, (1, 1, 1, 1, 1)] > 0.9 and m.posterior[3, (-1, -1, 0, -1, -1)] < 0.1


def brute_components(rows, size):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i in parent:
        for g in sets[i]:
            by[g].add(i)
    for i in parent:
        common = Counter(j for g in sets[i] for j in by[g] if j < i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sets, find


@pytest.mark.parametrize("size,small,block", [(2, 64, 4096), (5, 2, 3)])
def test_near_duplicates(docs, rows, size, small, block, monkeypatch):
    monkeypatch.setattr(odd_sketch, "SMALL", small)
    monkeypatch.setattr(odd_sketch, "BLOCK", block)
    sets, find = brute_components(rows, size)
    want = Counter((i, len(sets[i]), None if i is None else find(i), i is None or find(i) == i) for i, _ in rows)
    assert held(odd_sketch.near_duplicates(docs, size), ["doc_id", "n_shingles", "component_id", "kept"]) == want


def test_a_failed_nearest_pair_hides_no_link(spark, monkeypatch):
    """1 has 2 (similarity 0.79, checked as a star, failed) nearer by parity than 4 (0.81), and 2 and 4 are one component by way of 3."""
    words = lambda a, b: [f"w{k}" for k in range(a, b)]
    texts = {0: words(9000, 11000), 1: words(0, 2000), 2: words(0, 1580), 3: words(0, 1580) + words(2000, 2395), 4: words(0, 2468)}
    bands = {0: [1], 1: [1, 2], 2: [1, 2, 3], 3: [3, 4], 4: [1, 3, 4]}
    real = odd_sketch.signatures

    def signatures(size):
        inner = real(size)

        def run(batches):
            import pyarrow as pa

            for batch in inner(batches):
                own = [[*bands[i], *range(100 * (i + 1), 100 * (i + 1) + 32 - len(bands[i]))] for i in batch.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64())) if n == "bands" else batch.column(n) for n in batch.schema.names], batch.schema.names)

        return run

    monkeypatch.setattr(odd_sketch, "SMALL", 1)
    monkeypatch.setattr(odd_sketch, "signatures", signatures)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in odd_sketch.near_duplicates(docs, 1).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, rows without doc_id, and different texts under one doc_id are judged row by row."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    docs = spark.createDataFrame([(5, a, "x"), (5, a, "x"), (3, a + " tail", "x"), (7, b, "y"), (7, c, "z"), (None, c, "z"), (None, b + " more", "y"), (9, None, "n"), (9, None, "n"), (None, "", "n")], "doc_id long, text string, row string")
    got = sorted(((r.doc_id, r.text, r["row"]) for r in odd_sketch.keep_one(docs).collect()), key=str)
    assert odd_sketch.keep_one(docs).columns == docs.columns
    assert got == sorted([(3, a + " tail", "x"), (7, b, "y"), (7, c, "z"), (9, None, "n"), (9, None, "n"), (None, "", "n")], key=str)


@pytest.mark.parametrize("hot", [1, 3, 20_000])
def test_hot_bands_and_large_components(spark, monkeypatch, hot):
    """A chain of near copies that one star doesn't hold together, beside others in the same buckets."""
    monkeypatch.setattr(odd_sketch, "HOT", hot)
    monkeypatch.setattr(odd_sketch, "SMALL", 2)
    monkeypatch.setattr(odd_sketch, "BLOCK", 4)
    r = np.random.default_rng(3)
    rows = []
    for g in range(3):
        words = [f"g{g}w{k}" for k in range(80)]
        for i in range(25):
            rows.append((100 * g + i, " ".join(words)))
            words[int(r.integers(0, 80))] = f"n{g}x{i}"
    rows += [(900 + i, rows[30][1]) for i in range(20)] + [(None, rows[0][1])]
    sets, find = brute_components(rows, 2)
    got = odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert Counter((x.doc_id, x.component_id, x.kept) for x in got.collect()) == Counter((i, None if i is None else find(i), i is None or find(i) == i) for i, _ in rows)


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r.id: r.comp for r in odd_sketch.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(40)}


def test_set_bitmaps_never_exceed_the_difference():
    r = np.random.default_rng(0)
    for _ in range(50):
        x = r.integers(0, 2**63, 300).astype(np.uint64)
        y = np.unique(np.concatenate([x[: r.integers(1, 300)], r.integers(0, 2**63, r.integers(0, 200)).astype(np.uint64)]))
        x = np.unique(x)
        ones = int(np.bitwise_count(odd_sketch.set_parity(x) ^ odd_sketch.set_parity(y)).sum())
        assert ones <= len(np.setxor1d(x, y))


def test_byte_bpe(docs, rows):
    ranks = byte_bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, text in rows:
        ids = np.array(t.encode_ordinary(text or ""), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert held(byte_bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == want


def test_byte_bpe_round_trip_with_ids(docs, rows):
    out = byte_bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).select("doc_id", "decoded", "ids", "n_tokens").collect()
    assert Counter((r.doc_id, r.decoded) for r in out) == Counter((i, t or "") for i, t in rows)
    assert all(len(r.ids) == r.n_tokens for r in out)


def test_byte_bpe_takes_linear_time():
    """Steps through the automaton's tokens, by the compatibility look-ups, grow in proportion to a pre-token's length."""
    data = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    e = byte_bpe.Encoder(byte_bpe.read_ranks(data), P.PATTERN)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(data), special_tokens={})
    letters = np.random.default_rng(0).integers(97, 123, 1 << 18).astype(np.uint8).tobytes()
    assert e.encode_word(letters[:20_000]) == t.encode_ordinary(letters[:20_000].decode())
    took = []
    for n in (1 << 16, 1 << 18):
        began = time.process_time()
        e.encode_word(letters[:n])
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0] + 0.5  # sixteen times as much if it were quadratic


def test_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(_memo, "MOST_BYTES", 1000)
    memo = _memo.PieceMemo(lambda new: [[len(x), ord(x[0])] for x in new])
    for k in range(50):
        ids, lengths = memo.ids(["a" * (100 + k), "b", "a" * (100 + k)])
        assert ids.tolist() == [100 + k, 97, 1, 98, 100 + k, 97] and lengths.tolist() == [2, 2, 2] and len(memo.at) < 20


def test_lm_scores(docs, rows):
    got = log_bilinear.scored(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == lm_base(rows)
    own = [r for r in got if r.held_out and r.doc_id < 10**6]
    assert sum(r.score for r in own) > sum(r.base_score for r in own) and all(r.score < 0 for r in got)


def lm_base(rows):
    """doc_id, n_tokens, n_known, N and base_score by counting."""
    ho = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = [(i, [*WORD.findall(lower(t)), " "]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not ho[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return Counter((i, ho[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for i, ws in tokens)


@pytest.mark.parametrize("head", [1, 30, 1000])
def test_lm_counts_do_not_depend_on_the_head(spark, monkeypatch, head):
    """Hundreds of words that occur once or twice, most of which are in no head; the end is rarer than the head's words."""
    monkeypatch.setattr(log_bilinear, "HEAD", head)
    many = " ".join(f"w{k}" for k in range(500))
    rows = [(1, many), (2, many[:900] + " a a a a a"), (3, "a b c \x00 é"), (10, "never seen a"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = log_bilinear.scored(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == lm_base(rows)
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("head,least", [(200_000, 1000), (60, 40), (5000, 300)])
def test_lm_probabilities_sum_to_one(spark, docs, monkeypatch, head, least):
    """A trained model's probabilities of all training words and of one unseen word in each bucket, after some contexts."""
    monkeypatch.setattr(log_bilinear, "HEAD", head)
    monkeypatch.setattr(log_bilinear, "LEAST_WORDS", least)
    train = docs.where("doc_id < 60 or doc_id >= 1000000").select("doc_id", "text")
    counts = log_bilinear.word_counts(train).collect()
    v = log_bilinear.vocabulary(spark.createDataFrame(counts))
    assert v.tokens == sum(r.c for r in counts) and v.words == len(counts) and log_bilinear.END in v.at and len(v.at) <= head + 1
    start = log_bilinear.Model(v)
    model = log_bilinear.train_model(train, spark.sparkContext.broadcast(v))
    assert any(np.abs(x - y).max() > 0.01 for x, y in zip(model.parts[:2], start.parts[:2], strict=True))
    words, c = [bytes(r.word) for r in counts], np.array([r.c for r in counts], float)
    at, classes, _ = v.look_up(words)
    inside = np.where((classes >= v.first_bucket) & (classes < v.first_group), np.log((c + 0.1) / np.where(v.inner[classes] > 0, v.inner[classes], 1)), 0)
    unseen = np.arange(v.first_bucket, v.first_group)
    for one, two in [(0, 1), (v.end_row, v.end_row), (v.rows - 1, 2)]:
        n = len(words)
        p = model.log_probability(np.full(n, one), np.full(n, two), classes, v.place_of[at]) + inside
        q = model.log_probability(np.full(len(unseen), one), np.full(len(unseen), two), unseen, np.full(len(unseen), -1)) + np.log(0.1 / v.inner[unseen])
        assert abs(np.exp(p).sum() + np.exp(q).sum() - 1) < 1e-3


def test_lm_learns_alike_however_the_input_is_split(spark):
    """Bits a token of held-out texts, learnt by 1, 8 and 64 tasks from the same 5,000 documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 5000").select("doc_id", "text")
    bits = []
    for tasks in (1, 8, 64):
        score, base, n = log_bilinear.scored(docs.repartition(tasks, "doc_id")).where("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").head()
        bits.append(-score / n / np.log10(2))
    unigram = -base / n / np.log10(2)
    assert max(bits) - min(bits) < 0.1 and max(bits) < unigram - 0.6


def test_lm_moves_further_where_more_tasks_agree():
    """What several tasks changed together: the mean, and how many of them met a row."""
    one = {"rows": np.array([0, 2], np.int16).tobytes(), "met": np.array([4, 2], np.float32).tobytes(), "square": np.array([16, 4], np.float32).tobytes(), "gain": np.ones((2, 2), np.float32).tobytes(), "change": log_bilinear.packed(np.full((2, log_bilinear.DIM + 1), 0.5, np.float32))}
    two = one | {"rows": np.array([0, 3], np.int16).tobytes(), "change": log_bilinear.packed(np.full((2, log_bilinear.DIM + 1), 0.7, np.float32))}
    fields = [c for c in log_bilinear.LEARNT if c != "block"]
    step = log_bilinear.Step(1 << 24 | 2, **log_bilinear.together([tuple(x[c] for c in fields) for x in (one, two)]))
    assert step.which == 1 and step.at.tolist() == [2 * log_bilinear.BLOCK + i for i in (0, 2, 3)]
    assert np.allclose(step.tasks, [2, 1, 1]) and np.allclose(step.gain, 1) and np.allclose(step.change, [[0.6], [0.5], [0.7]], atol=0.01)


def test_lm_looks_words_up_without_making_python_objects_of_them():
    """Words as an Arrow array, as the tasks have them: places, classes and rows as by a dict and byte by byte; a slice of the array too."""
    words = [b"a", b"bc", "é".encode(), b"\x00", b"xyz", b"never", b"q", "日本".encode(), b" "]
    v = log_bilinear.Vocabulary([(b"bc", 9), (b"xyz", 5), (b" ", 4), (b"a", 1)], {}, 19, 3)
    bucket = [(w[-2] * 31 + w[-1] * 7 + 2 if len(w) > 1 else w[0] * 31 + 1) % log_bilinear.BUCKETS for w in words]
    for own, low in ((words, 0), (pa.array(words, pa.binary()), 0), (pa.array(words, pa.binary())[3:], 3)):
        at, classes, rows = v.look_up(own)
        assert at.tolist() == [v.at.get(w, -1) for w in words[low:]]
        assert log_bilinear.buckets_of(own).tolist() == bucket[low:]
        assert all((c, r) == (v.first_bucket + b, v.end_row + 1 + b) for p, c, r, b in zip(at, classes, rows, bucket[low:], strict=True) if p < 0)
    assert [len(x) for x in v.look_up(pa.array([], pa.binary()))] == [0, 0, 0] and len(log_bilinear.buckets_of([])) == 0
    tokens, codes, lengths = log_bilinear._tokens(pa.RecordBatch.from_arrays([pa.array([" A b  a", None, ""])], ["text"]))
    assert isinstance(tokens, pa.Array) and [tokens[int(c)].as_py() for c in codes] == [b"a", b"b", b"a", b" ", b" ", b" "] and lengths.tolist() == [4, 1, 1]
    rows = np.array([70_000, 3, 70_000, 65_539, 3, 4_464])
    at, total, often = log_bilinear._sums(rows, np.arange(12.0).reshape(6, 2))
    assert at.tolist() == [3, 4464, 65_539, 70_000] and total.tolist() == [[10, 12], [10, 11], [6, 7], [4, 6]] and often.tolist() == [2, 1, 1, 2]


def test_lm_vocabulary_grows_with_the_tokens():
    own = [log_bilinear.Vocabulary([(f"w{k}".encode(), 10**9 // (k + 1)) for k in range(30_000)] + [(log_bilinear.END, 1)], {}, n, 10**6) for n in (10**6, 10**7, 4 * 10**7)]
    assert [v.end_row for v in own] == [log_bilinear.LEAST_WORDS, 10**7 // log_bilinear.TOKENS_A_WORD, 4 * 10**7 // log_bilinear.TOKENS_A_WORD]
    assert all(v.classes < 8 * v.end_row**0.5 + 200 for v in own)


def plain_discriminant(x, y):
    """Scores by the formula of the densities, with no Cholesky factors."""
    center = x.mean(axis=0)
    scale = np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    density = []
    for c in (0, 1):
        own = (x[y == c] - center) / scale
        m, mean, cov = len(own), own.mean(axis=0), np.cov(own.T, bias=True)
        w = max(discriminant.SHRINKAGE, min(1.0, x.shape[1] / (m + 1)))
        cov = (1 - w) * cov + w * np.diag(0.5 * np.diag(cov) + 0.5) + 1e-6 * np.eye(x.shape[1])
        density.append((mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1], m))

    def score(v):
        z = np.clip((v - center) / scale, -discriminant.CLIP, discriminant.CLIP)
        side = [np.log(m) - 0.5 * ((z - mean) @ inverse @ (z - mean) + det) for mean, inverse, det, m in density]
        return 1 / (1 + np.exp(np.clip(side[0] - side[1], -700, 700)))

    return score


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").union(spark.createDataFrame([(None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int"))
    got = discriminant.scored(docs, labels).collect()
    held_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held_out(r.doc_id) for r in got)
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null and doc_id is not null").collect()}
    x = {r.doc_id: np.array(r.features) for r in discriminant.features(docs).collect()}
    train = [i for i in truth if i in x and not held_out(i)]
    score = plain_discriminant(np.array([x[i] for i in train]), np.array([truth[i] for i in train]))
    assert all(abs(r.score - score(x[r.doc_id])) < 1e-6 for r in got if r.doc_id is not None)
    own = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert len(own) > 20 and np.mean(own) > 0.93
    assert all(r.score == 0.5 for r in discriminant.scored(docs, labels.where("false")).collect())
    kept = discriminant.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.score >= 0.5)


def measures(t):
    w = WORD.findall(t or "")
    three = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(three)
    covered = {i + k for i, g in enumerate(three) if often[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, rows):
    out = rule_ledger.apply_policy(rule_ledger.ledger(docs))
    want = Counter()
    for i, t in rows:
        m = measures(t)
        want[(i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert held(out, ["doc_id", *rule_ledger.MEASURES[:5], "base_failed"]) == want
    assert not out.where("base_failed and kept").count()
    good = rule_ledger.keep_good(docs)
    assert good.columns == docs.columns and held(good, ["doc_id"]) == held(out.where("kept"), ["doc_id"])
    ledger = rule_ledger.ledger(docs)
    bits = [r.failed_bits for r in ledger.collect()]
    for r in rule_ledger.ablation(ledger).collect():
        b = rule_ledger.bit(r.rule)
        assert (r.failed, r.alone, r.rejected) == (sum(bool(x & b) for x in bits), bits.count(b), sum(map(bool, bits))) and r.rejected_without == r.rejected - r.alone


def test_packing(docs, rows):
    out = nnls_packing.packed(docs, P.path("word_bpe_49k.json"), with_ids=True).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i, tuple(ids)] += 1
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append(r)
        texts[r.doc_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)
    assert sum(len(x.ids) for x in out) == sum(len(k[1]) * n for k, n in want.items())
    for i, ids in want:
        if i != 10**6 + 4:
            own = sorted(texts[i], key=lambda r: r.start)
            assert tuple(x for r in own for x in r.ids) == ids and all(r.doc_tokens == len(ids) for r in own)


def test_sequences_of_many_rows_and_windows_do_not_collide(spark, monkeypatch):
    """Small windows, so that rows have many of them, and few rows that look up their ranks together."""
    monkeypatch.setattr(nnls_packing, "DEAL", 3)
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 90)) for i in range(200)], "doc_id long, text string").repartition(5)
    out = nnls_packing.packed(docs, P.path("word_bpe_49k.json"), window=16).collect()
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= 16
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("lengths", [[3000] * 50, [1] * 9000, [4095, 1, 2048, 2048, 5], list(range(1, 400)) * 3])
def test_plans_place_every_tail_once(lengths):
    h = np.bincount(lengths, minlength=4096)
    plan, used = nnls_packing.Plan(h), defaultdict(list)
    for n in np.flatnonzero(h):
        for rank in range(h[n]):
            pieces = plan.place(int(n), rank)
            assert sum(p[1] for p in pieces) == n and [p[0] for p in pieces] == np.cumsum([0, *[p[1] for p in pieces]])[:-1].tolist()
            for _, size, sequence, offset in pieces:
                used[sequence].append((offset, size))
    for s in used.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0
        total = s[-1][0] + s[-1][1]
        assert total == 4096 or total & (total - 1) == 0


def test_licenses(docs, rows):
    want = Counter()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in rows:
        w = word.findall(lower(t))
        places = [(k, label) for p, label in license_scan.PHRASES.items() for q in [p.split()] for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
        base = {x for _, x in places}
        more, best = set(base), 0.0
        for b in re.split(r"\n[ \t\x0B\f\r]*\n", lower(t)):
            own = set(word.findall(b))
            for label, template in license_scan.TEMPLATES:
                s = set(template.split())
                if len(s & own) >= license_scan.need(len(s), license_scan.PERCENT):
                    more.add(label)
                    best = max(best, len(s & own) / len(s))
        at = [k for k, _ in places]
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(more)), 1.0 if at else best] += 1
    assert held(license_scan.scanned(docs), ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]) == want


def test_empty_tables(spark):
    docs, labels = nothing(spark), spark.read.parquet(f"{SF}/labels.parquet")
    for out in (weak_pii.found(docs), odd_sketch.near_duplicates(docs), byte_bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), log_bilinear.scored(docs), discriminant.scored(docs, labels), rule_ledger.ledger(docs), nnls_packing.packed(docs, P.path("word_bpe_49k.json")), license_scan.scanned(docs)):
        assert out.count() == 0
