"""Each stage of the pipeline against brute force on what the stage before has kept, and on an empty table."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import discriminant, weak_pii
from tessera.llm._tables import keep
from tests.llm.data import SF, documents
from tests.llm.test_documents import WORD, brute_components, measures, plain_discriminant

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_by_rules(t):
    t = t or ""
    n, chars, symbols, same, again = measures(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    upper, letters = (len(re.findall(p, t)) for p in ("[A-Z]", "[A-Za-z\u0080-\U0010ffff]"))
    dots = sum(x.rstrip(" \t\x0b\x0c\r").endswith(("...", "\u2026")) for x in lines)
    failed = [n < 50, 100 * again > 50 * n, chars < 2 * n, chars > 20 * n, 10 * symbols > 3 * n and symbols >= 10, 2 * same > len(lines) and same >= 3, 10 * upper > 6 * letters and letters > 0, 2 * letters < chars, 10 * dots > 3 * len(lines) and dots >= 3]
    return not any(failed)


def by_order(r):
    return (r.doc_id is None, r.doc_id or 0)


def test_stages(spark):
    base = documents(spark).select(*COLUMNS)
    twice = base.where("doc_id in (3, 17, 1000000)").union(base.where("doc_id in (5, 8)").selectExpr("cast(null as bigint)", "text || ' and more'", "lang", "source", "n_chars"))
    docs = keep(base.union(twice), "documents")
    rows = docs.collect()
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "rules", "near_duplicates", "personal_data", "packing"]

    def after(name):
        nonlocal docs
        docs = keep(stages[name](spark, docs, SF), name)
        return docs.collect()

    # quality: the plain formula, learnt from the labelled rows that aren't held out
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    both = docs.selectExpr("crc32(cast(doc_id as string)) % 3 = 1 held", "*").collect()
    x = np.vstack([discriminant.statistics(spark_array([r.text])) for r in both])
    train = [i for i, r in enumerate(both) if r.doc_id in labels and not r.held]
    score = plain_discriminant(x[train], np.array([labels[both[i].doc_id] for i in train]))
    want = Counter(tuple(r[c] for c in COLUMNS) for i, r in enumerate(both) if score(x[i]) >= 0.5)
    rows = after("quality")
    assert docs.columns == COLUMNS and Counter(map(tuple, rows)) == want and 100 < len(rows) < len(both)

    want = Counter(tuple(r) for r in rows if kept_by_rules(r.text))
    rows = after("rules")
    assert docs.columns == COLUMNS and Counter(map(tuple, rows)) == want

    sets, find = brute_components(list(enumerate(r.text for r in rows)), 5)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i) if sets[i] else ("alone", i)].append(r)
    want = Counter(tuple(min(g, key=by_order)) for g in groups.values())
    before, rows = len(rows), after("near_duplicates")
    assert docs.columns == COLUMNS and Counter(map(tuple, rows)) == want and len(rows) < before

    spans = {(r.doc_id, r.at): r.details for r in weak_pii.found(docs.selectExpr("xxhash64(text) doc_id", "text")).selectExpr("doc_id", "0 at", "details").collect()}
    keys = {r.text: r.k for r in docs.selectExpr("text", "xxhash64(text) k").collect()}
    want = Counter()
    for r in rows:
        out, reach = [], 0
        for s in sorted(spans[keys[r.text], 0], key=lambda s: (s.start, s.kind, s.stop)):
            out += [r.text[reach : s.start] if s.start > reach else "", f"<{weak_pii.KINDS[s.kind]}>"]
            reach = max(reach, s.stop)
        new = "".join(out) + r.text[reach:]
        want[(r.doc_id, new, r.lang, r.source, len(new))] += 1
    rows = after("personal_data")
    assert docs.columns == COLUMNS and Counter(map(tuple, rows)) == want

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids) + 1) for r in rows)
    pieces = after("packing")
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    assert sum(p.length for p in pieces) == sum(n * k for (_, n), k in want.items())
    used = defaultdict(list)
    for p in pieces:
        used[p.sequence_id].append((p.offset, p.length))
    for s in used.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= 4096


def spark_array(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def test_stages_of_nothing(spark):
    docs = documents(spark).select(*COLUMNS).where("false")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == COLUMNS


def test_run_gives_the_last_stage(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
