"""Quality rules as a ledger of bit masks.

Every rule is evaluated once for every document. The ledger holds the measurements and one long whose bit i says that rule i failed. A policy is a
version and the set of rules that reject; it is applied to a written ledger by one AND, so policies can change without reading a text again.
ablation() counts by bitwise aggregation what each rule of a policy rejects, alone and together with others.

Defined results: null is the empty text (no words; it fails too_short). Rows, also repeated ones and those without
doc_id, are judged each by its own text, which is measured whole at any length. An empty table gives none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm._bytes import Words, slices
from tessera.llm._tables import rolled, unrolled

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ellipsis_lines"]
#: name -> SQL condition of failing, over MEASURES; the bit is the place in this dict, so new rules go to the end.
RULES = {
    "too_short": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "words_too_short": "word_chars < 2 * n_words",
    "words_too_long": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words and n_symbols >= 10",
    "duplicate_lines": "2 * n_dup_lines > n_lines and n_dup_lines >= 3",
    "shouting": "10 * n_upper > 6 * n_letters and n_letters > 0",
    "no_letters": "2 * n_letters < word_chars",
    "ellipsis_lines": "10 * n_ellipsis_lines > 3 * n_lines and n_ellipsis_lines >= 3",
}
BASE = ["too_short", "repeated_windows"]
POLICIES = {
    "base-1": BASE,
    "web-1": list(RULES),
    "web-2": [r for r in RULES if r != "ellipsis_lines"],
}
CURRENT = "web-1"

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), range(65, 91))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])  # bytes from 0xC0 on begin the characters beyond ASCII
_INSIDE = np.isin(np.arange(256), range(0x80, 0xC0))
_BLANK = b" \t\x0b\x0c\r"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _repeated(h: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(h) < 4:
        return 0
    w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1]) * np.uint64(0xD1B54A32D192ED03) + h[2:]
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[k : k + len(w)] |= again
    return int(covered.sum())


def measure(texts: pa.Array) -> np.ndarray:
    w = Words(texts)
    n = w.docs
    per_doc = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[w.off])
    inside = np.concatenate([[0], np.cumsum(_INSIDE[w.data], dtype=np.int64)])
    characters = np.concatenate([[0], np.cumsum(w.ends - w.starts - (inside[w.ends] - inside[w.starts]))])
    h = w.hashes(lower=False)
    out = np.zeros((n, len(MEASURES)), np.int64)
    out[:, 0] = np.diff(w.first)
    out[:, 1] = np.diff(characters[w.first])
    out[:, 2] = per_doc(_SYMBOLS[w.data])
    out[:, 6] = per_doc(_UPPER[w.data])
    out[:, 7] = per_doc(_LETTER[w.data])
    for d in range(n):
        out[d, 4] = _repeated(h[w.first[d] : w.first[d + 1]])
        lines = [x for x in w.data[w.off[d] : w.off[d + 1]].tobytes().split(b"\n") if x.strip(_BLANK)]
        out[d, 3] = len(lines) - len(set(lines))
        out[d, 5] = len(lines)
        out[d, 8] = sum(x.rstrip(_BLANK).endswith((b"...", b"\xe2\x80\xa6")) for x in lines)
    return out


def _measured(rows: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns of rows (with text), the MEASURES and failed_bits."""
    schema = StructType([rows.schema[c] for c in carried] + [StructField(m, LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], *[pa.array(np.ascontiguousarray(m[:, k])) for k in range(m.shape[1])]], [*carried, *MEASURES])

    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0))
    return rows.mapInArrow(run, schema).withColumn("failed_bits", bits.cast("bigint"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the MEASURES and failed_bits of every row of docs."""
    return _measured(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), ["doc_id"])


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with the policy's verdict: base_failed, kept and the policy's version."""
    failed = lambda m: F.col("failed_bits").bitwiseAND(F.lit(m).cast("bigint")) != 0
    base = sum(bit(r) for r in BASE)
    return rows.withColumn("base_failed", failed(base)).withColumn("kept", ~failed(mask(policy) | base)).withColumn("policy", F.lit(policy))


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: failed (documents that fail it), alone (documents that only this rule rejects), and the documents that the policy rejects with and without it."""
    m = mask(policy)
    own = F.col("failed_bits").bitwiseAND(F.lit(m).cast("bigint"))
    patterns = rows.groupBy(own.alias("bits")).agg(F.count("*").alias("docs"))  # at most 2^rules rows, counted before they are shuffled
    named = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]]))
    each = patterns.select("bits", "docs", named.alias("r")).select("bits", "docs", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.sum(F.when(c, F.col("docs")).otherwise(0))
    return each.groupBy("rule").agg(count(has).alias("failed"), count(F.col("bits") == F.col("bit")).alias("alone"), count(F.col("bits") != 0).alias("rejected"), count((F.col("bits") != 0) & (F.col("bits") != F.col("bit"))).alias("rejected_without"))


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs that the policy keeps, with docs' own columns, in one pass; each row is judged by its own text."""
    rows = rolled(docs)
    return unrolled(apply_policy(_measured(rows, ["own", "text"]), policy).where("kept"), docs)
