"""Personal data by weak supervision.

Candidates are spans of the base patterns and of looser ones. Labelers look at each candidate - regex (does it have the strict form), gazetteer (known
country codes, domain endings, card issuers, key names), context (words before it), shape (usual length) and edges (is it part of a longer token) - and
vote yes, no or nothing. The votes of all candidates are counted by pattern, of which there are at most KINDS * 3^LABELERS, and only
these counts reach the driver. Expectation-maximisation estimates from them the labelers' reliabilities and each pattern's probability; with
these as soft labels a logistic span classifier over kind and votes is trained, which judges the candidates. Base spans are kept whatever it says.

Only DataFrame expressions are used; the two fits are plain arithmetic over the counted patterns.

Defined results: null is the empty text. Spans are code points, end exclusive. Candidates that overlap a base span, or a candidate of a kind listed before,
are not added again. Without any candidate the classifier accepts none. Rows, also repeated ones and those without doc_id (which stays null), are searched each on its own. A text of any length is searched whole, in time that grows with its length. An empty table
gives none."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._native import chunks, count_below, cut, let, matches, most_before
from tessera.llm._tables import keep, rolled, unrolled

#: Base kinds in their order, with patterns that match what the plain ones do, but can't backtrack: a run of characters is taken whole
#: (possessive), and begins where it isn't preceded by one of its own, unless the last match ended there.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser kinds, with the kind that a span of theirs is reported as.
LOOSE = {
    "secret": (r"(?i)(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])", "secret"),
    "phone_like": (r"\+[0-9](?:[^0-9A-Za-z\n]{0,5}+[0-9]){9,14}+", "phone"),
    "email_like": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}+", "email"),
    "card_like": (r"(?<![0-9])[0-9]{4}+(?:[^0-9A-Za-z\n]{1,4}+[0-9]{4}+){3}+(?![0-9])", "card"),
}
KINDS = [*BASE, "secret"]
LABELERS = ["regex", "gazetteer", "context", "shape", "edges"]
#: Words before a span that speak for personal data. Fixed values.
CONTEXT = {
    "email": "mail|email|e-mail|contact|write|reach|correo|courriel|kontakt",
    "ip": "ip|host|address|server|from|login|client",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|fax|mobile|cell|telefon|dial|whatsapp",
    "secret": "token|secret|key|password|passwd|api|auth|bearer",
}
_GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]]? ?)(?:com|org|net|edu|gov|de|fr|es|uk|io|info|eu)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "secret": None,
}
ROUNDS = 60
FEW = 32  # spans up to which each candidate is held against all of them
ACCEPT = 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""

    def step(s: Column, n: Column) -> Column:
        def value(i: Column) -> Column:
            d = F.ascii(F.substring(s, n - i, F.lit(1))) - 48
            return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0

    return let(digits, lambda s: F.when(F.char_length(s) > 0, step(s, F.char_length(s))).otherwise(F.lit(False)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _holds(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern passes the kind's check."""
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    n = lambda d: F.char_length(d)
    if kind == "card":
        return let(_digits(m), lambda d: F.when(n(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return n(_digits(m)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, strict: bool, s: Column) -> Column:
    """Votes of all LABELERS, as an array in their order."""
    m, before, after = s["m"], s["before"], s["after"]
    n = F.char_length(_digits(m))
    if kind == "secret":
        letters = m.rlike("[A-Fa-f]") & m.rlike("[0-9]")
        regex, gazetteer = _vote(letters, ~letters), _vote(before.rlike(r"""(?i)(?:token|secret|key|password|api)[a-z_]*\W{1,6}$"""), F.lit(False))
        shape = _vote(F.char_length(m).isin(32, 40, 56, 64, 96, 128), F.lit(False))
    else:
        regex = F.lit(1) if strict else _vote({"phone": n.between(10, 15), "card": let(_digits(m), luhn), "email": F.lit(True)}[kind], F.lit(kind == "card"))
        listed = m.rlike(_GAZETTEER[kind])
        gazetteer = _vote(listed, ~listed)
        shape = {"email": _vote(m.rlike(r"^[^@ ]{1,64}"), F.lit(False)), "ip": _vote(F.char_length(m) >= 9, F.lit(False)), "card": _vote(n.isin(15, 16), n > 16), "phone": _vote(n.between(11, 13), n < 10)}[kind]
    context = _vote(before.rlike(rf"(?i)(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"), F.lit(False))
    joined = before.rlike(r"[\p{L}\p{N}_.]$") | after.rlike(r"^[\p{L}\p{N}_]")
    return F.array(regex, gazetteer, context, shape, _vote(~joined, joined)).cast("array<int>")


def _apart(more: Column, held: Column) -> Column:
    """The spans of more that overlap none that is held: as many of these begin before their ends as end before their starts."""
    edges = lambda name: F.array_sort(F.transform(held, lambda y: y[name]))
    few = F.filter(more, lambda x: ~F.exists(held, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])))
    many = let(edges("start"), lambda starts: let(edges("stop"), lambda stops: F.filter(more, lambda x: count_below(starts, x["stop"], False) == count_below(stops, x["start"], True))))
    return F.when(F.size(held) <= FEW, few).otherwise(many)


_SPAN = "array<struct<start:int,kind:int,stop:int,base:boolean,votes:array<int>>>"


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column spans: all candidates of the text, array<struct<start, kind, stop, base, votes>> by start. kind is the place in KINDS.

    Each step is a column of its own that the next one uses more than once, so that it is computed once."""
    has = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast(_SPAN)
    digit = has.rlike("[0-9][^0-9]{0,5}[0-9]")
    may = {"email": has.contains("@"), "ip": digit, "card": digit, "phone": has.contains("+"), "secret": has.rlike("(?i)[0-9a-f]{32}"), "phone_like": has.contains("+"), "email_like": has.rlike(r"(?i)(?:[(\[]| )dot(?:[)\]]| )"), "card_like": digit}

    def spans(name: str, kind: str, pattern: str, strict: bool) -> Column:
        held = matches(has, pattern)
        if strict:
            held = F.filter(held, lambda s: _holds(kind, s["m"]))
        found = F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["stop"].alias("stop"), F.lit(strict).alias("base"), _votes(kind, strict, s).alias("votes")))
        return F.when(may[name], found.cast(_SPAN)).otherwise(none)

    out = docs.withColumn("spans", F.concat(*[spans(k, k, p, True) for k, p in BASE.items()]))
    for name, (pattern, kind) in LOOSE.items():
        out = out.withColumn("_more", spans(name, kind, pattern, False)).withColumn("spans", F.when(F.size("_more") > 0, F.concat("spans", _apart(F.col("_more"), F.col("spans")))).otherwise(F.col("spans"))).drop("_more")
    return out.withColumn("spans", F.array_sort("spans"))


class Model:
    """weights of the span classifier by kind and vote, and the estimated reliabilities."""

    def __init__(self, counted: list[tuple[int, tuple[int, ...], int]]):
        # every kind weighs the same, however frequent it is
        total = {k: sum(n for kind, _, n in counted if kind == k) for k in range(len(KINDS))}
        patterns = [(kind, votes, 200 * n / total[kind]) for kind, votes, n in sorted(counted)]
        self.reliability = self._expectation_maximisation(patterns)
        self.weights = self._classifier(patterns)

    def _expectation_maximisation(self, patterns: list) -> dict:
        """P(vote | class) of each labeler, smoothed, and P(class) of each kind. It starts from labelers that are mostly right and often silent."""
        start = {1: {1: 0.5, 0: 0.4, -1: 0.1}, 0: {1: 0.1, 0: 0.4, -1: 0.5}}
        like = {(j, c): dict(start[c]) for j in range(len(LABELERS)) for c in (0, 1)}
        prior = {k: 0.5 for k in range(len(KINDS))}
        self.posterior: dict = {}
        for _ in range(ROUNDS):
            for kind, votes, _n in patterns:
                side = {c: log(prior[kind] if c else 1 - prior[kind]) + sum(log(like[j, c][v]) for j, v in enumerate(votes)) for c in (0, 1)}
                self.posterior[kind, votes] = 1 / (1 + exp(max(-50.0, min(50.0, side[0] - side[1]))))
            for k in prior:
                own = [(self.posterior[kind, v], n) for kind, v, n in patterns if kind == k]
                prior[k] = (20 + sum(p * n for p, n in own)) / (40 + sum(n for _, n in own))
            for (j, c), table in like.items():
                # counts on top of what the labelers are taken for at the start
                total = {v: 100 * start[c][v] for v in table}
                for kind, votes, n in patterns:
                    p = self.posterior[kind, votes]
                    total[votes[j]] += n * (p if c else 1 - p)
                for v in table:
                    table[v] = total[v] / sum(total.values())
        return {"prior": prior, "like": like}

    def _classifier(self, patterns: list) -> dict:
        """Logistic regression on the posteriors, by gradient steps over the patterns; weights for each kind and each vote of each labeler."""
        w: dict = {("kind", k): 0.0 for k in range(len(KINDS))} | {(j, v): 0.0 for j in range(len(LABELERS)) for v in (1, -1)}
        total = sum(n for _, _, n in patterns)
        speed = {k: 1e-6 for k in w}
        for _ in range(400 if total else 0):
            slope = {k: 1e-3 * w[k] for k in w}
            for kind, votes, n in patterns:
                on = [("kind", kind), *((j, v) for j, v in enumerate(votes) if v)]
                error = 1 / (1 + exp(max(-50.0, min(50.0, -sum(w[k] for k in on))))) - self.posterior[kind, votes]
                for k in on:
                    slope[k] += error * n / total
            for k, g in slope.items():
                speed[k] += g * g
                w[k] -= 0.5 * g / speed[k] ** 0.5
        return w

    def probability(self, span: Column) -> Column:
        z = F.element_at(F.array(*[F.lit(self.weights["kind", k]) for k in range(len(KINDS))]), span["kind"] + 1)
        for j in range(len(LABELERS)):
            vote = span["votes"][j]
            z = z + F.when(vote == 1, F.lit(self.weights[j, 1])).when(vote == -1, F.lit(self.weights[j, -1])).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit(found: DataFrame) -> Model:
    """A model from a table with the column spans of with_candidates()."""
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()  # at most KINDS * 3^LABELERS rows
    return Model([(r.kind, tuple(r.votes), r["count"]) for r in counts])


def accepted(spans: Column, model: Model) -> Column:
    return F.filter(spans, lambda s: s["base"] | (model.probability(s) >= ACCEPT))


def _named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ",")


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs, and details (the accepted spans with their votes)."""
    table = keep(with_candidates(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "spans"), "candidates")
    model = fit(table)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == KINDS.index(kind)))).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return table.select("doc_id", *counts, F.sha2(_named(base).cast("binary"), 256).alias("base_sha256"), accepted(F.col("spans"), model).alias("details")).withColumn("spans", _named(F.col("details")))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every accepted span of text replaced by its kind in angle brackets, and n_chars made to fit; other columns as they are.

    Where accepted spans overlap, what they cover together is gone and each is named once. A null text stays null. The new text is joined from what lies between the spans, which is taken from pieces of the
    text, so a long text with many spans takes time in proportion."""
    table = keep(with_candidates(rolled(docs)), "candidates")  # with the texts, so that they are searched once
    model = fit(table.select("spans"))
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    held = table.withColumn("spans", accepted(F.col("spans"), model))

    def joined(pieces: Column, reach: Column) -> Column:
        # reach: the furthest stop before each span; what stays is between it and the span's start
        between = F.transform("spans", lambda s, i: F.concat(cut(pieces, F.get(reach, i), s["start"]), F.element_at(kinds, s["kind"] + 1)))
        last = cut(pieces, F.array_max(F.transform("spans", lambda s: s["stop"])), F.char_length("text"))
        return F.concat(F.array_join(between, ""), last)

    stops = F.transform("spans", lambda s: s["stop"])
    new = let(chunks(F.col("text")), lambda pieces: let(most_before(stops), lambda reach: joined(pieces, reach)))
    done = held.withColumn("new", F.when(F.size("spans") > 0, new).otherwise(F.col("text")))
    return unrolled(done, docs, text=F.col("new"), n_chars=F.char_length("new").cast("bigint"))
