"""Personal data by weak supervision.

Candidate spans of four kinds come from patterns: strict ones with a check (the base, which always stays) and looser
ones: disguised addresses, numbers without a country code, digit runs that fail their check. Labelers vote on each
candidate, for, against or not at all: the strict pattern with its check; a gazetteer (top-level domains, country and
issuer prefixes, reserved networks); the words before it; and what touches it. Expectation-maximisation over the vote
patterns estimates, for each kind, how reliable each labeler is and how likely each pattern is personal data; a logistic
span classifier is then trained on these likelihoods, from the votes and the span's form. Candidates that it takes for
personal data are added to the base.

Finding, voting, counting and scoring are DataFrame expressions. What the driver sees to train on is a histogram: a row
for each kind, vote pattern and form, at most 4 * 3^4 * 4 rows, whatever the corpus; its counts cover all documents.

Places of matches come from the text between them, so no pattern runs row by row outside the engine; patterns are
possessive or anchored at run starts, so that they take linear time on texts without white space as well.

Defined cases: a null text is empty and has no span; repeated rows are searched each; spans of one kind never overlap,
base first; spans of different kinds may; offsets are code points, ends exclusive; an empty table gives an empty result
and no added spans; a null id and other columns are left as they are.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import kept
from ._tables import table

KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# Equal, match for match, to the plain forms of these patterns. \G is where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{DOMAIN}]++(?:\.[{DOMAIN}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+ ?(?:\[at\]|\(at\)| at ) ?[{DOMAIN}]{{1,63}}+ ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{{2,24}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\[?\.\]?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
#: What every match of a pattern holds, so that texts without it need no search: a string, or a shorter pattern.
IMPLIED = {
    ("email", "base"): "@",
    ("email", "loose"): "dot",
    ("ip", "base"): r"[0-9]\.[0-9]",
    ("ip", "loose"): r"[0-9]\[?\.\]?[0-9]",
    ("card", "base"): r"[0-9](?:[\x20-]?[0-9]){15}",
    ("card", "loose"): r"[0-9](?:[\x20-]?[0-9]){12}",
    ("phone", "base"): "+",
    ("phone", "loose"): r"[0-9]{3}[ .-][0-9]{4}",
}
# Gazetteers, as patterns on a span's own text.
GAZETTEER_FOR = {
    "email": r"(?i)(?:\.|dot\W{1,2})(?:com|org|net|edu|gov|io|info|biz|co|de|fr|es|uk|eu|us|ch|at|it|nl)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])\D",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0245])",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2}\)?[ .-][2-9])",
}
GAZETTEER_AGAINST = {
    "email": r"^[@.%+-]",
    "ip": r"^(?:0+|127|255)\D|(?:^|\D)0[0-9]",
    "card": r"([0-9])\1{9}",
    "phone": r"([0-9])\1{6}",
}
# Words shortly before a span.
CONTEXT_FOR = {
    "email": r"(?i)mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|login|from",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay",
    "phone": r"(?i)phone|\btel|call|fax|mobile|cell|whatsapp|telefon",
}
CONTEXT_AGAINST = {
    "email": r"(?i)version|example only",
    "ip": r"(?i)\bv(?:er(?:sion)?)?\.? ?$|section|chapter|release",
    "card": r"(?i)\bid\b|isbn|serial|order|tracking|token",
    "phone": r"(?i)isbn|serial|order|tracking|invoice",
}
BEFORE = 32
N_VOTES, N_FORMS = 4, 4
THRESHOLD = 0.5


def matches(text: Column, pattern: str, implied: str) -> Column:
    """array<struct<value, start, end>> of a pattern's matches, from the pieces between them."""
    may = text.rlike(implied) if "[" in implied else F.contains(text, F.lit(implied))
    values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<value:string,start:int,end:int>>")

    def walk(pair: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            value = F.get(pair["values"], i)
            start = a["at"] + F.char_length(F.get(pair["between"], i))
            end = start + F.char_length(value)
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(value.alias("value"), start.alias("start"), end.alias("end")))).alias("out"))

        first = F.struct(F.lit(0).alias("at"), none.alias("out"))
        n = F.size(pair["values"])
        return F.when(n == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), first, add)["out"])

    held = F.array(F.struct(values.alias("values"), between.alias("between")))
    return F.when(may, F.get(F.transform(held, walk), F.lit(0))).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check that a strict match must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(value))
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), luhn(_digits(value))).otherwise(False)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind], IMPLIED[kind, "base"]), lambda m: passes(kind, m["value"]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def candidates(text: Column, kind: str, base: Column) -> Column:
    """array<struct<kind, start, end, base, votes, form>>: the base spans, then the looser matches apart from them."""
    loose = F.filter(matches(text, LOOSE[kind], IMPLIED[kind, "loose"]), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))

    def judged(strict: bool):
        def judge(m: Column) -> Column:
            value = m["value"]
            before = F.substring(text, F.greatest(F.lit(1), m["start"] + 1 - BEFORE), F.least(m["start"], F.lit(BEFORE)))
            touching = F.concat(F.substring(text, m["start"], F.when(m["start"] > 0, 1).otherwise(0)), F.substring(text, m["end"] + 1, F.lit(1)))
            votes = F.array(
                F.lit(1 if strict else -1 if kind in ("card", "ip") else 0),
                _vote(value.rlike(GAZETTEER_FOR[kind]), value.rlike(GAZETTEER_AGAINST[kind])),
                _vote(before.rlike(CONTEXT_FOR[kind]), before.rlike(CONTEXT_AGAINST[kind])),
                _vote(touching.rlike(r"^[\s,.;:!?()\"'<>|]*$"), touching.rlike(r"[\p{L}\p{N}_]")),
            )
            # form: are there separators, and is the span long for its kind
            form = F.when(value.rlike(r"[ ()\[\]-]"), 1).otherwise(0) + F.when(F.char_length(value) > {"email": 24, "ip": 11, "card": 16, "phone": 14}[kind], 2).otherwise(0)
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit(strict).alias("base"), votes.alias("votes"), form.alias("form"))

        return judge

    return F.concat(F.transform(base, judged(True)), F.transform(loose, judged(False)))


def find(docs: DataFrame) -> DataFrame:
    """docs (text and any other columns) with _candidates."""
    text = F.coalesce("text", F.lit(""))
    out = docs
    for kind in KINDS:
        out = out.withColumn(f"_base_{kind}", base_spans(text, kind))
    out = out.withColumn("_candidates", F.concat(*(candidates(text, kind, F.col(f"_base_{kind}")) for kind in KINDS)))
    return out.drop(*(f"_base_{kind}" for kind in KINDS))


def expectation_maximisation(histogram: dict[tuple, float], rounds: int = 60) -> dict[tuple, float]:
    """The likelihood of each vote pattern, given how often each occurs, by labelers that err independently."""
    n = sum(histogram.values())
    if not n:
        return {}
    share = 0.5
    rates = {(j, v, y): {(1, 1): 0.7, (-1, 1): 0.1, (1, 0): 0.1, (-1, 0): 0.5}.get((v, y), 0.3) for j, v, y in product(range(N_VOTES), (-1, 0, 1), (0, 1))}
    likely: dict[tuple, float] = {}
    for _ in range(rounds):
        for votes in histogram:
            p = [(1 - share if y == 0 else share) * math.prod(rates[j, v, y] for j, v in enumerate(votes)) for y in (0, 1)]
            likely[votes] = p[1] / (p[0] + p[1])
        # a few made-up votes keep each rate off 0 and 1, and a labeler on the side it was made for
        share = min(0.98, max(0.02, (sum(c * likely[v] for v, c in histogram.items()) + 1) / (n + 2)))
        for j, y in product(range(N_VOTES), (0, 1)):
            weight = {v: 0.0 for v in (-1, 0, 1)}
            for votes, c in histogram.items():
                weight[votes[j]] += c * (likely[votes] if y else 1 - likely[votes])
            made_up = {1: 3.0 if y else 1.0, 0: 2.0, -1: 1.0 if y else 3.0}
            total = sum(weight.values()) + sum(made_up.values())
            for v in weight:
                rates[j, v, y] = (weight[v] + made_up[v]) / total
    return likely


def span_features(votes: tuple, form: int) -> list[float]:
    return [1.0, *(float(v == s) for v in votes for s in (1, -1)), *(float(form == f) for f in range(1, N_FORMS))]


def fit_classifier(rows: list[tuple[tuple, int, float, float]], rounds: int = 400, strength: float = 0.01) -> list[float]:
    """Logistic weights from (votes, form, count, likelihood), by gradient descent with a fixed step."""
    x = [span_features(votes, form) for votes, form, _, _ in rows]
    total = sum(c for _, _, c, _ in rows)
    w = [0.0] * (1 + 2 * N_VOTES + N_FORMS - 1)
    for _ in range(rounds):
        gradient = [strength * a for a in w]
        for f, (_, _, c, target) in zip(x, rows, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f, strict=True))))))
            for i, b in enumerate(f):
                gradient[i] += c / total * (p - target) * b
        w = [a - 1.5 * g for a, g in zip(w, gradient, strict=True)]
    return w


def train(found: DataFrame) -> dict[int, list[float]]:
    """A span classifier's weights for each kind that has candidates. found: what find() gives."""
    each = found.select(F.explode("_candidates").alias("c")).groupBy("c.kind", "c.votes", "c.form").count().collect()
    model = {}
    for kind in range(len(KINDS)):
        rows = [(tuple(r["votes"]), r["form"], float(r["count"])) for r in each if r["kind"] == kind]
        if rows:
            histogram: dict[tuple, float] = {}
            for votes, _, c in sorted(rows):
                histogram[votes] = histogram.get(votes, 0.0) + c
            likely = expectation_maximisation(histogram)
            model[kind] = fit_classifier([(v, f, c, likely[v]) for v, f, c in sorted(rows)])
    return model


def accepted(model: dict[int, list[float]]):
    """A predicate on candidates: the base, and those that the classifier takes."""
    taken = sorted(
        (kind, votes, form)
        for kind, w in model.items()
        for votes in product((-1, 0, 1), repeat=N_VOTES)
        for form in range(N_FORMS)
        if sum(a * b for a, b in zip(w, span_features(votes, form), strict=True)) >= math.log(THRESHOLD / (1 - THRESHOLD))
    )
    code = lambda kind, votes, form: (((kind * 3 + votes[0] + 1) * 3 + votes[1] + 1) * 3 + votes[2] + 1) * 12 + (votes[3] + 1) * 4 + form
    codes = F.array(*(F.lit(code(*t)) for t in taken)) if taken else F.array().cast("array<int>")
    return lambda c: c["base"] | F.array_contains(codes, code(c["kind"], [F.get(c["votes"], F.lit(j)) for j in range(N_VOTES)], c["form"]))


def spans(found: DataFrame, model: dict[int, list[float]], name: str = "spans") -> DataFrame:
    """found with a column of spans, array<struct<kind, start, end, base>> by kind and start, in place of _candidates."""
    kept = F.transform(F.filter("_candidates", accepted(model)), lambda c: F.struct(c["kind"], c["start"], c["end"], c["base"]))
    return found.withColumn(name, F.array_sort(kept)).drop("_candidates")


def personal_data(docs: DataFrame, name: str = "spans", without: tuple[str, ...] = ()) -> DataFrame:
    """docs (text and any other columns, but for those named) with a column of spans. Texts are searched once: what was
    found is kept as a table, to train on and to mark by."""
    found = kept(find(docs).drop(*without), "candidates")
    return spans(found, train(found), name)


def listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(found: Column, kind: str) -> Column:
    """How many spans are of a kind. A filter's function takes the span only: a second parameter, even one with a default
    value, would be the span's place in the array."""
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def masked(text: Column, found: Column) -> Column:
    """text with each span replaced by its kind in brackets; spans that overlap go as one, by the first one's kind."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_place = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def add(a: Column, s: Column) -> Column:
        more = F.struct((-s["less"]).alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))).alias("out"))
        return F.when(s["start"] >= a["at"], more).otherwise(F.struct(F.greatest(a["at"], -s["less"]).alias("at"), a["out"].alias("out")))

    cut = F.aggregate(by_place, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), add)
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text)))
    return F.when(F.size(found) == 0, text).otherwise(F.get(F.transform(F.array(cut), rest), F.lit(0)))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = personal_data(docs, without=("text",))
    base = F.filter("spans", lambda s: s["base"])
    n = [counted(base, kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *n, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
