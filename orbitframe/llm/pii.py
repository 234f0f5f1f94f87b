"""Personal data by weak supervision, with DataFrame functions only.

Base patterns give spans that always stay. Further candidates come from looser patterns (written-out e-mail
addresses, numbers that look like phones or cards, titled names, assigned secrets). On every candidate,
labelers vote for, against or not at all: the strict pattern check, a gazetteer, words before it, words that
speak against it, and its shape. Expectation-maximisation over the counts of vote patterns (a bounded table,
whatever the corpus) estimates each labeler's reliability; the posteriors train a logistic span classifier
over discrete features, which decides on the candidates that are not base spans.

One pass reads the text with the patterns and writes the candidates; training and scoring read those. Nothing is
shuffled but counts; spans are built inside each row, so a row with many spans or a common text is no hot key, and
offsets come from sums in chunks, so that a long text with very many spans stays nearly linear.

Defined cases: null and empty texts have no spans; offsets are code points; repeated rows are treated alike; spans
and their parts may have any length; an empty table gives an empty result and an untrained classifier, which adds
nothing; other columns stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.settings import scratch, written

KINDS = ("email", "ip", "card", "phone", "name", "secret")
BASE = ("email", "ip", "card", "phone")
VOTERS = ("strict", "gazetteer", "before", "against", "shape")

# The stated patterns, written so that Java's matcher runs in linear time and without recursion: a match
# can only begin where the run of its first class begins, or where the match before it ended. Runs of
# digits that can't be cards are no matches at all, which drops the same ones.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9])++",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[a-z0-9-]++(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[a-z0-9-]++)++",
    "card": PATTERNS["card"],
    "phone": r"(?<![0-9+.)(-])(?<![0-9] )(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])(?![ .-][0-9])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Sra?|Mme|Monsieur|Madame|Señora?)\.? \p{Lu}[\p{Ll}']++(?: \p{Lu}[\p{Ll}']++)?|(?<=\b(?:name is|my name|signed|contact|dear|named|called) )\p{Lu}[\p{Ll}']++ \p{Lu}[\p{Ll}']++",
    "secret": r"(?i)\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)\b ?[=:] ?[\"']?[a-z0-9+/_=-]{16,}+[\"']?",
}
NEEDS = {"email": "@", "phone": "+"}
# Fixed word lists of the labelers.
BEFORE = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|server|host|address|adresse|dirección",
    "card": "card|karte|tarjeta|carte|visa|mastercard|payment|zahlung|pago",
    "phone": "phone|call|tel|mobile|fax|telefon|handy|teléfono|téléphone",
    "name": "name|contact|dear|from|von|de la part",
    "secret": "key|token|secret|password|credential",
}
AGAINST = "version|license|isbn|chapter|section|page|article|figure|table|order|invoice|§|#"
# Fixed gazetteers, plain lists.
GIVEN = (
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen "
    "anna peter hans klaus ursula monika wolfgang sabine jürgen heike stefan petra jean marie pierre michel nathalie isabelle françois sophie "
    "josé maría juan carmen antonio ana manuel lucía carlos elena alice bob carol dave eve frank grace heidi"
).split()
FAMILY = (
    "smith johnson williams brown jones miller davis wilson moore taylor anderson jackson white harris martin thompson clark lewis walker hall "
    "müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann dupont durand leroy moreau laurent bernard petit roux "
    "garcía martínez lópez sánchez pérez gómez fernández díaz ruiz torres"
).split()
DOMAINS = "com org net edu gov mil info biz io co me eu uk de fr es it nl ch at be se no dk fi pl pt cz ru ua us ca br mx ar in cn jp kr au nz za test example invalid".split()
ISSUERS = r"(?:4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|65|62|67|63|50|56|57|58)"  # first digits that card networks use
COUNTRY_CODES = r"(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9])"
KEY_WORDS = "sk pk ghp gho xox xoxb akia asia aiza eyj glpat npm pypi hf bearer basic"
GAZETTEER = {
    "email": rf"(?i).*(?:\.|dot ?[\])] ?)(?:{'|'.join(DOMAINS)})",
    "ip": r"(?:10|127|172|192|[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\..*",
    "card": rf"{ISSUERS}.*",
    "phone": rf"\+ ?{COUNTRY_CODES}.*|[ (]*0[1-9].*",
    "name": rf"(?i).*(?<!\p{{L}})(?:{'|'.join(GIVEN + FAMILY)})(?!\p{{L}}).*",
    "secret": rf"(?i).*[=: \"'](?:{KEY_WORDS.replace(' ', '|')})[-_a-z0-9].*",
}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column, chunk: int = 64) -> Column:
    """For each element what the ones before it come to under an associative op. Whole chunks are taken at a time."""
    total = lambda part: F.aggregate(part, zero, op)
    at = lambda i: F.floor(i / chunk).cast("int")

    def within(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), at(F.size(v))), lambda c: total(F.slice(v, c * chunk + 1, F.lit(chunk))))
        sums = bind(chunks, lambda cs: F.transform(cs, lambda _, c: total(F.slice(cs, F.lit(1), c))))
        return bind(sums, lambda before: F.transform(v, lambda _, i: op(F.get(before, at(i)), total(F.slice(v, at(i) * chunk + 1, i % chunk)))))

    return bind(values, within)


def sums_before(lengths: Column) -> Column:
    return running(lengths, lambda a, x: a + x, F.lit(0))


SPANS = "array<struct<kind:string,start:int,end:int,text:string,left:string>>"


def matches(text: Column, pattern: str, kind: str, when: Column) -> Column:
    """array<struct<kind, start, end, text, left>> of all matches of a pattern, left to right. left: up to 40 characters before it."""
    p = F.lit(pattern)
    found = bind(
        F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")),
        lambda s: bind(
            F.struct(s["m"].alias("m"), s["p"].alias("p"), sums_before(F.transform(s["m"], lambda m, i: F.length(m) + F.length(F.get(s["p"], i)))).alias("before")),
            lambda r: F.transform(
                r["m"],
                lambda m, i: bind(
                    F.get(r["before"], i) + F.length(F.get(r["p"], i)),
                    lambda at: F.struct(
                        F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(m)).alias("end"), m.alias("text"),
                        F.lower(F.right(F.concat(F.coalesce(F.get(r["m"], i - 1), F.lit("")), F.get(r["p"], i)), F.lit(40))).alias("left"),
                    ),
                ),
            ),
        ),
    )
    return F.when(when, found).otherwise(F.array().cast(SPANS))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(number) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def strict(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(m, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"))
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & bind(digits(m), luhn)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def passes(kind: str) -> Callable[[Column], Column]:
    return lambda s: strict(kind, s["text"])


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind as listed, then start."""
    parts = []
    for kind in BASE:
        when = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.regexp_like(text, F.lit("[0-9]"))
        parts.append(F.filter(matches(text, PATTERNS[kind], kind, when), passes(kind)))
    return F.concat(*parts)


def candidate_spans(text: Column) -> Column:
    return F.concat(*(matches(text, p, kind, F.regexp_like(text, F.lit(p))) for kind, p in LOOSE.items()))


def _lookup(table: dict[str, str], kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), kind)


def votes(s: Column) -> list[Column]:
    """1 for, -1 against, 0 no vote; in the order of VOTERS."""
    kind, text, left = s["kind"], s["text"], s["left"]
    n = F.length(digits(text))
    ok = F.when(kind == "card", strict("card", text)).when(kind == "phone", F.regexp_like(text, F.lit(r"^\+")) & strict("phone", text)).when(kind == "ip", strict("ip", text)).when(kind == "email", F.contains(text, F.lit("@")))
    shape = F.when(kind == "phone", n.between(9, 12)).when(kind == "card", n == 16).when(kind == "secret", F.regexp_like(text, F.lit("[0-9]"))).when(kind == "email", F.length(text) < 80)
    sign = lambda c: F.when(c, 1).when(~c, -1).otherwise(0)
    return [
        sign(ok),
        # a name that the gazetteer doesn't have may be one all the same
        F.when(F.regexp_like(text, F.concat(F.lit("^(?:"), _lookup(GAZETTEER, kind), F.lit(")$"))), 1).when(kind.isin("name", "secret"), 0).otherwise(-1),
        F.when(F.regexp_like(left, F.concat(F.lit(r"\b(?:"), _lookup(BEFORE, kind), F.lit(")"))), 1).otherwise(0),
        F.when(F.regexp_like(left, F.lit(rf"(?:{AGAINST})[^a-z]*$")), -1).otherwise(0),
        sign(shape),
    ]


def features(s: Column) -> list[Column]:
    """Discrete features of the final classifier, each with a handful of values."""
    n = F.length(digits(s["text"]))
    tail = F.substring(s["left"], -1, 1)
    return [
        s["kind"],
        F.concat(s["kind"], F.lit("/digits"), F.least(F.floor(n / 4), F.lit(5)).cast("string")),
        F.concat(s["kind"], F.lit("/separated"), F.regexp_like(s["text"], F.lit("[ .-]")).cast("string")),
        F.concat(F.lit("after/"), F.when(F.regexp_like(tail, F.lit(r"\p{L}")), "letter").when(F.regexp_like(tail, F.lit(r"\s")), "space").when(F.length(tail) == 0, "start").otherwise("other")),
        F.concat(F.lit("words/"), s["kind"], F.regexp_like(s["left"], F.concat(F.lit(r"\b(?:"), _lookup(BEFORE, s["kind"]), F.lit(")"))).cast("string")),
        F.concat(F.lit("against/"), F.regexp_like(s["left"], F.lit(rf"(?:{AGAINST})[^a-z]*$")).cast("string")),
        F.concat(s["kind"], F.lit("/strict"), votes(s)[0].cast("string")),
    ]


@dataclass
class Classifier:
    """Weights by feature value; reliabilities[voter][label][vote + 1] are the estimated vote probabilities."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -10.0
    reliabilities: list[list[list[float]]] = field(default_factory=list)

    def score(self, s: Column) -> Column:
        if not self.weights:
            return F.lit(0.0)
        table = F.create_map(*(F.lit(x) for kv in self.weights.items() for x in kv))
        z = F.lit(self.bias)
        for f in features(s):
            z = z + F.coalesce(F.element_at(table, f), F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def estimate(patterns: list[tuple[tuple[int, ...], str, float]], rounds: int = 60) -> tuple[list[float], list[list[list[float]]]]:
    """Expectation-maximisation over (votes, kind, count): posterior of each pattern, and the voters' reliabilities."""
    post = []
    for v, _, _ in patterns:
        post.append(1 / (1 + math.exp(-1.5 * sum(v))))
    rel: list[list[list[float]]] = []
    for _ in range(rounds):
        rel = []
        for j in range(len(VOTERS)):
            # A labeler that doesn't vote says nothing. Labelers are taken to be right more often than not: the prior is four votes.
            by = [[2.5, 0.0, 1.5], [1.5, 0.0, 2.5]]
            for (v, _, n), p in zip(patterns, post, strict=True):
                if v[j]:
                    by[1][v[j] + 1] += n * p
                    by[0][v[j] + 1] += n * (1 - p)
            rel.append([[x / sum(row) for x in row] for row in by])
        prior: dict[str, list[float]] = {}
        for (_, kind, n), p in zip(patterns, post, strict=True):
            a = prior.setdefault(kind, [1.0, 1.0])
            a[1] += n * p
            a[0] += n * (1 - p)
        new = []
        for v, kind, _ in patterns:
            z = math.log(prior[kind][1] / prior[kind][0]) + sum(math.log(rel[j][1][x + 1] / rel[j][0][x + 1]) for j, x in enumerate(v) if x)
            new.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        moved = max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0.0)
        post = new
        if moved < 1e-9:
            break
    return post, rel


def logistic(rows: list[tuple[tuple[str, ...], float, float]], steps: int = 300, rate: float = 2.0, decay: float = 1e-3) -> tuple[dict[str, float], float]:
    """Weights of discrete features from (features, soft label, count), by full-batch gradient steps."""
    total = sum(n for _, _, n in rows)
    weights = {f: 0.0 for fs, _, _ in rows for f in fs}
    bias = 0.0
    for _ in range(steps):
        grad, gb = dict.fromkeys(weights, 0.0), 0.0
        for fs, y, n in rows:
            z = bias + sum(weights[f] for f in fs)
            e = (1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - y) * n / total
            gb += e
            for f in fs:
                grad[f] += e
        bias -= rate * gb
        for f in weights:
            weights[f] -= rate * (grad[f] + decay * weights[f])
    return weights, bias


def candidates(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (these columns of docs), base, more: what the patterns find, written to the shared store."""
    text = F.col("body")
    found = docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in columns)).alias("row"), F.col("text").alias("body"))
    found = found.withColumn("base", F.coalesce(base_spans(text), F.array().cast(SPANS))).withColumn("more", F.coalesce(candidate_spans(text), F.array().cast(SPANS)))
    return written(found.drop("body"), scratch(docs.sparkSession, "pii"))


def train(found: DataFrame) -> Classifier:
    """Counts over all candidates of all rows; what reaches the driver is bounded by the votes' and features' domains."""
    s = F.col("s")
    spans = found.select(F.explode(F.concat("base", "more")).alias("s"))
    counted = spans.select(F.array(*votes(s)).alias("v"), F.array(*features(s)).alias("f")).groupBy("v", "f").count().collect()
    if not counted:
        return Classifier()
    counted.sort(key=lambda r: (r["v"], r["f"]))
    by: dict[tuple, float] = {}
    for r in counted:
        key = (tuple(r["v"]), r["f"][0])
        by[key] = by.get(key, 0.0) + r["count"]
    patterns = [(v, kind, n) for (v, kind), n in by.items()]
    post, rel = estimate(patterns)
    label = {(v, kind): p for (v, kind, _), p in zip(patterns, post, strict=True)}
    weights, bias = logistic([(tuple(r["f"]), label[tuple(r["v"]), r["f"][0]], float(r["count"])) for r in counted])
    return Classifier(weights, bias, rel)


def apart(base: Column, more: Column) -> Column:
    """Those of more that overlap none of base. All are sorted by start; a span is held against the furthest end before it and the next start after it."""
    far = F.lit(1 << 30)
    tagged = F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("at"), F.lit(0).alias("new"), s.alias("s"))), F.transform(more, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("new"), s.alias("s"))))

    def kept(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda x: F.when(x["new"] == 0, x["s"]["end"]).otherwise(F.lit(0))), lambda a, x: F.greatest(a, x), F.lit(0))
        starts = F.reverse(running(F.reverse(F.transform(all_, lambda x: F.when(x["new"] == 0, x["at"]).otherwise(far))), lambda a, x: F.least(a, x), far))
        both = F.transform(F.arrays_zip(all_.alias("x"), ends.alias("e"), starts.alias("n")), lambda z: z)
        return F.transform(F.filter(both, lambda z: (z["x"]["new"] == 1) & (z["e"] <= z["x"]["at"]) & (z["n"] >= z["x"]["s"]["end"])), lambda z: z["x"]["s"])

    return F.when(F.size(more) == 0, more).otherwise(bind(F.array_sort(tagged), kept))


def with_spans(docs: DataFrame, columns: list[str], classifier: Classifier | None = None, threshold: float = 0.5) -> DataFrame:
    """row (these columns of docs), ``base`` and ``spans``: arrays of structs (kind, start, end, text, left)."""
    found = candidates(docs, columns)
    classifier = classifier or train(found)
    sure = F.filter("more", lambda s: classifier.score(s) >= threshold)
    both = bind(sure, lambda more: F.concat("base", apart(F.col("base"), more)))
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    keyed = F.array_sort(F.transform(both, lambda s: F.struct(F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s.alias("s"))))
    return found.select("row", "base", F.transform(keyed, lambda x: x["s"]).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans per document."""
    found = with_spans(docs, ["doc_id"])
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("row.doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def cutter(text: Column, segment: int = 4096) -> tuple[Column, Callable[[Column, Column, Column], Column]]:
    """(segments of a text, a function of them that cuts code points a..b-1 out without walking the text from its start)."""
    segments = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / segment).cast("int")), lambda c: F.substring(text, c * segment + 1, F.lit(segment)))

    def cut(held: Column, a: Column, b: Column) -> Column:
        at = F.floor(a / segment).cast("int")
        near = F.array_join(F.slice(held, at + 1, F.floor(b / segment).cast("int") - at + 1), "")
        return F.when(b > a, F.substring(near, a - at * segment + 1, b - a)).otherwise(F.lit(""))

    return segments, cut


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans count as one, named after the first."""
    found = with_spans(docs, docs.columns)
    whole = F.col("row.text")
    segments, cut = cutter(whole)
    in_order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def put_together(x: Column) -> Column:
        """x: spans in order, for each the furthest end before it, and the segments of the text."""

        def part(s: Column, i: Column) -> Column:
            reached = F.get(x["reached"], i)
            return F.when(s["start"] < reached, F.lit("")).otherwise(F.concat(cut(x["held"], reached, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))

        tail = cut(x["held"], F.array_max(F.transform(x["s"], lambda s: s["end"])), F.length(whole))
        return F.array_join(F.concat(F.transform(x["s"], part), F.array(tail)), "")

    ends = lambda s: running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
    new = bind(in_order, lambda s: bind(F.struct(s.alias("s"), ends(s).alias("reached"), segments.alias("held")), put_together))
    done = found.select("row", F.when(F.size("spans") > 0, new).otherwise(whole).alias("text"))
    own = lambda c: F.col("row").getField(c).alias(c)
    return done.select(*[F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else own(c) for c in docs.columns])
