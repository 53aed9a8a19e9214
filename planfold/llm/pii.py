"""Personal data by weak supervision, in DataFrame and SQL functions only.

Wide patterns give candidate spans. Five labelers vote on each (1 for, -1 against, 0 abstains): the strict shape, a checksum or range
test, a gazetteer (domains, issuers, country codes, reserved networks, names of credentials), cue words just before, and the
characters on both sides. Expectation-maximisation over the counts of vote patterns, for each kind, estimates how often each labeler
votes which way on true and on false spans; its posteriors, as soft labels, train a logistic span classifier. Vote patterns number at
most kinds * 3**5, however large the corpus is: each step is one aggregate over that table.

Base spans (the contract's patterns, leftmost and non-overlapping for each kind) always stay; of the other candidates, those the
classifier accepts and that overlap no base span are added. Added kinds come after the base kinds: secret (credentials).

The patterns are written with possessive groups and starts at run boundaries: equal matches, but linear in the text's length and free
of deep recursion; a run of characters is taken whole, whatever its length. Matches become rows; places are running sums over the rows of one text, and what overlaps a base span is seen from
the largest end before it and the least start after it, so a text with very many spans takes no more than sorting them.

Defined results: null text counts as empty; no candidates at all: base spans only; rows are handled one by one (each gets a number of
its own), so rows that repeat, or have no doc_id, are reported and redacted each. Extra columns are ignored by found_spans(), kept by
redacted()."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planfold.llm.common import cut, table, written

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
ROUNDS, ACCEPT = 12, 0.5
#: Characters of the pieces in which texts are redacted.
PIECE = 4096
_LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> (SQL condition under which a text can hold one, pattern).
PATTERNS = {
    "email": ("instr(t, '@') > 0", rf"(?={_LOCAL})(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "email2": ("(instr(t, '(at)') > 0 or instr(t, '[at]') > 0)", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?:(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]++)++"),
    "ip": ("digits", r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("digits", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("instr(t, '+') > 0", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "phone2": ("digits", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "secret": ("(instr(t, '=') > 0 or instr(t, ':') > 0)", r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key) {0,3}[=:] {0,3}\"?[a-z0-9+/_.-]{6,}+\"?"),
}
#: Gazetteers and cue words (as alternatives of patterns).
DOMAINS = "com|net|org|edu|gov|info|io|eu|de|fr|es|it|uk|us|ch|at|be|nl"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35"
COUNTRIES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
RESERVED = "0|10|127|169\\.254|192\\.168|172\\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9]"
CUES = {
    "email": "mail|courriel|correo|contact|write|from",
    "ip": "ip|addr|host|server|from|login",
    "card": "card|visa|pay|karte|carte|tarjeta|credit",
    "phone": "phone|tel|call|mobile|fax|anruf|appel",
    "secret": "login|user|auth|key|credential",
}
COUNTER_CUES = "version|v\\.|isbn|order|invoice|page|section|build"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: Luhn: from the right, every second digit doubled, less 9 where that passes 9.
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> case when i % 2 = 0 then cast(c as int) else cast(c as int) * 2 - case when c > '4' then 9 else 0 end end), 0, (a, x) -> a + x) % 10 = 0"
#: kind -> base test of a match m.
VALID = {
    "email": "true",
    "ip": f"m rlike r'^{_PART}(?:\\.{_PART}){{3}}$'",
    "card": f"case when length({_DIGITS}) between 12 and 19 then {_LUHN} else false end",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "secret": "false",
}


def _matches(name: str, number: int) -> str:
    """SQL: array of the matches of a pattern, each with the text between it and the match before (its length and end) and the start of
    what follows."""
    one = f"struct({number} as p, i as i, length(get(g_{name}, i)) as gap, m as m, right(get(g_{name}, i), 40) as before, left(get(g_{name}, i + 1), 2) as after)"
    return f"transform(m_{name}, (m, i) -> {one})"


def _votes(kind: str) -> dict[str, str]:
    """SQL of the five votes on a match with columns m, before, after."""
    sign = lambda yes, no: f"case when {yes} then 1 when {no} then -1 else 0 end"
    shape = {
        "email": sign(r"m rlike r'^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$'", r"m rlike r'\.[0-9]+$'"),
        "ip": sign(r"m rlike r'^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$'", "length(m) > 15"),
        "card": sign(r"m rlike r'^(?:[0-9]{13,16}|(?:[0-9]{4}[ -]){3}[0-9]{1,4})$'", f"length({_DIGITS}) not between 12 and 19"),
        "phone": sign(r"m rlike r'^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{2,4}[ .-]?[0-9]{2,4}'", f"length({_DIGITS}) > 15"),
        "secret": sign("m rlike r'[0-9]' and m rlike r'[=:].*[A-Za-z]'", "m rlike r'[=:] *[A-Za-z]+$'"),
    }
    test = {
        "email": sign("not m rlike r'[.]{2}|^[.]|[.]@'", "length(m) > 254"),
        "ip": sign(VALID["ip"], "true"),
        "card": sign(VALID["card"], "true"),
        "phone": sign(f"length({_DIGITS}) between 9 and 15", "true"),
        "secret": sign("length(regexp_replace(m, '^[^=:]*[=:]', '')) >= 12", "length(m) < 14"),
    }
    known = {
        "email": sign(rf"m rlike r'(?i)[.) ](?:{DOMAINS})$'", r"m rlike r'(?i)\.(?:png|jpg|gif|js|css)$'"),
        "ip": sign(f"not m rlike r'^(?:{RESERVED})\\.'", "true"),
        "card": sign(f"m rlike r'^(?:{ISSUERS})'", "true"),
        "phone": sign(rf"m rlike r'^\+(?:{COUNTRIES})' or m rlike r'^\(?[2-9]'", "true"),
        "secret": sign("m rlike r'(?i)^(?:password|passwd|token|secret)'", "false"),
    }
    cue = sign(f"before rlike r'(?i)(?:{CUES[kind]})[^A-Za-z]{{0,6}}$'", f"before rlike r'(?i)(?:{COUNTER_CUES})[^A-Za-z]{{0,3}}$'")
    edge = sign("before rlike r'(?:^|[\\s(<\\[:,;])$' and after rlike r'^(?:$|[\\s)>\\].,;:!?])'", "before rlike r'[A-Za-z0-9_]$' or after rlike r'^[A-Za-z0-9_]'")
    return {"v_shape": shape[kind], "v_test": test[kind], "v_known": known[kind], "v_cue": cue, "v_edge": edge}


VOTES = ["v_shape", "v_test", "v_known", "v_cue", "v_edge"]


def _by_kind(sql: dict[str, str]) -> Column:
    """A column of k from SQL for each kind."""
    return F.expr(f"case {' '.join(f'when k = {KINDS.index(kind)} then ({said})' for kind, said in sql.items())} end")


def matched(docs: DataFrame, *more: str) -> DataFrame:
    """docs(text) -> row (a number of its own), found: array of all matches of all patterns."""
    t = docs.select(*more, F.coalesce("text", F.lit("")).alias("t")).withColumn("digits", F.expr("t rlike '[0-9]'"))
    for name, (when, pattern) in PATTERNS.items():
        t = t.withColumn(f"m_{name}", F.expr(f"case when {when} then regexp_extract_all(t, r'{pattern}', 0) else array() end"))
        t = t.withColumn(f"g_{name}", F.expr(f"case when size(m_{name}) > 0 then split(t, r'{pattern}', -1) else array() end"))
    found = ", ".join(_matches(name, i) for i, name in enumerate(PATTERNS))
    return written(t.select(*more, F.expr(f"concat({found})").alias("found")).withColumn("row", F.monotonically_increasing_id()))


def candidates(found: DataFrame) -> DataFrame:
    """matched() -> a row for each candidate: row, s, e, k (place in KINDS), base, votes, alone (overlaps no base span)."""
    kinds = F.array(*(F.lit(KINDS.index(name.rstrip("2"))) for name in PATTERNS))
    m = found.where("size(found) > 0").select("row", F.inline("found")).repartition("row")
    upto = F.sum(F.col("gap") + F.length("m")).over(Window.partitionBy("row", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("e", upto.cast("int")).withColumn("s", F.col("e") - F.length("m")).withColumn("k", kinds[F.col("p")])
    votes = {kind: _votes(kind) for kind in KINDS}
    base = F.col("p").isin([i for i, name in enumerate(PATTERNS) if name in BASE]) & _by_kind(VALID)
    m = m.withColumn("base", base).select("row", "s", "e", "k", "base", *(_by_kind({kind: votes[kind][v] for kind in KINDS}).alias(v) for v in VOTES))
    by_place = Window.partitionBy("row").orderBy("s", "k", "e")
    before = F.max(F.when(F.col("base"), F.col("e"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    # the least start behind: the same window, read backwards
    behind = F.min(F.when(F.col("base"), F.col("s"))).over(Window.partitionBy("row").orderBy(F.desc("s"), F.desc("k"), F.desc("e")).rowsBetween(Window.unboundedPreceding, -1))
    alone = (F.coalesce(before, F.lit(0)) <= F.col("s")) & F.coalesce(behind >= F.col("e"), F.lit(True))
    # what the base rules drop is no candidate for the same kind again, but for secrets and the wider patterns
    return m.withColumn("alone", alone).where("base or k = 4 or (v_test = 1 and alone)")


def _literal(x: float) -> str:
    return f"{x!r}D"


def estimated(patterns: DataFrame, rounds: int = ROUNDS) -> dict[tuple[int, str, int], float]:
    """patterns(k, votes, n) -> {(kind, vote column, vote): log odds that the vote gives}, with (kind, '', 0) the prior's, by
    expectation-maximisation of a naive Bayes mixture with smoothing. It starts from the majority of votes."""
    posterior = "1 / (1 + exp(-(" + " + ".join(f"1.5D * {v}" for v in VOTES) + ")))"
    odds: dict[tuple[int, str, int], float] = {}
    for _ in range(rounds):
        sums = [F.expr(f"sum(n * p) as yes"), F.expr("sum(n * (1 - p)) as no")]
        for v in VOTES:
            for value in (-1, 0, 1):
                sums += [F.expr(f"sum(case when {v} = {value} then n * p else 0 end) as yes_{v}_{value + 1}"), F.expr(f"sum(case when {v} = {value} then n * (1 - p) else 0 end) as no_{v}_{value + 1}")]
        rows = patterns.withColumn("p", F.expr(posterior)).groupBy("k").agg(*sums).collect()
        odds = {}
        for r in rows:
            odds[r.k, "", 0] = math.log((r.yes + 1) / (r.no + 1))
            for v in VOTES:
                for value in (-1, 0, 1):
                    yes, no = (r[f"{side}_{v}_{value + 1}"] for side in ("yes", "no"))
                    # a vote can only count in its own direction: keeps the latent classes from changing places
                    said = math.log((yes + 1) / (r.yes + 3)) - math.log((no + 1) / (r.no + 3))
                    odds[r.k, v, value] = max(said, 0.0) if value > 0 else min(said, 0.0) if value < 0 else 0.0
        terms = [f"case {' '.join(f'when k = {k} and {v} = {x} then {_literal(o)}' for (k, name, x), o in odds.items() if name == v)} else 0D end" for v in VOTES]
        prior = f"case {' '.join(f'when k = {k} then {_literal(o)}' for (k, name, _x), o in odds.items() if not name)} else 0D end"
        posterior = f"1 / (1 + exp(-greatest(-30D, least(30D, {prior} + {' + '.join(terms)}))))"
    return odds | {(-1, posterior, 0): 0.0}


def classifier(patterns: DataFrame, posterior: str) -> str:
    """SQL of the span classifier's probability over k and the votes: logistic regression on the posteriors as soft labels."""
    names = [f"f{i}" for i in range(len(KINDS) + 2 * len(VOTES))]
    feature_sql = [f"cast(k = {i} as double)" for i in range(len(KINDS))] + [f"cast({v} = {x} as double)" for v in VOTES for x in (1, -1)]
    rows = patterns.withColumn("p", F.expr(posterior)).selectExpr(*(f"{s} as {n}" for s, n in zip(feature_sql, names, strict=True)), "explode(array(struct(1D as label, n * p as weight), struct(0D as label, n * (1 - p) as weight))) as y")
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows.select(*names, "y.*").where("weight > 1e-9"))
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=30, standardization=False).fit(rows)
    if model.numClasses < 2:
        return posterior
    terms = " + ".join(f"{_literal(float(c))} * {s}" for c, s in zip(model.coefficients, feature_sql, strict=True))
    return f"1 / (1 + exp(-({_literal(float(model.intercept))} + {terms})))"


def accepted_spans(found: DataFrame) -> DataFrame:
    """matched() -> row, s, k, e, base: the base spans, and those that the classifier accepts and that overlap none of them."""
    spans = written(candidates(found))
    patterns = cut(spans.groupBy("k", *VOTES).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    accepted = "false"
    if not patterns.isEmpty():
        posterior = next(name for (k, name, _), _o in estimated(patterns).items() if k == -1)
        accepted = f"{classifier(patterns, posterior)} >= {ACCEPT}"
    return spans.where(f"base or (alone and {accepted})").select("row", "s", "k", "e", "base")


def found_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base and spans: arrays of (s, k, e), k the place in KINDS, by s then k."""
    found = matched(docs, "doc_id")
    span = F.struct("s", "k", "e")
    by_row = accepted_spans(found).groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<s: int, k: int, e: int>>")
    return found.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by <kind>; spans that overlap are one, under the kind of the first.

    Texts with spans are cut into pieces of PIECE characters, so that each replacement touches one piece or a few, and joined again."""
    rows = matched(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text"), "doc")  # numbered and written once; all else refers to them
    spans = accepted_spans(rows)
    by_place = Window.partitionBy("row").orderBy("s", "k", "e")
    starts = F.col("s") >= F.coalesce(F.max("e").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    region = spans.withColumn("starts", starts.cast("int")).withColumn("region", F.sum("starts").over(by_place)).groupBy("row", "region").agg(F.min(F.struct("s", "k")).alias("first"), F.max("e").alias("e"))
    parts = region.select("row", F.col("first.s").alias("s"), "e", F.col("first.k").alias("k")).select("*", F.explode(F.sequence(F.expr(f"s div {PIECE}"), F.expr(f"(e - 1) div {PIECE}"))).alias("c"))
    name = F.element_at(F.array(*(F.lit(f"<{k}>") for k in KINDS)), F.col("k") + 1)
    parts = parts.select("row", F.col("c").cast("int").alias("c"), F.struct(F.expr(f"cast(greatest(s - c * {PIECE}, 0) as int) as a"), F.expr(f"cast(least(e - c * {PIECE}, {PIECE}) as int) as b"), F.when(F.expr(f"s div {PIECE} = c"), name).otherwise("").alias("name")).alias("part"))
    parts = parts.groupBy("row", "c").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    pieces = rows.join(spans.select("row").distinct(), "row", "left_semi").select("row", F.posexplode(F.regexp_extract_all("doc.text", F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))).alias("c", "piece"))
    said = "concat(array_join(transform(parts, (x, i) -> concat(substring(piece, coalesce(get(parts, i - 1).b, 0) + 1, x.a - coalesce(get(parts, i - 1).b, 0)), x.name)), ''), substring(piece, element_at(parts, -1).b + 1))"
    pieces = pieces.join(parts, ["row", "c"], "left").select("row", F.struct("c", F.expr(f"case when parts is null then piece else {said} end").alias("said")).alias("x"))
    new = pieces.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["said"]), "").alias("_new"))
    out = rows.drop("found").join(new, "row", "left")
    return out.select(*(F.coalesce("_new", "doc.text").alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_spans(table(spark, sf_dir, "documents"))
    kinds = f"array({', '.join(repr(k) for k in KINDS)})"
    said = lambda a: F.expr(f"array_join(transform({a}, x -> concat({kinds}[x.k], ':', x.s, ':', x.e)), ',')")
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("found"))
