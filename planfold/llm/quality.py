"""Quality rules by distribution divergence, in DataFrame and SQL functions only.

For each document, a histogram of character classes and one of common words are compared with references of each language by the
Jensen-Shannon distance (base 2, 0 to 1). The references are summed over all documents of a language that are long enough. A document
fails the method if even the nearest reference is further than a limit, and is long enough to be judged: short texts scatter widely,
so the guards keep them.

Base rules beside it (words are [^\\x20\\x09-\\x0D]+): fewer than 10 words, or over 20 % of the words in five-word windows that occur twice
or more in the text, fail.

Defined results: null text has no words; lang null or not in COMMON_WORDS takes part in no reference; where no reference exists the
method keeps. Rows are judged one by one, so ties and repeated rows don't matter. Extra columns are ignored by judged()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import table, written

#: The most frequent words of each language that references know.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
#: The classes a character is counted in; lower-case letters a-z are what is left.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:?'\"()-]", "mark": "[!#*$%&|<>=@^~_+{}\\\\[\\\\]/]", "wide": "[^\\x00-\\x7F]"}
MIN_WORDS, MIN_CHARS = 30, 150
#: Limits of the two distances. Texts without any common word are about 0.34 from the references in words. Texts of less than
#: STEADY_WORDS words scatter more: their limit rises evenly, by SHORT_WORDS at MIN_WORDS words.
MAX_CLASSES, MAX_WORDS = 0.27, 0.3
STEADY_WORDS, SHORT_WORDS = 60, 0.03
BASE_WORDS, BASE_REPEATS, WINDOW = 10, 20, 5

_BLANK = "[ \\t-\\r]"
_VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})


def _array(items: list[str]) -> str:
    return f"array({', '.join(items)})"


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """docs(doc_id, text, lang) -> counts and the two histograms (arrays of long) of each row."""
    t = docs.select("doc_id", "lang", *more, F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("w", F.expr(f"filter(split(t, r'{_BLANK}+', -1), x -> x <> '')"))
    t = t.withColumn("l", F.expr(f"filter(split(t, '\\n', -1), x -> x rlike r'[^ \\t-\\r]')"))
    t = t.withColumn("hw", F.expr("transform(w, x -> xxhash64(x))"))
    last = WINDOW - 1
    t = t.withColumn("win", F.expr(f"case when size(hw) >= {WINDOW} then transform(sequence(0, size(hw) - {WINDOW}), i -> xxhash64({', '.join(f'hw[i + {k}]' for k in range(WINDOW))})) else array() end"))
    # the windows found twice or more, by sorting (hash, place) only where there are any
    t = t.withColumn("by_hash", F.expr("case when size(array_distinct(win)) < size(win) then sort_array(transform(win, (h, i) -> struct(h, i))) end"))
    t = t.withColumn("places", F.expr("sort_array(transform(filter(transform(by_hash, (x, k) -> struct(x.h = get(by_hash, k - 1).h or x.h = get(by_hash, k + 1).h as again, x.i as i)), x -> x.again), x -> x.i))"))
    repeated = f"coalesce(aggregate(places, struct(0L as n, -{WINDOW} as at), (s, p) -> struct(s.n + least({WINDOW}, p - s.at) as n, p as at), s -> s.n), 0L)"
    t = t.withColumn("found", F.expr(f"regexp_extract_all(lower(t), r'(?<![^ \\t-\\r])({'|'.join(_VOCABULARY)})(?=[ \\t-\\r.,;:!?]|$)', 1)"))
    t = t.withColumn("chars", F.expr("length(t)")).withColumn("word_chars", F.expr("cast(length(array_join(w, '')) as long)"))
    for name, pattern in CLASSES.items():
        t = t.withColumn(f"c_{name}", F.size(F.regexp_extract_all("t", F.lit(pattern.replace("\\\\", "\\")), F.lit(0))))
    classes = _array([f"c_{n}" for n in CLASSES] + ["chars - word_chars", "word_chars - (" + " + ".join(f"c_{n}" for n in CLASSES) + ")"])
    words = _array([f"size(filter(found, x -> x = '{w}'))" for w in _VOCABULARY] + ["size(w) - size(found)"])
    n_symbols = F.size(F.regexp_extract_all("t", F.lit("[#*$%&|<>]"), F.lit(0))).cast("long")
    return t.select("doc_id", "lang", *more, "chars", F.size("w").cast("long").alias("n_words"), "word_chars", n_symbols.alias("n_symbols"), F.expr("cast(size(l) - size(array_distinct(l)) as long) as n_dup_lines"), F.expr(f"cast({repeated} as long) as n_repeat_words"), F.expr(f"transform({classes}, x -> cast(x as long)) as classes"), F.expr(f"transform({words}, x -> cast(x as long)) as words"))


def references(found: DataFrame) -> dict[str, dict[str, list[float]]]:
    """{histogram: {language: shares}}, summed over all long enough documents. At most as many rows as languages times bins."""
    long_ = found.where(F.col("lang").isin(*COMMON_WORDS) & (F.col("n_words") >= MIN_WORDS) & (F.col("chars") >= MIN_CHARS))
    out: dict[str, dict[str, list[float]]] = {}
    for name in ("classes", "words"):
        sums: dict[str, dict[int, int]] = {}
        for r in long_.select("lang", F.posexplode(name)).groupBy("lang", "pos").agg(F.sum("col").alias("n")).collect():
            sums.setdefault(r.lang, {})[r.pos] = r.n
        out[name] = {lang: [bins[k] / total for k in sorted(bins)] for lang, bins in sorted(sums.items()) if (total := sum(bins.values()))}
    return out


def jensen_shannon(counts: str, shares: list[float]) -> Column:
    """Distance of a histogram column from fixed shares; null for an empty histogram."""
    q = _array([f"{x!r}D" for x in shares])
    half = lambda x: f"case when {x} > 0 then 0.5D * {x} * log2(2 * {x} / (p + q)) else 0D end"
    total = f"aggregate({counts}, 0L, (s, x) -> s + x)"
    parts = f"zip_with(transform({counts}, x -> x / {total}), {q}, (p, q) -> {half('p')} + {half('q')})"
    return F.expr(f"case when {total} > 0 then sqrt(greatest(0D, aggregate({parts}, 0D, (s, x) -> s + x))) end")


def judged(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, counts, class_distance, word_distance, base_failed, kept."""
    found = written(measured(docs))
    refs = references(found)
    nearest = {name: F.array_min(F.array(*(jensen_shannon(name, shares) for shares in by.values()))) if by else F.lit(None).cast("double") for name, by in refs.items()}
    out = found.withColumn("class_distance", nearest["classes"]).withColumn("word_distance", nearest["words"])
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    judged_ = (F.col("n_words") >= MIN_WORDS) & (F.col("chars") >= MIN_CHARS)
    max_words = MAX_WORDS + SHORT_WORDS * F.greatest(F.lit(0), STEADY_WORDS - F.col("n_words")) / (STEADY_WORDS - MIN_WORDS)
    far = F.coalesce(F.col("class_distance") > MAX_CLASSES, F.lit(False)) | F.coalesce(F.col("word_distance") > max_words, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~(judged_ & far)).alias("kept"), "class_distance", "word_distance")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
