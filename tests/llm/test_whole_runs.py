"""Spans taken whole whatever their length, toxicity from rare labels, and pages where importance alone finds the article."""

import random
import re
from html import unescape

import pytest

from planfold.llm import html_text, pii, toxicity


@pytest.mark.parametrize(
    "text,left",
    [
        ("login password=" + "aB3x" * 25_000 + " end", ["aB3x", "password"]),
        ("auth token: " + "k9" * 300 + "\n", ["k9"]),
        ("write to bob (at) mail.co.a.b.c.example.com today", ["bob", "example", ".a.b"]),
        ("write to " + "n" * 70 + " (at) host.example.org today", ["nnn", "host"]),
        ("contact: " + "q" * 5000 + "@" + "sub." * 50 + "example.com.", ["qqq", "sub."]),
        ("mail me: jo [at] a [dot] b [dot] c [dot] d [dot] e [dot] f [dot] example [dot] com", ["[dot]", "example"]),
    ],
)
def test_nothing_of_a_span_stays(spark, text, left):
    clean = [(i, f"plain words without anything {i}") for i in range(3)]
    known = [(10 + i, f"mail bob{i}@example.com, password=abc{i}Def12345, write to amy{i} (at) host{i}.example.org now") for i in range(40)]
    docs = spark.createDataFrame([(1000, text), *clean, *known], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert all(part not in got[1000] for part in left), got[1000][:200]
    assert all(got[i] == t for i, t in clean)


def toxic_docs(n, every):
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    bad = ["grobvil", "dulmash", "skritch", "plonkfer"]
    return [(i, " ".join(r.choices(words, k=40) + (r.choices(bad, k=8) if i % every == 0 else [])), int(i % every == 0)) for i in range(n)]


def test_rare_labels_and_labels_without_documents(spark):
    """Of 6,000 labels 60 are toxic, and nine in ten of all labels have no document: the bound of 1,000 rows must still hold enough of them."""
    rows = toxic_docs(6000, 100)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(10_000_000 + i, 0) for i in range(54_000)], "doc_id long, toxic int")
    sample = toxicity.labelled(docs, labels, 1000).collect()
    assert len(sample) == 1000 and all(r.doc_id < 6000 for r in sample)
    n = {x: sum(r.toxic == x for r in sample) for x in (0, 1)}
    weight = {x: sum(r.weight for r in sample if r.toxic == x) for x in (0, 1)}
    assert n[1] > 30 and abs(weight[1] - n[1]) < 1e-6 and weight[0] > 4000
    truth = {i: x for i, _, x in rows}
    got = toxicity.scored(docs, labels, 1000).collect()
    said = [r for r in got if r.held_out]
    caught = sum(r.predicted for r in said if truth[r.doc_id])
    assert caught >= 0.9 * sum(truth[r.doc_id] for r in said)
    assert sum(r.predicted for r in said if not truth[r.doc_id]) <= 0.01 * len(said)


def test_labels_without_any_document(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(50)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.scored(docs, labels).collect()] == [(0.0, 0)] * 3


def plain_article(html):
    """The article by its tag alone, for pages of one kind: comments and markup taken away, references decoded."""
    inner = re.search(r"(?s)<article[^>]*>(.*)</article>", html)[1]
    inner = re.sub(r"(?s)<!--.*?-->|<(script|style|form|aside|nav)\b.*?</\1>", " ", inner)
    inner = re.sub(r"</?(?:b|i|em|strong|a|span|u|small|code|mark|sub|sup)\b[^>]*>", "", inner)
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_importance_alone_finds_the_article(spark, sf):
    """Tags and names off: only what browsers never show weighs nothing. Of 250 pages the branch with the importance is the article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = {}
    for r in html_text.decisive_paths(pages).collect():
        weights.setdefault(r.host, {})[r.path] = r.weight
    unseen = frozenset("script style template noscript svg head title".split())
    rows, right = pages.collect(), 0
    for r in rows:
        root, _ = html_text.content_root(html_text.parsed(r.html), weights.get(html_text.host_of(r.url), {}), lambda x: x.tag in unseen)
        right += html_text._text(root, lambda x: x.tag in unseen) == plain_article(r.html)
    assert right / len(rows) > 0.9
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert all(got[r.page_id] == plain_article(r.html) for r in rows)


def test_importance_overrules_a_tag(spark):
    """Every page shows the same teaser in an <article>; its own story stands in a branch without a name."""
    page = "<body><div><article><h2>Offer of the week</h2><p>The same offer on all pages of this site</p></article></div><div><div><h1>Story {i}</h1><p>{text}</p><p>More of {i}</p></div></div></body>"
    r = random.Random(3)
    rows = [(i, f"http://h.example/{i}", page.format(i=i, text=" ".join(f"w{r.randrange(10**6)}" for _ in range(20)))) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html_text.BROADCAST_PATHS, -1):
        before, html_text.BROADCAST_PATHS = html_text.BROADCAST_PATHS, limit
        try:
            got = {r.page_id: r.text for r in html_text.extracted(df).collect()}
        finally:
            html_text.BROADCAST_PATHS = before
        assert all(t.startswith(f"Story {i} w") and t.endswith(f"More of {i}") for i, t in got.items())
    assert html_text.main_text(rows[0][2]).startswith("Offer")  # nothing known of the host: the tag decides
