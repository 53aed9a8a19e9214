import math
import random
import re
import time
from collections import Counter, defaultdict

from planfold.llm import html_text, mixing
from planfold.llm.order import running_totals

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav>
<!-- x --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One <b>bo</b>ld&nbsp;word<br>next<p>Two &lt;tags&gt; <form><input value=">">go</form>
<div class="comments"><p>me too</p><article>another view</article></div><p>Last</p></article><footer>&copy; host</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line One bold word next Two <tags> Last"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<p>a<p>b <a href='x>c") == "a b c" or html_text.main_text("<p>a<p>b <a href='x>c").startswith("a b")
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_text.main_text("<body><header>logo</header><div>text</div><aside>s</aside></body>") == "text"


def test_article_in_main():
    story = "<article><h1>Head</h1><p>The story</p><article>a comment</article></article>"
    for page in (f"<main>{story}</main>", f"<div role=main><div>{story}</div></div>", f"<main><div role='main'>{story}</div><p>note</p></main>"):
        assert html_text.main_text(f"<body><nav>menu</nav>{page}<footer>f</footer></body>") == "Head The story"
    assert html_text.main_text("<main><p>A story without an article around it</p><article>teaser <article>x</article></article></main>") == "A story without an article around it teaser"
    assert html_text.main_text("<main itemprop=articleBody><p>Story</p><article>some longer comment</article></main>") == "Story"


def test_attributes_by_whole_names():
    for a in ("style='overflow:hidden'", 'aria-hidden="false"', "data-class=share", "data-id='menu'", "data-role=navigation", 'title="class=ad hidden"', "style=visibility:hidden"):
        assert html_text.main_text(f"<body><article {a}><p {a}>Story</p></article></body>") == "Story", a
    for a in ("hidden", "HIDDEN=''", "data-x=1 hidden", "data-id=x id=menu", "class = 'share x'", "ROLE=navigation", "title='x'class=ad"):
        assert html_text.main_text(f"<body><article><p>Story</p><p {a}>more</p></article></body>") == "Story", a
    assert html_text.main_text("<body><p>other</p><div data-itemprop=articleBody>x</div></body>") == "other x"


def test_style_tree_finds_repeated_branches(spark):
    page = "<body><div class='top'>Welcome to our site</div><div class='story'>Story {i} {i}</div><div class='line'>Same for all</div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i=i)) for i in range(30)] + [(100, None, None), (101, "http://[bad", "<p>x"), (102, "", ""), (5, "http://h.example/5", page.format(i=5))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as low", "'k' as key", "'p' as path")
    got = {r.page_id: r.text for r in html_text.extracted(df).collect()}
    assert got[7] == "Story 7 7" and got[100] == got[102] == "" and got[101] == "x"
    before, html_text.BROADCAST_PATHS = html_text.BROADCAST_PATHS, -1
    try:
        assert {r.page_id: r.text for r in html_text.extracted(df).collect()} == got
    finally:
        html_text.BROADCAST_PATHS = before
    assert html_text.extracted(df.limit(0)).count() == 0


def test_wrappers_of_the_article_are_not_judged_by_name():
    assert html_text.main_text('<div class="layout-with-sidebar"><article>text</article></div>') == "text"
    assert html_text.main_text('<body class="has-sidebar"><p>hello</p></body>') == "hello"
    assert html_text.main_text('<div class="page-with-sidebar"><nav>m</nav><div>hello</div></div>') == "hello"
    assert html_text.main_text('<div class="comments"><article>a longer comment</article></div><article>text</article>') == "text"


def test_broken_markup_takes_linear_time():
    n = 1_000_000
    for part in ("<a ", "<", "<!-- ", '<a "', "<![CDATA[", "</ ", "<script>", "<svg>x", "<div></p>", '<p a="'):
        for end in ("", ">"):
            began = time.process_time()
            html_text.main_text(part * (n // len(part)) + end)
            assert time.process_time() - began < 8, part
    assert html_text.main_text("<div>a</div><!-- never closed") == "a"


def plain_importance(pages):
    """{path: importance} of one host's pages, by the formulas of the docstring."""
    shown, said, ups = defaultdict(Counter), defaultdict(Counter), {}
    for html in pages:
        for (path, kind, feature), (up, _named) in html_text.style_features(html).items():
            (said if kind else shown)[path][feature] += 1
            ups[path] = up
    own = {}
    for path, layouts in shown.items():
        m = sum(layouts.values())
        entropy = -sum(n / m * math.log(n / m, m) for n in layouts.values()) if m > 1 else 0
        content = [1 - math.log(n, m) for n in said[path].values() for _ in range(n)] if m > 1 else []
        own[path] = 1.0 if m < html_text.MIN_PAGES else (entropy + sum(content) / len(content)) / 2 if content else entropy
    top, bottom = Counter(), Counter()
    for path in own:
        for level, branch in enumerate([path, *ups[path]]):
            w = sum(shown[path].values()) * html_text.DECAY**level
            top[branch] += w * own[path]
            bottom[branch] += w
    less = {p: html_text.VARIETY ** len(shown[p]) for p in own}
    return {p: (1 - less[p]) * own[p] + less[p] * top[p] / bottom[p] for p in own}


def test_importance(spark):
    rng = random.Random(2)
    html = [f"<body><div class=a>{'<p>same</p>' * rng.randrange(4)}<b>{i % 3}</b></div><p id=x>{'w ' * rng.randrange(50)}{i}</p><div><div><div><i><u><s><q>deep</q></s></u></i></div></div></div></body>" for i in range(25)]
    df = spark.createDataFrame([("http://h/", x) for x in html] + [("http://other/", "<p>x")], "url string, html string")
    got = {r.path: r.importance for r in html_text.importance(df).where("host = 'h'").collect()}
    expected = plain_importance(html)
    assert set(got) == set(expected)
    assert all(abs(got[p] - expected[p]) < 1e-9 for p in got)


def test_importance_decides(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(n))
    lengths = (1, 3, 9, 40)
    rows, stories = [], {}
    for i in range(60):
        story, work = text(20 + rng.randrange(40)), "".join(f"<p>{text(rng.choice(lengths))}</p>" for _ in range(rng.randrange(1, 200)))
        note = "<div class='pub'><p>This is the same offer on all pages</p></div>"
        rows.append((i, "http://h/", f"<body><article><p>{story}</p><section class='related-work'>{work}</section>{note}<p>end</p></article><div class='share'>share {i % 2}</div></body>"))
        stories[i] = " ".join(re.sub("<[^>]*>", " ", f"{story} {work} end").split())
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extracted(df).collect()}
    # what is the same on all pages goes without a name, and a name of noise is overruled where the branch differs from page to page
    assert got == stories
    alone = {r.page_id: r.text for r in html_text.extracted(df.limit(3)).collect()}
    assert all("same offer" in t and "share" not in t for t in alone.values())


def test_copies_of_an_article_keep_their_text(spark):
    page = "<body><article><h1>Head</h1><p class='story'>The same story</p></article><footer>f</footer></body>"
    df = spark.createDataFrame([(i, "http://h.example/", page) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extracted(df).collect()} == {"Head The same story"}


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mix(documents):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", f"s{i % 4}") for i in range(400)] + [(1000 + i, "a b c", "en", None) for i in range(5)] + [(2000, None, "en", "s1"), (2001, "", "en", "z"), (3, "w w w w", "en", "s3")]
    df = documents(rows)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets, taken = plain_targets(sizes), {}
    by_id = {(d, len((t or "").split())): s for d, t, _, s in rows}
    for r in got:
        s = by_id[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 14
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mixed(documents([(1, None), (2, "")])).count() == 2


def test_running_totals(spark):
    df = spark.range(1000).selectExpr("id", "id % 10 as v").repartition(5)
    got = running_totals(df, ["v", "id"], "v").orderBy("place").collect()
    total = 0
    for k, r in enumerate(got):
        total += r.v
        assert (r.place, r.upto) == (k, total)
