"""HTML extraction with site style trees.

Pages of a host are merged by element path (tags with their class and id from the root down). A node's own importance is the mean of
presentation (entropy of what the pages show there: child layouts and size of the text, base the number of times it is shown) and of
content (one less the mean entropy of its texts over the pages). A branch's composite importance is (1 - VARIETY**l) of its own and
VARIETY**l of the weighted mean over its nodes, where l is the number of layouts it is shown in: the more there are, the more they
say. In the mean each node counts as often as it is shown, and by DECAY for each level below, down to LEVELS levels. Nodes shown less
than MIN_PAGES times count as important.

Importance chooses where the article is: the text of each branch, weighed by the importance of the nodes that say it, is summed from the
leaves up, and from the body down the branch is followed that holds DOMINANT of the weight, as long as it is made of blocks. Tags and
names are a prior: what is never text or is named noise weighs nothing, and an <article>, <main> or articleBody on the way down or below
it is taken as it is; but if it stands elsewhere and has less than half of the weight, the heavier branch is the article. On hosts with
few pages nothing is known of importance and the prior alone decides.

What goes is decided by importance against a limit that the element's name sets: a branch with a neutral name goes under
MIN_IMPORTANCE, one whose class, id or role names noise (NOISE, ROLES) unless it has NAMED_IMPORTANCE, and elements that are never text
of an article (NEVER: menus, footers, asides, forms, scripts, ...; hidden ones) always, as pages of hosts with few pages need it.

The prior's article is the <article>, <main> or articleBody with the most text, or the body where there is none; an <article>
in <main> is one of them, and what <main> says beside its articles is measured against theirs. Elements around it are not judged by
name. Inside the article, plain elements without class or id are kept whatever their importance, and low branches only go if they
hold at most half of its text: copies of an article on one host make its paragraphs as frequent as a footer, and they are still text.

Statistics are counted with partial sums by (host, path, feature), so a host with a third of all pages is no hot spot. The paths that
change something are sent to the tasks where they are few (BROADCAST_PATHS, counted first); otherwise they are joined to the pages.

Defined results: null or empty html: empty text; null url: host ''; repeated rows are extracted each; broken markup (unclosed tags,
quotes, comments) is read as far as it goes, in time linear in its length: after a quote that never closes, tags end at the next >, and
text after the last > is text. Where names alone would leave nothing of a page, they don't count. Extra columns are ignored."""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planfold.llm.common import cut, map_texts, table

#: Limits of importance for branches with neutral names and with names of noise, and how often a node must be shown to be judged.
MIN_IMPORTANCE, NAMED_IMPORTANCE, MIN_PAGES = 0.2, 0.85, 8
LEVELS, DECAY, VARIETY = 6, 0.7, 0.9
#: Share of the weight that a branch must hold to be followed, and importance from which a node's text has its full weight.
DOMINANT, FULL_WEIGHT = 0.7, 0.9
BROADCAST_PATHS = 200_000
_TAG = re.compile(r"<!--|<!\[CDATA\[|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+>")
#: For pages with a quote that never closes.
_PLAIN_TAG = re.compile(r"<!--|<!\[CDATA\[|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>")
_OPENS = re.compile(r"<[a-zA-Z!?/]")
#: Any attribute with its value, so that the names are read whole and nothing is looked for inside values.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_KNOWN = frozenset("class id role itemprop hidden".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp")}
#: Fixed values of HTML: elements without an end tag, inline elements, elements that a new block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NEVER = frozenset("nav footer aside form script style noscript template iframe svg button select option textarea dialog head title object canvas menu audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended sidebar menu navbar nav navigation breadcrumb breadcrumbs pagination pager footer comment comments disqus reply replies respond widget toolbar login signup masthead".split()
)


class Node:
    __slots__ = ("tag", "attributes", "path", "up", "parts", "kids")

    def __init__(self, tag: str, attributes: dict, path: int, up: Node | None = None):
        self.tag, self.attributes, self.path, self.up, self.parts, self.kids = tag, attributes, path, up, [], []


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def parsed(html: str) -> Node:
    """The page's elements; parts of a node are texts and nodes in page order. Paths are 32-bit sums of the parent's path and the
    node's tag, class and id."""
    root = Node("", {}, 0)
    stack, at, n = [root], 0, len(html)
    last, pattern = html.rfind(">"), _TAG
    open_: dict[str, int] = {}
    unended: set[str] = set()

    def close(i: int) -> None:
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    while at < n:
        o = _OPENS.search(html, at)
        if o is None or o.start() > last:
            stack[-1].parts.append(html[at:] if o is None or not html.startswith("<!--", o.start()) else html[at : o.start()])
            break
        m = pattern.match(html, o.start())
        if m is None and pattern is _TAG:
            pattern = _PLAIN_TAG
            m = pattern.match(html, o.start())
        if m is None:  # no tag at all: the sign is text
            stack[-1].parts.append(html[at : o.start() + 1])
            at = o.start() + 1
            continue
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        name = m[2]
        if not name:
            continue
        tag = name.lower()
        if m[1]:
            if open_.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag in CLOSES_P:  # a new block ends an open paragraph with the inline elements in it
            for i in range(len(stack) - 1, 0, -1) if open_.get("p") else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            for i in range(len(stack) - 1, 0, -1) if any(map(open_.get, same)) else ():
                if stack[i].tag in same:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select") or tag in ("td", "th") and stack[i].tag == "tr":
                    break
        rest = m[3]
        attributes = {name: a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(rest) if (name := k.lower()) in _KNOWN} if rest and not rest.isspace() else {}
        sign = f"{tag}.{attributes.get('class', '')}#{attributes.get('id', '')}"
        node = Node(tag, attributes, crc32(sign.encode("utf-8", "replace"), stack[-1].path), stack[-1])
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(html, at) if tag not in unended else None
            if end is None:
                unended.add(tag)
            if tag == "title":
                node.parts.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _text(node: Node, gone=lambda _node: False) -> str:
    """Text of a branch: references decoded, inline elements run on, others apart by a blank."""
    said: list[str] = []
    work = [node]
    while work:
        x = work.pop()
        if isinstance(x, str):
            said.append(x)
            continue
        apart = " " if x.tag not in INLINE else ""
        said.append(apart)
        work.append(apart)
        for part in reversed(x.parts):
            if isinstance(part, str):
                work.append(entities.unescape(part) if "&" in part else part)
            elif not gone(part):
                work.append(part)
    return " ".join("".join(said).split())


def _never(node: Node) -> bool:
    return node.tag in NEVER or "hidden" in node.attributes


def _named(node: Node) -> bool:
    """Does class, id or role name noise?"""
    a = node.attributes
    if not a:
        return False
    if a.get("role", "").lower() in ROLES:
        return True
    words = re.split(r"[^a-z0-9]+", f"{a.get('class', '')} {a.get('id', '')}".lower())
    return not NOISE.isdisjoint(words)


def _holds_articles(node: Node) -> bool:
    """A <main> or role=main that isn't itself the article: articles in it are no readers' comments."""
    return (node.tag == "main" or node.attributes.get("role", "") == "main") and node.tag != "article" and node.attributes.get("itemprop", "") != "articleBody"


def _is_anchor(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attributes.get("itemprop", "") == "articleBody" or node.attributes.get("role", "") == "main"


def _anchor(root: Node, noise) -> Node | None:
    """The article: <article>, <main> or articleBody with the most text, noise left out. What a <main> has in articles counts for those.
    Anchors under an element with a name of noise only count where there are no others (the name may be that of a wrapper)."""
    order, found = [], {False: [], True: []}
    work = [(root, False)]
    while work:
        x, under = work.pop()
        order.append(x)
        anchor = _is_anchor(x)
        if anchor:
            found[under].append(x)
        inside = anchor and not _holds_articles(x)  # an article within another (a reader's comment) belongs to that one
        work += [(k, under or noise(k)) for k in x.kids if not _never(k)] if not inside else []
    anchors = found[False] or found[True]
    if len(anchors) < 2:
        return anchors[0] if anchors else None
    tops, seen = set(map(id, anchors)), []
    said: dict[int, int] = {}
    for a in anchors:  # lengths from the leaves up, each node once
        work = [a]
        while work:
            x = work.pop()
            seen.append(x)
            holds = _holds_articles(x)
            work += [k for k in x.kids if id(k) not in tops and not _never(k) and not noise(k) and not (holds and k.tag == "article")]
    for x in reversed(seen):
        said[id(x)] = said.get(id(x), 0) + sum(len(" ".join(p.split())) for p in x.parts if isinstance(p, str))
        if id(x) not in tops and x.up is not None:
            said[id(x.up)] = said.get(id(x.up), 0) + said[id(x)]
    return max(anchors, key=lambda x: said[id(x)])


def content_root(root: Node, weights: dict[int, float], nothing) -> tuple[Node, dict[int, float]]:
    """The branch that holds the article by weight alone, and the weight of all branches (by id); nothing(node): its branch weighs nothing."""
    top = next((k for h in root.kids for k in [h, *h.kids] if k.tag == "body"), root)
    order, work, total = [], [top], {}
    while work:
        x = work.pop()
        order.append(x)
        work += [k for k in x.kids if not nothing(k)]
    for x in reversed(order):
        own = sum(len(" ".join(p.split())) for p in x.parts if isinstance(p, str)) * weights.get(x.path, 1.0)
        total[id(x)] = total.get(id(x), 0.0) + own
        if x is not top:
            total[id(x.up)] = total.get(id(x.up), 0.0) + total[id(x)]
    x = top
    while True:
        blocks = [k for k in x.kids if id(k) in total and any(g.tag not in INLINE and g.tag not in VOID for g in k.kids)]
        best = max(blocks, key=lambda k: total[id(k)], default=None)
        if best is None or total[id(best)] < DOMINANT * total[id(x)] or not total[id(x)]:
            return x, total
        x = best


def _within(node: Node, other: Node) -> bool:
    while node is not None and node is not other:
        node = node.up
    return node is other


def main_text(html: str | None, low: frozenset[int] | set[int] = frozenset(), kept: frozenset[int] | set[int] = frozenset(), weights: dict[int, float] | None = None) -> str:
    """The article's text; low: paths of low importance on the page's host; kept: paths with a name of noise, but high importance;
    weights: importance of the host's paths under FULL_WEIGHT, None where nothing is known of the host."""
    if not html:
        return ""
    root = parsed(html)

    def noise(node: Node) -> bool:
        return node.path not in kept and _named(node)

    anchor = _anchor(root, noise)
    if weights is not None:
        found, total = content_root(root, weights, lambda x: _never(x) or noise(x))
        if found.tag != "body" and found is not root and (anchor is None or not _within(anchor, found) and not _within(found, anchor) and total[id(found)] > 2 * total.get(id(anchor), 0.0)):
            anchor = found
    comments = anchor.kids[:] if anchor is not None and not _holds_articles(anchor) else []
    if anchor is not None and not comments:  # a <main> that says more than its articles keeps them, without the articles in those
        work = [anchor]
        while work:
            for k in work.pop().kids:
                if k.tag == "article" or k.attributes.get("itemprop", "") == "articleBody":
                    comments += k.kids
                else:
                    work.append(k)
    nested = set()
    while comments:
        k = comments.pop()
        if k.tag == "article":
            nested.add(id(k))
        else:
            comments += k.kids
    top = anchor or next((k for h in root.kids for k in [h, *h.kids] if k.tag == "body"), root)

    def never(node: Node) -> bool:
        return _never(node) or node.tag == "header" and anchor is None or id(node) in nested

    def unimportant(node: Node) -> bool:
        return node.path in low and (anchor is None or bool(node.attributes))

    text = _text(top, lambda x: never(x) or noise(x))
    if low:
        left = _text(top, lambda x: never(x) or noise(x) or unimportant(x))
        if anchor is None or 2 * len(left) >= len(text):
            text = left
    return text if text or anchor is not None else _text(top, never)


def style_features(html: str | None) -> dict[tuple[int, int, int], tuple[list[int], bool]]:
    """The page's part of its host's style tree: (path, 0: what is shown or 1: own text, hash) -> paths of the LEVELS elements above,
    and whether the element has a name of noise."""
    out = {}
    work = [parsed(html)] if html else []
    while work:
        x = work.pop()
        if x.path:
            own = " ".join(" ".join(p for p in x.parts if isinstance(p, str)).split())
            shown = f"{len(own).bit_length() // 2} {' '.join(str(k.path) for k in x.kids)}"
            ups, up = [], x.up
            while up is not None and up.path and len(ups) < LEVELS:
                ups.append(up.path)
                up = up.up
            of = (ups, bool(x.attributes) and _named(x))
            out[x.path, 0, crc32(shown.encode())] = of
            if own:
                out[x.path, 1, crc32(own.encode("utf-8", "replace"))] = of
        work += x.kids
    return out


def importance(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (host, path, shown, named, own, importance): own and composite importance of every branch of every host."""

    def each(batch: pa.RecordBatch):
        found: dict[tuple, list] = {}
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = host_of(url)
            for f, (ups, named) in style_features(html).items():
                row = found.get((host, *f))
                if row is None:
                    found[host, *f] = [1, ups, named]
                else:
                    row[0] += 1
        keys = list(zip(*found, strict=True)) or [(), (), (), ()]
        values = list(zip(*found.values(), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int32()), pa.array(keys[3], pa.int64()), pa.array(values[0], pa.int64()), pa.array(values[1], pa.list_(pa.int64())), pa.array(values[2], pa.bool_())], names=["host", "path", "kind", "feature", "n", "ups", "named"])

    rows = map_texts(pages, ["url", "html"], "host string, path long, kind int, feature long, n long, ups array<long>, named boolean", each)
    seen = rows.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.first("ups").alias("ups"), F.first("named").alias("named"))
    by = seen.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("shown"), F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("layouts"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("texts"), F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("spread"),
        F.first("ups").alias("ups"), F.first("named").alias("named"), F.count(F.when(F.col("kind") == 0, 1)).alias("kinds"),
    )
    # presentation: -sum p log_m p; content: 1 - mean over texts of log_m(times the text is shown)
    m = F.log("shown")
    presentation = 1 - F.col("layouts") / (F.col("shown") * m)
    content = 1 - F.col("spread") / (F.col("texts") * m)
    own = F.when(F.col("shown") < MIN_PAGES, 1.0).when(F.col("texts") > 0, (presentation + content) / 2).otherwise(presentation)
    nodes = by.select("host", "path", "shown", "named", "kinds", own.alias("own"), F.concat(F.array("path"), "ups").alias("branches"))
    spread = nodes.select("host", F.posexplode("branches").alias("level", "branch"), "path", "shown", "named", "kinds", "own")
    weight = F.col("shown") * F.pow(F.lit(DECAY), F.col("level"))
    mine = lambda c: F.max(F.when(F.col("level") == 0, F.col(c))).alias(c)
    branches = spread.groupBy("host", F.col("branch").alias("path")).agg(mine("shown"), mine("named"), mine("kinds"), mine("own"), (F.sum(weight * F.col("own")) / F.sum(weight)).alias("mean"))
    less = F.pow(F.lit(VARIETY), F.col("kinds"))
    return branches.select("host", "path", "shown", "named", "own", ((1 - less) * F.col("own") + less * F.col("mean")).alias("importance"))


def decisive_paths(pages: DataFrame) -> DataFrame:
    """(host, path, low, kept, weight): the branches of low importance, those with a name of noise but high importance, and those whose text
    has less than its full weight."""
    judged = importance(pages).where(F.col("shown") >= MIN_PAGES)
    low, kept = F.col("importance") < MIN_IMPORTANCE, F.col("named") & (F.col("importance") >= NAMED_IMPORTANCE)
    return judged.select("host", "path", low.alias("low"), kept.alias("kept"), F.greatest(F.lit(0.0), "own").alias("weight")).where(F.col("low") | F.col("kept") | (F.col("weight") < FULL_WEIGHT))


def extracted(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html")
    paths = cut(decisive_paths(pages))
    schema = "page_id long, url string, text string, n_chars long"

    def rows(batch: pa.RecordBatch, sets: list):
        texts = [main_text(h, *x) for h, x in zip(batch.column("html").to_pylist(), sets, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if paths.count() <= BROADCAST_PATHS:
        known: dict[str, tuple[set[int], set[int], dict[int, float]]] = {}
        for r in paths.collect():
            low, kept, weights = known.setdefault(r.host, (set(), set(), {}))
            weights[r.path] = r.weight
            if r.low:
                low.add(r.path)
            elif r.kept:
                kept.add(r.path)

        def each(batch: pa.RecordBatch):
            yield rows(batch, [known.get(host_of(u), ()) for u in batch.column("url").to_pylist()])

        return map_texts(pages, ["page_id", "url", "html"], schema, each)

    def of_page(batch: pa.RecordBatch):
        urls, htmls = batch.column("url").to_pylist(), batch.column("html").to_pylist()
        for url, html, key in zip(urls, htmls, batch.column("key").to_pylist(), strict=True):
            found = sorted({f[0] for f in style_features(html)})
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array([host_of(url)] * len(found), pa.string()), pa.array(found, pa.int64())], names=["key", "host", "path"])

    keyed = pages.withColumn("key", F.xxhash64("page_id", "url", "html"))
    of = map_texts(keyed, ["key", "url", "html"], "key long, host string, path long", of_page).join(paths, ["host", "path"])
    of = of.groupBy("key").agg(F.collect_set(F.when(F.col("low"), F.col("path"))).alias("low"), F.collect_set(F.when(F.col("kept") & ~F.col("low"), F.col("path"))).alias("kept"), F.map_from_entries(F.collect_set(F.struct("path", "weight"))).alias("weights"))
    joined = keyed.join(of, "key", "left")

    def each_joined(batch: pa.RecordBatch):
        yield rows(batch, [(set(x or ()), set(y or ()), None if w is None else dict(w)) for x, y, w in zip(*(batch.column(c).to_pylist() for c in ("low", "kept", "weights")), strict=True)])

    return map_texts(joined, ["page_id", "url", "html", "low", "kept", "weights"], schema, each_joined)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
