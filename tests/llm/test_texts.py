"""Operators that judge each text on its own, against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import LONG, ODD, WORD, lower_az
from tokenizers import Tokenizer

from planfold.llm import common as common_
from planfold.llm import decontaminate, language, line_dedup, pii, quality, token_files, toxicity

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PRIVATE = [
    (1, None), (2, ""), (3, "a@b.c_d@e.f"), (4, "x..y@z.com a@b"), (5, "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0255"),
    (6, "4539 1488 0343 6467 4539-1488-0343-6467-1"), (7, "1" * 30000), (8, "12 " * 9000), (9, "a" * 50000 + "@"), (10, "a@b.c" * 900),
    (11, "+1 (366) 555-9807 +1+22222222222+++"), (12, "(366) 555-9807 mail: joe (at) example (dot) com"),
    (13, 'password=abc123def456 token = "1beb58b8af68854f0e01" pwd: hello'), (14, "😀 bob@x.org 😀 10.0.0.1 é +49 30 1234567"), (14, "😀 bob@x.org"),
]


def valid(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


@cache
def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [f"{k}:{a}:{e}" for a, _, e, k in sorted(found)]


def test_personal_data(documents, tmp_path, spark):
    documents(PRIVATE).write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op1_personal_data(spark, str(tmp_path)).collect()
    expected = sorted((d, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for d, t in PRIVATE)
    assert sorted((r.doc_id, r.base_sha256) for r in got) == expected
    for r in got:
        for kind in BASE:
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for t in [next(t for d, t in PRIVATE if d == r.doc_id and hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest() == r.base_sha256)] for s in base_spans(t))
    spans = {r.doc_id: r.spans for r in got if r.doc_id != 14}
    assert "secret:0:21" in spans[13]
    assert spans[1] == spans[2] == ""


@pytest.mark.parametrize("piece", [4096, 7])
def test_redaction(documents, monkeypatch, piece):
    monkeypatch.setattr(pii, "PIECE", piece)
    rows = [(1, "mail bob@x.org now"), (2, None), (3, "nothing"), (1, "now bob@x.org, +49 30 1234567"), (None, "null\n\nan@y.com"), (None, "10.0.0.1"), (5, "😀 4539 1488 0343 6467 é"), (6, "a@b.c" * 30), (7, "")]
    df = documents(rows)
    out = pii.redacted(df)
    assert out.columns == df.columns
    expected = [(1, "mail <email> now"), (2, None), (3, "nothing"), (1, "now <email>, <phone>"), (None, "null\n\n<email>"), (None, "<ip>"), (5, "😀 <card> é"), (6, re.sub(BASE["email"], "<email>", "a@b.c" * 30)), (7, "")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(expected, key=str)


def test_very_many_spans_in_one_text(documents):
    text = " ".join(f"a{i}@b.org x@{i % 250}.1.1.1" for i in range(40_000))
    began = time.time()
    (got,) = pii.found_spans(documents([(1, text)])).collect()
    assert time.time() - began < 60
    assert [(s.s, s.e) for s in got.base if s.k == 0] == [m.span() for m in re.finditer(BASE["email"], text)]


def plain_odds(patterns, rounds):
    """Expectation-maximisation over {(k, votes): n}, written out."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p, odds = {key: sigmoid(1.5 * sum(key[1])) for key in patterns}, {}
    for _ in range(rounds):
        odds = {}
        for k in {k for k, _ in patterns}:
            mine = {v: (n * p[k, v], n * (1 - p[k, v])) for (kk, v), n in patterns.items() if kk == k}
            yes, no = (sum(x[i] for x in mine.values()) for i in (0, 1))
            odds[k, "", 0] = math.log((yes + 1) / (no + 1))
            for j, name in enumerate(pii.VOTES):
                for value in (-1, 0, 1):
                    y, n = (sum(x[i] for v, x in mine.items() if v[j] == value) for i in (0, 1))
                    said = math.log((y + 1) / (yes + 3)) - math.log((n + 1) / (no + 3))
                    odds[k, name, value] = max(said, 0) if value > 0 else min(said, 0) if value < 0 else 0
        p = {(k, v): sigmoid(max(-30, min(30, odds[k, "", 0] + sum(odds[k, name, x] for name, x in zip(pii.VOTES, v, strict=True))))) for k, v in patterns}
    return odds, p


def test_reliabilities_and_classifier(spark):
    rng, patterns = np.random.RandomState(8), Counter()
    for k in (0, 1, 3):
        for _ in range(600):
            true = rng.rand() < 0.6
            votes = tuple(int(rng.choice([1, 0, -1], p=[0.7, 0.2, 0.1] if true else [0.1 + j / 10, 0.3, 0.6 - j / 10])) for j in range(5))
            patterns[k, votes] += 1
    df = spark.createDataFrame([(k, *v, n) for (k, v), n in patterns.items()], f"k int, {', '.join(f'{v} int' for v in pii.VOTES)}, n long")
    got, (odds, p) = pii.estimated(df), plain_odds(patterns, pii.ROUNDS)
    posterior = next(name for k, name, _ in got if k == -1)
    assert all(abs(got[key] - odds[key]) < 1e-6 for key in odds)
    assert all(abs(r.p - p[r.k, tuple(r[v] for v in pii.VOTES)]) < 1e-6 for r in df.selectExpr("k", *pii.VOTES, f"{posterior} as p").collect())
    # the classifier against Newton's steps on the same loss
    keys = list(patterns)
    x = np.array([[1.0, *(k == i for i in range(len(pii.KINDS))), *(v[j] == s for j in range(5) for s in (1, -1))] for k, v in keys], float)
    w, y, beta, keep = np.array([patterns[k] for k in keys], float), np.array([p[k] for k in keys]), np.zeros(16), np.diag([0.0] + [1e-3] * 15)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T * (w * q * (1 - q)) @ x / w.sum() + keep + 1e-12 * np.eye(16), x.T @ (w * (q - y)) / w.sum() + keep @ beta)
    expected = dict(zip(keys, 1 / (1 + np.exp(-x @ beta)), strict=True))
    found = {(r.k, tuple(r[v] for v in pii.VOTES)): r.q for r in df.selectExpr("k", *pii.VOTES, f"{pii.classifier(df, posterior)} as q").collect()}
    assert max(abs(found[k] - expected[k]) for k in keys) < 0.02


def test_personal_data_of_nothing(documents):
    assert pii.found_spans(documents([])).count() == 0


def plain_quality(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(documents):
    rows = [*ODD, (20, "a b c d e f a b c d e\nx\nx\n\n \n x"), (21, "to be or not " * 50), (22, "#*$%&|<> ok")]
    got = quality.judged(documents(rows)).collect()
    key = lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert sorted(map(key, got)) == sorted((d, *plain_quality(t)) for d, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_divergence_rejects_shouting(documents):
    prose = [(i, f"the house of the sea and a tree is in the north of it{i} that was on a hill to the {i}th lake and so it is for all of them " * 1 + " ".join(f"w{i}o{j}" for j in range(30)).replace("0", "a"), "en") for i in range(40)]
    loud = [(100, " ".join(f"SHOUT{chr(65 + i % 26)}!!" + chr(66 + i % 7) for i in range(60)), "en"), (101, "SHORT!! LOUD!!", "en")]
    got = {r.doc_id: r for r in quality.judged(documents(prose + loud)).collect()}
    assert all(got[d].kept for d, *_ in prose)
    assert not got[100].kept and not got[100].base_failed


def test_quality_divergence_rejects_texts_without_common_words(documents):
    rng = np.random.RandomState(5)
    new = lambda n: ["".join(rng.choice([*"abcdefghijklmnoprstuw"], 5)) for _ in range(n)]

    def text(n, common):
        words = [*new(n - common), *rng.choice(quality.COMMON_WORDS["en"], common)]
        return " ".join(words[i] for i in rng.permutation(n))

    prose = [(i, text(200, 44), "en") for i in range(60)]
    odd, short = (100, text(200, 0), "en"), [(200 + i, text(32, 7), "en") for i in range(20)]
    got = {r.doc_id: r for r in quality.judged(documents([*prose, odd, *short])).collect()}
    assert all(got[d].kept for d, *_ in [*prose, *short])
    assert not got[100].kept and not got[100].base_failed and got[100].class_distance <= quality.MAX_CLASSES


def test_quality_of_nothing(documents):
    assert quality.judged(documents([])).count() == 0


def plain_lines(rows):
    key = lambda line: lower_az(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and d is not None:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (d is not None and len(holders.get(key(x), ())) >= 5 and d != max(holders[key(x)]))]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize("ids", [10**6, 0])
def test_line_dedup(documents, monkeypatch, ids):
    monkeypatch.setattr(common_, "BROADCAST_IDS", ids)
    common = "This line is long enough to be counted, and it is everywhere"
    rows = [*ODD, *((20 + i, f"first {i}\n \t{common.upper() if i % 2 else common}\r\nshort\n\n{common}") for i in range(7)), (26, common), (None, common), (40, common[:39] + "\nshort"), (41, "short")]
    got = [tuple(r) for r in line_dedup.deduplicated_lines(documents(rows)).collect()]
    order = lambda r: (r[0] is not None, r)
    assert sorted(got, key=order) == sorted(plain_lines(rows), key=order)
    assert line_dedup.deduplicated_lines(documents([])).count() == 0


def test_line_dedup_of_form_feeds_and_the_letter_f(documents):
    first, last = "from the river to the sea and back home,", "the sea and the house that it is made of"
    assert len(first) == len(last) == 40
    bare = "the words alone are long enough to be counted"
    rows = [(i, f"{first}\n{last}\n\f{bare} \f" if i % 2 else f"{first}\n{last}\n{bare}") for i in range(6)]
    rows += [(10 + i, f"f{bare}f" if i < 3 else f"ff{bare}") for i in range(6)]
    got = [tuple(r) for r in line_dedup.deduplicated_lines(documents(rows)).collect()]
    assert sorted(got) == sorted(plain_lines(rows))
    assert {d: n for d, _, n, _ in got} == {**dict.fromkeys(range(5), 3), 5: 0, **dict.fromkeys(range(10, 16), 0)}


def plain_contamination(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower_az(t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            part = v[i : i + 10]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(item)
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [10**6, 40])
def test_contamination(documents, spark, block):
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [(1, ten + " lambda mu"), (2, "Short One"), (3, ""), (4, None), (5, "..."), (12, "short, one!"), (6, ten)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "item_id")
    rows = [*ODD, (20, f"x {ten.upper()}-lambda: {ten} y"), (21, ten[6:]), (22, "a short\tone; SHORT one shortone"), (23, ten + " mu")]
    got = decontaminate.contamination(documents(rows), bench, block).collect()
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
    assert sorted(map(key, got)) == sorted((d, *plain_contamination(t, items)) for d, t in rows)
    left = decontaminate.drop_contaminated(documents(rows), bench)
    assert not {20, 22} & {r.doc_id for r in left.collect()}
    assert left.columns == documents(rows).columns


def test_contamination_of_nothing(documents, spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for block in (10**6, 1):
        assert decontaminate.contamination(documents([]), bench, block).count() == 0


def test_contamination_without_items(documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(documents(ODD), none).collect())


def test_token_files(documents):
    rows = [*ODD, (20, "Hello, it's World's end...\tcafé ÉCOLE naïve 12345 <|endoftext|> x.y,z. ﬁ İstanbul é   a\x1cb")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_files.encoded(documents(rows)).orderBy("start").collect()
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    at = 0
    for r, d in zip(got, sorted(d for d, _ in rows), strict=True):
        assert r.doc_id == d and r.start == at
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[d]]
        at += r.n_tokens
    assert token_files.encoded(documents([])).count() == 0


#: Pieces whose tokens depend on what stands beside them: added tokens, apostrophes, composition, lower case of two characters, blanks
#: of other kinds, signs among letters, digits of all sorts.
PIECES = ["hello", "A\u0130", ",", ".", "\u0130", "'s", "'S", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>x", "<", "|", "\u00e9", "\u00c9", "e\u0301", "H\u0331", "t\u0308", "\u00df", "\u1e9e", "\u00d7", "\u00f7", "\u00ff", "\u0178", "12", "\uff13", "\u00bd",
          "\u00aa", "\u00b5", "j\u030c", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\u65e5\u672c", "\u03a9", "\u03a3\u0391\u03a3", "\ufb01", " ", "  ", "\n", "\t", "\r\n", "\x0b", "...", "%%%", "#a", "_", "\u0307", "\u0301", "\U0001f600", "\0", "\u0416", "\u0149", "\u01c4", "\u212a", "\u212b", "(a)", "O'NEIL", "'re", "'LL"]


@pytest.mark.parametrize("piece", [4 << 20, 16])
def test_ids_of_runs_are_the_ids_of_texts(piece, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE", piece)
    monkeypatch.setattr(token_files, "REMEMBERED", 2000)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, runs, rng = Tokenizer.from_file(path), token_files.RunIds(path), random.Random(11)
    anything = lambda: chr(rng.choice([rng.randrange(1, 128), rng.randrange(0x80, 0x250), rng.randrange(0x250, 0x3000)]))
    texts = ["".join(rng.choice(PIECES) if rng.random() < 0.8 else anything() for _ in range(rng.randrange(14))) for _ in range(3000)]
    for i in range(0, len(texts), 50):
        part = texts[i : i + 50]
        counts, ids = runs.texts([t.encode() for t in part], 2)
        expected = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in part]
        assert counts.tolist() == list(map(len, expected))
        assert ids.tolist() == [x for e in expected for x in e]


def test_token_files_of_many_row_groups(documents, spark):
    rng = np.random.RandomState(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.randint(0, 10**6, 400))) for i in range(300)]
    small = {"parquet.block.size": "20000", "parquet.block.size.row.check.min": "1", "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1", "spark.sql.shuffle.partitions": "1"}
    before, held, groups = {k: spark.conf.get(k, None) for k in small}, token_files.BLOCK_IDS, getattr(token_files, "SMALL_GROUPS", {}).copy()
    for k, v in small.items():
        spark.conf.set(k, v)
    token_files.BLOCK_IDS = 5000
    getattr(token_files, "SMALL_GROUPS", {}).update({"parquet.block.size": "20000"})
    try:
        path = token_files.shared_folder(spark)
        token_files.write_token_files(documents(rows), path)
        assert spark.read.parquet(f"{path}/ids").rdd.getNumPartitions() > 3
        got = token_files.read_token_files(spark, path).orderBy("start", "doc_id").collect()
    finally:
        token_files.BLOCK_IDS = held
        getattr(token_files, "SMALL_GROUPS", {}).update(groups)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [r.doc_id for r in got] == list(range(300))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_byte_code_round_trip():
    rng = np.random.RandomState(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2.0 ** rng.uniform(0, 31.9, n)).astype(np.uint32)
        control, data = token_files.pack(ranks)
        assert len(control) == (n + 3) // 4
        assert (token_files.unpack(control, data, n) == ranks).all()


def test_language(documents):
    words = {"en": "the of and to in that is was for it with as his on be at by", "de": "der die und in den von zu das mit sich des auf für ist im dem", "fr": "de la le et les des en un du une que est pour qui dans au"}
    rng = np.random.RandomState(2)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 60)), lang) for i in range(240) for lang in [sorted(words)[i % 3]]]
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 456 !!", "fr"), (903, "x", None), (904, "der die und in den von zu das " * 20 + "the of and " * 2, None)]
    got = {r.doc_id: r for r in language.identified(documents(rows + odd)).collect()}
    held = [(d, lang) for d, _, lang in rows if got[d].held_out]
    assert len(held) > 30 and sum(got[d].lang_pred == lang for d, lang in held) >= 0.95 * len(held)
    assert [got[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3 and got[904].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert {r.lang_pred for r in language.identified(documents([(1, "some text", None)])).collect()} == {"und"}


def plain_mixture(grams, model):
    """The language of one text: EM over all languages, then over the likeliest 1, 2, ... of them, by the docstring's formulas."""
    p, w = model[:, np.unique(grams)].astype(float), np.unique(grams, return_counts=True)[1].astype(float)

    def settle(share, rounds):
        for _ in range(rounds):
            part = p * share[:, None]
            share = (part / part.sum(axis=0) * w).sum(axis=1) / w.sum()
        return share

    share = settle(np.full(len(model), 1 / len(model)), language.ROUNDS)
    order, best = sorted(range(len(model)), key=lambda i: -share[i]), None
    for k in range(1, len(model) + 1):
        some = np.zeros(len(model))
        some[order[:k]] = np.maximum(share[order[:k]], 1e-6)
        some = settle(some / some.sum(), language.SET_ROUNDS if k > 1 else 0)
        likely = (w * np.log((p * some[:, None]).sum(axis=0))).sum() - 0.5 * (k - 1) * np.log(w.sum())
        if best is None or likely > best[0]:
            best = (likely, some)
    return int(best[1].argmax()), (w.sum() * best[1].max() + 1) / (w.sum() + len(model))


def test_mixtures_against_a_plain_version():
    rng = np.random.RandomState(6)
    model = rng.dirichlet(np.full(300, 0.3), 5) + 1e-6
    model = (model / model.sum(axis=1, keepdims=True)).astype(np.float32)
    texts = []
    for i in range(60):
        langs = rng.choice(5, 1 + i % 4, replace=False)
        texts.append(np.concatenate([rng.choice(300, rng.randint(20, 400), p=model[x] / model[x].sum(dtype=float)) for x in langs]))
    best, score = language.mixtures(texts, model)
    for t, b, s in zip(texts, best, score, strict=True):
        expected = plain_mixture(t, model)
        assert b == expected[0] and abs(s - expected[1]) < 5e-3


def test_language_of_odd_rows(documents, monkeypatch):
    rows = [(100 + i, f"the house of the sea {i}" if i % 2 else f"das haus und die see {i}", "en" if i % 2 else "de") for i in range(40)] + ODD
    got = sorted(map(tuple, language.identified(documents(rows)).collect()))
    assert len(got) == len(rows)
    monkeypatch.setattr(language, "CELLS", 10)
    assert sorted(map(tuple, language.identified(documents(rows)).collect())) == got
    assert language.identified(documents([])).count() == 0


def test_toxicity_features_of_odd_rows():
    lexicon = {"grum": 2.0}
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon) == [0.0] * toxicity.FEATURES
    tokens = "You are a GRUMBLO!! grumblo w0rd soooo".split()
    f = toxicity.features(" ".join(tokens), lexicon)
    assert f[0] == 2 / 7 and f[1] == 4 / 7 and f[3] == 2.0 and f[5] == 1.0 and f[6] == 1 / 7 and f[10] == 1 / 7 and f[11] == 1 / 7
    assert len(toxicity.features(LONG * 3, lexicon)) == toxicity.FEATURES


def test_toxicity(documents, spark):
    rng = np.random.RandomState(3)
    calm, bad = [f"calm{chr(97 + i)}{chr(97 + i)}" for i in range(26)], ["grumblo", "snarkit", "fozzle"]
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 5 == 0)
        words = [*rng.choice(calm, 40), *(rng.choice(bad, 4) if toxic else [])]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic, "x"))
    rows += [(900, None), (901, ""), (902, "grumblo snarkit you fozzle"), (902, "calmaa"), (903, LONG), (904, "calmaa"), (904, "calmaa")]
    labels += [(900, 1, None, "x"), (None, 1, 1, "x"), (0, 1, 1, "x")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.scored(documents(rows), table).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.scored(documents([]), table).count() == 0
    left = toxicity.drop_toxic(documents(rows), table)
    assert 5 not in {r.doc_id for r in left.collect()} and left.columns == documents(rows).columns


def test_toxicity_without_labels(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.scored(documents(ODD), none).collect()] == [0.0] * len(ODD)
