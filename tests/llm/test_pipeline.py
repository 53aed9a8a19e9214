"""The corpus pipeline, stage by stage, against plain versions; every stage on odd rows and empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import ODD, SCHEMA
from tests.llm.test_near_dedup import brute
from tests.llm.test_pages_and_mix import plain_targets
from tests.llm.test_texts import plain_contamination
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def corpus():
    rng = random.Random(12)
    calm = [f"calm{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    rows, labels, n = [], [], 0
    for i in range(220):
        words = rng.sample(calm, 40)
        toxic = i % 5 == 0
        if toxic:
            for w in ("grumblo", "snarkit", "fozzle", "grumblo"):
                words.insert(rng.randrange(len(words)), w)
        rows.append((n, " ".join(words), "en", f"s{i % 3}"))
        labels.append((n, 1, int(toxic)))
        n += 1
        if i % 9 == 0:  # an exact copy and a near one
            rows.append((n, " ".join(words).upper(), "en", "s1"))
            rows.append((n + 1, " ".join([*words[:-1], "changed"]), "en", "s2"))
            labels += [(n, 1, int(toxic)), (n + 1, 1, int(toxic))]
            n += 2
        if i % 20 == 1:
            rows.append((n, " ".join([*rng.sample(calm, 30), TEN, *rng.sample(calm, 5)]), "en", "s0"))
            labels.append((n, 1, 0))
            n += 1
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(spark, documents, tmp_path_factory):
    rows, labels = corpus()
    folder = tmp_path_factory.mktemp("corpus")
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, TEN), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def plain_tokens(texts):
    """{(doc_id, ids)} counted, of (doc_id, text)."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in texts]
    return Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)


def test_stages_and_run(spark, documents, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    toxicity, near, decontamination, mixing, tokens = (stage for _, stage in corpus_pipeline.STAGES)
    rows, labels = corpus()
    bad = {d for d, _, toxic in labels if toxic}
    docs = documents(rows)

    kept = toxicity(spark, docs, sf_dir)
    assert kept.columns == COLUMNS
    left = {r.doc_id: r.text for r in kept.collect()}
    clean = {r[0] for r in rows} - bad
    assert len(clean & set(left)) >= 0.98 * len(clean) and len(bad & set(left)) <= 0.05 * len(bad)

    docs = documents([r for r in rows if r[0] in left])
    groups = brute([(r[0], r[1]) for r in rows if r[0] in left])
    kept = near(spark, docs, sf_dir)
    left = {r.doc_id for r in kept.collect()}
    assert kept.columns == COLUMNS and left == set(groups.values())

    docs = documents([r for r in rows if r[0] in left])
    kept = decontamination(spark, docs, sf_dir)
    left = {r.doc_id for r in kept.collect()}
    assert kept.columns == COLUMNS and left == {r[0] for r in rows if r[0] in set(groups.values()) and not plain_contamination(r[1], [(1, TEN)])[4]}

    final = [r for r in rows if r[0] in left]
    mixed = mixing(spark, documents(final), sf_dir)
    taken = mixed.collect()
    assert mixed.columns == COLUMNS and {r.doc_id for r in taken} <= left and max(Counter(r.doc_id for r in taken).values()) <= 3
    size = lambda rs: {s: sum(len(t.split()) for t, x in rs if x == s) for s in ("s0", "s1", "s2")}
    targets, said = plain_targets(size([(r[1], r[3]) for r in final])), size([(r.text, r.source) for r in taken])
    assert all(abs(said[s] - targets[s]) <= 60 for s in targets)

    out = tokens(spark, spark.createDataFrame(taken, SCHEMA), sf_dir).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == plain_tokens([(r.doc_id, r.text) for r in taken])

    ran = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in ran) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out)
    assert [r.start for r in ran] == [0, *np.cumsum([r.n_tokens for r in ran])[:-1].tolist()]


def test_stages_on_odd_rows(spark, documents, sf_dir):
    rows = [*ODD, (None, "a row without a number"), (None, None), (20, f"x {TEN} y", "en", None)]
    docs = documents(rows)
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, documents([])):
            out = stage(spark, df, sf_dir)
            got = out.collect()
            if name != "token_files":
                assert out.columns == COLUMNS
            ids = Counter(r.doc_id for r in got)
            if df is not docs:
                assert not got
            elif name in ("toxicity", "token_files"):
                assert len(got) == len(rows)
            elif name == "decontamination":
                assert ids == Counter(r[0] for r in rows if r[0] != 20)
            elif name == "near_duplicates":
                assert ids == Counter(r[0] for r in rows if r[0] != 7)  # 6 and 7 are copies; rows of one doc_id are one document
            else:
                assert {1, 2, None} <= set(ids)
