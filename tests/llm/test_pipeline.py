"""The pipeline on a small corpus: each stage against brute force over what the stage before has left."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import bpe
from tests.llm.test_operators import components_by_force, removed_by_force, split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, k0 int, kept boolean, single string, row string"


def corpus():
    """Clean texts, toxic ones, junk, copies exact and near, a shared passage, nulls, ids that repeat, columns with names that clash."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["an", "ion", "or", "st", "re", "lu", "ma", "te"]) for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    texts, labels = [], []
    for i in range(420):
        w = [word() for _ in range(rng.randint(70, 140))]
        toxic = i % 7 == 0
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["zorgish", "blarghed"])
        if i % 10 == 3:
            w[20:20] = passage
        texts.append(" ".join(w))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[20 + i]) for i in range(8)]  # copies
    rows += [(1100 + i, texts[40 + i] + " and more") for i in range(8)]  # near copies
    rows += [(1, texts[1]), (5, texts[33]), (5, "of its own " + texts[34][:300] + " " + " ".join(word() for _ in range(80))), (None, texts[50]), (None, None), (2000, None), (2001, ""), (2002, "# $ % " * 60), (2003, "again and again " * 50)]
    return [(d, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), None if t is None else len(t), f"score{d}", None, d and d % 5, None, "x", None) for d, t in rows], labels


def toxic(text):
    return "zorgish" in (text or "") or "blarghed" in (text or "")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = out[name] = spark.read.parquet(f"{at}/{name}")
    out["at"] = at
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]


def test_quality_and_toxicity(stages):
    before, judged, clean = (Counter(map(tuple, stages[n].collect())) for n in ("documents", "quality_rules", "toxicity"))
    assert not judged - before and not clean - judged and stages["toxicity"].schema == stages["documents"].schema
    short = [r for r in before if len(split(r[1])) < 50]
    assert short and not any(r in judged for r in short) and sum(judged.values()) > 0.9 * sum(n for r, n in before.items() if r not in short)
    assert not any(toxic(r[1]) for r in clean)
    lost = [r for r in (judged - clean) if not toxic(r[1])]
    assert len(lost) <= 0.02 * len(judged), lost[:3]


def test_near_duplicates(stages):
    before, after = stages["toxicity"].collect(), Counter(map(tuple, stages["minhash_near_dedup"].collect()))
    # rows as documents of their own: those without an id link with nothing
    order = sorted((r for r in before if r.doc_id is not None), key=lambda r: r.doc_id)
    numbered = [type("Row", (), {"doc_id": i, "text": r.text})() for i, r in enumerate(order)]
    groups = {}
    for i, _, component in components_by_force(numbered, 5, 80):
        groups.setdefault(component, []).append(order[i])
    assert any(len(g) > 1 for g in groups.values())
    assert sum(after.values()) == len(groups) + sum(r.doc_id is None for r in before)
    for members in groups.values():  # one of each group stays, with the smallest id
        kept = [r for r in set(map(tuple, members)) if r in after]
        assert len(kept) == 1 and kept[0][0] == min(r.doc_id for r in members)
    assert all(after[tuple(r)] for r in before if r.doc_id is None)


def test_repeated_passages(stages):
    before, after = stages["minhash_near_dedup"].collect(), stages["substring_dedup"].collect()
    want = Counter((d, n - gone) for d, n, gone, _ in removed_by_force(before))
    assert Counter((r.doc_id, len(split(r.text))) for r in after) == want
    assert stages["substring_dedup"].schema == stages["documents"].schema
    assert sum(gone for *_, gone, _ in removed_by_force(before)) > 500
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None and (r.doc_id or 0) < 1000)
    other = lambda rows: Counter((r.doc_id, r.lang, r.source, r.score, r.k0, r.single) for r in rows)
    assert other(before) == other(after)


def test_packing_and_the_whole_run(spark, stages):
    c = bpe.codec(bpe.default_path())
    sizes = Counter()
    for r in stages["substring_dedup"].collect():
        ids = c.encode([(r.text or "").encode()])[0] + b"\2\0\0\0"
        sizes[r.doc_id, len(ids) // 4, zlib.crc32(ids)] += 1
    packed = stages["best_fit_packing"].collect()
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in packed if r.length < 1024) <= sizes and sum(r.length for r in packed) == sum(n * k for (_, n, _), k in sizes.items())
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    whole = corpus_pipeline.run(spark, stages["at"])
    assert Counter(tuple(r[k] for k in columns) for r in whole.collect()) == Counter(tuple(r[k] for k in columns) for r in packed)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
