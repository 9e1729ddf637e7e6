"""The operators against brute force, on small fixtures with nulls, ties, repeated rows, empty and long texts."""

import hashlib
import random
import re
import struct
import sys
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, licences, minhash, packing, quality, resampling, spotsigs, substring, toxicity, urls
from tessera.llm.bpe import default_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, single string, k0 int"


def word(rng):
    return "".join(rng.choice(["an", "the", "ion", "é", "ß", "or", "st", ".", "'s", "re"]) for _ in range(rng.randint(1, 5)))


def make(seed=1, n=60):
    rng = random.Random(seed)
    passage = " ".join(word(rng) for _ in range(70))
    rows = []
    for i in range(n):
        kind = i % 6
        text = " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else word(rng) for _ in range(rng.randint(1, 300)))
        if kind == 1:
            text = text + " " + passage + "\n" + text[: rng.randint(0, 200)]
        elif kind == 2 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 3 and rows and rng.random() < 0.8:
            base = (rng.choice(rows)[1] or "x").split()
            for _ in range(max(1, len(base) // 60)):
                base[rng.randrange(len(base))] = word(rng)
            text = " ".join(base)
        rows.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), len(text), "x", i))
    rows += [
        (1, None, None, None, None, None, None), (4, "", "en", "s0", 0, None, None), (7, " \n\t ", "en", "s0", 4, None, None), (10, "one", "en", "s0", 3, None, 1), (13, "one  two\n\n two", "en", "s0", 14, None, 1),
        (None, "no id " * 40, "en", "s0", 240, None, 1), rows[5], (16, "<|endoftext|> a  b　　c 'll  x<|endoftext|>", "en", "s0", 9, None, 1),
        (19, "A b c\x0bd e f\x1cg " * 400, "en", "s0", 6000, None, 1), (22, rows[1][1].upper(), "en", "s0", 0, None, 1), (25, passage + " " + passage, "en", "s1", 0, None, 1),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return WORD.findall((text or "").encode())


def key(d):
    return 2**63 if d is None else d


def test_bpe_is_the_library(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    got = sorted(bpe.round_trip(docs).collect(), key=lambda r: (key(r.doc_id), r.ids_sha256))
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (key(r[0]), r[2]))
    assert bpe.round_trip(empty).count() == 0
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    assert {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs.where("doc_id is not null"))).collect()} == texts


def test_bpe_on_odd_strings():
    c = bpe.codec(default_path())
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "'s", "'ll", ".", "…", "é", "à ", " ", "　", "  ", "😀", "1", "٣", "<|endoftext|>", "<|", "́", "ß", "\x85", "\x85 ", "\t", "中", "'t", "!", "\x1c "]
    for _ in range(5000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = c.tokenizer.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(c.encode([s.encode()])[0], "<u4").tolist() == ids, repr(s)
        assert c.decode(np.array(ids, dtype="<u4").tobytes()) == c.tokenizer.decode(ids, skip_special_tokens=False)


def test_packing(docs, empty):
    c = bpe.codec(default_path())
    out = packing.pack_documents(docs, per_partition=16).collect()
    want = Counter()
    for r in docs.collect():
        ids = c.encode([(r.text or "").encode()])[0] + struct.pack("<I", 2)
        want.update((r.doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.cut(len(ids) // 4, 1024)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    bound = packing.dual_bound(np.bincount([r.length for r in out], minlength=1025), 1024)
    whole = packing.pack_documents(docs).select("sequence_id").distinct().count()
    assert bound <= whole <= bound + 2 and whole <= len(by) <= 1.25 * bound
    assert packing.pack_documents(empty).count() == 0
    unique = docs.where("doc_id % 3 = 0").dropDuplicates(["doc_id"])
    seqs = packing.sequences(unique, packing.pack_documents(unique)).collect()
    assert sum(len(r.ids) for r in seqs) == sum(n for (d, *_, n, _), k in want.items() if d is not None and d % 3 == 0)


def test_dual_bound_never_exceeds_the_optimum():
    rng = random.Random(5)
    for _ in range(200):  # a packing without waste has as many bins as the bound may say
        sizes, bins = [], rng.randint(1, 9)
        for _ in range(bins):
            cuts = sorted(rng.sample(range(1, 100), rng.randint(0, 4)))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 100])]
        assert packing.dual_bound(np.bincount(sizes, minlength=101), 100) == bins
        assert packing.best_fit_decreasing(np.array(sizes), 100)[2] >= bins
    assert packing.dual_bound(np.bincount([51] * 7, minlength=101), 100) == 7


def removed_by_force(rows):
    seen, out = {}, []
    for r in rows:
        w = split(r.text)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            seen[k] = min(seen.get(k, (2**65, 0)), (key(r.doc_id), s))
    for r in rows:
        w, gone = split(r.text), set()
        for s in range(len(w) - 19):
            if seen[tuple(w[s : s + 20])] < (key(r.doc_id), s):
                gone.update(range(s, s + 20))
        out.append((r.doc_id, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=lambda r: (key(r[0]), r[3]))


def test_substring(docs, empty):
    got = [tuple(r)[:4] for r in substring.removed(docs).collect()]
    want = removed_by_force(docs.collect())
    assert sorted(got, key=lambda r: (key(r[0]), r[3])) == want
    assert sum(r[2] for r in want) > 1000
    assert substring.removed(empty).count() == 0
    new = substring.deduplicate(docs)
    assert new.columns == docs.columns and new.schema == docs.schema
    cut = {(r[0], r[3]) for r in want if r[2]}
    assert {(r.doc_id, hashlib.sha256(b" ".join(split(r.text))).hexdigest()) for r in new.collect()} >= cut
    assert substring.deduplicate(empty).count() == 0


def test_urls(spark):
    rows = [(1, "https://www.example.com/en/x?y"), (2, "http://a.example.com/en/1"), (3, "https://X.Example.net/es/3#t"), (4, None), (5, "no scheme"), (6, "http://spam-farm.example.org/fr/1"), (7, "http://a.com"), (8, "http://casino.org/"), (9, "http://a.org/click?x=1"), (None, "http://b.net/fr/"), (1, "https://www.example.com/en/x?y")]
    got = sorted((tuple(r)[:5] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()), key=str)
    want = [
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/1", "example.com/en/", "block"), (3, "x.example.net", "/es/3", "net/es/", "block"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "spam-farm.example.org", "/fr/1", None, "block"), (7, "a.com", "", None, "allow"), (8, "casino.org", "/", None, "block"), (9, "a.org", "/click", None, "block"), (None, "b.net", "/fr/", "net/fr/", "block"),
    ]
    assert got == sorted(want, key=str)
    assert urls.index_rules([(("a", "b"), "a.*b", "block")], {"a": 9, "b": 2}) == {"b": [0]}
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_quality(docs, empty):
    got = sorted((tuple(r)[:7] for r in quality.quality(docs).collect()), key=lambda r: (key(r[0]), r))
    want = []
    for r in docs.collect():
        t = r.text or ""
        w = [x.decode() for x in split(t)]
        grams = Counter(zip(w, w[1:], w[2:]))
        rep = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if split(x)]
        n = len(w)
        want.append((r.doc_id, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), n < 50 or 100 * len(rep) > 50 * n))
    assert got == sorted(want, key=lambda r: (key(r[0]), r))
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert kept.count() == quality.quality(docs).where("kept").count() > 20
    assert quality.quality(empty).count() == 0 and quality.filter_quality(empty).count() == 0


def shingles(text, size):
    w = [x.lower() for x in split(text)]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components_by_force(rows, size, percent):
    sets = {i: shingles(r.text, size) for i, r in enumerate(rows)}
    up = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if rows[i].doc_id is not None and rows[j].doc_id is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(rows[i].doc_id), find(rows[j].doc_id)))
            up[y] = x
    return sorted(((r.doc_id, len(sets[i]), find(r.doc_id)) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("size, threshold", [(3, 0.85), (5, 0.8)])
def test_minhash(docs, empty, size, threshold):
    got = minhash.near_duplicates(docs, size, threshold).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components_by_force(docs.collect(), size, round(100 * threshold))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(empty, size, threshold).count() == 0
    assert minhash.deduplicate(docs, size, threshold).schema == docs.schema


def test_deduplicate_with_repeated_ids(spark):
    base, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    near = base + " more"
    rows = [(1, base, "x"), (2, near, "x"), (2, other, "x"), (3, third, "x"), (3, third, "x"), (3, third, "y"), (4, "", "x"), (4, None, "x"), (None, base, "x"), (None, base, "x"), (5, third.upper(), "x"), (6, "some words of its own here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = minhash.deduplicate(df, 5, 0.8)
    want = [(1, base, "x"), (2, other, "x"), (3, third, "x"), (4, "", "x"), (4, None, "x"), (None, base, "x"), (None, base, "x"), (6, "some words of its own here", "x")]
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_minhash_chain_of_links(spark):
    rng, base = random.Random(9), [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):  # neighbours are alike, ends are not
        base[(i * 5) % 200 : (i * 5) % 200 + 5] = [f"x{rng.random()}" for _ in range(5)]
        rows.append((100 - i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df, 3, 0.85).collect()} == {61}


def test_signatures_estimate_the_likeness():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 100, 100))
    sig = minhash.signatures(np.concatenate([common, a, common, b]), np.array([400, 400]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.07
    few = minhash.signatures(np.array([5, 6, 7], dtype=np.uint64), np.array([2, 1, 0]), 64)
    assert (few[:2] >> np.uint64(52)).max() < 64 and len(set(few[1].tolist())) == 64 and (few[2] == 2**64 - 1).all()


def test_fingerprints(docs, empty, spark):
    rows = docs.collect()
    got = spotsigs.fingerprints(docs).collect()
    ordered = sorted(rows, key=lambda r: -key(r.doc_id))
    want = {}
    for i, r in enumerate(ordered):
        t, nxt = r.text or "", ordered[(i + 1) % len(ordered)].text or ""
        h = len(t) // 2
        want.setdefault(r.doc_id, set()).add((len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    assert len(got) == len(rows) and all((r.n_chars, r.edited_sha256) in want[r.doc_id] for r in got)
    text = {r.doc_id: r.text for r in rows}
    prints = {}
    for r in got:
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert prints.setdefault(text[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert spotsigs.fingerprints(empty).count() == 0
    one = spotsigs.fingerprints(spark.createDataFrame([(5, "the cat of dogs")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_chains_of_the_whole_list_of_anchors(spark):
    assert len(set(spotsigs.ANCHORS)) == 162
    rng = random.Random(3)
    some = ["was", "with", "für", "nicht", "pour", "être", "más", "donde", "the", "a", "cat", "Dog", "Haus", "l'eau", "x9", "-", "...", "été", "THEIR"]
    texts = [None, "", " ", "the", "the of", "cat", "cat was dog", "was cat", "?was the cat. Dog!", *(" ".join(rng.choices(some, k=rng.randint(1, 40))) for _ in range(200))]

    def plain(t):
        words = re.findall(r"[^\W_]+", (t or "").lower())
        content = [(w, i > 0 and words[i - 1] in spotsigs.ANCHORS) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
        return {f"{w} {content[i + 1][0] if i + 1 < len(content) else ''}" for i, (w, after) in enumerate(content) if after} or {t or ""}

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    number = lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF))
    want = spark.createDataFrame([(i, sorted(plain(t))) for i, t in enumerate(texts)], "doc_id int, c array<string>").select("doc_id", F.sort_array(F.transform("c", number)).alias("want"))
    for r in df.select("doc_id", spotsigs.chains(F.col("text")).alias("got")).join(want, "doc_id").collect():
        assert r.got == r.want, texts[r.doc_id]
    assert "INSET" in df.select(spotsigs.chains(F.col("text")))._jdf.queryExecution().optimizedPlan().toString().upper()


def test_buckets_of_the_order(spark):
    df = spark.range(0, 500, 3).selectExpr("id doc_id", "cast(id as string) text")
    from tessera.llm.common import keyed

    rows = spotsigs.in_order(keyed(df).drop("_tag"), per_bucket=20).where("not copy").orderBy("doc_id").collect()
    assert [r.bucket for r in rows] == sorted(r.bucket for r in rows) and len({r.bucket for r in rows}) > 5


def test_near_pairs(docs):
    member, pairs = spotsigs.near_pairs(docs, 0.8)
    sets = {r.doc_id: frozenset(r.c) for r in docs.where("doc_id is not null").select("doc_id", spotsigs.chains(F.col("text")).alias("c")).collect()}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    assert {(r.doc_id, r["class"]) for r in member.collect()} == {(d, first[s]) for d, s in sets.items()}
    want = {frozenset((first[a], first[b])) for a, b in combinations(first, 2) if len(a & b) >= 0.8 * len(a | b)}
    assert {frozenset((r.a, r.b)) for r in pairs.collect()} == want and want
    links = Counter(c for pair in want for c in pair)
    assert {(r.doc_id, r["class"], r.n_links) for r in spotsigs.near_classes(docs, 0.8).collect()} == {(d, first[s], links[first[s]]) for d, s in sets.items()}


def test_toxicity(spark, empty):
    rng = random.Random(4)
    bad = ["zorgish", "zorgful", "zorgness", "blarghed"]
    rows, labels = [], []
    for i in range(1500):
        w, toxic = [word(rng) for _ in range(rng.randint(20, 90))], int(rng.random() < 0.15)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    rows += [(None, "the"), (2000, None), (2001, "")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(df, lab).collect()
    truth = {d: t for d, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out) and len(out) == len(rows)
    kept = toxicity.reject_toxic(df.withColumn("score", F.lit("x")), lab)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(r.predicted == 0 for r in out)
    assert toxicity.toxicity(empty, lab).count() == 0
    assert {r.score < 1e-6 for r in toxicity.toxicity(df, lab.limit(0)).collect()} == {True}


def test_resampling(spark, docs, empty):
    labels = spark.createDataFrame([(i * 3, int(i % 4 > 0), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    rows = resampling.resample(docs, labels).collect()
    k = round(37 / 50 * docs.count())
    cut = sorted((r.key for r in rows), reverse=True)[k - 1]
    assert all(r.kept == (r.key >= cut) for r in rows) and k <= sum(r.kept for r in rows) <= k + 1
    counts = resampling.models(docs, {0, 3})
    assert counts[0].sum() == sum(max(0, 2 * len(split(r.text)) - 1) for r in docs.collect())
    assert resampling.resample(empty, labels).count() == 0
    wide = spark.range(5000).selectExpr("cast(hash(id) as double) key")
    values = sorted((r.key for r in wide.collect()), reverse=True)
    assert [resampling.kth_largest(wide, "key", k, most=50) for k in (1, 77, 4000, 5000)] == [values[k - 1] for k in (1, 77, 4000, 5000)]
    tied = spark.range(3000).selectExpr("cast(id % 2 as double) key")
    assert [resampling.kth_largest(tied, "key", k, most=50) for k in (1, 1500, 1501)] == [1.0, 1.0, 0.0]


def test_licences(spark, empty):
    rows = [(1, "words\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, "the license of version is public"), (4, None), (5, ""), (6, "x Licensed under the Apache License, Version 2.0. y\nReleased under the MIT License."), (7, "This work is licensed under the GNU General Public License, version 3."), (8, "Licensed drivers may obtain the copy of a public version")]
    got = {r.doc_id: (r.n_licences, r.families) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, "mit"), 2: (1, "cc-by-nc"), 3: (0, ""), 4: (0, ""), 5: (0, ""), 6: (2, "apache-2.0,mit"), 7: (1, "gpl-3.0"), 8: (0, "")}
    assert licences.scan(empty).count() == 0


def test_licences_over_lines(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    apache, mit = "Licensed under the Apache\nLicense, Version 2.0.", "Permission is hereby\ngranted, free of charge,\nto any person\nobtaining a copy\nof this software"
    noise = " ".join(f"w{i}" for i in range(300))
    want = {
        gpl: (1, "gpl-3.0"), gpl.replace("\n", "\r\n"): (1, "gpl-3.0"), "# " + gpl.replace("\n", "\n#   "): (1, "gpl-3.0"), apache: (1, "apache-2.0"), mit: (1, "mit"), f"{apache}\n{apache}": (2, "apache-2.0"),
        f"{noise} {apache} {noise}": (1, "apache-2.0"), f"{noise}\n{gpl}\n{noise}\n\n{mit}\n{noise}": (2, "gpl-3.0,mit"), f"{apache}\nReleased under the MIT License.\n{apache}": (3, "apache-2.0,mit"),
        apache.replace("\n", "\n\n"): (0, ""), "CC BY 4.0": (1, "cc-by"), f"{noise}\n{noise}": (0, ""), "the general\npublic may obtain\na copy": (0, ""),
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    texts = list(want)
    assert {texts[r.doc_id]: (r.n_licences, r.families) for r in licences.scan(df).collect()} == want
    # the gate never drops what overlaps enough
    model, rng = licences.train(), random.Random(5)
    for t in (t for family in model["pairs"].values() for t in family):
        need = licences.needed(len(t))
        assert all(set(rng.sample(t, need)) & set(model["gate"]) for _ in range(200))


@pytest.mark.parametrize("bits", [None, 54, 60])
def test_repeated_words_with_equal_hashes(spark, bits):
    rng = random.Random(11)
    texts = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 200))] for _ in range(40)]

    def force(w):
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}) if len(w) > 3 else 0

    df = spark.createDataFrame(list(enumerate(texts)), "i int, w array<string>").select("i", quality.repeated_words(F.col("w"), F.size("w"), bits).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: force(w) for i, w in enumerate(texts)}


#: Notices in other words than the templates', and texts that speak of licences without being one.
PARAPHRASES = [
    ("MIT License", "mit"), ("Licence MIT", "mit"), ("This project is available under the MIT license; see LICENSE.", "mit"), ("(c) 2019 A. Person. MIT licensed.", "mit"), ("License: MIT (see below)", "mit"), ("Code under the MIT licence, docs elsewhere", "mit"),
    ("Permission is granted hereby, free of charge, to any person obtaining a copy of the software", "mit"), ("The copyright notice above and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("ISC License", "isc"), ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that", "isc"),
    ("Apache License 2.0", "apache-2.0"), ("Distributed under Apache License, Version 2.0 (the license)", "apache-2.0"), ("Unless required by applicable law or agreed to in writing, this software is distributed on an AS IS BASIS", "apache-2.0"), ("# you may not use these files except in compliance with the License.", "apache-2.0"),
    ("GNU General Public License v2", "gpl-2.0"), ("see the GNU General Public License, version 2, for details", "gpl-2.0"), ("GNU General Public License v3 or later", "gpl-3.0"), ("This program is free software; you may redistribute it under the terms of the GNU General Public License", "gpl-3.0"),
    ("This program is distributed in the hope it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of fitness", "gpl"), ("You should have got a copy of the GNU General Public License along with this program.", "gpl"),
    ("Covered by the GNU Lesser General Public License, 2.1", "lgpl"), ("GNU Affero General Public License v3", "agpl-3.0"), ("BSD 3-Clause License", "bsd"), ("new BSD license text follows", "bsd"), ("Redistribution and use in source or binary forms, with or without modification, is permitted", "bsd"),
    ("Redistributions of source code must keep the above copyright notice, this list of conditions and the following disclaimer.", "bsd"), ("Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived", "bsd"),
    ("This code is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("Eclipse Public License 2.0", "epl-2.0"), ("This is unencumbered and free software released into the public domain.", "public-domain"), ("CC0 1.0 applies", "public-domain"),
    ("Photo under CC BY 4.0.", "cc-by"), ("text: CC BY-SA 3.0", "cc-by-sa"), ("CC BY-NC 4.0 (no shops)", "cc-by-nc"), ("Licensed under the Creative Commons Attribution-ShareAlike 4.0 International licence", "cc-by-sa"),
    ("Copyright 2020 The Firm. All rights reserved.", "proprietary"), ("Proprietary and confidential - do not share", "proprietary"),
]
PLAIN = [
    "A fishing licence is needed in the public parks of the city.", "He studied at MIT and took a license to drive.", "The Apache people lived there; version 2.0 of the map shows it.", "The general public may obtain a copy of the report free of charge.", "Permission to enter is granted to any person with a ticket.",
    "Without any warranty of success he went on.", "The rights of the author were reserved for all time.", "The software is free and the source is open, they say.", "This work is licensed to no one.", "The eclipse was seen by the public; no license was required.", "creative people share common ground", "redistribution of wealth in source countries",
]


def test_licences_in_other_words(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PARAPHRASES)] + [(1000 + i, t) for i, t in enumerate(PLAIN)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan(df).collect()}
    missed = [(t, f, got[i]) for i, (t, f) in enumerate(PARAPHRASES) if got[i] != f]
    assert len(missed) <= len(PARAPHRASES) // 10, missed
    assert not [t for i, t in enumerate(PLAIN) if got[1000 + i]]


def test_licences_of_long_and_repeated_rows(spark):
    line = "word " * 200_000 + "Released under the MIT License. " + "word " * 10
    rows = [(1, line, "x"), (1, line, "x"), (None, "MIT License", "y")]
    got = [tuple(r)[:3] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, families string")).collect()]
    assert sorted(got, key=str) == [(1, 1, "mit"), (1, 1, "mit"), (None, 1, "mit")]


def test_fingerprints_by_force(spark):
    """Every column against plain Python, over texts of four languages, empty ones, a long one and one without anchors."""
    rng = random.Random(8)
    some = [*rng.sample(spotsigs.ANCHORS, 30), *(word(rng) for _ in range(80)), "Été,", "l'eau", "!!"]
    texts = [None, "", "x", "cat dog", *(" ".join(rng.choices(some, k=rng.randint(1, 150))) for _ in range(60)), " ".join(rng.choices(some, k=30_000))]
    texts[7] = texts[8]
    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(texts)]

    def chains(t):
        words = re.findall(r"[^\W_]+", t.lower())
        content = [(w, i > 0 and words[i - 1] in spotsigs.ANCHORS) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
        found = {f"{w} {content[i + 1][0] if i + 1 < len(content) else ''}" for i, (w, after) in enumerate(content) if after} or {t}
        return {xxhash.xxh64_intdigest(c.encode(), seed=42) & 0xFFFFFFFF for c in found}

    show = lambda c: "".join(f"{x:08x}" for x in sorted(c))
    near = lambda a, b: len(a & b) / len(a | b)
    want, ordered = {}, sorted(rows, reverse=True)
    for i, (d, t, _) in enumerate(ordered):
        t, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = chains(t), chains(edited), chains(after)
        want[d] = (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), near(a, b), near(a, c))
    got = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, chains string")).collect()
    assert {r.doc_id: tuple(r) for r in got} == want


def test_quality_thresholds_by_force(spark):
    """kept of every row against exact quantiles: groups small enough that their sketches are exact, with nulls among them."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        kind = rng.choice([("en", "web"), ("en", "web"), ("en", "book"), ("de", "web"), (None, "web"), ("de", None)])
        w = [word(rng) + str(rng.randrange(10**6)) for _ in range(rng.randint(50, 90))]
        if rng.random() < 0.2:
            w[:20] = ["###"] * rng.randint(1, 20)
        if rng.random() < 0.2:
            w += w[:6] * rng.randint(1, 3)
        rows.append((i, " ".join(w) + ("\nsame line" * rng.randint(1, 9) if rng.random() < 0.2 else ""), *kind))
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    value = {"symbols_per_word": lambda r: r.n_symbols / r.n_words, "dup_lines_per_word": lambda r: r.n_dup_lines / r.n_words, "repeats_per_word": lambda r: r.n_repeat_words / r.n_words, "chars_per_word": lambda r: r.word_chars / r.n_words}

    def most(m, lang, source):
        good = [(lang_, source_, value[m](out[i])) for i, _, lang_, source_ in rows if not out[i].base_failed]
        levels = [[v for a, b, v in good if (a, b) == (lang, source)], [v for a, _, v in good if a == lang], [v for *_, v in good]]
        rank = lambda v, q: sorted(v)[max(0, int(np.ceil(q * len(v) - 1e-9)) - 1)]
        q = {}
        for at in (0.25, 0.75):
            x = rank(levels[2], at)
            for v in (levels[1], levels[0]):
                x = (rank(v, at) * len(v) + x * quality.LEAN) / (len(v) + quality.LEAN)
            q[at] = x
        return q[0.75] + quality.FENCE * max(q[0.75] - q[0.25], quality.MEASURES[m])

    for i, _, lang, source in rows:
        r = out[i]
        assert r.kept == (not r.base_failed and all(value[m](r) <= most(m, lang, source) + 1e-12 for m in value)), i
    assert 10 < sum(not r.kept for r in out.values()) < 100


def test_quality_sketches_of_large_groups(spark):
    rng = random.Random(13)
    rows = [(rng.choice("ab"), "s", 100, 0, 0, 0, rng.randrange(40, 900), False) for _ in range(6000)]
    df = spark.createDataFrame(rows, "_lang string, _source string, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long, word_chars long, base_failed boolean").repartition(7)
    for r in quality.thresholds(df).collect():
        v = sorted(x[6] / 100 for x in rows if x[0] == r._lang)
        low, high = (lambda d: v[int(len(v) * (0.75 + d))] + quality.FENCE * max(v[int(len(v) * (0.75 + d))] - v[int(len(v) * (0.25 - d))], quality.MEASURES["chars_per_word"]))(-0.03), (lambda d: v[int(len(v) * (0.75 + d))] + quality.FENCE * max(v[int(len(v) * (0.75 + d))] - v[int(len(v) * (0.25 - d))], quality.MEASURES["chars_per_word"]))(0.03)
        assert low <= r.most_chars_per_word <= high


def test_repeated_words_of_a_very_long_text(spark):
    rng = random.Random(14)
    w = [f"w{rng.randrange(3000)}" for _ in range(120_000)]
    n = Counter(zip(w, w[1:], w[2:]))
    want = len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)})
    r = quality.quality(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert (r.n_words, r.n_repeat_words) == (120_000, want)


def test_resampling_weights_by_force(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice(["aa", "Bb", "cc", "dd", "é"]) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(None, "aa Bb"), (3, "cc"), (50, None)]
    good = {i for i in range(0, 40, 3)}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(40)], "doc_id long, quality int, toxic int")

    def grams(t):
        h = [xxhash.xxh64_intdigest(w.encode(), seed=17) for w in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()]
        pairs = [(a + (0x8CB92BA72F3D8DD7 | 1) * b) % 2**64 for a, b in zip(h, h[1:])]
        return [x % resampling.BUCKETS for x in [*h, *resampling.mix(np.array(pairs, dtype=np.uint64)).tolist()]]

    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    for d, t in rows:
        for b in grams(t):
            raw[b] += 1
            target[b] += d in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted(((-1 if d is None else d), round(sum(ratio[b] for b in grams(t)), 9)) for d, t in rows)
    out = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, share=0.5).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), round(r.log_weight, 9)) for r in out) == want
    noise = np.array([r.key - r.log_weight for r in out])
    assert sum(r.kept for r in out) >= round(0.5 * len(rows)) and np.isfinite(noise).all()
    many = resampling.weigh(spark.range(20_000).selectExpr("id doc_id", "'' text"), np.zeros(resampling.BUCKETS), 1).toPandas()["key"]
    assert abs(many.mean() - 0.5772) < 0.05 and abs(many.var() - np.pi**2 / 6) < 0.1  # the standard Gumbel distribution


def test_risk_and_its_gradient():
    """The gradients against finite differences, and the corrected risk against its formula, also where it is negative."""
    rng = np.random.default_rng(3)
    p, u = (rng.random((30, 6)) < 0.5).astype(float), (rng.random((80, 6)) < 0.3).astype(float)
    soft = lambda z: np.log1p(np.exp(z))
    for _ in range(20):
        w, prior = rng.normal(size=7) * 3, rng.uniform(0.05, 0.6)
        positive, negative, gp, gn = toxicity.risk(w, p, u, prior)
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        assert np.isclose(positive, prior * soft(-zp).mean()) and np.isclose(negative, soft(zu).mean() - prior * soft(zp).mean())
        for k in range(7):
            d = np.zeros(7)
            d[k] = 1e-5
            up, down = toxicity.risk(w + d, p, u, prior), toxicity.risk(w - d, p, u, prior)
            assert np.isclose((up[0] - down[0]) / 2e-5, gp[k], atol=1e-6) and np.isclose((up[1] - down[1]) / 2e-5, gn[k], atol=1e-6)
    assert toxicity.risk(np.array([5.0] * 6 + [-10]), np.ones((3, 6)), np.zeros((3, 6)), 0.5)[1] < 0


@pytest.mark.parametrize("share", [0.02, 0.1, 0.3])
def test_class_prior_is_found_without_negatives(share):
    rng = np.random.default_rng(4)
    positive = lambda n: np.hstack([rng.random((n, 4)) < 0.7, rng.random((n, 20)) < 0.1]).astype(np.float32)
    other = lambda n: np.hstack([rng.random((n, 4)) < 0.01, rng.random((n, 20)) < 0.1]).astype(np.float32)
    n = 4000
    u = np.vstack([positive(int(n * share)), other(n - int(n * share))])
    rng.shuffle(u)
    assert abs(toxicity.class_prior(positive(600), u) - share) < 0.03


def test_toxicity_keeps_every_column(spark):
    bad, rows, labels = ["zorgish", "zorgful"], [], []
    rng = random.Random(21)
    for i in range(600):
        w = [word(rng) + str(rng.randrange(50)) for _ in range(30)]
        if i % 6 == 0:
            w[rng.randrange(30)] = rng.choice(bad)
            w[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(w), f"orig{i}", "p", i, None))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1, "other text of the same id", "again", "p", 1, None), (None, None, "null", "p", 1, None), (7, rows[7][1], "orig7", "p", 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string, k0 int, kept boolean")
    out = toxicity.reject_toxic(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.schema == df.schema
    got, clean = Counter(map(tuple, out.collect())), Counter(tuple(r) for r in rows if not (r[2].startswith("orig") and r[4] % 6 == 0))
    assert not got - Counter(rows) and sum((clean - got).values()) < 5 and sum((got - clean).values()) < 5


def test_substring_of_long_texts_and_many_null_ids(spark):
    rng = random.Random(41)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    rows = [(5, " ".join(long), "a"), (6, " ".join(long[50_000:50_030]), "b"), (7, None, "c"), (7, "", "c")]
    rows += [(None, " ".join(f"n{rng.randrange(10**6)}" for _ in range(30)), "d") for _ in range(300)] + [(None, " ".join(long[100:140]), "e"), (None, " ".join(long[100:140]), "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, single string").repartition(5)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.removed(df).collect())
    assert got == Counter({(5, 120_000, 0): 1, (6, 30, 30): 1, (7, 0, 0): 2, (None, 30, 0): 300, (None, 40, 40): 2})
    back = substring.deduplicate(df)
    assert back.schema == df.schema and Counter(r.single for r in back.collect()) == Counter(r[2] for r in rows)


def words_of_any_length(rng):
    """Words of 1 to 140 bytes that differ in one byte at most from others of their length, also in bytes of zero."""
    n = rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 140])
    w = bytearray(b"a" * n)
    if rng.random() < 0.3:
        w[rng.choice([0, n // 2, n - 1])] = rng.choice(b"\x00\x1cb")
    return w.decode()


def test_substring_tells_words_of_any_length_apart(spark):
    rng = random.Random(47)
    rows = []
    for i in range(60):
        base = re.findall(r"[^\x20\x09-\x0D]+", rng.choice(rows)[1]) if rows and i % 3 else [words_of_any_length(rng) for _ in range(90)]
        for _ in range(i % 3):  # copies but for a word or two, some of which differ in their last byte alone
            at = rng.randrange(len(base))
            base[at] = base[at][:-1] + "c" if rng.random() < 0.5 else base[at] + "\x00"
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t\x0b", "\r\n\x0c"]) for w in base)))
    rows += [(60, rows[0][1].strip()), (61, "\n" + rows[1][1] * 3), (62, " "), (63, None)]
    twins = [(2, rows[3][1]), (2, "an other text of this id " + rows[4][1]), (None, rows[5][1])]
    both = spark.createDataFrame(rows + twins, "doc_id long, text string").repartition(4)
    got = [tuple(r)[:4] for r in substring.removed(both).collect()]
    assert sorted(got, key=lambda r: (key(r[0]), r[3])) == removed_by_force(both.collect())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = substring.removed(df).collect()
    want = removed_by_force(df.collect())
    assert sorted((tuple(r)[:4] for r in out), key=lambda r: r[0]) == want and 1000 < sum(r[2] for r in want)
    for r in out:
        assert all(a < b <= r.n_words for a, b in zip(r.spans[::2], r.spans[1::2]))
        assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed
    words, spans = {i: [w.decode() for w in split(t)] for i, t in rows}, {r.doc_id: r.spans for r in out}
    for r in substring.deduplicate(df).collect():
        gone = {k for a, b in zip(spans[r.doc_id][::2], spans[r.doc_id][1::2]) for k in range(a, b)}
        assert r.text == (" ".join(w for k, w in enumerate(words[r.doc_id]) if k not in gone) if gone else dict(rows)[r.doc_id])


def test_substring_marks_leave_out_what_is_single_however_rows_are_dealt():
    rng = random.Random(53)
    for _ in range(60):
        texts = [b" ".join(b"w%d" % rng.randrange(50) for _ in range(rng.choice([0, 5, 19, 20, 21, 40, 300]))) for _ in range(rng.randint(1, 9))]
        p = substring.Parsed(texts)
        single = [[int(x) for x, d in zip(p.low.view(np.int64), p.low_doc) if d == r and rng.random() < 0.6] or rng.choice([None, []]) for r in range(len(texts))]
        marks = substring._marks(p, pa.array(single, pa.list_(pa.int64())))
        assert sum(map(len, marks.to_pylist())) <= len(p.low) / 8 + len(texts)
        runs = np.cumsum(p.new) - 1  # of blocks that share an anchor
        want = [int(a) for a, k in zip(p.at, runs) if int(p.low.view(np.int64)[k]) not in (single[p.doc[a]] or [])]
        assert substring._open(p, marks).tolist() == want
        alone = [(substring._open(substring.Parsed([t]), marks.slice(r, 1)) + p.starts[r]).tolist() for r, t in enumerate(texts)]
        assert sum(alone, []) == want


def test_substring_calls_nothing_for_each_word():
    """Rare words fill no memory of hashes: what is done for each word and block is done for all of a batch at once."""

    class Plan:  # hands back what would run in the executors
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run

    texts = [" ".join(f"w{i * 500 + k}" for k in range(500)) for i in range(100)]
    marks = pa.array([b"\xff" * 100] * len(texts), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)), pa.int64()), marks], names=["text", "_key", "open"])
    for work in (substring._anchors, substring._candidates):
        calls, run = Counter(), work(Plan())
        sys.setprofile(lambda frame, event, arg: calls.update([event]))
        try:
            out = list(run(iter([batch])))
        finally:
            sys.setprofile(None)
        assert sum(b.num_rows for b in out) > 5000
        assert calls["call"] + calls["c_call"] < 10_000, calls  # of 50,000 words


def test_urls_of_odd_shapes(spark):
    long = "http://a.example.net/es/" + "x" * 300_000
    rows = [(1, long, "r"), (2, "HTTP://Example.COM?a=://b.net/fr/", "r"), (3, "://", "r"), (4, "://net/es/", "r"), (5, "x://fr.net/fr/#", "r"), (6, "http://com/", "r"), (7, "http://notcom/", "r"), (8, "", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path[:8], r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got == {1: ("a.example.net", "/es/xxxx", "net/es/", "block"), 2: ("example.com", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("net", "/es/", "net/es/", "block"), 5: ("fr.net", "/fr/", "net/fr/", "block"), 6: ("com", "/", "com/", "allow"), 7: ("notcom", "/", None, "allow"), 8: ("", "", None, "allow")}
    equal = [("b.org/x/", "block"), ("a.org/x/", "allow")]  # as long as each other: a url fits one of them at most
    two = spark.createDataFrame([(1, "http://a.org/x/"), (2, "http://b.org/x/"), (3, "http://c.b.org/x/y")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(two, equal, []).collect()} == {1: "allow", 2: "block", 3: "block"}


def test_packing_of_a_very_long_text_and_clashing_columns(spark):
    rows = [(1, "one two three " * 60_000, 9, "g"), (2, "", 9, "g"), (2, "", 9, "g"), (None, None, 9, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, group string")
    out = packing.pack_documents(df).collect()
    mine = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 1)
    assert len(mine) > 100 and [p for p, *_ in mine] == list(range(len(mine))) and all(a[1] + a[2] == b[1] for a, b in zip(mine, mine[1:])) and {n for _, _, n in mine[1:]} == {1024}
    assert sorted((r.doc_id, r.length) for r in out if r.doc_id == 2) == [(2, 1), (2, 1)] and [r.length for r in out if r.doc_id is None] == [1]


def test_fingerprints_of_repeated_ids(spark):
    rows = [(3, "the cat of dogs and men", "x"), (3, "the cat of dogs and men", "x"), (3, "other words of the day", "x"), (None, "the end of it", "x"), (None, "the end of it", "x")]
    out = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    assert Counter((r.doc_id, r.n_chars) for r in out) == Counter((d, len(t)) for d, t, _ in rows)
    assert len({r.fingerprint for r in out}) == 3
