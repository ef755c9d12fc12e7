"""Operators on Spark against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
import zlib
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from llm.brute import DOCS, FOLD, ODD, components, digest, edits_within, families, frame, prose, removed
from pyspark.sql import functions as F

from tesselle.llm import components as links
from tesselle.llm import decontamination, hashing, jaccard, license_scan, packing, quality, repeats, scratch, sharding, token_counts, tokens, topk, toxicity

PATH = tokens.public_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    """Families of copies, odd texts, a null id and repeated rows."""
    out = families()
    out += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "a null id has words too"), (None, None)]
    return out + [out[3], out[3], (1003, "one")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    scratch.prepare(spark)
    return frame(spark, rows).repartition(3).cache()


def test_shared_folder_is_the_sessions(spark):
    assert scratch.folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    expected = {x: find(x) for x in root if find(x) != x}
    got = links.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == expected and len(got) == len(expected)
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(rows, docs, size, percent):
    got = sorted(jaccard.linked(docs, size, percent).collect(), key=str)
    expected = sorted(((d, n, c) for (d, _), (n, c) in zip(rows, components(rows, size, percent), strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == expected
    assert len({c for _, n, c in expected if n > 9}) > 6


def test_links_beyond_the_first_star(spark):
    """Sets that share signatures with a smallest member they are not linked to, and chains of links."""
    rng, out = random.Random(5), []
    base = prose(rng, 150).split()
    for i in range(60):
        near = list(base)
        for _ in range(i % 9):
            near[rng.randrange(150)] = f"n{rng.randrange(9)}"
        out.append((i, " ".join(near)))
        base[rng.randrange(150)] = f"m{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(frame(spark, out)).collect()}
    assert [got[i] for i in range(60)] == components(out, 4, 85) and 1 < len({c for _, c in got.values()}) < 60


def test_groups_of_the_same_sets_stay_once(spark):
    groups = [(1, 10), (1, 11), (2, 10), (2, 11), (3, 10), (3, 11), (3, 12), (4, 11), (4, 12), (5, 12), (5, 11), (6, 10), (6, 12)]
    lead = {s: min(x for t, x in groups if t == s) for s, _ in groups}
    rows = spark.createDataFrame([(s, x, lead[s]) for s, x in groups], "sig long, sid long, lead long").repartition(3)
    got = {}
    for r in jaccard.distinct_groups(rows).collect():
        got.setdefault(r.sig, set()).add(r.sid)
        assert r.lead == lead[r.sig]
    assert got == {1: {10, 11}, 3: {10, 11, 12}, 4: {11, 12}, 6: {10, 12}}


def test_blocks_of_a_frequent_signature(spark, monkeypatch):
    """Each two rows of a signature meet once, however many blocks they are dealt to, and links are the same."""
    frequent = spark.range(50).select(F.lit(7).cast("long").alias("sig"), F.col("id").alias("sid"), F.lit(50).cast("long").alias("count"))
    met = {}
    for r in jaccard.in_blocks(frequent, 8).collect():
        met.setdefault(r.meet, []).append((r.block, r.sid))
    pairs = [tuple(sorted((x, y))) for own in met.values() for i, (a, x) in enumerate(own) for b, y in own[:i] if a != b or len({c for c, _ in own}) == 1]
    assert sorted(pairs) == [(x, y) for x in range(50) for y in range(x + 1, 50)] and max(map(len, met.values())) < 30
    rng = random.Random(5)
    base = prose(rng, 60).split()
    out = [(i, " ".join(base[:20] + [f"v{i % 7}"] + base[20 + i % 5 :] + prose(rng, i % 9).split())) for i in range(60)]
    expected = components(out, 4, 85)
    small, whole = partial(jaccard.in_blocks, block=4), jaccard.in_blocks
    for blocks in (small, whole):
        monkeypatch.setattr(jaccard, "in_blocks", blocks)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(frame(spark, out)).collect()}
        assert [got[i] for i in range(60)] == expected


def test_one_of_each_group_stays(rows, docs):
    extra = docs.withColumn("sid", F.lit(1)).withColumn("sig", F.lit("x"))
    kept = jaccard.without_copies(extra, 5, 80)
    assert kept.columns == extra.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None)
    expected = sorted({(d, t) for (d, t), (_, c) in zip(rows, components(rows, 5, 80), strict=True) if d is not None and c == d}, key=str)
    assert sorted(got, key=str) == expected and kept.where("doc_id is null").count() == 2


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    near = f"{d} more"
    rows = [(1, a), (1, b), (2, a), (2, c), (2, None), (2, None), (3, d), (3, near), (3, d), (4, near), (5, ""), (None, a), (None, a)]
    got = [(r.doc_id, r.text) for r in jaccard.without_copies(frame(spark, rows), 5, 80).collect()]
    third = [r for r in got if r[0] == 3]
    assert len(third) == 1 and third[0][1] in (d, near)
    assert sorted((r for r in got if r[0] != 3), key=str) == sorted([(1, a), (1, b), (2, c), (2, None), (5, ""), (None, a), (None, a)], key=str)


def test_repeats(rows, docs):
    got = sorted(map(tuple, repeats.digest(docs.withColumn("key", F.lit(5))).collect()), key=str)
    raw, gone = removed([t for _, t in rows], 200)
    expected = sorted(((d, *digest(r, g)) for (d, _), r, g in zip(rows, raw, gone, strict=True)), key=str)
    assert got == expected


def test_repeats_of_frequent_passages_and_small_memory(spark):
    rng = random.Random(7)
    passage = prose(rng, 90)
    out = [(i, f"{prose(rng, i % 40)} {passage[: 420 - i % 60]} {prose(rng, 30)}é") for i in range(80)]
    got = {r[0]: tuple(r)[1:] for r in repeats.digest(frame(spark, out), memory=64).collect()}
    raw, gone = removed([t for _, t in out], 200)
    assert [got[i] for i in range(80)] == [digest(r, g) for r, g in zip(raw, gone, strict=True)]


def test_few_unwanted_kinds_are_sent(spark):
    ids = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 60_000)
    table = repeats.wanted_ids(spark.createDataFrame([(int(x),) for x in ids[:10_000]], "sent long"), 10_000)
    assert repeats.is_wanted(table, ids[:10_000]).all()
    assert repeats.is_wanted(table, ids[10_000:]).mean() < 0.03  # by one bit of eight to sixteen for each, 0.06 to 0.12


def test_texts_without_repeats(rows, docs):
    kept = repeats.without_repeats(docs)
    raw, gone = removed([t for _, t in rows], 200)
    expected = sorted(((d, None if t is None else bytes(x for x, y in zip(r, g, strict=True) if not y).decode(errors="ignore")) for (d, t), r, g in zip(rows, raw, gone, strict=True)), key=str)
    found = kept.collect()
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in found), key=str) == expected
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)


def test_decontamination(spark, docs):
    rng = random.Random(3)
    items = [(i, prose(rng, 40)) for i in range(6)] + [(7, None), (8, ""), (9, "shorty"), (2, prose(rng, 30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    full = items[0][1]
    texts = [(0, f"x {full.upper()} y"), (1, full.replace(" ", "\n ")), (2, full[: len(full) // 2]), (3, items[9][1] + "é"), (4, full[:50] + "q" * 9 + full[50:]), (5, prose(rng, 200)), (6, None), (7, ""), (8, "a shrty b"), (None, items[1][1]), (1, items[4][1])]
    frame_ = frame(spark, texts).withColumn("item_id", F.lit("clash"))
    truth = []
    for d, t in texts:
        for i, item in items:
            plain = decontamination.plain(item or "")
            if plain and edits_within(plain, decontamination.plain(t or "")) <= int(0.1 * len(plain)):
                truth.append((d, i))
    got = decontamination.leaks(frame_, benchmark).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(truth, key=str) and all(r.distance <= r.allowed for r in got)
    kept = decontamination.without_leaks(frame_, benchmark)
    assert kept.columns == frame_.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7, 8]
    parts = list(decontamination.finders(benchmark, most=3))
    assert sum(len(p.value.items) for p in parts) == 8 and len(parts) == 3
    assert decontamination.leaks(docs.limit(0), benchmark).count() == 0 and decontamination.leaks(docs, benchmark.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(0, 0.2, (300, 12)).astype(np.float32)
    m[40:60] = m[20]  # ties
    out = [(i, m[i].tolist()) for i in range(300)]
    odd = [(400, None), (420, [None] + [0.1] * 11), (440, [math.nan] * 12), (460, [math.inf] * 12), (None, m[0].tolist()), (20, m[20].tolist()), (480, [0.25] * 5), (500, [1e6] * 12)]
    got = topk.top_k(spark.createDataFrame(out + odd, "vec_id long, embedding array<float>").repartition(3)).collect()
    ids = np.array([i for i, _ in out] + [20, 480, 500])
    whole = np.floor(64 * topk.stacked([np.array(v, np.float32).astype(float) for _, v in [*out, odd[5], odd[6], odd[7]]], 12)).astype(np.int64)
    expected = []
    for q in sorted({int(i) for i in ids if i % 20 == 0}):
        scores = whole @ whole[list(ids).index(q)]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != q)[:20]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(expected)
    few = spark.createDataFrame([*out[:4], (60, [])], "vec_id long, embedding array<float>")
    assert len(topk.top_k(few).collect()) == 3 and topk.top_k(few.limit(0)).count() == 0


def test_top_k_with_a_sample_and_many_blocks(spark, monkeypatch):
    """First bounds, blocks that queries skip, and pages of blocks lose nothing; lists are read in part."""
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 1, (6, 10))
    m = (centre[rng.integers(0, 6, 900)] + rng.normal(0, 0.15, (900, 10))).astype(np.float32)
    for name, value in (("BLOCK", 60), ("QUERIES", 7), ("QUERY_PAGE", 2), ("EDGE_PAGE", 4)):
        monkeypatch.setattr(topk, name, value)
    counted = tuple(spark.sparkContext.accumulator(0) for _ in range(3))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(table, counted=counted).collect()
    whole = np.floor(64 * m.astype(float)).astype(np.int64)
    expected = []
    for q in range(0, 900, 20):
        scores = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:20]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(expected)
    pairs, reads, places = (c.value for c in counted)
    assert 45 <= pairs < 45 * 15 and 0 < reads < places


def test_top_k_of_an_id_with_different_vectors(spark):
    import duckdb

    from tesselle.llm import oracle

    rng = np.random.default_rng(1)
    out = [(i, v) for i, v in enumerate(rng.normal(0, 0.2, (200, 8)).astype(np.float32).tolist())]
    out += [(20, out[21][1]), (20, out[22][1][:5]), (40, out[40][1]), (60, [*out[60][1][:7], 0.5]), (60, out[60][1])]
    table = spark.createDataFrame(out, "vec_id long, embedding array<float>").toArrow()
    con = duckdb.connect()
    con.register("embeddings", table)
    expected = sorted(con.execute(oracle.top_k_sql()).fetchall())
    for parts in (1, 5):
        for rows in (out, out[::-1]):
            got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)).select("query_id", "rank", "vec_id", "score").collect()
            assert sorted(map(tuple, got)) == expected


def test_license_scan(spark):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    rng, some = random.Random(2), "MIT license apache GENERAL public License, gnu Kit é mit-license".split()
    texts = [*ODD, "mit license " * 3000, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Licensed under CC BY-NC 4.0.", "MIT licence", "general public\nlicense general public license", "ＭＩＴ license"]
    texts += [" ".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(60)]
    out = [*enumerate(texts), (3, texts[3]), (None, "mit license")]
    got = license_scan.scan(frame(spark, out).withColumn("words", F.lit(1))).collect()
    expected = []
    for d, t in out:
        w = words.findall((t or "").translate(FOLD))
        places = [(i, label) for label, p in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        expected.append((d, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(expected, key=str)
    labels = {r.doc_id: (r.labels, r.score) for r in got if r.doc_id is not None}
    assert labels[11] == ("mit", 1.0) and labels[12][0] == "cc-by-nc" and labels[13] == ("", 0.0) and all(0 <= s <= 1 for _, s in labels.values())
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan.scan(frame(spark, [])).count() == 0
    plan = license_scan.scan(frame(spark, out))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_quality(spark, docs):
    rng = random.Random(1)
    good = [(i, prose(rng, 50)) for i in range(300)]
    bad = [(1000 + i, " ".join(f"junk{rng.randrange(40)}" for _ in range(50))) for i in range(100)]
    out = good + bad + [(2000, None), (2001, ""), (None, "w1 w2"), good[0]]
    got = quality.resample(frame(spark, out), list(range(200)), keep=0.7).collect()
    chosen = [r.selected for r in got]
    assert len(got) == len(out) and math.ceil(0.7 * len(out)) <= sum(chosen) <= math.ceil(0.7 * len(out)) + 1
    assert sum(r.selected for r in got if r.doc_id is not None and 1000 <= r.doc_id < 1100) < 5
    assert {r.doc_id: r.n_grams for r in got}[0] == 99 and all(r.log_weight == 0 for r in got if r.n_grams == 0)
    again = {r.doc_id: r.selected for r in quality.resample(frame(spark, out).repartition(5), list(range(200)), keep=0.7).collect()}
    assert all(again[r.doc_id] == r.selected for r in got)
    assert quality.resample(frame(spark, []), []).count() == 0


def test_quality_against_brute_force(spark):
    """Buckets, log weights, noise and the selected rows, all anew in plain Python."""
    rng = random.Random(12)
    out = [(i, prose(rng, rng.randrange(0, 40), 60).upper() if i % 3 else prose(rng, 30, 20)) for i in range(80)] + [(-1, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w5"), (90, "z " * 20000)]
    target = [i for i in range(80) if i % 3 == 0] + [-1]
    got = quality.resample(frame(spark, out).withColumn("bucket", F.lit(1)).repartition(3), target, 0.5, buckets=97).collect()

    def grams_of(text):
        batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([text])], names=["doc_id", "text"])
        found, _ = quality.bucketed(batch, 97)
        words = (text or "").translate(FOLD).split()
        assert len(found) == max(0, 2 * len(words) - 1)
        return found.tolist()

    raw, good = [1] * 97, [1] * 97
    for d, t in out:
        for b in grams_of(t):
            raw[b] += 1
            good[b] += d is not None and d in target
    ratio = [math.log(g / sum(good)) - math.log(r / sum(raw)) for g, r in zip(good, raw, strict=True)]
    weights = [sum(ratio[b] for b in grams_of(t)) for _, t in out]
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_grams)
    mine = sorted(((d, len(grams_of(t)), w) for (d, t), w in zip(out, weights, strict=True)), key=lambda r: (r[0] is None, r[0], r[1]))
    for r, (d, n, w) in zip(sorted(got, key=key), mine, strict=True):
        assert (r.doc_id, r.n_grams) == (d, n) and math.isclose(r.log_weight, w, abs_tol=1e-8)

    def noise(d):
        x = int(hashing.mix(hashing.mix(np.array([-1 if d is None else d], np.int64).view(np.uint64)) ^ np.uint64(11))[0]) >> 11
        return -math.log(-math.log((x + 0.5) / 2**53))

    keys = sorted((w + noise(d) for d, _, w in mine), reverse=True)
    last = keys[math.ceil(0.5 * len(out)) - 1]
    assert [r.selected for r in sorted(got, key=key)] == [w + noise(d) >= last - 1e-9 for d, _, w in mine]


def test_long_texts(spark):
    """A text of 20,000 words and one of a single word of 100,000 bytes, whole: counts, items, tokens and pieces."""
    rng = random.Random(2)
    long, item = prose(rng, 20000), prose(rng, 30)
    out = [(1, long), (2, f"{long} {item}"), (3, "ab" * 50000), (4, item)]
    docs = frame(spark, out).withColumn("n_grams", F.lit(0)).withColumn("block", F.lit(0))
    assert {r.doc_id: r.n_grams for r in quality.resample(docs, [1]).collect()} == {1: 39999, 2: 40059, 3: 1, 4: 59}
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.leaks(docs, benchmark).collect()) == [2, 4]
    if Path(PATH).exists():
        from tokenizers import Tokenizer

        inner = Tokenizer.from_file(PATH)
        sizes = {d: len(inner.encode(t, add_special_tokens=False).ids) for d, t in out}
        pieces = packing.pack(docs, PATH).collect()
        assert {r.doc_id: r.doc_tokens - 1 for r in pieces} == sizes and sum(r.length for r in pieces) == sum(sizes.values()) + 4
        files = scratch.saved(token_counts.token_files(docs, PATH, 49407, block=1000), "files")
        assert sorted(r.n_tokens for r in token_counts.count_tokens(files.where("content is not null"), 49407).collect()) == sorted(sizes.values())


def test_helper_columns_of_the_same_names(spark):
    docs = frame(spark, [(1, "a b c d e"), (2, "a b c d e"), (3, None)])
    for name in ("__at", "__slot", "__shard", "__key", "__of", "__spans", "__gone", "__again", "__doc", "__text"):
        docs = docs.withColumn(name, F.lit("mine"))
    for made in (sharding.assign(docs, "doc_id"), repeats.without_repeats(docs), jaccard.without_copies(docs)):
        rows = made.collect()
        assert len(rows) in (2, 3) and all(r[n] == "mine" for r in rows for n in docs.columns if n.startswith("__"))


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(200)] + [5] * 20 + [-1, 0, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 100, 130, len(values)):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 0) is None


def test_toxicity(spark):
    rng = random.Random(6)
    bad_words = ["vilix", "vilor", "vilum", "grobat", "grobon"]
    out, labels = [], []
    for i in range(500):
        words = prose(rng, rng.randrange(30, 200), 50).split()
        words = ["".join("abcdefghij"[int(c)] for c in w[1:]) for w in words]
        if toxic := i % 4 == 0:
            words[:: len(words) // 2] = [rng.choice(bad_words) for _ in words[:: len(words) // 2]]
        out.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (9999, 0, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame_ = frame(spark, out + [(900, None), (901, ""), (None, "a b"), out[0]])
    model = toxicity.train(frame_, marks)
    got = toxicity.score(frame_.withColumn("score", F.lit(1)), model).collect()
    assert len(got) == 504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    right = [r.predicted == (r.doc_id % 4 == 0) for r in held]
    assert len(held) > 60 and sum(right) >= 0.97 * len(right)
    kept = toxicity.without_toxic(frame_, model)
    assert kept.columns == frame_.columns and kept.count() == sum(r.predicted == 0 for r in got)
    none = toxicity.train(frame_, marks.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(frame_, none).collect())
    assert toxicity.score(frame_.limit(0), model).count() == 0


def test_held_out_and_repeated_labels_do_not_weigh(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["plain", "text", "good", "vilix" if i % 5 == 1 else "day"]) for _ in range(12))) for i in range(150)]
    kept = [(i, int(i % 5 == 1)) for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    more = [(i, 1) for i in range(150, 400) if zlib.crc32(str(i).encode()) % 5 == 0] + kept[:40] + [(i, 0) for i, t in kept if t] + [(None, 1)]
    marks = [spark.createDataFrame(x, "doc_id long, toxic int") for x in (kept, kept + more)]
    assert toxicity.label_shares(marks[0]) == toxicity.label_shares(marks[1]) == {t: sum(x == t for _, x in kept) for t in (0, 1)}
    one, other = (toxicity.train(frame(spark, rows), m)["weights"] for m in marks)
    assert (one == other).all()


def test_every_labelled_row_is_learnt_from(spark):
    """More rows of a class than any sample held: each one's word is among the codes seen."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(i, word(i)) for i in range(6500)]
    model = toxicity.train(frame(spark, rows), spark.createDataFrame([(i, int(i >= 6000)) for i, _ in rows], "doc_id long, toxic int"))
    learnt = [w.encode() for i, w in rows if zlib.crc32(str(i).encode()) % 5 > 1]
    ends = np.cumsum([len(w) for w in learnt])
    codes, _ = toxicity.spelt(np.frombuffer(b"".join(learnt), np.uint8), np.append(0, ends[:-1]), ends)
    assert sum(zlib.crc32(str(i).encode()) % 5 > 1 for i in range(6000)) < 4000 < sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(6000))
    assert np.array_equal(model["seen"], np.unique(codes))


def test_held_out_labels_flipped_change_no_score(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice(["plain", "text", "good", "vilix" if i % 4 == 1 else "day"]) for _ in range(12))) for i in range(200)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    true = [(i, int(i % 4 == 1)) for i, _ in rows]
    scores = []
    for marks in (true, [(i, 1 - t if held(i) else t) for i, t in true], [(i, t) for i, t in true if not held(i)]):
        docs = frame(spark, rows)
        model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.score(docs, model).collect()))
    assert scores[0] == scores[1] == scores[2]


def test_labels_of_held_out_rows_are_not_used(spark):
    marks = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    from tesselle.llm.labelled import sample_ids

    ids = sample_ids(marks, "toxic", 1, 1000)
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and len(sample_ids(marks, "toxic", 1, 7)) == 7


@pytest.mark.skipif(not Path(PATH).exists(), reason="no tokenizer file")
def test_packing(spark, rows, docs):
    got = packing.pack(docs, PATH).collect()
    from tokenizers import Tokenizer

    inner, whole = Tokenizer.from_file(PATH), {}
    for d, t in rows:
        whole.setdefault(d, []).append(np.array([*inner.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(len(ids) // 4 for own in whole.values() for ids in own)
    for d, own in whole.items():  # every id of each row in one piece, and pieces as they say
        mine = [r for r in got if r.doc_id == d]
        assert all(any(r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for ids in own) for r in mine)
        starts = sorted((r.start, r.start + r.length) for r in mine)
        assert sorted([0] * len(own) + [e for _, e in starts]) == sorted([s for s, _ in starts] + [len(ids) // 4 for ids in own])
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
    short = [n for n in (sum(r.length for r in own) for own in sequences.values()) if n & (n - 1)]
    assert len(short) <= docs.rdd.getNumPartitions()
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_token_counts(spark, tmp_path):
    rng = random.Random(9)
    for width, block in (("<u2", 7), ("<u4", 3)):
        out, expected = [], []
        for file in range(5):
            ids = [rng.choice([0, 0, 5, 6, 7]) for _ in range(rng.choice([0, 1, 6, 7, 40, 41]))] + [9] * (file % 3)
            docs = " ".join(map(str, ids)).split("0") if ids else []
            for k, part in enumerate(docs):
                ended = k < len(docs) - 1
                if ended or part.split():
                    expected.append((file, k, len(part.split()), ended))
            out += [(file, b, np.array(ids[b * block : b * block + block], width).tobytes()) for b in range(-(-len(ids) // block))]
        got = token_counts.count_tokens(spark.createDataFrame(out, "file_id long, block long, content binary").repartition(3), 0, width)
        assert sorted((r.file_id, r.ordinal, r.n_tokens, r.ended) for r in got.collect()) == sorted(expected)
    assert token_counts.count_tokens(spark.createDataFrame([(0, 0, None)], "file_id long, block long, content binary"), 0).count() == 0


@pytest.mark.skipif(not Path(PATH).exists(), reason="no tokenizer file")
def test_token_files_round_trip(spark, rows, docs):
    files = scratch.saved(token_counts.token_files(docs, PATH, 49407, block=50), "files")
    counts = token_counts.count_tokens(files.where("content is not null"), 49407).collect()
    encode = tokens.Encoder(PATH, specials_as_text=True)
    assert sorted(r.n_tokens for r in counts) == sorted(len(b) // 4 for b in encode([t for _, t in rows])) and all(r.ended for r in counts)


def test_sharding(spark, docs):
    table = sharding.lookup_table()
    got = sharding.assign(docs.withColumn("slot", F.lit("x")), "doc_id")
    found = got.collect()
    assert got.columns == [*docs.columns, "slot", "shard"] and len(found) == docs.count()
    assert all(r.shard == table[r.slot] for r in found) and len({(r.doc_id, r.shard) for r in found}) == len({r.doc_id for r in found})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Pandas|Arrow|Exchange hashpartitioning", plan)
    assert sharding.assign(docs.limit(0), "doc_id").count() == 0
    spread = sharding.assign(spark.range(40000), "id", tuple(f"s{i}" for i in range(8)), 1009).groupBy("shard").count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 1.1 * 5000


def test_sharded_folders(spark, docs, tmp_path):
    sharding.write(docs, f"file://{tmp_path}/out", "doc_id", tuple("abc"), 101)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count() and {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1, 2}


def test_schema_of_documents(docs):
    assert ", ".join(f"{n} {'long' if t == 'bigint' else t}" for n, t in docs.dtypes) == DOCS
