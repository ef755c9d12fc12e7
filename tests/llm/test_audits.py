"""URL filters, the Merkle manifest and the divergence audit against plain versions and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from llm.brute import DOCS, FOLD
from pyspark.sql import functions as F

from tesselle.llm import divergence, merkle, oracle, scratch, url_filter

PAGES = "page_id long, url string, html string"
URLS = [
    None, "", "no scheme", "http://", "HTTP://EX.NET", "a://b://c.net/?x", "x://é😀K.org/fr/ü?q#z", "://example.net/en/a", "http://notexample.net/en/", "http://a.Example.com/de/",
    "http://net/", "http://net", "http://u@h.org:80/fr/#", "http://www.cheap-pills.example.com/en/3", "https://rivers.example.com/fr/9\n?a", "http://x.org/fr", "://" + "a" * 5000 + ".net/" + "b/" * 20000,
]


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql).to_arrow_table()


def same(df, sql, **tables):
    mine, theirs = df.toArrow(), run_sql(sql, **tables)
    names = sorted(mine.schema.names)
    assert names == sorted(theirs.schema.names)
    assert [str(mine.schema.field(n).type) for n in names] == [str(theirs.schema.field(n).type) for n in names]
    rows = lambda t: sorted(map(str, zip(*(t.column(n).to_pylist() for n in names), strict=True)))
    assert rows(mine) == rows(theirs)


# URL filters.


def plain_url(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return host.translate(FOLD), path


def plain_features(url):
    out = {0}
    for text, by in zip(plain_url(url), (url_filter.HOST, url_filter.PATH), strict=True):
        c = [ord(x) for x in f"^{text}$"]
        out |= {1 + sum(v * m for v, m in zip(c[i:], by, strict=False)) % (url_filter.BUCKETS - 1) for i in range(len(c) - 2)} if len(c) >= 3 else {0}
    return out


def plain_chance(total):
    return math.floor(url_filter.ONE / (1 + math.exp(-total / url_filter.ONE)))


def plain_fit(labelled):
    rows = [(y, plain_features(u)) for u, y in labelled if u is not None and y is not None]
    w = dict.fromkeys(set().union(*(f for _, f in rows)) if rows else (), 0)
    for _ in range(url_filter.STEPS):
        err = [y * url_filter.ONE - plain_chance(sum(w[b] for b in f)) for y, f in rows]
        w = {b: v + math.floor(sum(e for e, (_, f) in zip(err, rows, strict=True) if b in f) / url_filter.RATE) - math.floor(v / url_filter.DECAY) for b, v in w.items()}
    return w


@pytest.fixture(scope="module")
def weights(spark):
    return url_filter.fit(url_filter.labelled_urls(spark))


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)], PAGES)


def test_url_model_against_a_plain_one(spark, weights):
    labelled = [(u, 1) for u in url_filter.BLOCKED] + [(u, 0) for u in url_filter.ALLOWED]
    assert weights == plain_fit(labelled)
    odd = [("http://a.b/c", 1), ("http://a.b/c", 1), (None, 1), ("http://b.c/d", None), ("no url", 0), ("", 0)]
    assert url_filter.fit(spark.createDataFrame(odd, "url string, block int")) == plain_fit(odd)
    assert url_filter.fit(spark.createDataFrame([], "url string, block int")) == {}


def test_url_verdicts(spark, weights):
    got = {r.page_id: r for r in url_filter.judge(pages(spark, URLS), weights).collect()}
    rules = sorted(url_filter.RULES, key=lambda r: -len(r.name))
    for i, url in enumerate(URLS):
        host, path = plain_url(url)
        rule = next((r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), None)
        chance = plain_chance(sum(weights.get(b, 0) for b in plain_features(url)))
        r = got[i]
        assert (r.host, r.path, r.rule, r.score) == (host, path, rule.name if rule else None, chance / url_filter.ONE)
        assert r.verdict == (rule.verdict if rule else "block" if 2 * chance > url_filter.ONE else "allow")
    assert got[8].rule == "net/" and got[7].rule == "example.net/en/" and got[9].rule == "example.com/de/" and got[10].rule == "net/" and got[11].rule is None


def test_url_sql_repeated_rows_and_empty_tables(spark, weights):
    rows = pages(spark, [*URLS, *URLS[5:9]])
    same(url_filter.judge(rows, weights), oracle.url_filter_sql(), pages=rows)
    none = url_filter.judge(rows.where("false"), weights)
    assert none.count() == 0 and none.columns == ["page_id", "host", "path", "rule", "verdict", "score"]


def test_url_filter_keeps_whole_rows_and_runs_no_python(spark, weights):
    rows = pages(spark, URLS).withColumn("host", F.lit("mine")).withColumn("__w", F.lit(1)).withColumn("rule", F.lit(None).cast("string"))
    kept = url_filter.without_blocked(rows, weights)
    allowed = {r.page_id for r in url_filter.judge(rows, weights).collect() if r.verdict == "allow"}
    assert kept.columns == rows.columns and {r.page_id for r in kept.collect()} == allowed and {r.host for r in kept.collect()} == {"mine"}
    plan = url_filter.judge(rows, weights)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange|Join", plan)


def test_url_model_tells_junk_hosts_it_has_not_seen(spark, weights):
    junk = [f"http://{p}{w}.example.com/en/{i}" for i, w in enumerate(("cheap-pills-now", "casino-bets", "adult-cams", "ads-tracker", "spam-farm", "free-spins-win")) for p in ("", "www.", "m.")]
    plain = [f"https://{p}{w}.example.com/en/{i}" for i, w in enumerate(("meadow", "cathedral", "geology", "lanterns", "philharmonic", "botany")) for p in ("", "www.", "blog.")]
    got = {r.page_id: r.score for r in url_filter.judge(pages(spark, junk + plain), weights, ()).collect()}
    over = sum(got[i] > got[j] for i in range(len(junk)) for j in range(len(junk), len(junk) + len(plain)))
    assert over >= 0.95 * len(junk) * len(plain)


def test_url_rules_are_checked(spark):
    with pytest.raises(ValueError):
        url_filter.judge(pages(spark, []), {}, (url_filter.Rule("maybe", "a", "/"),))
    with pytest.raises(ValueError):
        url_filter.judge(pages(spark, []), {}, url_filter.RULES * 300)
    got = url_filter.judge(pages(spark, ["http://a.b/"]), {}, ()).first()
    assert got.rule is None and got.verdict == "allow" and got.score == 0.5


# The manifest.


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = [None if v is None else str(v) for v in (row[0], row[3], row[2], row[4], text)]
    return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Root, and the steps (place, siblings) of each leaf."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for leaf, i in enumerate(at):
            steps[leaf].append((i % 3, [x for k, x in enumerate(runs[i // 3]) if k != i % 3]))
        nodes, at = [H(*r) for r in runs], [i // 3 for i in at]
    return nodes[0], steps


def plain_manifest(rows):
    low = lambda v: (v is not None, v if v is not None else 0)
    trees = defaultdict(list)
    for r in rows:
        changed = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
        trees[r[3]].append((low(r[0]), plain_leaf(r, r[1]), r[0], plain_leaf(r, changed)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: plain_tree([x[1] for x in sorted(trees[s], key=lambda x: x[:2])]) for s in names}
    root, tops = plain_tree([made[s][0] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops, strict=True):
        for x, steps in zip(sorted(trees[s], key=lambda x: x[:2]), made[s][1], strict=True):
            node = x[3]
            for place, others in steps + top:
                node = H(*others[:place], node, *others[place:])
            out.append((x[2], x[1], made[s][0], root, H(*(o for _, others in steps + top for o in others)), node, node == root))
    return out


def documents(n=230, seed=3):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["a", "b", None, "é", "", "Z"]
    rows = [(i, rng.choice(["x\ny", "plain", None, "", "\n", "é\n😀"]) if rng.random() < 0.9 else "w " * 3000, rng.choice(["en", None]), rng.choice(sources), rng.choice([None, i])) for i in range(n)]
    rows += [rows[5], rows[5], rows[9], (None, None, None, None, None), (None, "a\n", "x", "hot", 3), (7, "lone", "en", "lone", 4), (rows[0][0], "other", "en", rows[0][3], 1)]
    return rows


@pytest.fixture(scope="module")
def small_blocks():
    kept = merkle.BLOCK_ROWS, merkle.FAN
    merkle.BLOCK_ROWS, merkle.FAN = 16, 3
    yield
    merkle.BLOCK_ROWS, merkle.FAN = kept


@pytest.mark.parametrize("rows", [documents(), documents(12), [(1, "a\nb", "en", "s", 1)], []], ids=["many", "few", "one", "none"])
def test_manifest(spark, small_blocks, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = merkle.verified(docs.withColumn("leaf", F.lit(1)).withColumn("place", F.lit("clash")))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_manifest(rows), key=key)
    same(got, oracle.merkle_sql(), documents=docs)


def test_manifest_paths_lead_to_the_root_and_forests_merge_in_any_order(spark):
    digests = [H(str(i)) for i in range(100)]
    rows = spark.createDataFrame([("t", i, d) for i, d in enumerate(digests)], "tree string, k int, leaf string")
    made = merkle.manifest(rows, ["k"]).withColumn("ends", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert {r.ends for r in made} == {r.root for r in made} == {plain_tree(digests)[0]} and [r["index"] for r in sorted(made, key=lambda r: r.k)] == list(range(100))
    # associative: open nodes of parts, put together in any grouping, give the same forest
    cuts = sorted(random.Random(1).sample(range(1, 100), 6))
    parts = [dict(enumerate(digests[a:b], a)) for a, b in pairwise([0, *cuts, 100])]

    def grow(*forests):
        given = defaultdict(dict)
        for f in forests:
            for (level, index), d in f.items():
                given[level][index] = d
        done = merkle.grown(given, 100)
        return {(len(done.levels) - 1, 0): done.root} if done.root else {(level, i): done.levels[level][i] for level, i in done.open_}

    first = [grow({(0, i): d for i, d in p.items()}) for p in parts]
    left, right = first[0], first[-1]
    for f in first[1:]:
        left = grow(left, f)
    for f in reversed(first[:-1]):
        right = grow(f, right)
    assert left == right == grow(*first) == {(5, 0): plain_tree(digests)[0]}


# The audit.


def plain_audit(rows):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))) for _, text, lang, source, _ in rows]
    df, total, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in docs:
        df[lang].update(set(w))
        total[lang].update(w)
        own[lang, source].update(w)
    kept = {lang: {t for t, n in c.items() if n >= 3} for lang, c in df.items()}
    share = lambda c, lang: (lambda size: {t: 1 + 10**9 * (c[t] + 1) // (size + len(kept[lang])) for t in kept[lang]})(sum(c[t] for t in kept[lang]))
    p = {g: share(c, g[0]) for g, c in own.items()}
    q = {lang: share(c, lang) for lang, c in total.items()}
    gap = lambda a, b: (a - b) ** 2 // b
    out = []
    for lang, source in own:
        mine = p[lang, source]
        pairs = [(s, sum(gap(mine[t], p[lang, s][t]) for t in kept[lang])) for x, s in own if x == lang and s != source]
        terms = [(t, gap(mine[t], q[lang][t])) for t in kept[lang] if own[lang, source][t] and mine[t] > q[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, divergence.RANKS)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def audited(n=160, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Word", "é", "x", "ß", "日本") for b in "abcdefgh"] + ["İ", "ÉA"]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.randrange(3, len(vocabulary))]) for _ in range(rng.randrange(25)))
    rows = [(i, text(), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "b", "c", None, "é"]), 0) for i in range(n)]
    rows += [rows[3]] * 4 + [(None, None, None, None, None), (1, "12 - 9", "en", "empty", 0), (2, "once only", "fr", "a", 0), (3, "", "fr", "b", 0), (4, "tie tie", "it", "a", 0), (5, "TIE-tie", "it", "b", 0), (6, "tie", "it", "a", 0)]
    return [*rows, (7, "word\x00a " * 9000, "en", "long", 0)]


@pytest.mark.parametrize("rows", [audited(), audited(5), [(1, None, None, None, None)], []], ids=["many", "few", "one", "none"])
def test_audit(spark, rows, monkeypatch):
    scratch.prepare(spark)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = divergence.audit(docs.withColumn("term", F.lit(1)).withColumn("n", F.lit("clash")))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows)
    same(got, oracle.divergence_sql(), documents=docs)


def test_audit_with_more_terms_than_ranks_and_held_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "RANKS", 7)
    monkeypatch.setattr(divergence, "FAN", 2)
    rows = audited(220, 9)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain_audit(rows)


def test_sketch_never_underestimates_and_tells_rare_keys():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    times = rng.integers(1, 300, 3000)
    sketch = np.zeros((divergence.DEPTH, 1 << 13), np.uint8)
    for k in range(300):
        divergence.add(sketch, keys[times > k])
    assert (divergence.estimate(sketch, keys) >= np.minimum(times, 255)).all()
    others = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    assert (divergence.estimate(sketch, others) < divergence.LEAST_DOCS).mean() > 0.95


def test_impossible_terms_are_not_shuffled(spark):
    """Words that one document has do not leave the counting pass."""
    rows = [(i, f"common also{i} only{i}x", "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(["common", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30))]), *r[2:]) for i, r in enumerate(rows)], DOCS)
    sketch = spark.sparkContext.broadcast(divergence.frequencies(divergence.filled(docs)))
    counted = divergence.filled(docs).mapInArrow(lambda batches: divergence._counted(batches, sketch), divergence.COUNTS)
    assert 0 < counted.count() < 60
