"""Parts without Spark: encoders, packers, signatures, suffix orders, walks."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.brute import KneserNey, edits_within, families, removed, shingles

from tesselle.llm import decontamination, hashing, induced, jaccard, license_scan, packing, repeats, sharding, tokens, topk, toxicity

PATH = tokens.public_path("word_bpe_49k.json")
needs_file = pytest.mark.skipif(not Path(PATH).exists(), reason="no tokenizer file")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@needs_file
@pytest.mark.parametrize("text", ["", "a", "İstanbul’s it's DON'T 'll", "a\x1cb  c\x85d e", "<|endoftext|> x<|EndOfText|>", "Σ ΑΣ οδός", "é é À straße ÷× ÿ", "1,234.5 --...!? a.b.c, (d)", "K Å ﬁ ǅ", "日本 語", "🙂👍🏽 x"])
def test_ids_are_the_tokenizers(plain, text):
    encode = tokens.Encoder(PATH)
    assert encode.direct
    for _ in range(2):  # anew, and from memory
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@needs_file
@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n.,'AbÉéß!<|>İıΣς日가٣"), st.characters(codec="utf-8")), max_size=60))
def test_ids_of_any_text(text):
    encode = tokens.encoder(PATH)
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == encode.inner.encode(text, add_special_tokens=False).ids


@needs_file
def test_ids_of_letters_before_marks(plain):
    """Every letter of the basic plane before and after marks, as a word's last letter."""
    encode, wrong = tokens.Encoder(PATH), []
    letters = [chr(c) for c in range(0x80, 0x10000) if chr(c).isalpha()]
    for at in range(0, len(letters), 40):
        text = " ".join(f"ab{c}. {c}, A{c}{c}!" for c in letters[at : at + 40])
        if np.frombuffer(encode([text])[0], "<u4").tolist() != plain.encode(text, add_special_tokens=False).ids:
            wrong.append(at)
    assert not wrong


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_each_tokenizer(name):
    """White space counts to some tokenizers; texts are cut only where it does not."""
    from tokenizers import Tokenizer

    path = tokens.public_path(name)
    if not Path(path).exists():
        pytest.skip("no tokenizer file")
    inner, encode = Tokenizer.from_file(path), tokens.Encoder(path)
    for text in ("two  spaces and\n\na line", " a b", "KALİTESİ, ANALİZİ.", "it's\tDon't", "", "日本 語 x", "Ünï\u0301code \u00a0x"):
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == inner.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60), st.integers(1, 30))
def test_packer(sizes, per):
    packer, sequences = packing.Packer(), []
    docs = [(d, d, 0, np.arange(n, dtype="<u4").tobytes(), n) for d, n in enumerate(sizes)]
    for i in range(0, len(docs), per):
        sequences += packer.add(docs[i : i + per])
    full = len(sequences)
    sequences += packer.finish()
    pieces = sorted((p[0], p[2], len(p[3]) // 4, p[3]) for _, row in sequences for p in row)
    for d, n in enumerate(sizes):
        own = b"".join(p[3] for p in pieces if p[0] == d)
        assert own == np.arange(n, dtype="<u4").tobytes()
    lengths = [sum(len(p[3]) // 4 for p in row) for _, row in sequences]
    assert all(n == t for n, (t, _) in zip(lengths[:full], sequences[:full], strict=True))
    assert all(n == t for n, (t, _) in zip(lengths[full:-1], sequences[full:-1], strict=True)) and all(n <= 2048 for n in lengths)
    steps, _ = packing.grouped(sequences, 16384, 0)
    for s in set(steps):
        own = [sequences[i][0] for i in range(len(steps)) if steps[i] == s]
        assert len(set(own)) == 1 and sum(own) <= 16384


def test_lookup_table():
    shards = tuple(f"s{i}" for i in range(20))
    table = sharding.lookup_table(shards, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 19)
    assert moved < 0.15 * 1009
    for bad in (((), 7), (("a", "a"), 7), (("a",), 9), (tuple("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB \n\té", max_size=40)), max_size=8), st.integers(1, 4))
def test_shingle_sets(texts, size):
    got = dict(jaccard.shingle_sets(_batch(texts), size)) if texts else {}
    assert [len(got[i]) for i in range(len(texts))] == [len(shingles(t, size)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(shingles(texts[i], size) & shingles(texts[j], size))


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    close = 0
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 2**62, n).astype(np.uint64)
        b = np.concatenate([a[int(rng.integers(0, max(1, n // 6))) :], rng.integers(0, 2**62, int(rng.integers(0, max(1, n // 7)))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            close += 1
            assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)))
            apart = int(np.bitwise_count((jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64)).sum())
            assert apart <= len(a) + len(b) - 2 * both
    assert close > 20


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_small_similar_sets_share_a_signature(percent):
    """Sets so small that parts are often empty: whatever differs within the limit, a signature is shared."""
    rng = np.random.default_rng(percent)
    for n in range(1, 40):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
            gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**62, int(rng.integers(0, n))).astype(np.uint64)[: n * (100 - percent) // 100 - gone + 1]]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)))


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("spare", [True, False])
def test_large_similar_sets_share_a_signature(percent, spare, monkeypatch):
    """Sets at the limit of similarity, with the spare partitions and without any, so that sets put elements in the place of empty parts."""
    if not spare:
        monkeypatch.setattr(jaccard, "partitions", lambda percent, smallest, k: (k // 2 + 1, 0))
    rng, close = np.random.default_rng(percent), 0
    for _ in range(60):
        n = int(rng.integers(200, 3000))
        a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        both = -(-n * 2 * percent // (100 + percent))
        b = np.unique(np.concatenate([a[rng.permutation(n)[:both]], rng.integers(0, 2**62, n - both).astype(np.uint64)]))
        if 100 * both >= percent * (2 * n - both):
            close += 1
            assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)))
    assert close > 50


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("size", [6, 12, 24, 60, 400, 1000])
def test_unrelated_sets_share_no_signature(size, percent):
    rng = np.random.default_rng(size)
    found = [np.unique(jaccard.signatures(np.unique(rng.integers(0, 2**62, size).astype(np.uint64)), percent)) for _ in range(1500)]
    assert np.unique(np.concatenate(found), return_counts=True)[1].max() == 1


@pytest.mark.parametrize("rows", [1, 2, 3, 50])
def test_shared_signatures_across_batches(rows):
    rng = np.random.default_rng(rows)
    for _ in range(30):
        pairs = sorted(zip(rng.integers(0, 6, 25).tolist(), rng.integers(0, 5, 25).tolist(), strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["sig", "sid"])
        got = [tuple(r.values()) for b in jaccard._shared(iter(batch.slice(i, rows) for i in range(0, 25, rows))) for r in b.to_pylist()]
        sets = {s: sorted({d for x, d in pairs if x == s}) for s, _ in pairs}
        assert sorted(got) == sorted((s, d, own[0]) for s, own in sets.items() if len(own) > 1 for d in own)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=150), st.integers(1, 9), st.sampled_from([(512, 64), (512, 0), (2, 64)]), st.sampled_from([1, 1 << 20]))
def test_suffix_order(symbols, times, queues, memory):
    text = np.array(symbols * times)
    expected = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(induced, "SINGLE", queues[0])
        patch.setattr(induced, "LONG", queues[1])
        assert induced.suffix_order(text, memory).tolist() == expected
    assert induced.doubled(text).tolist() == expected


def _common(a, b, most):
    return next((k for k in range(most) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), most)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(b"abc"), min_size=1, max_size=120), st.integers(1, 5), st.sampled_from([1, 3, 50]), st.sampled_from([3, 7, 512]), st.booleans())
def test_common_prefixes(letters, times, length, block, single):
    text = bytes(letters) * times
    order = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
    expected = [(i, _common(text[i:], text[order[k - 1] :], length) if k else 0) for k, i in enumerate(order)]
    files = induced.Files(1)
    files.block = block
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(induced, "LONG", 0 if single else 64)
        got = [(int(a), int(c)) for s, p in induced.suffixes(np.frombuffer(text, np.uint8), length, files) for a, c in zip(s, p, strict=True)]
    files.close()
    assert got == expected


def test_memory_of_sorting_is_bounded():
    """With a bound of 1 MB: under three times that, and hardly more for three times the text (the arrays of a sorting are some 60 bytes a byte)."""
    import tracemalloc

    rng, peaks = random.Random(8), []
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    for size in (500_000, 1_500_000):
        files = induced.Files(1 << 20)
        text = files.written(iter([np.frombuffer(" ".join(rng.choice(words) for _ in range(size // 5)).encode()[:size], np.uint8)]), np.uint8)
        owned = files.array(size, bool)
        owned[: size - 30] = True
        tracemalloc.start()
        repeats.repeated(text, owned, 30, files)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        files.close()
    assert peaks[1] < 3 << 20 and peaks[1] - peaks[0] < 1 << 20, peaks


def test_repeated_against_brute_force():
    rng = random.Random(4)
    for length in (3, 8):
        for memory in (1, 1 << 20):
            text = "".join(rng.choice("abc") for _ in range(400)).encode()
            owned = np.arange(400) % 7 != 0
            owned[400 - length + 1 :] = False
            files = induced.Files(memory)
            files.block = 512 if memory > 1 else 5
            got = np.flatnonzero(repeats.repeated(np.frombuffer(text, np.uint8), owned, length, files)).tolist()
            files.close()
            at = [i for i in range(400) if owned[i]]
            strings = [text[i : i + length] for i in at]
            assert [i for i in at if strings.count(text[i : i + length]) > 1] == got


def test_runs_of_flags():
    rng = np.random.default_rng(1)
    for block in (1, 2, 5, 100):
        flags = rng.random(60) < 0.6
        runs = [(a, b) for x, y in repeats._true(flags, block) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert [i for a, b in runs for i in range(a, b + 1)] == np.flatnonzero(flags).tolist() and all(not flags[b + 1] for _, b in runs if b < 59)


@pytest.mark.parametrize("rows", [1, 2, 3, 7])
def test_kinds_are_sorted_out_across_batches(rows):
    rng = np.random.default_rng(rows)
    for _ in range(40):
        n = int(rng.integers(1, 25))
        pick = np.sort(rng.integers(0, 4, n))
        kind = rng.integers(0, 3, n)
        order = np.lexsort((kind, pick))
        table = {"pick": pick[order], "kind": kind[order], "key": np.arange(n), "start": np.arange(n) * 3, "stop": np.arange(n) * 3 + 9}
        batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in table.items()} | {"sure": pa.array([False] * n)})
        out = pa.Table.from_batches(list(repeats._sorted_out(iter(batch.slice(i, rows) for i in range(0, n, rows)))) or [pa.RecordBatch.from_pydict({k: pa.array([], pa.int64()) for k in ("key", "start", "stop", "sent")})]).to_pylist()
        pairs = list(zip(table["pick"].tolist(), table["kind"].tolist(), strict=True))
        assert sorted(r["key"] for r in out if r["sent"] is None) == [i for i in range(n) if pairs.count(pairs[i]) > 1]
        heads = [i for i in range(n) if (i == 0 or pairs[i] != pairs[i - 1]) and len({k for p, k in pairs if p == pairs[i][0]}) > 1]
        ids = repeats.sent_id(*(table[c][heads].astype(np.int64) for c in ("pick", "kind", "key", "start")))
        assert sorted(r["sent"] for r in out if r["sent"] is not None) == sorted(ids.tolist())


def test_equal_stretches_pick_alike():
    rng = random.Random(2)
    same = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300))) + same + "zz" * k for k in range(4)]
    data, bounds = hashing.text_bytes(pa.array(texts))
    sums = hashing.prefix(data)
    row, place, first, last = repeats.picks(data, bounds, sums)
    owner = {}
    for r, p, a, b in zip(row.tolist(), place.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in range(a, b + 1):
            assert s not in owner
            owner[s] = p - s
    assert sorted(owner) == [int(bounds[r]) + i for r in range(4) for i in range(max(0, len(texts[r]) - 199))]
    starts = [int(bounds[r]) + t.index(same) for r, t in enumerate(texts)]
    for k in range(61):
        assert len({owner[s + k] for s in starts}) == 1


@settings(max_examples=100, deadline=None)
@given(st.text("abcé", max_size=12), st.text("abcé", max_size=30))
def test_nearest(item, text):
    assert decontamination.nearest(item, text) == edits_within(item, text)


def _mutated(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        how = rng.randrange(3)
        out[at : at + (how != 1)] = [] if how == 0 else [rng.choice("abcdefghij ")]
    return "".join(out)


def test_recall_of_edited_items():
    rng = random.Random(8)
    item = lambda: " ".join("".join(rng.choice("aeioustrnlé") for _ in range(rng.randrange(1, 9))) for _ in range(40))
    items = [item() for _ in range(12)]
    find = decontamination.Finder(list(enumerate(items)))
    hit = held = 0
    for number, text in enumerate(items):
        edits = find.items[number].edits
        for e in range(0, edits + 6, 2):
            doc = f"{item()} {_mutated(rng, text, e).upper() if e % 4 else _mutated(rng, text, e)}\n {item()}"
            truth = decontamination.nearest(find.items[number].text, decontamination.plain(doc)) <= edits
            found = find(_batch([item(), doc]))
            assert all(key == (1, number) for key in found) and (truth or not found)
            held += truth
            hit += truth and bool(found)
    assert held >= 100 and hit >= 0.98 * held


def _prose(rng, size):
    """Prose whose words are shared by all texts, cut to a number of characters."""
    words = "the of and a to in is was water people number sound other through following government development information important together".split()
    out = ""
    while len(out) < size:
        out += rng.choice(words) + " "
    return out[:size].strip()


@pytest.mark.parametrize("size", [16, 40, 100, 250, 600, 1000, 2000])
def test_recall_of_items_at_the_limit(size):
    """Edits at random up to the limit, spread evenly, or a tenth cut off at a document's start or end: nine in ten are found at least."""
    rng = random.Random(size)
    items = [_prose(rng, size) for _ in range(8)]
    find = decontamination.Finder(list(enumerate(items)))
    docs, of = [], []
    for number, item in enumerate(find.items):
        text, cut = item.text, len(item.text) // 10
        evenly = "".join(rng.choice("zqx") if i % 10 == 5 and i < 10 * cut else c for i, c in enumerate(text))
        for changed in (text, _mutated(rng, text, cut), _mutated(rng, text, cut // 2), evenly, "z" * cut + text[cut:], text[: size // 2] + "é" * cut + text[size // 2 :]):
            docs.append(f"{_prose(rng, 200)} {text[: size // 3]} {_prose(rng, 50)} {changed} {_prose(rng, 200)}")
        docs += [text[cut:] + f" {_prose(rng, 300)}", f"{_prose(rng, 300)} {text[:-cut]}", text[cut:], text[cut // 2 :] + "."]
        of += [number] * 10
    docs = [d.strip() for d in docs]
    found = find(_batch(docs))
    held = [(at, n) for at, n in enumerate(of) if decontamination.nearest(find.items[n].text, decontamination.plain(docs[at])) <= find.items[n].edits]
    assert len(held) >= 70 and sum(h in found for h in held) >= (0.9 if size > 20 else 0.8) * len(held)
    for (at, n), least in found.items():
        assert least <= find.items[n].edits and least == decontamination.nearest(find.items[n].text, decontamination.plain(docs[at]))


@pytest.mark.parametrize("size", [10, 11, 13, 15, 17, 19])
def test_short_items_are_all_found(size):
    """Of items that allow one edit none is missed, wherever it stands."""
    rng = random.Random(size)
    items = [_prose(rng, size).ljust(size, "s") for _ in range(25)]
    find = decontamination.Finder(list(enumerate(items)))
    docs, of = [], []
    for number, item in enumerate(find.items):
        for k in range(4):
            changed = _mutated(rng, item.text, 1)
            docs.append([f"{_prose(rng, 90)} {changed} {_prose(rng, 90)}", f"{changed} {_prose(rng, 90)}", f"{_prose(rng, 90)}{changed}", changed][k].strip())
            of.append(number)
    found = find(_batch(docs))
    held = [(at, n) for at, n in enumerate(of) if decontamination.nearest(find.items[n].text, decontamination.plain(docs[at])) <= 1]
    assert len(held) >= 90 and all(h in found for h in held)
    assert all(decontamination.nearest(find.items[n].text, decontamination.plain(docs[at])) == d for (at, n), d in found.items())


def test_a_shared_opener_does_not_call_for_every_item():
    """Items that begin alike: a text of their opener alone meets none often enough, and each is still found by the rest."""
    rng = random.Random(12)
    opener = "which of the following statements about the "
    rest = lambda: " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(3, 9))) for _ in range(18))
    items = [opener + rest() for _ in range(300)]
    find = decontamination.Finder(list(enumerate(items)))
    text = decontamination.folded(*decontamination.text_bytes(_batch([opener * 40]).column("text")))
    assert len(find.stretches(*text)[0]) < 30
    docs = [f"{_prose(rng, 80)} {_mutated(rng, items[n], len(items[n]) // 12)} {_prose(rng, 80)}" for n in range(0, 300, 6)]
    found = find(_batch(docs))
    held = [(at, n) for at, n in enumerate(range(0, 300, 6)) if decontamination.nearest(find.items[n].text, decontamination.plain(docs[at])) <= find.items[n].edits]
    assert len(held) > 40 and sum(h in found for h in held) >= 0.95 * len(held)


def test_items_without_spaces_and_with_wide_characters():
    rng = random.Random(4)
    kanji = "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(120))
    token = "".join(rng.choice("abcdef0123456789") for _ in range(200))
    quoted = f"{_prose(rng, 300)}’s {_prose(rng, 60)}"
    marks = "+-=/ ** <> !! ++ -- ## @@ %% && ?? ;; :: ,,"
    items = [kanji, token, quoted, marks, "tiny"]
    find = decontamination.Finder(list(enumerate(items)))
    docs = [f"天地{kanji[:60]}玄{kanji[61:]}黄", f"{token[:90]}z{token[90:]}", f"x {quoted.upper()}", f"a {marks} b", "a tinyest", kanji[:50], _prose(rng, 900)]
    assert sorted(find(_batch(docs))) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]


def test_lists_stop_early_and_right():
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, (4, 16))
    matrix = np.floor(64 * (centre[rng.integers(0, 4, 900)] + rng.normal(0, 0.1, (900, 16))))
    matrix[5:9] = matrix[4]
    ids = rng.permutation(900)
    for low in (np.iinfo(np.int64).min, None):
        lists = topk.Lists(ids, matrix)
        for q in range(30):
            scores = (matrix @ matrix[q]).astype(np.int64)
            other = ids != ids[q]
            order = topk.best(ids[other], scores[other], 20)
            got, values = lists.search(ids[q], matrix[q], int(scores[other][order][-1]) if low is None else low, 20)
            assert got.tolist() == ids[other][order].tolist() and values.tolist() == scores[other][order].tolist()
        assert lists.reads < 0.9 * 30 * 900 * 16  # lists were not read to their ends
    assert [len(x) for x in lists.search(-1, np.zeros(16), 1, 20)] == [0, 0]
    assert lists.search(-1, np.zeros(16), 0, 3)[0].tolist() == [0, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.integers(-3, 3), min_size=3, max_size=3), st.integers(1, 6))
def test_threshold_algorithm_with_ties(rows, query, k):
    matrix, query = np.array(rows, float), np.array(query, float)
    ids = np.random.default_rng(len(rows)).permutation(len(rows))
    scores = (matrix @ query).astype(np.int64)
    order = topk.best(ids, scores, k)
    got, values = topk.Lists(ids, matrix).search(-1, query, topk.LOWEST, k)
    assert got.tolist() == ids[order].tolist() and values.tolist() == scores[order].tolist()


def test_products_beyond_64_bits():
    a = np.array([[2.0**60, 3.0]])
    assert topk.products(a, np.array([[2.0**60, 1.0], [0.0, 5.0], [-(2.0**60), 0.0]])).tolist() == [[topk.HIGHEST, 15, topk.LOWEST]]


def test_models_tell_words_apart():
    words = [b"good", b"plain", b"text", b"vilix", b"vilor"]
    model = toxicity.fit(words, np.array([50.0, 50, 50, 30, 20]), np.array([90.0, 90, 90, 0, 0]))
    data = np.frombuffer(b"vilumgoodzzz", np.uint8)
    ratio = toxicity.word_ratios(model, data, np.array([0, 5, 9]), np.array([5, 9, 12]))
    assert ratio[0] > 1 > ratio[1] and abs(ratio[2]) < ratio[0]
    empty = toxicity.fit([], np.zeros(0), np.zeros(0))
    assert toxicity.word_ratios(empty, data, np.array([0]), np.array([5])).tolist() == [0.0]


def test_models_are_distributions():
    """After every seen context the chances of all bytes and the end come to one, for both classes."""
    words, tox, ord_ = [b"aab", b"ab", b"b", b"ba"], np.array([3.0, 1, 2, 5]), np.array([1.0, 4, 2, 2])
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    codes, _ = toxicity.spelt(data, np.append(0, ends[:-1]), ends)
    model = toxicity.fit(words, tox, ord_)
    assert set(model["seen"]) == set(np.unique(codes)) and np.isfinite(model["ratio"]).all() and np.isfinite(model["open"]).all()
    for counts in (tox, ord_):
        plain = KneserNey(words, counts, words, tox + ord_, toxicity.ORDER, toxicity.DISCOUNT, 258)
        for context in [*plain.contexts, (0, 0, 0, 0, 99), (1, 2, 3, 4, 5)]:
            assert np.isclose(sum(plain.chance(context, b) for b in range(258)), 1)


def test_ratios_against_a_plain_kneser_ney():
    """Log ratios of words, seen or not, by dictionaries of counts, order by order."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(40)})
    words = [w.encode() for w in words]
    tox, ord_ = (np.array([float(rng.randrange(4)) for _ in words]) for _ in "xy")
    model = toxicity.fit(words, tox, ord_)
    both = [KneserNey(words, c, words, np.ones(len(words)), toxicity.ORDER, toxicity.DISCOUNT, 258) for c in (tox, ord_)]
    for word in [*words, b"abcabcabcabc", b"cab", b"zz", b"az", b"a"]:
        raw = np.frombuffer(word, np.uint8)
        got = toxicity.word_ratios(model, raw, np.array([0]), np.array([len(word)]))[0]
        assert np.isclose(got, both[0].log_chance(word) - both[1].log_chance(word)), word


def test_templates():
    assert all(t.words[a:b] for t in license_scan.BASE + license_scan.NOTICES for a, b in t.phrases)
    index = license_scan.rarest(license_scan.BASE, {"license": 9})
    assert index[0] == {"mit": [0], "license": [1]}


def test_families_have_what_tests_need():
    rows = families()
    raw, gone = removed([t for _, t in rows], 200)
    assert any(map(any, gone)) and not all(map(all, gone)) and len(raw) == len(rows)


def test_words_are_spelt_to_their_end():
    rng = random.Random(9)
    letters = "天地人日月山水火木金土上下"
    plain = lambda n: "".join(rng.choice(letters) for _ in range(n))
    words = [plain(200).encode() for _ in range(60)] + [f"{plain(rng.randrange(200))}毒蛇咬{plain(100)}".encode() for _ in range(60)]
    model = toxicity.fit(words, np.array([0.0] * 60 + [1.0] * 60), np.array([1.0] * 60 + [0.0] * 60))
    for text in ("毒蛇咬{}", "{}毒蛇咬", "{0}毒蛇咬{0}", "{0}、{0}毒蛇咬{0}"):
        text = text.format(plain(300))
        clean, bad = toxicity.features(model, _batch([text.replace("毒蛇咬", "天地人"), text]))
        assert not np.isclose(bad[0], clean[0]) and bad[4] == clean[4] == 1 + text.count("、")
        # the pieces of a word add up to the whole
        text = text.replace("、", "")
        raw = np.frombuffer(text.encode(), np.uint8)
        word, start, end = toxicity.pieces(np.array([0]), np.array([len(raw)]))
        parts = toxicity.word_ratios(model, raw, start, end, np.zeros(len(word), np.int64), np.full(len(word), len(raw)))
        assert len(parts) > 10 and np.isclose(parts.sum(), toxicity.word_ratios(model, raw, np.array([0]), np.array([len(raw)]))[0])


def test_other_spaces_and_punctuation_end_words():
    texts = ["bad word.", "bad\u00a0word", "bad\u3000word", "bad，word。", "«bad» – word", "bad\u2028word\u0085", "bad, word"]
    model = toxicity.fit([b"bad", b"word"], np.array([9.0, 1]), np.array([1.0, 9]))
    x = toxicity.features(model, _batch(texts))
    assert (x == x[0]).all() and x[0, 4] == 2
    assert toxicity.features(model, _batch(["é", "", "日本", "🙂", "naïve\u200dx"]))[:, 4].tolist() == [1, 0, 1, 1, 1]


def test_what_cannot_repeat_is_not_sorted(monkeypatch):
    """Nearly all contexts that have the pick alone in common stay out of the sorting; those that have more are judged as by brute force, in any memory."""
    rng, sizes, real = random.Random(6), [], repeats.repeated
    pick, *tail = (bytes(rng.choices(b"abcdefgh ", k=n)) for n in (48, 90, 90))
    texts = [bytes(rng.choices(b"abcdefgh ", k=100)) + pick + bytes(rng.choices(b"abcdefgh ", k=140)) for _ in range(400)]
    texts += [texts[k][:10] + tail[0] + pick + tail[1] + texts[k][-50:] for k in range(3)]
    columns = {"pick": [5] * len(texts), "key": list(range(len(texts))), "start": [7] * len(texts), "place": [100] * len(texts)}
    table = pa.table({k: pa.array(v, pa.int32() if k == "place" else pa.int64()) for k, v in columns.items()} | {"bytes": pa.array(texts, pa.binary())})
    monkeypatch.setattr(repeats, "repeated", lambda text, *rest: sizes.append(len(text)) or real(text, *rest))
    for memory in (1, 1 << 20):
        got = {(r["key"], i) for b in repeats._shard(iter(table.to_batches(64)), 200, memory) for r in b.to_pylist() for i in range(r["start"], r["stop"])}
        strings = {}
        for k, t in enumerate(texts):
            for i in range(len(t) - 199):
                strings.setdefault(t[i : i + 200], []).append((k, i))
        assert got == {(k, 7 + i + j) for own in strings.values() if len(own) > 1 for k, i in own for j in range(200)} and got
    assert sizes[1] < sum(map(len, texts)) / 4, sizes


def test_what_an_encoder_remembers_is_not_copied(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    encode, whole = (tokens.Encoder(tokens.public_path("word_bpe_49k.json")) for _ in range(2))
    texts = ["one two three four", "two five", "six seven eight nine", "one Two"]
    encode([texts[0]])
    before = encode.known
    encode([texts[1]])
    assert encode.known.older is before and not before.older
    assert [encode([t]) for t in texts] == [[whole._whole(t)] for t in texts]
