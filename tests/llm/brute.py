"""Plain versions of the operators, for small inputs, and texts to try them on."""

import hashlib
import math
import random
import re
from collections import defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "é", "x" * 3000, "a b c", "A B C", "K İ ß", "a\x1cb c d e f"]


def frame(spark, rows):
    """Documents of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def families(seed=0, groups=6, copies=5, length=60):
    """Texts with exact copies, near copies at many distances, and passages shared by otherwise different texts."""
    rng, out = random.Random(seed), []
    shared = prose(rng, 60)
    for _ in range(groups):
        base = prose(rng, length).split()
        out.append(" ".join(base))
        for c in range(copies):
            near = list(base)
            for _ in range(c):
                near[rng.randrange(len(near))] = f"n{rng.randrange(99)}"
            out.append(" ".join(near))
        out.append(out[-1])
        out.append(f"{prose(rng, 20)} {shared} {prose(rng, 20)}")
    return list(enumerate(out))


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def components(rows, size, percent):
    """(n_shingles, smallest id of the component) of each row, in order."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(len(sets[i]), min(least[find(i)], default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def removed(texts, length):
    """Which bytes of each text a string covers that starts more than once."""
    raw, seen = [(t or "").encode() for t in texts], defaultdict(list)
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append((d, i))
    out = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d][i : i + length] = b"\1" * length
    return raw, out


def digest(raw, gone):
    kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
    spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
    return len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def edits_within(item, text):
    """The smallest edit distance of the item to a stretch of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[:], 0
        for i in range(1, len(row)):
            row[i] = min(last[i] + 1, row[i - 1] + 1, last[i - 1] + (item[i - 1] != c))
        best = min(best, row[-1])
    return best


class KneserNey:
    """A byte model of words: discounted counts of one class over continuation counts that all classes share, by dictionaries."""

    def __init__(self, words, counts, shared_words, shared, order, discount, size):
        self.order, self.discount, self.size = order, discount, size
        self.top = defaultdict(lambda: defaultdict(float))
        seen = set()
        for word, n in zip(words, counts, strict=True):
            for gram in self.grams(word):
                if n:
                    self.top[gram[:-1]][gram[-1]] += n
        for word in shared_words:
            seen.update(self.grams(word))
        self.contexts = list(self.top)
        self.lower = []  # by the length of the context: continuation counts
        for n in range(order - 1, 0, -1):
            table = defaultdict(lambda: defaultdict(float))
            shorter = set()
            for gram in seen:
                table[gram[1:-1]][gram[-1]] += 1
                shorter.add(gram[1:])
            self.lower.append(table)
            seen = shorter

    def grams(self, word):
        codes = [0] * (self.order - 1) + [b + 1 for b in word] + [257]
        return [tuple(codes[i : i + self.order]) for i in range(len(codes) - self.order + 1)]

    def _shared(self, level, context, byte):
        if level == len(self.lower):
            return 1 / self.size
        below = self._shared(level + 1, context[1:], byte)
        found = self.lower[level].get(context)
        if not found:
            return below
        total = sum(found.values())
        return (max(found.get(byte, 0) - self.discount, 0) + self.discount * len(found) * below) / total

    def chance(self, context, byte):
        below = self._shared(0, context[1:], byte)
        found = self.top.get(context)
        if not found:
            return below
        total = sum(found.values())
        return max(found.get(byte, 0) - self.discount, 0) / total + self.discount * len(found) / total * below

    def log_chance(self, word):
        return sum(math.log(self.chance(g[:-1], g[-1])) for g in self.grams(word))
