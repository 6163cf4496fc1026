"""Small tables for the operators, and brute-force versions of them."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import xxhash

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows, extra=False):
    """documents from (doc_id, text[, lang[, source]]); extra adds columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if extra:
        for name in ("digest", "fp", "kept", "keep_id", "n_words", "size", "key", "rank", "n", "item", "stratum", "of", "ids", "n_tokens", "component_id", "best", "copies", "rows", "winner_", "item_", "text_in", "symbol_ratio", "order"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
    return df


def words(text):
    return WORD.findall(text or "")


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "b"), (None, "a text without an id", "de", None), (None, None, None, None),
        (4, "same words here\tnow", "en", "a"), (5, "same words  here now", "en", "a"), (5, "same words  here now", "en", "a"),
        (6, long_text, "fr", "b"), (7, long_text, "fr", None), (8, "x" * 20_000, "en", "a"), (9, "one", "en", "c"), (10, "one two", "en", "c"),
        (11, "É ü 日本語 \x1c \x85 words\x0bsplit", "es", "c"), (12, "line\nline\nline\n\n", "en", "c"),
    ]


def corpus(n=240, seed=3):
    """Texts of made-up words in two languages, with copies, near copies and a hot source."""
    r = random.Random(seed)
    vocab = {"en": ["the", "of", "and", "thing", "house", "water", "light", "going", "under", "over", "with", "stone", "river"], "de": ["der", "und", "nicht", "haus", "wasser", "licht", "über", "stein", "fluß", "gehen", "mit", "auch", "ein"]}
    rows = []
    for i in range(n):
        lang = r.choice(["en", "de"])
        kind = r.random()
        if rows and kind < 0.15:
            _, text, lang, _ = r.choice(rows)
            text = text.replace(" ", "  ", 1) if r.random() < 0.5 else text
        elif rows and kind < 0.3:
            _, text, lang, _ = r.choice(rows)
            cut = text.split(" ")
            cut[r.randrange(len(cut))] = r.choice(vocab[lang])
            text = " ".join(cut)
        else:
            text = " ".join(r.choice(vocab[lang]) for _ in range(r.randint(1, 200)))
        rows.append((i, text, lang, "hot" if r.random() < 0.4 else f"s{r.randrange(5)}"))
    return rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    out = []
    for r in rows:
        g = [i for i in groups[normal(r[1])] if i is not None]
        out.append((r[0], min(g) if g else None, len(groups[normal(r[1])]), hashlib.sha256(normal(r[1]).encode()).hexdigest()))
    return out


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, close):
    """Indices of values in components of pairs that are close: a list of representatives."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if close(values[i], values[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def brute_near(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    part = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for r, p in zip(rows, part):
        if r[0] is not None:
            first[p] = min(first.get(p, r[0]), r[0])
    return [(r[0], f"{f:016x}", first.get(p)) for r, f, p in zip(rows, fps, part)]


def brute_quality(text):
    text = text or ""
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)


def brute_targets(sizes, weights=(3, 1, 2)):
    """Targets by resharing the excess round by round, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = {s: Fraction(0) for s in names}, Fraction(3, 2) * sum(sizes.values())
    free = [s for s in names if sizes[s]]
    while left > Fraction(1, 10**9) and free:
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += left * w[s] / total
        left = Fraction(0)
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = Fraction(2 * sizes[s])
                free.remove(s)
    return target


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
