import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
import tiktoken
from tokenizers import Tokenizer

from marlspike.llm import byte_bpe, language_id, license_scan, secret_scan, token_counts
from tests.llm.helpers import awkward_rows, corpus, docs_of, held_out

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD_TEXTS = [None, "", " ", "a  b   c\n\n d \n  e\t f  ", "\x1c a \x1c\x1d b", "日本語 テキスト  です　 x", "don't  I'LL 12 345  ...!!   y  z", " \n", "é ü ß <|endoftext|> a", "x" * 30_000, "  a   b", "a\r\n b\r\n\r\n  c", "İ ΑΣ Å é x́"]
key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_library(spark, encoding):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS + [r[1] for r in corpus(60)])] + awkward_rows()
    out = byte_bpe.digests(docs_of(spark, rows, extra=True), RANKS, P.PATTERN).collect()
    want = []
    for r in rows:
        ids = encoding.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_bpe_random_bytes_round_trip(encoding):
    ranks = byte_bpe.read_ranks(RANKS)
    bpe = byte_bpe.ByteBpe(ranks, byte_bpe.sentencepiece_model(ranks), P.PATTERN)
    r = random.Random(1)
    alphabet = "ab cdeéß'st \n\t\r\x0b\x1c\x85  　.,!?0123日本語🙂\x00"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)]
    for text, ids in zip(texts, bpe.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_bpe_encode_decode_tables(spark):
    docs = docs_of(spark, [(i, t) for i, t in enumerate(ODD_TEXTS)], extra=False)
    encoded = byte_bpe.encode(docs, RANKS, P.PATTERN, verify=True)
    assert encoded.columns == [*docs.columns, "n_tokens", "ids"]
    back = byte_bpe.decode(encoded, RANKS, P.PATTERN).collect()
    assert [r.decoded for r in sorted(back, key=lambda r: r.doc_id)] == [t or "" for t in ODD_TEXTS]
    assert byte_bpe.encode(docs_of(spark, []), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_clashing_columns_and_unknown_ids(spark):
    docs = docs_of(spark, [(1, "some text here"), (2, None), (3, "")], extra=True).withColumn("IDS", F.lit("y")).drop("ids")
    out = byte_bpe.encode(docs, RANKS, P.PATTERN, verify=True)
    assert sorted(out.columns) == sorted([c for c in docs.columns if c not in ("IDS", "n_tokens")] + ["n_tokens", "ids"])
    assert {r.doc_id: (r.n_tokens > 0, len(r.ids) > 0) for r in out.collect()} == {1: (True, True), 2: (False, False), 3: (False, False)}
    rows = [(np.array([1, 4_000_000_000], "<u4").tobytes(),), (b"",), (None,), (b"\x01",)]
    back = byte_bpe.decode(spark.createDataFrame(rows, "ids binary").withColumn("decoded", F.lit(1)), RANKS, P.PATTERN).collect()
    assert [r.decoded if r.ids is None or not r.ids else r.decoded[-1] for r in back] == ["\ufffd", "", None, "\ufffd"]
    assert byte_bpe.SPLITTABLE == P.PATTERN
    ranks = byte_bpe.read_ranks(RANKS)
    other = r"\S+ \S+|\s+|\S+"  # matches reach over spaces
    bpe, lib = byte_bpe.ByteBpe(ranks, byte_bpe.sentencepiece_model(ranks), other), tiktoken.Encoding("own", pat_str=other, mergeable_ranks=ranks, special_tokens={})
    texts = ["two words and more of them", "a  b c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_all(texts)] == [lib.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_library(spark, tmp_path, name):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS + ["<|startoftext|>x <|ENDOFTEXT|> y<|endoftext|>"] + [r[1] for r in corpus(40)])] + awkward_rows()
    t = token_counts.Tokenizer(P.path(name))
    assert t.by_word == (name == "word_bpe_49k.json")
    out = token_counts.count_tokens(docs_of(spark, rows, extra=True), t, str(tmp_path / "cache"), limit=50).collect()
    if name.endswith(".json"):
        lib = Tokenizer.from_file(P.path(name))
        n = [len(lib.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    else:
        import sentencepiece

        n = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode([r[1] or "" for r in rows])]
    want = [(r[0], len((r[1] or "").encode()), k, k > 50) for r, k in zip(rows, n)]
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_token_counts_of_random_words():
    t = token_counts.Tokenizer(P.path("word_bpe_49k.json"))
    count, lib = token_counts.Counter(t.file, t.kind, t.by_word), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    r = random.Random(2)
    pieces = ["a", "The", "HOUSE", "é", "É", "ß", "ΑΣ", "İ", "x́", "'s", "'LL", "'", ".", ",", "!?", ")", '"', "1", "23", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "ʼ", "日本", "_", "-", " ", " ", "\n", "\u00a0", "ªº", "Ⅷ", "ǅ"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(4000)]
    assert count(texts) == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]


def test_token_cache(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    t = token_counts.Tokenizer(P.path("word_bpe_49k.json"))
    first = docs_of(spark, [(1, "a b"), (2, "a  b"), (3, "c")])
    assert token_counts.count_tokens(first, t, cache).count() == 3
    assert spark.read.parquet(cache).count() == 2  # one for each normalised text
    # misses are encoded once and appended, whether their digests are broadcast or joined
    for few, word, total in ((100, "new", 3), (0, "newer", 4)):
        monkeypatch.setattr(token_counts, "BROADCAST_MISSES", few)
        more = docs_of(spark, [(4, "a\nb"), (5, word), (6, word)])
        assert token_counts.count_tokens(more, t, cache).count() == 3
        assert spark.read.parquet(cache).count() == total
    other = token_counts.Tokenizer(P.path("byte_bpe_50k.json"))
    assert {r.n_tokens for r in token_counts.count_tokens(docs_of(spark, [(1, "c")]), other, cache).collect()} == {1}
    assert spark.read.parquet(cache).count() == 5  # counts of another tokenizer are not used
    assert token_counts.count_tokens(docs_of(spark, []), t, cache).count() == 0


def test_gru_gradients_are_right():
    m = language_id.new_model(["a", "b", "c"], hidden=4)
    for x in m.arrays():
        x.flags.writeable = True
    m64 = language_id.Model(m.langs, *[[a.astype(np.float64) for a in part] for part in (m.table, m.u, m.c, m.w)], m.b.astype(np.float64))
    r = np.random.default_rng(0)
    x, y = r.integers(0, 8, (7, 5)), r.integers(0, 3, 5)
    _, grads = language_id.gradients(m64, x, y)
    for a, g in zip(m64.arrays(), grads):
        for _ in range(6):
            i = tuple(r.integers(0, n) for n in (8 if n > 8 else n for n in a.shape))
            keep, eps = a[i], 1e-4
            a[i] = keep + eps
            up = language_id.gradients(m64, x, y)[0]
            a[i] = keep - eps
            down = language_id.gradients(m64, x, y)[0]
            a[i] = keep
            assert abs((up - down) / (2 * eps) - g[i]) < 1e-4


def test_predictor_agrees_with_training_network():
    m = language_id.new_model(["a", "b"], hidden=5)
    text = "some bytes to read" * 3
    raw = text.encode()
    x = np.frombuffer(raw, np.uint8).astype(int)[:, None]
    h = [np.stack([s[5] for s in language_id._states(m, d, x)][:: 1 - 2 * d]) for d in (0, 1)]
    p = language_id._softmax(m.w[0] @ h[0] + m.w[1] @ h[1] + m.b[:, None]).mean(axis=0)[:, 0]
    langs, scores = language_id.Predictor(m)([text, None, "123 ...", ""])
    assert langs == ["ab"[p.argmax()], "und", "und", "und"] and abs(scores[0] - p.max()) < 1e-5 and scores[1:] == [0, 0, 0]


def test_language_id_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 150)
    rows = corpus(600)
    docs = docs_of(spark, rows + [(9000, None, "en"), (9001, "12 34", "de"), (None, "der und nicht haus", None)], extra=True)
    out = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(r.held_out == held_out(i) for i, r in out.items() if i is not None)
    test = [(r[2], out[r[0]].lang_pred) for r in rows if held_out(r[0]) and len(r[1]) > 40]
    assert np.mean([a == b for a, b in test]) > 0.97
    assert (out[9000].lang_pred, out[9000].score, out[9001].lang_pred, out[None].lang_pred) == ("und", 0.0, "und", "de")
    hot = docs_of(spark, [(1, f"the same id {i}", "en") for i in range(900)] + rows)
    assert len(language_id.fit(hot, per_lang=20).langs) == 2
    none = language_id.identify(docs_of(spark, []))
    assert none.count() == 0
    assert {r.lang_pred for r in language_id.identify(docs_of(spark, [(1, "text", None)])).collect()} == {"und"}


def test_every_language_is_learned_from_all_of_a_text(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language_id, "train", lambda windows, y, langs: seen.update(windows=windows, y=y, langs=langs))
    langs = [f"l{i}" for i in range(300)]
    rows = [(i, f"word {i} of it", lang) for i, lang in enumerate(langs * 4)] + [(10_000 + i, f"text {i}", "hot") for i in range(900)]
    kept = {r[2] for r in rows if not held_out(r[0])}
    for lanes in (100_000, 5):  # by broadcast and by a shuffle
        monkeypatch.setattr(language_id, "BROADCAST_LANGS", lanes)
        language_id.fit(docs_of(spark, rows), per_lang=3, most_docs=600)
        assert seen["langs"] == sorted(kept) and len(kept) > 290
        assert set(seen["y"]) == set(range(len(kept)))
    long_text = "".join(chr(97 + i // 100) for i in range(2600))
    language_id.fit(docs_of(spark, [(i, long_text, "x") for i in range(200)]), windows_per_doc=2, window=8)
    assert {bytes([b]) for b in seen["windows"].ravel() if b < 256} == {bytes([97 + i]) for i in range(26)}


def _dice(words, template):
    import collections

    a = collections.Counter(zip(words, words[1:]))
    t = license_scan.template_words(template)
    b = collections.Counter(zip(t, t[1:]))
    return 2 * sum((a & b).values()) / (len(words) - 1 + len(t) - 1)


def test_license_scan(spark):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 300)
    rows = [(1, "Released under the MIT License."), (2, "foo bar\nLicensed under CC BY-NC 4.0.\nmore"), (3, mit.replace("free of charge", "free of all charge")), (4, "intro\n\n" + mit[:200] + "\n" + mit[200:] + "\n\nend of it"), (5, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (6, "The house of the river."), *[(None if r[0] is None else r[0] + 100, *r[1:]) for r in awkward_rows()]]
    out = {r.doc_id: r for r in license_scan.scan(docs_of(spark, rows, extra=True)).collect()}
    assert [out[i].licenses for i in range(1, 7)] == ["MIT", "CC-BY-NC-4.0", "MIT", "MIT", "Apache-2.0,MIT", ""]
    assert out[3].best_dice == pytest.approx(_dice(license_scan.template_words(rows[2][1]), mit)) and out[5].n_passages == 2
    assert license_scan.scan(docs_of(spark, [])).count() == 0
    plan = license_scan.scan(docs_of(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_license_scan_equals_sql(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, (_, t) in enumerate(license_scan.TEMPLATES)] + [(i, r[1]) for i, r in enumerate(awkward_rows(), 100)] + [(200 + i, "x\n\n" + t + "\n \n" + t[: len(t) // 2]) for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    docs = docs_of(spark, rows)
    documents = docs.toPandas()  # noqa: F841  DuckDB finds it by name
    want = duckdb.sql(license_scan.scan_sql()).fetchall()
    got = [(r.doc_id, r.licenses, r.n_passages, r.best_dice) for r in license_scan.scan(docs).collect()]
    assert sorted(got) == sorted(want)


def _whole(name, least):
    return max((t for n, t in license_scan.TEMPLATES if n == name), key=len) if least else next(t for n, t in license_scan.TEMPLATES if n == name)


def test_licence_files_and_versions(spark):
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    whole = {n: "Copyright (c) 2020 Jane Doe. All rights reserved.\n\n" + _whole(n, True).replace(". ", ".\n").replace(": ", ":\n\n") for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")}
    rows = [(*x, "en") for x in enumerate([gnu.format("", "2"), gnu.format("", "3"), gnu.format("Lesser ", "3"), gnu.format("Affero ", "3"), gnu.format("Lesser ", "2.1"), *whole.values()])]
    got = {r.doc_id: r.licenses for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert [got[i] for i in range(5)] == ["GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "LGPL-2.1"]
    assert all(name in got[5 + i].split(",") for i, name in enumerate(whole)) and "BSD-3-Clause" not in got[7]


def brute_windows(text, least=0.8):
    import collections
    import re

    flat = re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")
    grams = list(zip(flat, flat[1:]))
    bags = [(name, collections.Counter(zip(t, t[1:])), len(t) - 1, tuple(t[:2])) for name, t in ((n, license_scan.template_words(t)) for n, t in license_scan.TEMPLATES)]
    names, best = set(), 0.0
    for i in range(len(grams)):
        fits = []
        if not any(grams[i] in bag for _, bag, _, _ in bags):
            continue
        for name, bag, size, first in bags:
            window = grams[i : i + size]
            shared = sum((collections.Counter(window) & bag).values())
            dice = 2 * shared / (len(window) + size)
            if dice >= least:
                fits.append((-shared, -dice, name, grams[i] == first or grams[i] in bag and (i == 0 or grams[i - 1] not in bag)))
        if any(begins for *_, begins in fits):
            names.add(min(fits)[2])
            best = max(best, -min(fits)[1])
    return ",".join(sorted(names)), best


def _glued(r):
    """Templates among other words on one line, whole, cut, changed, run together or twice."""
    rows = []
    for _, t in license_scan.TEMPLATES:
        w = t.split(" ")
        spot = r.randrange(len(w))
        for piece in (t, " ".join(w[: spot] + ["changed"] + w[spot + 1 :]), " ".join(w[r.randrange(max(1, len(w) // 4)) :]), t + " " + t, t + " " + r.choice(license_scan.TEMPLATES)[1]):
            rows.append((len(rows), f"Notes on rivers in winter {r.choice(['', '. ', ' of the '])}{piece}{r.choice(['', ' and', ' and so on to the end of it all'])}"))
    return rows


def test_windows_equal_brute_force_and_sql(spark):
    import duckdb

    rows = _glued(random.Random(21)) + [(1000 + i, r[1]) for i, r in enumerate(awkward_rows()) if i != 7]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in license_scan.scan(docs, windows=True).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert (got[i].notices, got[i].best_window) == brute_windows(text or ""), text
    documents = docs.toPandas()  # noqa: F841  DuckDB finds it by name
    assert sorted(tuple(r) for r in got.values()) == sorted(duckdb.sql(license_scan.scan_sql(windows=True)).fetchall())
    assert license_scan.scan(docs_of(spark, []), windows=True).count() == 0


def test_notices_among_other_words(spark):
    bsd = _whole("BSD-3-Clause", True).replace(": 1.", ":\n\n1.").replace(". 2.", ".\n\n2.").replace(". 3.", ".\n\n3.").replace(" THIS", "\n\nTHIS", 1)
    apache = next(t for n, t in license_scan.TEMPLATES if n == "Apache-2.0" and len(t) > 300)
    texts = {
        "Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Notes on rivers in winter. Released under the MIT License.": "MIT",
        f"We walked along the river for a day. {apache} Then we went home and wrote it all down.": "Apache-2.0",
        " some more words ".join([bsd] * 3): "BSD-3-Clause",
        f"A story.\n\nCopyright (c) 2020 Jane Doe. All rights reserved.\n\n{bsd}\n\nIt goes on after that, for a long time.": "BSD-3-Clause",
        "We walked under the trees. The license of the public house was on the wall, version 2 of it.": "",
    }
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, rows, extra=True), windows=True).collect()}
    assert [got[i].notices for i in range(len(rows))] == list(texts.values())


def test_every_match_holds_a_telling_stem():
    r = random.Random(8)
    stems = license_scan.telling_stems(license_scan.TEMPLATES, 0.8)
    holds = lambda w: any(x in w if len(x) >= license_scan.STEM else x == w for x in stems)
    for _, t in license_scan.TEMPLATES:
        words = license_scan.template_words(t)
        # words without a stem alone never reach the least similarity
        bare = [w for w in words if not holds(w)]
        assert _dice(bare, t) < 0.8 if len(bare) > 1 else True
        for _ in range(20):  # nor does any text that the stems are cut out of
            cut = [w if not holds(w) else f"z{r.randrange(99)}" for w in words]
            assert _dice(cut, t) < 0.8


def test_size_bounds_are_tight():
    for n in range(1, 60):
        low, high = license_scan.size_bounds(n, 0.8)
        reach = [m for m in range(1, 200) if 2 * min(m, n) / (m + n) >= 0.8]
        assert reach == [m for m in range(1, 200) if low - 1e-9 <= m <= high + 1e-9]
        shared = min(s for m in reach for s in range(min(m, n) + 1) if 2 * s / (m + n) >= 0.8)
        assert license_scan.least_shared(n, 0.8) == shared


def brute_base(text):
    import re

    out = []
    for k, (_, pattern, group, least) in enumerate(secret_scan.BASE):
        flags = re.IGNORECASE | re.ASCII if k == 0 else 0
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


#: The base patterns, written out again: kind, pattern, the group whose length counts, its least length.
SECRETS = [
    ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
]


def test_base_patterns_equal_those_written_out(spark):
    import re

    r = random.Random(12)
    pieces = ["password", "PassWd", "api_key", "apikey", "TOKEN", "secret", " ", "  ", ":", "=", '"', "'", "AKIA" + "A1" * 9, "AKIA0", "0123456789abcdef" * 2, "deadbeef", "ABC", "xyz/+_.-=", "é", "\n", "\t", "ſecret", "hunter2hunter2"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(40)))) for i in range(500)]
    found = 0
    for row, x in zip(rows, sorted(secret_scan.scan(docs_of(spark, rows), RANKS, P.PATTERN).collect(), key=lambda x: x.doc_id)):
        want = []
        for k, (name, pattern, group, least) in enumerate(SECRETS):
            want += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, row[1], re.I | re.A if k == 0 else 0) if len(m[group]) >= least]
        base = ",".join(text for _, _, text in sorted(want))
        found += len(want)
        assert x.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), row[1]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
    assert found > 500


def test_secret_scan(spark):
    r = random.Random(4)
    pieces = ["password", "Token", "API_KEY", "secret", " ", ":", "=", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "x", "é", "\n", ".", "zz-9", "ſecret", "passwd"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(30)))) for i in range(400)] + awkward_rows()
    out = secret_scan.scan(docs_of(spark, rows, extra=True), RANKS, P.PATTERN).collect()
    assert len(out) == len(rows)
    by_text = sorted(((row[0], brute_base(row[1] or "")) for row in rows), key=key)
    got = sorted(((x.doc_id, ",".join(s for s in x.spans.split(",") if s and not s.startswith("random"))) for x in out), key=key)
    assert got == by_text
    for x in out:
        base = [s for s in x.spans.split(",") if s and not s.startswith("random")]
        assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
    assert secret_scan.scan(docs_of(spark, []), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize(
    "word, found",
    [("sk9fQ2LmX7pVbT4wZr8KcN1y", True), ("ghp_R4nd0mT0k3nQwX9z7LkVb2Yp8Ns", True), ("internationalization2024", False), ("very-long-file-name-2023-11-05", False), ("someCamelCaseIdentifier12", False), ("550e8400-e29b-41d4-a716-446655440000", False), ("D41D8CD98F00B204E9800998ECF8427E", False), ("2023-11-05-10-30-00", False), ("averyveryverylongwordindeed", False)],
)
def test_token_efficiency(encoding, word, found):
    text = f"Here is {word}, in a sentence."
    spans = secret_scan.random_spans(text, [], lambda w: len(encoding.encode_ordinary(w)))
    assert [text[a:b] for a, _, b in spans] == ([word] if found else [])
    assert not secret_scan.random_spans(text, [(8, 2, 12)], lambda w: len(w))  # what a base pattern has is not told twice


@pytest.mark.parametrize("name", ["session_cookie=", "authorization=", "x=", ""])
def test_names_do_not_hide_secrets(encoding, name):
    r = random.Random(6)
    found = 0
    for i in range(200):
        value = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24)) + "=" * (i % 3)
        text = f"set {name}{value} here"
        spans = secret_scan.random_spans(text, [], lambda w: len(encoding.encode_ordinary(w)))
        found += any(text[a:b].endswith(value) for a, _, b in spans) and len(spans) == 1
    assert found >= 190
