import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from marlspike.llm import mixing, quality, url_filter
from tests.llm.helpers import awkward_rows, brute_quality, brute_targets, corpus, docs_of, words

key = lambda r: tuple((x is None, str(x)) for x in r)
LABELS = "doc_id long, quality int, toxic int"


def test_features_equal_brute_force():
    r = random.Random(1)
    texts = [None, "", *[t[1] for t in awkward_rows() if len(t[1] or "") < 5000]]
    for _ in range(300):
        texts.append("".join(r.choice(["a", "b", "c dd", " ", " ", "\n", "#", "|", "\x1c", "é", "\t"]) for _ in range(r.randrange(120))))
    got = list(zip(*[x.tolist() for x in quality.text_features(texts)]))
    for t, (n_words, chars, symbols, dup, _, repeat) in zip(texts, got, strict=True):
        assert (n_words, chars, symbols, dup, repeat) == brute_quality(t)[:5], repr(t)


def test_repeats_do_not_cross_documents(monkeypatch):
    monkeypatch.setattr(quality, "_BLOCK_WORDS", 30)
    texts = ["one two three four five six seven eight"] * 9 + ["a b c d e f g h a b c d e f g h i"]
    assert quality.text_features(texts)[5].tolist() == [0] * 9 + [16]


def _tail(k, n, p):
    from fractions import Fraction
    from math import comb

    p = Fraction(p)
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("k,n,risk", [(0, 100, 0.05), (2, 400, 0.02), (1, 59, 0.05), (0, 59, 0.05), (0, 58, 0.05), (10, 5000, 0.0025)])
def test_binomial_bound_is_exact(k, n, risk):
    # the Clopper-Pearson bound is at most risk where P(X <= k) at risk is at most delta
    for delta in (0.05, 0.003):
        assert quality.certified(k, n, risk, delta) == (_tail(k, n, risk) <= delta and k <= n * risk)


def test_false_rejections_are_rarely_over_the_risk():
    r = random.Random(7)
    risk, delta, over = 0.1, 0.1, 0
    grid = quality.GRID["symbol_ratio"]
    for _ in range(200):
        n = 400
        values = [r.random() ** 4 for _ in range(n)]  # good documents
        counts = {f: [n] * len(g) for f, g in quality.GRID.items()}
        counts["symbol_ratio"] = [sum(v > c for v in values) for c in grid]
        caught = {f: list(range(1, len(g) + 1)) for f, g in quality.GRID.items()}  # stricter ones catch more
        cut = quality.choose_cutoffs(n, counts, caught, risk, delta).get("symbol_ratio")
        over += cut is not None and 1 - cut**0.25 > risk / len(quality.GRID)
    assert over <= 200 * delta


def _labelled(n=4000, seed=2):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        text = " ".join(f"w{r.randrange(500)}" + ("" if good or r.random() < 0.5 else "##|") for _ in range(30))
        rows.append((i, text, "en" if i % 41 else "rare"))
        if i % 5:
            labels.append((i, int(good), 0))
    return rows, labels


def test_quality_report_and_stage(spark, monkeypatch):
    monkeypatch.setattr(quality, "RISK", 0.02)
    rows, labels = _labelled()
    rows += [(None if x[0] is None else x[0] + 100_000, *x[1:]) for x in awkward_rows()]
    docs = docs_of(spark, rows, extra=True)
    table = spark.createDataFrame(labels + labels[:5] + [(None, 1, 0), (7, None, None)], LABELS).withColumn("n_words", F.lit("x"))
    out = quality.quality_report(docs, table).collect()
    brute = [(r[0], *brute_quality(r[1])) for r in rows]
    assert sorted([tuple(r)[:7] for r in out], key=key) == sorted(brute, key=key)

    # cutoffs by brute force
    texts, lang = {r[0]: r[1] for r in rows}, {r[0]: r[2] if len(r) > 2 else "en" for r in rows}
    good, bad = collections.defaultdict(list), collections.defaultdict(list)
    for i, q, _ in labels:
        if not brute_quality(texts[i])[5]:
            (good if q == 1 else bad)[lang[i]].append(quality_ratios(texts[i]))
    part = quality.DELTA / len(good) / len(quality.GRID)
    over = lambda rows: {f: [sum(x[f] > c for x in rows) for c in g] for f, g in quality.GRID.items()}
    cuts = {s: quality.choose_cutoffs(len(v), over(v), over(bad[s]), quality.RISK, part) for s, v in good.items()}
    assert set(cuts["en"]) == {"symbol_ratio"} and cuts["rare"] == {}
    caught = sum(x["symbol_ratio"] > cuts["en"]["symbol_ratio"] for x in bad["en"])
    assert caught > 0.4 * len(bad["en"])
    want = [(r[0], not brute_quality(r[1])[5] and all(quality_ratios(r[1])[f] <= c for f, c in cuts.get(r[2], {}).items())) for r in rows]
    assert sorted([(r.doc_id, r.kept) for r in out], key=key) == sorted(want, key=key)

    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([i for i, k in want if k], key=str)


def test_small_strata_give_their_risk_to_the_most_useful_feature(spark):
    for n in (100, 400, 500, 1000, 1200, 2000, 2400):
        assert quality.most_features(n, 0.01, 0.0125) == sum((1 - 0.01 / m) ** n <= 0.0125 / m for m in range(1, 5))
    r = random.Random(3)
    rows, labels = [], []
    for lang in ("en", "fr", "de"):
        for _ in range(560):
            good = r.random() < 0.9
            text = " ".join(f"w{r.randrange(500)}" + ("" if good else "##|") for _ in range(30))
            labels.append((len(rows), int(good), 0))
            rows.append((len(rows), text, lang))
    out = quality.quality_report(docs_of(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    kept = {x.doc_id: x.kept for x in out}
    assert all(kept[i] == bool(q) for i, q, _ in labels)


def test_more_strata_than_any_cap(spark, monkeypatch):
    r = random.Random(5)
    rows, labels = [], []
    for lang in range(300):
        for i in range(40):
            good = i % 4 > 0
            labels.append((len(rows), int(good), 0))
            rows.append((len(rows), " ".join(f"w{r.randrange(500)}" + ("" if good else "##|") for _ in range(20)), f"l{lang}" if lang else None))
    table = spark.createDataFrame(labels, LABELS)
    for most in (100_000, 10):  # by broadcast and by a shuffle
        monkeypatch.setattr(quality, "BROADCAST_STRATA", most)
        monkeypatch.setattr(quality, "BROADCAST_LABELS", most)
        kept = {x.doc_id: x.kept for x in quality.quality_report(docs_of(spark, rows), table, risk=0.5).collect()}
        assert all(kept[i] == bool(q) for i, q, _ in labels)
        assert {x.doc_id for x in quality.keep_good(docs_of(spark, rows, extra=True), table, risk=0.5).collect()} == {i for i, q, _ in labels if q}


def quality_ratios(text):
    n, chars, symbols, dup, repeat, _ = brute_quality(text)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    return {"symbol_ratio": symbols / chars if chars else 0, "dup_line_ratio": dup / lines if lines else 0, "repeat_ratio": repeat / n if n else 0, "word_length": chars / n if n else 0}


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    docs = docs_of(spark, corpus(50))
    out = quality.quality_report(docs, none).collect()
    assert len(out) == 50 and all(r.kept != r.base_failed for r in out)
    assert quality.quality_report(docs_of(spark, []), none).count() == 0
    assert quality.keep_good(docs_of(spark, []), none).count() == 0


PAGES = "page_id long, url string, html string"


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in url_filter.RULES:
        domain, tail = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_url_rules(spark):
    urls = [None, "", "no host/org/", "http://a.ORG/x", "http://org/", "http://example.org/es/1", "https://m.example.org/en/12?q=/es/", "https://example.org/en/2", "http://x.com/fr/1#a", "http://x.com/fr", "ftp://xcom/fr/", "http://a.com?u=http://b.org/", "http://a.org", "x://b.com/de/://c.org/", "http://a.org#/y", "HTTP://A.COM/DE/", "http://b.com/de/\nx", "://a.org/"]
    rows = [(i, u, "<p>") for i, u in enumerate(urls)] + [(None, "http://a.org/1", None), (3, "http://a.ORG/x", "<p>")]
    pages = spark.createDataFrame(rows, PAGES)
    for name in ("host", "path", "rule", "src", "of", "verdict"):
        pages = pages.withColumn(name, F.lit("x"))
    out = url_filter.filter_urls(pages).collect()
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in out], key=key) == sorted([(i, *brute_url(u)[:3]) for i, u, _ in rows], key=key)
    assert all(r.verdict == (brute_url(rows[r.page_id][1])[3] or r.verdict) for r in out if r.page_id is not None and r.rule)
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def brute_rank(edges, seeds, rounds):
    out = collections.Counter()
    for (a, _), n in edges.items():
        out[a] += n
    rank = {h: 0.15 * w for h, w in seeds.items()}
    for _ in range(rounds):
        new = collections.Counter({h: 0.15 * w for h, w in seeds.items()})
        for (a, b), n in edges.items():
            new[b] += 0.85 * rank.get(a, 0) * n / out[a]
        rank = new
    return rank


def test_url_graph(spark):
    r = random.Random(3)
    hosts = [f"h{i}.net" for i in range(12)] + ["a.org", "b.com"]
    rows = []
    for i in range(200):
        h = r.choice(hosts)
        to = [r.choice(hosts) for _ in range(r.randrange(4))]
        path = r.choice(["/de/x", "/fr/x", "/en/x"]) if h == "b.com" else "/x"
        rows.append((i, f"http://{h}{path}", "".join(r.choice([f'<a href="https://{t}/p">', f"<A class=c HREF='//{t}/q'>", f"<a href=http://{t.upper()}/>"]) for t in to) + '<a href="/own">'))
    edges = collections.Counter()
    for _, u, html in rows:
        for t in re.findall(r"//([^/]+)/", html):
            if t.lower() != brute_url(u)[0]:
                edges[brute_url(u)[0], t.lower()] += 1
    good, bad = collections.Counter(), collections.Counter()
    for _, u, _ in rows:
        if says := brute_url(u)[3]:
            (good if says == "allow" else bad)[brute_url(u)[0]] += 1
    pages = spark.createDataFrame(rows, PAGES)
    got = {(e.src, e.dst): e.n for e in url_filter.host_edges(pages, "url", "html").collect()}
    assert got == edges
    trust, distrust = brute_rank(edges, good, 20), brute_rank({(b, a): n for (a, b), n in edges.items()}, bad, 20)
    for r_ in url_filter.filter_urls(pages).collect():
        t, d = trust.get(r_.host, 0), distrust.get(r_.host, 0)
        want = brute_url(rows[r_.page_id][1])[3] or ("block" if d > 0 and d >= 0.75 * (t + d) else "allow")
        assert r_.verdict == want or abs(d - 0.75 * (t + d)) < 1e-9


def test_trust_reaches_hosts_far_from_a_seed(spark):
    n = 60
    chain = [(i, f"http://h{i}.net/x", f'<a href="http://h{i + 1}.net/">') for i in range(n)] + [(n, f"http://h{n}.net/x", '<a href="http://b.com/de/">'), (n + 1, "http://b.com/de/x", None), (n + 2, "http://alone.net/", "")]
    out = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(chain, PAGES)).collect()}
    assert all(out[i] == "block" for i in range(n + 2)) and out[n + 2] == "allow"


def brute_mix(rows, target):
    import hashlib

    total = sum(len(words(r[1])) for r in rows)
    copies = []
    by = collections.defaultdict(list)
    for at, r in enumerate(rows):
        by[r[3]].append((hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0], len(words(r[1])), at))
    for s, docs in by.items():
        docs.sort(key=lambda d: (d[0], d[1] is None, d[1] or 0, d[2]))
        cum = 0
        for _ in range(2):
            for place, i, size, at in docs:
                cum += size
                if target[s]:
                    copies.append((cum / float(target[s]), s or "", place, i or 0, size, at))
    taken, spent = collections.Counter(), 0
    for f, _, _, _, size, at in sorted(copies):
        if spent + size > 1.5 * total:
            if size:
                break
        spent += size
        taken[at] += size
    return taken, total


@pytest.mark.parametrize("rows", [corpus(), [(i, " ".join(["w"] * (i % 17)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(500)], [(1, "a b c", "en", "x")], [(1, "", "en", "x"), (2, None, "en", None)]], ids=["corpus", "sizes", "one", "no words"])
def test_mix(spark, rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = brute_targets(sizes)
    out = mixing.mix_report(docs_of(spark, rows, extra=True)).collect()
    taken, total = brute_mix(rows, target)
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    for at, r in enumerate(rows):
        x = got[r[0]]
        assert (x.size, x.source_size) == (len(words(r[1])), sizes[r[3]])
        assert x.target == pytest.approx(float(target[r[3]])) and x.taken <= 2 * x.size
        assert x.taken == taken[at]
    assert sum(x.taken for x in out) <= 1.5 * total
    most = max(x.size for x in out)
    for s in sizes:
        mine = sum(got[r[0]].taken for r in rows if r[3] == s)
        assert abs(mine - target[s]) <= most or len(sizes) == 1


def test_mix_odd_rows(spark):
    rows = [r for r in awkward_rows()]
    out = mixing.mix_report(docs_of(spark, rows, extra=True)).collect()
    assert len(out) == len(rows) and all(r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size for r in out)
    assert mixing.mix_report(docs_of(spark, [])).count() == 0
    assert mixing.mix_documents(docs_of(spark, [])).count() == 0


def test_mix_documents(spark):
    rows = corpus(120) + [(500, "twice the same row", "en", "s1")] * 4 + [(501, None, "en", "s1")]
    docs = docs_of(spark, rows, extra=True)
    want = collections.Counter()
    for r in mixing.mix_report(docs).collect():
        want[r.doc_id] += r.taken // r.size if r.size else 1
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    got = collections.Counter(r.doc_id for r in out.collect())
    assert got == +want


def test_mix_is_native(spark):
    plan = mixing.mix_report(docs_of(spark, corpus(50)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
