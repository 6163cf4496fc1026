import random

import pytest

from marlspike.llm import exact_dedup, heavy, simhash
from marlspike.llm.components import components
from tests.llm.helpers import awkward_rows, brute_components, brute_exact, brute_near, corpus, docs_of, normal

key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("rows", [corpus(), awkward_rows()], ids=["corpus", "awkward"])
@pytest.mark.parametrize("counters", [4, 2048])
def test_exact_groups(spark, rows, counters):
    out = exact_dedup.duplicate_groups(docs_of(spark, rows, extra=True), counters=counters).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=key) == sorted(brute_exact(rows), key=key)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({normal(r[1]) for r in rows})  # one of each, repeated rows too
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("counters", [4, 2048])
def test_exact_rows_that_stay(spark, counters):
    rows = corpus() + awkward_rows()
    rows = [(i if r[0] is not None else None, *r[1:]) for i, r in enumerate(rows)]
    docs = docs_of(spark, rows, extra=True)
    out = exact_dedup.deduplicate(docs, counters=counters)
    assert out.columns == docs.columns
    first = {}
    for r in rows:
        k = normal(r[1])
        if k not in first or (r[0] is not None and (first[k] is None or r[0] < first[k])):
            first[k] = r[0]
    got = out.collect()
    assert {normal(r.text): r.doc_id for r in got} == first and len(got) == len(first)


def test_exact_one_hot_key(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(600)]
    out = exact_dedup.duplicate_groups(docs_of(spark, rows), counters=8).where("group_size > 1").collect()
    assert len(out) == 200 and {r.keep_id for r in out} == {0} and sum(r.kept for r in out) == 1


def test_empty(spark):
    none = docs_of(spark, [])
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.deduplicate(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_misra_gries_finds_all_heavy(spark):
    r = random.Random(1)
    values = [r.choice("abc") if r.random() < 0.5 else f"v{r.randrange(4000)}" for _ in range(6000)]
    df = spark.createDataFrame([(v,) for v in values], "digest string").repartition(7)
    found, least = heavy.heavy_items(df, "digest", len(values), k=20)
    got = {x.item for x in found.collect()}
    assert {v for v in set(values) if values.count(v) >= least} <= got and len(got) <= 21


@pytest.mark.parametrize("rows", [corpus(), awkward_rows()], ids=["corpus", "awkward"])
def test_near_components(spark, rows):
    out = simhash.near_duplicates(docs_of(spark, rows, extra=True)).collect()
    assert sorted([tuple(r) for r in out], key=key) == sorted(brute_near(rows), key=key)


def _crowd(n, seed=5):
    """Fingerprints crowded around a few centres, and others."""
    r = random.Random(seed)
    out = set()
    for _ in range(3):
        c = r.getrandbits(64)
        for _ in range(n):
            x = c
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    out |= {r.getrandbits(64) for _ in range(n)}
    return [x - (1 << 64) if x >> 63 else x for x in out]


@pytest.mark.parametrize("wide", [3, 16, 10_000])
def test_links_of_crowded_fingerprints(spark, monkeypatch, wide):
    monkeypatch.setattr(simhash, "WIDE", wide)
    fps = _crowd(70)
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    m = (1 << 64) - 1
    assert all(((r.a ^ r.b) & m).bit_count() <= 3 for r in got)
    want = brute_components(fps, lambda a, b: ((a ^ b) & m).bit_count() <= 3)
    pairs = {(r.a, r.b) for r in got}
    mine = brute_components(fps, lambda a, b: (min(a, b), max(a, b)) in pairs)
    groups = lambda part: {frozenset(f for f, p in zip(fps, part) if p == q) for q in set(part)}
    assert groups(mine) == groups(want)


def test_keep_one(spark):
    rows = corpus()
    docs = docs_of(spark, rows, extra=True)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in brute_near(rows)})
    twice = docs_of(spark, [(1, "some words to keep here"), (1, "some words to keep here"), (2, "other things that are not alike at all")])
    assert sorted(r.doc_id for r in simhash.keep_one(twice).collect()) == [1, 2]
    no_id = docs_of(spark, [(None, "some words to keep here"), (None, "some words to keep here"), (4, "other things that are not alike"), (None, "other things that are not alike")])
    assert sorted([r.doc_id for r in simhash.keep_one(no_id).collect()], key=str) == [4, None]


def test_components_of_chains(spark):
    r = random.Random(2)
    nodes = list(range(300))
    r.shuffle(nodes)
    pairs = [(min(a, b), max(a, b)) for a, b in zip(nodes[:200], nodes[1:200])] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[n] == min(nodes[:200]) for n in nodes[:200]) and all(got[1000 + i] == 1000 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_python_in_shuffled_part(spark):
    plan = exact_dedup.duplicate_groups(docs_of(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BatchEvalPython" not in plan


def test_components_of_both_kinds_are_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = docs_of(spark, [(1, text), (3, "another text of its own"), (5, text), (7, "one more of its own kind")])
    groups = spark.createDataFrame([(1, 1), (3, 3), (5, 3), (7, 7)], "doc_id long, component_id long")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, groups=groups).collect()) == [1, 7]
