import collections
import random

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from marlspike.llm import byte_bpe, mixing, similar
from tests.llm.helpers import awkward_rows, brute_components, brute_exact, brute_fingerprint, brute_near, brute_quality, brute_targets, corpus, docs_of, words
from tests.llm.test_quality_urls_mixing import brute_mix


def _write(spark, folder, rows, labels):
    docs_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = [(i, r[1], *(list(r[2:]) + ["en", "s"])[:2]) for i, r in enumerate(corpus(200) + [x for x in awkward_rows() if len(x[1] or "") < 5000])]
    _write(spark, tmp_path, rows, [(i, 1, 0) for i in range(0, 200, 3)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # too few labels for any cutoff: the base rules alone decide
    kept = [r for r in rows if not brute_quality(r[1])[5]]
    kept = [r for r, g in zip(kept, brute_exact(kept)) if r[0] == g[1]]
    alike = {r.doc_id: r.component_id for r in similar.similar_groups(docs_of(spark, kept)).collect()}
    assert any(i != c for i, c in alike.items())
    kept = [r for r, g in zip(kept, brute_near(kept)) if r[0] == g[2] and alike.get(r[0], r[0]) == r[0]]
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix_report(docs_of(spark, kept)).collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = collections.Counter()
    for r in kept:
        ids = enc.encode_ordinary(r[1])
        want[r[0], r[2], r[3], len(ids), np.array(ids, "<u4").tobytes()] += copies[r[0]]
    assert collections.Counter((r.doc_id, r.lang, r.source, r.n_tokens, bytes(r.ids)) for r in out) == +want
    assert sum(len(words(r[1])) * copies[r[0]] for r in kept) > 0


def _lowered(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_every_stage_equals_brute_force(spark, tmp_path):
    """Nothing of the code under test decides here: junk that a cutoff rejects, copies, near copies of both kinds, long texts, clashing columns."""
    r = random.Random(11)
    rows, labels, junk = [], [], set()
    for i in range(700):
        bad = r.random() < 0.1
        text = " ".join(f"w{r.randrange(400)}" + ("##|" if bad else "") for _ in range(r.randint(25, 45)))
        junk |= {i} if bad else set()
        rows.append((i, text, "en", r.choice(["hot", "hot", "s1", "s2", None])))
        labels.append((i, int(not bad), 0))
    for i in range(700, 900):  # copies, with other white space or letters, and near ones
        _, text, lang, source = rows[r.randrange(700)]
        kind, cut = r.randrange(4), text.split(" ")
        cut[r.randrange(len(cut))] = "edited"
        rows.append((i, [text.replace(" ", "\t\n", 2), text.upper(), " ".join(cut), text + " more"][kind], lang, source))
    base = " ".join(f"v{r.randrange(5000)}" for _ in range(6000))
    rows += [(900, base, "en", "s1"), (901, base + " end", "en", "s2"), (902, None, "en", "s1"), (903, "", None, None), (904, "few words", "fr", "s1")]
    docs_of(spark, rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [x for x in rows if not brute_quality(x[1])[5] and "##|" not in x[1].lower()]
    assert len(junk) > 40 and all(i in junk or not brute_quality(rows[i][1])[5] for i in range(700))
    kept = [x for x, g in zip(kept, brute_exact(kept)) if x[0] == g[1]]
    marks = [(brute_fingerprint(x[1]), _lowered(x[1])) for x in kept]
    part = brute_components(marks, lambda a, b: (a[0] ^ b[0]).bit_count() <= 3 or 10 * len(a[1] & b[1]) >= 8 * len(a[1] | b[1]))
    least = {}
    for x, p in zip(kept, part):
        least[p] = min(least.get(p, x[0]), x[0])
    before, kept = len(kept), [x for x, p in zip(kept, part) if x[0] == least[p]]
    assert before - len(kept) > 40 and 900 in {x[0] for x in kept} and 901 not in {x[0] for x in kept}
    sizes = collections.Counter()
    for x in kept:
        sizes[x[3]] += len(words(x[1]))
    taken, _ = brute_mix(kept, brute_targets(sizes))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = collections.Counter()
    for at, x in enumerate(kept):
        ids = enc.encode_ordinary(x[1])
        want[x[0], x[2], x[3], len(ids), np.array(ids, "<u4").tobytes()] += taken[at] // len(words(x[1]))
    assert collections.Counter((x.doc_id, x.lang, x.source, x.n_tokens, bytes(x.ids)) for x in out) == +want


def test_stages_return_columns_of_documents(spark, tmp_path):
    rows = corpus(60)
    _write(spark, tmp_path, rows, [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema


def test_pipeline_of_nothing(spark, tmp_path):
    _write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
