"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of bytes. A network of gated recurrent units reads each window from
either end, so that every position has a state from both sides and gets a probability for each
language; a document's probabilities are the means over all of its positions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlspike.llm.common import checkpoint, col, map_text

#: Units of each direction, bytes of a window, windows computed at once.
HIDDEN, WINDOW, BATCH = 12, 128, 2048
#: Training: documents of each language, and of all together, at most (but one of each language at least): the bounds of the
#: sample. Windows of each document, from places all over it, and bytes of those.
DOCS_PER_LANG, DOCS, WINDOWS_PER_DOC, TRAIN_WINDOW = 300, 60_000, 6, 64
#: Up to so many languages, their sizes go to every task.
BROADCAST_LANGS = 100_000
STEPS, TRAIN_BATCH, RATE, SEED = 350, 256, 0.02, 7
#: Share of documents that are held out, by crc32 of the id: remainder HELD_OUT of FOLDS.
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: The byte after the end of a window: it leaves the state as it is.
PAD = 256
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """langs, and for each direction: table (3H x 257, what each byte adds to the gates), u (3H x H), c (H), w (C x H); b (C)."""

    langs: list[str]
    table: list[np.ndarray]
    u: list[np.ndarray]
    c: list[np.ndarray]
    w: list[np.ndarray]
    b: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.table, *self.u, *self.c, *self.w, self.b]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Model:
    r = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (r.standard_normal(shape) * scale).astype(np.float32)

    h, c = hidden, len(langs)
    table = [normal(3 * h, PAD + 1, scale=0.3) for _ in range(2)]
    return Model(langs, table, [normal(3 * h, h, scale=0.5 / h**0.5) for _ in range(2)], [np.zeros(h, np.float32) for _ in range(2)], [normal(c, h, scale=0.3) for _ in range(2)], np.zeros(c, np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-2, keepdims=True))
    return e / e.sum(axis=-2, keepdims=True)


def _states(m: Model, d: int, x: np.ndarray) -> list[tuple]:
    """Forward steps of direction d over x (time x batch), in its order: (h before, reset, update, candidate, inner, h after)."""
    h_n = m.c[d].shape[0]
    h = np.zeros((h_n, x.shape[1]), np.float32)
    steps = []
    for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
        a = m.table[d][:, x[t]]
        g = m.u[d] @ h
        rz = _sigmoid(a[: 2 * h_n] + g[: 2 * h_n])
        r, z = rz[:h_n], rz[h_n:]
        inner = g[2 * h_n :] + m.c[d][:, None]
        n = np.tanh(a[2 * h_n :] + r * inner)
        after = n + z * (h - n)
        steps.append((h, r, z, n, inner, after))
        h = after
    return steps


def gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions of x (time x batch) for labels y, and its gradients, by backpropagation through time."""
    steps = [_states(m, 0, x), _states(m, 1, x)]
    length, batch = x.shape
    hf = np.stack([s[5] for s in steps[0]])
    hb = np.stack([s[5] for s in steps[1]][::-1])
    p = _softmax(m.w[0] @ hf + m.w[1] @ hb + m.b[:, None])
    picked = p[:, y, np.arange(batch)]
    loss = float(-np.log(picked + 1e-9).mean())
    p[:, y, np.arange(batch)] -= 1
    p /= length * batch
    d_b = p.sum(axis=(0, 2))
    d_w = [np.einsum("tcb,thb->ch", p, h) for h in (hf, hb)]
    d_table, d_u, d_c = [], [], []
    for d in range(2):
        h_n = m.c[d].shape[0]
        times = range(length) if d == 0 else range(length - 1, -1, -1)
        order = list(zip(times, steps[d], strict=True))[::-1]
        out = m.w[d].T @ p
        du, dc, dh = np.zeros_like(m.u[d]), np.zeros_like(m.c[d]), np.zeros((h_n, batch), np.float32)
        da_all = np.empty((3 * h_n, length, batch), np.float32)
        for t, (before, r, z, n, inner, _) in order:
            dh = dh + out[t]
            dn = dh * (1 - z) * (1 - n * n)
            dr = dn * inner * r * (1 - r)
            dz = dh * (before - n) * z * (1 - z)
            da_all[:, t] = np.concatenate([dr, dz, dn])
            dg = np.concatenate([dr, dz, dn * r])
            du += dg @ before.T
            dc += dg[2 * h_n :].sum(1)
            dh = dh * z + m.u[d].T @ dg
        flat, bytes_ = da_all.reshape(3 * h_n, -1), x.ravel()
        d_table.append(np.stack([np.bincount(bytes_, row, PAD + 1) for row in flat]).astype(np.float32))
        d_u.append(du)
        d_c.append(dc)
    return loss, [*d_table, *d_u, *d_c, *d_w, d_b]


def train(windows: np.ndarray, y: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = SEED) -> Model:
    """Adam over batches of windows (rows of bytes) with labels y; the same input gives the same model."""
    m, r = new_model(langs, seed=seed), np.random.default_rng(seed)
    state = [(np.zeros_like(a), np.zeros_like(a)) for a in m.arrays()]
    for step in range(1, steps + 1):
        chosen = r.integers(0, len(windows), TRAIN_BATCH)
        _, grads = gradients(m, np.ascontiguousarray(windows[chosen].T), y[chosen])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for a, g, (u, v) in zip(m.arrays(), grads, state, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            a -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return m


def windows_of(raw: bytes, length: int) -> np.ndarray:
    """The whole of raw in rows of `length` bytes; the last is filled up with PAD."""
    n = -(-len(raw) // length)
    out = np.full(n * length, PAD, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, length)


class Predictor:
    def __init__(self, m: Model):
        self.m = m
        self.h = m.c[0].shape[0]
        h = self.h
        self.tables, self.us = [], []
        for d in range(2):
            table, u = m.table[d].copy(), m.u[d].copy()
            table[:, PAD] = 0
            table[h : 2 * h, PAD] = 60  # the update gate is 1: the state stays
            # tanh(x / 2) gives both gates; the halves are put into the weights
            table[: 2 * h] *= 0.5
            u[: 2 * h] *= 0.5
            self.tables.append(np.ascontiguousarray(table))
            self.us.append(u)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """For each window (columns of x, time x batch), its positions' probabilities summed: C x batch."""
        m, h_n = self.m, self.h
        length, batch = x.shape
        scores = np.empty((length, len(m.langs), batch), np.float32)
        g, a = np.empty((3 * h_n, batch), np.float32), np.empty((3 * h_n, batch), np.float32)
        for d in range(2):
            h = np.zeros((h_n, batch), np.float32)
            table, u, c, w = self.tables[d], self.us[d], m.c[d][:, None], m.w[d]
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                np.take(table, x[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=g)
                rz = a[: 2 * h_n]
                rz += g[: 2 * h_n]
                np.tanh(rz, out=rz)
                rz += 1
                rz *= 0.5
                n = g[2 * h_n :]
                n += c
                n *= rz[:h_n]
                n += a[2 * h_n :]
                np.tanh(n, out=n)
                h -= n
                h *= rz[h_n:]
                h += n
                if d == 0:
                    np.matmul(w, h, out=scores[t])
                else:
                    scores[t] += w @ h
        scores += m.b[:, None]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores *= ((x != PAD) / scores.sum(axis=1))[:, None, :]
        return scores.sum(axis=0)

    def __call__(self, texts: list[str | None]) -> list:
        """lang_pred and score of whole texts."""
        raw = [t.encode("utf-8", "surrogatepass") if t and _LETTER.search(t) else b"" for t in texts]
        cut = [windows_of(r, WINDOW) for r in raw]
        owner = np.repeat(np.arange(len(raw)), [len(c) for c in cut])
        total = np.zeros((len(raw), len(self.m.langs)))
        if len(owner):
            rows = np.concatenate(cut)
            for at in range(0, len(rows), BATCH):
                x = np.ascontiguousarray(rows[at : at + BATCH].T).astype(np.intp)
                np.add.at(total, owner[at : at + BATCH], self.sums(x).T)
        best = total.argmax(axis=1)
        langs, scores = [], []
        for i, r in enumerate(raw):
            langs.append(self.m.langs[best[i]] if r else UNKNOWN)
            scores.append(min(1.0, float(total[i, best[i]] / len(r))) if r else 0.0)
        return [langs, scores]


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def fit(
    docs: DataFrame, per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = DOCS, windows_per_doc: int = WINDOWS_PER_DOC, window: int = TRAIN_WINDOW
) -> Model:
    """Train on documents outside the held-out fold that have a language and a text.

    Every language is learned. Of each at most per_lang documents, and at most most_docs of all, give
    up to windows_per_doc windows: those with the smallest hashes of their ids, one of each language
    at least. The windows of a document begin at a place of its hash in each of as many equal parts,
    so any part of any document may be drawn. That is a bounded sample, whatever the size of docs.
    Rows that repeat an id count once."""
    known = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang")).where((fold_of(F.col("id")) != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") > 0))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    counts = checkpoint(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")))
    langs = sorted(r["lang"] for r in counts.select("lang").collect())
    if not langs:
        return new_model([])
    per_lang = max(1, min(per_lang, most_docs // len(langs)))
    # about per_lang of each language by the hash alone, the first in any case, then no more than that in each
    share = counts.select("lang", F.greatest("least", F.lit(1.3 * per_lang) / F.col("n")).alias("share"))
    n, seed = F.length("text"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
    spread = F.transform(F.sequence(F.lit(0), F.lit(windows_per_doc - 1)), lambda i: F.substring("text", (n * (i + seed) / windows_per_doc).cast("int") + 1, F.lit(window)))
    near = known.join(F.broadcast(share) if len(langs) <= BROADCAST_LANGS else share, "lang").where(place <= F.col("share"))
    once = near.select("lang", "id", place.alias("place"), spread.alias("parts")).groupBy("lang", "id").agg(F.min("place").alias("place"), F.min("parts").alias("parts"))
    order = Window.partitionBy("lang").orderBy("place", F.col("id").cast("string"))
    rows = once.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= per_lang).collect()
    rows.sort(key=lambda r: (r["lang"], r["turn"]))
    number = {lang: i for i, lang in enumerate(langs)}
    cut, y = [], []
    for r in rows:
        for part in dict.fromkeys(r["parts"]):
            raw = part.encode("utf-8", "surrogatepass")[:window]
            if raw:
                cut.append(windows_of(raw, window))
                y.append(number[r["lang"]])
    labels = np.array(y)
    # as many windows of each language
    each = [np.flatnonzero(labels == i) for i in range(len(langs))]
    most = max(map(len, each))
    chosen = np.concatenate([np.resize(e, most) for e in each if len(e)])
    return train(np.concatenate(cut)[chosen], labels[chosen], langs)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs, from whole texts alone.

    lang_pred is 'und' with score 0 for a null text, one without a letter, or a model without
    languages; of equal probabilities the first language wins. A null id is not held out; repeated
    rows come out as often; texts are read whole, however long; no rows give no rows; other columns,
    whatever their names, are ignored."""
    parts = (model.langs, model.table, model.u, model.c, model.w, model.b)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def make():
        if not shared.value[0]:
            return lambda texts: [[UNKNOWN] * len(texts), [0.0] * len(texts)]
        return Predictor(Model(*shared.value))

    rows = docs.select(col(id_col).alias("doc_id"), (fold_of(col(id_col)) == HELD_OUT).alias("held_out"), col(text_col).alias("text"))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(rows, "text", fields, make, ["doc_id", "held_out"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return predict(docs, fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col)
