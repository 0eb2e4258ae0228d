"""Language identification by a convolutional network over bytes, in numpy.

A window of bytes is embedded, filters of several widths run over it, the largest response of each filter is kept, and a
softmax layer gives the languages. A text's windows are averaged, so long texts are predicted from all of themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

WINDOW, PAD = 256, 256
WIDTHS, FILTERS, DEPTH = (2, 3, 4), 16, 8
#: Bounds of the sample that training sees: languages (the most frequent), documents of each, characters of each document.
LANGUAGES, DOCUMENTS, CHARACTERS = 64, 600, 600


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray  # (257, DEPTH); the last row, for filling up, stays zero
    filters: np.ndarray  # (max width x DEPTH, widths x FILTERS); narrower filters are zero at their end
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def _unfold(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, max width x DEPTH) of byte windows."""
        w = max(WIDTHS)
        e = self.embedding[np.concatenate([x, np.full((len(x), w - 1), PAD, x.dtype)], axis=1)]
        n, length, d = e.shape
        view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)  # (n, positions, d, w)
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(n, length - w + 1, w * d)

    def forward(self, x: np.ndarray):
        u = self._unfold(x)
        r = (u.reshape(-1, u.shape[2]) @ self.filters).reshape(len(x), u.shape[1], -1)
        at = None
        top = r.max(1) + self.bias
        f = np.maximum(top, 0)
        z = f @ self.dense + self.offset
        z = z - z.max(1, keepdims=True)
        p = np.exp(z)
        return u, r, at, top, f, p / p.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]


def windows_of(data: bytes) -> np.ndarray:
    """Consecutive windows of all the bytes; the last one is filled up."""
    n = -(-len(data) // WINDOW)
    out = np.full(n * WINDOW, PAD, np.int16)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def train(texts: list[str], labels: list[str], epochs: int = 6, seed: int = 7) -> Model:
    """A model of the labels' languages, by Adam on windows and on short crops of them."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    xs, ys = [], []
    for text, label in zip(texts, labels):
        data = text.encode()
        for w in windows_of(data)[:2]:
            xs.append(w)
            ys.append(names.index(label))
        n = int(rng.integers(12, 90))
        a = int(rng.integers(0, max(1, len(data) - n)))
        short = np.full(WINDOW, PAD, np.int16)
        crop = np.frombuffer(data[a:a + n], np.uint8)
        short[:len(crop)] = crop
        xs.append(short)
        ys.append(names.index(label))
    x, y = np.array(xs), np.array(ys)
    w, k = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat(np.arange(w)[:, None] < width, DEPTH, axis=0).repeat(FILTERS, axis=1) for width in WIDTHS], axis=1)
    real = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    m = Model(names, real(PAD + 1, DEPTH), real(w * DEPTH, k) / np.float32(5) * mask, np.zeros(k, np.float32), real(k, len(names)) / np.float32(7), np.zeros(len(names), np.float32))
    m.embedding[PAD] = 0
    parts = ("embedding", "filters", "bias", "dense", "offset")
    first = {p: np.zeros_like(getattr(m, p)) for p in parts}
    second = {p: np.zeros_like(getattr(m, p)) for p in parts}
    step, column = 0, np.arange(k)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 64):
            sel = order[a:a + 64]
            u, r, _, top, f, p = m.forward(x[sel])
            dz = p
            dz[np.arange(len(sel)), y[sel]] -= 1
            dz /= len(sel)
            df = (dz @ m.dense.T) * (top > 0)
            at = r.argmax(1)  # (batch, filters)
            best = u[np.arange(len(sel))[:, None], at]  # (batch, filters, w x DEPTH)
            grads = {"dense": f.T @ dz, "offset": dz.sum(0), "bias": df.sum(0), "filters": np.einsum("bf,bfu->uf", df, best) * mask}
            back = (df[:, :, None] * m.filters[:, column].T[None]).reshape(len(sel), k, w, DEPTH)
            place = at[:, :, None] + np.arange(w)
            filled = np.concatenate([x[sel], np.full((len(sel), w - 1), PAD, np.int16)], axis=1)
            grads["embedding"] = np.zeros_like(m.embedding)
            np.add.at(grads["embedding"], filled[np.arange(len(sel))[:, None, None], place], back)
            grads["embedding"][PAD] = 0
            step += 1
            for q in parts:
                first[q] = 0.9 * first[q] + 0.1 * grads[q]
                second[q] = 0.999 * second[q] + 0.001 * grads[q] ** 2
                move = 0.004 * (first[q] / (1 - 0.9**step)) / (np.sqrt(second[q] / (1 - 0.999**step)) + 1e-8)
                setattr(m, q, (getattr(m, q) - move).astype(np.float32))
    return m


def held_out() -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text, modulo 5, is 0. A null doc_id is kept from it too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame) -> Model | None:
    """A model from labelled rows that are not held out; None if there are none.

    The sample is bounded: see LANGUAGES, DOCUMENTS, CHARACTERS. Documents are picked, and the place in
    a long one, by a hash.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    top = [r["lang"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    if not top:
        return None
    first = F.pmod("h", F.greatest(F.length("text") - CHARACTERS, F.lit(1))).cast("int") + 1
    cut = known.where(F.col("lang").isin(top)).select("lang", "h", F.substring("text", first, F.lit(CHARACTERS)).alias("text"))
    picked = cut.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= DOCUMENTS)
    rows = sorted((r["lang"], r["h"], r["text"]) for r in picked.collect())
    return train([r[2] for r in rows], [r[0] for r in rows])


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``lang_pred, score`` beside the columns ``keep``; only the text decides.

    ``und`` with score 0 for a null text or one without a letter, and for all if there is no model. The score is the mean
    probability of the language over all windows of the whole text, weighted by their bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = len(texts)
            lang, score = ["und"] * n, np.zeros(n)
            held, weight, owner, size = [], [], [], 0
            sums = np.zeros((n, len(m.languages) if m else 1))

            def flush():
                x = np.concatenate(held)
                p = np.concatenate([m.probabilities(x[a:a + 256]) for a in range(0, len(x), 256)])
                np.add.at(sums, np.concatenate(owner), p * np.concatenate(weight)[:, None])
                held.clear(), weight.clear(), owner.clear()

            real = []
            for i, t in enumerate(texts):
                if m is None or not t or not any(map(str.isalpha, t)):
                    continue
                real.append(i)
                data = t.encode()
                for a in range(0, len(data), WINDOW << 12):
                    part = windows_of(data[a:a + (WINDOW << 12)])
                    held.append(part)
                    weight.append((part != PAD).sum(1))
                    owner.append(np.full(len(part), i))
                    size += len(part)
                    if size >= 2048:
                        flush()
                        size = 0
            if held:
                flush()
            for i in real:
                p = sums[i] / sums[i].sum()
                best = int(p.argmax())
                lang[i], score[i] = m.languages[best], min(1.0, float(p[best]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(lang), pa.array(score)], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    return source.mapInArrow(run, f"{kinds}, lang_pred string, score double")
