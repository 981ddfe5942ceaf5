"""Language identification by a byte convolutional network, trained here with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.worker import bound_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 8
PAD = 256
#: Windows that pass through the network at once.
BATCH = 256
UNKNOWN = "und"


@dataclass
class ByteCNN:
    """Weights: an embedding of the bytes, filters of several widths, a softmax over languages."""

    langs: list[str]
    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> ByteCNN:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        table = rng.standard_normal((PAD + 1, DEPTH)).astype(np.float32) * 0.5
        table[PAD] = 0
        return cls(
            langs, table, [draw(w * DEPTH, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            draw(len(WIDTHS) * FILTERS, len(langs)), np.zeros(len(langs), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.biases, self.out, self.out_bias]

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rectified maxima of every filter over a (n, WINDOW) byte array, and where they are."""
        embedded = self.table[windows]
        maxima, places = [], []
        for w, kernel, bias in zip(WIDTHS, self.filters, self.biases):
            spans = WINDOW - w + 1
            z = embedded[:, :spans] @ kernel[:DEPTH]
            for j in range(1, w):
                z += embedded[:, j:j + spans] @ kernel[j * DEPTH:(j + 1) * DEPTH]
            at = z.argmax(axis=1)
            places.append(at)
            maxima.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + bias)
        return np.maximum(np.concatenate(maxima, 1), 0), places

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), BATCH):
            z = self.features(windows[i:i + BATCH])[0] @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 1000, rate: float = 0.003, seed: int = 7) -> ByteCNN:
        """Cross entropy by Adam, in passes over the sample until ``steps`` batches have taught; only the
        maxima's own bytes get a gradient."""
        rng = np.random.default_rng(seed)
        params = self.weights()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        while step < steps:
            order = rng.permutation(len(windows))
            for i in range(0, len(order), 64):
                x, y = windows[order[i:i + 64]], labels[order[i:i + 64]]
                hidden, places = self.features(x)
                z = hidden @ self.out + self.out_bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                error = z / z.sum(axis=1, keepdims=True)
                error[np.arange(len(y)), y] -= 1
                error /= len(y)
                back = (error @ self.out.T) * (hidden > 0)
                table = np.zeros_like(self.table)
                filters, biases = [], []
                for k, (w, kernel, at) in enumerate(zip(WIDTHS, self.filters, places)):
                    g = back[:, k * FILTERS:(k + 1) * FILTERS]
                    cols = at[:, :, None] + np.arange(w)
                    seen = x[np.arange(len(x))[:, None, None], cols]
                    patches = self.table[seen].reshape(len(x), FILTERS, w * DEPTH)
                    filters.append(np.einsum("nf,nfd->df", g, patches))
                    biases.append(g.sum(0))
                    spread = (g[:, :, None] * kernel.T[None]).reshape(-1, DEPTH)
                    np.add.at(table, seen.reshape(-1), spread)
                table[PAD] = 0
                step += 1
                grads = [table, *filters, *biases, hidden.T @ error, error.sum(0)]
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def windows_of(data: bytes) -> np.ndarray:
    """All fixed-length windows of a text's bytes, the last one padded."""
    n = -(-len(data) // WINDOW)
    out = np.full(n * WINDOW, PAD, np.int16)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1500,
) -> ByteCNN | None:
    """Fit on about ``per_language`` documents of each language, two windows of each.

    The sample is bounded by that parameter whatever the table's size, chosen by a hash of ``key``,
    and only its windows come to the driver. Rows without language, or without a letter in a window,
    teach nothing. None if nothing can be learned.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(key).cast("string")).alias("h")).where(
        "t IS NOT NULL AND l IS NOT NULL"
    )
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*[
        F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, per_language / n))
    ]), F.col("l"))
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    at = lambda salt: 1 + F.pmod(F.xxhash64("h", F.lit(salt)), F.greatest(F.char_length("t") - WINDOW, F.lit(1)))
    taken = drawn.select("l", "h", *[
        F.encode(F.substring("t", at(k).cast("int"), F.lit(WINDOW)), "UTF-8").alias(f"w{k}") for k in range(2)
    ]).orderBy("h", "w0", "w1").toPandas()
    langs = sorted(sizes)
    samples = [
        (windows_of(bytes(w)[:WINDOW])[0], langs.index(l))
        for _, l, *both in taken[["h", "l", "w0", "w1"]].itertuples(index=False)
        for w in both if any(map(str.isalpha, bytes(w).decode("utf-8", "ignore")))
    ]
    if not samples:
        return None
    x, y = np.stack([s[0] for s in samples]), np.array([s[1] for s in samples])
    return ByteCNN.fresh(langs).fit(x, y)


def language(text: Column, model: ByteCNN | None) -> Column:
    """Struct (lang_pred, score) of a text column, from every window of the whole text.

    Windows vote with their probabilities, weighted by their bytes; the score is the winner's mean
    probability. NULL or a text without a letter, or no model, is ``und`` with score 0; ties go to
    the first language in order.
    """

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            held, owners, size = [], [], 0

            def flush() -> None:
                nonlocal held, owners, size
                if not held:
                    return
                windows = np.concatenate(held)
                p = model.probabilities(windows)
                weight = (windows != PAD).sum(axis=1)
                starts = np.cumsum([0, *[len(h) for h in held[:-1]]])
                votes = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                for k, v in zip(owners, votes):
                    names[k], scores[k] = model.langs[int(v.argmax())], min(1.0, float(v.max()))
                held, owners, size = [], [], 0

            for k, t in enumerate(texts):
                names.append(UNKNOWN)
                scores.append(0.0)
                t = t.as_py()
                if model is None or t is None or not any(map(str.isalpha, t)):
                    continue
                held.append(windows_of(t.encode("utf-8", "surrogatepass")))
                owners.append(k)
                size += len(held[-1])
                if size >= BATCH * 16:
                    flush()
            flush()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, model: ByteCNN | None, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with the struct column ``into``; every row and all other columns stay as they are."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(into, language(F.col(text).cast("string"), model))


def held_out(key: Column) -> Column:
    """The fold that never teaches: crc32 of the id's text is 2 modulo 4. A NULL id is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(True))
