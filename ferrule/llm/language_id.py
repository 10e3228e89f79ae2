"""Language identification with a small byte convolutional network.

Bytes are embedded, filters of several widths slide over windows of fixed
length, the largest response of each filter is kept and a softmax layer decides.
The network is trained here, in numpy, on a bounded sample of labelled rows; at
prediction every window of the whole text counts, and a text's answer is the
average over its windows.

Results in odd cases: a null text or one without any letter is ``und`` with
score 0; so is everything where no labelled row could be learned from; a null id
counts as held out; short texts are padded; repeated rows are judged each; an
empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, doc_crc, documents, thinned

#: Rows learned from at most, windows of each, and bytes of a window.
SAMPLE_ROWS, SAMPLE_WINDOWS, WINDOW = 4000, 3, 256
EMBEDDING, WIDTHS, FILTERS = 8, (2, 3, 4), (10, 11, 11)
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.004, 7
UNKNOWN = "und"


def windows_of(data: bytes) -> np.ndarray:
    """The text's windows, the last one overlapping the one before; short texts are padded."""
    n = len(data)
    if n <= WINDOW:
        return np.frombuffer(data.ljust(WINDOW, b"\0"), np.uint8)[None]
    raw = np.frombuffer(data, np.uint8)
    whole = raw[: n - n % WINDOW].reshape(-1, WINDOW)
    return whole if n % WINDOW == 0 else np.concatenate([whole, raw[None, n - WINDOW :]])


class Network:
    """Embedding, filters of several widths, maximum over the window, softmax."""

    def __init__(self, labels: list[str]):
        rng = np.random.default_rng(SEED)
        wide, n = max(WIDTHS), sum(FILTERS)
        self.labels = labels
        self.table = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.mask = np.zeros((wide * EMBEDDING, n), np.float32)
        at = 0
        for width, count in zip(WIDTHS, FILTERS, strict=True):
            self.mask[: width * EMBEDDING, at : at + count] = 1
            at += count
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.3, (n, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        x = self.table[windows]
        return np.concatenate([x[:, i : WINDOW - wide + 1 + i] for i in range(wide)], axis=2)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), 64):
            pooled = (self._columns(windows[at : at + 64]) @ self.filters).max(axis=1)
            scores = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
            e = np.exp(scores - scores.max(axis=1, keepdims=True))
            parts.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(parts)

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        names = ("table", "filters", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step, wide = 0, max(WIDTHS)
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                own = windows[pick]
                columns = self._columns(own)
                response = columns @ self.filters
                where = response.argmax(axis=1)
                pooled = np.take_along_axis(response, where[:, None], 1)[:, 0] + self.bias
                active = np.maximum(pooled, 0)
                scores = active @ self.out + self.out_bias
                e = np.exp(scores - scores.max(axis=1, keepdims=True))
                slope = e / e.sum(axis=1, keepdims=True)
                slope[np.arange(len(pick)), labels[pick]] -= 1
                slope /= len(pick)
                back = (slope @ self.out.T) * (pooled > 0)
                # only the strongest place of each filter passes anything back
                seen = np.take_along_axis(columns, where[:, :, None], 1)
                grads = {"out": active.T @ slope, "out_bias": slope.sum(0), "bias": back.sum(0)}
                grads["filters"] = np.einsum("bf,bfk->kf", back, seen) * self.mask
                into = (back[:, :, None] * self.filters.T[None]).reshape(len(pick), -1, wide, EMBEDDING)
                places = where[:, :, None] + np.arange(wide)
                grads["table"] = np.zeros_like(self.table)
                np.add.at(grads["table"], own[np.arange(len(pick))[:, None, None], places], into)
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.labels and t and any(map(str.isalpha, t))]
        # texts are taken together until some megabytes of windows have come together
        group: list[tuple[int, np.ndarray]] = []
        held = 0
        for n, i in enumerate(known):
            group.append((i, windows_of(texts[i].encode())))
            held += len(group[-1][1])
            if held >= 8192 or n + 1 == len(known):
                p = self.probabilities(np.concatenate([w for _, w in group]))
                at = 0
                for j, w in group:
                    mean = p[at : at + len(w)].mean(axis=0)
                    at += len(w)
                    best = int(mean.argmax())
                    found[j], scores[j] = self.labels[best], min(1.0, float(mean[best]))
                group, held = [], 0
        return found, scores


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(doc_crc(column), F.lit(4)) == 2, F.lit(True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network:
    """Train on at most SAMPLE_ROWS labelled rows that are not held out, chosen by a hash of the id."""
    size = F.greatest(F.char_length("t") - WINDOW, F.lit(1))
    parts = F.array(*[F.substring(F.col("t"), (F.pmod(F.xxhash64(F.col("i"), F.lit(k)), size) + 1).cast("int"), WINDOW) for k in range(SAMPLE_WINDOWS)])
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("label"))
    rows = rows.where("t is not null and label is not null and label <> 'und'").select("label", parts.alias("parts"), F.xxhash64("i").alias("o"), "i")
    sample = thinned(rows, "o", SAMPLE_ROWS).orderBy("o", "i").limit(SAMPLE_ROWS).collect()
    pairs = [(r["label"], p) for r in sample for p in dict.fromkeys(r["parts"]) if any(map(str.isalpha, p))]
    network = Network(sorted({label for label, _ in pairs}))
    if pairs:
        windows = np.concatenate([windows_of(p.encode())[:1] for _, p in pairs])
        network.train(windows, np.array([network.labels.index(label) for label, _ in pairs]))
    return network


def language_id(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, scores = network.judge(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

        return step

    judged = arrow_map(docs.select(id_col, text_col), f"`{id_col}` {kind}, lang_pred string, score double", make)
    return judged.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """The documents in some learned language, with all columns."""
    at = docs.columns.index(text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([x != UNKNOWN for x in network.judge(batch.column(at).to_pylist())[0]], pa.bool_()))

        return step

    return arrow_map(docs, docs.schema, make)


def op2_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language_id(docs, learn(docs))
