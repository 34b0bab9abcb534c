"""Quality scores by support vectors over n-gram indicators scaled by naive Bayes ratios."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.tables import map_texts, quoted, sample_rows
from tracegraph.llm.words import chained, mix, piece_hashes, spans

# Size of the hashed indicator space, as a power of two.
BITS = 16
# Labelled rows the classifier is fitted on, half of each class where there are enough.
SAMPLE_ROWS = 8192
SMOOTHING = 1.0
PENALTY = 1.0
PASSES = 20
# Share of the fitted weight against its mean size, which keeps close to naive Bayes.
BLEND = 0.5
# Shares (as negative powers of two) from which on an n-gram of word shapes counts.
LEVELS = (1, 3, 5)
CHUNK = 1 << 20


def word_shapes(data: np.ndarray) -> np.ndarray:
    """A small number per word: first and last character's kind, capitals, length, and whether it repeats the word before."""
    starts, ends = spans(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    kind = np.zeros(256, dtype=np.uint64)
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 1, 2, 3, 4
    plain = kind == 0
    kind[plain] = np.arange(int(plain.sum()), dtype=np.uint64) + np.uint64(5)
    capitals = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    length = ends - starts
    loud = (capitals[ends] - capitals[starts]) * 2 > length
    hashes = piece_hashes(data, starts, ends)
    same = np.concatenate(([False], hashes[1:] == hashes[:-1])).astype(np.uint64)
    size = np.minimum(length, 15).astype(np.uint64) // np.uint64(4)
    return ((kind[data[starts]] * np.uint64(64) + kind[data[ends - 1]]) * np.uint64(4) + size) * np.uint64(4) + loud.astype(np.uint64) * np.uint64(2) + same


def indicators(text: str | None, bits: int = BITS) -> np.ndarray:
    """Which n-grams the whole text has: three and four bytes, and one to three word shapes.

    For shapes the indicator also says how common the n-gram is in the text, in powers of
    two of its share, so a short odd passage differs from an odd text.
    """
    data = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
    seen = np.zeros(1 << bits, dtype=bool)
    shift = np.uint32(32 - bits)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + 3].astype(np.uint32)
        grams = part[:-2] * np.uint32(1 << 16) + part[1:-1] * np.uint32(1 << 8) + part[2:]
        seen[(grams * np.uint32(2654435761)) >> shift] = True
        if len(part) > 3:
            seen[(((grams[:-1] * np.uint32(0x85EBCA6B)) ^ part[3:]) * np.uint32(2246822519)) >> shift] = True
    shapes = word_shapes(data)
    # The whole shape, and only whether the word is loud or a repeat.
    for tag, tokens in ((1, shapes), (2, shapes & np.uint64(3))):
        hashes = mix(tokens + np.uint64(tag << 20))
        for width in (1, 2, 3):
            if len(tokens) >= width:
                kinds, counts = np.unique(chained(hashes, width), return_counts=True)
                level = np.log2(counts / (len(tokens) - width + 1))
                for deep in LEVELS:
                    seen[mix(kinds[level >= -deep] + np.uint64(deep * 4 + width)) >> np.uint64(64 - bits)] = True
    return np.flatnonzero(seen)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss fit: one dual variable at a time, in seeded random order."""
    values = [scale[r] for r in rows]
    norms = np.array([max(1e-12, float(np.sqrt(v @ v + 1))) for v in values])
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(PASSES):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x = values[i] / norms[i]
            slope = y[i] * (float(w[rows[i]] @ x) + bias / norms[i]) - 1
            new = min(max(alpha[i] - slope, 0.0), penalty[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                most, alpha[i] = max(most, abs(step)), new
                w[rows[i]] += step * x
                bias += step / norms[i]
        if most < 1e-3:
            break
    return w, bias


def margins(rows: list[np.ndarray], weight: np.ndarray, scale: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(rows))
    for i, r in enumerate(rows):
        v = scale[r]
        out[i] = (float(weight[r] @ v) + bias) / np.sqrt(v @ v + 1)
    return out


def fit_quality(texts: list[str | None], labels: list[int], prior: float, bits: int = BITS) -> dict:
    """The scaled weights, and a logistic curve from margins to probabilities under ``prior``, the share of label 1."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i] or "", labels[i]))
    y = np.array([1.0 if labels[i] else -1.0 for i in order])
    if len(set(y)) < 2:
        return {"constant": float(len(y) == 0 or y[0] > 0)}
    rows = [indicators(texts[i], bits) for i in order]
    held = np.random.default_rng(1).random(len(rows)) < (0.25 if len(rows) >= 40 else 0)

    def solve(which: np.ndarray):
        good, bad = np.zeros(1 << bits), np.zeros(1 << bits)
        for i in which:
            (good if y[i] > 0 else bad)[rows[i]] += 1
        ups, downs = max(1, (y[which] > 0).sum()), max(1, (y[which] < 0).sum())
        ratio = np.log((good + SMOOTHING) / (ups + 2 * SMOOTHING)) - np.log((bad + SMOOTHING) / (downs + 2 * SMOOTHING))
        ratio[(good + bad) < 2] = 0
        cost = np.where(y[which] > 0, len(which) / (2 * ups), len(which) / (2 * downs)) * PENALTY
        w, bias = dual_descent([rows[i] for i in which], y[which], ratio, cost)
        return BLEND * w + (1 - BLEND) * np.abs(w).mean(), ratio, bias

    fitted = solve(np.flatnonzero(~held))
    tested = np.flatnonzero(held) if held.any() and len(set(y[held])) == 2 else np.arange(len(rows))
    m = margins([rows[i] for i in tested], *fitted)
    # Targets kept off 0 and 1 by a count, weights that restore the prior.
    up = y[tested] > 0
    target = np.where(up, (up.sum() + 1) / (up.sum() + 2), 1 / ((~up).sum() + 2))
    weight = np.where(up, prior / max(1, up.sum()), (1 - prior) / max(1, (~up).sum()))
    slope, level = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * m + level, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ m, g.sum()])
        hess = np.array([[h @ (m * m), h @ m], [h @ m, h.sum()]]) + 1e-6 * np.eye(2)
        change = np.linalg.solve(hess, grad)
        slope, level = slope - np.clip(change[0], -5, 5), level - np.clip(change[1], -5, 5)
        if np.abs(change).max() < 1e-6:
            break
    w, ratio, bias = fitted
    return {"weight": w.astype(np.float32), "scale": ratio.astype(np.float32), "bias": bias, "slope": float(slope), "level": float(level), "bits": bits}


def predict(model: dict, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each whole text."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    m = margins([indicators(t, model["bits"]) for t in texts], model["weight"], model["scale"], model["bias"])
    return 1 / (1 + np.exp(-np.clip(model["slope"] * m + model["level"], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", only: Column | None = None, rows: int = SAMPLE_ROWS, bits: int = BITS) -> dict:
    """The model from about ``rows`` labelled rows at most, drawn evenly from both classes.

    ``only`` is a condition on the label table. Labels that are null, or whose document is
    missing, are not used; a null text counts as empty. The fit runs in one task on the
    sample, whose size does not grow with the tables.
    """
    usable = labels.select(quoted(doc_id).alias("id"), quoted(label).cast("int").alias("label"), (F.lit(True) if only is None else only).alias("used"))
    usable = usable.filter("used and id is not null and label in (0, 1)").drop("used")
    prior = usable.agg(F.avg("label")).first()[0]
    drawn = sample_rows(usable, "label", rows)
    source = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text"))
    # The drawn labels are at most about ``rows`` rows of two numbers.
    sample = source.join(F.broadcast(drawn), "id").select("text", "label")

    def run(batches):
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_quality(texts, marks, prior, bits))], type=pa.binary())], ["model"])

    fitted = sample.repartition(1).mapInArrow(run, "model binary").first()
    # Spark runs no task where there is no row.
    return pickle.loads(fitted[0]) if fitted else fit_quality([], [], 1.0, bits)


def score(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the score of every row, 0 to 1; null counts as the empty text."""
    return map_texts(docs, keep, text, lambda texts: [predict(model, texts)], "score double")
