"""Language identification with error-correcting output codes."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.tables import keep_texts, map_texts, sample_rows

UNDETERMINED = "und"
# Size of the hashed n-gram space, as a power of two.
BITS = 14
# Rows the classifiers are fitted on, over all languages together.
SAMPLE_ROWS = 4096
EPOCHS = 30
BATCH = 64
# Up to so many languages every split of them into two parts is a classifier.
EXHAUSTIVE = 6
# Share by which the second-best codeword must be farther than the best one.
AMBIGUOUS = 0.02
CHUNK = 1 << 20

# ASCII capitals to small letters, other ASCII characters that are no letters to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of hashed two- and three-byte grams of the whole text, case folded."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8").translate(FOLD) + b" ", dtype=np.uint8)
    counts = np.zeros(1 << bits, dtype=np.int64)
    shift = np.uint32(32 - bits)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + 2].astype(np.uint32)
        pairs = part[:-1] * np.uint32(257) + part[1:]
        counts += np.bincount(((pairs[: CHUNK] * np.uint32(2654435761)) >> shift).astype(np.int64), minlength=1 << bits)
        triples = pairs[:-1] * np.uint32(263) + part[2:] + np.uint32(1 << 24)
        counts += np.bincount(((triples * np.uint32(2246822519)) >> shift).astype(np.int64), minlength=1 << bits)
    return counts


def features(texts: list[str], bits: int = BITS) -> np.ndarray:
    """A row of unit length per text: damped gram counts."""
    out = np.empty((len(texts), 1 << bits), dtype=np.float32)
    for i, text in enumerate(texts):
        row = np.sqrt(gram_counts(text, bits))
        out[i] = row / max(1.0, float(np.sqrt((row * row).sum())))
    return out


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 per language: all splits for a few, else seeded random columns.

    Random columns are as many as 15 log2(n); of 64 drawn codes the one whose nearest
    two codewords are farthest apart is taken.
    """
    if n <= 1:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        masks = np.arange(1, 2 ** (n - 1))
        return np.array([np.where(masks >> k & 1, -1, 1) if k < n - 1 else np.ones(len(masks), dtype=int) for k in range(n)])
    rng, best, width = np.random.default_rng(n), None, int(np.ceil(15 * np.log2(n)))
    for _ in range(64):
        code = rng.choice([-1, 1], size=(n, width))
        apart = ((width - code @ code.T) // 2 + np.eye(n, dtype=int) * width).min()
        if np.abs(code.sum(axis=0)).max() < n and (best is None or apart > best[0]):
            best = apart, code
    return best[1] if best else code


def fit_codes(texts: list[str], langs: list[str], bits: int = BITS) -> dict:
    """Binary logistic classifiers for the bits of the codewords, and how far each can be trusted."""
    order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
    names = sorted(set(langs))
    code = codewords(len(names))
    if not code.shape[1]:
        return {"names": names, "code": code, "w": np.zeros((1 << bits, 0), np.float32), "b": np.zeros(0, np.float32), "trust": code, "bits": bits}
    x = features([texts[i] for i in order], bits)
    which = np.array([names.index(langs[i]) for i in order])
    y = code[which].astype(np.float32)
    rng = np.random.default_rng(0)
    shuffled = rng.permutation(len(x))
    checked, used = shuffled[::5], np.delete(shuffled, np.s_[::5]) if len(x) >= 50 else shuffled
    # Every language weighs the same, however many of its rows were drawn.
    share = np.bincount(which[used], minlength=len(names))
    weight = (len(used) / (len(names) * np.maximum(share, 1)))[which].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    for epoch in range(EPOCHS):
        rate = 8.0 / (1 + epoch)
        for at in range(0, len(used), BATCH):
            rows = used[at : at + BATCH]
            slope = -y[rows] / (1 + np.exp(np.clip(y[rows] * (x[rows] @ w + b), -30, 30))) * weight[rows, None]
            w -= rate * (x[rows].T @ slope) / len(rows)
            b -= rate * 0.1 * slope.mean(axis=0)
        rng.shuffle(used)
    right = (np.sign(x[checked] @ w + b) == y[checked]).astype(float)
    trust = np.full(code.shape, 0.5)
    for k in range(len(names)):
        own = right[which[checked] == k]
        if len(own):
            trust[k] = (own.sum(axis=0) + 1) / (len(own) + 2)
    return {"names": names, "code": code, "w": w, "b": b, "trust": trust / trust.sum(axis=1, keepdims=True), "bits": bits}


def decode(model: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, margin to the second) by the loss-weighted distance to each codeword."""
    losses = np.exp(-np.clip(margins[:, None, :] * model["code"][None], -4, 4))
    distance = (losses * model["trust"][None]).sum(axis=2)
    ranked = np.sort(distance, axis=1)
    best = distance.argmin(axis=1)
    inverse = 1 / distance**2
    score = inverse.max(axis=1) / inverse.sum(axis=1)
    apart = (ranked[:, 1] - ranked[:, 0]) / ranked[:, 1] if ranked.shape[1] > 1 else np.ones(len(ranked))
    return best, score, apart


def predict(model: dict, texts: list[str | None], block: int = 256) -> tuple[list, list, list]:
    """Language, score and ambiguity of each text; texts without letters are undetermined."""
    names, scores, doubts = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if not model["names"]:
        return names, scores, doubts
    lettered = [i for i, t in enumerate(texts) if has_letter(t)]
    for at in range(0, len(lettered), block):
        rows = lettered[at : at + block]
        if model["code"].shape[1]:
            best, score, apart = decode(model, features([texts[i] for i in rows], model["bits"]) @ model["w"] + model["b"])
        else:
            best, score, apart = np.zeros(len(rows), int), np.ones(len(rows)), np.ones(len(rows))
        for i, k, s, a in zip(rows, best, score, apart):
            names[i], scores[i], doubts[i] = model["names"][k], float(s), bool(a < AMBIGUOUS)
    return names, scores, doubts


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", only: Column | None = None, rows: int = SAMPLE_ROWS, bits: int = BITS) -> dict:
    """The model from a sample of at most about ``rows`` labelled rows, the same number for every language.

    ``only`` limits the rows that may be learned from. Rows with null text or language are
    not used. The fit runs in one task on the sample, whose size does not grow with the table.
    """
    usable = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), (F.lit(True) if only is None else only).alias("used"))
    usable = usable.filter("used and text is not null and lang is not null").drop("used")
    sample = sample_rows(usable, "lang", rows)

    def run(batches):
        texts, langs = [], []
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(t):
                    texts.append(t)
                    langs.append(name)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_codes(texts, langs, bits))], type=pa.binary())], ["model"])

    fitted = sample.select("text", "lang").repartition(1).mapInArrow(run, "model binary").first()
    # Spark runs no task where there is no row.
    return pickle.loads(fitted[0]) if fitted else fit_codes([], [], bits)


def identify(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score and ambiguous of every row.

    Null texts and texts without a letter are ``und`` with score 0 and count as ambiguous;
    so is every text if no language could be learned.
    """
    return map_texts(docs, keep, text, lambda texts: predict(model, texts), "lang_pred string, score double, ambiguous boolean")


def drop_unidentified(docs: DataFrame, text: str = "text", lang: str = "lang", only: Column | None = None) -> DataFrame:
    """The rows whose language is found without ambiguity, columns unchanged.

    If no row carries a language there is nothing to learn from, and every row with a letter stays.
    """
    model = fit(docs, text, lang, only)
    if not model["names"]:
        return keep_texts(docs, text, lambda texts: [has_letter(t) for t in texts])
    return keep_texts(docs, text, lambda texts: [not d for d in predict(model, texts)[2]])
