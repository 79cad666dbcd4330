"""Quality by attention-based multiple-instance learning.

A text is a bag of passages (``PASSAGE_WORDS`` words each, the whole text). A passage is encoded by
measurements of its form and by hashed word and character features, all from array arithmetic over its
bytes. A hidden layer makes a representation h of each passage; a gated attention, softmax over
w . (tanh(V h) * sigmoid(U h)), weighs a text's passages; the weighed representation gives the score.
Only texts have labels: which passages matter is learned from them.

The model is fitted on the driver on a sample of whole texts, bounded by ``SAMPLE`` rows and ``SAMPLE_PASSAGES``
passages in all: labelled rows that are for training are taken in the order of a hash, as long as they fit (a text that
does not fit is passed over whole, never cut). Scoring reads every passage of every text, on the executors. The
fitted weights are some 10,000s of numbers.

Defined cases: null text is the empty text, a text without words is one passage of zeros and gets a
score as any other; labels that are null are left out, repeated labels of one document count once (the
largest); without any label of both classes the model's score is 0.5; repeated rows get equal scores;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_of
from .words import BLANK, SAME, blocks, fingerprints, texts_of

PASSAGE_WORDS = 64
SAMPLE, SAMPLE_PASSAGES = 4000, 60_000
HASHED = 96
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 60, 64, 0.01, 1e-4, 7

_code = np.arange(256)
#: Kinds of bytes whose share of a passage is a feature.
_KINDS = np.stack(
    [
        np.isin(_code, [ord(c) for c in "#*$%&|<>"]),
        np.isin(_code, [ord(c) for c in "|"]),
        np.isin(_code, [ord(c) for c in "!?"]),
        np.isin(_code, [ord(c) for c in ".,;:"]),
        (_code >= 65) & (_code <= 90),
        (_code >= 97) & (_code <= 122),
        (_code >= 48) & (_code <= 57),
        _code >= 128,
        _code == 10,
    ]
)
FEATURES = len(_KINDS) + 5 + HASHED


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a column of texts, and each text's number of passages (at least one)."""
    data, offsets = texts_of(column)
    rows, numbers = [np.zeros((0, FEATURES), np.float32)], [np.zeros(0, np.int64)]
    for first, last in blocks(offsets):
        at = offsets[first : last + 1]
        features, number = _encode_block(data[at[0] : at[-1]], at - at[0])
        rows.append(features)
        numbers.append(number)
    return np.concatenate(rows), np.concatenate(numbers)


def _encode_block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, prints, counts = fingerprints(data, offsets, BLANK, SAME)
    number = np.maximum(1, -(-counts // PASSAGE_WORDS))
    base = np.concatenate([[0], np.cumsum(number)])
    total = int(base[-1])
    out = np.zeros((total, FEATURES), dtype=np.float32)
    if not len(starts):
        return out, number
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = base[text] + place // PASSAGE_WORDS
    head = np.flatnonzero(np.diff(passage, prepend=-1))  # the first word of each passage that has words
    has = passage[head]
    words = np.diff(np.append(head, len(starts))).astype(np.float64)
    begin, finish = starts[head], ends[np.append(head[1:], len(starts)) - 1]
    size = np.maximum(finish - begin, 1)
    for k, kind in enumerate(_KINDS):
        running = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        out[has, k] = (running[finish] - running[begin]) / size
    k = len(_KINDS)
    length = (ends - starts).astype(np.float64)
    mean = np.add.reduceat(length, head) / words
    out[has, k] = mean / 10
    out[has, k + 1] = np.sqrt(np.maximum(0, np.add.reduceat(length**2, head) / words - mean**2)) / 10
    order = np.lexsort((prints, passage))
    repeated = np.zeros(len(prints), dtype=bool)
    repeated[order[1:]] = (prints[order][1:] == prints[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    out[has, k + 2] = np.add.reduceat(repeated.astype(np.float64), head) / words
    out[has, k + 3] = np.log1p(words) / 5
    out[has, k + 4] = np.log1p(counts[text[head]]) / 10
    slot = (prints >> np.uint64(16)).astype(np.int64) % HASHED
    sign = np.where((prints >> np.uint64(63)).astype(bool), 1.0, -1.0)
    hashed = np.bincount(passage * HASHED + slot, weights=sign, minlength=total * HASHED).reshape(total, HASHED)
    out[has, k + 5 :] = (hashed[has] / np.sqrt(words)[:, None]).astype(np.float32)
    return out, number


def _forward(model: dict, x: np.ndarray, number: np.ndarray) -> dict:
    """Everything from features to scores; ``number`` are passages by text, in order."""
    cut = np.cumsum(number) - number
    bag = np.repeat(np.arange(len(number)), number)
    z = (x - model["mean"]) / model["scale"]
    h = np.tanh(z @ model["W"] + model["b"])
    a, g = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-np.clip(h @ model["U"], -30, 30)))
    e = (a * g) @ model["w"]
    e = np.exp(e - np.maximum.reduceat(e, cut)[bag])
    weight = e / np.add.reduceat(e, cut)[bag]
    pooled = np.add.reduceat(weight[:, None] * h, cut, axis=0)
    logit = np.clip(pooled @ model["c"] + model["d"], -30, 30)
    return {"z": z, "h": h, "a": a, "g": g, "bag": bag, "cut": cut, "weight": weight, "pooled": pooled, "score": 1 / (1 + np.exp(-logit))}


def _gradients(model: dict, f: dict, y: np.ndarray, cost: np.ndarray) -> dict:
    """Of the weighted log loss."""
    d_logit = cost * (f["score"] - y) / len(y)
    d_pooled = d_logit[:, None] * model["c"]
    bag, h, weight = f["bag"], f["h"], f["weight"]
    d_h = weight[:, None] * d_pooled[bag]
    d_weight = (h * d_pooled[bag]).sum(axis=1)
    d_e = weight * (d_weight - np.add.reduceat(weight * d_weight, f["cut"])[bag])
    d_gate = d_e[:, None] * model["w"]
    d_a, d_g = d_gate * f["g"] * (1 - f["a"] ** 2), d_gate * f["a"] * f["g"] * (1 - f["g"])
    d_h = d_h + d_a @ model["V"].T + d_g @ model["U"].T
    d_z = d_h * (1 - h**2)
    return {
        "c": f["pooled"].T @ d_logit, "d": d_logit.sum(), "w": (f["a"] * f["g"]).T @ d_e, "V": h.T @ d_a, "U": h.T @ d_g,
        "W": f["z"].T @ d_z, "b": d_z.sum(axis=0),
    }


def fit(x: np.ndarray, number: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """A model by stochastic gradient steps (Adam); both classes weigh the same."""
    rng = np.random.default_rng(seed)
    k = x.shape[1]
    model = {
        "mean": x.mean(axis=0) if len(x) else np.zeros(k), "scale": x.std(axis=0) + 1e-3 if len(x) else np.ones(k),
        "W": rng.normal(0, k**-0.5, (k, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, ATTENTION**-0.5, ATTENTION), "c": np.zeros(HIDDEN), "d": 0.0,
    }
    positive = y.mean() if len(y) else 0.5
    if not 0 < positive < 1:
        return model
    cost = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive))
    start = np.cumsum(number) - number
    names = ["W", "b", "V", "U", "w", "c", "d"]
    first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            rows = np.concatenate([np.arange(start[i], start[i] + number[i]) for i in pick])
            grads = _gradients(model, _forward(model, x[rows], number[pick]), y[pick], cost[pick])
            step += 1
            for n in names:
                grad = grads[n] + DECAY * model[n]
                first[n] = 0.9 * first[n] + 0.1 * grad
                second[n] = 0.999 * second[n] + 0.001 * grad**2
                model[n] = model[n] - RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str = "doc_id"):
    """The fold that is never trained on."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, number = encode(batch.column(2))
        cuts = np.concatenate([[0], np.cumsum(number)])
        cells = [x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(number), pa.array(cells, pa.binary())], names=["doc_id", "target", "n", "bag"])


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> dict:
    """Fits on at most ``sample`` labelled rows of the training folds, chosen by hash of the id, of at most ``passages`` passages in all."""
    marked = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).alias("target"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", text_of("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    rows = rows.groupBy("doc_id", "target").agg(F.min("text").alias("text"))  # a repeated id counts once
    with scratch(documents.sparkSession, "bags") as keep:
        bags = keep(rows.mapInArrow(_bags, "doc_id bigint, target int, n bigint, bag binary"), "bags")
        fitting, held = [], 0
        for row in bags.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most ``sample`` rows
            if held + row["n"] <= passages:
                held += row["n"]
                fitting.append(row["doc_id"])
        found = bags.where(F.col("doc_id").isin(fitting)).orderBy("doc_id").select("target", "bag").toArrow()
    cells = [np.frombuffer(c, np.float32).reshape(-1, FEATURES) for c in found.column("bag").to_pylist()]
    x = np.concatenate(cells or [np.zeros((0, FEATURES), np.float32)]).astype(np.float64)
    return fit(x, np.array([len(c) for c in cells], dtype=np.int64), np.array(found.column("target").to_pylist(), dtype=np.float64))


def score(documents: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, attention): every row's score, and which passage weighed most (from 0)."""
    shared = documents.sparkSession.sparkContext.broadcast({k: np.asarray(v, dtype=np.float32) for k, v in model.items()})  # the fixed shape of the network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                x, number = encode(batch.column(1))
                f = _forward(shared.value, x, number)
                best = np.lexsort((np.arange(len(f["bag"])), -f["weight"], f["bag"]))[f["cut"]] - f["cut"]
                yield pa.record_batch([batch.column(0), pa.array(f["score"].astype(np.float64)), pa.array(best.astype(np.int32))], names=["doc_id", "score", "attention"])

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, attention int")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``documents``."""
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
