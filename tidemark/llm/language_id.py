"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``WINDOW`` bytes. Two recurrent layers, one for
each direction, read a window; every byte gets a probability for each language
from both states, and a document's probabilities are the mean over its bytes.
The cell has one gate:

    z, n = sigmoid(E_z[x] + h U_z), tanh(E_n[x] + h U_n);  h' = z h + (1 - z) n

It is trained in numpy by backpropagation through time on a bounded sample of
every language there is: ``PER_LANGUAGE`` rows of each, or equal parts of
``ROWS`` rows where these are fewer (but ``LEAST`` rows), and ``WINDOWS``
windows of each row. Rows are sampled by the hash of their id, so the sample
doesn't depend on partitions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

WINDOW = 128
HIDDEN = 12
PER_LANGUAGE = 160
ROWS = 10240
LEAST = 8
WINDOWS = 6
EPOCHS = 14
BATCH = 128
#: Windows that a worker reads at a time.
BLOCK = 1024
PAD = 256
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # 2 x 257 x 2H; the last row stands for no byte and keeps the state
    recur: np.ndarray  # 2 x H x 2H
    out: np.ndarray  # 2H x languages
    bias: np.ndarray


def _start(languages: list[str], hidden: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
    return Model(languages, draw(2, PAD + 1, 2 * hidden), draw(2, hidden, 2 * hidden), draw(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))


def _forward(model: Model, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """States (time x windows x 2H) for bytes (windows x time); with ``keep`` also gates for training."""
    count, time = data.shape
    hidden = model.recur.shape[1]
    embed = model.embed.copy()
    embed[:, PAD, :hidden], embed[:, PAD, hidden:] = 40, 0  # no byte: the gate keeps the state
    embed[:, :, :hidden] *= 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2: one tanh for both halves
    recur = model.recur.copy()
    recur[:, :, :hidden] *= 0.5
    states = np.empty((time, count, 2 * hidden), np.float32)
    gates = np.empty((2, time, count, 2 * hidden), np.float32) if keep else None
    columns = np.ascontiguousarray(data.T)
    a, b = np.empty((count, 2 * hidden), np.float32), np.empty((count, 2 * hidden), np.float32)
    for way in range(2):
        h = np.zeros((count, hidden), np.float32)
        at = slice(way * hidden, (way + 1) * hidden)
        for t in range(time) if way == 0 else range(time - 1, -1, -1):
            np.take(embed[way], columns[t], axis=0, out=a, mode="clip")
            np.matmul(h, recur[way], out=b)
            a += b
            np.tanh(a, out=a)
            z, n = a[:, :hidden], a[:, hidden:]
            z *= 0.5
            z += 0.5
            h = h - n
            h *= z
            h += n
            states[t, :, at] = h
            if keep:
                gates[way, t] = a
    return states, (gates,)


def _probabilities(model: Model, states: np.ndarray) -> np.ndarray:
    logits = states.reshape(-1, states.shape[-1]) @ model.out
    logits += model.bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.reshape(*states.shape[:2], -1)


def gradients(model: Model, data: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all bytes, and its gradient by backpropagation through time."""
    hidden, (count, time) = model.recur.shape[1], data.shape
    states, (gates,) = _forward(model, data, keep=True)
    p = _probabilities(model, states)
    real = (data.T != PAD).astype(np.float32)
    total = max(float(real.sum()), 1.0)
    own = np.take_along_axis(p, np.broadcast_to(label[None, :, None], (time, count, 1)), axis=2)[..., 0]
    loss = -float((np.log(np.maximum(own, 1e-9)) * real).sum()) / total
    d = p
    np.put_along_axis(d, np.broadcast_to(label[None, :, None], (time, count, 1)), own[..., None] - 1, axis=2)
    d *= (real / total)[..., None]
    flat = d.reshape(-1, d.shape[-1])
    d_out = states.reshape(-1, 2 * hidden).T @ flat
    d_bias = flat.sum(axis=0)
    d_states = (flat @ model.out.T).reshape(states.shape)
    d_embed, d_recur = np.zeros_like(model.embed), np.zeros_like(model.recur)
    codes = data.T.ravel()
    for way in range(2):
        at = slice(way * hidden, (way + 1) * hidden)
        order = range(time - 1, -1, -1) if way == 0 else range(time)
        carry = np.zeros((count, hidden), np.float32)
        d_gates = np.empty((time, count, 2 * hidden), np.float32)
        for t in order:
            before = t - 1 if way == 0 else t + 1
            h = states[before, :, at] if 0 <= before < time else np.zeros((count, hidden), np.float32)
            z, n = gates[way, t, :, :hidden], gates[way, t, :, hidden:]
            dh = d_states[t, :, at] + carry
            d_gates[t, :, :hidden] = dh * (h - n) * z * (1 - z)
            d_gates[t, :, hidden:] = dh * (1 - z) * (1 - n * n)
            carry = dh * z + d_gates[t] @ model.recur[way].T
            d_recur[way] += h.T @ d_gates[t]
        flat = d_gates.reshape(-1, 2 * hidden)
        for k in range(2 * hidden):
            d_embed[way, :, k] = np.bincount(codes, flat[:, k], PAD + 1)
    d_embed[:, PAD] = 0
    return loss, [d_embed, d_recur, d_out, d_bias]


def train(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 11) -> Model | None:
    """A model by Adam over shuffled batches; None without windows."""
    if not windows:
        return None
    languages = sorted(set(labels))
    model = _start(languages, hidden, seed)
    index = {x: i for i, x in enumerate(languages)}
    data, label = _pad(windows), np.array([index[x] for x in labels])
    params = [model.embed, model.recur, model.out, model.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        rate = 0.02 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            _, grads = gradients(model, data[pick], label[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _pad(windows: list[bytes]) -> np.ndarray:
    data = np.full((len(windows), WINDOW), PAD, np.int32)
    for i, x in enumerate(windows):
        data[i, : len(x)] = np.frombuffer(x, np.uint8)
    return data


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or (not raw.isascii() and any(map(str.isalpha, raw.decode("utf-8", "replace"))))


def predict(model: Model | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    """Language and its mean probability over all bytes of each text."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, scores
    pieces, owner = [], []
    sums = np.zeros((len(texts), len(model.languages)))

    def read() -> None:
        data = _pad(pieces)
        p = _probabilities(model, _forward(model, data)[0])
        short = [i for i, x in enumerate(pieces) if len(x) < WINDOW]
        for i in short:
            p[len(pieces[i]) :, i] = 0
        np.add.at(sums, owner, p.sum(axis=0))
        pieces.clear()
        owner.clear()

    known = [raw is not None and has_letter(raw) for raw in texts]
    for i, raw in enumerate(texts):
        if not known[i]:
            continue
        for at in range(0, len(raw), WINDOW):
            pieces.append(raw[at : at + WINDOW])
            owner.append(i)
            if len(pieces) == BLOCK:
                read()
    if pieces:
        read()
    for i in np.flatnonzero(known):
        best = int(np.argmax(sums[i]))
        names[i], scores[i] = model.languages[best], float(min(1.0, sums[i, best] / len(texts[i])))
    return names, scores


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id") -> tuple[list[bytes], list[str]]:
    """Windows and languages of a bounded sample of ``labelled`` (id, text, lang)."""
    rows = labelled.where(F.col(id_col).isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != ""))
    # one row for each language
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return [], []
    per_language = min(per_language, max(LEAST, ROWS // len(counts)))
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * per_language / r["count"] + 1e-4)) for r in counts], "lang string, _share double")
    raw = F.col("text").cast("binary")
    room = F.greatest(F.octet_length("text") - WINDOW, F.lit(0))
    picked = (
        rows.select(id_col, "text", "lang")
        .join(F.broadcast(shares), "lang")
        .where(draw < F.col("_share"))
        .select(
            "lang",
            F.xxhash64(id_col).alias("draw"),
            F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring(raw, (F.lit(1) + F.floor(room * k / max(1, WINDOWS - 1))).cast("int"), F.lit(WINDOW))).alias("windows"),
        )
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "windows")))
        .where(F.col("rank") <= per_language)
        .orderBy("lang", "rank")
        .collect()
    )
    pairs = [(bytes(w), r["lang"]) for r in picked for w in dict.fromkeys(map(bytes, r["windows"])) if w]
    return [w for w, _ in pairs], [x for _, x in pairs]


def fit(labelled: DataFrame, id_col: str = "doc_id") -> Model | None:
    return train(*sample(labelled, id_col=id_col))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the mean probability, 0 to 1).

    ``und`` with score 0 where the text is null or has no letter, or where no
    model could be trained. Whole texts are read; other columns pass through
    (columns of these two names are replaced). Empty tables give no rows.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        names, scores = predict(model, texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    out = docs.withColumn("_language", predicted(F.col("text").cast("binary")))
    return out.withColumns({"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")
