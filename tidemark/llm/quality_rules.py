"""Quality rules: base counts, and a calibrated n-gram model over hashed features.

The model is logistic regression over two families of features, each a share of
its own: hashed words, and hashed runs of ``GRAM`` characters. It learns from a
bounded sample of labelled rows (``PER_CLASS`` of either class; of a long text
``PIECES`` pieces of ``PIECE`` bytes), and a part that it hasn't seen calibrates
its scores to probabilities (Platt). Whole texts are scored in Arrow batches and
held against fixed thresholds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

DIMENSIONS = 1 << 16
GRAM = 4
PER_CLASS = 1000
PIECES, PIECE = 4, 3000
STEPS = 120
#: Fixed thresholds: fewest words, largest share (in percent) of repeated words, least probability of good quality.
MIN_WORDS, MAX_REPEATED, MIN_QUALITY = 50, 50, 0.5
#: Words, bytes or characters handled at a time.
BLOCK = 1 << 18

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_INSIDE = np.ones(256, np.int64)  # bytes that begin a character of a word
_INSIDE[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = 0


def counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = raw.split()
    chars = symbols = 0
    for at in range(0, len(raw), BLOCK):
        data = np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - at), at)
        by_byte = np.bincount(data, minlength=256)
        chars += int(by_byte @ _INSIDE)
        symbols += int(by_byte @ _SYMBOL)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words inside windows of three words that occur more than once."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = len(number)
    _, pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)
    _, triple, often = np.unique(pair[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
    twice = often[triple] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shares of hashed words (first half of the places) and of hashed runs of characters (second half)."""
    half = DIMENSIONS // 2
    total = np.zeros(DIMENSIONS, np.float32)
    words = raw.split()
    for at in range(0, len(words), BLOCK):
        block = np.fromiter(map(zlib.crc32, words[at : at + BLOCK]), np.int64) & (half - 1)
        total[:half] += np.bincount(block, minlength=half)
    text = _characters(raw)
    for at in range(0, len(text) - GRAM + 1, BLOCK):
        total[half:] += np.bincount(_grams(text, at), minlength=half)
    place = np.flatnonzero(total)
    value = total[place]
    value[place < half] *= 10 / max(1, len(words))
    value[place >= half] *= 10 / max(1, len(text) - GRAM + 1)
    return place, value


def _characters(raw: bytes) -> bytes | str:
    """The text by code points; in plain ASCII its bytes are these."""
    return raw if raw.isascii() else raw.decode("utf-8", "replace")


def _grams(text: bytes | str, at: int) -> np.ndarray:
    """Places (below half the dimensions) of the runs of characters that begin in a block."""
    block = text[at : at + BLOCK + GRAM - 1]
    points = np.frombuffer(block, np.uint8) if isinstance(block, bytes) else np.frombuffer(block.encode("utf-32-le"), np.uint32)
    data = points.astype(np.uint32)
    n = len(data) - GRAM + 1
    run = data[:n].copy()
    for k in range(1, GRAM):
        run *= np.uint32(16777619)
        run ^= data[k : k + n]
    run *= np.uint32(2654435761)
    run >>= np.uint32(32 - (DIMENSIONS // 2).bit_length() + 1)
    return run.astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float  # of the calibration
    offset: float

    def probability(self, raw: bytes) -> float:
        half, words = DIMENSIONS // 2, raw.split()
        score = self.bias
        if words:
            total = 0.0
            for at in range(0, len(words), BLOCK):
                block = np.fromiter(map(zlib.crc32, words[at : at + BLOCK]), np.int64) & (half - 1)
                total += float(self.weights[block].sum(dtype=np.float64))
            score += 10 * total / len(words)
        text = _characters(raw)
        if len(text) >= GRAM:
            total = sum(float(self.weights[half + _grams(text, at)].sum(dtype=np.float64)) for at in range(0, len(text) - GRAM + 1, BLOCK))
            score += 10 * total / (len(text) - GRAM + 1)
        return float(_sigmoid(self.slope * score + self.offset))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[bytes, bool]], steps: int = STEPS) -> Model | None:
    """A model from (text, good) rows; None unless both classes are there. One row in four calibrates."""
    if len({good for _, good in rows}) < 2:
        return None
    sparse = [features(raw) for raw, _ in rows]
    good = np.array([g for _, g in rows], np.float64)
    aside = np.arange(len(rows)) % 4 == 3
    if len(set(good[aside])) < 2 or len(set(good[~aside])) < 2:
        aside = np.zeros(len(rows), bool)
    learn = np.flatnonzero(~aside)
    place = np.concatenate([sparse[i][0] for i in learn] or [np.zeros(0, np.int64)])
    value = np.concatenate([sparse[i][1] for i in learn] or [np.zeros(0, np.float32)])
    owner = np.repeat(np.arange(len(learn)), [len(sparse[i][0]) for i in learn])
    y = good[learn]
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(DIMENSIONS), 0.0
    m, v, mb, vb = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    for step in range(1, steps + 1):
        error = (_sigmoid(np.bincount(owner, w[place] * value, len(learn)) + b) - y) * share
        g = np.bincount(place, error[owner] * value, DIMENSIONS) + 1e-5 * w
        gb = float(error.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= 0.3 * (mb / (1 - 0.9**step)) / (vb**0.5 / (1 - 0.99**step) ** 0.5 + 1e-6)
    model = Model(w.astype(np.float32), b, 1.0, 0.0)
    test = np.flatnonzero(aside) if aside.any() else learn
    scores = np.array([float(model.weights[sparse[i][0]] @ sparse[i][1]) + b for i in test])
    model.slope, model.offset = _platt(scores, good[test])
    return model


def _platt(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the scores, by damped Newton steps on smoothed targets."""
    up, down = good.sum(), len(good) - good.sum()
    target = np.where(good > 0, (up + 1) / (up + 2), 1 / (down + 2))
    spread = score.std() or 1.0
    x = np.stack([(score - score.mean()) / spread, np.ones(len(score))], axis=1)
    a = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ a)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        a -= 0.7 * np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * a)
    return float(a[0] / spread), float(a[1] - a[0] * score.mean() / spread)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[bytes, bool]]:
    """A bounded sample of labelled texts. A row is bad if any of its labels is."""
    named = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).alias("good"))
    )
    totals = {r["good"]: r["count"] for r in named.groupBy("good").count().collect()}
    if len(totals) < 2:
        return []
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("good"), F.lit(1.5 * per_class / totals[True])).otherwise(1.5 * per_class / totals[False])
    rank = Window.partitionBy("good").orderBy("draw", "doc_id")
    picked = (
        named.where(draw < share)
        .select("doc_id", "good", F.xxhash64("doc_id").alias("draw"))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= per_class)
        .select("doc_id", "good")
    )
    raw = F.col("text").cast("binary")
    room = F.greatest(F.octet_length("text") - PIECE, F.lit(0))
    pieces = F.when(F.octet_length("text") <= PIECES * PIECE, F.array(raw)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(raw, (F.lit(1) + F.floor(room * k / (PIECES - 1))).cast("int"), F.lit(PIECE)))
    )
    # 2 * per_class rows at most, so the broadcast has a bound
    rows = (
        docs.select("doc_id", "text")
        .where("text is not null")
        .join(F.broadcast(picked), "doc_id")
        .select("doc_id", "good", pieces.alias("pieces"))
        .groupBy("doc_id", "good")
        .agg(F.min("pieces").alias("pieces"))
        .orderBy(F.xxhash64("doc_id"))
        .collect()
    )
    return [(b"".join(map(bytes, r["pieces"])), r["good"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    return train(sample(docs, labels, per_class))


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with the base counts, ``probability`` of good quality, ``base_failed`` and ``kept``.

    Null texts have no words; texts that fail the base rules have no
    probability. Without a model (no labels, or one class) the base rules
    decide alone. Whole texts are read; other columns pass through (those of
    these names are replaced). Empty tables give no rows.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf(JUDGED)
    def judged(texts: pa.Array) -> pa.Array:
        rows = []
        for raw in texts.to_pylist():
            base = counts(raw or b"")
            rows.append((*base, None if model is None or fails(base[0], base[4]) else model.probability(raw)))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    names = [x.split()[0] for x in JUDGED.split(", ")]
    out = docs.withColumn("_judged", judged(F.col("text").cast("binary")))
    out = out.withColumns({x: F.col(f"_judged.{x}") for x in names}).drop("_judged")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.lit(model is None) | F.coalesce(F.col("probability") >= MIN_QUALITY, F.lit(False)))
    )


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words
