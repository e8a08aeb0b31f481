"""Text kernels that need a parser or a loop: HTML, risk sections, JSON in prose, word pieces, scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr, wordpiece


class _Text(HTMLParser):
    """Texts outside scripts and styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_to_text(html: str | None) -> str:
    """Texts joined by spaces, white space (hard spaces included) collapsed."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return re.sub(r"\s+", " ", " ".join(parser.parts).replace("\xa0", " "))


#: Pages whose texts are Python's at once.
_PAGES = 64


def html_texts(batch: pa.Array) -> pa.Array:
    """X04 for many pages: they become Python's text one by one, and go back to Arrow a few at a time."""
    parts = [pa.array([html_to_text(x.as_py()) for x in batch[i : i + _PAGES]], pa.string()) for i in range(0, len(batch), _PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


# Patterns and phrases of annual reports.
_ITEM = re.compile(r"item\s*1a", re.I)
_ITEM_HEADER = re.compile(r"item\s*1a\.?\s*risk\s*factors", re.I)
_HEADER = re.compile(r"(item\s*1a\.?\s*)?risk\s*factors\s*[\.\:”\"]?\s+(?=[A-Z])", re.I)
_CONTENTS = re.compile(r"\s*(item\s*1a\.?\s*)?risk\s*factors\s*\d{1,4}\s+item\s*1b", re.I)
_END = re.compile(
    r"(?:item\s*)?1b\.?\s*unresolved\s*staff\s*comments|(?:item\s*)?1c\.?\s*cybersecurity|(?:item\s*)?2\.?\s*properties"
    r"|(?:item\s*)?3\.?\s*legal\s*proceedings|form\s*10-k\s*cross\s*reference\s*index",
    re.I,
)
_AFTER_HEADER = ["incorporated by reference", "incorporated herein by reference", "can be found in this report under", "information in response to this item"]
_ELSEWHERE = ["incorporated by reference", "incorporated herein by reference", "annual report to shareholders", "information in response to this item"]
_POINTERS = ["section", "above", "below", "of this form", "discussed"]
LEAST, OVERRUN = 2000, 300_000

Section = tuple[str, str | None, int, list[str]]


def refers_elsewhere(text: str) -> bool:
    """An item header with a phrase soon after it that points to another document."""
    return any(p in text[m.start() : m.start() + 300].lower() for m in _ITEM.finditer(text) for p in _ELSEWHERE)


def risk_section(text: str) -> Section:
    """(status, section, length, flags) of the risk factors in a report's text."""
    absent = ("incorporated_by_reference", None, 0, ["incorporated_by_reference"])
    header = _ITEM_HEADER.search(text)
    if header and any(p in text[header.end() : header.end() + 250].lower() for p in _AFTER_HEADER):
        return absent
    for m in _HEADER.finditer(text):
        pointer = not m[1] and any(p in text[m.end() : m.end() + 40].lower() for p in _POINTERS)
        if pointer or _CONTENTS.match(text[m.start() : m.start() + 40]):
            continue
        end = _END.search(text, m.end())
        section = text[m.end() : end.start() if end else len(text)].strip()
        if len(section) > LEAST:  # headers come in order, so the first is the earliest
            flags = ["suspiciously_long_possible_overrun"] * (len(section) > OVERRUN)
            flags += ["possible_toc_overrun_at_end"] * ("cross reference" in section[-200:].lower())
            return "extracted", section, len(section), flags
    return absent if refers_elsewhere(text) else ("not_found", None, 0, ["no_section_found"])


def first_json(text: str) -> str:
    """X12 for one answer (see ``expr.first_json``)."""
    s = text.strip()
    if s.startswith("```"):
        s = re.sub(r"^json", "", s.strip("`"), flags=re.I).strip()
    at = s.find("{")
    if at < 0:
        return s
    depth, quoted = 0, False
    for m in re.finditer(r'\\.|["{}\\]', s[at:], re.S):
        c = ("" if quoted else m[0][1]) if len(m[0]) == 2 else m[0]
        quoted ^= c == '"'
        if not quoted and c in ("{", "}"):
            depth += 1 if c == "{" else -1
            if depth == 0:
                return s[at : at + m.end()]
    return s[at:]


def word_pieces(text: str, vocabulary: dict[str, int], most: int = 512) -> tuple[list[int], list[int], list[int]]:
    """Word pieces (ids, mask, types), cut to ``most`` with the closing mark kept."""
    ids = wordpiece.WordPieces(vocabulary).encode(text, most)
    return ids, [1] * len(ids), [0] * len(ids)


# A small word list, for scores without a model file.
NEGATIVE = [
    "loss", "losses", "decline", "declined", "risk", "risks", "adverse", "lawsuit", "litigation", "impairment", "default", "weak", "fraud", "breach", "error", "recall", "fall", "fell",
]
POSITIVE = ["gain", "gains", "growth", "profit", "record", "strong", "improve", "improved", "beat", "success", "award", "purchase", "rise", "rose", "upgrade"]


def lexicon_scores(texts: list[str]) -> list[tuple[float, float, float]]:
    """(positive, negative, neutral) from shares of words, the scorer that needs no model."""
    out = []
    for text in texts:
        words = re.findall(r"[a-z]+", text.lower())
        p, n = sum(w in POSITIVE for w in words), sum(w in NEGATIVE for w in words)
        total = p + n + 1 + len(words) / 20
        out.append((p / total, n / total, 1 - (p + n) / total))
    return out


Scorer = Callable[[list[str]], list[tuple[float, float, float]]]


def onnx_scorer(model_path: str, encode: Callable[[str], tuple[list[int], list[int], list[int]]]) -> Scorer:
    """A scorer over a model file, opened once in each worker."""
    import numpy as np

    session: list = []

    def score(texts: list[str]) -> list[tuple[float, float, float]]:
        import onnxruntime

        if not session:
            session.append(onnxruntime.InferenceSession(model_path))
        out = []
        for text in texts:
            ids, mask, types = (np.array([x], np.int64) for x in encode(text))
            logits = session[0].run(None, {"input_ids": ids, "attention_mask": mask, "token_type_ids": types})[0][0]
            raised = np.exp(logits - logits.max())
            out.append(tuple(float(x) for x in raised / raised.sum()))
        return out

    return score


SCORES = "positive double, negative double, neutral double"


def score_texts(texts: DataFrame, column: str, scorer: Scorer = lexicon_scores) -> DataFrame:
    """``texts`` with probabilities, and the label of the greatest (``label``)."""

    @F.pandas_udf(SCORES)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(scorer([x or "" for x in batch]), columns=["positive", "negative", "neutral"])

    out = texts.withColumn("_s", scored(F.col(column)))
    out = out.withColumns({c: F.col(f"_s.{c}") for c in ("positive", "negative", "neutral")}).drop("_s")
    return out.withColumn("label", expr.argmax_label(F.col("positive"), F.col("negative"), F.col("neutral")))


def score_documents(docs: DataFrame, key: str, column: str, scorer: Scorer = lexicon_scores, most: int = 400) -> DataFrame:
    """For each document the number of sentences scored, means, the greatest negative and the share of 0.5 and more.

    A document without sentences has 0 of them and nulls. Sentences are rows, so
    a long document is scored by many tasks' batches and summed up before the shuffle.
    """
    all_parts = expr.sentences(F.col(column), most=2_000_000_000)
    parts = docs.select(key, F.slice(all_parts, 1, most).alias("_parts"), (F.size(all_parts) > most).alias("_capped"))
    rows = score_texts(parts.select(key, "_capped", F.explode("_parts").alias("_sentence")), "_sentence", scorer)
    found = rows.groupBy(key).agg(
        F.count("*").cast("int").alias("n_sentences"),
        F.avg("negative").alias("mean_negative"),
        F.max("negative").alias("max_negative"),
        F.avg(F.when(F.col("negative") >= 0.5, 1.0).otherwise(0.0)).alias("risk_density"),
        F.avg("neutral").alias("mean_neutral"),
        F.avg("positive").alias("mean_positive"),
        F.max("_capped").alias("capped"),
    )
    return docs.select(key).join(found, key, "left").withColumn("n_sentences", F.coalesce("n_sentences", F.lit(0)))


def html_text(html: str) -> Column:
    """X04 over a column."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return html_texts(batch)

    return run(html)


def json_object(text: str) -> Column:
    """X12 over a column."""
    return expr.first_json(F.col(text))


def item_1a(html: str) -> Column:
    """The risk section of a report in HTML."""

    @F.arrow_udf("status string, text string, length int, flags array<string>")
    def run(batch: pa.Array) -> pa.Array:
        rows = [risk_section(html_to_text(x)) for x in batch.to_pylist()]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["status", "text", "length", "flags"])

    return run(html)


def unusual(ticker: str, day: str, z: list[float], score: float) -> str:
    """What is unusual about a company-day, by the three features furthest out (one sigma at least, else the furthest)."""
    labels = ["news volume", "negative", "neg-news ratio", "|return|"]
    ranked = sorted(zip(labels, z), key=lambda x: -abs(x[1]))
    parts = [x for x in ranked[:3] if abs(x[1]) >= 1] or ranked[:1]
    named = ", ".join(f"{name} {v:+.1f}σ" for name, v in parts)
    return f"Unusual for {ticker} on {day}: {named}. Anomaly score {score:.3f}."


def sigma_text(ticker: Column, day: Column, z: Column, score: Column) -> Column:
    """X13 over columns."""

    @F.pandas_udf("string")
    def run(ticker: pd.Series, day: pd.Series, z: pd.Series, score: pd.Series) -> pd.Series:
        return pd.Series([unusual(*row) for row in zip(ticker, day, z, score)], dtype=object)

    return run(ticker, day, z, score)


def vocabulary_pieces(text: Column, vocabulary: dict[str, int], most: int = 512) -> Column:
    """X19 over a column: an array of ids."""
    return wordpiece.encoded(text, vocabulary, most)
