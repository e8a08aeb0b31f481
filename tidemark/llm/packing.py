"""Packing: concatenate and cut.

Pass one tokenises each partition and notes where every document starts inside
it; the result is a written table, so pass two reads committed rows. Prefix sums
over the token totals of partitions (one row for each partition) turn those
starts into global offsets, and fixed windows cut the stream. Only the last
sequence has padding. A boundary record (a piece) says which ids of a document
lie where in which sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, written

#: Chunks without white space that a worker keeps with their ids, in each of two generations; some 200 bytes each.
CACHE_CHUNKS = 400_000
CACHE_BYTES = 40
_TAIL = b".,;:!?"


class _Chunks(dict):
    """Ids (little-endian 32 bits) of a chunk of text that has no ASCII white space.

    The tokenizer drops white space and no token spans it, so the ids of a text
    are the ids of its chunks, one after another. Marks after a letter or digit
    are tokens of their own, so a chunk with marks at its end is looked up
    without them. When a generation is full the one before it is dropped.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        packed = self.old.get(chunk)
        if packed is None:
            core = chunk.rstrip(_TAIL)
            if core and len(core) < len(chunk) and core.isalnum():
                packed = self[core] + self[chunk[len(core) :]]
            else:
                ids = self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
                packed = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(chunk) <= CACHE_BYTES:
            if len(self) >= CACHE_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = packed
        return packed


def _chunks(path: str) -> _Chunks:
    """The cache of this worker process: it outlives tasks, and functions sent anew with each."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_tidemark_chunks", {})
    if path not in kept:
        kept[path] = _Chunks(path)
    return kept[path]


def token_bytes(raw: bytes, chunks: _Chunks) -> bytes:
    # All is lower-cased anyway, but for special tokens, and after letters and marks (U+0300 to U+037F) are joined.
    if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
        raw = raw.lower()
    return b"".join(map(chunks.__getitem__, raw.split()))


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, part, local_start, n, ids)``: ids as bytes, closed by ``end_id``, a null text as an empty one."""
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunks, part, at = _chunks(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [token_bytes(raw or b"", chunks) + end for raw in batch.column(1).to_pylist()]
            starts = []
            for x in ids:
                starts.append(at)
                at += len(x) // 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "part", "local_start", "n", "ids"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return narrow.mapInArrow(run, "doc_id long, part int, local_start long, n long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document in a sequence of ``length`` tokens.

    Null and empty texts are the one id ``end_id``. Repeated rows are packed as
    often as they occur. Documents follow each other as partitions deliver
    them. An empty table gives no rows; other columns are ignored. With
    ``keep_ids`` the ids of the piece come along as bytes.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    ids = written(tokenise(docs, tokenizer, end_id, id_col, text_col))
    sums = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    # a row for each partition of pass one: as small as the list of its tasks
    offsets = ids.groupBy("part").agg(F.sum("n").alias("_n")).select(
        F.col("part").alias("_part"), (F.sum("_n").over(sums) - F.col("_n")).alias("_before")
    )
    placed = ids.join(F.broadcast(offsets), F.col("part") == F.col("_part")).withColumn(
        "_start", F.col("_before") + F.col("local_start")
    )
    div = lambda x: F.call_function("div", x, F.lit(length).cast("long"))
    pieces = placed.withColumn(
        "sequence_id", F.explode(F.sequence(div(F.col("_start")), div(F.col("_start") + F.col("n") - 1)))
    )
    begin = F.greatest(F.col("sequence_id") * length, F.col("_start"))
    finish = F.least((F.col("sequence_id") + 1) * length, F.col("_start") + F.col("n"))
    pieces = pieces.withColumn("start", begin - F.col("_start")).withColumn("length", finish - begin)
    piece = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    columns = [
        F.col("doc_id"),
        F.col("start"),
        F.col("length"),
        F.crc32(piece).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        F.col("sequence_id"),
        (F.col("_start") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
    ]
    return pieces.select(*columns, *([piece.alias("ids")] if keep_ids else []))
