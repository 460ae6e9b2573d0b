"""Packing by concatenate and cut: prefix sums over partition token totals, then fixed windows with boundary records.

Pass one tokenizes each partition once and stores, with every document, its token ids, its partition number and the
tokens before it in that partition. The totals of the partitions (one number each) give every partition its global
offset. Pass two adds the offset, cuts the token stream at multiples of the window and writes one boundary record for
each piece. There is no shuffle at all; a document of any length is cut freely and a lost task repeats with equal ids.

Defined cases: a missing text is empty and gives one end-of-document id; repeated documents are packed once for each
row; an empty table gives no piece; extra columns are ignored. The last sequence is shorter than the window and is to be
padded; a window full to the end needs no padding.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import stored

WINDOW, END = 1024, 0
#: The pre-tokenizer's pattern that belongs to this vocabulary (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A function from text to ids. ``.json`` is read by tokenizers; if the same vocabulary lies beside it as ranks, the
    ids are computed from those by tiktoken, which gives equal ids (tested over all blanks and many texts) several times faster.
    A special token that is written out in a text gets its one id, as in tokenizers."""
    if path not in _encoders:
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and not os.path.exists(ranks):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            _encoders[path] = lambda text: t.encode(text, add_special_tokens=False).ids
        else:
            import tiktoken

            special = {}
            if path.endswith(".json"):
                with open(path) as f:
                    special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks if path.endswith(".json") else path, "rb"))}
            coding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={k: v for k, v in table.items() if v not in special.values()}, special_tokens=special)
            _encoders[path] = lambda text: coding.encode(text, allowed_special="all")
    return _encoders[path]


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Stored rows doc_id, n_ids, before (ids before it in its partition), part, ids (little-endian unsigned 16 or 32 bits: ``width`` bytes)."""
    path = vocabulary or default_vocabulary()
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = encoder(path)
        before = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                blobs, counts, starts = [], [], []
                for t in some.column(1):
                    ids = np.array([*encode_one(t.as_py()), END], np.uint32)
                    blobs.append((ids.astype("<u2") if ids.max() < 65536 else ids.astype("<u4")).tobytes())
                    counts.append(len(ids))
                    starts.append(before)
                    before += len(ids)
                yield pa.record_batch([some.column(0), pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n_ids", "before", "ids"])

    coded = d.mapInArrow(encode, "doc_id long, n_ids long, before long, ids binary")
    return stored(coded.withColumn("part", F.spark_partition_id()), "tokens")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    coded = tokenized(docs, doc_id, text, vocabulary)
    totals = coded.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one number a partition
    bases, base = {}, 0
    for r in totals:
        bases[r["part"]] = base
        base += r["n"]
    sent = docs.sparkSession.sparkContext.broadcast(bases)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, n, before, ids, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                first = sent.value[part] + before
                wide = memoryview(np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes())
                at = 0
                while at < n:
                    place = (first + at) % window
                    m = min(window - place, n - at)
                    for column, value in zip(out, (doc, at, m, zlib.crc32(wide[4 * at : 4 * (at + m)]), n, (first + at) // window, place), strict=True):
                        column.append(value)
                    at += m
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=names)

    return coded.select("doc_id", "n_ids", "before", "ids", "part").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
