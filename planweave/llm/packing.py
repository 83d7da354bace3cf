"""Packing documents into fixed windows by best-fit decreasing.

A document's tokens (its ids and one closing id) are first cut into full windows; what is left of it, one piece shorter than a window at
most, goes to the tightest open window that still holds it, longest pieces first. Pieces of one length are interchangeable, so the
decision is made on the histogram of lengths: at most ``window`` numbers reach the driver however many documents there are. The
plan that comes back says, for the r-th piece of a length, which sequence and offset it takes, and is joined to the pieces by rank.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed as often as they occur; an empty table gives no
piece; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import pinned, slices

WINDOW = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Rank is counted in blocks of about so many pieces.
RANK_BLOCK = 8192


class CapacityTree:
    """A segment tree over remaining capacities 0..top that finds the smallest capacity, at least as large as asked, with an open window."""

    def __init__(self, top: int):
        self.leaves = 1
        while self.leaves <= top:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, windows: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += windows
            node //= 2

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, pieces, pieces a window, first sequence, first offset) for all pieces of a histogram of lengths.

    Equal to placing the pieces one by one, longest first, each in the open window with the least room that is enough: while pieces of
    one length are placed, a window that took one stays the tightest until it can take no more.
    """
    tree, groups = CapacityTree(window), {}
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left > 0:
            room = tree.tightest(length)
            if room is None:
                room, per = window, window // length
                count = -(-left // per)
                first, sequences = sequences, sequences + count
            else:
                per = room // length
                first, count = groups[room].pop()
                tree.add(room, -count)
            whole = min(count, left // per)
            for windows, pieces in ((whole, per), (1 if whole < count and left - whole * per > 0 else 0, left - whole * per)):
                if windows and pieces:
                    slots.append((length, rank, windows * pieces, pieces, first, window - room))
                    rank, left = rank + windows * pieces, left - windows * pieces
                    rest = room - pieces * length
                    groups.setdefault(rest, []).append((first, windows))
                    tree.add(rest, windows)
                    first, count = first + windows, count - windows
            if count:
                groups.setdefault(room, []).append((first, count))
                tree.add(room, count)
    return slots


@lru_cache(maxsize=2)
def _encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizer file. Merges of such a file are in the order of their ids, so ids serve as ranks."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if all(c in byte_of for c in piece) and piece not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text and the closing id 0. Same ids as the ``tokenizers`` library gives for the file with its default settings: a string of
    the file's added tokens is one id."""
    ids = _encoder(path).encode(text or "", allowed_special="all")
    ids.append(0)
    return np.array(ids, "<u4")


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece: full windows of a document and what is left."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 4 << 20):
            out: list[list[int | None]] = [[], [], [], [], []]
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = token_ids(text, path)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    for column, value in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = docs.sparkSession
    cut = pinned(pieces(docs, tokenizer, window))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    blocks = max(1, sum(histogram.values()) // RANK_BLOCK)
    rows = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    counts = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("local", F.row_number().over(inner) - 1).join(base, ["length", "block"]).withColumn("rank", F.col("base") + F.col("local"))
    slots = spark.createDataFrame(best_fit_decreasing(histogram, window), "length long, first_rank long, pieces long, per long, first_sequence long, first_offset long")
    found = ranked.join(F.broadcast(slots), "length").filter((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("pieces")))
    nth = F.col("rank") - F.col("first_rank")
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )
