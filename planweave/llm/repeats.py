"""Removing repeated byte strings by suffix arrays of shards.

Every byte that lies in a string of 400 bytes which also starts anywhere else is removed. The work is cut in shards without losing a match:
a document's windows of 400 bytes are grouped in passages by the least hash of their pieces (see ``anchors``), equal windows have
equal hashes, and the hash of one passage alone, with its piece once in it, cannot belong to a repeated window. The passages of the hashes that are left go
to shards by hash, equal passages once and with the number of their occurrences. A hash whose different passages make more than a shard is
dealt out again: they are cut by the least hash of every window in a second order of the pieces, and equal windows still meet. A shard's suffix and common-prefix arrays come
from external induced sorting (see ``suffixes``): suffixes with a common prefix of 400 make a class, and a class with more than one
occurrence marks all its window starts.

Strings shorter than 400 bytes stay. Whether a document shares such a string with another is told beside this by ``n_shared_marks``, the number of its
marks (see ``anchors``) that other documents have too: above 0 wherever 299 bytes are shared, and often from 150 on.

Defined cases: a null or empty text has no bytes; shorter texts keep all; rows that share an id, and null ids, are separate documents;
other columns are ignored. Texts of any length are cut in pieces of ``PIECE`` bytes, whose windows overlap, while hashing.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.anchors import MARK, WINDOW, parts, passages
from planweave.llm.common import partitions, pinned, released, slices, stored
from planweave.llm.suffixes import suffix_arrays

PIECE = 4 << 20
#: Bytes of passages in a shard, about.
SHARD_BYTES = 4 << 20


def _passages(data: bytes) -> tuple[list[tuple[int, int, int, int, bool]], np.ndarray]:
    """(hash, hash of the bytes, first window start, window starts, whether its own windows may repeat) of all passages of a document, and
    its different marks."""
    found, marks = [], [np.empty(0, np.uint64)]
    for base in range(0, max(len(data) - MARK + 1, 0), PIECE):
        piece = data[base : base + PIECE + WINDOW - 1]
        keys, first, count, inner, here = passages(np.frombuffer(piece, np.uint8))
        marks.append(here)
        for k, a, n, i in zip(keys.view(np.int64).tolist(), first.tolist(), count.tolist(), inner.tolist(), strict=True):
            content = xxhash.xxh3_64_intdigest(piece[a : a + n + WINDOW - 1])
            found.append((k, content - (1 << 64) * (content >> 63), base + a, n, i))
    return found, (marks[1] if len(marks) == 2 else np.unique(np.concatenate(marks))).view(np.int64)


def passage_table(rows: DataFrame) -> DataFrame:
    """uid, key, content, start, starts, inner: all passages of rows (uid, body); and for each document with marks a row of uid and marks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 4 << 20):
            found, owners, marks = [], [], []
            for uid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if text:
                    of_text, here = _passages(text.encode())
                    found += [(uid, *p) for p in of_text]
                    if len(here):
                        owners.append(uid)
                        marks.append(here)
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            kinds = [*[pa.int64()] * 5, pa.bool_()]
            names = ["uid", "key", "content", "start", "starts", "inner", "marks"]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.nulls(len(found), longs)], names)
            ends = np.cumsum([0, *map(len, marks)]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *marks])))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), *(pa.nulls(len(owners), k) for k in kinds[1:]), held], names)

    return rows.mapInArrow(cut, "uid long, key long, content long, start long, starts long, inner boolean, marks array<long>")


def shared_marks(table: DataFrame) -> DataFrame:
    """uid, n_shared_marks: how many different marks of a document are in other documents too, where any is."""
    marks = table.filter("marks IS NOT NULL").select("uid", F.explode("marks").alias("mark"))
    met = marks.groupBy("mark").agg(F.min("uid").alias("a"), F.max("uid").alias("b")).filter("a < b").select("mark")
    return marks.join(met, "mark", "left_semi").groupBy("uid").agg(F.count("*").alias("n_shared_marks"))


def repeated_starts(texts: list[bytes], starts: list[int], weights: list[int], folder: str) -> list[np.ndarray]:
    """For each passage, a flag for each of its window starts: whether the window occurs more than once in all, counting a passage by its
    weight. Equal passages are sorted once."""
    number: dict[bytes, int] = {}
    of = [number.setdefault(t, len(number)) for t in texts]
    first = dict(zip(reversed(of), reversed(starts), strict=True))
    flags = _repeated(list(number), [first[k] for k in range(len(number))], np.bincount(of, weights).astype(np.int64).tolist(), folder)
    return [flags[k] for k in of]


def _repeated(texts: list[bytes], starts: list[int], weights: list[int], folder: str) -> list[np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + np.uint16(2)
    begin = np.cumsum(lengths + 1) - lengths - 1
    symbols[begin + lengths] = 1
    symbols = np.append(symbols, np.uint16(0))
    order, lcp = suffix_arrays(symbols, 258, WINDOW, folder)
    of = np.repeat(np.arange(len(texts)), lengths + 1)
    owned = np.append(np.arange(len(symbols) - 1) - begin[of] < np.array(starts)[of], False)
    weight = np.where(owned, np.append(np.array(weights)[of], 0), 0)
    group = np.cumsum(lcp < WINDOW) - 1
    total = np.bincount(group, weight[order])
    again = np.zeros(len(symbols), bool)
    again[order] = (total >= 2)[group]
    return [again[b : b + n] for b, n in zip(begin.tolist(), starts, strict=True)]


def _runs(flags: np.ndarray) -> np.ndarray:
    """First and end of each run of set flags, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]))).astype(np.int64)


def _covered(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed runs of one document, from the runs of its window starts."""
    edges = [(x["start"] + a, x["start"] + b - 1 + WINDOW) for x in found or [] for a, b in np.frombuffer(x["runs"], np.int64).reshape(-1, 2).tolist()]
    out: list[tuple[int, int]] = []
    for a, b in sorted(edges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _identified(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (uid, body), and where ids are null or repeated a table of (uid, doc_id)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n, known = rows.select(F.count("*"), F.count_distinct("doc_id")).first()
    if n == known:
        return rows.withColumnsRenamed({"doc_id": "uid", "text": "body"}), None
    numbered = stored(rows.withColumn("number", F.monotonically_increasing_id()), "numbered").withColumnRenamed("number", "uid")
    return numbered.select("uid", F.col("text").alias("body")), numbered.select("uid", "doc_id")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes, the removed runs (start and end, in bytes) and n_shared_marks of every document."""
    rows, names = _identified(docs)
    count = partitions(docs.sparkSession)
    noted = stored(passage_table(rows), "passages")
    table = noted.filter("key IS NOT NULL").drop("marks")
    shared = table.groupBy("key").agg(F.count("*").alias("n"), F.max("inner").alias("inner")).filter("n > 1 OR inner").select("key")
    met = table.join(shared, "key", "left_semi")
    contents = pinned(met.groupBy("key", "content").agg(F.min(F.struct("uid", "start", "starts")).alias("at"), F.count("*").alias("weight")))
    size = F.sum(F.col("at.starts") + (WINDOW - 1))
    total = contents.agg(size).first()[0] or 0
    shards = max(1, total // SHARD_BYTES)
    hot = pinned(contents.groupBy("key").agg(size.alias("bytes")).filter(F.col("bytes") > SHARD_BYTES).select("key", F.lit(True).alias("hot")))
    # Held after the join, so that nothing above keeps Spark from splitting the tasks of hot keys.
    flagged = contents.withColumn("hot", F.lit(False)) if hot.isEmpty() else pinned(contents.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    wanted = flagged.select(F.col("at.uid").alias("uid"), F.struct("at.start", "at.starts", "key", "content", "weight", "hot").alias("p")).groupBy("uid").agg(F.collect_list("p").alias("wanted"))
    # Both uses below read one exchange of the texts.
    dealt = rows.filter("uid IS NOT NULL").repartition(count, "uid")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, 4 << 20):
            out: list[list] = [[], [], [], [], [], [], []]
            for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                data = text.encode()
                for p in wanted:
                    body = data[p["start"] : p["start"] + p["starts"] + WINDOW - 1]
                    cuts = [(p["key"], 0, p["starts"])]
                    if p["hot"]:
                        cuts = zip(*(x.tolist() for x in parts(np.frombuffer(body, np.uint8))), strict=True)
                    for key, first, starts in cuts:
                        row = (key % shards, p["key"], p["content"], first, body[first : first + starts + WINDOW - 1], starts, p["weight"])
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            kinds = [*[pa.int64()] * 4, pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["shard", "key", "content", "first", "bytes", "starts", "weight"])

    def sorted_out(shard: pa.Table) -> pa.Table:
        with tempfile.TemporaryDirectory() as folder:  # scratch of this task alone, gone when it ends
            flags = repeated_starts(shard["bytes"].to_pylist(), shard["starts"].to_pylist(), shard["weight"].to_pylist(), folder)
        runs = pa.array([(_runs(f) + a).tobytes() for f, a in zip(flags, shard["first"].to_pylist(), strict=True)], pa.binary())
        released()
        return pa.table({"key": shard["key"], "content": shard["content"], "runs": runs})

    cuts = dealt.join(wanted, "uid").select("body", "wanted").mapInArrow(cut_out, "shard long, key long, content long, first long, bytes binary, starts long, weight long")
    found = cuts.groupBy("shard").applyInArrow(sorted_out, "key long, content long, runs binary").filter("length(runs) > 0")
    spans = met.select("uid", "key", "content", "start").join(found, ["key", "content"]).groupBy("uid").agg(F.collect_list(F.struct("start", "runs")).alias("found"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 4 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data, cuts = (text or "").encode(), _covered(found)
                kept, at = hashlib.sha256(), 0
                for a, b in cuts:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                lost = sum(b - a for a, b in cuts)
                row = (len(data), lost, len(cuts), kept.hexdigest(), len(data) - lost, [{"start": a, "end": b} for a, b in cuts])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "removed"])

    schema = "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes long, removed array<struct<start:long,end:long>>"
    done = dealt.join(spans, "uid", "left").select("uid", "body", "found").mapInArrow(removed, schema)
    done = done.join(shared_marks(noted), "uid", "left").withColumn("n_shared_marks", F.coalesce("n_shared_marks", F.lit(0)))
    if names is not None:
        return done.join(names, "uid").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "removed", "n_shared_marks")
    return done.withColumnRenamed("uid", "doc_id")
