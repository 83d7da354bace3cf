"""Exact Jaccard join of word-shingle sets by prefix trees, and the groups that its links make.

Two documents link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. The join runs in four steps, each exact:

1. Shared counts. A partner holds at least 0.8 of a document's shingles, so a document of which fewer occur anywhere else has none.
   Shingles are dealt by hash, in arrays by block of documents, and each block learns how many shingles of its documents are shared. A
   shingle that a block has more than once goes out once, so that no shingle gathers more entries than there are blocks. Equal sets are
   then one set, and the counting is done again among the sets left.
2. Prefixes. Shingles get a global order by the number of documents that have them. Linked sets have a shingle in common among the
   rarest fifth (and one) of each, so sets without a common prefix shingle never link. Chains of common prefix shingles make clusters.
3. Prefix trees. The sets of a cluster, commonest shingle first, are stored in a tree of shared runs. A set walks the tree with the
   overlap so far; a branch is left when neither what remains of the set nor the longest set below can make the overlap large enough, or
   when all sets below already hang together with it. A large cluster is cut in blocks, which meet through common hubs; what is not in its
   largest group then is held against every block.
4. Components of all links.

Shingles are compared by 64-bit hashes in step 1, and by count and 44 bits of the hash within a cluster.

Defined cases: null and empty texts have no shingle and no link; equal sets link; rows that share an id are one node; a null id has a
null component; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.common import partitions, pinned, released, slices, stored, text_bytes, views
from planweave.llm.components import connected
from planweave.llm.shingles import shingle_sets

SIZE = 5
#: Similarity as a fraction: linked when DENOMINATOR * overlap >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 80, 100
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 4096
#: Buckets of shingles for each partition, at least: partitions, to which buckets are hashed, then come out even. And bytes of text whose
#: shingles a bucket holds, at most: a bucket's memory does not grow with the input.
BUCKETS_A_PARTITION, BUCKET_BYTES = 8, 2 << 20
#: Sets in a block of a large cluster, and about as many in a task of small clusters.
CLUSTER_BLOCK = 512
#: Sets that every block of a large cluster has beside its own.
HUBS = 4
_SHARED_LOCALLY = 0xFFFF
_LOW44 = np.uint64((1 << 44) - 1)


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that any partner of a set of n has in common with it, at least."""
    return -(-n * NUMERATOR // DENOMINATOR)


def buckets_for(spark: SparkSession, size: int) -> int:
    """Buckets for the shingles of ``size`` bytes of text."""
    return max(BUCKETS_A_PARTITION * partitions(spark), -(-size // BUCKET_BYTES))


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _blobs(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


_PARTS = ["bucket", "block", "ids", "sizes", "marks", "tokens", "places"]
_PART_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_PART_SCHEMA = "bucket int, block long, ids binary, sizes binary, marks binary, tokens binary, places binary"


def shared_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n (shingles), mark (digest of the set), shared (shingles that occur in another row) for rows (doc_id, text)."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, BLOCK_BYTES, BLOCK_ROWS):
            sets = shingle_sets(part.column(1).to_pylist(), SIZE)
            sizes = np.array([len(s) for s in sets], np.int64)
            ids = np.array([-1 if i is None else i for i in part.column(0).to_pylist()], np.int64)
            marks = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            tokens, places = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, places = tokens[order], places[order]
            fresh = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, bool)
            alone = fresh & np.concatenate([fresh[1:], [True]]) if len(tokens) else fresh
            here = np.bincount(places[~alone], minlength=len(sets)).astype(np.int64)
            block = int.from_bytes(hashlib.blake2b(ids.tobytes() + marks, digest_size=8).digest(), "little", signed=True)
            null = np.array([i is None for i in part.column(0).to_pylist()], np.uint8)
            rows = [(block % buckets, block, ids.tobytes() + null.tobytes(), sizes.tobytes(), marks, here.tobytes(), None)]
            sent, place = tokens[fresh], np.where(alone, places, _SHARED_LOCALLY)[fresh].astype(np.uint16)
            cuts = np.searchsorted(_bucket(sent, buckets), np.arange(buckets + 1))
            low = (sent & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    own = slice(cuts[b], cuts[b + 1])
                    rows.append((b, block, None, None, None, low[own].tobytes(), place[own].tobytes()))
            yield _blobs(rows, _PARTS, _PART_KINDS)

    def counted(group: pa.Table) -> pa.Table:
        heads = group.filter(pc.is_valid(group["ids"]))
        body = group.filter(pc.is_null(group["ids"]))
        blocks = body["block"].to_pylist()
        tokens, places = views(body["tokens"], np.uint32), views(body["places"], np.uint16)
        rows = list(zip(heads["block"].to_pylist(), heads["ids"].to_pylist(), heads["sizes"].to_pylist(), heads["marks"].to_pylist(), heads["tokens"].to_pylist(), [None] * len(heads), strict=True))
        if blocks:
            every = np.concatenate(tokens)
            row = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(t) for t in tokens])
            order = np.argsort(every, kind="stable")
            every = every[order]
            same = every[1:] == every[:-1]
            hit = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            place = np.concatenate(places)[hit].astype(np.int64)
            real = place != _SHARED_LOCALLY
            pair, n = np.unique(row[hit][real].astype(np.int64) * (1 << 16) + place[real], return_counts=True)
            cuts = np.searchsorted(pair, np.arange(len(blocks) + 1) << 16)
            for k, block in enumerate(blocks):
                if cuts[k] < cuts[k + 1]:
                    own = slice(cuts[k], cuts[k + 1])
                    rows.append((block, None, None, None, (pair[own] & 0xFFFF).astype(np.uint16).tobytes(), n[own].astype(np.uint32).tobytes()))
        released()
        return pa.Table.from_batches([_blobs(rows, ["block", "ids", "sizes", "marks", "at", "n"], [pa.int64(), *[pa.binary()] * 5])])

    def summed(group: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        heads = group.filter(pc.is_valid(group["ids"]))
        body = group.filter(pc.is_null(group["ids"]))
        # A block that comes twice has the same rows twice: each of its sets is then shared.
        twice = len(heads) > 1
        for ids, sizes, marks, here in zip(views(heads["ids"], np.uint8), views(heads["sizes"], np.int64), views(heads["marks"], np.uint8), views(heads["at"], np.int64), strict=True):
            total = sizes.copy() if twice else here.copy()
            if not twice:
                for at, n in zip(views(body["at"], np.uint16), views(body["n"], np.uint32), strict=True):
                    total[at] += n
            null = ids[8 * len(sizes) :].astype(bool)
            mark = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sizes), [None, pa.py_buffer(marks.tobytes())]).cast(pa.binary())
            out.append(pa.RecordBatch.from_arrays([pa.array(ids[: 8 * len(sizes)].view(np.int64), mask=null), pa.array(sizes), mark, pa.array(total)], ["doc_id", "n", "mark", "shared"]))
        released()
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("shared", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    by_bucket = rows.mapInArrow(dealt, _PART_SCHEMA).groupBy("bucket").applyInArrow(counted, "block long, ids binary, sizes binary, marks binary, at binary, n binary")
    return by_bucket.groupBy("block").applyInArrow(summed, "doc_id long, n long, mark binary, shared long")


def set_blocks(docs: DataFrame) -> DataFrame:
    """block, ids, sizes, tokens: the sets of blocks of rows (doc_id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, BLOCK_BYTES, BLOCK_ROWS):
            sets = shingle_sets(part.column(1).to_pylist(), SIZE)
            ids = np.array(part.column(0).to_pylist(), np.int64)
            tokens = np.concatenate(sets)
            block = int.from_bytes(hashlib.blake2b(ids.tobytes() + tokens.tobytes(), digest_size=8).digest(), "little", signed=True)
            yield _blobs([(block, ids.tobytes(), np.array([len(s) for s in sets], np.int64).tobytes(), tokens.tobytes())], ["block", "ids", "sizes", "tokens"], [pa.int64(), *[pa.binary()] * 3])

    return docs.mapInArrow(made, "block long, ids binary, sizes binary, tokens binary")


def ordered_sets(blocks: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n, tokens, prefix for every set: its shingles as numbers whose order is the global one, commonest first, and those of its
    prefix that another set has. A number is the complement of the count of sets, then 44 bits of the hash."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own in zip(batch.column(0).to_pylist(), views(pa.chunked_array([batch.column(1)]), np.uint64), strict=True):
                tokens, n = np.unique(own, return_counts=True)
                cuts = np.searchsorted(_bucket(tokens, buckets), np.arange(buckets + 1))
                rows = [(b, block, tokens[cuts[b] : cuts[b + 1]].tobytes(), n[cuts[b] : cuts[b + 1]].astype(np.uint32).tobytes()) for b in range(buckets) if cuts[b] < cuts[b + 1]]
                if rows:
                    yield _blobs(rows, ["bucket", "block", "tokens", "n"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])
        released()

    def counted(group: pa.Table) -> pa.Table:
        tokens = views(group["tokens"], np.uint64)
        n = np.concatenate(views(group["n"], np.uint32))
        _, place = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(place, n).astype(np.uint32)[place]
        cuts = np.cumsum([0, *map(len, tokens)])
        rows = [(block, b, total[cuts[k] : cuts[k + 1]].tobytes()) for k, (block, b) in enumerate(zip(group["block"].to_pylist(), group["bucket"].to_pylist(), strict=True))]
        released()
        return pa.Table.from_batches([_blobs(rows, ["block", "bucket", "n"], [pa.int64(), pa.int32(), pa.binary()])])

    def joined(sets: pa.Table, counts: pa.Table) -> pa.Table:
        found = []
        by_bucket = dict(zip(counts["bucket"].to_pylist(), views(counts["n"], np.uint32), strict=True))
        total = np.concatenate([np.empty(0, np.uint32), *(by_bucket[b] for b in sorted(by_bucket))])
        # A block that comes twice has the same sets twice; one copy is enough.
        for ids, sizes, tokens in list(zip(*(views(sets[c], k) for c, k in (("ids", np.int64), ("sizes", np.int64), ("tokens", np.uint64))), strict=True))[:1]:
            _, place = np.unique(tokens, return_inverse=True)
            n = total[place].astype(np.uint64)
            keys = ((np.uint64(0xFFFFF) - np.minimum(n, np.uint64(0xFFFFF))) << np.uint64(44)) | (tokens & _LOW44)
            at = 0
            for doc_id, size in zip(ids.tolist(), sizes.tolist(), strict=True):
                own = np.sort(keys[at : at + size])
                at += size
                rarest = own[least_overlap(size) - 1 :]  # n - least + 1 of the end
                found.append((doc_id, size, own.tobytes(), rarest[(rarest >> np.uint64(44)) < 0xFFFFE].view(np.int64).tolist()))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        released()
        return pa.Table.from_batches([_blobs(found, ["doc_id", "n", "tokens", "prefix"], kinds)])

    counts = blocks.select("block", "tokens").mapInArrow(dealt, "bucket int, block long, tokens binary, n binary").groupBy("bucket").applyInArrow(counted, "block long, bucket int, n binary")
    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(joined, "doc_id long, n long, tokens binary, prefix array<long>")


class _Branch:
    """A run of shingles that all sets below share. ``low`` and ``high`` bound their sizes; ``member`` is one of them, ``one`` tells that
    all were in one group when last looked at."""

    __slots__ = ("run", "below", "ends", "low", "high", "member", "one")

    def __init__(self, run: list[int], size: int, member: int):
        self.run, self.below, self.ends = run, {}, []
        self.low = self.high = size
        self.member, self.one = member, True


class PrefixTree:
    """Sets in a global order, and links found among them while they are added."""

    def __init__(self) -> None:
        self.top = _Branch([], 1 << 60, -1)
        self.top.high = 0
        self.group: list[int] = []
        self.sizes: list[int] = []
        self.links: list[tuple[int, int]] = []
        self.first: dict[int, int] = {}  # a set of each known group

    def find(self, x: int) -> int:
        while self.group[x] != x:
            self.group[x] = self.group[self.group[x]]
            x = self.group[x]
        return x

    def add(self, ranks: list[int], known: int | None = None) -> None:
        """Link a set with all sets in the tree that are not yet in its group, and store it. A set joins the sets of its ``known`` group at once."""
        own, n = len(self.group), len(ranks)
        fellow = own if known is None else self.first.setdefault(known, own)
        self.group.append(own if fellow == own else self.find(fellow))
        self.sizes.append(n)
        self._search(own, ranks)
        self._store(own, ranks)

    def _search(self, own: int, ranks: list[int]) -> None:
        n, held = len(ranks), frozenset(ranks)
        smallest, largest = -(-n * NUMERATOR // DENOMINATOR), n * DENOMINATOR // NUMERATOR
        stack = [(b, 0, 0) for b in self.top.below.values()]
        while stack:
            branch, overlap, depth = stack.pop()
            if branch.high < smallest or branch.low > largest or (branch.one and self.find(branch.member) == self.find(own)):
                continue
            overlap += len(held.intersection(branch.run))
            depth += len(branch.run)
            least = -(-(n + max(branch.low, smallest)) * NUMERATOR // (NUMERATOR + DENOMINATOR))
            if overlap + min(branch.high - depth, n - bisect_right(ranks, branch.run[-1])) < least:
                continue
            for other in branch.ends:
                if DENOMINATOR * overlap >= NUMERATOR * (n + self.sizes[other] - overlap) and (a := self.find(own)) != (b := self.find(other)):
                    self.links.append((own, other))
                    self.group[max(a, b)] = min(a, b)
            stack += [(b, overlap, depth) for b in branch.below.values()]

    def _store(self, own: int, ranks: list[int]) -> None:
        node, at, n = self.top, 0, len(ranks)
        while True:
            if at == n:
                node.ends.append(own)
                return
            branch = node.below.get(ranks[at])
            if branch is None:
                made = _Branch(ranks[at:], n, own)
                made.ends.append(own)
                node.below[ranks[at]] = made
                return
            run, k, most = branch.run, 0, min(len(branch.run), n - at)
            while k < most and run[k] == ranks[at + k]:
                k += 1
            if k < len(run):
                upper = _Branch(run[:k], branch.low, branch.member)
                upper.high, upper.one = branch.high, branch.one
                branch.run = run[k:]
                upper.below[run[k]] = branch
                node.below[run[0]] = branch = upper
            branch.low, branch.high = min(branch.low, n), max(branch.high, n)
            branch.one = branch.one and self.find(branch.member) == self.find(own)
            node, at = branch, at + k


def tree_links(ids: list[int], sets: list[np.ndarray], known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among sets of ordered numbers that join all of them that hang together. Sets of one ``known`` group hang together already."""
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    tree, at = PrefixTree(), 0
    for k, s in enumerate(sets):
        tree.add(place[at : at + len(s)].tolist(), None if known is None else known[k])
        at += len(s)
    return [(ids[a], ids[b]) for a, b in tree.links]


def _joined(group: pa.Table) -> pa.Table:
    """Links in the clusters of one task: a tree for each cluster, small sets first."""
    own: dict[int, dict[tuple[int, bytes], tuple[int, int, np.ndarray]]] = {}
    for c, i, t, k in zip(group["component"].to_pylist(), group["doc_id"].to_pylist(), views(group["tokens"], np.uint64), group["known"].to_pylist(), strict=True):
        own.setdefault(c, {})[i, hashlib.blake2b(t, digest_size=16).digest()] = (i, i if k is None else k, t)  # rows of one id may have different sets
    found = []
    for rows in own.values():
        if len(rows) > 1:
            ids, known, sets = zip(*sorted(rows.values(), key=lambda r: (len(r[2]), r[0])), strict=True)
            found += tree_links(list(ids), list(sets), list(known))
    released()
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


_LINKS = "a long, b long"


def links(sets: DataFrame) -> DataFrame:
    """a, b: links between different sets (doc_id, n, tokens, prefix) that make the same components as all links do.

    A cluster of up to ``CLUSTER_BLOCK`` sets gets one tree. A larger one is dealt to blocks, each with the cluster's hubs beside its own sets,
    so that a large group of near copies comes together through the hubs. Only sets outside the cluster's largest group so far are then
    held against all others, block by block.
    """
    postings = sets.select("doc_id", F.explode("prefix").alias("token"))
    least = postings.groupBy("token").agg(F.min("doc_id").alias("b"), F.count("*").alias("sets")).filter("sets > 1").drop("sets")
    chained = postings.join(least, "token").select(F.col("doc_id").alias("a"), "b").filter("a <> b").distinct()
    clusters = pinned(connected(chained))
    hubs = [F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node"))["node"] for k in range(HUBS)]
    sized = pinned(clusters.groupBy("component").agg(F.count("*").alias("sets"), F.array(*hubs).alias("hubs")).withColumn("blocks", F.ceil(F.col("sets") / CLUSTER_BLOCK).cast("int")))
    tasks = max(1, (sized.filter("blocks = 1").agg(F.sum("sets")).first()[0] or 0) // CLUSTER_BLOCK)
    members = clusters.join(sized.drop("hubs", "sets"), "component").select(F.col("node").alias("doc_id"), "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"))
    small = F.col("blocks") == 1
    placed = members.select("doc_id", "component", F.when(small, -1 - F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.col("component")).alias("task"), "i")
    beside = sized.filter("blocks > 1").select(F.explode("hubs").alias("doc_id"), "component", F.col("component").alias("task"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    tokens, unknown = sets.select("doc_id", "tokens"), F.lit(None).cast("long").alias("known")
    first = tokens.join(placed.unionByName(beside).distinct(), "doc_id").withColumn("known", unknown).groupBy("task", "i").applyInArrow(_joined, _LINKS)
    if sized.filter("blocks > 1").isEmpty():
        return first
    first = pinned(first)
    groups = connected(first).select(F.col("node").alias("doc_id"), F.col("component").alias("known"))
    large = pinned(members.filter("blocks > 1").join(groups, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id")))
    most = large.groupBy("component", "known").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("in"))
    most = most.withColumn("parts", F.ceil((F.col("all") - F.col("in")) / CLUSTER_BLOCK).cast("int")).filter("parts > 0")
    paired = large.join(most.select("component", "main", "parts"), "component")
    every = paired.select("doc_id", "component", "known", "i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    outside = paired.filter("known <> main").select("doc_id", "component", "known", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("j"))
    return first.unionByName(tokens.join(every.unionByName(outside).distinct(), "doc_id").groupBy("component", "i", "j").applyInArrow(_joined, _LINKS))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = buckets_for(docs.sparkSession, text_bytes(rows))
    counted = pinned(shared_counts(rows, buckets))
    able = counted.filter(f"doc_id IS NOT NULL AND n > 0 AND {DENOMINATOR} * shared >= {NUMERATOR} * n")
    # Held, so that the join below has plain exchanges on both sides and Spark can split a set that very many documents have.
    first = pinned(able.groupBy("mark").agg(F.min("doc_id").alias("rep")))
    copies = pinned(able.join(first, "mark").select("doc_id", "rep").distinct())
    reps = copies.select(F.col("rep").alias("doc_id")).distinct()
    texts = stored(rows.join(reps, "doc_id", "left_semi"), "reps")
    again = shared_counts(texts, buckets).filter(f"{DENOMINATOR} * shared >= {NUMERATOR} * n").select("doc_id").distinct()
    sets = stored(ordered_sets(stored(set_blocks(texts.join(again, "doc_id", "left_semi")), "blocks"), buckets).filter("size(prefix) > 0"), "sets")
    groups = connected(links(sets).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    groups = groups.select(F.col("node").alias("doc_id"), "component")
    return counted.join(groups, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
