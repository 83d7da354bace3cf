"""Scores of documents by masked pseudo-likelihood.

A window network reads two words on either side of a place and predicts the class of the word that stands there; exact counts of all other
documents tell which word of the class it is, and which words stand next to each other. The sum over all places of log P(word | both sides)
scores the document. With n the counts of words, of words in class c, and of neighbours, all without the scored document itself,

    base(w)  = P_network(class of w | sides) (n(w) + NEW) / (n(c) + NEW * words of c)
    left(w)  = (n(l, w) + PRIOR base(w)) / (n(l, any) + PRIOR), and right(w) in the same way; beyond a document's end, base(w)
    P(w)     = (left(w) + right(w)) / 2

which sums to one over all words of the corpus. For the network, words are dealt by hash to 65,536 forms: the most frequent forms are
classes of their own, the others share classes by hash. Its size is fixed. The tables of words and of neighbours hold exact words (63
bits of their hash) and grow with the corpus: documents are held in blocks, the keys of a block go to buckets by hash, where they are
counted over all blocks, and the totals go back to the blocks.

The network learns from all documents: counts by one pass, then, in numpy, one pass of stochastic gradients over every
token of every partition, all from one start, with sampled negative classes; the partitions' weights are averaged by tokens, in a tree, so
that no task receives the models of more than ``FAN`` partitions. Scores use the full sum over classes.
The partitions of the input decide which tokens are trained on together, so weights differ slightly with the layout of the table.

Defined cases: a text without words (null, empty, blank) has no tokens, score 0 and no mean; repeated rows score the same; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import partitions, released, slices, stored, views
from planweave.llm.shingles import BASE, mixed, words

FORMS, FREQUENT, SHARED = 1 << 16, 192, 64
CLASSES = FREQUENT + SHARED
SIDES = (-2, -1, 1, 2)
HIDDEN, BATCH, NEGATIVES, RATE = 24, 4096, 48, 0.1
CHUNKS, FAN = 16, 64
#: Weight of the network's word against counts of neighbours, and the count of a word that no other document has.
PRIOR, NEW = 20.0, 0.5
#: Bytes of text in a block, and in all blocks for each bucket of keys.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
_ROWS = "chunk int, part int, weight double, data binary"


def forms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Form of every word of all texts, and the document of each."""
    hashes, first = words(texts)
    return (hashes >> np.uint64(48)).astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(first))


class Vocabulary:
    """Classes of forms, and log shares of forms in their classes, from counts."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.of = (FREQUENT + np.arange(FORMS) % SHARED).astype(np.int64)
        self.of[order[:FREQUENT]] = np.arange(FREQUENT)
        smooth = counts + 0.5
        total = np.bincount(self.of, smooth, CLASSES)
        self.log_share = np.log(smooth / total[self.of])
        self.unigram = total / total.sum()


class Network:
    """Sum of one vector for each neighbour by side, tanh, and a softmax over classes. ``values`` holds all weights in one array."""

    SIZES = ((len(SIDES), CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))

    def __init__(self, values: np.ndarray | None = None, unigram: np.ndarray | None = None):
        counts = [int(np.prod(s)) for s in self.SIZES]
        if values is None:
            rng = np.random.default_rng(5)
            values = (rng.standard_normal(sum(counts)) * 0.2).astype(np.float32)
            values[-CLASSES:] = np.log(unigram + 1e-9)
        self.values = values
        edges = np.cumsum([0, *counts])
        self.sides, self.bias, self.out, self.base = (values[a:b].reshape(s) for a, b, s in zip(edges[:-1], edges[1:], self.SIZES, strict=True))

    def hidden(self, near: np.ndarray) -> np.ndarray:
        total = self.bias + self.sides[0][near[0]]
        for k in range(1, len(SIDES)):
            total += self.sides[k][near[k]]
        return np.tanh(total, out=total)

    def log_probability(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        logits = self.hidden(near) @ self.out
        logits += self.base
        own = logits[np.arange(len(target)), target].astype(np.float64)
        top = logits.max(axis=1, keepdims=True)
        logits -= top
        np.exp(logits, out=logits)
        return own - top[:, 0] - np.log(logits.sum(axis=1, dtype=np.float64))

    def step(self, near: np.ndarray, target: np.ndarray, drawn: np.ndarray, unigram: np.ndarray, squares: np.ndarray) -> None:
        """One gradient step by importance-weighted sampled softmax, with step sizes from the squares of past gradients."""
        h = self.hidden(near)
        n = len(target)
        own = np.einsum("nh,nh->n", h, self.out.T[target]) + self.base[target] - np.log(unigram[target])
        rest = h @ self.out[:, drawn] + (self.base - np.log(unigram))[drawn]
        rest[drawn[None, :] == target[:, None]] = -1e9
        rest += np.float32(-np.log(len(drawn)))
        top = np.maximum(own, rest.max(axis=1))
        own_p, rest_p = np.exp(own - top), np.exp(rest - top[:, None])
        total = own_p + rest_p.sum(axis=1)
        own_g = (own_p / total - 1).astype(np.float32) / n
        rest_g = (rest_p / total[:, None]).astype(np.float32) / n
        gradient = np.zeros_like(self.values)
        g = Network(gradient)
        back = own_g[:, None] * self.out.T[target] + rest_g @ self.out[:, drawn].T
        np.add.at(g.out.T, drawn, (h.T @ rest_g).T)
        cells = target[:, None] * HIDDEN + np.arange(HIDDEN)
        g.out += np.bincount(cells.ravel(), (own_g[:, None] * h).ravel(), CLASSES * HIDDEN).reshape(CLASSES, HIDDEN).T
        np.add.at(g.base, drawn, rest_g.sum(axis=0))
        g.base += np.bincount(target, own_g, CLASSES)
        back *= 1 - h * h
        g.bias += back.sum(axis=0)
        flat = back.ravel()
        for k in range(len(SIDES)):
            g.sides[k] += np.bincount((near[k][:, None] * HIDDEN + np.arange(HIDDEN)).ravel(), flat, (CLASSES + 1) * HIDDEN).reshape(-1, HIDDEN)
        squares += gradient * gradient
        self.values -= RATE * gradient / (np.sqrt(squares) + 1e-8)


def neighbours(classes: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Class at each side of every place; beyond a document's ends the extra class."""
    place = np.arange(len(classes)) + 2 * (document + 1)
    padded = np.full(len(classes) + 2 * (int(document[-1]) + 2) if len(document) else 4, CLASSES, np.int64)
    padded[place] = classes
    return np.stack([padded[place + k] for k in SIDES])


def _chunks(values: np.ndarray, weight: float) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    pieces = [p.astype(np.float64).tobytes() for p in np.array_split(values, CHUNKS)]
    return pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int32()), pa.array([weight] * CHUNKS), pa.array(pieces, pa.binary())], ["chunk", "part", "weight", "data"])


def _added(rows: DataFrame, parts: int) -> tuple[np.ndarray, float]:
    """Weighted sum of the arrays of ``parts`` partitions, and the sum of weights. A tree: no task adds more than ``FAN`` arrays; CHUNKS
    rows reach the driver."""

    def add(group: pa.Table) -> pa.Table:
        total: np.ndarray | float = 0.0
        for data in views(group["data"], np.float64):
            total = total + data
        weight = float(sum(group["weight"].to_pylist()))
        return pa.table({"chunk": pa.array([group["chunk"][0].as_py()], pa.int32()), "part": pa.array([group["part"][0].as_py()], pa.int32()), "weight": [weight], "data": pa.array([np.asarray(total).tobytes()], pa.binary())})

    while True:
        parts = -(-parts // FAN)
        nearer = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        rows = nearer.groupBy("chunk", "part").applyInArrow(add, _ROWS)
        if parts <= 1:
            break
    found = sorted(rows.collect(), key=lambda r: r["chunk"])
    return (np.concatenate([np.frombuffer(r["data"], np.float64) for r in found]), found[0]["weight"]) if found else (np.empty(0), 0.0)


def learn(docs: DataFrame) -> tuple[Vocabulary, Network]:
    texts = docs.select(F.col("text").cast("string").alias("text"))
    parts = texts.rdd.getNumPartitions()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FORMS, np.int64)
        for part in slices(batches, 0, 2 << 20):
            total += np.bincount(forms(part.column(0).to_pylist())[0], minlength=FORMS)
        yield _chunks(total, 1.0)

    counts, _ = _added(texts.mapInArrow(count, _ROWS), parts)
    vocabulary = Vocabulary(counts if len(counts) else np.zeros(FORMS))
    start = Network(unigram=vocabulary.unigram).values
    of, unigram = vocabulary.of, vocabulary.unigram

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, squares, seen = Network(start.copy()), np.full_like(start, 1e-6), 0
        rng = np.random.default_rng(17)
        for part in slices(batches, 0, 2 << 20):
            form, document = forms(part.column(0).to_pylist())
            if not len(form):
                continue
            classes = of[form]
            near = neighbours(classes, document)
            for a in range(0, len(classes), BATCH):
                drawn = rng.choice(CLASSES, NEGATIVES, p=unigram)
                network.step(near[:, a : a + BATCH], classes[a : a + BATCH], drawn, unigram, squares)
            seen += len(classes)
        if seen:
            yield _chunks(network.values * float(seen), float(seen))

    values, weight = _added(texts.mapInArrow(train, _ROWS), parts)
    return vocabulary, Network((values / weight).astype(np.float32) if weight else start)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys as they first come, and for every key the number of its own."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _packed(values: np.ndarray) -> bytes:
    """Compressed, after its length in 8 bytes: most counts are small."""
    data = values.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), kind)


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word; a few texts at a time, which takes less memory."""
    found, a, held = [], 0, 0
    for b, text in enumerate(texts, 1):
        held += len(text or "")
        if held > 1 << 18 or b == len(texts):
            hashes, first = words(texts[a:b])
            found.append((hashes, np.repeat(np.arange(a, b), np.diff(first))))
            a, held = b, 0
    return np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])


class Block:
    """Words and neighbouring words of some texts, with their counts here and in each document. Words have even keys, pairs odd ones."""

    def __init__(self, texts: list[str | None], buckets: int):
        hashes, self.document = _hashed(texts)
        self.form = (hashes >> np.uint64(48)).astype(np.int64)
        self.before = np.flatnonzero(self.document[1:] == self.document[:-1])
        key = hashes & ~np.uint64(1)
        self.words, self.word = _numbered(key)
        self.pairs, self.pair = _numbered(mixed(key[self.before] * np.uint64(BASE) + key[self.before + 1]) | np.uint64(1))
        self.buckets = [self._places(keys, buckets) for keys in (self.words, self.pairs)]

    @staticmethod
    def _places(keys: np.ndarray, buckets: int) -> list[np.ndarray]:
        bucket = ((keys >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets)))

    def _counts(self, of: np.ndarray, size: int) -> np.ndarray:
        """How often each number stands anywhere, before a word and after a word of its document."""
        return np.stack([np.bincount(x, minlength=size) for x in (of, of[self.before], of[self.before + 1])])

    def dealt(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(bucket, words, pairs, counts of both) of all buckets that get any."""
        of_words, of_pairs = self._counts(self.word, len(self.words)), np.bincount(self.pair, minlength=len(self.pairs))
        for k, (w, p) in enumerate(zip(*self.buckets, strict=True)):
            if len(w) or len(p):
                yield k, self.words[w].tobytes(), self.pairs[p].tobytes(), _packed(np.concatenate([of_words[:, w].ravel(), of_pairs[p]]).astype(np.uint32))

    def elsewhere(self, totals: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """From (bucket, totals): counts in all other documents, three for the word of each place, and one for each pair of neighbours."""
        of_words, of_pairs = np.zeros((3, len(self.words)), np.int64), np.zeros(len(self.pairs), np.int64)
        for k, n in totals:
            w, p = (of[k] for of in self.buckets)
            of_words[:, w], of_pairs[p] = n[: 3 * len(w)].reshape(3, -1), n[3 * len(w) :]
        mine = _numbered(self.document * len(self.words) + self.word)[1]
        paired = _numbered(self.document[self.before] * len(self.pairs) + self.pair)[1]
        own = self._counts(mine, len(mine))
        return of_words[:, self.word] - own[:, mine], of_pairs[self.pair] - np.bincount(paired)[paired] if len(paired) else of_pairs

    def log_probability(self, base: np.ndarray, of_words: np.ndarray, of_pairs: np.ndarray) -> np.ndarray:
        left, right = base.copy(), base.copy()
        first, second = self.before, self.before + 1
        left[second] = (of_pairs + PRIOR * base[second]) / (of_words[1, first] + PRIOR)
        right[first] = (of_pairs + PRIOR * base[first]) / (of_words[2, second] + PRIOR)
        return np.log((left + right) / 2)


def _blocks(docs: DataFrame) -> DataFrame:
    """block, bytes, rows (doc_id and text as a compressed Arrow stream): all rows, in blocks of about ``BLOCK_BYTES``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, rows in enumerate(slices(batches, 1, BLOCK_BYTES)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            columns = [pa.array([(part << 33) + k], pa.int64()), pa.array([rows.column(1).nbytes], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bytes", "rows"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(packed, "block long, bytes long, rows binary")


def _totals(blocks: DataFrame, buckets: int, of: np.ndarray) -> DataFrame:
    """block, bucket, n: totals of a block's keys over all blocks; with block -1, the different words and the tokens of each class in the bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = pa.ipc.open_stream(rows.as_py()).read_all()[1].to_pylist()
                found = list(zip(*Block(texts, buckets).dealt(), strict=True)) or [()] * 4
                columns = [pa.array([block] * len(found[0]), pa.int64()), pa.array(found[0], pa.int32()), *(pa.array(x, pa.binary()) for x in found[1:])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "words", "pairs", "n"])
        released()

    def count(group: pa.Table) -> pa.Table:
        parts = [views(group[c], np.uint64) for c in ("words", "pairs")]
        ns = [_unpacked(x.as_py(), np.uint32) for x in group["n"]]
        sizes = [len(w) for w in parts[0]]
        (words_, word), (pairs, pair) = (_numbered(np.concatenate(p)) for p in parts)
        every = np.concatenate([n[: 3 * m].reshape(3, -1) for n, m in zip(ns, sizes, strict=True)], axis=1)
        of_words = np.stack([np.bincount(word, n, len(words_)) for n in every]).astype(np.int64)
        of_pairs = np.bincount(pair, np.concatenate([n[3 * m :] for n, m in zip(ns, sizes, strict=True)]), len(pairs)).astype(np.int64)
        out, w, p = [], 0, 0
        for a, b in zip(*parts, strict=True):
            out.append(_packed(np.concatenate([of_words[:, word[w : w + len(a)]].ravel(), of_pairs[pair[p : p + len(b)]]])))
            w, p = w + len(a), p + len(b)
        classes = of[(words_ >> np.uint64(48)).astype(np.int64)]
        out.append(_packed(np.concatenate([np.bincount(classes, minlength=CLASSES), np.bincount(classes, of_words[0], CLASSES).astype(np.int64)])))
        released()
        block = pa.array([*group["block"].to_pylist(), -1], pa.int64())
        bucket = pa.array([*group["bucket"].to_pylist(), group["bucket"][0].as_py()], pa.int32())
        return pa.table({"block": block, "bucket": bucket, "n": pa.array(out, pa.binary())})

    dealt = blocks.select("block", "rows").mapInArrow(deal, "block long, bucket int, words binary, pairs binary, n binary")
    return dealt.groupBy("bucket").applyInArrow(count, "block long, bucket int, n binary")


def score(docs: DataFrame, learned: tuple[Vocabulary, Network] | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum), mean_log_likelihood of every row. Counts of words and neighbours are those of ``docs``."""
    blocks = stored(_blocks(docs), "blocks")
    vocabulary, network = learned or learn(docs)
    of, values = vocabulary.of, network.values
    buckets = max(partitions(docs.sparkSession), (blocks.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES)
    totals = stored(_totals(blocks, buckets, of), "totals")
    kinds, seen = np.zeros((2, CLASSES), np.int64)
    for r in totals.filter("block < 0").select("n").toLocalIterator():
        more = _unpacked(r["n"], np.int64).reshape(2, -1)
        kinds, seen = kinds + more[0], seen + more[1]

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        held = pa.ipc.open_stream(texts["rows"][0].as_py()).read_all()
        model, block = Network(values), Block(held[1].to_pylist(), buckets)
        document, classes = block.document, of[block.form]
        of_words, of_pairs = block.elsewhere((k, _unpacked(n.as_py(), np.int64)) for k, n in zip(found["bucket"].to_pylist(), found["n"], strict=True))
        rows = held.num_rows
        own = np.bincount(document * CLASSES + classes, minlength=rows * CLASSES)[document * CLASSES + classes]
        base = (of_words[0] + NEW) / (seen[classes] - own + NEW * kinds[classes])
        near = neighbours(classes, document)
        for a in range(0, len(classes), BATCH):
            base[a : a + BATCH] *= np.exp(model.log_probability(near[:, a : a + BATCH], classes[a : a + BATCH]))
        n = np.bincount(document, minlength=rows)
        total = np.bincount(document, block.log_probability(base, of_words, of_pairs), rows).astype(np.float64)  # of nothing, counts would be integers
        released()
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        return pa.table([held[0], pa.array(n, pa.int64()), pa.array(total), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    pairs = blocks.select("block", "rows").groupBy("block").cogroup(totals.filter("block >= 0").groupBy("block"))
    return pairs.applyInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
