"""Language of a text by error-correcting output codes over byte n-grams.

Each language has a codeword; one linear classifier for each bit of it is trained, in numpy, on hashed byte trigrams. A text's bits are
compared with all codewords by a weighted logistic loss, and the nearest codeword is the prediction. Its share among all codewords is
the score; a text whose two nearest codewords lie close together is flagged as ambiguous.

The classifiers are fitted on a bounded sample: about ``PER_LANGUAGE`` different texts of each language, those of the smallest hashes, or
fewer where ``SAMPLE`` texts of all languages would be exceeded, drawn from the rows whose language is known and which are not held out.
Only features of the sample, of one size each, reach the driver. Every language that occurs is learned. Predictions read the text alone,
all of it.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; a null id is not held out; without any labelled row every
text is ``und``; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import slices

UNKNOWN = "und"
#: Texts in the sample of a language, and of all languages, about.
PER_LANGUAGE, SAMPLE = 400, 20_000
BUCKET_BITS = 12
AMBIGUOUS = 1.0

#: ASCII letters and all bytes of longer characters stand for themselves, the rest for a space.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def _buckets(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint32)
    return ((wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


_BLANK = int(_buckets(np.full(3, 32, np.uint8))[0])


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams of the lower-case text, words being set off by spaces."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_LETTERS), np.uint8)
    counts = np.bincount(_buckets(data), minlength=1 << BUCKET_BITS)
    counts[_BLANK] = 0
    return np.sqrt(counts / max(1, counts.sum()), dtype=np.float32, casting="unsafe")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(classes: int) -> np.ndarray:
    """Rows of +1 and -1. Few classes get every way of splitting them in two; more get the best of some random codes."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 5:
        return np.array([(1, *x) for x in product((1, -1), repeat=classes - 1) if -1 in x]).T.astype(float)
    rng = np.random.default_rng(0)
    bits = int(np.ceil(10 * np.log2(classes)))
    tried = [rng.choice([1.0, -1.0], (classes, bits)) for _ in range(40)]
    return max(tried, key=lambda c: (c @ c.T - 2 * bits * np.eye(classes)).max() * -1)


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        margins = features(text) @ self.weights + self.bias
        loss = (np.logaddexp(0.0, -self.code * margins) * self.trust).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        share = 1.0 / np.exp(loss[order[0]] - loss).sum()
        return self.languages[order[0]], float(share), len(order) > 1 and float(loss[order[1]] - loss[order[0]]) < AMBIGUOUS


def fit(texts: list[str], labels: list[str]) -> Model:
    return fitted(np.stack([features(t) for t in texts]) if texts else np.empty((0, 1 << BUCKET_BITS), np.float32), labels)


def fitted(x: np.ndarray, labels: list[str], rounds: int = 150, rate: float = 30.0) -> Model:
    """One logistic classifier for each bit, by accelerated gradient descent; every language weighs the same."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1), np.ones(1))
    number = {y: k for k, y in enumerate(languages)}
    of = np.array([number[y] for y in labels])
    y = code[of]
    share = (1.0 / np.bincount(of, minlength=len(languages)))[of] / len(languages)
    weights, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1])
    ahead, ahead_bias = weights.copy(), bias.copy()
    for k in range(rounds):
        pull = y / (1.0 + np.exp(np.clip(y * (x @ ahead + ahead_bias), -40, 40))) * share[:, None]
        new, new_bias = ahead + rate * (x.T @ pull.astype(np.float32) - 1e-5 * ahead), ahead_bias + pull.sum(axis=0)
        momentum = k / (k + 3)
        ahead, ahead_bias = new + momentum * (new - weights), new_bias + momentum * (new_bias - bias)
        weights, bias = new, new_bias
    right = ((np.sign(x @ weights + bias) == y) * share[:, None]).sum(axis=0)
    return Model(languages, code, weights, bias, np.clip(2 * right - 1, 0.05, 1.0))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the sample. What comes to the driver is one vector for each of its texts, about ``per_language`` (with the spread of a hash) for
    each language, and one count for each language. Equal texts have one hash and count and come once."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    known = docs.filter(~held_out(F.col("doc_id"))).select(lang.alias("label"), text.alias("body")).filter("label IS NOT NULL AND body IS NOT NULL").withColumn("draw", F.xxhash64(F.lit("langid"), "body"))
    counts = {r["label"]: r["different"] for r in known.groupBy("label").agg(F.approx_count_distinct("draw", 0.02).alias("different")).collect()}
    each = max(1, min(per_language, SAMPLE // max(1, len(counts))))
    most = docs.sparkSession.createDataFrame([(k, each / n) for k, n in counts.items()], "label string, most double")
    drawn = known.join(F.broadcast(most), "label").filter(F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53)) < F.col("most"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), 1, 8 << 20):
                usable = [(y, t, d) for y, t, d in zip(*(c.to_pylist() for c in part.columns), strict=True) if has_letter(t)]
                found = [pa.compress(features(t).tobytes(), "zstd", asbytes=True) for _, t, _ in usable]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _, _ in usable], pa.string()), pa.array(found, pa.binary()), pa.array([d for _, _, d in usable], pa.int64())], ["label", "found", "draw"])

    sample = drawn.select("label", "body", "draw").mapInArrow(described, "label string, found binary, draw long").groupBy("label", "draw").agg(F.min("found").alias("found"))
    rows = sorted(sample.collect(), key=lambda r: (r["label"], r["draw"]))
    size = 4 << BUCKET_BITS
    vectors = [np.frombuffer(pa.decompress(r["found"], size, "zstd", asbytes=True), np.float32) for r in rows]
    return fitted(np.stack(vectors) if vectors else np.empty((0, 1 << BUCKET_BITS), np.float32), [r["label"] for r in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 8 << 20):
            found = [model.predict(t) for t in part.column(1).to_pylist()]
            arrays = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *arrays], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The rows whose text has a language: all but ``und`` and those that no codeword is near to. All columns stay."""
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for part in slices(iter([batch]), k, 8 << 20):
                found = [model.predict(t) for t in part.column(k).to_pylist()]
                yield part.filter(pa.array([x[0] != UNKNOWN and x[1] >= least_score for x in found]))

    return docs.mapInArrow(run, docs.schema)
