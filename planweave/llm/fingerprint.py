"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits, in built-in functions only.

Every shingle of five lower-case words is hashed once. The eight highest bits choose one of 256 bins, and each bin keeps its least hash:
the hashes are sorted, so a bin's least is the first of its run. An empty bin copies the first filled bin in a random order of the bins
that belongs to it alone and is the same for every document. Four low-order bits of each bin make the fingerprint, one hexadecimal digit
a bin. Of two fingerprints, the agreement by chance of 1/16 is taken out of the share of equal bins.

Defined cases: a null text is empty; a text of one to four words has one shingle, all of it; a text without words has the empty
fingerprint, which is like itself alone; rows of one id are told apart by nothing but their texts, and the least of the next id's texts
counts as the next; a null id has no next document; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import partitions, stored

BINS = 256
WORDS = 5
PROBES = 12
#: Ranges of ids, at least, in which neighbours are found; one bound and one id of each reach the driver.
RANGES = 64


def _bin(h: Column) -> Column:
    """0 to 255, ascending with the signed hash."""
    return F.shiftrightunsigned(h, 56).bitwiseXOR(128).cast("int")


def _digit(packed: Column, place: Column) -> Column:
    """The digit of a bin, null if it is empty."""
    return F.nullif(F.substring(packed, place + 1, F.lit(1)), F.lit("_"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with a column ``name``, the fingerprint of column ``text``.

    Each step that reads an array more than once stands in a projection of its own, so that the array is made once.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    c = {k: F.col(f"__{k}") for k in ("words", "hashes", "least", "packed")}
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    df = df.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("__words"))
    n = F.size(c["words"])
    runs = F.transform(c["words"], lambda h, i: F.xxhash64(h, *[F.get(c["words"], i + k) for k in range(1, WORDS)]))
    hashes = F.sort_array(F.slice(runs, F.lit(1), F.when(n >= WORDS, n - (WORDS - 1)).otherwise(F.least(n, F.lit(1)))))
    df = df.select(*kept, hashes.alias("__hashes"))
    least = F.filter(c["hashes"], lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(c["hashes"], i - 1))))
    df = df.select(*kept, least.alias("__least"))
    own = lambda h: F.lower(F.hex(h.bitwiseAND(15)))
    gap = lambda h, i: _bin(h) - F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(c["least"], i - 1))) - 1
    packed = F.rpad(F.array_join(F.transform(c["least"], lambda h, i: F.concat(F.repeat(F.lit("_"), gap(h, i)), own(h))), ""), BINS, "_")
    df = df.select(*kept, c["least"], packed.alias("__packed"))

    def filled(b: Column) -> Column:
        tries = [_digit(c["packed"], F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
        rest = F.array_min(F.transform(c["least"], lambda h: F.struct(F.xxhash64(b, _bin(h)).alias("order"), own(h).alias("digit"))))["digit"]
        return F.coalesce(_digit(c["packed"], b), *tries, rest)

    every = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), filled), "")
    made = F.when(F.size(c["least"]) == 0, F.lit("")).when(F.instr(c["packed"], "_") == 0, c["packed"]).otherwise(every)
    return df.select(*kept, made.alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected share of equal bins of two fingerprints, from 0 to 1."""

    def differing(k: Column) -> Column:
        x, y = (F.conv(F.substring(v, k * 8 + 1, F.lit(8)), 16, 10).cast("long") for v in (a, b))
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftright(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftright(z, 2)).bitwiseAND(0x11111111))

    chance = 1.0 / 16
    apart = F.aggregate(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), F.lit(0), lambda t, k: t + differing(k))
    corrected = F.greatest(((BINS - apart) / F.lit(float(BINS)) - chance) / (1 - chance), F.lit(0.0))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(corrected)


def followers(ids: DataFrame, bounds: list[int]) -> DataFrame:
    """doc_id, n and the next id in ascending order, the first one after the last, for rows of distinct ids.

    Ids are cut at ``bounds`` into ranges. Inside a range a window finds the next id; after its last id comes the least id of the next
    range that has any. Of each range one row reaches the driver.
    """
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    ranged = ids.withColumn("range", place)
    firsts = sorted((r["range"], r["least"]) for r in ranged.groupBy("range").agg(F.min("doc_id").alias("least")).collect())
    wrapped = [x for k, (r, _) in enumerate(firsts) for x in (F.lit(r), F.lit(firsts[(k + 1) % len(firsts)][1]))]
    following = F.element_at(F.create_map(*wrapped), F.col("range")) if wrapped else F.lit(None).cast("long")
    inside = Window.partitionBy("range").orderBy("doc_id")
    return ranged.withColumn("next_id", F.coalesce(F.lead("doc_id").over(inside), following)).drop("range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its second half replaced from the next document), and their likeness.

    The texts are shuffled once, by id; what each text gives to the one before it is shuffled once more. Both sides of that join read one
    exchange: it holds plain texts, since Spark does not see that two exchanges with higher-order functions below are the same.
    """
    # New names: an alias that keeps a name is dropped on one side of a self-join alone, and then the exchanges differ.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    placed = rows.filter("id IS NOT NULL")
    count = partitions(docs.sparkSession)
    ranges = max(RANGES, count)
    sized = placed.groupBy(F.col("id").alias("doc_id")).agg(F.max(F.length("body")).alias("n"), F.count("*").alias("rows"))
    shape = sized.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10_000).alias("bounds"), F.max("rows").alias("most")).first()
    repeated = (shape["most"] or 0) > 1
    before = followers(sized.select("doc_id", "n"), sorted(set(shape["bounds"] or []))).select(F.col("next_id").alias("id"), F.col("doc_id").alias("prior_id"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    dealt = placed.repartition(count, "id")
    parts = dealt.join(before, "id").select(F.col("prior_id").alias("id"), F.col("id").alias("next_id"), F.expr("left(body, half)").alias("part"))
    if repeated:
        parts = parts.groupBy("id").agg(F.min(F.struct("part", "next_id")).alias("s")).select("id", "s.next_id", "s.part")
    apart = rows.filter("id IS NULL").select("id", "body", F.lit(None).cast("long").alias("next_id"), F.lit(None).cast("string").alias("part"))
    half = "cast(floor(length(body) / 2) AS int)"
    new = F.concat(F.expr(f"left(body, length(body) - {half})"), F.coalesce(F.expr(f"left(part, {half})"), F.lit("")))
    joined = dealt.join(parts, "id", "left").unionByName(apart).select(F.col("id").alias("doc_id"), "next_id", F.length("body").cast("long").alias("n_chars"), F.col("body").alias("text"), new.alias("new"))
    both = with_fingerprint(with_fingerprint(joined, "text", "fingerprint").withColumn("edited_sha256", F.sha2(F.col("new").cast("binary"), 256)).drop("text"), "new", "edited_fingerprint")
    printed = stored(both.drop("new"), "fingerprints")
    following = printed.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint"))
    if repeated:
        following = following.groupBy("next_id").agg(F.min("next_fingerprint").alias("next_fingerprint"))
    return printed.join(following, "next_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
