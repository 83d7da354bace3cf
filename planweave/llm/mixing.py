"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted in cells of source, language and topic. Raking finds one factor for each source, language and topic so that the
weighted tokens meet the target shares of all three at once. A cell's sampling probability follows from its factors and a budget of tokens;
a document is kept if a hash of its id, read as a number from 0 to 1, lies below it. Where the budget asks for more of a cell than there
is, the probability is 1 and the rest shows as a sample weight above 1, so that weighted tokens still meet the targets.

Languages and topics are few and their factors are held by the driver; sources may be many, so their cells stay distributed and each
round brings back only one sum for each language and topic.

A target share that is not given is the square root of the share in the corpus, and the shares are scaled to sum to one. Topics are
told by marker words; a text that has none is ``general``.

Defined cases: a null source or language is a category of its own, named by the empty string; a null or empty text has no tokens and
is drawn by its cell's probability, which is 0 in a cell without tokens; a null id is drawn as the empty string; repeated rows share one draw; where structural gaps keep the targets
out of reach, raking stops after ``ROUNDS`` rounds at its best fit; an empty table stays empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.llm.common import pinned, slices

ROUNDS, CLOSE = 60, 1e-7
#: Sources per task of a raking round, and the number of sources up to which their factors are broadcast.
SOURCES_A_TASK, BROADCAST_SOURCES = 20_000, 100_000

#: Marker words of the default topics, in lower case.
TOPICS = {
    "law": frozenset("license licence licensed copyright rights permission warranty liability terms lizenz licencia derechos droits reserved".split()),
    "computing": frozenset("password token key code function return import class server api http data = { } password: token:".split()),
    "tables": frozenset("| || -- --- ---|--- :---".split()),
}


def topic_and_tokens(text: str | None, topics: Mapping[str, frozenset[str]]) -> tuple[str, int]:
    """The topic with the most marker words, ties by name; and the number of words."""
    words = (text or "").lower().split()
    seen: Counter[str] = Counter()
    distinct = set(words)
    for name, markers in topics.items():
        if found := distinct & markers:
            seen[name] = sum(map(words.count, found))
    return (min(seen, key=lambda t: (-seen[t], t)) if seen else "general"), len(words)


def measured(docs: DataFrame, topics: Mapping[str, frozenset[str]] = TOPICS) -> DataFrame:
    """All columns, with ``mix_topic`` and ``mix_tokens``."""
    topics = dict(topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for part in slices(iter([batch]), k, 8 << 20):
                found = [topic_and_tokens(t, topics) for t in part.column(k).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], [*part.schema.names, "mix_topic", "mix_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("mix_topic", T.StringType()), T.StructField("mix_tokens", T.LongType())]))


def _shares(tokens: Mapping[str, float], given: Mapping[str, float] | None) -> dict[str, float]:
    raw = {k: (given or {}).get(k, 0.0) if given else float(n) ** 0.5 for k, n in tokens.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else dict.fromkeys(raw, 0.0)


class Raked:
    """Factors of languages and topics, and the table of sources with theirs."""

    def __init__(self, lang: dict[str, float], topic: dict[str, float], sources: DataFrame, count: int):
        self.lang, self.topic, self.sources, self.count = lang, topic, sources, count


def _looked_up(values: Mapping[str, float], column: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(0.0)) if pairs else F.lit(0.0)


def rake(cells: DataFrame, source_targets: Mapping[str, float] | None = None, lang_targets: Mapping[str, float] | None = None, topic_targets: Mapping[str, float] | None = None) -> Raked:
    """Iterative proportional fitting of cells (source, lang, topic, tokens)."""
    key = F.struct("lang", "topic").alias("key")
    marginals = {(r["lang"], r["topic"]): float(r["n"]) for r in cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("n")).collect() if r["n"]}
    langs, topics = sorted({k[0] for k in marginals}), sorted({k[1] for k in marginals})
    lang_goal = _shares({x: sum(n for k, n in marginals.items() if k[0] == x) for x in langs}, lang_targets)
    topic_goal = _shares({x: sum(n for k, n in marginals.items() if k[1] == x) for x in topics}, topic_targets)
    by_source = cells.filter("tokens > 0").groupBy("source").agg(F.collect_list(F.struct(key, "tokens")).alias("cells"), F.sum("tokens").alias("all"))
    goal = _looked_up(source_targets, F.col("source")) if source_targets else F.sqrt("all")
    count, total = (by_source.select(F.count("*"), F.sum(goal)).first())[:2]
    by_source = pinned(by_source.withColumn("goal", goal / F.lit(total or 1.0)).coalesce(max(1, count // SOURCES_A_TASK)))
    lang, topic = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def fitted() -> Column:
        weights = F.aggregate("cells", F.lit(0.0), lambda t, c: t + c["tokens"] * _looked_up(lang, c["key"]["lang"]) * _looked_up(topic, c["key"]["topic"]))
        return F.when(weights > 0, F.col("goal") / weights).otherwise(0.0)

    for _ in range(ROUNDS if count else 0):
        pulled = by_source.select(fitted().alias("factor"), F.explode("cells").alias("c")).groupBy("c.key.lang", "c.key.topic").agg(F.sum(F.col("factor") * F.col("c.tokens")).alias("n"))
        sums = {(r["lang"], r["topic"]): r["n"] for r in pulled.collect()}  # one sum a language and topic
        before = dict(lang), dict(topic)
        for x in langs:
            got = sum(n * topic[t] for (y, t), n in sums.items() if y == x)
            lang[x] = lang_goal[x] / got if got else 0.0
        for t in topics:
            got = sum(n * lang[y] for (y, u), n in sums.items() if u == t)
            topic[t] = topic_goal[t] / got if got else 0.0
        scale = sum(lang.values()) / len(langs) or 1.0
        lang = {k: v / scale for k, v in lang.items()}
        topic = {k: v * scale for k, v in topic.items()}
        moved = [abs(a - b) / (abs(a) or 1.0) for new, old in ((lang, before[0]), (topic, before[1])) for a, b in zip(new.values(), old.values(), strict=True)]
        if max(moved) < CLOSE:
            break
    return Raked(lang, topic, by_source.select("source", fitted().alias("factor")), count)


def cells_of(rows: DataFrame) -> DataFrame:
    """Tokens of each source, language and topic of measured rows."""
    source, lang = F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang")
    return pinned(rows.groupBy(source, lang, F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens")))


def _with_factor(df: DataFrame, raked: Raked, source: Column, spread: Column) -> DataFrame:
    """Rows with the factor of their source. Beyond a bounded number of sources, a hot one is dealt to many tasks by ``spread``."""
    table = raked.sources.select(F.col("source").alias("__source"), F.col("factor").alias("__factor"))
    if raked.count <= BROADCAST_SOURCES:
        return df.join(F.broadcast(table), source == F.col("__source"), "left")
    salts = 32
    table = table.withColumn("__salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    return df.join(table, (source == F.col("__source")) & (F.pmod(F.xxhash64(spread), F.lit(salts)) == F.col("__salt")), "left").drop("__salt")


def decided(rows: DataFrame, cells: DataFrame, keep_share: float = 0.5, seed: int = 11, **targets: Mapping[str, float] | None) -> DataFrame:
    """Measured rows with ``mix_weight`` (sample weight), ``mix_probability`` and ``mix_kept``; about ``keep_share`` of the tokens are kept."""
    raked = rake(cells, **targets)

    def ratio(lang: Column, topic: Column) -> Column:
        return F.coalesce("__factor", F.lit(0.0)) * _looked_up(raked.lang, lang) * _looked_up(raked.topic, topic)

    scored = _with_factor(cells, raked, F.col("source"), F.col("topic")).select("tokens", ratio(F.col("lang"), F.col("topic")).alias("ratio"))
    total, least = scored.select(F.sum("tokens"), F.min(F.when(F.col("ratio") > 0, F.col("ratio")))).first()
    low, scale = 0.0, 1.0 / least if least else 0.0
    for _ in range(6):  # each round divides the interval of the scale by 32
        steps = [low + (scale - low) * k / 32 for k in range(1, 33)]
        got = scored.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("ratio") * s)).alias(f"s{k}") for k, s in enumerate(steps)]).first()
        over = next((k for k in range(32) if (got[k] or 0.0) >= keep_share * (total or 0)), 31)
        low, scale = (steps[over - 1] if over else low), steps[over]
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    place = F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))
    out = _with_factor(rows, raked, F.coalesce("source", F.lit("")), F.col("doc_id")).withColumn("__ratio", ratio(F.coalesce("lang", F.lit("")), F.col("mix_topic")) * scale)
    probability = F.least(F.lit(1.0), F.col("__ratio"))
    weight = F.when(F.col("__ratio") > 0, F.greatest(F.lit(1.0), F.col("__ratio"))).otherwise(0.0)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], weight.alias("mix_weight"), probability.alias("mix_probability"), (place < probability).alias("mix_kept"))


def assignments(docs: DataFrame, **settings: float) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, kept for every document."""
    rows = pinned(measured(docs.select("doc_id", "source", "lang", "text")).drop("text"))
    named = {"mix_topic": "topic", "mix_tokens": "tokens", "mix_weight": "weight", "mix_probability": "probability", "mix_kept": "kept"}
    return decided(rows, cells_of(rows), **settings).withColumnsRenamed(named)


def mixed(docs: DataFrame, keep_share: float = 0.5, **targets: Mapping[str, float] | None) -> DataFrame:
    """The kept rows with their own columns, whatever their names: all but the four that are read here have other names meanwhile."""
    plain = docs.toDF(*[c if c in ("doc_id", "source", "lang", "text") else f"own_{k}" for k, c in enumerate(docs.columns)])
    cells = cells_of(measured(docs.select("source", "lang", "text")))
    return decided(measured(plain), cells, keep_share, **targets).filter("mix_kept").select(*plain.columns).toDF(*docs.columns)
