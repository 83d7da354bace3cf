"""Personal data in text: four base patterns and a semi-Markov conditional random field.

Base spans are exact patterns (email, ip, card, phone), leftmost and non-overlapping for each kind; a match that fails its test is
dropped and not tried again. Around every token that holds a digit, ``@`` or ``=``, the random field then scores whole candidate spans of
up to ``MAX_TOKENS`` tokens: features look at the entire span (its shape, checks, the word before it), and a dynamic program over segments
chooses boundaries and types together. Base spans are fixed points of that program, so they always stay; the field adds spans of the
kinds that no base pattern covers: ``secret`` (credentials) and ``id`` (grouped personal numbers).

The weights are trained here, in numpy, by maximum likelihood on sentences made from rules with a fixed seed.

Defined cases: a null or empty text has no span; offsets count code points, ends are exclusive; repeated rows give repeated results;
other columns of the input are ignored by ``detect`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import slices

BASE = ("email", "ip", "card", "phone")
LABELS = ("O", *BASE, "secret", "id")
ADDED = ("secret", "id")
#: Tokens of an entity, at most: the longest grouped number, an account number of 34 characters, has nine groups.
MAX_TOKENS = 10
CONTEXT = 3

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@=]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` is met once; the local part is the run before it, back to the end of the match before at most."""
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL_TAIL.match(text, at)):
            found.append((start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """The four base patterns, by start, then in the order of ``BASE``."""
    if not text or not _TRIGGER.search(text):
        return []
    found = [(*x, "email") for x in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2]), x[1]))


#: Features of a whole candidate span.
_CUES = frozenset("password passwd pwd secret token key apikey api_key access_key auth bearer credential".split())
_ID_CUES = frozenset("ssn passport id iban account personnummer ausweis dni nif insee steuernummer".split())
_KEYED = re.compile(r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|(?:api|access)?_?key|auth)\s*[=:]\s*[\"']?[^\s\"']{6,}[\"']?\Z")
_KEY = re.compile(r"[\"']?[A-Z]{4}[A-Z0-9]{12,}[\"']?[.,;]?\Z")
_HEX = re.compile(r"[\"']?[0-9a-f]{24,}[\"']?[.,;]?\Z")
_GROUPED = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}[.,;]?\Z")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?[.,;]?\Z")
_FEATURES = 22


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int, exact: dict[tuple[int, int], str]) -> tuple[int, ...]:
    """Indices of the features that hold for tokens i..j-1 as one span."""
    start, end = tokens[i][0], tokens[j - 1][1]
    span = text[start:end]
    kind = exact.get((i, j))
    before = text[tokens[i - 1][0] : tokens[i - 1][1]].strip(".,:;=\"'").lower() if i else ""
    digits = sum("0" <= c <= "9" for c in span)
    shapes = (
        bool(_KEYED.match(span)),
        bool(_KEY.match(span)) and digits > 1,
        bool(_HEX.match(span)) and digits > 3,
        bool(_GROUPED.match(span)),
        bool(_IBAN.match(span)),
    )
    has = (
        True,
        j - i == 1,
        j - i > 3,
        kind == "email",
        kind == "ip",
        kind == "card",
        kind == "phone",
        *shapes,
        any(shapes),
        kind is None and not any(shapes),
        before in _CUES,
        before in _ID_CUES,
        digits == 0,
        0 < digits < 6,
        digits >= 6,
        2 * digits > len(span),
        not any(c.isalnum() for c in span),
        span.replace(".", "").replace(",", "").isalpha(),
    )
    return tuple(k for k, x in enumerate(has) if x)


def _segments_at(text: str, tokens: list[tuple[int, int]], exact: dict[tuple[int, int], str]) -> Iterator[tuple[int, list[tuple[int, tuple[int, ...], bool]]]]:
    """Each end in order, with its candidate segments (start, features, may be an entity). Outside segments have one token; an entity has a trigger."""
    hot = [bool(_TRIGGER.search(text, a, b)) for a, b in tokens]
    for j in range(1, len(tokens) + 1):
        yield j, [(i, span_features(text, tokens, i, j, exact), any(hot[i:j])) for i in range(max(0, j - MAX_TOKENS), j) if i == j - 1 or any(hot[i:j])]


def _segments(text: str, tokens: list[tuple[int, int]], exact: dict[tuple[int, int], str]) -> dict[int, list[tuple[int, tuple[int, ...], bool]]]:
    """All candidate segments by end."""
    return dict(_segments_at(text, tokens, exact))


def _allowed(i: int, j: int, entity: bool, labels: tuple[str, ...]) -> np.ndarray:
    """0 for each label that a segment may have, else -inf: outside has one token, an entity has a trigger."""
    return np.array([0.0 if (j - i == 1 if x == "O" else entity and x in labels) else -np.inf for x in LABELS])


class SemiMarkov:
    """Weights of span features by label and of label pairs; exact likelihood gradient and exact decoding."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def scores(self, features: tuple[int, ...]) -> np.ndarray:
        return self.weights[:, list(features)].sum(axis=1)

    def decode(self, segments: Iterable[tuple[int, list]], n: int, fixed: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
        """The best (start, end, label) segments, from candidates by end in order, which are taken one end at a time. ``fixed`` segments are kept whole with their label; no other segment cuts or covers one."""
        inside = {k for i, j in fixed for k in range(i + 1, j)}
        nearest = [n + 1] * (n + 1)  # least end of the fixed segments that start at or after a token
        for i, j in fixed:
            nearest[i] = j
        for i in range(n - 1, -1, -1):
            nearest[i] = min(nearest[i], nearest[i + 1])
        came = np.zeros((n + 1, len(LABELS), 2), np.int32)
        best = np.full(len(LABELS), -np.inf)
        into, before = {0: self.pairs[0]}, {0: np.zeros(len(LABELS), int)}  # of the last MAX_TOKENS ends
        for j, candidates in segments:
            into.pop(j - 1 - MAX_TOKENS, None)
            before.pop(j - 1 - MAX_TOKENS, None)
            if j in inside:
                continue
            best = np.full(len(LABELS), -np.inf)
            for i, features, entity in candidates:
                held = fixed.get((i, j))
                if i in inside or (held is None and nearest[i] <= j):
                    continue
                if held is None:
                    mask = _allowed(i, j, entity, ADDED)
                else:
                    mask = np.full(len(LABELS), -np.inf)
                    mask[held] = 0.0
                own = into[i] + self.scores(features) + mask
                better = own > best
                best[better] = own[better]
                came[j, better, 0] = i
                came[j, better, 1] = before[i][better]
            paths = best[:, None] + self.pairs
            into[j], before[j] = paths.max(axis=0), paths.argmax(axis=0)
        out, j, y = [], n, int(np.argmax(best))
        while j > 0:
            i, x = map(int, came[j, y])
            out.append((i, j, y))
            j, y = i, x
        return out[::-1]

    def gradient(self, segments: dict, n: int, gold: list[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of a segmentation and its gradient, by forward and backward sums over all segmentations."""
        size = len(LABELS)
        own = {(i, j): self.scores(f) + _allowed(i, j, e, LABELS) for j in segments for i, f, e in segments[j]}
        forward = np.full((n + 1, size), -np.inf)
        backward = np.full((n + 1, size), -np.inf)
        backward[n] = 0.0
        into = {0: self.pairs[0]}
        for j in range(1, n + 1):
            for i, _, _ in segments[j]:
                forward[j] = np.logaddexp(forward[j], into[i] + own[i, j])
            into[j] = np.logaddexp.reduce(forward[j][:, None] + self.pairs, axis=0)
        total = np.logaddexp.reduce(forward[n])
        weights, pairs = np.zeros_like(self.weights), np.zeros_like(self.pairs)
        for j in range(n, 0, -1):
            for i, features, _ in segments[j]:
                after = own[i, j] + backward[j]
                if i:
                    paths = self.pairs + after
                    backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(paths, axis=1))
                    pairs -= np.exp(forward[i][:, None] + paths - total)
                else:
                    pairs[0] -= np.exp(self.pairs[0] + after - total)
                weights[:, list(features)] -= np.exp(into[i] + after - total)[:, None]
        value, x = -total, 0
        for i, j, y in gold:
            features = next(f for s, f, _ in segments[j] if s == i)
            value += self.scores(features)[y] + self.pairs[x, y]
            weights[y, list(features)] += 1
            pairs[x, y] += 1
            x = y
        return value, weights, pairs


def _made(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence from rules, with the places of its personal data."""
    word = lambda: "".join(rng.choice(list("aeinorstlhdu"), rng.integers(1, 9)))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda s, n: "".join(rng.choice(list(s), n))

    def card() -> str:
        body = "4" + digits(14)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def account() -> str:
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        groups = [letters(upper + "0123456789", 4) if rng.random() < 0.5 else letters(upper, 4) if rng.random() < 0.3 else digits(4) for _ in range(rng.integers(3, 8))]
        return " ".join([letters(upper, 2) + digits(2), *groups, *([digits(rng.integers(1, 4))] if rng.random() < 0.6 else [])])

    makers = {
        "email": lambda: f"{word()}.{digits(2)}@{word()}.example.com",
        "ip": lambda: ".".join(str(rng.integers(1, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        "secret": lambda: [f"password={letters('0123456789abcdef', 18)}", f"AKIA{letters('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 8)}{digits(3)}{letters('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 5)}", f'token = "{letters("0123456789abcdef", 40)}"', f"api_key: {letters('0123456789abcdef', 24)}"][rng.integers(4)],
        "id": lambda: [f"{digits(3)}-{digits(2)}-{digits(4)}", f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", account()][rng.integers(3)],
    }
    plain = (lambda: f"{rng.integers(1, 9)}.0", lambda: digits(rng.integers(1, 6)), lambda: f"{rng.integers(1, 40)}.", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{word()}={word()}", lambda: f"{digits(1)},{digits(3)}", lambda: f"{digits(2)}%", lambda: f"{word().upper()}-{word().upper()} {rng.integers(1, 9)}.0", lambda: f"{digits(16)} {digits(16)}", lambda: f"| {digits(3)} | {digits(2)} |", lambda: f"= {word()}", lambda: f"{word()}{digits(1)}", lambda: f"{digits(7)}")
    text, spans = "", []
    for _ in range(rng.integers(3, 6)):
        text += " ".join(word() for _ in range(rng.integers(1, 3))) + " "
        if rng.random() < 0.5:
            kind = list(makers)[rng.integers(len(makers))]
            made = makers[kind]()
            spans.append((len(text), len(text) + len(made), kind))
            text += made + " "
        elif rng.random() < 0.6:
            text += plain[rng.integers(len(plain))]() + " "
    return text + word(), spans


def _exact(tokens: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> dict[tuple[int, int], str]:
    """Base spans in tokens: the fewest tokens that cover each."""
    starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
    found: dict[tuple[int, int], str] = {}
    for a, b, kind in spans:
        first, end = bisect_right(ends, a), bisect_left(starts, b)
        if first < end:
            found.setdefault((first, end), kind)
    return found


@lru_cache(maxsize=1)
def trained(sentences: int = 100, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted to made sentences by gradient ascent with momentum; the same on every machine."""
    rng = np.random.default_rng(seed)
    cases = []
    for _ in range(sentences):
        text, spans = _made(rng)
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        exact = _exact(tokens, base_spans(text))
        segments = _segments(text, tokens, exact)
        gold, k = [], 0
        named = {i: (j, kind) for (i, j), kind in _exact(tokens, spans).items()}
        while k < len(tokens):
            j, kind = named.get(k, (k + 1, "O"))
            gold.append((k, j, LABELS.index(kind)))
            k = j
        if all(any(i == s for s, _, _ in segments[j]) for i, j, _ in gold):
            cases.append((segments, len(tokens), gold))
    model = SemiMarkov(np.zeros((len(LABELS), _FEATURES)), np.zeros((len(LABELS), len(LABELS))))
    moving = [np.zeros_like(model.weights), np.zeros_like(model.pairs)]
    for _ in range(rounds):
        total = [-1e-3 * model.weights, -1e-3 * model.pairs]
        for segments, n, gold in cases:
            _, w, p = model.gradient(segments, n, gold)
            total[0] += w / len(cases)
            total[1] += p / len(cases)
        for k, x in enumerate((model.weights, model.pairs)):
            moving[k] = 0.9 * moving[k] + total[k]
            x += 1.5 * moving[k]
    return model.weights, model.pairs


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Tokens around triggers, with ``CONTEXT`` tokens on either side; overlapping windows are one."""
    white = "\x20\x09\x0a\x0b\x0c\x0d"

    def moved(at: int, step: int) -> int:
        for _ in range(CONTEXT + 1):
            for skip in (True, False):
                while 0 <= (k := at - (step < 0)) < len(text) and (text[k] in white) == skip:
                    at += step
        return at

    begin = end = token_end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < token_end:
            continue  # another trigger of the same token
        token_end = next((k for k in range(m.end(), len(text)) if text[k] in white), len(text))
        a, b = moved(m.start(), -1), moved(m.end(), 1)
        if begin >= 0 and a > end:
            yield [x.span() for x in _TOKEN.finditer(text, begin, end)]
            begin = -1
        begin, end = (a, b) if begin < 0 else (begin, max(b, end))
    if begin >= 0:
        yield [x.span() for x in _TOKEN.finditer(text, begin, end)]


def find(text: str | None, model: SemiMarkov) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    if not text or not _TRIGGER.search(text):
        return base, base
    added: list[tuple[int, int, str]] = []
    near = 0
    for tokens in windows(text):
        low, high = tokens[0][0], tokens[-1][1]
        while near < len(base) and base[near][1] <= low:
            near += 1
        close = list(takewhile(lambda x: x[0] < high, islice(base, near, None)))
        reach = list(accumulate((b for _, b, _ in close), max))  # greatest end so far
        exact = _exact(tokens, close)
        fixed, taken = {}, set()
        for (i, j), kind in exact.items():
            if j - i <= MAX_TOKENS and not taken & set(range(i, j)):
                fixed[i, j] = LABELS.index(kind)
                taken |= set(range(i, j))
        for i, j, y in model.decode(_segments_at(text, tokens, exact), len(tokens), fixed):
            if LABELS[y] in ADDED:
                start, end = tokens[i][0], tokens[j - 1][1]
                while end > start and text[end - 1] in ".,;":
                    end -= 1
                if not (k := bisect_left(close, end, key=lambda x: x[0])) or reach[k - 1] <= start:
                    added.append((start, end, LABELS[y]))
    order = (*BASE, *ADDED)
    return base, sorted({*base, *added}, key=lambda x: (x[0], order.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans, counts of the added kinds and of all spans."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkov(*weights)
        for part in slices(batches, 1, 4 << 20):
            counts: list[list[int]] = [[], [], [], []]
            digests, joined, numbers = [], [], ([], [], [])
            for text in part.column(1).to_pylist():
                base, every = find(text, model)
                for k, kind in enumerate(BASE):
                    counts[k].append(sum(x[2] == kind for x in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(every))
                for column, n in zip(numbers, (*(sum(x[2] == k for x in every) for k in ADDED), len(every)), strict=True):
                    column.append(n)
            more = [f"n_{k}" for k in ADDED] + ["n_spans"]
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string()), *(pa.array(c, pa.int64()) for c in numbers)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *more])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, " + ", ".join(f"n_{k} long" for k in ADDED) + ", n_spans long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redacted(text: str | None, model: SemiMarkov) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the union takes the first kind."""
    _, spans = find(text, model)
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out.append(text[at:start] + f"[{kind}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows with personal data replaced in ``text``; n_chars, where there is such a column, follows the new text."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkov(*weights)
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for part in slices(iter([batch]), k, 4 << 20):
                texts = pa.array([redacted(t, model) for t in part.column(k).to_pylist()], part.schema.field(k).type)
                yield part.set_column(k, part.schema.field(k), texts)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
