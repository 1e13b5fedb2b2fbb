"""Secret scan: fixed patterns, and guess costs of values in credential contexts.

Three base patterns give spans of kind ``assign``, ``access`` and ``hex``. Further
spans, kind ``guess``, are values that follow a credential word (``pwd:``,
``passphrase is``, ``Authorization: Bearer`` ...) and are hard to guess. A value's guess cost
is the cheapest way to write it as a run of parts, found by dynamic programming
over its positions: common words, dates, repeats, alphabetic or numeric
sequences, keyboard walks, and brute force for what is left. Each part costs
the logarithm (base 10) of the guesses it takes; every further part costs as
much as the choice where to cut. The words are those of ``COMMON`` and of two public
vocabularies. The cost alone decides: a value needs no digit. The minimum is over all segmentations, of values
of any length.

Defined cases: null and empty texts have no spans; overlapping spans of different
kinds are all reported, but a ``guess`` that lies wholly in a base span is not;
repeated rows each come out; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import texts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A run too short to count can hold no longer match, so the lengths are in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A byte search for what every such run holds spares most texts that pattern.
HEX_MARKS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
HEX_RUN = b"\x01" * 32
CONTEXT = re.compile(
    r"""\b(?:pass(?:phrase|code|word|wd)?|pwd|pw|credentials?|secret|token|auth(?:orization|[_-]?token)?|(?:api|private|access|client|signing|encryption|master)[_-]?(?:key|secret)|connection[_-]?string)\b["']?\s{0,4}(?:[:=]|\bis\b)\s{0,4}(?:bearer\s{1,4}|basic\s{1,4})?["']?([^\s"'<>,;]{8,})""",
    re.I | re.A,
)
#: A value that takes fewer guesses (as a power of ten) is no secret.
MIN_GUESSES = 9.0
#: Every context holds one of these.
CONTEXT_MARKS = ("pass", "pw", "credential", "secret", "token", "auth", "key", "string")

# Frequent password words, most frequent first.
COMMON = (
    "password 123456 qwerty letmein welcome admin login dragon monkey master sunshine princess football baseball iloveyou "
    "shadow superman batman trustno abc123 secret access hello freedom whatever michael jordan hunter summer winter spring "
    "autumn monday friday january february march april june july august september october november december test guest root "
    "user default changeme example sample dummy placeholder none null true false undefined required optional hidden token "
    "pass word love money star king queen black white red blue green orange yellow silver golden happy lucky magic the and "
    "for you with this that from your value string field name email phone address please enter reset change forgot"
).split()
# Rows of a keyboard.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4310$5!7", "aaeiossit")


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEYBOARD):
        for i, c in enumerate(row):
            for dr, shifts in ((0, (-1, 1)), (1, (-1, 0)), (-1, (0, 1))):
                other = KEYBOARD[r + dr] if 0 <= r + dr < len(KEYBOARD) else ""
                near.setdefault(c, set()).update(other[i + s] for s in shifts if 0 <= i + s < len(other))
    return near


NEAR = _neighbours()
PLACE = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d|(?:19|20)\d\d)")


def _alphabet(text: str) -> int:
    """Of brute force: the characters of the classes that occur."""
    sizes = ((r"[a-z]", 26), (r"[A-Z]", 26), (r"\d", 10), (r"[^A-Za-z0-9]", 33))
    return sum(n for pattern, n in sizes if re.search(pattern, text))


@lru_cache(1)
def known_words() -> dict[str, int]:
    """Ranks of ``COMMON``, then of the whole words of two public vocabularies, English
    and of many languages, whose order is about that of frequency."""
    import public_tokenizers

    first: dict[str, int] = {}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as f:
        pieces = [(base64.b64decode(line.split()[0]).decode("utf-8", "replace"), i) for i, line in enumerate(f) if line.strip()]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        pieces += [(" " + w[:-4], i) for w, i in json.load(f)["model"]["vocab"].items() if w.endswith("</w>")]
    for piece, i in pieces:
        word = piece[1:].lower()
        if piece[0:1] == " " and len(word) >= 3 and word.isalpha():
            first[word] = min(i, first.get(word, i))
    order = dict.fromkeys([*COMMON, *sorted(first, key=lambda w: (first[w], w))])
    return {w: i + 1 for i, w in enumerate(order)}


@lru_cache(1)
def known_length() -> int:
    return max(map(len, known_words()))


@lru_cache(1)
def known_heads() -> frozenset[str]:
    return frozenset(w[:3] for w in known_words())


class Ends:
    """The least ``cost + log10(end - start)`` over the starts of parts that may have any length, end by end.

    A longer part's cost grows more slowly, so a start that an earlier one has once caught up with is never the
    best again: starts wait on a stack, newest last, and leave it when overtaken. Each goes once, whatever the length."""

    def __init__(self) -> None:
        self.waiting: list[tuple[int, float, float]] = []  # start, cost, end from which on the one before is better

    def clear(self) -> None:
        if self.waiting:
            self.waiting = []

    def add(self, start: int, cost: float, end: int) -> None:
        while self.waiting:
            before, other, until = self.waiting[-1]
            more = (cost - other) * math.log(10)
            if more > 0:
                at = start + (start - before) / math.expm1(min(more, 700.0))
                if at <= end:
                    return  # the one before is better already, and stays so
                if at < until:
                    self.waiting.append((start, cost, at))
                    return
            self.waiting.pop()  # never better than the new one, or not before it is overtaken itself
        self.waiting.append((start, cost, math.inf))

    def least(self, end: int) -> float:
        waiting = self.waiting
        while len(waiting) > 1 and waiting[-1][2] <= end:
            waiting.pop()
        return waiting[-1][1] + math.log10(end - waiting[-1][0]) if waiting else math.inf


def guess_cost(value: str, words: dict[str, int] | None = None) -> float:
    """Log10 of the guesses that the cheapest segmentation of ``value`` takes, over
    ``COMMON`` and ``words`` (word to rank), or over ``known_words`` without any. Walks, sequences and
    repeats may begin and end anywhere; time grows in proportion to length, but for a logarithm."""
    ranks = known_words() if words is None else {w: i + 1 for i, w in enumerate(COMMON)} | words
    heads = known_heads() if words is None else {w[:3] for w in ranks}
    n, low = len(value), "".join([c.lower() if c.isascii() else c for c in value])
    longest = known_length() if words is None else max(map(len, ranks))
    plain = low.translate(LEET)
    brute = math.log10(max(10, _alphabet(value)))
    # the smallest cost of value[:i], with the choice of a cut there
    best, begun = [0.0] + [math.inf] * n, [0.0] * (n + 1)
    cut_cost = math.log10(max(2, n))
    steps = [ord(b) - ord(a) for a, b in zip(value, value[1:])]
    ways = [(PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1]) if b in NEAR.get(a, ()) else None for a, b in zip(low, low[1:])]
    turned = [0.0] * (n + 1)  # cost of the turns of a walk up to here
    for k in range(1, len(ways)):
        turned[k] = turned[k - 1] + (0.7 if ways[k] is not None and ways[k - 1] is not None and ways[k] != ways[k - 1] else 0.0)
    walk, row = Ends(), Ends()
    periods = [(period, max(3, 2 * period), Ends()) for period in range(1, 9)]
    same = [0] * 9  # how many characters up to here are those of a period before
    open_brute = math.inf  # cost of a prefix that ends within a brute-force part
    for i in range(n):
        begun[i] = start = best[i] + (cut_cost if i else 0.0)
        for form, extra in ((low, 0.0), (plain, 0.5)):
            if form[i : i + 3] in heads:
                for j in range(i + 3, min(n, i + longest) + 1):
                    rank = ranks.get(form[i:j])
                    if rank:
                        shown = value[i:j]
                        cost = math.log10(rank + 1) + extra + (0.0 if shown == shown.lower() else 0.3 if shown[1:] == shown[1:].lower() or shown.isupper() else 1.0)
                        best[j] = min(best[j], start + cost)
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, j):
                    best[j] = min(best[j], start + (2.1 if j - i == 4 else 4.6))
        open_brute = min(open_brute, start) + brute
        j = i + 1  # parts of any length that end here
        found = min(best[j], open_brute)
        if i >= 2 and ways[i - 1] is not None and ways[i - 2] is not None:  # keyboard walk
            walk.add(i - 2, begun[i - 2] - turned[i - 2], j)
            found = min(found, math.log10(47) + turned[i - 1] + walk.least(j))
        else:
            walk.clear()
        if i >= 2 and steps[i - 1] == steps[i - 2] and abs(steps[i - 1]) == 1:  # sequence
            row.add(i - 2, begun[i - 2], j)
            found = min(found, 1.4 + row.least(j))
        else:
            row.clear()
        for period, least, ends in periods:  # repeats
            if i < period or value[i] != value[i - period]:
                same[period] = 0
                ends.clear()
                continue
            same[period] += 1
            if same[period] >= least - period:
                ends.add(j - least, begun[j - least], j)
                found = min(found, period * brute - math.log10(period) + ends.least(j))
        best[j] = found
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, kind by number."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if HEX_RUN in text.encode("utf-8", "replace").translate(HEX_MARKS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spans(text: str) -> list[tuple[int, int, int]]:
    """The base spans and the values of high guess cost, in order."""
    found = base_spans(text)
    low = text.lower()
    if any(mark in low for mark in CONTEXT_MARKS):
        base = list(found)
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            value = text[start:end].rstrip(".!?)]}")
            end = start + len(value)
            if len(value) >= 8 and not any(a <= start and end <= b for a, _, b in base) and guess_cost(value) >= MIN_GUESSES:
                found.append((start, 3, end))
    return sorted(found)


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in texts(batch, "text"):
            found = spans(text)
            counts = [sum(k == i for _, k, _ in found) for i in range(4)]
            base = shown([x for x in found if x[1] < 3])
            out.append((*counts, hashlib.sha256(base.encode()).hexdigest(), shown(found)))
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in SPANS.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """The spans of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, SPANS)


def masked(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every span, overlaps joined, replaced by ``mark``."""
    out, done, open_ = [], 0, None
    for a, _, b in spans(text):
        if open_ is not None and a < open_:
            open_ = done = max(open_, b)
            continue
        out += [text[done:a], mark]
        open_ = done = b
    return "".join([*out, text[done:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        column = pa.array([None if t is None else masked(t) for t in batch.column(at).to_pylist()], pa.string())
        yield batch.set_column(at, "text", column)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; columns as they were."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(_mask, rows.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
