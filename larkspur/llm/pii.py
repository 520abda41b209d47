"""Personal data by weak supervision.

Strict patterns (the base) and broader ones propose spans of four kinds. Five labelers vote on each
span: +1 personal, -1 not, 0 no opinion. They are the strict pattern with its checks, the span's
shape, a gazetteer, words that speak for it just before it, and signs that speak against it around
it. Votes are counted over the whole corpus, per kind and combination of votes; there are at most
4 * 3**5 combinations, whatever the corpus. Expectation-maximisation on these counts estimates how
reliable each labeler is and how likely each combination is personal data. These are the soft labels that a
logistic model of whole spans is trained on: besides the votes it sees a span's length, letters, digits and
signs, and the words around it (hashed), so spans of equal votes can differ. It is trained on at most ``SAMPLE`` distinct spans of each
combination, weighted by the combination's count, and its decisions add broad spans to the strict ones. All candidates vote; only of
accepted ones that overlap does one stay, the most probable.

Edge cases: a null text counts as empty and has no spans; rows that repeat an id are scanned each for
itself; null ids and other columns pass through; a corpus without any candidate accepts nothing and
an empty table gives an empty one. Scans are linear in the text but for bounded look-back, however long it is.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.batches import bounded, text_slices
from larkspur.sources.storage import stored, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "shape", "gazetteer", "context", "against")
#: Characters before and after a span that context labelers read.
AROUND = 48
#: A broad span is accepted from this probability on.
ACCEPT = 0.5

#: Spans of each combination of votes that the classifier is trained on, those of the smallest hashes of span and context.
SAMPLE = 64
#: Buckets of the words before and after a span.
BUCKETS = (32, 16)

# Patterns, gazetteers and context words.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BROAD_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63})+")
BROAD_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
BROAD_PHONE = re.compile(r"(?<![0-9])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
TOP_DOMAINS = frozenset("com org net edu gov info biz io de fr es uk it nl eu us ca ch at be au jp".split())
CALLING_CODES = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 98".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "2221", "30", "36", "38")
CONTEXT = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "address", "server", "client"),
    "card": ("card", "visa", "mastercard", "credit", "amex"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
}
AGAINST = ("version", "isbn", "order", "serial", "part no", "build", "doi", "issue")


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, passed, at = 0, 0, text.find("@")
    while at >= 0:
        from_ = max(last, passed)  # no name has an @, so nothing is looked at twice
        start = from_ + len(text[from_:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        passed = at + 1
        at = text.find("@", max(passed, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the strict patterns, sorted; kinds are places in KINDS."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and int(p) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def broad_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, leftmost first, that overlap no base span; they may overlap each other."""
    found = []
    if "(at)" in text.lower() or "[at]" in text.lower():
        found += [(m.start(), 0, m.end()) for m in BROAD_EMAIL.finditer(text)]
    if text.count(":") >= 7:
        found += [(m.start(), 1, m.end()) for m in BROAD_IP.finditer(text)]
    if re.search("[0-9]", text):
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 40 and 12 <= len(_digits(m[0])) <= 19:
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in BROAD_PHONE.finditer(text)]
    if not found:
        return []
    kept, taken = [], sorted((a, b) for a, _, b in base)
    reach, i = 0, 0
    for a, kind, b in sorted(found):
        while i < len(taken) and taken[i][0] < b:
            reach, i = max(reach, taken[i][1]), i + 1
        if a >= reach:
            kept.append((a, kind, b))
    return kept


def votes(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, ...]:
    """One vote of each labeler in LABELERS."""
    span, name = text[start:end], KINDS[kind]
    before, after = text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    digits = _digits(span)
    if name == "email":
        shape = 1 if 5 <= len(span) <= 254 and ".." not in span else -1
        top = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        gazetteer = 1 if top in TOP_DOMAINS or re.sub(r".*?([a-z0-9-]+)\W*$", r"\1", span[-80:].lower()) in TOP_DOMAINS else 0
    elif name == "ip":
        parts = span.split(".")
        shape = -1 if parts[0].lstrip("0") == "" or any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        gazetteer = 0 if ":" in span else 1 if 0 < int(parts[0][-3:]) < 224 else -1
    elif name == "card":
        shape = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        gazetteer = 1 if digits.startswith(CARD_STARTS) else -1
    else:
        shape = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = 1 if span[0] == "+" and digits.startswith(CALLING_CODES) else 0
    near = 1 if any(w in before for w in CONTEXT[name]) else 0
    glued = before[-1:].isalnum() or after[:1].isalnum()
    against = -1 if glued or any(w in before[-16:] for w in AGAINST) else 0
    return (1 if strict else 0, shape, gazetteer, near, against)


COMBINATIONS = list(product(range(len(KINDS)), *[(-1, 0, 1)] * len(LABELERS)))
_CODE = {c: i for i, c in enumerate(COMBINATIONS)}


def coded(text: str, span: tuple[int, int, int], strict: bool) -> int:
    """The combination of kind and votes as a place in COMBINATIONS."""
    start, kind, end = span
    return _CODE[kind, *votes(text, start, kind, end, strict)]


_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = " .-()+:@"
_LENGTHS = range(7, 20)
WIDTH = 1 + 2 * len(LABELERS) + 7 + len(_SIGNS) + len(_LENGTHS) + sum(BUCKETS)


def features(text: str, span: tuple[int, int, int], strict: bool) -> np.ndarray:
    """What the classifier sees of a span, each number between 0 and 1; of length ``WIDTH``."""
    start, kind, end = span
    own, cast = text[start:end], votes(text, start, kind, end, strict)
    before, after = text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    digits, n = sum(map(str.isdigit, own)), max(1, len(own))
    out = [1.0, *(float(v == x) for v in cast for x in (-1, 1))]
    out += [min(n, 64) / 64, digits / n, sum(map(str.isalpha, own)) / n, min(len(re.findall("[0-9]+", own)), 8) / 8, float(own[:1].isdigit()), float(before[-1:].isalnum()), float(after[:1].isalnum())]
    out += [float(c in own) for c in _SIGNS] + [float(digits == k) for k in _LENGTHS]
    for words, size in ((_WORD.findall(before), BUCKETS[0]), (_WORD.findall(after), BUCKETS[1])):
        bag = [0.0] * size
        for w in words:
            bag[zlib.crc32(w.encode("utf-8", "surrogatepass")) % size] = 1.0
        out += bag
    return np.array(out, np.float32)


class SpanModel(NamedTuple):
    """A logistic model of whole spans, with weights of its own for each kind."""

    weights: np.ndarray  # kind by feature

    def __call__(self, text: str, span: tuple[int, int, int]) -> float | None:
        """The probability that a broad span is personal data, if it is accepted."""
        p = 1 / (1 + math.exp(-float(np.clip(self.weights[span[1]] @ features(text, span, False), -50, 50))))
        return p if p >= ACCEPT else None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``code, n`` of the partition's combinations, and ``code, hash, features`` of their ``SAMPLE`` spans of smallest hash."""
    totals: Counter = Counter()
    kept: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
    highest: dict[int, int] = {}
    for part in text_slices(batches):
        for x in part.column("text"):
            text = x.as_py() or ""
            base = base_spans(text)
            for strict, spans in ((True, base), (False, broad_spans(text, base))):
                for span in spans:
                    code = coded(text, span, strict)
                    totals[code] += 1
                    context = text[max(0, span[0] - AROUND) : span[2] + AROUND].encode("utf-8", "surrogatepass")
                    at = xxhash.xxh64_intdigest(context, code) >> 1
                    own = kept[code]
                    if at not in own and (len(own) < SAMPLE or at < highest[code]):
                        if len(own) == SAMPLE:
                            del own[highest[code]]
                        own[at] = features(text, span, strict)
                        highest[code] = max(own)
    rows = [(code, n, None, None) for code, n in totals.items()]
    rows += [(code, None, at, x) for code, own in kept.items() for at, x in own.items()]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float32()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["code", "n", "hash", "features"])


def vote_counts(docs: DataFrame) -> pd.DataFrame:
    """``code, n`` over all rows, and ``features`` of sampled spans, a list of vectors.

    At most ``len(COMBINATIONS)`` rows and ``SAMPLE`` spans for each reach the driver. Samples of partitions are cut
    to the smallest hashes in two steps, so no task gets those of all partitions.
    """
    counted = bounded(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "code int, n long, hash long, features array<float>")
    counted = stored(counted, "votes")
    counts = counted.filter("n IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    spans = counted.filter("hash IS NOT NULL").groupBy("code", "hash").agg(F.first("features").alias("features")).withColumn("part", F.col("hash") % 1024)
    for by in (("code", "part"), ("code",)):
        spans = spans.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("hash"))).filter(F.col("place") <= SAMPLE)
    found: dict[int, list] = defaultdict(list)
    for r in spans.select("code", "hash", "features").collect():
        found[r.code].append((r.hash, r.features))
    counts["features"] = [[x for _, x in sorted(found[c])] for c in counts.code]
    return counts


def reliabilities(counts: pd.DataFrame, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: P(personal | combination) and P(vote | class, labeler).

    Classes start from the majority of votes; one pseudo-vote keeps probabilities inside (0, 1).
    """
    votes_of = np.array([COMBINATIONS[c][1:] for c in counts.code], int).reshape(-1, len(LABELERS))
    n = counts.n.to_numpy(float)
    belief = 1 / (1 + np.exp(-votes_of.sum(axis=1).astype(float)))
    given = np.full((2, len(LABELERS), 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - belief) * n, belief * n])
        prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        for vote in (-1, 0, 1):
            given[:, :, vote + 1] = weight @ (votes_of == vote) + 1
        given /= given.sum(axis=2, keepdims=True)
        logs = np.log(prior)[:, None] + np.stack([np.log(given[k][np.arange(len(LABELERS)), votes_of + 1]).sum(axis=1) for k in (0, 1)])
        belief = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return belief, given


def logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray, decay: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Newton's method for soft labels; weights add up to 1."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - label)) + decay * w
        curve = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + decay * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def fit(counts: pd.DataFrame) -> SpanModel | dict[int, float]:
    """The classifier, trained on the soft labels of sampled spans.

    Without a column ``features``, one of votes alone: the codes that it accepts, with their probabilities.
    """
    if not len(counts):
        return {}
    counts = counts.sort_values("code")
    belief, _ = reliabilities(counts)
    combos, n = np.array([COMBINATIONS[c] for c in counts.code], int), counts.n.to_numpy(float)
    if "features" not in counts:
        seen = np.concatenate([combos[:, :1] == np.arange(len(KINDS))] + [combos[:, k : k + 1] == v for k in range(1, combos.shape[1]) for v in (-1, 1)], axis=1).astype(float)
        p = 1 / (1 + np.exp(-seen @ logistic(seen, belief, n / n.sum())))
        return {int(c): float(x) for c, x in zip(counts.code, p) if x >= ACCEPT}
    weights = np.zeros((len(KINDS), WIDTH))
    for kind in set(combos[:, 0]):
        rows = [(x, belief[i], n[i] / len(own)) for i, own in enumerate(counts.features) if combos[i, 0] == kind for x in own]
        x, label, weight = (np.array(a, float) for a in zip(*rows))
        weights[kind] = logistic(x, label, weight / weight.sum())
    return SpanModel(weights)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def settled(found: list[tuple[float, tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
    """Of spans with probabilities, those that overlap none of the more probable ones kept; ties go to the leftmost."""
    kept: list[tuple[int, int, int]] = []
    for _, span in sorted(found, key=lambda x: (-x[0], x[1])):
        i = bisect.bisect(kept, span)
        if (not i or kept[i - 1][2] <= span[0]) and (i == len(kept) or span[2] <= kept[i][0]):
            kept.insert(i, span)
    return kept


def all_spans(text: str, accepted: SpanModel | dict[int, float]) -> tuple[list, list]:
    """Base spans, and these with the accepted broad ones."""
    base = base_spans(text)
    judge = accepted if callable(accepted) else lambda text, span: accepted.get(coded(text, span, False))
    voted = [(judge(text, s), s) for s in broad_spans(text, base)]
    return base, sorted(base + settled([(p, s) for p, s in voted if p is not None]))


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row."""
    accepted = fit(vote_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            counts, digests, spans = [], [], []
            for x in part.column("text"):
                base, every = all_spans(x.as_py() or "", accepted)
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            by_kind = [pa.array(np.array(counts, np.int64)[:, k]) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *by_kind, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns; in ``text``, each span is replaced by its kind, as in ``<EMAIL>``.

    Overlapping spans are replaced together, under the first one's kind; a null text stays null.
    """
    accepted = fit(vote_counts(docs))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for a, kind, b in all_spans(text, accepted)[1]:
                if a >= at:
                    out += [text[at:a], f"<{KINDS[kind].upper()}>"]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return bounded(docs).withColumn("text", clean(F.col("text")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
