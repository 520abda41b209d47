"""Language identification: script ranges, then Viterbi over per-word scores.

Words are runs of letters; a run of over ``SCORED`` letters or of several scripts, as in unspaced text, is
cut into pieces that each count as a word, in spans too. The script of a word, from ranges of code points, leaves only the
languages that were seen with that script in training. Each of these scores the word by the mean
log-probability of its letter 1- to 3-grams (with word ends), bounded from below. Over a document's
words, Viterbi finds the sequence of languages of highest total score less ``SWITCH`` for each change of
language, so a lone borrowed word doesn't make a span but a quoted passage does. The document's language
is the one with most letters in its spans, and its score that share of letters, weighted by how far the
words' scores bear it out.

Words are found alike in training and prediction: maximal runs of letters of the lower-cased text. The model is
sparse: of an n-gram, only the languages that have it. It has every language and every n-gram of the sample; one that would
be too large to be sent to the tasks is an error.

Edge cases: null texts and texts without letters are ``und`` with score 0, as is every text if nothing
could be learned; words in a script never seen in training leave all languages open and no
preference; ties go to the alphabetically first language; repeated rows, null ids and other columns change nothing;
an empty table gives an empty one. Whole texts are read and all their letters scored, in batches of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.batches import TEXT_BYTES, bounded, text_slices
from larkspur.sources.storage import discard, stored, table

#: Labelled documents per language that the model is fitted on, chosen by a hash of the id.
SAMPLE_DOCS = 3_000
#: N-grams of all languages together that a model may have, of 16 bytes each; four languages have about 120,000. More is an error, never a smaller model.
MODEL_GRAMS = 25_000_000
#: Languages that can be learned; their rates are broadcast. More labels than this are an error too.
LANGUAGES = 100_000
#: Score that a change of language costs, in nats.
SWITCH = 6.0
#: Bounds of a word's score against the best language's.
WORST = -4.0
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.02
UNKNOWN = "und"

# First and last code points of letters by script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x9FFF),),
}
_BOUNDS = sorted((a, b, name) for name, ranges in SCRIPTS.items() for a, b in ranges)
_STARTS = np.array([a for a, _, _ in _BOUNDS])
NO_LETTERS = r"[^\p{L}]+"
#: Documents whose language scores less, so that under this share of their letters bears it out, aren't identified (``keep_identified``).
LEAST_SCORE = 0.3


class Model(NamedTuple):
    languages: list[str]
    scripts: np.ndarray  # script (the last row: none) by language: whether the language has it
    keys: np.ndarray  # sorted n-grams as numbers
    starts: np.ndarray  # where each n-gram's entries begin, and their number last
    of: np.ndarray  # an entry's language
    gains: np.ndarray  # an entry's log-probability less that of an n-gram the language doesn't have
    missing: np.ndarray  # the latter, by language


_NAMES = [*SCRIPTS, "other"]
_SCRIPT = np.array([_NAMES.index(name) for _, _, name in _BOUNDS])
_LAST = np.array([b for _, b, _ in _BOUNDS])
#: Letters of a word that are scored; longer runs of letters are several words.
SCORED = 40
#: Letters that are cut into pieces at once.
PIECE = 1 << 16


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point, as a place in the list of scripts; the last is none of them."""
    k = np.searchsorted(_STARTS, points, side="right") - 1
    return np.where((k >= 0) & (points <= _LAST[k]), _SCRIPT[k], len(_NAMES) - 1)


#: Words that stay whole: short ones of one script.
_PLAIN = re.compile("|".join(f"[{''.join(f'{chr(a)}-{chr(b)}' for a, b in ranges)}]{{1,{SCORED}}}" for ranges in SCRIPTS.values()))


def _cut(run: str) -> list[str]:
    """A run of letters in pieces of one script and at most SCORED letters; letters of no script go with those before."""
    script = scripts_of(np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
    at = np.arange(len(run))
    known = np.flatnonzero(script < len(_NAMES) - 1)
    first = np.zeros(len(run), bool)
    first[0] = True
    first[known[1:][script[known[1:]] != script[known[:-1]]]] = True
    first |= (at - np.maximum.accumulate(np.where(first, at, 0))) % SCORED == 0
    cuts = [*np.flatnonzero(first).tolist(), len(run)]
    return [run[a:b] for a, b in zip(cuts, cuts[1:])]


def pieces(word: str) -> list[str]:
    """The word, or its pieces if it has over SCORED letters or several scripts."""
    if _PLAIN.fullmatch(word):
        return [word]
    return [x for i in range(0, len(word), PIECE) for x in _cut(word[i : i + PIECE])]


def gram_key(gram: str) -> int:
    """One to three code points as one number."""
    return sum(ord(c) << (21 * i) for i, c in enumerate(gram))


def grams(word: str) -> list[str]:
    """Its letters, and the pairs and triples of letters and word ends."""
    held = f"^{word}$"
    return [held[i : i + n] for n in (1, 2, 3) for i in range(len(held) - n + 1) if n > 1 or 0 < i < len(held) - 1]


def gram_of(key: int) -> str:
    return "".join(chr(key >> (21 * i) & 0x1FFFFF) for i in range(3) if key >> (21 * i))


class Held:
    """Words, cut after SCORED letters, between ``^`` and ``$`` as one array of code points."""

    def __init__(self, words: list[str]):
        cut = [w[:SCORED] for w in words]
        self.points = np.frombuffer("".join(f"^{w}$" for w in cut).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.size = np.array([len(w) for w in cut])
        self.starts = np.cumsum(self.size + 2) - (self.size + 2)
        self.left = np.repeat(self.starts + self.size + 1, self.size + 2) - np.arange(len(self.points))  # places to the word's end
        self.inner = self.left > 0
        self.inner[self.starts] = False
        script = scripts_of(np.where(self.inner, self.points, 0))
        first = np.minimum.reduceat(np.where(self.inner & (script < len(_NAMES) - 1), np.arange(len(self.points)), len(self.points)), self.starts)
        self.script = np.append(script, len(_NAMES) - 1)[first]  # of a word's first letter that has one

    def keys(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the 1-, 2- and 3-grams that begin at each place, and whether there is one."""
        p = self.points
        after, later = np.r_[p[1:], 0], np.r_[p[2:], 0, 0][: len(p)]
        return [(p, self.inner), (p | after << 21, self.left >= 1), (p | after << 21 | later << 42, self.left >= 2)]


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words and pieces, and for each in all the texts, in order, its place among these and its text."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), NO_LETTERS)
    words, parents = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(words, "")
    words, parents = words.filter(real), parents[real.to_numpy(zero_copy_only=False)]
    if not len(words):
        return [], np.zeros(0, np.int64), parents
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    cut = [pieces(w) for w in distinct]
    if len(distinct) < sum(map(len, cut)):
        count = np.array([len(x) for x in cut])
        place: dict[str, int] = {}
        codes = np.array([place.setdefault(x, len(place)) for own in cut for x in own])
        each, distinct = count[code], list(place)
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        code = codes[np.repeat((np.cumsum(count) - count)[code], each) + within]
        parents = np.repeat(parents, each)
    return distinct, code, parents


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4; 2 is held out of all training. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def training_rows(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """``text, lang`` of at most about ``per_language`` labelled documents per language outside the held-out fold."""
    usable = bounded(docs).select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2))
    counts = stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if counts.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    rates = counts.select("lang", (F.lit(float(per_language)) / F.col("n")).alias("rate"))
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return usable.join(F.broadcast(rates), "lang").filter(drawn < F.col("rate")).select("text", "lang")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for part in text_slices(batches):
        distinct, code, parents = split_words(part.column("text"))
        if not distinct:
            continue
        of_text = part.column("lang").dictionary_encode()
        both, n = np.unique(parents.astype(np.int64) * len(distinct) + code, return_counts=True)
        lang = of_text.indices.to_numpy(zero_copy_only=False).astype(np.int64)[both // len(distinct)]
        own, at = np.unique(lang * len(distinct) + both % len(distinct), return_inverse=True)
        total, langs = np.bincount(at, weights=n), of_text.dictionary.to_pylist()
        seen.update({(langs[x // len(distinct)], distinct[x % len(distinct)]): k for x, k in zip(own.tolist(), total.astype(int).tolist())})
    by_lang: dict[str, tuple[list[str], list[int]]] = {}
    for (lang, word), n in seen.items():
        words, ns = by_lang.setdefault(lang, ([], []))
        words.append(word)
        ns.append(n)
    rows: list[tuple[str, str, str, int]] = []
    for lang, (words, ns) in by_lang.items():
        counts: Counter = Counter()
        scripts: Counter = Counter()
        for i in range(0, len(words), 50_000):
            some, n = Held(words[i : i + 50_000]), np.array(ns[i : i + 50_000])
            for script, letters in zip(some.script.tolist(), (n * [len(w) for w in words[i : i + 50_000]]).tolist()):
                scripts[_NAMES[script]] += letters
            each = np.repeat(n, some.size + 2)
            for key, use in some.keys():
                distinct, at = np.unique(key[use], return_inverse=True)
                counts.update(dict(zip(distinct.tolist(), np.bincount(at, weights=each[use]).astype(int).tolist())))
        rows += [(lang, "script", k, n) for k, n in scripts.items()] + [(lang, "gram", gram_of(k), n) for k, n in counts.items()]
    for i in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[i : i + 50_000]), [pa.string()] * 3 + [pa.int64()])], names=["lang", "kind", "item", "n"])


def fit(docs: DataFrame) -> Model:
    """The model; a ValueError if it has more than ``MODEL_GRAMS`` n-grams."""
    counted = training_rows(docs).mapInArrow(_counted, "lang string, kind string, item string, n long")
    counted = stored(counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "grams")
    totals = {(r.lang, r.kind): (r.n, r.kinds) for r in counted.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
    if (size := sum(kinds for _, kinds in totals.values())) > MODEL_GRAMS:
        raise ValueError(f"a model of {size} n-grams; take fewer documents per language, or fewer languages")
    rows = counted.collect()
    discard(counted)
    return model_of(totals, [(r.lang, r.kind, r.item, r.n) for r in rows])


def model_of(totals: dict[tuple[str, str], tuple[int, int]], rows: list[tuple[str, str, str, int]]) -> Model:
    """From totals and kinds of n-grams and script letters per language, and their most frequent items."""
    languages = sorted({lang for lang, _ in totals})
    at = {lang: i for i, lang in enumerate(languages)}
    size = np.array([sum(totals.get((lang, "gram"), (0, 0))) + 1.0 for lang in languages])
    scripts = np.zeros((len(_NAMES), len(languages)), bool)
    for lang, kind, item, n in rows:
        if kind == "script" and n >= SCRIPT_SHARE * totals[lang, "script"][0]:
            scripts[_NAMES.index(item), at[lang]] = True
    own = [(gram_key(item), at[lang], n) for lang, kind, item, n in rows if kind == "gram"]
    key, of, n = (np.array(x, np.int64) for x in zip(*own)) if own else np.zeros((3, 0), np.int64)
    order = np.lexsort((of, key))
    keys, starts = np.unique(key[order], return_index=True)
    missing = np.log(0.5 / size)
    gains = (np.log((n + 0.5) / size[of]) - missing[of])[order]
    return Model(languages, scripts, keys, np.r_[starts, len(key)], of[order].astype(np.int32), gains.astype(np.float32), missing)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """For each word, a score per language: 0 for the best, down to WORST; twice that where the script rules it out."""
    step = max(1, 200_000 // max(4, len(model.languages)))
    out = [_some_scores(words[i : i + step], model) for i in range(0, len(words), step)]
    return np.concatenate(out) if out else np.zeros((0, len(model.languages)), np.float32)


def _some_scores(words: list[str], model: Model) -> np.ndarray:
    held, k = Held(words), len(model.languages)
    word = np.repeat(np.arange(len(words)), held.size + 2)
    total = ((3 * held.size + 1)[:, None] * model.missing).ravel()
    for key, use in held.keys():
        key, of_word = key[use], word[use]
        place = np.searchsorted(model.keys, key)
        found = np.append(model.keys, -1)[place] == key
        place, of_word = place[found], of_word[found]
        n = model.starts[place + 1] - model.starts[place]
        entry = np.arange(n.sum()) + np.repeat(model.starts[place] - (np.cumsum(n) - n), n)
        total += np.bincount(np.repeat(of_word * k, n) + model.of[entry], weights=model.gains[entry], minlength=len(total))
    score = total.reshape(len(words), k) / (3 * held.size + 1)[:, None] * np.minimum(np.array([len(w) for w in words]) + 1, 6)[:, None]
    open_ = model.scripts[held.script]
    none = ~open_.any(axis=1)
    score = np.where(open_, score, -np.inf)
    best = np.where(none, 0.0, score.max(axis=1))
    score = np.maximum(score - best[:, None], np.where(open_, WORST, 2 * WORST))
    return np.where(none[:, None], 0.0, score).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; ``scores`` holds the documents' words one after another.

    All documents advance together, word by word, the longest ones last.
    """
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    longest = lengths[order]
    came = np.empty((n, k), np.uint8 if k < 256 else np.uint16)
    steps = int(longest[0]) if len(longest) else 0
    # Documents still running at step t: all whose length is over t.
    running = np.searchsorted(-longest, -np.arange(steps), side="left")
    value = scores[first[: running[0]]].astype(np.float64) if steps else np.zeros((0, k))
    last = np.zeros(len(lengths), came.dtype)
    own = np.arange(k, dtype=came.dtype)
    for t in range(1, steps):
        m = running[t]
        if m < len(value):
            last[m : len(value)] = value[m:].argmax(axis=1)
            value = value[:m]
        best = value.argmax(axis=1)
        changed = value[np.arange(m), best] - switch
        stay = value >= changed[:, None]
        row = first[:m] + t
        came[row] = np.where(stay, own, best[:, None].astype(came.dtype))
        value = np.where(stay, value, changed[:, None]) + scores[row]
        value -= value.max(axis=1, keepdims=True)
    last[: len(value)] = value.argmax(axis=1)
    path = np.empty(n, came.dtype)
    state = last
    for t in range(steps - 1, -1, -1):
        m = running[t]
        row = first[:m] + t
        path[row] = state[:m]
        if t:
            state[:m] = came[row, state[:m]]
    return path


def labelled(texts: pa.Array, model: Model, with_spans: bool = True) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and spans (``lang, start, words``) of every text."""
    k, n = len(model.languages), len(texts)
    distinct, code, parents = split_words(texts)
    if not k or not distinct:
        return [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
    table_ = word_scores(distinct, model)
    sizes = np.array([len(w) for w in distinct])[code]
    scores = table_[code]
    lengths = np.bincount(parents, minlength=n)
    path = viterbi(scores, lengths)
    letters = np.bincount(parents * k + path, weights=sizes, minlength=n * k).reshape(n, k)
    total = np.maximum(letters.sum(axis=1), 1)
    best = letters.argmax(axis=1)
    # How far the words of the chosen language's spans bear it out: 1 if it is the best for each.
    mine = path == best[parents]
    support = np.exp(np.minimum(scores[np.arange(len(path)), path], 0.0).astype(float))
    borne = np.bincount(parents[mine], weights=(support * sizes)[mine], minlength=n)
    starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (parents[1:] != parents[:-1])])
    widths = np.diff(np.r_[starts, len(path)])
    begins = np.cumsum(lengths) - lengths
    spans: list[list[dict]] = [[] for _ in range(n)]
    for a, w in zip(starts.tolist(), widths.tolist()) if with_spans else ():
        spans[parents[a]].append({"lang": model.languages[path[a]], "start": a - int(begins[parents[a]]), "words": w})
    langs = [model.languages[b] if w else UNKNOWN for b, w in zip(best.tolist(), lengths.tolist())]
    return langs, np.where(lengths > 0, np.clip(borne / total, 0, 1), 0.0).tolist(), spans


def _slices(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Slices that are the smaller, the more languages each of their words has a score in."""
    return text_slices(batches, limit=TEXT_BYTES * 8 // max(8, len(model.languages)))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` of every row."""
    model = fit(docs) if model is None else model
    given = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_GRAMS entries
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, given.value):
            langs, scores, spans = labelled(part.column("text"), given.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<lang:string,start:long,words:long>>")


def keep_identified(docs: DataFrame, languages: Sequence[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is identified, one of ``languages`` if given, with the label as ``lang`` where that is null.

    Rejected are texts without letters, and those that no language bears out (a score under ``least``). If no language could be
    learned, that of texts with letters is unknown: they stay as they are.
    """
    model = fit(docs)
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def found(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        if not given.value.languages:
            some = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_pylist()
            langs, scores = ["" if x else UNKNOWN for x in some], [1.0] * len(some)
        else:
            for part in _slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), given.value):
                own, score, _ = labelled(part.column("text"), given.value, False)
                langs, scores = langs + own, scores + score
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    rows = bounded(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), found.asNondeterministic()(F.col("text").cast("string")).alias("found"))
    kept = rows.filter((F.col("found.lang") != UNKNOWN) & (F.col("found.score") >= least))
    if languages is not None:
        kept = kept.filter(F.col("found.lang").isin(list(languages)))
    label = F.coalesce(F.col("doc.lang"), F.nullif(F.col("found.lang"), F.lit("")))
    return kept.select(*((label.cast(docs.schema[c].dataType) if c == "lang" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
