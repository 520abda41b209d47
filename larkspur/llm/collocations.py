"""Phrases of up to ``DEPTH`` words that occur together more than their parts would have it, by language.

A shard is the texts of a task, up to ``SHARD_BYTES`` at a time. Its words are found and numbered by whole arrays of bytes, and a
generalised suffix automaton of its pieces, cut at ``DEPTH`` words, is built level by level: transitions lead from a distinct run
of words of one language by a word to the next level, its endpos count is how often it ends somewhere, and its link leads to
the run without the first word. Where a link keeps the count, both end at the same places and are one state, which is listed once, by its
longest run and the length of its shortest. Spark takes the runs of the states apart again and adds up the counts of all shards.

Most runs are rare, so a first scan counts words and pairs in hash counters, each shard as one sorted list per
slice of counters. A counter below ``LEAST`` proves that all its runs are below it. A second scan counts triples likewise, of words and pairs
that reached it. The third scan's automaton reads only such words and follows transitions only where the pair's and the triple's
counters reached it; what it lists goes by its text, not by its hash, so results are exact. There is a counter for every ``PER_COUNTER`` bytes of text, up to
``2**MOST_BITS``; broadcast is one bit of each, so 256 MB at most. In a larger corpus fewer runs are ruled out, and results are the same.

Scores are the least over all cuts of a phrase, in decimals of 38 digits. A longer phrase is followed along its
suffix link and its prefix to the phrases inside it: as counts only fall with length, a phrase is
subsumed if a phrase longer by one word is frequent enough.

Edge cases: null texts are empty, null languages ``und``; texts of any length are read whole, rows that repeat count as often;
words may be any bytes but blanks and signs that end a piece; no rows or nothing frequent give no phrases; other columns are ignored; ties end with
the phrase itself, so no two rows of a language compare equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.batches import bounded, returned, text_slices
from larkspur.sources.storage import discard, stored, table

DEPTH = 4
#: Occurrences of a phrase.
LEAST = 30
#: A phrase is subsumed by a longer one with this share, in hundredths, of its occurrences.
SUBSUMED = 80
#: Phrases of a language.
FIRST = 2_000
SHARD_BYTES = 8 << 20
#: Bytes of text for each counter, the most and the fewest counters and those of one slice (powers of two).
PER_COUNTER, MOST_BITS, FEWEST_BITS, SLICE = 32, 31, 20, 16

# Signs that end a piece, blanks between words, and the scale of scores.
ENDS, BLANKS, SCALE = b".,;:!?\n\x0b\x0c\r", b" \t", 2_000_000
_WORD, _BLANK, _END = 0, 1, 2
_KIND = np.full(256, _WORD, np.uint8)
_KIND[list(BLANKS)], _KIND[list(ENDS)] = _BLANK, _END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words(NamedTuple):
    """The words of a shard in order: the number of each in ``names``, and whether it begins a piece."""

    names: pa.Array
    code: np.ndarray
    begins: np.ndarray
    of_text: np.ndarray


def words(texts: pa.Array) -> Words:
    """Lower-cased words of whole texts."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())  # offsets of 64 bits
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = _KIND[raw]
    is_word = kind == _WORD
    first = np.r_[True, ~is_word[:-1]] if len(raw) else np.zeros(0, bool)
    first[ends[:-1][ends[:-1] < len(raw)]] = True
    starts = np.flatnonzero(is_word & first)
    last = np.r_[~is_word[1:], True] if len(raw) else np.zeros(0, bool)
    last[ends[1:][ends[1:] > 0] - 1] = True
    sizes = np.flatnonzero(is_word & last) + 1 - starts
    of_text = np.searchsorted(ends, starts, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == _END), starts)
    begins = np.r_[True, (np.diff(piece) != 0) | (np.diff(of_text) != 0)] if len(starts) else np.zeros(0, bool)
    letters = _LOWER[raw[is_word]]
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))  # numbers in the order of words, so that what is listed is in order too
    return Words(found.dictionary.take(pa.array(order)), rank[found.indices.to_numpy(zero_copy_only=False)], begins, of_text)


class Level(NamedTuple):
    """Runs of one length: ``at`` has the run of every place (-1: none), of each run its count, link, parent and last word."""

    at: np.ndarray
    count: np.ndarray
    link: np.ndarray
    parent: np.ndarray
    last: np.ndarray


def roots(symbol: np.ndarray) -> Level:
    """Runs of one word, by symbol; places of -1 have none."""
    count = np.bincount(symbol[symbol >= 0], minlength=int(symbol.max(initial=-1)) + 1)
    own = np.arange(len(count))
    return Level(symbol, count, np.full(len(count), -1), np.full(len(count), -1), own)


def grown(level: Level, one: Level, begins: np.ndarray, depth: int, allowed: np.ndarray | None = None) -> Level:
    """The runs a transition further; ``allowed`` has the places where the transition to ``depth`` words may be taken."""
    n = len(level.at)
    at = np.full(n, -1)
    if n < depth:
        return Level(at, *(np.zeros(0, np.int64) for _ in range(4)))
    near, following = level.at[: n - depth + 1], one.at[depth - 1 :]
    open_ = (near >= 0) & (following >= 0) & ~begins[depth - 1 :]
    if allowed is not None:
        open_ &= allowed[depth - 1 :]
    place = np.flatnonzero(open_)
    key = near[place] * np.int64(len(one.count)) + following[place]
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(key)])
    state = np.empty(len(key), np.int64)
    state[order] = np.repeat(np.arange(len(new)), count)
    at[place] = state
    example = place[order[new]]
    return Level(at, count, level.at[example + 1] if depth > 2 else following[place][order[new]], near[example], one.at[example + depth - 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes with all bits stirred."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Settings(NamedTuple):
    """Least occurrences, bytes of a shard, and counters (a power of two; by the bytes of text, if none are given)."""

    least: int = LEAST
    shard_bytes: int = SHARD_BYTES
    bits: int | None = None

    @property
    def slice(self) -> int:
        return min(SLICE, self.bits)


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``lang, text`` in batches of up to ``most`` bytes of text, or of one row."""
    held, size = [], 0
    for part in text_slices(batches):
        here = part.get_total_buffer_size() if part.num_rows == 1 else part.nbytes
        if held and size + here > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
            returned()
        held.append(part)
        size += here
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        returned()


class Shard:
    """Words of a shard as symbols (language and word), with their hashes."""

    def __init__(self, batch: pa.RecordBatch):
        found = words(batch.column("text"))
        langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        self.langs, self.names, self.begins = langs.dictionary, found.names, found.begins
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[found.of_text]
        pairs, symbol = np.unique(lang * max(1, len(self.names)) + found.code, return_inverse=True)
        self.symbol = symbol.astype(np.int64)
        self.lang, self.name = pairs // max(1, len(self.names)), pairs % max(1, len(self.names))
        named = np.array([xxhash.xxh64_intdigest(x) for x in self.names.to_pylist()], np.uint64)
        spoken = np.array([xxhash.xxh64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)
        self.hash = mixed(named[self.name] * _FACTORS[0] + spoken[self.lang]) if len(pairs) else np.zeros(0, np.uint64)



def longer(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs with one more word."""
    return mixed(run * _FACTORS[1] + word * _FACTORS[2])


def counter(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class Held(NamedTuple):
    """One bit per counter, packed: whether it reached the least."""

    bits: int
    packed: np.ndarray

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = counter(hashes, self.bits)
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def frequent_roots(shard: Shard, held: Held) -> tuple[Level, np.ndarray, np.ndarray]:
    """Runs of one word that may be frequent, and the places where a pair ends that may be, with the hash of that pair."""
    symbol = np.where(held(shard.hash)[shard.symbol], shard.symbol, -1) if len(shard.symbol) else shard.symbol
    allowed, hashes = np.zeros(len(symbol), bool), np.zeros(len(symbol), np.uint64)
    place = np.flatnonzero((symbol[1:] >= 0) & (symbol[:-1] >= 0) & ~shard.begins[1:]) + 1
    hashes[place] = longer(shard.hash[symbol[place - 1]], shard.hash[symbol[place]])
    allowed[place] = held(hashes[place])
    return roots(symbol), allowed, hashes


def _first_counts(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of words and pairs."""
    one = roots(shard.symbol)
    two = grown(one, one, shard.begins, 2)
    return np.r_[shard.hash[one.last], longer(shard.hash[two.parent], shard.hash[two.last])], np.r_[one.count, two.count]


def _second_counts(shard: Shard, held: Held) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of triples whose words and pairs may be frequent."""
    one, allowed, _ = frequent_roots(shard, held)
    two = grown(one, one, shard.begins, 2, allowed)
    three = grown(two, one, shard.begins, 3, allowed)
    pairs = longer(shard.hash[two.parent], shard.hash[two.last])
    return longer(pairs[three.parent], shard.hash[three.last]), three.count


def _sketch(hashes: np.ndarray, count: np.ndarray, how: Settings) -> pa.RecordBatch:
    """A shard's counts, a row per slice of counters: places in it, and counts up to the least that matters."""
    at = counter(hashes, how.bits)
    order = np.argsort(at, kind="stable")
    at, count = at[order], np.minimum(count[order], how.least).astype(np.min_scalar_type(how.least))
    place = (at & ((1 << how.slice) - 1)).astype("<u2")
    number, starts = np.unique(at >> how.slice, return_index=True)
    ends = np.r_[starts[1:], len(at)]
    kinds = {"slice": pa.int32(), "places": pa.binary(), "counts": pa.binary()}
    columns = (number, [place[a:b].tobytes() for a, b in zip(starts, ends)], [count[a:b].tobytes() for a, b in zip(starts, ends)])
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds.values())], names=list(kinds))


def _summed(batches: Iterator[pa.RecordBatch], how: Settings) -> Iterator[pa.RecordBatch]:
    """One bit per counter of each slice: whether all shards together reach the least; rows are sorted by slice."""
    now, sums = None, None
    bits = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= how.least).tobytes()], pa.binary())], names=["slice", "bits"])
    for batch in batches:
        for s, places, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "places", "counts"))):
            if s != now:
                if now is not None:
                    yield bits()
                now, sums = s, np.zeros(1 << how.slice, np.int64)
            sums += np.bincount(np.frombuffer(places, "<u2"), np.frombuffer(counts, np.min_scalar_type(how.least)), 1 << how.slice).astype(np.int64)
    if now is not None:
        yield bits()


def reached(docs: DataFrame, how: Settings, counts: Callable[[Shard], tuple[np.ndarray, np.ndarray]]) -> Held:
    """The counters of all shards together; ``counts`` gives a shard's hashes and counts."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketch = docs.mapInArrow(lambda batches: (_sketch(*counts(Shard(x)), how) for x in shards(batches, how.shard_bytes)), "slice int, places binary, counts binary")
    slices = sketch.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(lambda batches: _summed(batches, how), "slice int, bits binary")
    out, found = np.zeros((1 << how.bits) // 8, np.uint8), slices.toArrow()
    for s, bits in zip(found.column("slice").to_pylist(), found.column("bits").to_pylist()):
        out[s << how.slice - 3 : s + 1 << how.slice - 3] = np.frombuffer(bits, np.uint8)
    return Held(how.bits, out)


def sized(docs: DataFrame, how: Settings) -> Settings:
    """With counters by the bytes of text, if none are given."""
    if how.bits is not None:
        return how
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return how._replace(bits=min(MOST_BITS, max(FEWEST_BITS, int(size // PER_COUNTER).bit_length())))


def shortest(levels: list[Level]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level, the runs that are the longest of their state, and the length of the state's shortest."""
    low, longest = [np.ones(len(levels[0].count), np.int64)], [np.ones(len(levels[0].count), bool)]
    for k, level in enumerate(levels[1:], 1):
        same = level.count == levels[k - 1].count[level.link]
        longest[-1][level.link[same]] = False
        low.append(np.where(same, low[-1][level.link], k + 1))
        longest.append(np.ones(len(level.count), bool))
    for mask, least in zip(longest, low):
        yield mask, least


def counted(docs: DataFrame, how: Settings) -> DataFrame:
    """``lang, k, phrase, f``: runs of ``k`` words in ``docs(lang, text)`` and their occurrences, whole for all with the least or more; ``k`` is 0 for all words of a language."""
    context, how = docs.sparkSession.sparkContext, sized(docs, how)
    pairs = context.broadcast(reached(docs, how, _first_counts))
    triples = context.broadcast(reached(docs, how, lambda shard: _second_counts(shard, pairs.value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, how.shard_bytes):
            shard = Shard(batch)
            all_words = np.bincount(shard.lang[shard.symbol], minlength=len(shard.langs))
            spoken = np.flatnonzero(all_words)
            yield _states(shard.langs, spoken, np.zeros(len(spoken), np.int64), 0, pa.nulls(len(spoken), pa.string()), all_words[spoken])
            one, pair, hashes = frequent_roots(shard, pairs.value)
            triple, place = np.zeros(len(pair), bool), np.flatnonzero(pair[1:] & pair[:-1]) + 1
            triple[place] = triples.value(longer(hashes[place - 1], shard.hash[one.at[place]]))
            levels = [one]
            for depth in range(2, DEPTH + 1):
                levels.append(grown(levels[-1], one, shard.begins, depth, pair if depth == 2 else triple))
            text = single = pc.cast(shard.names.take(pa.array(shard.name[one.last])), pa.large_string())
            lang = shard.lang[one.last]
            for depth, (level, (longest, least)) in enumerate(zip(levels, shortest(levels)), 1):
                if depth > 1:
                    text = pc.binary_join_element_wise(text.take(pa.array(level.parent)), single.take(pa.array(level.last)), pa.scalar(" ", pa.large_string()))
                    lang = lang[level.parent]
                listed = np.flatnonzero(longest & (level.count > 0))
                yield _states(shard.langs, lang[listed], least[listed], depth, text.take(pa.array(listed)), level.count[listed])

    found = docs.mapInArrow(run, "lang string, low int, k int, phrase string, f long")
    runs = found.withColumn("k", F.explode(F.sequence("low", "k"))).withColumn("phrase", F.array_join(F.slice(F.split("phrase", " "), -F.greatest("k", F.lit(1)), F.greatest("k", F.lit(1))), " "))
    return runs.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def _states(langs: pa.Array, lang: np.ndarray, low: np.ndarray, k: int, phrases: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    columns = (pc.cast(langs.take(pa.array(lang)), pa.string()), pa.array(low.astype(np.int32)), pa.array(np.full(len(count), k, np.int32)), pc.cast(phrases, pa.string()), pa.array(count.astype(np.int64)))
    return pa.RecordBatch.from_arrays(list(columns), names=["lang", "low", "k", "phrase", "f"])


def subsumed(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, over``: phrases inside longer ones of ``frequent(lang, k, phrase, f)``, and the most occurrences of any of these."""
    link = F.regexp_replace("phrase", r"^[^ ]+ ", "")
    parent = F.regexp_replace("phrase", r" [^ ]+$", "")
    return frequent.filter("k > 2").select("lang", F.explode(F.array_distinct(F.array(link, parent))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("over"))


def scored(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of two words and more, by the cut of the lowest score."""
    parts = F.split("phrase", " ")
    cut = frequent.filter("k > 1").select("lang", "phrase", F.col("f").alias("a"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    halves = cut.select("lang", "phrase", "a", "cut", F.array_join(F.slice("parts", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("parts", F.col("cut") + 1, F.size("parts")), " ").alias("right"))
    met = halves.join(frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"CAST({SCALE} * CAST(a AS DECIMAL(25, 0)) DIV (CAST(l AS DECIMAL(25, 0)) + CAST(r AS DECIMAL(25, 0))) AS LONG)")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least")
    return met.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "least.l", "least.r", "least.score")


def collocations(docs: DataFrame, first: int = FIRST, how: Settings = Settings()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first phrases of each language of ``docs(lang, text)``."""
    counts = stored(counted(bounded(docs), how).filter((F.col("k") == 0) | (F.col("f") >= how.least)), "counts")
    frequent = counts.filter("k > 0")
    share = lambda c, times: F.col(c).cast("decimal(25,0)") * times
    kept = scored(frequent).join(subsumed(frequent), ["lang", "phrase"], "left").filter(F.col("over").isNull() | (share("over", 100) < share("a", SUBSUMED)))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    n = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    found = stored(ranked.join(n, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(counts)
    return found


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return collocations(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")))


QUERIES = {"op13_collocations": op13_collocations}
ORACLE_SQL = {
    "op13_collocations": r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents
    ), listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
    starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM listed),
    runs AS (SELECT lang, words, i, unnest(range(1, 5)) AS k FROM starts),
    counted AS (
      SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM runs WHERE i + k - 1 <= len(words) GROUP BY ALL
    ), n AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
    often AS (SELECT *, string_split(phrase, ' ') AS parts FROM counted WHERE f >= 30),
    cuts AS (SELECT lang, phrase, parts, f AS a, unnest(range(1, k)) AS cut FROM often WHERE k > 1),
    scores AS (
      SELECT c.lang, c.phrase, c.parts, a, cut, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT) AS score
      FROM cuts c
      JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.parts[1 : cut], ' ')
      JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.parts[cut + 1 :], ' ')
    ), lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    inside AS (
      SELECT lang, array_to_string(parts[i : i + m - 1], ' ') AS phrase, max(f) AS over
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM often WHERE k > 2)) GROUP BY ALL
    ), kept AS (
      SELECT c.* FROM lowest c LEFT JOIN inside USING (lang, phrase) WHERE over IS NULL OR 100 * over::HUGEINT < 80 * a::HUGEINT
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
    FROM kept JOIN n USING (lang)
    QUALIFY rank <= 2000
    """,
}
