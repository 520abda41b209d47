"""License scans with a generalised suffix automaton of template words.

Templates (the base phrases, short notices, short licenses and the bodies of long ones) are cut into words and put into one suffix
automaton. A file's words stream through it and give, at every word, the longest match with any template that ends there (the
matching statistics). Matches of ``MIN_MATCH`` words or more (of bodies ``MIN_BODY_MATCH``), or of a whole template, are chained per
template where they follow each other in file and template with gaps of at most ``MAX_GAP`` words. A chain
that covers ``MIN_COVER`` of its template's words gives its label and a covered span; a body counts as ``BODY_WORDS`` words, so
an excerpt of it is enough. Long licenses share passages: of bodies whose chains overlap in a file, those that cover fewer words
than one of another label give way. Places of base phrases are read off the same matches.

Only runs of words that some template has are streamed, all others lead back to the automaton's
root. Edge cases: null texts are empty and have no words; repeated rows, null ids and other
columns change nothing; an empty table gives an empty one. ``first_word`` and ``last_word`` are null
without a base phrase, label lists are then empty strings.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.batches import bounded, text_slices
from larkspur.llm.license_texts import TEXTS
from larkspur.sources.storage import table

MIN_MATCH = 3
MIN_BODY_MATCH = 5
MAX_GAP = 6
MIN_COVER = 0.8
BODY_WORDS = 75
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

Template = tuple[str, str]  # label, text

# Base phrases and notices with their labels.
BASE: tuple[Template, ...] = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
NOTICES: tuple[Template, ...] = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    ("reserved", "all rights reserved"),
)
# Bodies of long licenses, in files of ``license_bodies``.
BODY_FILES: tuple[Template, ...] = (
    ("apache", "Apache-2.0.txt"),
    ("gpl", "GPL-2.txt"),
    ("gpl", "GPL-3.txt"),
    ("lgpl", "LGPL-2.1.txt"),
    ("lgpl", "LGPL-3.txt"),
    ("mpl", "MPL-2.0.txt"),
)


@cache
def bodies() -> tuple[Template, ...]:
    folder = resources.files("larkspur.llm").joinpath("license_bodies")
    return tuple((label, folder.joinpath(name).read_text("utf-8")) for label, name in BODY_FILES)


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class Automaton:
    """Suffix automaton of several word sequences.

    ``step`` maps (state, word) to a state, ``link`` is the suffix link and ``size`` the longest length of a
    state; ``ends`` has each state's places as (sequence, end), those of matches shorter than a sequence's ``least`` left out.
    """

    def __init__(self, sequences: Sequence[Sequence[int]], least: Sequence[int] | None = None):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for sequence in sequences:
            state = 0
            for word in sequence:
                state = self._extended(state, word)
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.step]
        for t, sequence in enumerate(sequences):
            state = 0
            for i, word in enumerate(sequence):
                state = self.step[state][word]
                at = state
                while at > 0 and (least is None or self.size[at] >= least[t]):
                    self.ends[at].add((t, i + 1))
                    at = self.link[at]

    def _state(self, step: dict[int, int], link: int, size: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The part of ``target`` that has the length after ``state``, as a state of its own."""
        half = self._state(dict(self.step[target]), self.link[target], self.size[state] + 1)
        self.link[target] = half
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = half
            state = self.link[state]
        return half

    def _extended(self, state: int, word: int) -> int:
        if word in self.step[state]:
            target = self.step[state][word]
            return target if self.size[target] == self.size[state] + 1 else self._split(state, word, target)
        new = self._state({}, 0, self.size[state] + 1)
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.step[state][word]
            self.link[new] = target if self.size[target] == self.size[state] + 1 else self._split(state, word, target)
        return new

    def statistics(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest match that ends there."""
        state, length = 0, 0
        for word in words:
            while state > 0 and word not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.step[state]:
                state, length = self.step[state][word], length + 1
            yield state, length


class Scanner:
    """Templates compiled for scanning; small, and sent to every task."""

    def __init__(self, phrases: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES + TEXTS, long: Sequence[Template] | None = None):
        long = bodies() if long is None else long
        texts = [words_of(text) for _, text in (*phrases, *notices, *long)]
        if not all(texts):
            raise ValueError("a template has no words")
        self.labels = [label for label, _ in (*phrases, *notices, *long)]
        self.n_base, self.sizes, self.first_body = len(phrases), [len(x) for x in texts], len(phrases) + len(notices)
        self.least = [min(MIN_MATCH if t < self.first_body else MIN_BODY_MATCH, n) for t, n in enumerate(self.sizes)]
        self.needed = [n if t < self.first_body else min(n, BODY_WORDS) for t, n in enumerate(self.sizes)]
        self.vocabulary = sorted({w for x in texts for w in x})
        code = {w: i for i, w in enumerate(self.vocabulary)}
        coded = [[code[w] for w in x] for x in texts]
        self.automaton = a = Automaton(coded, self.least)
        self.shortest = min(self.sizes)
        self.phrases: list[list[int]] = [[] for _ in a.step]  # of a state: base phrases that end every match of their length
        own: dict[int, list[int]] = defaultdict(list)
        for t in range(self.n_base):
            state = 0
            for w in coded[t]:
                state = a.step[state][w]
            own[state].append(t)
        for state in range(1, len(a.step)):
            at = state
            while at > 0:
                self.phrases[state] += own.get(at, [])
                at = a.link[at]

    def run(self, codes: list[int], at: int, places: list[tuple[int, int]], matches: dict[int, list[tuple[int, int, int]]]) -> None:
        """Scan one run of known words that starts at word ``at``: base places as (start, phrase); per
        template, right-maximal matches as (file start, template start, length)."""
        before = None
        for i, (state, length) in enumerate(self.automaton.statistics(codes)):
            if before and length <= before[1]:
                self._matched(*before, at + i, matches)
            for t in self.phrases[state]:
                if self.sizes[t] <= length:
                    places.append((at + i + 1 - self.sizes[t], t))
            before = (state, length)
        if before:
            self._matched(*before, at + len(codes), matches)

    def _matched(self, state: int, length: int, end: int, matches: dict[int, list[tuple[int, int, int]]]) -> None:
        for t, stop in self.automaton.ends[state]:
            if length >= self.least[t]:
                matches[t].append((end - length, stop - length, length))

    def chains(self, matches: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int, float]]:
        """``(template, first word, end, covered share)``; of chains of a template that overlap, the better one."""
        found = []
        for t, own in matches.items():
            reached: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)  # by ends in file and template: words covered, less the first word
            for f, p, n in sorted(set(own)):
                near = [reached[e] for e in range(f - MAX_GAP, f + 1) if e in reached]
                covered, start = max((x[q] for x in near for q in range(p - MAX_GAP, p + 1) if q in x), default=(0, -f))
                chain = (covered + n, start)
                reached[f + n][p + n] = max(reached[f + n].get(p + n, chain), chain)
                found.append((t, -start, f + n, covered + n))
        kept: list[tuple[int, int, int, int]] = []
        end = (-1, -1)  # template and end of the chain kept last
        for t, a, b, covered in sorted(found, key=lambda x: (x[0], x[1], -x[3], x[2])):
            if end[0] != t or a >= end[1]:
                kept.append((t, a, b, covered))
                end = (t, b)
            elif covered > kept[-1][3]:
                kept[-1] = (t, a, b, covered)
                end = (t, b)
        return [(t, a, b, min(1.0, covered / self.needed[t])) for t, a, b, covered in self._told_apart(kept)]

    def _told_apart(self, chains: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains without those of bodies that overlap a longer one of a body of another label.

        Chains of one template don't overlap, so each meets about as many as there are bodies.
        """
        long = sorted((x for x in chains if x[0] >= self.first_body), key=lambda x: x[1])
        beaten = set()
        for i, one in enumerate(long):
            j = i + 1
            while j < len(long) and long[j][1] < one[2]:
                if self.labels[one[0]] != self.labels[long[j][0]] and one[3] != long[j][3]:
                    beaten.add(min(one, long[j], key=lambda x: x[3]))
                j += 1
        return [x for x in chains if x not in beaten]


def _scanned(texts: pa.Array, scanner: Scanner):
    """Per text: number of words, base places, chains."""
    n = len(texts)
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")), SEPARATORS)
    words, parents = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(words, "")
    words, parents = words.filter(real), parents[real.to_numpy(zero_copy_only=False)]
    code = pc.fill_null(pc.index_in(words, value_set=pa.array(scanner.vocabulary)), -1).to_numpy(zero_copy_only=False)
    lengths = np.bincount(parents, minlength=n)
    begins = np.cumsum(lengths) - lengths
    known = code >= 0
    edge = known & np.r_[True, ~known[:-1] | (parents[1:] != parents[:-1])][: len(known)]
    starts = np.flatnonzero(edge)
    stops = np.flatnonzero(known & np.r_[(~known[1:]) | (parents[1:] != parents[:-1]), True][: len(known)]) + 1
    places: dict[int, list] = defaultdict(list)
    matches: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for a, b in zip(starts.tolist(), stops.tolist()):
        if b - a >= scanner.shortest:
            row = int(parents[a])
            scanner.run(code[a:b].tolist(), a - int(begins[row]), places[row], matches[row])
    return lengths, places, {row: scanner.chains(m) for row, m in matches.items()}


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of every row.

    ``spans`` lists covered template spans as ``label:first word:end``; ``score`` is the largest covered share.
    """
    scanner = scanner or Scanner()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            lengths, places, chains = _scanned(part.column("text"), scanner)
            rows = []
            for i in range(part.num_rows):
                base, found = places.get(i, []), chains.get(i, [])
                own = {scanner.labels[t] for _, t in base}
                kept = [x for x in found if x[3] >= MIN_COVER]
                every = own | {scanner.labels[t] for t, *_ in kept}
                starts = [s for s, _ in base]
                spans = sorted({(a, b, scanner.labels[t]) for t, a, b, _ in kept})
                rows.append((int(lengths[i]), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(every)), max((x[3] for x in found), default=0.0), ",".join(f"{k}:{a}:{b}" for a, b, k in spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    ids = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op6_licenses": op6_licenses}
ORACLE_SQL: dict[str, str] = {}
