"""Quality rules as a short-circuit cascade.

Each rule rejects documents by a feature of the text. On a sample the cost of each rule
(seconds a document) and its selectivity (share rejected) are measured; rules then run in
order of rejections per cost, and a document that one rule rejects is not looked at by
those behind it. The order changes the work, never the verdict: a document is kept when
no rule rejects it. The sample is the first ``SAMPLE`` rows the table gives.

The counts of the base are made for every document, with array operations over the bytes
of many texts at a time; a very long text is gone through in blocks.

Results for odd input: null text has no words, no line and fails the base; repeated rows
give equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import BLANK, packed, parts, per_text, ranges, windows_of, word_hashes

SAMPLE = 512
BYTES_AT_ONCE = 1 << 20
MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


class Texts:
    """Packed texts with their features, each made when a rule first asks for it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def some(self, rows: np.ndarray) -> Texts:
        sizes = np.diff(self.offsets)[rows]
        part = Texts(self.data[ranges(self.offsets[rows], sizes)], np.concatenate([[0], np.cumsum(sizes)]))
        for name in ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words"):
            if name in self.__dict__:
                part.__dict__[name] = tuple(x[rows] for x in self.lines) if name == "lines" else getattr(self, name)[rows]
        return part

    @cached_property
    def words(self):
        return word_hashes(self.data, self.offsets)

    @cached_property
    def n_words(self):
        return np.bincount(self.words[1], minlength=len(self.offsets) - 1).astype(np.int64)

    @cached_property
    def word_chars(self):
        return per_text(~BLANK[self.data] & ((self.data & 0xC0) != 0x80), self.offsets)

    @cached_property
    def n_symbols(self):
        return per_text(SYMBOLS[self.data], self.offsets)

    @cached_property
    def lines(self):
        """Lines with a word, and those of them equal to an earlier line of the text."""
        n, again = (np.zeros(len(self.offsets) - 1, np.int64) for _ in range(2))
        for i in range(len(n)):
            solid = [x for x in self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
            n[i], again[i] = len(solid), len(solid) - len(set(solid))
        return n, again

    @cached_property
    def n_repeat_words(self):
        """Words inside windows of three words that the text has twice or more."""
        hashes, owner, _ = self.words
        window, place = windows_of(hashes, owner, 3)
        order = np.lexsort((window, owner[place]))
        w, o = window[order], owner[place][order]
        same = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(hashes), bool)
        for j in range(3):
            covered[place[order[twice]] + j] = True
        return np.bincount(owner[covered], minlength=len(self.offsets) - 1).astype(np.int64)

    @cached_property
    def letters(self):
        """Small and capital letters of the Latin alphabet, accented ones included."""
        after = np.concatenate([[False], self.data[:-1] == 0xC3]) if len(self.data) else np.zeros(0, bool)
        d = self.data
        small = _LOWER[d] | (after & (d >= 0x9F) & (d != 0xB7))
        capital = _UPPER[d] | (after & (d < 0x9F) & (d != 0x97))
        return per_text(small, self.offsets), per_text(capital, self.offsets)

    @cached_property
    def words_without_letter(self):
        """Words of neither a Latin letter nor any character beyond ASCII."""
        _, owner, where = self.words
        if not len(where):
            return np.zeros(len(self.offsets) - 1, np.int64)
        letter = _LOWER[self.data] | _UPPER[self.data] | (self.data >= 0x80)
        # A stretch from one word's begin to the next has that word and blanks only.
        has = np.logical_or.reduceat(letter, where)
        return np.bincount(owner[~has], minlength=len(self.offsets) - 1).astype(np.int64)

    @cached_property
    def exclamations(self):
        return per_text(self.data == 0x21, self.offsets)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives True for each text to reject; it should ask for few features."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 14 * t.n_words)),
    Rule("repeated_lines", lambda t: 10 * t.lines[1] > 3 * t.lines[0]),
    Rule("capitals", lambda t: t.letters[1] > t.letters[0]),
    Rule("words_without_letter", lambda t: 10 * t.words_without_letter > 3 * t.n_words),
    Rule("exclamations", lambda t: 2 * t.exclamations > t.n_words),
)


def base_failed(t: Texts) -> np.ndarray:
    return (t.n_words < MIN_WORDS) | (t.n_repeat_words > MAX_REPEATED * t.n_words)


def kept_by(rules, texts: Texts, alive: np.ndarray) -> np.ndarray:
    """Run the rules in turn; each sees only the texts that none before it rejected."""
    alive = alive.copy()
    rows = np.flatnonzero(alive)
    part = texts.some(rows)
    for rule in rules:
        if not len(rows):
            break
        bad = rule.rejects(part)
        if bad.any():
            alive[rows[bad]] = False
            good = np.flatnonzero(~bad)
            rows, part = rows[good], part.some(good)
    return alive


def _texts(batches):
    for batch in batches:
        column = batch.column(1)
        data, offsets = packed(column)
        for lo, hi in parts(np.diff(offsets), BYTES_AT_ONCE):
            yield batch.column(0).slice(lo, hi - lo), Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _measure(rules, batches):
    """Cost and rejections of each rule over all texts of a sample."""
    seconds, rejected, seen = np.zeros(len(rules)), np.zeros(len(rules)), 0
    for _, texts in _texts(batches):
        alive = np.flatnonzero(~base_failed(texts))
        seen += len(alive)
        for k, rule in enumerate(rules):
            part = texts.some(alive)
            began = time.perf_counter()
            bad = rule.rejects(part)
            seconds[k] += time.perf_counter() - began
            rejected[k] += np.count_nonzero(bad)
    if seen:
        columns = [pa.array(list(range(len(rules))), pa.int32()), pa.array(seconds / seen), pa.array(rejected / seen)]
        yield pa.RecordBatch.from_arrays(columns, ["rule", "cost", "selectivity"])


def cascade(docs: DataFrame, rules=RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules in order of rejections per cost, as measured on a sample of the table."""
    rows = docs.select("doc_id", F.col("text").cast("string")).limit(sample)
    found = rows.mapInArrow(partial(_measure, rules), "rule int, cost double, selectivity double")
    per_cost = {r.rule: r.selectivity / max(r.cost, 1e-12) for r in found.collect()}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-per_cost.get(k, 0.0), k))]


def _judge(rules, batches):
    for doc_id, t in _texts(batches):
        failed = base_failed(t)
        kept = kept_by(rules, t, ~failed)
        columns = [t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words, failed, kept]
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        yield pa.RecordBatch.from_arrays([doc_id, *map(pa.array, columns)], names)


def quality_rules(docs: DataFrame, rules=None) -> DataFrame:
    """The counts and the verdict of each row; ``rules`` in a given order, or measured."""
    rules = cascade(docs) if rules is None else rules
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean"
    )
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_judge, list(rules)), schema)
