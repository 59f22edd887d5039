"""Periodic runs of words, found in a grammar of each text.

A run is a stretch of words with smallest period q and at least ``TIMES`` periods (and
``LEAST`` words) that no neighbour extends. Texts become word ids, a batch of texts in one
array, and Re-Pair builds a grammar of each text: neighbouring pairs that occur more than
once become rules, the most frequent first. All texts go on together, and a round replaces
every pair that has a higher count than the pairs overlapping it, so the most frequent pair
of each text is always among them.

A run lies in the expansion of a rule and crosses the boundary between its two parts, or
crosses a boundary of the start string. Boundaries are tested once for each rule, in the
text of its first occurrence: of a run with period q, 2 q words lie on one side, so for
each power of two l with l <= q < 2 l the 2 l words beside the boundary occur again at
distance q and no nearer (two nearer ones would give a smaller period). The nearest equal
windows are therefore the only candidates; comparing words gives the extent. What a rule
has is translated to all places where it was put, and of stretches of a text with the same
period those inside others go: every run is found whole at the lowest rule that holds it.

Windows have exact numbers (pairs of numbers of half as long ones), and only windows whose
halves both occur again are numbered, so longer ones are soon few.

Results for odd input: a text without words (null, empty) has no runs; repeated rows give
equal rows; a null doc_id is kept (and, with ``tails``, counts as 0); an empty
table gives an empty table; other columns are ignored. A long text is a batch of its own;
memory is in proportion to its words.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import id_array, ids, numbered, ranges

TIMES = 4
LEAST = 6
BATCH_WORDS = 1 << 19
STEP = 32  # words compared at once when a stretch is followed
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)


class Grammar:
    """Re-Pair of many texts: ``words`` are numbers, ``text`` says whose each is (rising).

    Rule r covers [lo, hi) at its first occurrence and is cut at mid; ``places`` are the
    starts of its occurrences, those of rule r from ``first[r]`` to ``first[r + 1]``.
    ``ends`` are the boundaries inside the start strings.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.lo: list[np.ndarray] = []
        self.mid: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        placed: list[tuple[np.ndarray, np.ndarray]] = []
        left: list[np.ndarray] = []
        total = len(words)
        rules = 0
        # Symbols: (number, where it begins, where it ends, text); numbers are each text's own.
        symbol, _ = numbered(text, words)
        at, to = np.arange(total), np.arange(1, total + 1)
        next_symbol = int(symbol.max(initial=-1)) + 1
        while len(symbol):
            pair = np.flatnonzero(text[1:] == text[:-1])
            number, counts = numbered(symbol[pair], symbol[pair + 1])
            # In a row of one symbol every second pair counts.
            same = np.zeros(len(symbol) + 1, bool)
            same[pair + 1] = symbol[pair] == symbol[pair + 1]
            place = np.arange(len(symbol))
            since = place - np.maximum.accumulate(np.where(same[:-1], 0, place))
            odd = same[pair + 1] & (since[pair] % 2 == 1)
            counts = counts - np.bincount(number[odd], minlength=len(counts))
            weight = np.zeros(len(symbol) + 1, np.int64)  # of the pair that begins here
            # Equal counts are put in an order that is the same wherever the pair occurs.
            mixed = (np.arange(len(counts)) * 0x9E3779B1 & 0xFFFFFF) + 1
            again = counts > 1
            weight[pair] = np.where(again[number] & ~odd, (counts[number] << 24) + mixed[number], 0)
            before = np.concatenate(([0], weight[:-2]))
            best = np.flatnonzero((weight[:-1] > before) & (weight[:-1] >= weight[1:]))
            # Texts without a pair that occurs again are done.
            alive = np.zeros(int(text[-1]) + 1, bool)
            alive[text[best]] = True
            done = ~alive[text]
            left.append(at[done])
            if not len(best):
                break
            rank = np.zeros(len(symbol), np.int64)
            rank[pair] = number
            rule, first = _dense(rank[best])
            self.lo.append(at[best[first]])
            self.mid.append(at[best[first] + 1])
            self.hi.append(to[best[first] + 1])
            placed.append((rule + rules, at[best]))
            symbol[best] = next_symbol + rule
            to[best] = to[best + 1]
            rules += len(first)
            next_symbol += len(first)
            stay = ~done
            stay[best + 1] = False
            symbol, at, to, text = symbol[stay], at[stay], to[stay], text[stay]
            if next_symbol >= 1 << 31:
                symbol, _ = numbered(np.zeros_like(symbol), symbol)
                next_symbol = int(symbol.max(initial=-1)) + 1
        none = np.zeros(0, np.int64)
        self.lo, self.mid, self.hi = (np.concatenate(x) if x else none for x in (self.lo, self.mid, self.hi))
        rule = np.concatenate([p[0] for p in placed]) if placed else none
        place = np.concatenate([p[1] for p in placed]) if placed else none
        order = np.argsort(rule, kind="stable")
        self.places = place[order]
        self.first = np.searchsorted(rule[order], np.arange(rules + 1))
        starts = np.concatenate(left) if left else none
        self.ends = np.sort(starts)


def _dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, ... for the distinct values, and where each comes first."""
    _, first, number = np.unique(values, return_index=True, return_inverse=True)
    return number.astype(np.int64), first


def _nearest(number: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows (rising starts): how far the nearest equal one before and behind begins, 0 if none."""
    order = np.argsort(number, kind="stable")
    equal = number[order[1:]] == number[order[:-1]]
    far = starts[order[1:]] - starts[order[:-1]]
    before = np.zeros(len(starts), np.int64)
    behind = np.zeros(len(starts), np.int64)
    before[order[1:][equal]] = far[equal]
    behind[order[:-1][equal]] = far[equal]
    return before, behind


def _follow(words: np.ndarray, at: np.ndarray, q: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on (step 1) or back (-1) equal those q words behind them, up to the limit."""
    out = np.zeros(len(at), np.int64)
    active = np.flatnonzero(limit > 0)
    reach = np.arange(STEP)
    last = len(words) - 1
    while len(active):
        todo = limit[active] - out[active]
        place = at[active, None] + step * (out[active, None] + reach)
        good = words[np.clip(place, 0, last)] == words[np.clip(place + q[active, None], 0, last)]
        good &= reach < todo[:, None]
        run = np.where(good.all(1), STEP, np.argmin(good, 1))
        out[active] += run
        active = active[run == STEP]
    return out


def boundary_runs(words: np.ndarray, text: np.ndarray, cut: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple:
    """Runs inside [lo, hi) that cross the boundary before word ``cut``: (boundary, start, end, period)."""
    found: list[tuple] = []
    n = len(words)
    if not len(cut):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    starts = np.flatnonzero(text[1:] == text[:-1])  # of windows of two words
    number, counts = numbered(words[starts], words[starts + 1])
    number, counts = _per_text(number, text[starts])
    size = 2  # = 2 l, words of a window
    where = np.empty(n + 1, np.int64)
    while len(starts):
        again = counts[number] > 1
        starts, number = starts[again], number[again]
        if not len(starts):
            break
        half = size // 2
        before, behind = _nearest(number, starts)
        where.fill(-1)
        where[starts] = np.arange(len(starts))
        # The window that ends at the boundary, and the one that begins there.
        for shift in (size, 0):
            begin = cut - shift
            inside = np.flatnonzero((begin >= lo) & (begin + size <= hi))
            slot = where[begin[inside]]
            inside, slot = inside[slot >= 0], slot[slot >= 0]
            for far, sign in ((before, -1), (behind, 1)):
                q = far[slot]
                fits = np.flatnonzero((q >= half) & (q < size))
                b, q, begin_at = inside[fits], q[fits], starts[slot[fits]]
                if sign < 0:
                    begin_at = begin_at - q  # equal to the words q behind
                ok = np.flatnonzero((begin_at >= lo[b]) & (begin_at + size + q <= hi[b]))
                b, q, begin_at = b[ok], q[ok], begin_at[ok]
                more = _follow(words, begin_at + size, q, hi[b] - q - begin_at - size, 1)
                less = _follow(words, begin_at - 1, q, begin_at - lo[b], -1)
                start, end = begin_at - less, begin_at + size + more + q
                long = np.flatnonzero((end - start >= np.maximum(LEAST, TIMES * q)) & (start < cut[b]) & (end > cut[b]))
                found.append((b[long], start[long], end[long], q[long]))
        # Windows of twice the size, where both halves occur again.
        second = np.where(starts + size < n, where[np.minimum(starts + size, n)], -1)
        both = np.flatnonzero(second >= 0)
        both = both[text[starts[both]] == text[starts[second[both]]]]
        number, counts = numbered(number[both], number[second[both]])
        starts = starts[both]
        size *= 2
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def _per_text(number: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return numbered(text, number)


def runs_of(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts in one array: start, end, period, in order of text, start and period."""
    n = len(words)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    grammar = Grammar(words, text)
    edge = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    stop = np.append(edge[1:], n)
    owner = np.cumsum(np.append(True, text[1:] != text[:-1])) - 1
    top = grammar.ends
    rules = len(grammar.lo)
    cut = np.concatenate([grammar.mid, top])
    lo = np.concatenate([grammar.lo, edge[owner[top]]])
    hi = np.concatenate([grammar.hi, stop[owner[top]]])
    which, start, end, period = boundary_runs(words, text, cut, lo, hi)
    # To all places of the rules.
    ruled = which < rules
    rule, home = which[ruled], grammar.lo[which[ruled]]
    times = grammar.first[rule + 1] - grammar.first[rule]
    moved = grammar.places[ranges(grammar.first[rule], times)] - np.repeat(home, times)
    start = np.concatenate([np.repeat(start[ruled], times) + moved, start[~ruled]])
    end = np.concatenate([np.repeat(end[ruled], times) + moved, end[~ruled]])
    period = np.concatenate([np.repeat(period[ruled], times), period[~ruled]])
    # Of one text and period, stretches inside others go.
    order = np.lexsort((-end, start, period, owner[start]))
    start, end, period = start[order], end[order], period[order]
    group = owner[start] * (n + 1) + period
    new = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
    # Ends so far, made to begin anew in each group.
    base = (np.cumsum(new) - 1) * (n + 1)
    so_far = np.maximum.accumulate(end + base) if len(end) else end
    keep = new.copy()
    keep[1:] |= (end + base)[1:] > so_far[:-1]
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth text (by checksum of its id) goes on with a period from some word on."""
    h = zlib.crc32(str(0 if doc_id is None else doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _rows(owners: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    """Runs of some texts, given as words."""
    number: dict[bytes, int] = {}
    for t in texts:
        for w in set(t).difference(number):
            number[w] = len(number)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    offsets = np.append(0, np.cumsum(sizes))
    text = np.repeat(np.arange(len(texts)), sizes)
    start, end, period = runs_of(words, text)
    owner = text[start]
    # Words behind the first period of a run go.
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    length = end - start
    order = np.lexsort((period, start, -length, owner))
    best = np.full(len(texts), -1)
    best[owner[order][::-1]] = order[::-1]
    start = start - offsets[owner]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    listed, collapsed = [], []
    for k, t in enumerate(texts):
        a, b = bounds[k], bounds[k + 1]
        if a == b:
            listed.append(_digest(b""))
            collapsed.append(_digest(b" ".join(t)))
            continue
        lines = zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist())
        listed.append(_digest("".join(f"{s},{m},{q}\n" for s, m, q in lines).encode()))
        stay = kept[offsets[k] : offsets[k + 1]].tolist()
        collapsed.append(_digest(b" ".join([w for w, x in zip(t, stay) if x])))
    none = best < 0
    columns = [id_array(np.array(owners, np.int64)), pa.array(np.diff(bounds), pa.int64())]
    if len(start):
        values = (start[best], length[best], period[best], 1000 * length[best] // period[best])
        columns += [pa.array(v, pa.int64(), mask=none) for v in values]
    else:
        columns += [pa.nulls(len(texts), pa.int64())] * 4
    columns += [pa.array(listed, pa.string()), pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])


def _find(tails: bool, batches):
    for batch in batches:
        owners: list = []
        texts: list[list[bytes]] = []
        size = 0
        for owner, doc_id, value in zip(ids(batch.column(0)).tolist(), batch.column(0), batch.column(1)):
            value = value.as_py()
            words = value.encode().split() if value else []
            if tails:
                words = _tail(words, doc_id.as_py())
            owners.append(owner)
            texts.append(words)
            size += len(words)
            if size >= BATCH_WORDS:
                yield _rows(owners, texts)
                owners, texts, size = [], [], 0
        if owners:
            yield _rows(owners, texts)


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """One row for each document: n_runs, its longest run, and digests of all runs and of the
    text without repeated periods. Words are what ``[^\\x20\\x09-\\x0D]+`` matches. With
    ``tails`` a tenth of the texts get periodic tails first (see ``_tail``), as test data."""

    def run(batches):
        return _find(tails, batches)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
