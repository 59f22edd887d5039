"""Encoding and decoding with a merge-type piece model through a prefix table.

Merging pairs by rank gives every text one result, and each prefix of a text has a
result of its own. The table keeps, for each prefix, only the *last token* of its
result: the rest is the result of the prefix before that token. A token that ends at a
place is right when the last token of the prefix before it may stand before it, which
depends on these two tokens alone: undoing merges from the younger of them back, no
merge across the boundary may come earlier than the merges that made them. Tokens that
end at a place come from one pass of an Aho-Corasick automaton over the pieces; one of
them is compatible. The ids are recovered from the end of the table backwards.

A piece never holds the mark of a blank after another character, so a text falls into
words (blanks and what follows them, cut again where no piece reaches across) that are
encoded alone; repeated words come from a bounded memory of results.

The model file is read by the sentencepiece library in each task; its pieces and scores
define the pairs. The file's path is a parameter.

Results for odd input: null text encodes as the end id alone; the empty text as well;
an empty table gives an empty table; repeated rows give equal rows; other columns are
ignored; very long texts and words take time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MEMORY = 1 << 17  # words of each of two generations kept with their results, per task
LONG_WORD = 256  # longer ones are not kept
BYTES = -2  # stands for a character that only byte ids can give


class PieceModel:
    """Pieces, ranks and pairs of a model whose pieces are merges of two pieces."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = lib.eos_id()
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.bytes_of = {int(self.pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_value = {i: v for v, i in self.bytes_of.items()}
        self.hidden = {i for i in range(n) if lib.is_control(i)}
        self.unknown = lib.unk_id()
        self.id_of = {self.pieces[i]: i for i in normal}
        self.rank = {i: -lib.get_score(i) for i in normal}
        self.length = {i: len(self.pieces[i]) for i in normal}
        # The pair a piece was merged from: encode it with the merges before its own.
        self.split: dict[int, tuple[int, int] | None] = {}
        for i in sorted(normal, key=lambda x: (len(self.pieces[x]), x)):
            self.split[i] = self._pair_of(i)
        # A piece that merging its own text does not end in never shows up.
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            if self.split[i] is not None or len(text) == 1:
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}

    def _merge_rank(self, a: int, b: int):
        """Rank of merging two tokens, None when their text is no piece."""
        i = self.id_of.get(self.pieces[a] + self.pieces[b])
        return None if i is None else (self.rank[i], i)

    def _pair_of(self, i: int):
        """The last merge that makes this piece out of single characters, lowest ranks first
        and leftmost among equals; None for a character, or when merging does not reach it."""
        text = self.pieces[i]
        if len(text) == 1:
            return None
        parts = [self.id_of.get(c) for c in text]
        if None in parts:
            return None
        while len(parts) > 2:
            best = None
            for k in range(len(parts) - 1):
                r = self._merge_rank(parts[k], parts[k + 1])
                if r is not None and (best is None or r[0] < best[0]):
                    best = (r[0], k, r[1])
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [best[2]]
        r = self._merge_rank(*parts)
        return (parts[0], parts[1]) if r is not None else None

    def fits(self, a: int, b: int) -> bool:
        """May token b follow token a, with nothing merged across the boundary?"""
        known = self._fits.get((a, b))
        if known is None:
            known = self._fits[a, b] = self._test(a, b)
        return known

    def _test(self, a: int, b: int) -> bool:
        """Play the merges of both tokens backwards. A merge across the boundary wins over
        the one that made the side to be undone when it has a lower rank, or the same rank
        and starts further left (the right side's own merge starts after the boundary)."""
        left, right = a, b
        limit_left = limit_right = np.inf  # rank of the merge that hides the boundary tokens
        while True:
            cross = self._merge_rank(left, right)
            if cross is not None:
                rank = cross[0]
                # It happens unless one of the two had been merged away before.
                if not (limit_left <= rank or limit_right < rank):
                    return False
            sl, sr = self.split[left], self.split[right]
            rl = self.rank[left] if sl else -np.inf
            rr = self.rank[right] if sr else -np.inf
            if sl is None and sr is None:
                return True
            # Undo the younger merge; equal ranks merge from the left, so the right is younger.
            if rl > rr:
                limit_left = rl
                left = sl[1]
            else:
                limit_right = rr
                right = sr[0]


class Codec:
    """Exact encode and decode of whole texts."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.words: dict[str, tuple[int, str, tuple[int, ...]]] = {}
        self.older = self.words
        self.split = re.compile(self._word_pattern()).findall

    def _word_pattern(self) -> str:
        """Words end before a mark. They also end where a letter or digit meets another
        character, unless a piece holds such a pair, and at line ends that no piece holds."""
        pieces = self.model.id_of
        joined = {a for p in pieces for a, b in zip(p, p[1:]) if a.isalnum() and not b.isalnum()}
        end = "" if any("\n" in p for p in pieces) else "\n"
        odd = "".join(re.escape(a) for a in sorted(joined))
        letter = f"[^\\W_{odd}]"
        other = f"(?:[^\\w{MARK}{end}]|[_{odd}])"
        return f"{MARK}*{other}*{letter}+|{MARK}*{other}+|{MARK}+" + ("|\n" if end else "")

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of one word through its prefix table."""
        m = self.model
        length, known, fits = m.length, m._fits, m.fits
        last = [BYTES] * (len(text) + 1)  # the last token of each prefix
        for at, i in m.automaton.iter(text):
            if last[at + 1] != BYTES:
                continue
            start = at + 1 - length[i]
            before = last[start]
            if start == 0 or before == BYTES:
                last[at + 1] = i
            else:
                ok = known.get((before, i))
                if fits(before, i) if ok is None else ok:
                    last[at + 1] = i
        out: list[int] = []
        at = len(text)
        while at:
            i = last[at]
            if i == BYTES:
                out.extend(self._bytes(text[at - 1])[::-1])
                at -= 1
            else:
                out.append(i)
                at -= length[i]
        return tuple(out[::-1])

    def _bytes(self, char: str) -> list[int]:
        m = self.model
        data = char.encode("utf-8", "surrogatepass")
        return [m.bytes_of[x] for x in data] if m.bytes_of else [m.unknown]

    def _entry(self, text: str):
        """Number of ids, the ids as text, the text they decode to, the ids of a word."""
        entry = self.older.get(text)
        if entry is None:
            ids = self.word(text)
            entry = (len(ids), " ".join(map(str, ids)), self.decode(ids, False), ids)
        if len(text) <= LONG_WORD:
            if len(self.words) >= MEMORY:
                self.words, self.older = {}, self.words
            self.words[text] = entry
        return entry

    def entries(self, text: str) -> list:
        """The words of a text with their results; no character's bytes are in two words."""
        if not text:
            return []
        return [self.words.get(w) or self._entry(w) for w in self.split(MARK + text.replace(" ", MARK))]

    def encode(self, text: str) -> list[int]:
        """Ids with the end id."""
        return [i for e in self.entries(text) for i in e[3]] + [self.model.end_id]

    def decode(self, ids, first: bool = True) -> str:
        """Text of ids: control ids vanish, runs of byte ids are UTF-8 (a byte that is part of
        no character becomes U+FFFD), marks are blanks, and the first blank is not the text's."""
        m = self.model
        pieces, byte_value, hidden = m.pieces, m.byte_value, m.hidden
        out: list[str] = []
        run = bytearray()
        for i in ids:
            value = byte_value.get(i)
            if value is not None:
                run.append(value)
                first = False
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i in hidden:
                continue
            piece = " ⁇ " if i == m.unknown else pieces[i]
            if first and piece.startswith(MARK):
                piece = piece[1:]
            first = False
            out.append(piece)
        if run:
            out.append(_utf8(run))
        return "".join(out).replace(MARK, " ")


def _utf8(data: bytearray) -> str:
    """Each byte outside a whole character becomes one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _digests(path: str, ids_too: bool, batches):
    c = codec(path)
    end = c.model.end_id
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            words = c.entries(text or "")
            shown = " ".join([e[1] for e in words] + [str(end)])
            # Words decode one by one; the blank before the first is the encoder's own.
            back = "".join([e[2] for e in words])[1:]
            ids = [i for e in words for i in e[3]] + [end] if ids_too else None
            rows.append((sum([e[0] for e in words]) + 1, _sha(shown), _sha(back), ids))
        columns = [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids_too:
            columns.append(pa.array([r[3] for r in rows], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row (and the ids themselves)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches):
        return _digests(model_path, with_ids, batches)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
