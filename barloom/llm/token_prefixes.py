"""Exact token counts of every prefix of a text, for byte-level BPE vocabularies.

A sequence of tokens is the encoding of its bytes exactly if every two
neighbours are: merging their bytes on their own gives the same two tokens.
So the encodings of all prefixes of a piece follow from one pass: the last
token of prefix ``j`` is the token ``t`` that ends at ``j`` and may follow the
last token of prefix ``j - len(t)``, and its count is one more than there.

Pieces are what the pre-tokenizer cuts a text into.  The table of a text is the
tables of its pieces laid end to end; the few prefixes whose own pieces differ
from those of the whole text (a cut behind a run of white space, inside a
contraction or a special token) are counted from the piece before the cut.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from bisect import bisect_right
from itertools import accumulate
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import BoundedCache, long_id, map_batches, utf8

#: Pre-tokenizer pattern of the byte-level vocabularies: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTRACTIONS = ("'re", "'ve", "'ll")
#: Longer pieces are computed but not kept.
_KEEP_CHARS = 256
#: White space other than single spaces between other characters.
_WIDE = re.compile(r" \s|\s |\A\s|\s\Z")
_PAIR = re.compile(r"\s\s")
_RUN = regex.compile(r"\s{2,}(?=\S)")
#: A contraction of three characters where its apostrophe begins a piece.
_SHORT = regex.compile(r"(?<=[\p{L}\p{N}]|[^\S ])'(?:re|ve|ll)")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Token counts of all prefixes of a text, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()

        def raw(token):
            return bytes(symbols[c] for c in token)

        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"]:
            raise ValueError("needs a byte-level BPE without normalizer and prefix space")
        special = {t["content"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        self.rank, self.made = {}, {i: (-1, i, i) for i in self.ids.values()}
        for n, (a, b) in enumerate(model["merges"]):
            a, b = raw(a), raw(b)
            pair = self.ids[a], self.ids[b]
            self.rank[pair] = n
            self.made[self.ids[a + b]] = (n, *pair)
        self.ends = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), i))
        self.ends.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.follows = BoundedCache(self._follows, 1_000_000)
        self.piece = BoundedCache(self._piece)
        self.first = BoundedCache(self._stretch)
        self.later = BoundedCache(lambda w: self._stretch(" " + w))

    def _follows(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay apart.

        Their last merges are undone, the later one first; the pair that then
        meets at the border must not be one that merges before that moment.  Of
        equal merges the left one comes first.
        """
        (a, b), rank, made, before = pair, self.rank, self.made, 1 << 60
        while True:
            if rank.get((a, b), 1 << 60) < before:
                return False
            (at_a, _, tail), (at_b, head, _) = made[a], made[b]
            if at_a < 0 and at_b < 0:
                return True
            if at_a > at_b:
                before, a = at_a, tail
            else:
                before, b = at_b + 1, head

    def _table(self, data: bytes) -> list[int]:
        """Counts of the prefixes of 0, 1, ... bytes of one piece."""
        count, last, follows = [0] + [-1] * len(data), [0] * (len(data) + 1), self.follows
        for end, (size, token) in self.ends.iter(data.decode("latin-1")):
            if count[end + 1] < 0:
                begin = end + 1 - size
                if begin == 0 or follows[last[begin], token]:
                    count[end + 1] = count[begin] + 1
                    last[end + 1] = token
        return count

    def _piece(self, piece: str) -> tuple[int, bytes]:
        """(tokens, change of the count with every character) of a piece."""
        counts = self._table(piece.encode())
        if not piece.isascii():
            counts = [counts[i] for i in accumulate((len(c.encode()) for c in piece), initial=0)]
        return counts[-1], array("h", map(sub, counts[1:], counts)).tobytes()

    def _of_piece(self, piece: str) -> tuple[int, bytes]:
        return self.piece[piece] if len(piece) <= _KEEP_CHARS else self._piece(piece)

    def _stretch(self, chunk: str) -> bytes:
        return b"".join(self._of_piece(p)[1] for p in self.pattern.findall(chunk))

    def _plain(self, text: str) -> list[bytes]:
        """Changes over a stretch without special tokens, by its pieces."""
        if not _WIDE.search(text):
            # single spaces between words: no piece reaches over one
            words = text.split(" ")
            later = self.later
            return [self.first[words[0]], *[later[w] for w in words[1:]]]
        return [self._of_piece(p)[1] for p in self.pattern.findall(text)]

    def counts(self, text: str) -> np.ndarray:
        """``counts[p]``: tokens of the first ``p`` characters of ``text``, for every p."""
        marks = list(self.special.finditer(text)) if self.special else []
        if not marks:
            changes = self._plain(text)
        else:
            changes, at = [], 0
            for m in marks:
                changes += self._plain(text[at : m.start()])
                changes.append(array("h", [0] * (m.end() - m.start() - 1) + [1]).tobytes())
                at = m.end()
            changes += self._plain(text[at:])
        out = np.zeros(len(text) + 1, dtype=np.int32)
        np.cumsum(np.frombuffer(b"".join(changes), dtype=np.int16), dtype=np.int32, out=out[1:])
        self._mend(text, marks, out)
        return out

    def _mend(self, text: str, marks: list, out: np.ndarray) -> None:
        """Count the prefixes again whose pieces are not those of the whole text."""
        bounds = [0, *(m.end() for m in marks)]
        ends = [*(m.start() for m in marks), len(text)]
        done = {}
        for m in _RUN.finditer(text) if _PAIR.search(text) else ():
            # a cut right behind a run of white space that goes on as another piece
            done[m.end()] = (m.start(), self._count(m.group()))
        if "'" in text:
            spans = [m.span() for m in _SHORT.finditer(text)]
            spans += [(b, b + 3) for b in bounds if text[b : b + 3] in _CONTRACTIONS]
            for start, end in spans:
                if end <= ends[bisect_right(bounds, start) - 1]:
                    done.update({cut: (start, self._count(text[start:cut])) for cut in range(start + 1, end)})
        for m in marks:
            # inside a special token its first characters are plain text
            k = bounds.index(m.end()) - 1
            start = self._restart(text, bounds[k], m.start())
            for cut in range(m.start() + 1, m.end()):
                done[cut] = (start, self._count(text[start:cut]))
        whole = {cut: int(out[start]) + n for cut, (start, n) in done.items()}
        for cut, n in whole.items():
            out[cut] = n

    def _count(self, text: str) -> int:
        return sum(self._of_piece(p)[0] for p in self.pattern.findall(text))

    def _restart(self, text: str, low: int, at: int) -> int:
        """Start of the last piece of the stretch that ends at ``at``."""
        last = low
        for m in self.pattern.finditer(text, low, at):
            last = m.start()
        return last


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_prefixes(docs: DataFrame, *, vocabulary: str, budget: int = 512, doc_id: str = "doc_id", text: str = "text", table: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, fit_chars[, prefix_tokens])`` per row of ``docs``.

    ``prefix_tokens[p]`` is the number of tokens of the first p characters,
    for p from 0 to the length of the text, as encoding just that prefix would
    give: ``tokens_of_prefix`` and ``longest_prefix`` answer from it without
    another encoding.  ``fit_chars`` is the longest prefix of at most ``budget``
    tokens.  ``table=False`` leaves the array out of the result.  A special
    token's string inside a text is that token, no other is added.

    A null text is an empty one, with no token and the table [0]; null ids and
    repeated rows stay as they are; other columns are left out.  ``vocabulary``
    is the path of a byte-level BPE file that every executor can open.
    """
    rows = docs.select(long_id(docs, doc_id).alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))

    def one(batch):
        counter = _counter(vocabulary)
        n_bytes, n_tokens, fit, tables = [], [], [], []
        for raw in utf8(batch.column("text")):
            counts = counter.counts(raw.decode("utf-8", "replace"))
            n_bytes.append(len(raw))
            n_tokens.append(int(counts[-1]))
            fit.append(int(np.flatnonzero(counts <= budget)[-1]))
            if table:
                tables.append(counts)
        arrays = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fit, pa.int64())]
        names = ["doc_id", "n_bytes", "n_tokens", "fit_chars"]
        if table:
            arrays.append(pa.array(tables, pa.list_(pa.int32())))
            names.append("prefix_tokens")
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_batches(rows, one, "doc_id bigint, n_bytes bigint, n_tokens bigint, fit_chars bigint" + ", prefix_tokens array<int>" * table)


def tokens_of_prefix(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters, from a stored table."""
    return F.get(prefix_tokens, F.least(chars, F.size(prefix_tokens) - 1))


def longest_prefix(prefix_tokens: Column, budget: Column) -> Column:
    """Most characters that can be kept within ``budget`` tokens, from a stored table."""
    return F.size(prefix_tokens) - 1 - F.aggregate(
        F.reverse(prefix_tokens), F.struct(F.lit(0).alias("n"), F.lit(False).alias("hit")),
        lambda s, c: F.struct((s["n"] + F.when(s["hit"] | (c <= budget), 0).otherwise(1)).alias("n"), (s["hit"] | (c <= budget)).alias("hit")),
        lambda s: s["n"])
