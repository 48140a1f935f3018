"""Encoding of a whole corpus with a public byte-level BPE tokenizer, without special tokens.

Method: per-prefix dynamic programming. For every prefix of a piece there is exactly one last token in the encoding of
that prefix. A string automaton over the vocabulary gives the tokens that end at a position; a candidate is the last
token when it is compatible with the last token of the prefix it leaves, that is when merging the two alone gives the
two again. One compatible candidate exists, so the encoding of a piece of n bytes takes n such look-ups, however the
merges fall, and is read off by following the tokens back from the end. Merges are never simulated on the text.

The vocabulary (its size is fixed by the tokenizer, about 50,000 entries) is read once by the driver and sent to the
executors as a broadcast of a few MB; a worker builds its automaton once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizer's file is; a parameter everywhere.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the tokenizer's published pattern for splitting a text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces up to this many characters are remembered by a worker, which forgets all when it holds so many.
REMEMBER, REMEMBERED = 40, 200_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in vocabulary files of this kind: printable Latin-1 for itself, else from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_vocabulary(path: str = BYTE_BPE) -> tuple[list[tuple[bytes, int]], list[tuple[int, int]]]:
    """The tokens by merge order as (bytes, id), the 256 bytes first, and the merges as pairs of places in that list."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = {c: b for b, c in byte_letters().items()}
    vocab = model["vocab"]
    tokens = [(bytes([byte[c]]), vocab[c]) for c in sorted(byte, key=lambda c: vocab[c])]
    place = {t: i for i, (t, _) in enumerate(tokens)}
    merges = []
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        pair = [bytes(byte[c] for c in x) for x in (a, b)]
        merges.append((place[pair[0]], place[pair[1]]))
        joined = pair[0] + pair[1]
        place[joined] = len(tokens)
        tokens.append((joined, vocab[a + b]))
    return tokens, merges


class Encoder:
    """Encodes texts with one vocabulary; made once in each worker."""

    def __init__(self, tokens: list[tuple[bytes, int]], merges: list[tuple[int, int]]):
        import ahocorasick
        import regex

        self.ids = [i for _, i in tokens]
        self.length = [len(t) for t, _ in tokens]
        self.halves = [(i, i) for i in range(256)] + merges
        self.joined = {pair: 256 + k for k, pair in enumerate(merges)}
        self.single = {t.decode("latin-1"): i for i, (t, _) in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, (t, _) in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES).findall
        self.agree: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives just these two tokens.

        The later of the two merges is undone, again and again, down to single bytes; at each step the tokens that
        touch at the border must have no merge of their own that comes before the one just undone.
        """
        key = (a, b)
        known = self.agree.get(key)
        if known is not None:
            return known
        halves, joined, bound, ok = self.halves, self.joined, len(self.ids), True
        while True:
            if joined.get((a, b), bound) < bound:
                ok = False
                break
            left, right = a >= 256, b >= 256
            if not (left or right):
                break
            if left and a > b:
                bound, a = a, halves[a][1]
            else:
                # On the right a merge of equal rank with the bound happens after the one across the border.
                bound, b = b + 1, halves[b][0]
        if len(self.agree) >= 4 * REMEMBERED:
            self.agree.clear()
        self.agree[key] = ok
        return ok

    def piece(self, text: str) -> list[int]:
        """Places of the tokens of one piece, whose bytes stand as Latin-1 characters."""
        if (whole := self.single.get(text)) is not None:
            return [whole]  # the vocabulary's own tokens encode to themselves
        last = [-1] * (len(text) + 1)
        length, compatible = self.length, self.compatible
        done = 0
        for end, token in self.automaton.iter(text):
            end += 1
            if end == done:
                continue
            start = end - length[token]
            if start == 0 or last[start] >= 0 and compatible(last[start], token):
                last[end] = token
                done = end
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or missing one."""
        out: list[int] = []
        known, ids = self.known, self.ids
        for p in self.pieces(text or ""):
            got = known.get(p)
            if got is None:
                got = [ids[i] for i in self.piece(p.encode("utf-8", "surrogatepass").decode("latin-1"))]
                if len(p) <= REMEMBER:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = got
            out += got
        return out


_made: dict[str, Encoder] = {}


def _encoder(key: str, vocabulary) -> Encoder:
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(*vocabulary.value)
    return _made[key]


def encoder_udf(spark, kind: str, path: str = BYTE_BPE):
    """A vectorised function of a text column: its ids (``array<int>``) or, for ``bigint``, their number."""
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(path, vocabulary)
        for texts in batches:
            yield pd.Series([enc.encode(t) for t in texts], dtype="object")

    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(path, vocabulary)
        for texts in batches:
            yield pd.Series([len(enc.encode(t)) for t in texts], dtype="int64")

    return F.pandas_udf(ids if kind == "array<int>" else sizes, kind)


def token_ids(df: DataFrame, text: Column, out: str = "ids", path: str = BYTE_BPE) -> DataFrame:
    """The table with a column ``out`` of token ids (an existing one of that name is replaced).

    An empty and a NULL text have the empty list, never NULL. Texts are encoded whole, whatever their length. The work
    is per row: nothing is shuffled, and a hot source or language costs no task more than its share of the file.
    """
    return df.withColumn(out, encoder_udf(df.sparkSession, "array<int>", path)(text))


def token_counts(df: DataFrame, text: Column, out: str = "tokens", path: str = BYTE_BPE) -> DataFrame:
    """The table with a column ``out`` counting the tokens; 0 for empty and NULL texts."""
    return df.withColumn(out, encoder_udf(df.sparkSession, "bigint", path)(text))
