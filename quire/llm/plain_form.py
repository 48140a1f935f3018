"""Visually identical text with different characters: one plain form for every string.

Method: a string is cut into words as they stand, look-alikes, ignorable characters and all. Each word that holds such
characters is run through a trie of the vocabulary by a weighted edit automaton: reading a look-alike as a letter it looks
like, a full-width form, ligature or overlaid stroke as what it shows, and skipping an ignorable character cost nothing;
any other edit costs one. A word that reaches the end of a vocabulary word within the allowed cost (0 for p4: typos stay)
takes that canonical spelling. Only words that reach none are normalised by the table of look-alikes, character by
character. Words wholly in another script stay; what script a word is in is told by itself, by its neighbours, or, where
all words of a string are made of look-alikes, by the vocabulary.

No vocabulary is collected or broadcast: distinct words of the text and of the vocabulary meet in blocks by their outline
(the first look of each character), each block builds its own trie of bounded size, and the canonical spellings are joined
back to the strings.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut

# Letters that look like a Latin letter, by script, in alphabetical order of the Latin letter.
CYRILLIC = dict(zip("аАВсСԁеЕһНіІӀјЈкКӏМмоОрРԛѕЅтТуУѵԝхХ", "aABcCdeEhHiIIjJkKlMmoOpPqsStTyYvwxX", strict=True))
GREEK = dict(zip("αΑΒϲϹΕΗιΙϳκΚΜηΝοΟρΡτΤυνχΧγΥΖω", "aABcCEHiIjkKMnNoOpPtTuvxXyYZw", strict=True))
ARMENIAN = dict(zip("հյոօՕզՏսՍ", "hjnoOqSuU", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPSTVWZ", strict=True))
PHONETIC = dict(zip("ɑɡ", "ag", strict=True))
LOOKS = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | PHONETIC
SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
#: Letters that look like a second one as well; the vocabulary tells which is meant, the table takes the first.
ALSO = {"ӏ": "I", "Ӏ": "l", "І": "l", "Ι": "l", "ν": "u", "η": "h"}
#: Letters with a stroke, as a letter and an overlaid stroke show them.
STROKES = {f"{a}{mark}": b for pair in ("oø", "OØ", "lł", "LŁ", "dđ", "DĐ", "hħ", "HĦ", "tŧ", "TŦ") for a, b in [pair] for mark in "\u0335\u0337\u0338"}
#: Marks that stand for an ordinary one: hyphens and the dot between facet and value.
MARKS = dict.fromkeys("‐‑﹣－", "-") | dict.fromkeys("·‧⋅∙", "·")
#: Compatibility forms that look like what they stand for; the others (superscripts, fractions, circled ...) do not.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")

#: JVM pattern of characters that may need work; a string without them is plain and never reaches Python.
SUSPECT = r"[^ -~¡-¬®-ɏḀ-ỿ]"


def ignorable(c: str) -> bool:
    """Characters that show nothing: format characters, joiners, selectors."""
    return unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ᠎" or "︀" <= c <= "️" or "᠋" <= c <= "᠏"


def script(c: str) -> str:
    """LATIN, CYRILLIC, GREEK ... of a letter, '' of anything else."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def same_look(c: str) -> str:
    """Full-width forms, ligatures and Roman numerals as the characters they show."""
    d = unicodedata.decomposition(c)
    if d.startswith(SAME_LOOK) or d.startswith("<compat>") and ("ﬀ" <= c <= "ﬆ" or "Ⅰ" <= c <= "ⅿ"):
        return unicodedata.normalize("NFKC", c)
    return c


def wordlike(c: str) -> bool:
    """Letters, their marks, what shows letters, and what shows nothing."""
    return c.isalpha() or unicodedata.combining(c) > 0 or ignorable(c) or same_look(c)[:1].isalpha()


def odd(word: str) -> bool:
    """Whether a word holds a character that may have to be read as another."""
    return any(not c.isascii() and (c in LOOKS or c in ALSO or unicodedata.combining(c) or ignorable(c) or same_look(c) != c) for c in word)


def readings(c: str) -> tuple[str, ...]:
    """What one character can be read as at no cost, the nearest look first; decomposed."""
    if c.isascii():
        return (c,)
    first = unicodedata.normalize("NFD", same_look(c))
    return tuple(dict.fromkeys([LOOKS.get(c) or MARKS.get(c) or first, *ALSO.get(c, ""), first]))


#: The cost of an edit; a second look costs one, so that it decides between spellings and never against one.
EDIT = 100


class Trie:
    """Vocabulary trie over decomposed characters, traversed by an edit automaton."""

    def __init__(self, words: Iterable[tuple[str, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[tuple[str, int] | None] = [None]
        for w, n in sorted(words):
            at = 0
            for c in unicodedata.normalize("NFD", w):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                at = self.next[at][c]
            old = self.word[at]
            self.word[at] = (unicodedata.normalize("NFC", w), n + (old[1] if old else 0))

    def walk(self, node: int | None, chars: str) -> int | None:
        for c in chars:
            node = self.next[node].get(c) if node is not None else None
        return node

    def best(self, chars: str, budget: int = 0) -> tuple[int, int, str] | None:
        """(cost, -uses, spelling) of the vocabulary word reached with the least cost, the commonest and then the first by code points on ties."""
        most = budget * EDIT + EDIT - 1
        chars = "".join(c if c in LOOKS else unicodedata.normalize("NFD", c) for c in chars)
        states: list[dict[int, int]] = [{} for _ in range(len(chars) + 2)]
        states[0][0] = 0

        def reach(i: int, node: int | None, cost: int) -> None:
            if node is not None and cost <= most and cost < states[i].get(node, most + 1):
                states[i][node] = cost

        for i, c in enumerate(chars):
            todo = list(states[i].items()) if budget else ()
            while todo:  # characters of the vocabulary that the text lacks
                node, cost = todo.pop()
                for to in self.next[node].values():
                    if cost + EDIT <= most and cost + EDIT < states[i].get(to, most + 1):
                        states[i][to] = cost + EDIT
                        todo.append((to, cost + EDIT))
            skip, stroke = ignorable(c), STROKES.get(chars[i : i + 2])
            for node, cost in states[i].items():
                if skip:
                    reach(i + 1, node, cost)
                    continue
                for k, reading in enumerate(readings(c)):
                    reach(i + 1, self.walk(node, reading), cost + (k > 0))
                if stroke:
                    reach(i + 2, self.walk(node, stroke), cost)
                if cost + EDIT <= most:
                    reach(i + 1, node, cost + EDIT)
                    for to in self.next[node].values():
                        reach(i + 1, to, cost + EDIT)
        last = states[len(chars)]
        todo = list(last.items()) if budget else ()
        while todo:
            node, cost = todo.pop()
            for to in self.next[node].values():
                if cost + EDIT <= most and cost + EDIT < last.get(to, most + 1):
                    last[to] = cost + EDIT
                    todo.append((to, cost + EDIT))
        return min(((cost, -self.word[n][1], self.word[n][0]) for n, cost in last.items() if self.word[n]), default=None)

    def find(self, chars: str, budget: int = 0) -> str | None:
        got = self.best(chars, budget)
        return got[2] if got else None


def shown(chars: str, latin: bool) -> str:
    """The table: what is left of the characters without ignorables and compatibility forms, look-alikes as Latin letters if ``latin``."""
    text = unicodedata.normalize("NFD", "".join(same_look(c) for c in chars if not ignorable(c)))
    text = "".join(" " if unicodedata.category(c) == "Zs" else MARKS.get(c, c) for c in text)
    return unicodedata.normalize("NFC", "".join(LOOKS.get(c, c) for c in text) if latin else text)


def outline(word: str) -> str:
    """A key that all words with a common reading share: the first look of each character, without marks, I and l alike."""
    base = "".join(readings(c)[0] for c in word if not ignorable(c))
    base = unicodedata.normalize("NFD", "".join(_UNSTROKED.get(c, c) for c in base))
    return "".join(_ONE.get(c, c) for c in base if not unicodedata.combining(c))


_UNSTROKED = {b: a[0] for a, b in STROKES.items()}
_ONE = {"I": "l", "u": "v", "h": "n"}


def pieces(text: str) -> list[tuple[str, str]]:
    """(piece, script): words as they stand and what is between them. The script is '' for none, 'latin', 'sure' for a word of another script, 'maybe' for look-alikes only."""
    cuts: list[str] = []
    was = None
    for c in text:
        kind = wordlike(c)
        if kind == was:
            cuts[-1] += c
        else:
            cuts.append(c)
        was = kind
    out = []
    for p in cuts:
        seen = unicodedata.normalize("NFD", "".join(same_look(c) for c in p if not ignorable(c)))
        other = [c for c in seen if script(c) in SCRIPTS]
        if any(c not in LOOKS and c not in ALSO for c in other):
            out.append((p, "sure"))  # a letter that no Latin one looks like; a Latin letter in such a word is a slip, and slips stay
        elif any(script(c) == "LATIN" for c in seen):
            out.append((p, "latin"))
        else:
            out.append((p, "maybe" if other else ""))
    return out


def asked_words(text: str | None) -> list[str]:
    """The words of a string that the vocabulary is asked for."""
    return sorted({p for p, f in pieces(text or "") if f in ("latin", "maybe") and odd(p)})


def plain_form(text: str | None, find: Callable[[str], str | None] = lambda _: None) -> str | None:
    """The plain form of one string; ``find`` gives the canonical spelling of a word, if the vocabulary has one.

    NULL stays NULL; the empty string stays empty; case, blanks' number and typos stay.
    """
    if not text:
        return text
    parts = pieces(text)
    scripts = [f for _, f in parts]
    out = []
    for i, (p, f) in enumerate(parts):
        latin = f == "latin"
        canon = find(p) if f in ("latin", "maybe") and odd(p) else None
        if f == "maybe":
            # The nearest word that is surely of one script tells, before and after; the vocabulary settles the rest.
            before = next((x for x in reversed(scripts[:i]) if x in ("latin", "sure")), "")
            after = next((x for x in scripts[i + 1 :] if x in ("latin", "sure")), "")
            latin = "sure" not in (before, after) and (bool(before or after) or canon is not None)
        out.append(canon if latin and canon is not None else shown(p, latin))
    return unicodedata.normalize("NFC", "".join(out))


def word_vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): all words of the plain strings, however rare, with the number of strings they stand in."""
    plain = texts.where(F.col(column).isNotNull() & ~F.col(column).rlike(SUSPECT)).select(column)
    words = plain.select(F.explode(F.array_distinct(F.split(column, r"[^\p{L}\p{M}]+"))).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _each(f, kind: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([f(x) for x in b], dtype="object")

    return F.pandas_udf(run, kind).asNondeterministic()  # evaluated once where it stands


#: Most words of a trie, on average: a block of this size takes some 40 MB in a worker.
TRIE_WORDS = 20_000


def canonical(words: DataFrame, vocabulary: DataFrame, budget: int = 0, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, canon): of the distinct ``words`` (word), those that reach a word of ``vocabulary`` (word, n) within ``budget`` edits.

    Without edits a word can only reach words of its own outline, so both are spread by it; with edits every block of
    the vocabulary is asked for every word, and the least cost decides.
    """
    known = vocabulary.groupBy("word").agg(F.sum("n").alias("n"))
    blocks = max(1, -(-known.count() // trie_words))
    line = _each(outline, "string")
    spread = F.pmod(F.xxhash64(line("word")), F.lit(blocks))
    asked = words.distinct()
    asked = asked.withColumn("block", spread) if not budget else asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):
            trie = Trie(zip(right["word"], right["n"], strict=True))
            for w in left["word"]:
                if got := trie.best(w, budget):
                    out.append((w, *got))
        return pd.DataFrame(out, columns=["word", "cost", "uses", "canon"]).astype({"cost": "int64", "uses": "int64"})

    found = asked.groupBy("block").cogroup(known.withColumn("block", spread).groupBy("block")).applyInPandas(run, "word string, cost long, uses long, canon string")
    return found.groupBy("word").agg(F.min(F.struct("cost", "uses", "canon"))["canon"].alias("canon"))


def plain_strings(strings: DataFrame, vocabulary: DataFrame, budget: int = 0) -> DataFrame:
    """(string, plain) of every distinct string of the one column of ``strings`` that holds suspect characters.

    NULL, and strings without suspect characters, are left out in the JVM; Python sees only the odd ones.
    """
    (column,) = strings.columns
    odd_ones = strings.select(F.col(f"`{column}`").alias("string")).where(F.col("string").rlike(SUSPECT)).distinct()
    odd_ones = cut(odd_ones.withColumn("words", _each(asked_words, "array<string>")("string")))
    each = odd_ones.select("string", F.explode("words").alias("word"))
    canon = canonical(each.select("word"), vocabulary, budget)
    told = each.join(canon, "word").groupBy("string").agg(F.collect_list(F.struct("word", "canon")).alias("told"))

    @F.pandas_udf("string")
    def plain(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spellings in batches:
            yield pd.Series([plain_form(t, {} .get if s is None else {x["word"]: x["canon"] for x in s}.get) for t, s in zip(texts, spellings, strict=True)], dtype="object")

    return odd_ones.join(told, "string", "left").select("string", plain.asNondeterministic()("string", "told").alias("plain"))


def odd_strings(df: DataFrame, key: str, column: str, vocabulary: DataFrame, budget: int = 0) -> DataFrame:
    """(rec_id, plain) of the rows whose string differs from its plain form; each key and form once.

    NULL and empty strings give no row. The input may hold any other columns; they are dropped.
    """
    rows = df.select(F.col(f"`{key}`").alias("rec_id"), F.col(f"`{column}`").alias("string")).where(F.col("string").rlike(SUSPECT))
    made = plain_strings(rows.select("string"), vocabulary, budget)
    return rows.join(made, "string").where(F.col("plain") != F.col("string")).select("rec_id", "plain").distinct()


def plain_elements(df: DataFrame, key: str, column: str, vocabulary: DataFrame) -> DataFrame:
    """The rows with every string of an array column in its plain form; only rows with odd strings are taken apart.

    ``key`` may stand in several rows; it is any column or struct that tells which rows hold the same array.
    """
    is_odd = F.coalesce(F.exists(F.col(column), lambda t: t.rlike(SUSPECT)), F.lit(False))
    some = df.where(is_odd)
    each = some.select(key, F.explode(F.array_distinct(column)).alias("string"))
    made = each.join(plain_strings(each.select("string"), vocabulary), "string").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("string", "plain"))).alias("_plain"))
    mended = some.join(made, key).withColumn(column, F.transform(column, lambda t: F.coalesce(F.element_at("_plain", t), t))).drop("_plain")
    return df.where(~is_odd).unionByName(mended.select(df.columns))
