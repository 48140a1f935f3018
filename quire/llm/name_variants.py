"""Variant spellings of names typed by people: link the spellings of one person or body.

Method: suffix blocking. Names are cut into tokens; tokens that are overly common in the corpus (given names, the words of
a body's type) are told from the others (surnames, places) by their frequency alone. What a common token is typed like is
learnt too: slips, shortenings and contractions by the longest-common-subsequence, nicknames by co-variation, that is by
standing with the same surnames as the common token more often than chance allows. No list of names or of types is used.

The suffixes of a form's tokens, from a least length on, are counted over all forms; a token is indexed under its shortest
suffix that is not overly common. A token all of whose suffixes are overly common is not dropped but refined with the
other fields: it is indexed together with the beginning of each other token. Keys that are still common are split into
blocks in which every pair meets. Pairs are compared token by token with the longest-common-subsequence ratio. Full
spellings that agree are linked; a spelling with only initials joins the one group of full spellings it fits best, so that
an initial never joins two relatives. Groups are the connected components.

No step collects names on the driver: distinct strings are formed first (one author string may stand in a third of the
rows), blocks are joined by key, and components are found by min-label rounds with reliable checkpoints. What a pair must have
in common to be linked (near surnames, a letter of the given name) is tested while blocks are joined, so pairs that
only share a block are neither shuffled nor written. The common
tokens are sent to the executors: one in COMMON_SHARE tokens each, so there are at most COMMON_SHARE of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.blocking import pairs_by_key
from quire.session import Scratch, cut

#: Strings that stand where a name is missing.
NO_NAMES = ("desconocido", "unknown", "varios autores")

#: Words of address, of authorship and degrees, which are no part of a name.
TITLES = set("author autor autora by don dna doctor dr dra lady lord mr mrs ms phd por prof profesor professor profa sir sr sra srta".split())
PARTICLES = set("da das de del der di do dos el la las los of the van von y and".split())
_COMPANY = {"sa", "sl", "ltd", "inc"}
#: A token of at least one in so many tokens of the distinct names is overly common.
COMMON_SHARE = 1_000


def fold(s: str) -> str:
    """Lower case without accents, look-alike widths and invisible characters."""
    t = unicodedata.normalize("NFKD", s)
    return "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - bin(v).count("1")


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def alike(a: str, b: str) -> bool:
    """Equal but for a slip of the keyboard: one character more, less or other, or two swapped."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1 or min(n, m) < 3:
        return False
    return lcs(a, b) >= max(n, m) - 1


def name_tokens(raw: str) -> list[str]:
    """The folded tokens of a name in natural order (what follows a comma comes first), without particles and words of address.

    Capitals run together (``ML``) are initials, unless the whole name is in capitals.
    """
    text = re.sub(r"[(\[][^)\]]*[)\]]", " ", raw)
    text = re.sub(r"(?i),?\s*\bph\.?\s?d\b\.?", " ", text)
    shout = text.upper() == text
    halves = []
    for h in text.split(","):
        out: list[str] = []
        for w in _WORD.findall(fold_keep(h)):
            f = w.lower()
            if f in TITLES or f in PARTICLES:
                continue
            run = len(w) in (2, 3) and w.isupper() and not shout or shout and len(w) == 2 and not set(f) & set("aeiou")
            out += list(f) if run else [f]
        halves.append(out)
    return [w for h in halves[1:] for w in h] + halves[0]


def token_fit(a: str, b: str) -> int:
    """3: the same token but for a slip; 2: a shortening or contraction of three letters or more; 1: an initial or shorter; 0: different."""
    if a == b:
        return 3 if len(a) > 1 else 1
    short, full = sorted((a, b), key=len)
    if len(short) > 2 and (alike(a, b) or len(short) > 7 and ratio(a, b) >= 0.88):
        return 3
    if full.startswith(short):
        return 2 if len(short) > 2 else 1
    return 1 if 1 < len(short) < 6 and short[0] == full[0] and lcs(short, full) == len(short) and len(full) > len(short) + 1 else 0


def align(a: list[str], b: list[str]) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """(pairs (i, j, fit), left of a, left of b): tokens paired one to one, best fit first, then in order."""
    fits = sorted((-f, abs(i - j), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (f := token_fit(x, y)))
    pairs, ia, ib = [], set(range(len(a))), set(range(len(b)))
    for f, _, i, j in fits:
        if i in ia and j in ib:
            pairs.append((i, j, -f))
            ia.discard(i)
            ib.discard(j)
    return pairs, sorted(ia), sorted(ib)


_WORD = re.compile(r"[^\W\d_]+º?")


class Common:
    """The overly common tokens of a corpus, and which of them a token can stand for."""

    def __init__(self, tokens: Iterable[str]):
        self.tokens = frozenset(t for t in tokens if len(t) > 1)
        self.near: dict[str, set[str]] = {}
        for t in self.tokens:
            if len(t) > 3:
                for x in self._cuts(t):
                    self.near.setdefault(x, set()).add(t)
        self.known: dict[str, frozenset[str]] = {}

    @staticmethod
    def _cuts(t: str) -> set[str]:
        return {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}

    def kin(self, w: str) -> frozenset[str]:
        """The common tokens a token can stand for: itself, else those it is a slip, a shortening or a contraction of."""
        if w in self.tokens:
            return frozenset((w,))
        if len(w) < 2 or len(w) > 40:
            return frozenset()
        if w not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            near = {t for x in self._cuts(w) for t in self.near.get(x, ()) if alike(w, t)} if len(w) > 3 else set()
            short = {t for t in self.tokens if len(w) < len(t) and (t.startswith(w) or len(w) < 6 and w[0] == t[0] and lcs(w, t) == len(w) and len(t) > len(w) + 1)} if not near else set()
            self.known[w] = frozenset(near or {t for t in short if t.startswith(w)} or short)
        return self.known[w]


def read_name(tokens: list[str], kin: list[frozenset[str]]) -> tuple[list[int], list[int]]:
    """(indices of given names or words of a type, indices of surnames or words of a place), each in order.

    A token with common kin is given, and so is an initial at its side; where nothing tells, the first token is given.
    """
    n = len(tokens)
    given = {i for i in range(n) if kin[i]}
    rest = [i for i in range(n) if not kin[i] and len(tokens[i]) > 1]
    ones = [i for i in range(n) if len(tokens[i]) == 1]
    if not rest:
        if len(given) > 1:  # a surname as common as a given name: the last one
            given.discard(max(given))
        return sorted(given | set(ones)), [i for i in range(n) if i not in given and i not in ones]
    first = rest[0]
    full = set(given)
    for i in ones:
        if i < first or not full or any(g > first and g < i for g in full):
            given.add(i)
    if not given and n > 1:
        given = {0}
    if n > 2 and tokens[0] == "d" and kin[1]:  # D. before a given name is a word of address
        return sorted(given - {0}), [i for i in range(1, n) if i not in given]
    return sorted(given), [i for i in range(n) if i not in given]


def fold_keep(s: str) -> str:
    """Without accents and invisible characters, case kept (runs of capitals may be initials)."""
    t = unicodedata.normalize("NFKD", s)
    return "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def given_fit(a: str, b: str, ka: frozenset[str], kb: frozenset[str]) -> int:
    """2: the same given name in full; 1: one is an initial or a short contraction of the other; 0: different."""
    if a == b:
        return 2 if len(a) > 1 else 1
    if len(a) == 1 or len(b) == 1:
        one, full, kin = (a, b, kb) if len(a) == 1 else (b, a, ka)
        return 1 if full[0] == one or any(x[0] == one for x in kin) else 0
    if ka and kb:
        return 2 if ka & kb else 0
    fit = token_fit(a, b)
    return 2 if fit > 1 else fit


def surname_fit(a: str, b: str) -> int:
    """2: the same surname but for a slip; 1: an initial of it; 0: different."""
    if len(a) == 1 or len(b) == 1:
        return 1 if a[0] == b[0] else 0
    return 2 if alike(a, b) or len(a) > 7 and len(b) > 7 and ratio(a, b) >= 0.88 and abs(len(a) - len(b)) < 2 else 0


def same_name(ga: list[str], ka: list[frozenset[str]], sa: list[str], gb: list[str], kb: list[frozenset[str]], sb: list[str]) -> int:
    """2: surely one person or body; 1: one of the two has only initials that fit the other; 0: not the same."""
    if not ga or not gb:
        return 2 if not ga and not gb and len(sa) == len(sb) and all(surname_fit(x, y) == 2 for x, y in zip(sa, sb, strict=True)) else 0
    if not sa or not sb or surname_fit(sa[0], sb[0]) < 2:
        return 0
    if not all(surname_fit(x, y) for x, y in zip(sa[1:], sb[1:], strict=False)):
        return 0
    fits = [given_fit(x, y, kx, ky) for x, y, kx, ky in zip(ga, gb, ka, kb, strict=False)]
    if not all(fits) or fits[0] == 1 and sa[0] != sb[0] and len(sa) != len(sb):
        return 0  # an initial, a slip and a missing surname at once are too little to go by
    return fits[0]


FORM = "given array<string>, kin array<array<string>>, last array<string>"


def tokens_udf():
    """Vectorised :func:`name_tokens`; a name that holds only particles or words of address is taken by all its words, NULL is no name."""

    def one(raw: str | None) -> list[str] | None:
        if raw is None or fold(raw).strip() in ("", *NO_NAMES):
            return None
        words = name_tokens(raw)
        return [w for w in words if w not in _COMPANY] or words or [w.lower() for w in _WORD.findall(fold_keep(raw))] or None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([one(x) for x in b], dtype="object")

    return F.pandas_udf(run, "array<string>").asNondeterministic()


def common_tokens(tokens: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> list[str]:
    """The overly common tokens of (tokens), one row a distinct name: at most COMMON_SHARE."""
    n = keep(tokens.select(F.explode("tokens").alias("token")).groupBy("token").count())
    total = n.agg(F.sum("count")).first()[0] or 0
    return sorted(r.token for r in n.where(F.col("count") > max(3, total / COMMON_SHARE)).select("token").collect())


def form_udf(common: list[str]):
    """Vectorised reading of tokens, and of learnt kin by token, into a form."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        words = Common(common)
        for names, learnt in batches:
            out = []
            for tokens, more in zip(names, learnt, strict=True):
                told = {} if more is None else {x["token"]: frozenset(x["kin"]) for x in more}
                kin = [words.kin(t) | told.get(t, frozenset()) for t in tokens]
                given, last = read_name(list(tokens), kin)
                out.append(([tokens[i] for i in given], [sorted(kin[i]) for i in given], [tokens[i] for i in last]))
            yield pd.DataFrame(out, columns=["given", "kin", "last"], dtype="object")

    return F.pandas_udf(run, FORM).asNondeterministic()


#: A nickname stands with this part of its surnames beside the common name, and with so many surnames at least.
LEAST_SHARED, LEAST_SURNAMES = 0.25, 2


def nicknames(names: DataFrame) -> DataFrame:
    """(token, kin): tokens that co-vary with common ones, of (tokens, given, kin, last) of distinct names.

    A name without a common token has its given name first or last. Such a token, or a common one, stands for another common one if it is found
    with the very surnames of that one, for LEAST_SURNAMES different ones and LEAST_SHARED of all it has, or if it is a
    part of it (a subsequence) and one surname tells. Surnames that are themselves overly common hold many people and tell nothing,
    so they do only together with a second surname.
    """
    known = names.where(F.exists("kin", lambda k: F.size(k) == 1)).where(F.size("last") > 0).select(F.array_join("last", " ").alias("who"), F.explode(F.filter("kin", lambda k: F.size(k) == 1)).alias("k")).select("who", F.col("k")[0].alias("common")).distinct()
    n = F.size("tokens")
    sides = F.array(
        F.struct(F.element_at("tokens", 1).alias("token"), F.array_join(F.slice("tokens", 2, n - 1), " ").alias("who")),
        F.struct(F.element_at("tokens", -1).alias("token"), F.array_join(F.slice("tokens", 1, n - 1), " ").alias("who")),
    )
    plain = names.where((n > 1) & ~F.exists("kin", lambda k: F.size(k) > 0)).select(F.inline(sides)).where("length(token) > 1").distinct()
    plain = plain.unionByName(known.select(F.col("common").alias("token"), "who"))
    shared = plain.join(known, "who").where("token <> common").groupBy("token", "common").agg(F.count("*").alias("met"))
    each = plain.groupBy("token").agg(F.count("*").alias("all"))
    part = F.rlike("common", F.concat(F.lit("^.*"), F.array_join(F.split("token", ""), ".*"), F.lit(".*$")))
    good = shared.join(each, "token").where((F.col("met") >= LEAST_SURNAMES) & (F.col("met") >= LEAST_SHARED * F.col("all")) | part & (F.col("met") >= LEAST_SHARED * F.col("all")))
    return good.groupBy("token").agg(F.sort_array(F.collect_set("common")).alias("kin"))


def fit_udf():
    """Vectorised :func:`same_name` over the columns of two forms."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series([same_name(list(ga), [frozenset(k) for k in ka], list(sa), list(gb), [frozenset(k) for k in kb], list(sb)) for ga, ka, sa, gb, kb, sb in zip(*cols, strict=True)], dtype="int32")

    return F.pandas_udf(run, T.IntegerType()).asNondeterministic()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 40, scratch: Scratch | None = None) -> DataFrame:
    """(id, group): the least id of each connected component, for nodes (id) and undirected edges (a, b).

    Min-label rounds with pointer jumping: a node takes the least label among its own and its neighbours', then the
    label of its label. Labels are written each round, to ``scratch`` if given, so lineage stays short and an executor's loss costs one round.
    """
    keep = scratch.keep if scratch else cut
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = nodes.select("id", F.col("id").alias("group"))
    linked = keep(both.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("group")))
    for _ in range(most_rounds):
        near = both.join(linked.select("id", "group"), F.col("b") == F.col("id")).groupBy("a").agg(F.min("group").alias("least"))
        step = linked.select("id", "group").join(near, F.col("id") == F.col("a"), "left").select("id", F.least("group", F.coalesce("least", "group")).alias("group"), F.col("group").alias("was"))
        jump = step.select(F.col("id").alias("j"), F.col("group").alias("jumped"))
        new = keep(step.join(jump, step.group == jump.j, "left").select("id", F.least("group", F.coalesce("jumped", "group")).alias("group"), "was"))
        done = new.where(F.col("group") != F.col("was")).limit(1).count() == 0
        if scratch:
            scratch.drop(linked)
        linked = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.join(linked.select("id", F.col("group").alias("g")), "id", "left").select("id", F.coalesce("g", "group").alias("group"))


def blocks(forms: DataFrame, least: int = 4, common: int = 60) -> DataFrame:
    """(id, key) of every form under the suffix index; a key is a 64-bit number, whose collision only adds pairs to compare.

    ``least``: the shortest suffix; ``common``: a suffix of more forms than this is overly common. A token goes under
    its shortest suffix that is not; a token without one is refined with the beginning of each other token. The pairs
    of longer suffixes are pairs of the shorter one too, so one key a token loses nothing.
    """
    tokens = forms.select("id", F.explode(F.array_distinct(F.concat("fields", "last"))).alias("token"), F.concat("fields", "last").alias("all")).where(F.length("token") > 1)
    # Every length up to 20, then in growing steps, so that a token of any length has few suffixes.
    size = F.length("token")
    steps = [n for n in [*range(least, 21), 24, 32, 48, *(64 << k for k in range(25))] if n >= least]
    lengths = F.when(size < least, F.array(size)).otherwise(F.filter(F.array(*map(F.lit, steps)), lambda n: n <= size))
    suffixes = tokens.select("id", "token", "all", F.explode(lengths).alias("n")).withColumn("suffix", F.expr("right(token, n)"))
    often = suffixes.groupBy("suffix").agg(F.count_distinct("id").alias("forms"))
    fine = suffixes.join(often.where(F.col("forms") <= common), "suffix")
    best = fine.groupBy("id", "token").agg(F.min("n").alias("n")).select("id", F.expr("right(token, n)").alias("key"), "token")
    rest = tokens.join(best.select("id", "token"), ["id", "token"], "left_anti")
    others = F.filter("all", lambda x: (F.length(x) > 2) & (x != F.col("token")))
    refined = rest.select("id", "token", F.explode(F.when(F.size(others) > 0, others).otherwise(F.array(F.lit("")))).alias("other"))
    refined = refined.select("id", F.concat("token", F.lit("|"), F.substring("other", 1, 3)).alias("key"))
    # An initial is shorter than any suffix: the first letter of each given name, refined in the same way.
    people = forms.select("id", F.explode(F.array_distinct(F.transform("fields", lambda g: F.substring(g, 1, 1)))).alias("i"), "last")
    first = people.select("id", "i", F.explode("last").alias("other")).where(F.length("other") > 2)
    first = first.select("id", F.concat("i", F.lit("|"), F.substring("other", 1, 4)).alias("key"))
    return best.select("id", "key").union(refined).union(first).select("id", F.xxhash64("key").alias("key")).distinct()


def read_names(names: DataFrame, column: str, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(name, uses, given, kin, last) of every distinct name; nicknames are learnt from a first reading."""
    each = names.select(F.col(f"`{column}`").alias("name")).where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("uses"))
    each = keep(each.withColumn("tokens", tokens_udf()("name")).where("tokens is not null"))
    common = common_tokens(each, keep)
    read = form_udf(common)
    nothing = F.lit(None).cast("array<struct<token:string,kin:array<string>>>")
    first = keep(each.select("name", "uses", "tokens", read("tokens", nothing).alias("f")).select("name", "uses", "tokens", "f.*"))
    learnt = keep(nicknames(first))
    some = each.select("name", F.explode(F.array_distinct("tokens")).alias("token")).join(learnt, "token").groupBy("name").agg(F.collect_list(F.struct("token", "kin")).alias("more"))
    again = first.join(some, "name").select("name", "uses", read("tokens", "more").alias("f")).select("name", "uses", "f.*")
    return first.join(some, "name", "left_anti").select("name", "uses", "given", "kin", "last").unionByName(again)


def link_names(names: DataFrame, column: str = "name", least: int = 4, common: int = 60) -> DataFrame:
    """(name, group): every distinct name of the column with the id of its group.

    NULL, strings without a letter and the placeholders of ``NO_NAMES`` are no names and have no row. Equal strings are
    one name; a name without variants is a group of its own. Other columns are dropped.
    """
    with Scratch(names.sparkSession) as scratch:
        return cut(_linked(names, column, least, common, scratch))


def near(a: Column, b: Column) -> Column:
    """Whether two tokens can be the same but for slips: holds wherever :func:`alike` does, or a ratio of 0.88 at lengths that differ by one at most."""
    size = F.length(a) + F.length(b)
    most = F.greatest(F.lit(2), F.ceil(0.12 * size).cast("int"))
    return F.coalesce((a == b) | (F.abs(F.length(a) - F.length(b)) < 2) & (F.call_function("levenshtein", a, b, most) >= 0), F.lit(True))


def comparable() -> Column:
    """Holds for every two forms that :func:`same_name` can link: first surnames that are near, and first given names with a first letter in common (their own or their kin's) or near."""
    c = F.col
    return (c("id_a") < c("id_b")) & near(c("surname_a"), c("surname_b")) & (F.coalesce(F.arrays_overlap("letters_a", "letters_b"), F.lit(True)) | near(c("given_a"), c("given_b")))


def _linked(names: DataFrame, column: str, least: int, common: int, scratch: Scratch) -> DataFrame:
    keep, drop = scratch.keep, scratch.drop
    # A form is told by its fields themselves, joined by marks that no token holds. Its number follows the order of the forms.
    form = F.concat_ws("|", F.array_join("given", " "), F.array_join(F.transform("kin", lambda k: F.array_join(k, ",")), " "), F.array_join("last", " "))
    read = keep(read_names(names, column, keep).withColumn("form", form))
    fields = F.array_distinct(F.concat("given", F.flatten("kin")))
    forms = read.groupBy("form").agg(F.first("given").alias("given"), F.first("kin").alias("kin"), F.first("last").alias("last"), F.sum("uses").alias("uses")).withColumn("fields", fields)
    forms = keep(forms.orderBy("form").withColumn("id", F.monotonically_increasing_id()))
    named = keep(read.select("name", "form").join(forms.select("form", "id"), "form").select("name", "id"))
    drop(read)
    letters = F.array_distinct(F.transform(F.concat(F.slice("given", 1, 1), F.coalesce(F.try_element_at("kin", F.lit(1)), F.array())), lambda g: F.substring(g, 1, 1)))
    features = forms.select("id", F.try_element_at("last", F.lit(1)).alias("surname"), F.try_element_at("given", F.lit(1)).alias("given"), F.when(F.size("given") > 0, letters).alias("letters"))
    key = keep(blocks(forms, least, common).join(features, "id"))
    met = keep(pairs_by_key(key, key, able=comparable(), keep=keep))
    drop(key)
    side = lambda x: forms.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "given", "kin", "last")])
    pairs = met.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    fit = keep(pairs.select("a", "b", fit_udf()("given_a", "kin_a", "last_a", "given_b", "kin_b", "last_b").alias("fit")).where("fit > 0"))
    drop(met)
    sure = fit.where("fit = 2").select("a", "b")
    group = keep(components(forms.select("id"), sure, scratch=scratch))
    # A spelling with initials only, or with a contraction: the largest group of full spellings it fits.
    weight = forms.select("id", "uses").join(group, "id").groupBy("group").agg(F.sum("uses").alias("weight"))
    # Of two longer given names that fit only so, the shorter is the contraction.
    size = forms.select("id", F.coalesce(F.length(F.try_element_at("given", F.lit(1))), F.lit(3)).alias("size"))
    weak = fit.where("fit = 1").select("a", "b").union(fit.where("fit = 1").select("b", "a"))
    weak = keep(weak.join(size.withColumnsRenamed({"id": "a", "size": "sa"}), "a").join(size.withColumnsRenamed({"id": "b", "size": "sb"}), "b"))
    choice = weak.where("sb >= 3 and (sa < 3 or sa < sb)").select("a", "b")
    ranked = choice.join(group, choice.b == group.id).join(weight, "group").groupBy("a").agg(F.max(F.struct("weight", "group", "b")).alias("best"))
    chosen = keep(ranked.select("a", F.col("best.b").alias("b")))
    both = weak.where("a < b and sa < 3 and sb < 3").select("a", "b")
    both = both.join(chosen.select("a"), "a", "left_anti").join(chosen.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b")
    # The sure groups are one node each from here on.
    more, of = chosen.union(both), lambda x: group.select(F.col("id").alias(x), F.col("group").alias(f"g{x}"))
    joined = keep(more.join(of("a"), "a").join(of("b"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    final = components(group.select(F.col("group").alias("id")).distinct(), joined, scratch=scratch).withColumnsRenamed({"group": "g"})
    return named.join(group, "id").join(final.withColumnRenamed("id", "group"), "group").select("name", F.col("g").alias("group"))


def name_pairs(names: DataFrame, column: str = "name", **how) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code points: all pairs of different strings of one group."""
    g = link_names(names, column, **how)
    a, b = g.select("group", F.col("name").alias("name_a")), g.select("group", F.col("name").alias("name_b"))
    return a.join(b, "group").where("name_a < name_b").select("name_a", "name_b")
