"""Personal information inside free text: find it with its kind, and replace it by typed placeholders.

Method: information-theoretic sanitisation. Addresses of mail and street, phone and identity numbers have a grammar and
are found by it; they are the protected entities. Names have none, and most names in these texts are of characters and
authors. What a term around a name reveals is estimated from the whole corpus, without any list of such terms: of the
texts in which the term stands at a name, how many hold another protected entity, against how many would if only the
kind of document told. The disclosure of a term has two figures: ``gain``, the part of the possible increase of that
probability which the term brings, and ``bits``, the information against the base rate over all its texts, which tells
whether the counts bear it. Terms beyond both thresholds disclose; a name at such a term is personal and replaced by a
placeholder, other names stay, so the text remains readable. Names so found are protected entities themselves: a second
round estimates again with them, which carries the evidence to terms that seldom stand beside numbers.

A repeated text counts once. The threshold in bits grows with the logarithm of the number of terms, so that the number
of terms taken by chance has one bound for corpora of every size. Counts cover all documents, are aggregated before they
are shuffled, and terms are joined to the spans by key: nothing of the corpus is gathered on the driver.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import cut, one_row

STRUCTURED = ("email", "phone", "id", "address")
KINDS = (*STRUCTURED, "person")

_AT = r"(?:@|＠|\s?[(\[{]\s?(?:at|arroba)\s?[)\]}]\s?|\s(?:at|arroba)\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punto|ponto|point)\s?[)\]}]\s?|\s(?:dot|punto|ponto|point)\s)"
EMAIL = re.compile(rf"(?i)(?<![\w.+%-])[\w][\w.+%-]*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]*[a-z0-9])+(?![\w@])")

_S = r"[ .\u00a0-]"
_GROUPS = "|".join((rf"\d{{3}}{_S}\d{{3}}{_S}\d{{4}}", rf"\d{{3}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}", rf"\d{{3}}{_S}\d{{3}}{_S}\d{{3}}", rf"\d{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}", rf"\d{{4}}{_S}\d{{3}}{_S}\d{{3}}", rf"\d{{4,5}}{_S}\d{{6}}", rf"\d{{2}}{_S}\d{{4}}{_S}\d{{4}}", rf"\d{{2}}{_S}\d{{3}}{_S}\d{{4}}", r"\d{9,10}"))
_LAND = rf"(?:\(\+\d{{1,3}}\)|\+\d{{1,3}}|00(?:1|2\d\d?|3\d\d?|4\d|5\d\d?|6\d|7|8\d|9\d))"
PHONE = re.compile(
    r"(?<![\w#])(?<!\d[.,/-])(?:"
    rf"{_LAND}{_S}?(?:\(0\){_S}?)?(?:{_GROUPS})"
    rf"|1-\d{{3}}-\d{{3}}-\d{{4}}|\(\d{{2,4}}\){_S}?\d{{3}}{_S}\d{{4}}|\d{{3}}{_S}\d{{3}}{_S}\d{{4}}"
    rf"|0\d{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}|0\d{{4}}{_S}\d{{6}}|0\d{{3}}{_S}\d{{3}}{_S}\d{{3,4}}"
    r"|[5-9]\d{2}([ -])\d{3}\1\d{3}|[5-9]\d{2}([ .-])\d{2}\2\d{2}\2\d{2}|[5-9]\d{8}"
    r")(?![\w-])(?!\.\d)"
)
ID = re.compile(
    r"(?<![\w-])(?<!\d[.,/])(?:\d{8}[ -]?[A-HJ-NP-TV-Z]|\d{2}\.\d{3}\.\d{3}[ -]?[A-HJ-NP-TV-Z]|[XYZ][ -]?\d{7}[ -]?[A-HJ-NP-TV-Z]"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2})(?![\w-])(?!\.\d)"
)

_UP = r"[A-ZÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÑÇŁØ]"
_LOW = r"[\w'’]"
_WORD = rf"{_UP}{_LOW}+(?:-{_UP}{_LOW}+)*"
_LINK = r"(?:de la|de los|de las|del|de|la|los|las|du|des|do|da|dos|das|y)"
_PLACE = rf"(?:(?:{_LINK} )*{_WORD}(?: (?:{_LINK} )*{_WORD})*)"
_FLOOR = (
    r"(?:esc\. ?\w+|piso \w+|planta \w+|puerta \w+|bajo(?: [A-Z])?|ático(?: [A-Z])?|\d{1,2} ?\.?[ºª°](?: ?(?:izq|dcha|dch|der|[A-Z])\b)?|\d{1,2}-[A-Z]\b|\d{1,2} ?[A-Z]\b"
    r"|(?:Flat|Unit|Apt|Suite|Room|Floor|Apartment)\.? ?\w+|(?:apt|appt|bât|étage)\.? ?\w+)"
)
_STREET = r"(?:[Cc]alle|CALLE|[Cc]/|[Cc]l\.|[Aa]venida|AVENIDA|[Aa]vda\.|[Aa]v\.|[Pp]laza|PLAZA|[Pp]za\.|[Pp]aseo|PASEO|[Pp]\.?º|[Cc]amino|CAMINO|[Tt]ravesía|[Rr]onda|[Cc]arretera|[Cc]tra\.|[Rr]ua|[Ll]argo|[Pp]raça)"
_RUE = r"(?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|Rue|Avenue|Boulevard|Place|Chemin)"
_WAY = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Row|Close|Court|Drive|Dr|Way|Terrace|Square|Crescent|Gardens|Hill|Place)\b(?:\.(?=,| ?#))?(?! [A-Z][a-z]+ (?:Street|St|Road|Rd|Lane|Row)\b)"
_CODE = r"(?:\d{4,5}|\d{5}-\d{3})"
ADDRESS = re.compile(
    rf"(?<!\w)(?:{_STREET} ?{_PLACE}(?:,? ?(?:n\.?[ºo°]\.?|núm\.|num\.)? ?\d{{1,4}}\b)(?: (?:bis|dpdo))?(?:, {_FLOOR})*(?:, {_CODE} {_WORD}|, {_CODE}\b)?"
    rf"|\d{{1,4}}(?: bis| ter)?,? {_RUE} (?:(?:du|des|de la|de l'|de|d')? ?{_WORD}|{_PLACE})(?: {_WORD})*(?:, {_FLOOR})*(?:, {_CODE} {_WORD})?"
    rf"|\d{{1,5}} {_WORD}(?: {_WORD}){{0,3}}? {_WAY}(?: ?#\d+)?(?:, {_FLOOR})*(?:,? #\d+)?(?:, {_WORD}(?: {_CODE}\b)?)?)"
)

#: Words of address, no part of a name.
_TITLES = r"(?:(?:Mr|Mrs|Ms|Dr|Dra|Sr|Sra|Srta|Prof|Mme|Mlle|Dña)\.|D\.ª|Dª|Don|Doña|Señor|Señora|Sir|Lady|Miss) "
_NAME_LINK = r"(?:de la|de los|de las|del|de|von|van|da|do|dos)"
_INITIAL = rf"{_UP}\."
_FIRST = rf"(?:{_WORD}|{_INITIAL})"
_NAME = rf"(?:{_NAME_LINK} )?{_FIRST}(?: (?:{_NAME_LINK} )?{_FIRST})*"
#: Closing words that stand before a signature, with a comma.
_CLOSINGS = "Atentamente|Best|Cheers|Cordialement|Cumprimentos|Gracias|Merci|Obrigada|Obrigado|Regards|Saludos|Sincerely|Thanks|Yours"
SPAN = re.compile(rf"(?<![\w«\"“'’-])(?!(?:{_CLOSINGS}),)({_TITLES})?({_NAME})((?:, {_FIRST}(?: {_FIRST}){{0,2}})?)")

#: A term discloses if it brings this part of the possible increase ...
LEAST_GAIN = 0.25
#: ... and its bits exceed the logarithm of the number of terms by this: at most eight terms are then due to chance.
SURPLUS_BITS = -3.0
#: Fewest bits, however few terms there are.
LEAST_BITS = 6.0
#: Estimates: the first from items with a grammar, each further one with the names of the one before.
ROUNDS = 2
#: A word that begins so many disclosed names is a name by itself.
LEAST_NAMES = 3
#: Words that open a sentence with a capital and are no name.
_OPENERS = set(
    "A Al An And Aquel Aquella As At Bajo Before Beneath Beside Between By Cada Con Cuando De Desde Durante El Ella En Entre Em Esa Ese Esta Este For From He Her His I I'd I'm I've If In It La Las Le Les Lo Los Mi Mon My Na "
    "No Nadie Nobody O On Os Para Pero Por Según She Si Sin Sou Soy Su Sus That The They They'd This To Todo Tras Un Una Uno When With Without Y À Le L'été Quand Junto Antes Al Dos Two".split()
)

_TOKEN = re.compile(r"\[(?:email|phone|id|address)\]|[^\W\d_](?:[\w'’.º-]*[\wº.])?[:,;]?|\d[\d.]*[:,;]?|[^\w\s]")


def structured(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items with a grammar, without overlaps, in order; mail goes before numbers, these before streets."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in (("email", EMAIL), ("id", ID), ("phone", PHONE), ("address", ADDRESS)):
        for m in pattern.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b, _ in found):
                found.append((m.start(), m.end(), kind))
    return sorted(found)


def tokens(text: str, at: int, count: int, after: bool) -> list[str]:
    """The ``count`` tokens next to a position, in order, in lower case with numbers as #; read in growing windows, so none is cut."""
    size = 64
    while True:
        part = text[at : at + size].replace("&lt;", "<") if after else text[max(0, at - size) : at]
        found = _TOKEN.findall(part)
        if len(found) > count or (at + size >= len(text) if after else size >= at):  # one more than asked: only the outermost can be cut
            chosen = found[:count] if after else found[-count:]
            return [re.sub(r"\d[\d.]*", "#", t.lower()) for t in chosen]
        size *= 4


def context(text: str, start: int, end: int) -> list[str]:
    """The terms around a name: the one or two before it, and what follows it.

    A term does not reach over the end of a sentence or, but for a colon or comma, of a line.
    """
    left, right = tokens(text, start, 2, False), tokens(text, end, 3, True)
    terms = []
    ends = not left or left[-1][-1] in ".!?…»”\")]" and left[-1] not in ("n.º", "no.", "d.ª")
    gap = start
    while gap and text[gap - 1].isspace():
        gap -= 1
    if not ends and ("\n" not in text[gap:start] or left[-1][-1] in ",:"):
        terms += ["l:" + left[-1], "l2:" + " ".join(left)]
    if right and right[0][0] not in ".!?…»”\")":
        terms.append("r:" + "".join(right[: 3 if right[0] == "<" else 1 if right[0][-1] in ".!?…" else 2]))
    return terms


def names(text: str, items: list[tuple[int, int, str]]) -> list[tuple[int, int, list[str], bool]]:
    """(start, end, terms, lone) of the name-like spans outside the structured items; ``lone`` is one word within a sentence."""
    pieces, at, size, shift = [], 0, 0, []
    for a, b, kind in items:
        pieces += [text[at:a], f"[{kind}]"]
        size += a - at + len(kind) + 2
        shift.append((size, b - size))
        at = b
    masked = "".join([*pieces, text[at:]])

    def back(pos: int) -> int:
        n = bisect_right(shift, (pos, len(text)))
        return pos + (shift[n - 1][1] if n else 0)

    out = []
    for m in SPAN.finditer(masked):
        name, rest = m[2], m[3]
        lead = 0
        while (first := _HEAD.match(name, lead)) and first[0][:-1] in _OPENERS:
            lead = first.end()
        name = name[lead:]
        one = " " not in name
        start, end = m.start(2) + lead, m.end(2)
        # Surname, given name. A word of its own after the comma would start with a small letter or be a masked item.
        if rest and name.count(" ") < 4 and (one or not any(w.endswith(".") for w in _PART.findall(name))):
            end = m.end(3)
        lone = one and end == m.end(2)
        if lone and (name.isupper() or name in _OPENERS):
            continue
        terms = context(masked, start if lead else m.start(), end)
        if not lone or terms and terms[0][0] == "l":
            out.append((back(start), back(end - 1) + 1, terms, lone))
    return out


_HEAD, _PART = re.compile(r"\S+ "), re.compile(rf"{_WORD}|{_INITIAL}")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("found", T.StringType()), T.StructField("terms", T.ArrayType(T.StringType()))]))


def spans_udf():
    """Vectorised search: the structured items and the name-like spans (kind ``name``, of one word ``word``) of each text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for text in b:
                items = structured(text) if text else []
                rows = [{"kind": k, "start": s, "found": text[s:e], "terms": []} for s, e, k in items]
                rows += [{"kind": "word" if lone else "name", "start": s, "found": text[s:e], "terms": t} for s, e, t, lone in (names(text, items) if text else [])]
                out.append(rows)
            yield pd.Series(out, dtype="object")

    return F.pandas_udf(run, SPANS).asNondeterministic()


def spans(docs: DataFrame, key: str, text: str, group: list[str]) -> DataFrame:
    """(key, group, whole, spans): one row per document; ``whole`` is a hash of its text."""
    kind = F.concat_ws("/", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group])
    return docs.select(F.col(key).alias("key"), kind.alias("group"), F.xxhash64(text).alias("whole"), spans_udf()(F.col(text)).alias("spans"))


def disclosure(found: DataFrame) -> DataFrame:
    """(term, docs, seen, due, gain, bits): how strongly each term at a name reveals another protected entity, over all texts.

    ``found`` is that of :func:`spans`, with ``own`` (starts of the names known to be personal, or NULL). ``docs`` counts
    the term's texts, ``seen`` those that hold a protected entity besides the name and the term, ``due`` how many would
    if only the group told. An item within the term itself is no evidence for it.
    """
    exact = F.size(F.filter("spans", lambda s: ~s["kind"].isin("name", "word")))
    own = F.coalesce("own", F.array().cast("array<int>"))
    each = found.select("group", "whole", F.filter("spans", lambda s: s["kind"] == "name").alias("names"), own.alias("own"), (exact + F.size(own)).alias("n")).dropDuplicates(["group", "whole"])

    def other(s, t):
        return F.col("n") - F.array_contains("own", s["start"]).cast("int") - F.contains(t, F.lit("[")).cast("int") > 0

    def flagged(values, flag: int):
        return F.transform(F.array_distinct(F.flatten(values)), lambda t: F.struct(t.alias("term"), F.lit(flag).alias("flag")))

    every = flagged(F.transform("names", lambda s: s["terms"]), 0)
    beside = flagged(F.transform("names", lambda s: F.filter(s["terms"], lambda t: other(s, t))), 1)
    base = each.groupBy("group").agg(F.avg((F.col("n") > 0).cast("int")).alias("base"))
    by = each.select("group", F.inline(F.concat(every, beside))).groupBy("term", "group").agg(F.sum("flag").alias("seen"), F.sum(1 - F.col("flag")).alias("docs"))
    by = by.join(base, "group").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum(F.col("docs") * F.col("base")).alias("due"), F.sum("docs").alias("docs"))
    p, q = F.col("due") / F.col("docs"), (F.col("seen") + F.col("due") / F.col("docs")) / (F.col("docs") + 1)
    by = by.withColumns({"p": p, "q": q}).where("p > 0 and q > p and q < 1")
    bits = F.col("seen") * F.log2(F.expr("q / p")) + (F.col("docs") - F.col("seen")) * F.log2(F.expr("(1 - q) / (1 - p)"))
    return by.select("term", "docs", "seen", "due", F.expr("(q - p) / (1 - p)").alias("gain"), bits.alias("bits"))


def personal_items(docs: DataFrame, key: str, text: str, group: list[str], least_gain: float = LEAST_GAIN, surplus: float = SURPLUS_BITS, rounds: int = ROUNDS) -> DataFrame:
    """(key, pii_kind, start, found): every item as it stands, with its offset in code points.

    ``group``: columns of the document's kind. NULL and empty texts give no rows; repeated rows of a key count
    once; an empty table gives no rows. Whole texts are read, whatever their length. The choice of names does not depend
    on how often the corpus repeats a text; a corpus too small to bear an estimate gives no names. A single word is a
    name if it begins LEAST_NAMES different disclosed names, and the two words before it and what follows, if anything, disclose.
    """
    one = one_row(docs.select(key, text, *group), key)
    found = cut(spans(one, key, text, group)).withColumn("own", F.lit(None).cast("array<int>"))
    each = found.select("key", F.explode("spans").alias("s")).select("key", "s.*")
    at = each.where("kind in ('name', 'word')").select("key", "kind", "start", "found", F.explode("terms").alias("term"))
    names_at = at.where("kind = 'name'")
    for k in range(rounds):
        told = cut(disclosure(found))
        terms = found.select(F.explode("spans").alias("s")).where("s.kind = 'name'").select(F.explode("s.terms").alias("term")).distinct().count() if not k else terms
        strong = told.where((F.col("gain") >= least_gain) & (F.col("bits") >= max(LEAST_BITS, log2(max(terms, 1)) + surplus))).select("term")
        person = cut(names_at.join(strong, "term", "left_semi").select("key", "start", "found").distinct())
        if k + 1 < rounds:
            found = found.drop("own").join(person.groupBy("key").agg(F.collect_list("start").alias("own")), "key", "left")
    head = F.regexp_extract("found", r"^([^\s,.]+) [^,]*$", 1)
    first = person.select(head.alias("word"), "found").where("word <> ''").distinct().groupBy("word").count().where(F.col("count") >= LEAST_NAMES).select("word")
    around = at.where("kind = 'word' and term not like 'l:%'").join(strong.withColumn("told", F.lit(1)), "term", "left")
    around = around.groupBy("key", "start", "found").agg(F.min(F.coalesce("told", F.lit(0))).alias("told"), F.max(F.col("term").like("l2:%").cast("int")).alias("led"))
    lone = around.where("told = 1 and led = 1").join(first, F.col("found") == F.col("word"), "left_semi").select("key", "start", "found")
    exact = each.where("kind not in ('name', 'word')").select("key", F.col("kind").alias("pii_kind"), "start", "found")
    return exact.unionByName(person.unionByName(lone).withColumn("pii_kind", F.lit("person"))).withColumnRenamed("key", key)


def sanitise_udf(placeholders: dict[str, str]):
    """Vectorised replacement: the text and its items (kind, start, found) give the text with placeholders."""

    def clean(text: str, items) -> str:
        marks: list[tuple[int, int, str]] = []
        for it in sorted(items, key=lambda i: (i["start"], -len(i["found"]))):
            at, found = it["start"], it["found"]
            spots = [at]
            if it["kind"] == "person":  # the same name elsewhere in the document is the same person
                spots += [m.start() for m in re.finditer(rf"(?<!\w){re.escape(found)}(?!\w)", text)]
            marks += [(x, x + len(found), it["kind"]) for x in spots]
        out, done = "", 0
        for a, b, kind in sorted(set(marks)):
            if a >= done:
                out += text[done:a] + placeholders.get(kind, f"[{kind.upper()}]")
                done = b
        return out + text[done:]

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, items in batches:
            yield pd.Series([t if t is None or i is None or not len(i) else clean(t, i) for t, i in zip(texts, items, strict=True)], dtype="object")

    return F.pandas_udf(run, "string").asNondeterministic()


def sanitise(docs: DataFrame, key: str, text: str, group: list[str], kinds: DataFrame) -> DataFrame:
    """(key, text): each document with its items replaced by the placeholders of ``kinds`` (pii_kind, placeholder).

    The rest of the text stays as it is; NULL stays NULL. ``kinds`` is the fixed list of kinds, a handful of rows.
    """
    names_of = {r.pii_kind: r.placeholder for r in kinds.select("pii_kind", "placeholder").collect()}
    items = personal_items(docs, key, text, group).groupBy(key).agg(F.collect_list(F.struct(F.col("pii_kind").alias("kind"), "start", "found")).alias("_items"))
    one = one_row(docs.select(key, text), key)
    return one.join(items, key, "left").select(key, sanitise_udf(names_of)(F.col(text), F.col("_items")).alias("text"))
