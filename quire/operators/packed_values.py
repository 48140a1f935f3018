"""Several values packed in one string field: split into one value per row, with the position kept.

Method: quoted spans are replaced with indexed placeholders that cannot occur in the text, the rest is split at the
delimiters, the spans are put back through array lookup, and the array is exploded with positions. All of it is built
of JVM expressions; no row leaves whole-stage code generation for Python, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A placeholder is OPEN, the span's index, SHUT. Private-use characters already in the text are escaped first.
OPEN, SHUT = "", ""

#: Delimiters between values. A slash separates only between blanks, other marks always.
DELIMITERS = r"[,;|\t\r\n•、，；]|(?<=\s)/(?=\s)"

#: Quotes that can wrap a value, each as opening, body, closing; the body may hold delimiters. The loops are possessive:
#: what may follow is decided by the next character alone, so nothing is given back, and the JVM neither recurses nor
#: remembers a state per character, however long a value is.
QUOTED = (
    r'"(?:[^"\\]++|\\.|"")*+"',
    r"'(?:[^'\\]++|\\.|'(?!\s*(?:$|" + DELIMITERS + r")))*+'",
    r"«[^»]*»",
    r"“[^”]*”",
    r"‘[^’]*’",
)

_SPAN = rf"(?sU)(^|{DELIMITERS})(\s*)({'|'.join(QUOTED)})(?=\s*(?:$|{DELIMITERS}))"
_BLANKS = r"(?U)^\s++|(?<!\s)\s++$"


def _let(value: Column, body) -> Column:
    """Evaluate an expression once and use it several times."""
    return F.transform(F.array(value), body)[0]


def _unwrap(span: Column) -> Column:
    """The span without its quotes, and without the escape marks that only the wrapping needed."""
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    escaped = F.regexp_replace(inner, r"""(?:\\|"(?="))(["'\\])""", "$1")
    return F.when(F.substring(span, 1, 1).isin('"', "'"), escaped).otherwise(inner)


def packed_values(packed: Column) -> Column:
    """The non-empty values of a packed string, in order, as ``array<string>``.

    NULL gives NULL; an empty or blank text, bare delimiters and ``[]`` give an empty array. A list literal's outer
    brackets are dropped. Values keep their characters: only the blanks around them, the quotes around a whole value
    and the escape marks inside such quotes go. A quote that does not end before a delimiter is an ordinary character.
    """

    def restore(piece: Column, spans: Column) -> Column:
        index = F.regexp_extract(piece, f"^{OPEN}([0-9]+){SHUT}$", 1)
        return F.when(index != "", F.element_at(spans, index.cast("int") + 1)).otherwise(piece)

    def split(text: Column) -> Column:
        spans = F.regexp_extract_all(text, F.lit(_SPAN), F.lit(3))
        outer = F.split(F.regexp_replace(text, _SPAN, "$1$2" + OPEN + "q"), OPEN + "q")
        marked = F.array_join(
            F.transform(
                outer, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(SHUT), x))
            ),
            "",
        )
        values = _let(
            F.transform(spans, _unwrap),
            lambda s: F.transform(
                F.split(marked, DELIMITERS_U), lambda x: restore(F.regexp_replace(x, _BLANKS, ""), s)
            ),
        )
        trimmed = F.transform(values, lambda x: F.regexp_replace(F.replace(x, F.lit(OPEN + "e" + SHUT), F.lit(OPEN)), _BLANKS, ""))
        return F.filter(trimmed, lambda x: x != "")

    escaped = F.replace(packed, F.lit(OPEN), F.lit(OPEN + "e" + SHUT))
    bare = F.regexp_replace(escaped, r"(?sU)^\s*\[(.*)\]\s*$", "$1")
    return F.when(packed.isNotNull(), _let(bare, split))


DELIMITERS_U = f"(?U){DELIMITERS}"


def split_packed(df: DataFrame, column: str, keep: Sequence[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per value of ``column``: the ``keep`` columns, ``pos`` counting from 1, ``value``.

    Rows whose field is NULL or holds no value give no row. Repeated values keep their own positions. Columns that are
    not in ``keep`` are dropped, so names in the input cannot clash with ``pos`` and ``value``; a clash with ``keep``
    raises ValueError.
    """
    if {pos, value} & set(keep):
        raise ValueError(f"{pos} and {value} must differ from {list(keep)}")
    return df.select(*[F.col(f"`{k}`") for k in keep], F.posexplode(packed_values(F.col(f"`{column}`"))).alias("_p", value)).select(
        *[F.col(f"`{k}`") for k in keep], (F.col("_p") + 1).alias(pos), F.col(value)
    )
