"""Title normalisers (SC01, SC02) and author token sets (SC11), as JVM expressions.

Word characters are letters, digits and the underscore of any script; blanks are those of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import collapse, strip

NOT_WORD_OR_BLANK = r"(?U)[^\p{L}\p{N}_\s]"
#: Leading articles dropped once from a title that is compared.
ARTICLES = "the a an el la los las un una unos unas le les der die das il lo gli de het o".split()


def title_key(title: Column) -> Column:
    """SC01: the key under which titles of different libraries are the same; NULL gives ''."""
    t = F.lower(F.coalesce(title, F.lit("")))
    t = F.regexp_replace(t, r"[\(\[].*?[\)\]]", "")
    t = F.regexp_replace(t, r"(?U)(\s*-\s*)?\b(spa|eng|esp|fans)\b(\s*-\s*fans)?$", "")
    t = F.element_at(F.split(t, " - "), -1)
    return collapse(F.regexp_replace(t, NOT_WORD_OR_BLANK, ""))


def pair_title(title: Column) -> Column:
    """SC02: the title compared in the pair scan: brackets dropped, cut at the colon, one leading article dropped."""
    t = F.lower(F.coalesce(title, F.lit("")))
    t = F.regexp_replace(t, r"[\(\[].*?[\)\]]", " ")
    t = F.substring_index(t, ":", 1)
    t = collapse(F.regexp_replace(t, NOT_WORD_OR_BLANK, " "))
    words = F.split(t, " ")
    first = words[0]
    return F.when((F.size(words) > 1) & first.isin(*ARTICLES), F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).otherwise(t)


def author_sets(authors: Column) -> Column:
    """SC11: each author as the set of its lower-case words, authors without a word left out."""
    words = F.transform(authors, lambda a: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(a), NOT_WORD_OR_BLANK, " "), r"(?U)\s+"), lambda w: w != "")))
    return F.filter(F.coalesce(words, F.array().cast("array<array<string>>")), lambda s: F.size(s) > 0)


def split_authors(authors: Column) -> Column:
    """Several authors in one string, parted by ';', '&', ' y ' or ' and '."""
    return F.filter(F.transform(F.split(authors, r";|&|(?U)\s+(?:y|and)\s+"), strip), lambda a: a != "")
