"""Text normal forms, identifiers and similarity, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįıłñńňòóôõöøōùúûüūůýÿžźżšśřťğ"
_PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiiilnnnooooooouuuuuuyyzzzssrtg"


def words_form(c: Column) -> Column:
    """Lower case, anything but letters and digits to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def ascii_form(c: Column) -> Column:
    """Lower case, anything but a to z and digits to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def folded_form(c: Column) -> Column:
    """words_form without Latin accents; sharp s becomes ss."""
    return words_form(F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), _ACCENTED, _PLAIN))


def alias_form(c: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def decimal_text(c: Column) -> Column:
    """A number written with blanks and a decimal comma, as text that casts to decimal; else null."""
    bare = F.replace(F.regexp_replace(c, "[\\s  ]", ""), F.lit(","), F.lit("."))
    return F.when(bare.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), bare)


def hashed_id(*parts: Column, length: int = 24, separator: str = "|") -> Column:
    """The first hex digits of the SHA-256 of joined parts; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def year_in(c: Column) -> Column:
    """The first year of the 20th or 21st century in a text."""
    return F.regexp_extract(c, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def category_root(c: Column) -> Column:
    """What stands before the first > sign."""
    return F.trim(F.split_part(c, F.lit(">"), F.lit(1)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def script_of(c: Column) -> Column:
    """The first of the known scripts that a text holds a letter of."""
    kinds = [("arabic", "IsArabic"), ("cyrillic", "IsCyrillic"), ("greek", "IsGreek"), ("han", "IsHan"), ("latin", "IsLatin")]
    return F.coalesce(*(F.when(c.rlike(rf"\p{{{name}}}"), code) for code, name in kinds))


def all_tokens_in(query: Column, *columns: Column) -> Column:
    """Whether each token of a query is part of one column at least, letter case aside."""
    found = lambda t: reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), t) for c in columns))
    return F.forall(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != ""), found)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a text's words, each padded with two blanks before and one after."""
    words = F.filter(F.split(words_form(c), " "), lambda w: w != "")
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, cut)))


def short_grams(c: Column, size: int = 3) -> Column:
    """Distinct substrings of a text of up to so many characters."""
    cut = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(cut(n) for n in range(1, size + 1))))


def lexical_score(query: Column, text: Column) -> Column:
    """100 if equal, 90 if contained, else 80 by the share of the query's tokens, rounded half to even."""
    q, t = words_form(query), words_form(text)
    tokens = F.array_distinct(F.filter(F.split(q, " "), lambda w: w != ""))
    shared = F.size(F.array_intersect(tokens, F.split(t, " ")))
    share = F.bround(80 * shared / F.when(F.size(tokens) > 0, F.size(tokens)), 0).cast("int")
    return F.when(q == t, 100).when((q != "") & F.contains(t, q), 90).otherwise(F.coalesce(share, F.lit(0)))
