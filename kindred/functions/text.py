"""Normal forms and tokens as column expressions; none leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import ADDRESS_WORDS, LEGAL_SUFFIXES, SOUNDEX_CODES, STOPWORDS


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters with one ASCII character in their compatibility decomposition, these, and those with several."""
    one_from, one_to, many = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7B0:
            continue
        char = chr(code)
        kept = "".join(x for x in unicodedata.normalize("NFKD", char) if x < "\x80")
        if len(kept) == 1:
            one_from.append(char)
            one_to.append(kept)
        elif kept:
            many[char] = kept
    return "".join(one_from), "".join(one_to), many


def _ranges(chars) -> str:
    """The inside of a character class: a class is tried range by range, so neighbours are one."""
    out: list[list[int]] = []
    for code in sorted(ord(c) for c in chars):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


def fold_ascii(c: Column) -> Column:
    """Compatibility decomposition with all that is not ASCII dropped; null as ''.

    Pure ASCII, the usual case, costs one scan; characters that become several are cut out and looked up.
    """
    source, target, many = _foldings()
    c = F.coalesce(c, F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    several = rf"(?=[^\x00-\x7F])[{_ranges(many)}]"
    spread = F.array_join(F.transform(F.split(c, f"(?={several})|(?<={several})"), lambda part: F.coalesce(F.try_element_at(table, part), part)), "")
    rare = c.rlike(several)
    folded = F.regexp_replace(F.translate(F.when(rare, spread).otherwise(c), source, target), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def clean_text(c: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else as one space."""
    return F.trim(F.regexp_replace(F.lower(fold_ascii(c)), "[^a-z0-9]+", " "))


def tokens_of(clean: Column) -> Column:
    return F.filter(F.split(clean, " "), lambda t: t != "")


def tokenize(c: Column) -> Column:
    return tokens_of(clean_text(c))


def remove_suffixes(a: Column) -> Column:
    return F.filter(a, lambda t: (F.length(t) > 1) & ~t.isin(LEGAL_SUFFIXES))


def expand_address(a: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    return F.transform(a, lambda t: F.coalesce(F.try_element_at(table, t), t))


def remove_stopwords(a: Column) -> Column:
    return F.filter(a, lambda t: ~t.isin(STOPWORDS))


def is_digits(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def canonical_name_of(tokens: Column) -> Column:
    return F.array_join(F.sort_array(remove_stopwords(remove_suffixes(F.array_distinct(tokens)))), " ")


def canonical_address_of(tokens: Column) -> Column:
    """Numbers in their order, then the sorted words of two letters and more, repeated ones too."""
    words = remove_stopwords(expand_address(tokens))
    return F.array_join(F.concat(F.filter(words, is_digits), F.array_sort(F.filter(words, lambda t: ~is_digits(t) & (F.length(t) > 1)))), " ")


def canonical_name(c: Column) -> Column:
    return canonical_name_of(tokenize(c))


def canonical_address(c: Column) -> Column:
    return canonical_address_of(tokenize(c))


def ngrams(text: Column, low: int = 2, high: int = 3) -> Column:
    """The set of letter n-grams of the text between two spaces; none of ''."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))

    def of_length(n: int) -> Column:
        return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))  # one pass, whatever the length

    grams = [of_length(n) for n in range(low, high + 1)]
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*grams)))


def tokens_set(tokens: Column, drop_suffixes: bool = False, drop_stopwords: bool = False) -> Column:
    tokens = remove_suffixes(tokens) if drop_suffixes else tokens
    tokens = remove_stopwords(tokens) if drop_stopwords else tokens
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) > 1))


def name_tokens(tokens: Column) -> Column:
    return F.array_distinct(remove_suffixes(tokens))


def address_tokens(tokens: Column) -> Column:
    return F.array_distinct(F.filter(expand_address(tokens), lambda t: is_digits(t) | (F.length(t) > 1)))


def digit_tokens(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, is_digits))


def soundex(t: Column) -> Column:
    """Four places: the first letter, then codes. All uncoded letters part equal codes, and the first letter's code stays."""
    letters = "".join(SOUNDEX_CODES) + "".join(x for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if x not in "".join(SOUNDEX_CODES))
    codes = "".join(code * len(group) for group, code in SOUNDEX_CODES.items()).ljust(26, "0")
    upper = F.upper(t)
    coded = F.translate(F.substring(upper, 2, 1 << 20), letters, codes)
    single = F.regexp_replace(F.regexp_replace(coded, r"([0-9])\1+", "$1"), "0", "")
    return F.when(t == "", "").otherwise(F.rpad(F.concat(F.substring(upper, 1, 1), single), 4, "0"))


def soundex_keys(tokens: Column) -> Column:
    """Codes of the first four alphabetic tokens of three letters and more."""
    return F.transform(F.slice(F.filter(remove_suffixes(tokens), lambda t: t.rlike("^[a-z]+$") & (F.length(t) >= 3)), 1, 4), soundex)


def prefix(c: Column, n: int = 4) -> Column:
    return F.substring(c, 1, n)


def norm_key(c: Column, sep: str) -> Column:
    """ASCII letters and digits in lower case; runs of others become sep, ' ' or ''."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9]+", sep)))


def norm_country(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def list_size(ids: Column) -> Column:
    """Items of a comma list; null and '' have none."""
    return F.when(F.coalesce(ids, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(ids, ",")))
