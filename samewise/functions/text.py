"""Text normalisation as Spark columns. Nothing here leaves the JVM, transliteration included.

All functions take and return a Column; a null text is an empty one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables


def filled(s: Column | str) -> Column:
    return F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit(""))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def tokens(s: Column) -> Column:
    """The words between single spaces; of an empty text there are none."""
    return F.filter(F.split(s, " "), lambda t: t != "")


def has_indic(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike("[\\u0900-\\u0D7F]")


def transliterate(s: Column) -> Column:
    """Romanises Indic letters and leaves the rest.

    All nine scripts are folded onto Devanagari by offset. A consonant keeps its inherent vowel unless
    a vowel sign, a virama, a character that is no letter or digit, or the end follows.
    """
    deva = tables.INDIC_BLOCKS[0]
    fold = "".join(chr(b + k) for b in tables.INDIC_BLOCKS[1:] for k in range(128))
    onto = "".join(chr(deva + k) for _ in tables.INDIC_BLOCKS[1:] for k in range(128))
    mute = "".join(map(chr, (*tables.ZERO_WIDTH, deva + tables.NUKTA, deva + tables.AVAGRAHA)))
    cons = "".join(chr(deva + k) for k in tables.CONSONANTS)
    signs = "".join(chr(deva + k) for k in tables.VOWEL_SIGNS) + chr(deva + tables.VIRAMA)
    roman = {k: v for t in (tables.CONSONANTS, tables.VOWELS, tables.VOWEL_SIGNS, tables.NASALS) for k, v in t.items()} | {tables.DIGIT_ZERO + i: str(i) for i in range(10)}
    table = F.create_map(*[F.lit(x) for k, v in roman.items() for x in (chr(deva + k), v)])

    def read(s: Column) -> Column:
        plain = F.translate(F.translate(s, fold, onto), mute, "")
        voiced = F.regexp_replace(plain, f"([{cons}])(?=[\\u0900-\\u097F\\p{{L}}\\p{{N}}&&[^{signs}]])", "$1a")
        return F.array_join(F.transform(F.split(voiced, ""), lambda c: F.coalesce(table[c], F.when(c.rlike("[\\u0900-\\u097F]"), "").otherwise(c))), "")

    return let(s, lambda x: F.when(has_indic(x), read(x)).otherwise(x))


@lru_cache(maxsize=1)
def accents() -> tuple[str, str, dict[str, str]]:
    """From the Unicode data: letters with one plain letter each, that letter, and those that stand for several.

    Marks that combine map to nothing. Only what ends up as ASCII is listed: all else is dropped by clean().
    """
    one, onto, more, gone = [], [], {}, []
    for k in range(0x80, 0x1FFFF):
        c = chr(k)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if not plain:
            gone.append(c)
        elif len(plain) == 1 and plain.isascii():
            one.append(c)
            onto.append(plain)
        elif any(x.isascii() for x in plain) and len(plain) > 1:
            more[c] = plain
    return "".join(one + gone), "".join(onto), more


def strip_accents(s: Column) -> Column:
    """Compatibility decomposition without combining marks, as far as its result has ASCII characters."""
    one, onto, more = accents()
    several = F.create_map(*[F.lit(x) for kv in more.items() for x in kv])

    def spread(s: Column) -> Column:
        return F.when(s.rlike("[" + "".join(more) + "]"), F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(several[c], c)), "")).otherwise(s)

    return let(s, lambda x: F.when(x.rlike("[^\\x00-\\x7F]"), F.translate(spread(x), one, onto)).otherwise(x))


def strip_domains(s: Column) -> Column:
    return F.regexp_replace(s, rf"\b([a-z0-9-]+)\.(?:{'|'.join(tables.TOP_LEVEL_DOMAINS)})\b", "$1")


def clean(s: Column | str) -> Column:
    """Lower-case ASCII letters and digits in words one space apart; & and + become "and", apostrophes go."""
    s = strip_accents(F.lower(transliterate(filled(s))))
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    s = strip_domains(F.translate(s, "'’", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^0-9a-z\s]+", " "), r"\s+", " "))


def without_legal(c: Column) -> Column:
    """A cleaned name without legal forms, unless nothing else is there."""
    kept = F.filter(tokens(c), lambda t: ~t.isin(tables.LEGAL))
    return let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(c))


def norm_name(s: Column | str) -> Column:
    return let(clean(s), without_legal)


def skeleton(s: Column) -> Column:
    """Consonants folded by voicing and place, runs collapsed, words that vanish dropped."""
    for a, b in tables.DIGRAPHS:
        s = F.replace(s, F.lit(a), F.lit(b))
    letters = "".join(tables.FOLDS.values())
    s = F.translate(s, letters + tables.SILENT, "".join(k * len(v) for k, v in tables.FOLDS.items()))
    return F.trim(F.regexp_replace(s, r"(.)\1+", "$1"))


def denumbered(t: Column) -> Column:
    """A word without the zeros before its first digit other than zero."""
    return F.regexp_replace(t, "^0+([1-9])", "$1")


def expanded(c: Column) -> Column:
    """A cleaned address word by word: abbreviation, else state, else dropped stop word, else leading zeros off."""
    known = tables.STATES | tables.ABBREVIATIONS
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    kept = F.filter(tokens(c), lambda t: ~t.isin([w for w in tables.ADDRESS_STOPWORDS if w not in known]))
    return F.array_join(F.transform(kept, lambda t: F.coalesce(table[t], denumbered(t))), " ")


def norm_addr(s: Column | str) -> Column:
    return expanded(clean(s))


def postal(s: Column) -> Column:
    """The first run of six digits that stands alone, else the first of five, else empty."""
    hits = F.regexp_extract_all(s, F.lit(r"\b\d{5,6}\b"), F.lit(0))
    six = F.filter(hits, lambda x: F.length(x) == 6)
    return F.coalesce(F.try_element_at(six, F.lit(1)), F.try_element_at(hits, F.lit(1)), F.lit(""))


def numbers(s: Column) -> Column:
    """Distinct numbers that stand alone, with one letter after them at most."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"\b\d+[a-z]?\b"), F.lit(0)))


def digit_tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(tokens(s), lambda t: t.rlike("[0-9]")))


def acronym(s: Column) -> Column:
    t = tokens(s)
    return F.when(F.size(t) >= 2, F.array_join(F.transform(t, lambda x: F.left(x, F.lit(1))), "")).otherwise("")


def sorted_key(s: Column) -> Column:
    return F.array_join(F.array_sort(tokens(s)), " ")


def shingles(s: Column, n: int = 4, short: bool = False) -> Column:
    """All n-grams of characters of the text without spaces, repeats included; a shorter text is its own if `short`, else it has none."""
    flat = F.replace(s, F.lit(" "), F.lit(""))
    own = F.when((F.length(flat) > 0) & F.lit(short), F.array(flat)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(flat) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(flat) - (n - 1), F.lit(1))), lambda i: F.substr(flat, i, F.lit(n)))).otherwise(own)


def normalised(df, name: str = "business_name", address: str = "business_address", zero_fix: bool = True):
    """Adds n_name, s_name, n_addr, c_name, name_sorted, name_acr, postal and blob.

    zero_fix takes the postal code before leading zeros go, so that codes that start with 0 keep their
    five digits; without it, it is taken from the normalised address.
    """
    df = df.withColumns({"c_name": clean(name), "_c_addr": clean(address)})
    df = df.withColumns({"n_name": without_legal(F.col("c_name")), "n_addr": expanded(F.col("_c_addr"))})
    n, code = F.col("n_name"), postal(F.col("_c_addr")) if zero_fix else postal(F.col("n_addr"))
    return df.withColumns({"s_name": skeleton(n), "name_sorted": sorted_key(n), "name_acr": acronym(n), "postal": code, "blob": F.trim(F.concat_ws(" ", n, "n_addr"))}).drop("_c_addr")
