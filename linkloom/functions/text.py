"""Text normalisation as column expressions; only the Unicode fold leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicons import INDIC_BLOCKS, INDIC_LETTERS, LEGAL_SUFFIXES, LETTER_FOLDS, MOJIBAKE, SCRIPTS, STREETS, state_lookup

_NUMBER = r"\p{Nd}{1,6}(?:-\p{Nd}{1,6})?"
_POSTAL = r"(?<!\p{Nd})\p{Nd}{5}(?:-\p{Nd}{4})?(?!\p{Nd})|(?<!\p{Nd})\p{Nd}{6}(?!\p{Nd})"


def fold_text(s: str) -> str:
    """NFKC, case fold, then accents and special letters folded (result in NFD)."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", s).casefold())
    return "".join(LETTER_FOLDS.get(c, c) for c in s if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def unicode_fold(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


@F.pandas_udf(StringType())
def unicode_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def fix_mojibake(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, c)


def _by_script(c: Column, fold: Callable[[Column], Column]) -> Column:
    """fold where c has other than ASCII characters, plain lower case where not; ASCII rows stay in the JVM."""
    other = F.when(not_ascii(c), c)
    return F.when(other.isNull(), F.lower(c)).otherwise(fold(other))


def folded(c: Column) -> Column:
    """Repaired and folded text with & spelled out."""
    return F.replace(_by_script(fix_mojibake(F.coalesce(c, F.lit(""))), unicode_fold), F.lit("&"), F.lit(" and "))


def profile_norm(c: Column) -> Column:
    """NFKC and case fold with accents kept, & spelled out, other characters than letters, digits and underscores as one space."""
    return spaced(F.replace(_by_script(F.coalesce(c, F.lit("")), unicode_casefold), F.lit("&"), F.lit(" and ")))


def truncate_bytes(c: Column, size: int) -> Column:
    """The longest beginning of at most size UTF-8 bytes that cuts no character."""
    cut = F.substring(F.encode(c, "UTF-8"), 1, size)
    return F.when(F.octet_length(c) <= size, c).otherwise(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "\uFFFD+$", ""))


def postal_like(c: Column) -> Column:
    """First run of 5 digits (with an optional -4) or 6, bounded by other characters; "" if none."""
    return F.regexp_extract(c, _POSTAL, 0)


def looks_french(c: Column) -> Column:
    return F.startswith(F.upper(F.trim(c)), F.lit("FR"))


def spaced(c: Column) -> Column:
    """Letters, digits and underscores, single-spaced."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "))


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, " "), "")


def literal_array(values) -> Column:
    return F.array(*map(F.lit, values))


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def core_tokens(toks: Column) -> Column:
    kept = F.filter(toks, lambda t: ~F.array_contains(literal_array(LEGAL_SUFFIXES), t))
    return F.when(F.size(kept) == 0, toks).otherwise(kept)


def suffix_tokens(toks: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(toks, lambda t: F.array_contains(literal_array(LEGAL_SUFFIXES), t))))


def initials(core: Column) -> Column:
    return F.array_join(F.transform(F.filter(core, lambda t: t.rlike(r"^\p{L}")), lambda t: F.left(t, F.lit(1))), "")


def phon_key(tok: Column) -> Column:
    """A-Z only: first letter, later non-vowels, repeats of the last one collapsed."""
    u = F.regexp_replace(F.upper(tok), "[^A-Z]", "")
    rest = F.regexp_replace(F.substring(u, 2, 1 << 30), "[AEIOU]", "")
    return F.regexp_replace(F.concat(F.left(u, F.lit(1)), rest), r"(.)\1+", "$1")


def phon_name(core: Column) -> Column:
    first, last = phon_key(F.try_element_at(core, F.lit(1))), phon_key(F.try_element_at(core, F.lit(-1)))
    return F.when(F.size(core) == 0, "").when(F.size(core) == 1, first).otherwise(F.concat_ws(" ", first, last))


def script(c: Column) -> Column:
    """Script of the first character from U+0250 on that has one, or that is a letter (unknown); else latin."""
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for _, a, b in SCRIPTS)
    hit = F.regexp_extract(c, f"[{ranges}]|[\\p{{L}}&&[^\\x{{0}}-\\x{{24F}}]]", 0)
    named: Callable = lambda acc, r: acc.when((hit >= chr(r[1])) & (hit <= chr(r[2])), r[0])
    return reduce(named, SCRIPTS, F.when(hit == "", "latin")).otherwise("unknown")


def _roman(offset: int) -> str:
    """Latin rendering of the letter at an offset of an Indic block, without its inherent vowel."""
    return INDIC_LETTERS.get(offset, "")


def romanise_one(s: str) -> str:
    """Indic letters rendered in Latin: consonants with their inherent a, but before a vowel sign or a virama."""
    out, waiting = [], False
    for ch in s:
        base = next((a for a in INDIC_BLOCKS.values() if a <= ord(ch) < a + 128), None)
        kind = None if base is None else ord(ch) - base
        sign = kind is not None and (0x3E <= kind <= 0x4D)
        if waiting and not sign:
            out.append("a")
        waiting = False
        if kind is None:
            out.append(ch)
        elif 0x15 <= kind <= 0x39:
            out.append(_roman(kind))
            waiting = True
        elif kind != 0x4D:
            out.append(str(kind - 0x66) if 0x66 <= kind <= 0x6F else _roman(kind))
    return "".join(out) + "a" * waiting


@F.pandas_udf(StringType())
def romanise(s: pd.Series) -> pd.Series:
    return s.map(romanise_one, na_action="ignore")


def transliterate(raw: Column, found: Column) -> Column:
    """Latin rendering of names in an Indic script; null for all others."""
    return romanise(F.when(found.isin(*INDIC_BLOCKS), raw))


def not_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def postal(work: Column) -> Column:
    return F.replace(F.regexp_extract(work, _POSTAL, 0), F.lit("-"), F.lit(""))


def house_number(work: Column, post: Column) -> Column:
    """First number that is neither the postal code nor a long run at the tail."""
    zero = F.struct(F.lit(1).alias("pos"), F.lit("").alias("hn"))

    def step(acc: Column, n: Column) -> Column:
        at = F.locate_from(n, work, acc["pos"]) if hasattr(F, "locate_from") else F.call_function("locate", n, work, acc["pos"])
        end = at + F.length(n)
        skip = (F.replace(n, F.lit("-"), F.lit("")) == post) | ((F.length(n) >= 5) & (end - 1 >= F.length(work) - 4))
        return F.struct(end.alias("pos"), F.when(acc["hn"] != "", acc["hn"]).when(skip, "").otherwise(n).alias("hn"))

    return F.aggregate(F.regexp_extract_all(work, F.lit(f"({_NUMBER})"), F.lit(1)), zero, step, lambda a: a["hn"])


def expand_streets(toks: Column) -> Column:
    table = literal_map(STREETS)
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(table, t), t))


def state(toks: Column) -> Column:
    """First adjacent pair of tokens that names a state, else first token that does."""
    table = literal_map(state_lookup())
    pairs = F.transform(F.when(F.size(toks) > 1, F.sequence(F.lit(1), F.size(toks) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", F.get(toks, i - 1), F.get(toks, i)))
    known = lambda a: F.try_element_at(F.filter(F.transform(a, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(known(pairs), known(toks), F.lit(""))
