"""Column expressions on text: cleaning, counting and splitting, all built-in and null-safe (null in, null out)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that cleaned text may hold, and the tag for numbers.
ALLOWED = "'A-Za-z0-9ÄÖÜäöü,?!-;_— "
NUMBER_TAG = "0NUMERICTAG"
#: Single characters and what they are normalised to.
CHARS_FROM = "’‘‚“”„«»‹›–…  ſ"
CHARS_TO = "''''''''''-.  s"
#: Accented letters and their base; umlauts stay.
ACCENTS_FROM = "àáâãåèéêëìíîïòóôõùúûýÿñçÀÁÂÃÅÈÉÊËÌÍÎÏÒÓÔÕÙÚÛÝÑÇ"
ACCENTS_TO = "aaaaaeeeeiiiioooouuuyyncAAAAAEEEEIIIIOOOOUUUYNC"
#: The punctuation marks whose share is a feature.
MARKS = "',!?-;_—"

WORDS = r"[\p{L}\p{N}_]+"
TOKENS = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
SENTENCES = r"[^.!?\n]+[.!?]*"


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def tokens(text: Column) -> Column:
    """Words and single other characters, in order."""
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def sentences(text: Column) -> Column:
    """Stretches up to and with their closing marks; line ends also close them; blank ones are left out."""
    found = F.regexp_extract_all(text, F.lit(SENTENCES), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def number_tag(text: Column) -> Column:
    """Numbers, with the marks inside them, become one tag."""
    return F.regexp_replace(text, r"[0-9]+([,'.][0-9]+)*", NUMBER_TAG)


def normalise_chars(text: Column) -> Column:
    return F.translate(text, CHARS_FROM, CHARS_TO)


def strip_accents(text: Column) -> Column:
    """Accented letters become their base letter; ä, ö and ü stay."""
    return F.translate(text, ACCENTS_FROM, ACCENTS_TO)


def clean(text: Column) -> Column:
    """The whole chain: tags of code points, characters, accents, what isn't allowed, numbers, white space."""
    out = strip_accents(normalise_chars(F.regexp_replace(text, r"<U\+[0-9A-F]+>", "")))
    return squeeze(number_tag(F.regexp_replace(out, f"[^{ALLOWED}]", " ")))


def apply_rules(text: Column, rules: Column) -> Column:
    """Literal replacements of an array of structs (old, new), in order; an empty old changes nothing."""
    return F.aggregate(rules, text, lambda t, r: F.replace(t, r["old"], r["new"]))


def replace_all(text: Column, pairs: dict[str, str]) -> Column:
    """All the pairs at once: what one replacement makes is not replaced again, and the first pair that fits wins."""
    import re

    alternatives = "|".join(re.escape(k) for k in pairs)
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?:{alternatives})|."), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.array_join(F.transform(found, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def drop_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def count_of(text: Column, chars: str) -> Column:
    """How many of the characters of text are one of chars."""
    return F.length(text) - F.length(drop_chars(text, chars))


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded; null where b is null or 0."""
    return F.round(a / F.nullif(b, F.lit(0)), digits)


def let(value: Column, f) -> Column:
    """f of value, with value computed once: an expression used inside a lambda is otherwise computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def chain(text: Column, *steps) -> Column:
    return reduce(lambda t, f: f(t), steps, text)
