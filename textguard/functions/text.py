"""Text normalisation as Column expressions.

Nothing here shuffles or leaves the JVM. The accent table is derived once from Unicode data
with ``unicodedata`` and shipped to the executors as the two strings of a ``translate``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import zip_longest

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points nobody sees.
INVISIBLE = "\u200B\u200C\u200D\u2060\uFEFF\u00AD\u034F\u180E"

# Lookalike characters and what they stand for.
CONFUSABLES = {
    "\u0430": "a", "\u0435": "e", "\u043E": "o", "\u0440": "p", "\u0441": "c", "\u0445": "x",
    "\u0443": "y", "\u0456": "i", "\u04BB": "h", "\u0405": "s", "\u03B1": "a", "\u03BF": "o",
    "\u03C1": "p", "\u03C5": "u", "\u03BD": "v", "\u03BA": "k", "\u2013": "-", "\u2014": "-",
    "\u2018": "'", "\u2019": "'", "\u201C": '"', "\u201D": '"', "\u00A0": " ",
}

# Symbols read as letters.
LEET = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
    "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "(": "c", "\u20AC": "e",
}

# Characters that hide letters.
MASKS = "*#%_"

# Labels that assistive software appends to a text.
LABEL_SUFFIXES = [
    ", search suggestion", " search suggestion", " - google search", ", google search",
    ", suggestion", " suggestion", ", link", ", button", ", heading", ", visited link",
]

@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) strings: accented and full-width letters to their base letter.

    Characters of ``from`` beyond the length of ``to`` are deleted by ``translate``, which
    takes care of free-standing combining marks.
    """
    source, target = [], []
    spans = [(0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000), (0xFF01, 0xFF5F)]
    for lo, hi in spans:
        for code in range(lo, hi):
            char = chr(code)
            form = "NFKD" if code >= 0xFF00 else "NFD"
            base = "".join(c for c in unicodedata.normalize(form, char) if not unicodedata.combining(c))
            if len(base) == 1 and base != char:
                source.append(char)
                target.append(base)
    marks = [chr(c) for c in range(0x0300, 0x0370) if chr(c) not in INVISIBLE]
    return "".join(source) + "".join(marks), "".join(target)


def is_ascii(text: Column) -> Column:
    """One byte per character; cheaper than a pattern."""
    return F.octet_length(text) == F.char_length(text)


def strip_invisible(text: Column) -> Column:
    """Drop zero-width characters and soft hyphens."""
    return F.when(is_ascii(text), text).otherwise(F.translate(text, INVISIBLE, ""))


def fold_unicode(text: Column) -> Column:
    """Fold accents and full-width forms, then lower-case."""
    source, target = accent_table()
    return F.lower(F.when(is_ascii(text), text).otherwise(F.translate(text, source, target)))


def fold_confusables(text: Column) -> Column:
    """Fold lookalike letters and typographic punctuation."""
    table = F.translate(text, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))
    return F.when(is_ascii(text), text).otherwise(table)


@lru_cache(maxsize=1)
def folding_table() -> tuple[str, str]:
    """(from, to) strings that do N1-N3 at once, but for the lower-casing: a character whose lower-case form is a lookalike goes to what
    that stands for, any other accented one to its base letter."""
    accents = {**dict.fromkeys(INVISIBLE, ""), **{c: b for c, b in zip_longest(*accent_table(), fillvalue="") if c not in INVISIBLE}}
    kept, dropped = [], []
    for char in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        base = accents.get(char, char)
        base = CONFUSABLES.get(base.lower(), base)
        if base != char:
            (kept if base else dropped).append((char, base))
    return "".join(c for c, _ in kept + dropped), "".join(b for _, b in kept)


def fold_characters(text: Column) -> Column:
    """N1-N3 in order, with one look at each character."""
    source, target = folding_table()
    return F.lower(F.when(is_ascii(text), text).otherwise(F.translate(text, source, target)))


def fold_leet(text: Column) -> Column:
    """A symbol becomes its letter when a letter or another such symbol touches it.

    A replaced neighbour is a letter and an unreplaced one is a symbol, and both count as touching, so all are replaced at once: symbols
    side by side, and a single one beside a letter.
    """
    symbols = "".join("\\" + c if c in "$|+(" else c for c in LEET)
    touched = rf"[{symbols}](?:[{symbols}]+|(?<=\p{{L}}[{symbols}])|(?=\p{{L}}))"  # the symbol first: few characters are one
    letters = F.transform(F.regexp_extract_all(text, F.lit(touched), F.lit(0)), lambda hit: F.translate(hit, "".join(LEET), "".join(LEET.values())))
    folded = F.array_join(F.zip_with(F.split(text, touched), letters, lambda piece, hit: F.concat(piece, F.coalesce(hit, F.lit("")))), "")
    return F.when(text.rlike(touched), folded).otherwise(text)


def collapse_space(text: Column) -> Column:
    """One space between words, none at the ends. A single space is no match, so nothing is put in its place."""
    return F.trim(F.regexp_replace(text, "[\\t\\n\\r][ \\t\\n\\r]*| [ \\t\\n\\r]+", " "))


def collapse_runs(text: Column, keep: int) -> Column:
    """Cut a run of one character down to ``keep``."""
    return F.regexp_replace(text, r"(?s)(.)" + r"\1" * keep + "+", "$1" * keep)


def squash(text: Column) -> Column:
    """Letters and digits only, repeats removed; the dedupe key of a text.

    ``\\P{Alnum}`` is ASCII's; Java looks its members up in a table, where the class spelled out is a chain of ranges.
    """
    letters = F.when(is_ascii(text), F.regexp_replace(text, r"\P{Alnum}+", "")).otherwise(
        F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    return collapse_runs(letters, 1)


def tokenize(text: Column) -> Column:
    """Words of letters and digits; apostrophes join their word and vanish."""
    joined = F.replace(text, F.lit("'"), F.lit(""))
    parts = F.when(is_ascii(text), F.split(joined, r"\P{Alnum}+")).otherwise(
        F.split(joined, r"[^\p{L}\p{N}]+"))
    return F.array_remove(parts, "")


def long_run_flag(text: Column) -> Column:
    """A character three or more times in a row."""
    return text.rlike(r"(?s)(.)\1\1")


def padded(tokens: Column) -> Column:
    """Words joined by one space, with a space at both ends."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def padded_words(text: Column) -> Column:
    """N9 and N15 at once: ``padded(tokenize(text))`` without an array of the words."""
    joined = F.replace(text, F.lit("'"), F.lit(""))
    spaced = F.when(is_ascii(text), F.regexp_replace(joined, r"\P{Alnum}+", " ")).otherwise(
        F.regexp_replace(joined, r"[^\p{L}\p{N}]+", " "))
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def strip_markup(text: Column) -> Column:
    """N17, first half: links, mentions, entities and the repost mark become spaces."""
    text = F.regexp_replace(text, r"https?://\S+", " ")
    text = F.regexp_replace(text, r"@\w+", " ")
    text = F.regexp_replace(text, r"&[a-z]+;|&#\d+;", " ")
    return F.replace(text, F.lit("RT "), F.lit(" "))


def strip_ui_labels(text: Column) -> Column:
    """Trailing interface labels, however many."""
    any_label = "|".join(LABEL_SUFFIXES)
    return F.trim(F.regexp_replace(F.trim(text), rf"(?i)(?:\s*(?:{any_label}))+\s*$", ""))


def salted_digest(code: Column, salt: Column) -> Column:
    """Lower-case hex SHA-256 of ``salt:code``; null when either is missing."""
    return F.when(code.isNotNull() & salt.isNotNull(), F.sha2(F.concat(salt, F.lit(":"), code), 256))


def trim_all(text: Column) -> Column:
    """Strip every kind of white space from both ends."""
    return F.regexp_replace(text, r"^[\s\u0085\u00A0]+|[\s\u0085\u00A0]+$", "")


def sentences(text: Column) -> Column:
    """Sentences with the white space behind them: a break follows '.', '!' or '?' and a space.

    Put back together they are the text, character for character.
    """
    marked = F.regexp_replace(text, r"([.!?]\s+)", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")
