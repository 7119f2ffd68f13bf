"""From disguised text to words.

Every step is a per-row expression over bounded word tables, so normalising a corpus is one
map-only pass whatever its size or skew. The only table work is building the typo table, and
that starts from the few dozen words worth catching, not from the corpus.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard import lexicon as L
from textguard.functions import text as T
from textguard.functions.arrays import let, mapping, quote, settle, within, words

KEYBOARD = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

# Suffixes a real word may carry.
SUFFIXES = ["s", "es", "ed", "d", "ing", "er", "ers", "ly"]

# The typo table is generated from the fixed target words; it can never grow past this.
MAX_TYPOS = 20_000


def vocabulary() -> list[str]:
    """Every word the rules know by name."""
    lists = [L.SLURS, L.STRONG_PROFANITY, L.MILD_PROFANITY, L.EXPLICIT_WORDS, L.INSULT_NOUNS,
             L.INSULT_ADJECTIVES, L.SECOND_PERSON, L.FIRST_PERSON, L.EXTRA_VOCABULARY]
    return sorted({w for words_ in lists for w in words_})


def mask_vocabulary() -> list[str]:
    """Words a masked spelling may stand for: shortest first, then alphabetical."""
    lists = [L.STRONG_PROFANITY, L.MILD_PROFANITY, L.SLURS, L.EXPLICIT_WORDS, L.INSULT_NOUNS,
             L.INSULT_ADJECTIVES, ["kill", "yourself", "die", "hell"]]
    return sorted({w for words_ in lists for w in words_}, key=lambda w: (len(w), w))


def typo_targets() -> list[str]:
    """Words worth catching through a typo. Typos are only looked for from five letters on."""
    found = set(L.TYPO_TARGETS) | {w for w in L.STRONG_PROFANITY if len(w) >= 4}
    found |= {w for w in L.SLURS if len(w) >= 5}
    return sorted(w for w in found if len(w) >= 5)


@lru_cache(maxsize=1)
def adjacency() -> dict[str, str]:
    """Keys that touch on a keyboard, row and column wise."""
    place = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}
    return {
        a: "".join(b for b, (r2, i2) in place.items() if b != a and abs(r - r2) <= 1 and abs(i - i2) <= 1)
        for a, (r, i) in place.items()
    }


@lru_cache(maxsize=1)
def typo_forms() -> dict[str, str]:
    """typo -> word, turned round: instead of comparing each token with each target, list every
    slip a target allows (one neighbouring key, or two letters swapped). Ties go to the
    alphabetically first word. The first letter is never touched."""
    near, forms = adjacency(), {}
    for word in typo_targets():
        slips = set()
        for i in range(1, len(word)):
            slips |= {word[:i] + c + word[i + 1:] for c in near[word[i]]}
            if i + 1 < len(word):
                slips.add(word[:i] + word[i + 1] + word[i] + word[i + 2:])
        for slip in slips - {word}:
            forms.setdefault(slip, word)
    assert len(forms) <= MAX_TYPOS
    return forms


def typo_table(spark: SparkSession) -> DataFrame:
    """The typo forms as a bounded DataFrame (typo, target)."""
    return spark.createDataFrame(sorted(typo_forms().items()), "typo string, target string")


def stem_candidates(token: Column) -> Column:
    """The word itself and every stem it may be an inflection of."""
    stems = []
    for suffix in SUFFIXES:
        n = len(suffix)
        fits = token.endswith(suffix) & (F.char_length(token) > n + 2)
        stem = F.substring(token, F.lit(1), F.char_length(token) - n)
        doubled = stem.rlike(r"(?s)(.)\1$")
        shorter = F.substring(stem, F.lit(1), F.char_length(stem) - 1)
        stems += [F.when(fits, stem), F.when(fits, F.concat(stem, F.lit("e"))), F.when(fits & doubled, shorter)]
    return F.array_distinct(F.array_compact(F.array(token, *stems)))


def is_real_word(tokens: DataFrame, dictionary: DataFrame, token: str = "token", term: str = "term") -> DataFrame:
    """Adds ``is_real``. ``tokens`` must hold distinct tokens."""
    stems = tokens.select(token, F.explode(stem_candidates(F.col(token))).alias("_stem"))
    known = dictionary.select(F.lower(F.col(term)).alias("_stem")).distinct()
    real = stems.join(known, "_stem", "left_semi").select(token).distinct().withColumn("is_real", F.lit(True))
    return tokens.join(real, token, "left").withColumn("is_real", F.coalesce("is_real", F.lit(False)))


def surviving_typos(spark: SparkSession, dictionary: DataFrame | None, term: str = "term") -> dict[str, str]:
    """Typo forms that are not real words.

    The dictionary is cut down by a semi-join with the stems of the generated forms, so
    what comes back is at most ``MAX_TYPOS`` rows however large the dictionary is.
    """
    if dictionary is None:
        return dict(typo_forms())
    table = is_real_word(typo_table(spark), dictionary, "typo", term)
    return {r.typo: r.target for r in table.filter(~F.col("is_real")).collect()}


def typo_fix(tokens: DataFrame, dictionary: DataFrame, token: str = "token") -> DataFrame:
    """Distinct tokens with the word each is a slip of; tokens that are none are left out."""
    spark = tokens.sparkSession
    table = is_real_word(typo_table(spark), dictionary, "typo").filter(~F.col("is_real"))
    fixes = F.broadcast(table.select(F.col("typo").alias(token), F.col("target").alias("fixed")))
    return tokens.join(fixes, token)


def known_form(form: str) -> str:
    """The lexicon word behind a spelling, or null."""
    names = vocabulary() + list(L.ALIASES)
    return f"CASE WHEN {within(form, names)} THEN coalesce(try_element_at({mapping(L.ALIASES)}, {form}), {form}) END"


def canonical_form(token: str, typos: dict[str, str] | None = None) -> str:
    """One token folded onto the lexicon, or left as typed.

    A word the lexicon knows by that spelling stays, so only aliases, slips and words with a doubled character are looked at closely.
    """
    slip = (f"WHEN char_length({token}) > 2 AND {within(token, typos)} AND NOT {within(token, vocabulary())} THEN try_element_at({mapping(typos)}, {token})"
            if typos else "")
    two = rf"regexp_replace({token}, r'(?s)(.)\1{{2,}}', '$1$1')"
    one = rf"regexp_replace({token}, r'(?s)(.)\1+', '$1')"
    shorter = rf"CASE WHEN {token} RLIKE r'(?s)(.)\1\1' THEN {let(two, 'two', known_form('two'))} END"
    shortest = let(one, "one", known_form("one"))
    return rf"""CASE
        WHEN {within(token, L.ALIASES)} THEN try_element_at({mapping(L.ALIASES)}, {token})
        {slip}
        WHEN char_length({token}) > 2 AND {token} RLIKE r'(?s)(.)\1' AND NOT {within(token, vocabulary())} THEN coalesce({shorter}, {shortest}, {token})
        ELSE {token} END"""


def mask_pattern(core: str) -> str:
    """The masked word as a pattern: n mask characters stand for n-1 (at least one) to n+1 letters."""
    steps = [
        (r"([\\.\+?^$(){}|\[\]&-])", r"\\$1"),
        (r"(?<![*#%_])[*#%_](?![*#%_])", "[a-z]{1,2}"),
        (r"(?<![*#%_])[*#%_](?=[*#%_])", "[a-z]{0,2}"),
        (r"[*#%_]", "[a-z]"),
    ]
    for pattern, becomes in steps:
        core = f"regexp_replace({core}, {quote(pattern)}, {quote(becomes)})"
    return f"concat('^(?:', {core}, ')$')"


def resolve_mask(word: str) -> str:
    """N4 for one word: the first vocabulary word its mask allows, put in place of the masked core."""
    core = rf"regexp_replace({word}, r'^[^\p{{L}}\p{{M}}*#%_]+|[^\p{{L}}\p{{M}}*#%_]+$', '')"
    head, tail = "regexp_extract(core, r'^([^*#%_]*)', 1)", "regexp_extract(core, r'([^*#%_]*)$', 1)"
    # The letters before and after the masks sort out nearly every word before a pattern runs.
    matches = f"""get(filter({words(mask_vocabulary())}, v ->
        startswith(v, mask.head) AND endswith(v, mask.tail) AND v RLIKE mask.pattern), 0)"""
    found = let(f"struct({head} AS head, {tail} AS tail, {mask_pattern('core')} AS pattern)", "mask", matches)
    replaced = rf"CASE WHEN core RLIKE r'\p{{L}}' AND char_length(core) >= 2 THEN replace({word}, core, {found}) END"
    return f"coalesce({let(core, 'core', replaced)}, {word})"


def replace_matches(text: str, pattern: str, name: str, replacement: str, there: str) -> str:
    """Replace each match of a pattern by an expression over the match. ``there`` says cheaply whether the text has a match."""
    pieces = f"split({text}, {quote(pattern)})"
    found = f"transform(regexp_extract_all({text}, {quote(pattern)}, 0), {name} -> {replacement})"
    filled = f"array_join(zip_with({pieces}, {found}, (piece, hit) -> concat(piece, coalesce(hit, ''))), '')"
    return f"CASE WHEN {there} THEN {filled} ELSE {text} END"


def resolve_masks(text: str) -> Column:
    """Masked words of a text column resolved in place."""
    return F.expr(replace_matches(text, r"(?<![^ ])[^ *#%_]*+[*#%_][^ ]*", "masked", resolve_mask("masked"), " OR ".join(f"contains({text}, '{c}')" for c in T.MASKS)))


def join_singles(ctext: str, typos: dict[str, str] | None = None) -> Column:
    """N14 on the padded form: runs of single letters glued back into a word.

    Runs of three or more are always glued; runs of two only onto a word the lexicon knows.
    """
    known = vocabulary() + list(L.ALIASES)
    glued = let("replace(run, ' ', '')", "w",
                f"CASE WHEN char_length(w) >= 3 OR {within('w', known)} THEN {canonical_form('w', typos)} ELSE run END")
    return F.expr(replace_matches(ctext, r"(?<= )\p{L}(?: \p{L})+(?= )", "run", glued, rf"{ctext} RLIKE r' \p{{L}} \p{{L}} '"))


def normalize(df: DataFrame, text: str = "text", typos: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds plain, destretched, squashed, tokens, canonical, ctext and cjoined.

    ``typos`` comes from :func:`surviving_typos`; without it no typo is corrected. ``keep`` names the added columns that are wanted:
    the rest are not worked out. Spark cannot see that itself, as the row is settled whole.
    """
    given = df.columns
    df = (
        df.withColumn("plain", T.fold_characters(F.col(text)))
        .withColumn("plain", resolve_masks("plain"))
        .withColumn("plain", T.collapse_space(T.fold_leet(F.col("plain"))))
        .withColumn("destretched", T.collapse_runs(F.col("plain"), 2))
        .withColumn("tokens", T.tokenize(F.col("plain")))
        .withColumn("squashed", T.collapse_runs(F.array_join("tokens", ""), 1))
        .withColumn("canonical", F.expr(f"transform(tokens, w -> {canonical_form('w', typos)})"))
        .withColumn("ctext", T.padded(F.col("canonical")))
        .withColumn("cjoined", join_singles("ctext", typos))
    )
    added = ["plain", "destretched", "squashed", "tokens", "canonical", "ctext", "cjoined"]
    return settle(df.select(*[c for c in given if c not in added], *[c for c in added if c in given or keep is None or c in keep]))


#: What :func:`word_forms`, and with it the lexical score, reads.
LEXICAL = ["plain", "destretched", "tokens"]


def word_forms(df: DataFrame) -> DataFrame:
    """Adds ``word_set``: plain tokens, de-stretched tokens, and stretched tokens fully cut back."""
    stretched = F.when(F.col("plain") != F.col("destretched"), T.tokenize(F.col("destretched")))
    cut = F.transform(F.filter("tokens", T.long_run_flag), T.squash)
    extra = F.coalesce(F.concat(stretched, cut), F.array().cast("array<string>"))
    return df.withColumn("word_set", F.array_distinct(F.concat("tokens", extra)))


def canonicalize(tokens: DataFrame, typos: dict[str, str] | None = None, token: str = "token") -> DataFrame:
    """N11 over a table of tokens: adds ``canonical``."""
    return tokens.withColumn("canonical", F.expr(canonical_form(token, typos)))


def passage_window(df: DataFrame, text: str = "text", size: int = 1500, step: int = 640) -> DataFrame:
    """N19 re-aimed at long documents: one row per overlapping passage.

    Texts up to ``size`` stay whole. Longer ones are cut every ``step`` characters into
    windows of ``size``, each starting on a word boundary, so no character is left out.
    """
    n = F.char_length(F.col(text))
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)) + F.lit(step - 1), F.lit(step)))
    raw = F.substring(F.col(text), F.col("start") + 1, F.lit(size))
    # A window that begins inside a word begins after it instead.
    inside = (F.col("start") > 0) & ~F.substring(F.col(text), F.col("start"), F.lit(1)).rlike(r"\s")
    passage = F.when(inside, F.regexp_replace(raw, r"^\S+", "")).otherwise(raw)
    return (df.select("*", F.posexplode(starts).alias("passage", "start"))
            .withColumn("passage_text", passage))
