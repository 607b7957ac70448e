"""Token normalisation as column expressions (no Python per row).

Only Unicode NFKC has no Spark function; ``nfkc`` below is an Arrow UDF meant for the
distinct non-ASCII tokens of a vocabulary, never for running text.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# the Arrow function travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What counts as white space between words.
SPACE = (
    "[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
)

SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Words for numbers.
ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen "
    "fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

# Symbols read as words.
SYMBOLS = {"&": "and", "+": "plus", "%": "percent", "@": "at", "#": "number", "$": "dollar"}

# Contractions without their apostrophe, and what they stand for.
CONTRACTIONS = {
    "dont": "do not",
    "cant": "cannot",
    "wont": "will not",
    "im": "i am",
    "ive": "i have",
    "id": "i would",
    "ill": "i will",
    "youre": "you are",
    "youve": "you have",
    "youll": "you will",
    "theyre": "they are",
    "theyve": "they have",
    "weve": "we have",
    "thats": "that is",
    "theres": "there is",
    "heres": "here is",
    "whats": "what is",
    "whos": "who is",
    "lets": "let us",
    "aint": "is not",
    "yall": "you all",
    "gonna": "going to",
    "wanna": "want to",
    "gotta": "got to",
    "kinda": "kind of",
    "sorta": "sort of",
    "outta": "out of",
    "innit": "is it not",
}

# Ordered rewriting rules of the phonetic key.  Lower case letters are finished codes
# ("q" stands for the two codes KS until the key has been cut), "_" is an erased letter,
# and vowels stay in place until the end because later rules look at them.
PHONETIC_RULES = [
    ("^[KGP]N", "_N"),
    ("^AE", "_E"),
    ("^WR", "_R"),
    ("^X", "s"),
    ("BB", "p"),
    ("DD", "t"),
    ("FF", "f"),
    ("GG", "k"),
    ("JJ", "j"),
    ("KK", "k"),
    ("LL", "l"),
    ("MM", "m"),
    ("NN", "n"),
    ("PP", "p"),
    ("RR", "r"),
    ("SS", "s"),
    ("TT", "t"),
    ("VV", "f"),
    ("ZZ", "s"),
    ("DG([EIY])", "j\\1"),
    ("^GH", "k"),
    ("([AEIOU])GH", "\\1k"),
    ("GH", "_"),
    ("G([EIY])", "j\\1"),
    ("CH", "x"),
    ("C([EIY])", "s\\1"),
    ("PH", "f"),
    ("SH", "x"),
    ("S(I[OA])", "x\\1"),
    ("TH", "0"),
    ("T(I[OA])", "x\\1"),
    ("(^|[AEIOU])H([AEIOU])", "\\1h\\2"),
    ("(^|[AEIOU])H([AEIOU])", "\\1h\\2"),
    ("W([AEIOU])", "a\\1"),
    ("^([AEIOUY])", "a\\1"),
]
# Afterwards single letters become codes; what has none (vowels, H, W, Y, "_") is erased.
PHONETIC_LETTERS = {
    "B": "p",
    "CGKQ": "k",
    "D": "t",
    "FV": "f",
    "J": "j",
    "L": "l",
    "M": "m",
    "N": "n",
    "P": "p",
    "R": "r",
    "SZ": "s",
    "T": "t",
    "X": "q",
}
PHONETIC_LENGTH = 6


@F.pandas_udf(StringType())
def nfkc(raw: pd.Series) -> pd.Series:
    return raw.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def words_of(text: Column) -> Column:
    """White-space separated words, empty ones dropped."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def number_words(digits: Column) -> Column:
    """Digits to words without spaces, up to 999 999; larger numbers keep their digits.

    Spaces inside a spelled-out number vanish with the punctuation, so they are left out.
    """
    ones = F.array(*[F.lit(w) for w in ONES])
    tens = F.array(*[F.lit(w) for w in TENS])
    bare = F.regexp_replace(digits, "^0+([0-9])", "$1")
    n = F.when(F.length(bare) <= 6, bare.cast("int"))

    def under_hundred(x: Column) -> Column:
        t = F.element_at(tens, F.greatest((x / 10).cast("int") - 1, F.lit(1)))
        unit = F.when(x % 10 > 0, F.element_at(ones, x % 10 + 1)).otherwise("")
        return F.when(x < 20, F.element_at(ones, F.least(x, F.lit(19)) + 1)).otherwise(F.concat(t, unit))

    def under_thousand(x: Column) -> Column:
        hundreds = F.concat(F.element_at(ones, (x / 100).cast("int") + 1), F.lit("hundred"))
        rest = F.when(x % 100 > 0, under_hundred(x % 100)).otherwise("")
        return F.when(x < 100, under_hundred(x)).otherwise(F.concat(hundreds, rest))

    thousands = F.concat(under_thousand((n / 1000).cast("int")), F.lit("thousand"))
    rest = F.when(n % 1000 > 0, under_thousand(n % 1000)).otherwise("")
    spelled = F.when(n < 1000, under_thousand(n)).otherwise(F.concat(thousands, rest))
    return F.when(n.isNull(), bare).otherwise(spelled)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times, also inside array lambdas."""
    return F.transform(F.array(value), body)[0]


def spell_numbers(col: Column) -> Column:
    """Replace every run of digits inside a token by its words."""
    pieces = F.regexp_extract_all(col, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    spelled = F.array_join(
        F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), number_words(p)).otherwise(p)), ""
    )
    return F.when(col.rlike("[0-9]"), spelled).otherwise(col)


def normalized(raw: Column) -> Column:
    """Comparison form of a token; contractions yield several space-separated words.

    Expects NFKC text; ASCII always is.
    """
    symbols = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    contractions = F.create_map(*[F.lit(x) for kv in CONTRACTIONS.items() for x in kv])

    def spoken(s: Column) -> Column:
        return let(F.coalesce(symbols[s], s), spell_numbers)

    def expanded(s: Column) -> Column:
        return F.coalesce(contractions[F.replace(s, F.lit("'"), F.lit(""))], s)

    s = let(trimmed(F.lower(raw)), spoken)
    s = F.regexp_replace(s, "[^\\p{L}\\p{N}'’-]", "")
    s = F.regexp_replace(s, "(.)\\1{2,}", "$1$1")
    return let(F.replace(s, F.lit("’"), F.lit("'")), expanded)


def parts_of(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda p: p != "")


def syllables(word: Column) -> Column:
    """Vowel groups of at most two letters after dropping a silent ending; at least 1."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    stem = F.regexp_replace(letters, "([^laeiouy]es|ed|[^laeiouy]e)$", "")
    groups = F.size(F.regexp_extract_all(stem, F.lit("[aeiouy]{1,2}"), F.lit(0)))
    return F.greatest(F.lit(1), groups).cast("bigint")


def phonetic(word: Column) -> Column:
    """Consonant-class key of a word, empty when it has no Latin letters."""
    key = F.regexp_replace(F.upper(word), "[^A-Z]", "")
    for pattern, code in PHONETIC_RULES:
        if pattern.isalpha():
            key = F.replace(key, F.lit(pattern), F.lit(code))
        else:
            key = F.regexp_replace(key, pattern, code.replace("\\", "$"))
    letters = "".join(PHONETIC_LETTERS)
    codes = "".join(code * len(group) for group, code in PHONETIC_LETTERS.items())
    key = F.replace(F.translate(key, letters + "AEIOUYHW_", codes), F.lit("q"), F.lit("k~"))
    # an X counts as two codes; one that begins within the length keeps both
    key = F.regexp_extract(key, f"^.{{0,{PHONETIC_LENGTH}}}~?", 0)
    return F.upper(F.replace(key, F.lit("~"), F.lit("s")))


_NO_LETTER = "[^\\p{L}\\p{N}]*"
_MAYBE_CONTRACTION = f"^{_NO_LETTER}(?=[{''.join(sorted({c[0] for c in CONTRACTIONS}))}])(?:" + "|".join(
    "".join(f"{letter}+{_NO_LETTER}" for letter in c) for c in CONTRACTIONS
) + ")$"


def part_count(raw: Column) -> Column:
    """Number of parts of a token's normal form, without making most of those forms.

    Only a contraction has several, and only a token without any letter, digit, apostrophe or
    hyphen that is no symbol has none.
    """
    some = raw.rlike("[\\p{L}\\p{N}'’-]") | trimmed(raw).isin(list(SYMBOLS))
    return F.when(F.lower(raw).rlike(_MAYBE_CONTRACTION), F.size(parts_of(normalized(raw)))).otherwise(
        F.when(some, 1).otherwise(0)
    )


def first_part(raw: Column) -> Column:
    """First part of a token's normal form, null for none; plain words are their own."""
    plain = raw.rlike("^[A-Za-z]+$") & ~raw.rlike("(?i)(.)\\1\\1") & ~F.lower(raw).isin(list(CONTRACTIONS))
    return F.when(plain, F.lower(raw)).otherwise(F.try_element_at(parts_of(normalized(raw)), F.lit(1)))


def sung_words(text: Column) -> Column:
    """Raw words of a line, repeated once per word their contraction stands for.

    Words that normalise to nothing (lone punctuation) are left out.
    """
    return F.flatten(F.transform(words_of(text), lambda w: F.array_repeat(w, part_count(w))))
