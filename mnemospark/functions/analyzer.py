"""The text analyser of full-text search: tokens by character class, lower case, ASCII folding, English stems.

All of it is expressions in the JVM. Stems are meant for a table of distinct words (see stems()), since a word takes
some thirty patterns; the rules are those of the published English Snowball stemmer (Porter2).
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # stem_word goes to executors with the tasks

#: A run of letters (with their marks) or of digits is a token.
TOKEN = r"([\p{L}\p{M}]+|\p{N}+)"


@functools.cache
def _folding() -> tuple[str, str]:
    """Lower-case letters beyond ASCII that decompose to one plain letter, and those letters; made by rule from Unicode."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and len(plain) == 1 and plain.isascii():
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# Letters that fold to several, or without a decomposition.
WIDE = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ø", "o"), ("đ", "d"), ("ð", "d"), ("ł", "l"), ("ħ", "h"), ("ı", "i"))


def fold(text: Column) -> Column:
    """Lower case, accents off."""
    out = F.translate(F.lower(text), *_folding())
    for a, b in WIDE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\p{M}", "")


def words(text: Column | str) -> Column:
    """Folded tokens in order, repeats included; null: none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1)), lambda w: w != "")


# Fixed values of the stemmer: words with stems of their own, words that stay, suffixes with what replaces them.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
           "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
         "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
         "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: The end of a short syllable: consonant, vowel, consonant but w, x or Y; or vowel, consonant at the start.
SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cut(w: Column, n: Column | int) -> Column:
    """w without its last n letters."""
    return F.left(w, F.length(w) - n)


def _longest(w: Column, suffixes) -> Column:
    """The longest of the suffixes that w ends with, or the empty string."""
    return F.regexp_extract(w, "(" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$", 1)


def _replaced(w: Column, suffix: Column, table: dict[str, str]) -> Column:
    to = F.lit("")
    for a, b in table.items():
        if b:
            to = F.when(suffix == a, b).otherwise(to)
    return F.concat(_cut(w, F.length(suffix)), to)


def _plural(w: Column) -> Column:
    return (F.when(w.endswith("sses"), _cut(w, 2)).when(w.rlike("ie[ds]$"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
            .when(w.rlike("[us]s$"), w).when(w.rlike("[aeiouy].+s$"), _cut(w, 1)).otherwise(w))


def _tense(w: Column, r1: Column) -> Column:
    suffix = F.regexp_extract(w, "(eedly|eed|ingly|edly|ing|ed)$", 1)

    def shorter(stem: Column) -> Column:
        short = stem.rlike(SHORT) & (F.length(stem) <= r1)
        mended = F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(stem.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(stem, 1)).when(short, F.concat(stem, F.lit("e"))).otherwise(stem)
        return F.when(stem.rlike("[aeiouy]"), mended).otherwise(w)

    def by(s: Column) -> Column:
        inside = F.length(w) - F.length(s) >= r1
        return F.when(s == "", w).when(s.startswith("eed"), F.when(inside, F.concat(_cut(w, F.length(s)), F.lit("ee"))).otherwise(w)).otherwise(_let(_cut(w, F.length(s)), shorter))

    return _let(suffix, by)


def _step2(w: Column, r1: Column) -> Column:
    def by(s: Column) -> Column:
        ok = (s != "") & (F.length(w) - F.length(s) >= r1)
        ok = ok & F.when(s == "ogi", w.endswith("logi")).when(s == "li", w.rlike("[cdeghkmnrt]li$")).otherwise(F.lit(True))
        return F.when(ok, _replaced(w, s, STEP2)).otherwise(w)

    return _let(_longest(w, STEP2), by)


def _step3(w: Column, r1: Column, r2: Column) -> Column:
    def by(s: Column) -> Column:
        rest = F.length(w) - F.length(s)
        return F.when((s != "") & (rest >= r1) & ((s != "ative") | (rest >= r2)), _replaced(w, s, STEP3)).otherwise(w)

    return _let(_longest(w, STEP3), by)


def _step4(w: Column, r2: Column) -> Column:
    def by(s: Column) -> Column:
        return F.when((s != "") & (F.length(w) - F.length(s) >= r2) & ((s != "ion") | w.rlike("[st]ion$")), _cut(w, F.length(s))).otherwise(w)

    return _let(_longest(w, STEP4), by)


def _step5(w: Column, r1: Column, r2: Column) -> Column:
    at = F.length(w) - 1
    e = w.endswith("e") & ((at >= r2) | ((at >= r1) & ~_cut(w, 1).rlike(SHORT)))
    return F.when(e | (w.endswith("ll") & (at >= r2)), _cut(w, 1)).otherwise(w)


def _region(w: Column, start: Column) -> Column:
    """Where the part after the first consonant that follows a vowel begins, looking from start."""
    head = F.regexp_extract(F.substring(w, start + 1, F.length(w)), "^.*?[aeiouy][^aeiouy]", 0)
    return F.when(head == "", F.length(w)).otherwise(start + F.length(head))


def stem(word: Column) -> Column:
    """The English stem of a folded word. Words of up to two letters, digits and words of other alphabets stay."""
    y = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "(?<=[aeiouy])y", "Y")

    def by_regions(w: Column, r: Column) -> Column:
        r1, r2 = r["r1"], r["r2"]
        late = lambda v: _let(_let(_let(_let(v, lambda x: _step2(x, r1)), lambda x: _step3(x, r1, r2)), lambda x: _step4(x, r2)), lambda x: _step5(x, r1, r2))
        ends = lambda v: F.when(v.rlike("^.+[^aeiouy][yY]$"), F.concat(_cut(v, 1), F.lit("i"))).otherwise(v)
        return _let(_plural(w), lambda v: F.when(v.isin(*KEPT), v).otherwise(_let(_let(_tense(v, r1), ends), late)))

    def by_word(w: Column) -> Column:
        first = F.when(w.rlike("^(?:gener|arsen)"), F.lit(5)).when(w.startswith("commun"), F.lit(6)).otherwise(_region(w, F.lit(0)))
        return _let(_let(first, lambda r1: F.struct(r1.alias("r1"), _region(w, r1).alias("r2"))), lambda r: by_regions(w, r))

    out = F.lower(_let(y, by_word))
    for a, b in SPECIAL.items():
        out = F.when(word == a, b).otherwise(out)
    return F.when(word.rlike("^[a-z]{3,}$"), out).otherwise(word)


@functools.cache
def stem_of(name: str) -> Column:
    """stem() of a column; the expression is long, so it is built once."""
    return stem(F.col(name))


@functools.cache
def query_stems(name: str) -> Column:
    """The distinct stems of a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(words(F.col(name)), stem)))


def stems(tokens: DataFrame, word: str = "word") -> DataFrame:
    """(word, term) for the distinct words of tokens. Few bytes, but much work for each: they are dealt to all tasks."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.select(F.col(word).alias("word")).distinct().repartition(parts, "word").withColumn("term", stem_of("word"))


def stem_word(word: str) -> str:
    """stem() of one folded word, rule by rule, where words are counted outside the JVM."""
    if not _STEMMED.match(word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub("(?<=[aeiouy])y", "Y", "Y" + word[1:] if word[0] == "y" else word)
    r1 = 5 if w.startswith(("gener", "arsen")) else 6 if w.startswith("commun") else _region_of(w, 0)
    r2 = _region_of(w, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif not w.endswith(("us", "ss")) and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in KEPT:
        return w.lower()
    w = _tense_of(w, r1)
    if re.search("^.+[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    s = _end(w, _STEP2_END)
    if s and len(w) - len(s) >= r1 and (w.endswith("logi") if s == "ogi" else bool(re.search("[cdeghkmnrt]li$", w)) if s == "li" else True):
        w = w[: len(w) - len(s)] + STEP2[s]
    s = _end(w, _STEP3_END)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: len(w) - len(s)] + STEP3[s]
    s = _end(w, _STEP4_END)
    if s and len(w) - len(s) >= r2 and (s != "ion" or re.search("[st]ion$", w)):
        w = w[: len(w) - len(s)]
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT.search(w[:-1]))) or (w.endswith("ll") and at >= r2):
        w = w[:-1]
    return w.lower()


_STEMMED, _SHORT, _HEAD = re.compile("[a-z]{3,}$"), re.compile(SHORT), re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_STEP2_END, _STEP3_END, _STEP4_END, _TENSE_END = (re.compile("(" + "|".join(sorted(x, key=len, reverse=True)) + ")$") for x in (STEP2, STEP3, STEP4, ("eedly", "eed", "ingly", "edly", "ing", "ed")))


def _end(w: str, suffixes: re.Pattern) -> str:
    m = suffixes.search(w)
    return m[1] if m else ""


def _region_of(w: str, start: int) -> int:
    m = _HEAD.match(w, start)
    return m.end() if m else len(w)


def _tense_of(w: str, r1: int) -> str:
    s = _end(w, _TENSE_END)
    if not s:
        return w
    stem_ = w[: len(w) - len(s)]
    if s.startswith("eed"):
        return stem_ + "ee" if len(stem_) >= r1 else w
    if not re.search("[aeiouy]", stem_):
        return w
    if stem_.endswith(("at", "bl", "iz")):
        return stem_ + "e"
    if stem_.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return stem_[:-1]
    return stem_ + "e" if len(stem_) <= r1 and _SHORT.search(stem_) else stem_
