"""Text functions as Spark columns: folding, tokens, language votes, quality of text."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The most frequent words by which a language is told; longer lists may be given instead.
STOP_WORDS = {
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero".split(),
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur pas au plus ne se ce il".split(),
    "it": "di e il la che in a per un è del non una le si da con i al della sono come anche ma".split(),
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "la": "et in est non ad cum quod ut qui sed quae de ex esse per enim si nec etiam quam sunt autem ab hoc".split(),
    "ca": "de la i el que a les en del un per amb no una els és al com més però dels seu era pel".split(),
}


@functools.lru_cache(1)
def _latin() -> tuple[str, str]:
    """Latin letters with marks, and their base letters, by the rule of canonical decomposition."""
    pairs = []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(i))[0]
        if base.isascii() and base.isalpha():
            pairs.append((chr(i), base.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _bases() -> dict[str, str]:
    """Of each base letter, the Latin letters that fold to it."""
    out: dict[str, str] = {}
    for letter, base in zip(*_latin()):
        out[base] = out.get(base, "") + letter
    return out


def folded(text: Column) -> Column:
    """Lower case without Latin diacritics; combining marks go. Plain ASCII takes the short way."""
    a, b = _latin()
    bare = F.octet_length(text) == F.length(text)
    return F.when(bare, F.lower(text)).otherwise(F.translate(F.lower(F.regexp_replace(text, r"\p{Mn}", "")), a, b))


def spelled(term: str) -> str:
    """A pattern that finds a term whatever its Latin marks and white space."""
    out = ""
    for ch in term:
        base = unicodedata.normalize("NFD", ch)[0].lower()
        if ch.isspace():
            out += r"\s+"
        elif base in _bases():
            out += f"[{base}{_bases()[base]}]"
        else:
            out += re.escape(ch)
    return out


def token_line(text: Column) -> Column:
    """Runs of letters and numbers of folded text, with a blank before and after each; ` ` if there is none."""
    line = F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(line == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), line, F.lit(" ")))


def tokens(text: Column) -> Column:
    """Runs of letters and numbers of folded text."""
    return F.filter(F.split(token_line(text), " "), lambda t: t != "")


def token_count(line: Column) -> Column:
    """Tokens of a token_line."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) - 1


def count_tokens(text: Column) -> Column:
    """A model-free estimate of tokens: the greater of characters / 4 and words * 1.3, rounded up."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.ceil(F.length(text) / 4), F.floor((words * 13 + 9) / 10)).cast("long")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


# Signs of a broken text layer, their weight, and the share of letters under which a text is suspect.
BROKEN = r"[\x{FFFD}\x00-\x08\x0E-\x1F]|\(cid:[0-9]+\)|[\x{C3}\x{C2}][\x{80}-\x{BF}]"
BROKEN_WEIGHT, FEW_LETTERS, FEW_LETTERS_COST = 4, 0.4, 0.5


def garbage_ratio(text: Column) -> Column:
    """How broken a text looks, 0 to 1: impossible characters, weighted, and a charge for few letters; 1 if it is empty."""
    n = F.greatest(F.length(text), F.lit(1))
    odd = F.regexp_count(text, F.lit(BROKEN)) * BROKEN_WEIGHT / n
    few = F.when(letters(text) / n < FEW_LETTERS, FEW_LETTERS_COST).otherwise(0.0)
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), odd + few))


def language_vote(text: Column, stop_words: dict[str, list[str]] | None = None, most: int = 20_000) -> Column:
    """The language with the most stop words among the first words (the first language of equals), if there are 20 words
    and the votes are at least 5 and 8 % of them."""
    stop_words = stop_words or STOP_WORDS
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), 1, most)
    votes_of = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    votes = F.array(*map(votes_of, stop_words.values()))
    best, n = F.array_max(votes), F.size(words)
    pick = F.element_at(F.array(*map(F.lit, stop_words)), F.array_position(votes, best).cast("int"))
    return F.when((n >= 20) & (best >= 5) & (best * 100 >= n * 8), pick)


def isbn10(text: Column) -> Column:
    """The first ISBN-10 whose check digit holds, without hyphens, of those after the word ISBN."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)ISBN(?:-10)?:?\s*((?:[0-9][ -]?){9}[0-9Xx])"), F.lit(1))
    bare = F.transform(found, lambda x: F.upper(F.regexp_replace(x, "[ -]", "")))
    value = lambda x, i: F.when(F.substring(x, i, F.lit(1)) == "X", 10).otherwise(F.substring(x, i, F.lit(1)).try_cast("int"))
    total = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda s, i: s + (11 - i) * value(x, i))
    return F.get(F.filter(bare, lambda x: total(x) % 11 == 0), F.lit(0))


def arxiv(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"arXiv:\s?([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?", 1), F.lit(""))


def isbn13(text: Column) -> Column:
    """The first ISBN-13 whose check digit holds, without hyphens."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"97[89][0-9-]{10,14}"), F.lit(0)), lambda x: F.replace(x, F.lit("-"), F.lit("")))
    weight = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda s, i: s + F.substring(x, i, F.lit(1)).cast("int") * (1 + 2 * ((i + 1) % 2)))
    good = F.filter(found, lambda x: (F.length(x) == 13) & (weight(x) % 10 == 0))
    return F.get(good, F.lit(0))


def doi(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]*[A-Za-z0-9])", 1), F.lit(""))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))


def dice(a: Column, b: Column) -> Column:
    """Similarity of two short texts: twice the shared character pairs, each as often as both have it, of all pairs
    (folded, letters and numbers alone). For many or long texts, corpus.dice_pairs joins counts instead."""
    x, y = (F.regexp_replace(folded(c), r"[^\p{L}\p{N}]", "") for c in (a, b))
    pairs = lambda t: F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    p, q = pairs(x), pairs(y)
    times = lambda array, g: F.size(F.filter(array, lambda v: v == g))
    common = F.aggregate(F.array_intersect(p, q), F.lit(0), lambda s, g: s + F.least(times(p, g), times(q, g)))
    short = (F.length(x) == 0) | (F.length(y) == 0)
    return F.when(short, 0.0).when(x == y, 1.0).when((F.length(x) < 2) | (F.length(y) < 2), 0.0).otherwise(2 * common / (F.size(p) + F.size(q)))
