"""Names of people and regions of images, as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Particles of family names, words of corporate names, and languages with two family names.
PARTICLES = "de del da das do dos di du van von der le la y".split()
PAIRS = ("de la", "de las", "de los", "van der", "van den")
CORPORATE = r"(?i)\b(?:inc|ltd|institute|university|universidad|national|agency|press|society|academia)\b"
TWO_FAMILIES = ("es", "pt", "ca", "gl")


def split_name(text: str, language: str | None = None) -> dict[str, str]:
    """A person's name as CSL has it: family, given, dropping-particle; or literal for a body."""
    name = re.sub(r"\s+", " ", text.strip(" \t\n,;"))
    name = re.sub(r"\s*\([0-9]{3,4}\s*[-–]\s*[0-9]{0,4}\)$|,\s*[0-9]{3,4}-[0-9]{0,4}\.?$", "", name)
    if not name or re.search(CORPORATE, name):
        return {"literal": name} if name else {}
    if "," in name:
        family, given = (x.strip() for x in name.split(",", 1))
        tail = re.search(r"(?i)\s((?:de|del|da|di|du|van|von)(?:\s(?:la|los|las|der|den))?)$", given)
        return {"family": family, "given": given[: tail.start()], "dropping-particle": tail[1]} if tail else {"family": family, "given": given}
    words = name.split(" ")
    for i in range(1, len(words) - 1):
        for size in (2, 1):
            part = " ".join(words[i : i + size])
            if i + size < len(words) and (part.lower() in PAIRS if size == 2 else part in PARTICLES):
                return {"given": " ".join(words[:i]), "dropping-particle": part, "family": " ".join(words[i + size :])}
    families = 2 if len(words) > 2 and (language or "").startswith(TWO_FAMILIES) else 1
    return {"family": " ".join(words[-families:])} | ({"given": " ".join(words[:-families])} if len(words) > families else {})


_NAME = StructType([StructField(k, StringType()) for k in ("family", "given", "dropping-particle", "literal")])


@F.pandas_udf(_NAME)
def parsed_name(text: pd.Series, language: pd.Series) -> pd.DataFrame:
    rows = [split_name(t or "", lang) for t, lang in zip(text, language)]
    return pd.DataFrame([[r.get(k) for k in ("family", "given", "dropping-particle", "literal")] for r in rows], columns=["family", "given", "dropping-particle", "literal"])


def region(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A region as fractions within the image, from fractions or thousandths; null if nothing is left."""
    scale = F.when(F.greatest(x, y, w, h) > 1.5, 1000.0).otherwise(1.0)
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / scale))
    a, b = cut(x), cut(y)
    made = F.struct(F.round(a, 4).alias("x"), F.round(b, 4).alias("y"), F.round(F.least(cut(w), 1 - a), 4).alias("w"), F.round(F.least(cut(h), 1 - b), 4).alias("h"))
    return F.when((cut(w) > 0) & (cut(h) > 0), made)


# Ligatures and the long s, which readers give for the letters they stand for.
READ_AS = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ſ": "s"}


def read_text(text: Column) -> Column:
    """A reader's text: line ends, blanks before them, runs of empty lines, ligatures."""
    out = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    for sign, plain in READ_AS.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


def heard(name: Column, words: Column, catalogue: Column) -> Column:
    """Whether a speaker's name may be given: its parts were said, or a catalogue has it."""
    said = F.forall(F.filter(F.split(F.lower(name), r"\s+"), lambda p: F.length(p) > 2), lambda p: F.array_contains(F.transform(words, F.lower), p))
    return F.coalesce(said, F.lit(False)) | F.array_contains(catalogue, name)
