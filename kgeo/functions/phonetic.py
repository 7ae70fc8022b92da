"""Metaphone: consonant sounds of English words, up to a number of signs."""

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spelling to sound, tried in this order at each place (pattern of what follows, sound); # is a vowel before.
SOUNDS = [(re.compile(p), s) for p, s in (
    (r"TCH", "X"), (r"SCH", "SK"), (r"CIA|CH|SH|SI[AO]|TI[AO]", "X"), (r"TH", "0"), (r"PH", "F"), (r"C[IEY]", "S"), (r"CK", "K"), (r"DG[EIY]", "J"),
    (r"GH(?![AEIOU])", ""), (r"GN$|GNED$", "N"), (r"G[EIY]", "J"), (r"WH", "W"), (r"W[AEIOU]", "W"), (r"W", ""), (r"Y[AEIOU]", "Y"), (r"Y", ""),
    (r"X", "KS"), (r"[CQK]", "K"), (r"G", "K"), (r"D", "T"), (r"V", "F"), (r"Z", "S"), (r"H[AEIOU]", "H"), (r"H", ""), (r"[BFJLMNPRST]", None))]
_LENGTH = {"TCH": 3, "SCH": 3, "CIA": 3}


def metaphone_of(word: str | None, most: int = 4) -> str | None:
    if word is None:
        return None
    w = re.sub("[^A-Z]", "", word.upper())
    w = re.sub("^(?:[KGP]N|AE|WR)", lambda m: m[0][1], w)
    w = re.sub("^X", "S", w)
    w = re.sub(r"MB$", "M", w)
    out, i = "", 0
    while i < len(w) and len(out) < most:
        c = w[i]
        if i and c == w[i - 1] and c != "C":
            i += 1
            continue
        if c in "AEIOU":
            out += c if i == 0 else ""
            i += 1
            continue
        for p, s in SOUNDS:
            if m := p.match(w, i):
                out += c if s is None else s
                i += 2 if m[0] in ("CH", "SH", "TH", "PH", "CK", "WH") or m[0][:2] == "GH" else _LENGTH.get(m[0], 1)
                break
        else:
            i += 1
    return out[:most]


@F.pandas_udf(StringType())
def metaphone(words: pd.Series) -> pd.Series:
    return words.map(metaphone_of)
