"""Case and sound of short strings, vectorized over distinct values in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Sounds of letters in Metaphone.
_DROP_FIRST = {"kn": "n", "gn": "n", "pn": "n", "ae": "e", "wr": "r"}
_SAME = {"b": "b", "d": "t", "f": "f", "j": "j", "k": "k", "l": "l", "m": "m", "n": "n", "p": "p", "q": "k", "r": "r", "s": "s", "t": "t", "v": "f", "x": "ks", "z": "s"}


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Every letter behind a non-letter in upper case, all others in lower case."""
    return s.str.title()


def metaphone_code(word: str) -> str:
    """A Metaphone code: how a word sounds in English, as consonants."""
    w = "".join(c for c in word.lower() if c.isalpha())
    w = "".join(c for i, c in enumerate(w) if i == 0 or c != w[i - 1] or c == "c")
    if w[:2] in _DROP_FIRST:
        w = _DROP_FIRST[w[:2]] + w[2:]
    elif w[:1] == "x":
        w = "s" + w[1:]
    elif w[:2] == "wh":
        w = "w" + w[2:]
    out = []
    for i, c in enumerate(w):
        before, after, second = w[i - 1] if i else "", w[i + 1 : i + 2], w[i + 2 : i + 3]
        if c in "aeiou":
            out.append(c if i == 0 else "")
        elif c == "b":
            out.append("" if before == "m" and not after else "b")
        elif c == "c":
            if after == "h":
                out.append("k" if before == "s" else "x")
            elif after == "i" and second == "a":
                out.append("x")
            else:
                out.append(("" if before == "s" else "s") if after and after in "iey" else "k")
        elif c == "d":
            out.append("j" if after == "g" and second and second in "eiy" else "t")
        elif c == "g":
            if after == "h" and not (i + 2 >= len(w) or second in "aeiou"):
                out.append("")
            elif after == "n" and (i + 2 >= len(w) or w[i + 1 :] == "ned"):
                out.append("")
            elif after and after in "eiy" and before != "g":
                out.append("" if before == "d" else "j")
            else:
                out.append("k")
        elif c == "h":
            out.append("h" if after and after in "aeiou" and before not in ("c", "s", "p", "t", "g") else "")
        elif c == "k":
            out.append("" if before == "c" else "k")
        elif c == "p":
            out.append("f" if after == "h" else "p")
        elif c == "s":
            out.append("x" if after == "h" or after == "i" and second and second in "oa" else "s")
        elif c == "t":
            if after == "i" and second and second in "ao":
                out.append("x")
            elif after == "h":
                out.append("0")
            else:
                out.append("" if after == "c" and second == "h" else "t")
        elif c == "w" or c == "y":
            out.append(c if after and after in "aeiou" else "")
        else:
            out.append(_SAME.get(c, ""))
    return "".join(out).upper()


@F.pandas_udf(StringType())
def metaphone(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else metaphone_code(x))
