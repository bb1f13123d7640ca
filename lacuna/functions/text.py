"""Comparable keys of multilingual titles: plain Python kernels and Arrow wrappers for distinct values."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that decomposition leaves, in Latin letters.
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"}
#: Han numerals.
HAN_DIGITS = {"〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
#: Words after which any numeral from I to XX is a number, single letters included.
NUMBERED = "part pt act movement mov mvt vol volume chapter suite no nr track scene phase section book canto opus op"


def _roman(n: int) -> str:
    tens, ones = divmod(n, 10)
    return "x" * tens + ("ix" if ones == 9 else "iv" if ones == 4 else "v" * (ones // 5) + "i" * (ones % 5))


#: Roman numerals from I to XX and their numbers.
NUMBERED_VALUES = _VALUES = {_roman(n): str(n) for n in range(1, 21)}
_NUMERAL = re.compile(
    rf"(?P<word>\b(?:{'|'.join(NUMBERED.split())})\b\.?\s*)(?P<after>[ivx]+)\b|(?P<open>[(\[{{]\s*)(?P<inside>[ivx]+)(?=\s*[)\]}}])|\b(?P<alone>[ivx]{{2,}})\b", re.IGNORECASE
)
# a text without such a word has no numeral
_ROMAN = re.compile(r"\b[ivx]+\b", re.IGNORECASE)
_SPACE = re.compile(r"[\W_]+")


def _han_number(text: str) -> str:
    total, ones = 0, 0
    for c in text:
        if c == "十":
            total, ones = total + 10 * (ones or 1), 0
        else:
            ones = ones * 10 + HAN_DIGITS[c]
    return str(total + ones)


_HAN = re.compile("[〇一二三四五六七八九十]+")


def _hiragana(c: str) -> str:
    return chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c


def normalised(text: str | None) -> str:
    """Case, accents, width, kana script and punctuation are one; symbol-only titles keep their symbols."""
    if not text:
        return ""
    folded = unicodedata.normalize("NFKC", text).casefold()
    marks = "".join(c for c in unicodedata.normalize("NFKD", folded) if not unicodedata.combining(c) or c in "゙゚")
    plain = "".join(LATIN.get(c, _hiragana(c)) for c in unicodedata.normalize("NFC", marks))
    plain = _HAN.sub(lambda m: _han_number(m[0]), plain)
    key = _SPACE.sub(" ", plain).strip()
    return key or " ".join(folded.split())


def numerals(text: str) -> str:
    """Roman numerals from I to XX as digits; I, V and X alone only in brackets or after a word that numbers something."""

    def digits(m: re.Match) -> str:
        found = m["after"] or m["inside"] or m["alone"]
        return (m["word"] or m["open"] or "") + _VALUES.get(found.lower(), found)

    return _NUMERAL.sub(digits, text) if _ROMAN.search(text) else text


_DASH = r"[-‐-―−~〜～]"
_PREFIX = re.compile(rf"^\s*(?:(?:cd|disc)\s*\d+\s*{_DASH}\s*)?(?:[a-d]?\d{{1,3}}(?:{_DASH}\d{{1,3}})?)\s*(?:[.)]|{_DASH})?\s+(?=\S)", re.IGNORECASE)
_ARTIST = re.compile(rf"^.{{1,80}}?\s+{_DASH}\s+(?=\S)")


def filename_title(name: str) -> str:
    """The title in a file's name: without extension, leading number and artist."""
    stem = re.sub(r"\.[A-Za-z0-9]{2,4}$", "", name.replace("\\", "/").rsplit("/", 1)[-1])
    return _ARTIST.sub("", _PREFIX.sub("", stem)).strip() or stem


#: Words that make a bracket a version, and marks of a guest.
_DESCRIPTOR = re.compile(r"[\(\[]([^()\[\]]*\b(?:live|remix|mix|demo|acoustic|instrumental|remaster(?:ed)?|edit|version|mono|stereo|karaoke)\b[^()\[\]]*)[\)\]]", re.IGNORECASE)
_FEATURE = re.compile(r"[\(\[]\s*(?:feat\.?|ft\.?|featuring|with)\s+([^()\[\]]+)[\)\]]|\s(?:feat\.?|ft\.?|featuring)\s+(.+)$", re.IGNORECASE)


def title_parts(title: str) -> tuple[str, list[str], str]:
    """The base title's key, its version descriptors and the guests it credits; an unbracketed "with" is title text.
    Roman numerals count as numbers, so Part II and Part 2 have one key."""
    guests = " & ".join(next(g for g in m.groups() if g).strip() for m in _FEATURE.finditer(title))
    rest = numerals(_FEATURE.sub(" ", title))
    versions = sorted({normalised(m[1]) for m in _DESCRIPTOR.finditer(rest)})
    return normalised(_DESCRIPTOR.sub(" ", rest)), versions, normalised(guests)


def contiguous(needle: list[str], hay: list[str]) -> bool:
    n = len(needle)
    return n > 0 and any(hay[i : i + n] == needle for i in range(len(hay) - n + 1))


def _each(kernel):
    """A vectorised form of a kernel; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: kernel(x) if x is not None else None)

    return run


def _title_frame(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([title_parts(x or "") for x in s], columns=["base", "versions", "guests"])


def normalised_col(column: str) -> Column:
    return F.pandas_udf(_each(normalised), "string")(column)


def filename_title_col(column: str) -> Column:
    return F.pandas_udf(_each(filename_title), "string")(column)


def title_parts_col(column: str) -> Column:
    """A struct of base title, versions and guests."""

    def run(s: pd.Series) -> pd.DataFrame:
        return _title_frame(s)

    return F.pandas_udf(run, "base string, versions array<string>, guests string")(column)


def with_key(df: DataFrame, column: str, key: str) -> DataFrame:
    """Normalise each distinct value once and join the keys back."""
    values = df.select(F.col(column).alias("__value")).filter("__value is not null").distinct().withColumn(key, normalised_col("__value"))
    return df.join(values, df[column] == values["__value"], "left").drop("__value")
