"""JSON that a model wrote among other things, as column functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands around JSON, and the faults that are mended in it.
_AROUND = re.compile(r"(?s)<think>.*?</think>")
_STRING = r'"(?:[^"\\]|\\.)*"'
_FAULTS = re.compile(rf"(?s)({_STRING})|//[^\n]*|/\*.*?\*/|,(?=\s*[\]}}])|\bTrue\b|\bFalse\b|\bNone\b|\bNaN\b|[\n\t\r]")
_WORDS = {"True": "true", "False": "false", "None": "null", "NaN": "null"}


def mended(text: str) -> str:
    """A JSON text without comments and trailing commas, with JSON's own constants; line breaks within strings escaped."""

    def right(m: re.Match) -> str:
        if m[1] is not None:
            return m[1].replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
        return _WORDS.get(m[0], " ")

    return _FAULTS.sub(right, text)


def closed(text: str) -> str:
    """A text that begins with a brace, up to the one that closes it; a text that was cut off is closed."""
    opened, inside, at = [], False, 0
    while at < len(text):
        c = text[at]
        if inside:
            at += c == "\\"
            inside = c != '"'
        elif c == '"':
            inside = True
        elif c in "{[":
            opened.append("}" if c == "{" else "]")
        elif c in "}]":
            if not opened or opened.pop() != c:
                return text[: at + 1]
            if not opened:
                return text[: at + 1]
        at += 1
    return text.rstrip("\\") + ('"' if inside else "") + "".join(reversed(opened))


def first_object(text: str | None, need: str | None = None) -> dict | None:
    """The first JSON object of a text, mended if need be, that has the key `need` where one is named; None without one."""
    plain = _AROUND.sub("", text or "")
    at = plain.find("{")
    while at >= 0:
        whole = closed(plain[at:])
        for form in (whole, mended(whole)):
            try:
                found = json.loads(form, strict=False)
            except ValueError:
                continue
            if isinstance(found, dict) and (need is None or need in found):
                return found
            break
        at = plain.find("{", at + 1)
    return None


def json_object(text: Column, need: str | None = None) -> Column:
    """The first object of each text as JSON of one form; null where there is none."""

    @F.pandas_udf(T.StringType())
    def tell(texts: pd.Series) -> pd.Series:
        found = (first_object(t, need) for t in texts)
        return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False, allow_nan=False, default=str) for x in found], dtype=object)

    return tell(text)
