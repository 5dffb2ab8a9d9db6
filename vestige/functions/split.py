"""A cell's text taken apart into the fields that it packs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: parts that one text gives at most; what is left over is the last part.
MOST_PARTS = 1000
PARTS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
_blank = re.compile(r"[ \t\n\r]*").match
_decoder = json.JSONDecoder(strict=True, parse_constant=lambda name: _refuse(name))


def _refuse(name: str) -> None:
    raise ValueError(name)


def json_entries(text: str) -> list[tuple[str, str]] | None:
    """(key, value as written) of a JSON object with at least one key, in order, repeated keys too; else None."""
    if not (text.startswith("{") and text.endswith("}")):
        return None
    out, at = [], _blank(text, 1).end()
    try:
        while True:
            if text[at] != '"':
                return None
            key, at = json.decoder.scanstring(text, at + 1, True)
            at = _blank(text, at).end()
            if text[at] != ":":
                return None
            start = _blank(text, at + 1).end()
            _, at = _decoder.raw_decode(text, start)
            out.append((key, text[start:at]))
            at = _blank(text, at).end()
            if text[at] == "}":
                return out if at == len(text) - 1 else None
            if text[at] != ",":
                return None
            at = _blank(text, at + 1).end()
    except (ValueError, IndexError, RecursionError):  # not JSON, or nested too deeply to say
        return None


def _field(piece: str, separator: str) -> tuple[str | None, str] | None:
    if separator == "¦":
        piece = piece.strip()
        key, found, value = piece.partition(": ")
        return ((key.strip(), value.strip()) if found and key.strip() else (None, piece)) if piece else None
    piece = piece.removesuffix("\r")
    return (None, piece) if piece.strip() else None


def _fields(text: str, separator: str) -> list[tuple[str | None, str]] | None:
    pieces, at = [], 0
    for found in re.finditer(f"[{separator}]|$(?!\n)", text):
        pieces.append((at, text[at : found.start()]))
        at = found.end()
    full = [(start, field) for start, piece in pieces if (field := _field(piece, separator))]
    if len(full) < 2:
        return None
    parts = [field for _, field in full[:MOST_PARTS]]
    if len(full) > MOST_PARTS:
        parts[-1] = (None, text[full[MOST_PARTS - 1][0] :].strip())
    return parts


def parts_of(text: str) -> list[tuple[str | None, str]]:
    """Fields of a JSON object, of ``¦``, or of tabs and lines, by the first of these that finds any; else the whole text."""
    entries = json_entries(text.strip())
    if entries:
        rest = ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in entries[MOST_PARTS - 1 :])
        return [*entries[: MOST_PARTS - 1], *([(None, "{" + rest + "}")] if rest else [])]
    return ("¦" in text and _fields(text, "¦")) or _fields(text, "\t\n") or [(None, text)]


@F.pandas_udf(PARTS)
def _split(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"key": k, "value": v} for k, v in parts_of(t)])


def split_value(text: Column) -> Column:
    """Array of (key, value) in order; null for null. Python, in Arrow batches: no built-in function keeps a JSON value as written."""
    return _split(text)
