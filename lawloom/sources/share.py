"""Texts as short payloads for links: a letter for the form, then base64 for addresses."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Letters of the forms, and the length from which an address is too long for some readers.
DEFLATED, RAW, LONG = "z", "r", 8000


def encode_raw(text: Column) -> Column:
    body = F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_")
    return F.concat(F.lit(RAW), body)


def decode_raw(payload: Column) -> Column:
    body = F.translate(F.substring(payload, F.lit(2), F.length(payload)), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    return F.when(payload.startswith(RAW), F.decode(F.unbase64(padded), "UTF-8"))


@pandas_udf(StringType())
def encode_deflated(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        return DEFLATED + base64.urlsafe_b64encode(z.compress(t.encode()) + z.flush()).decode().rstrip("=")

    return text.map(one)


@pandas_udf(StringType())
def decode_deflated(payload: pd.Series) -> pd.Series:
    def one(p: str | None) -> str | None:
        if not p or p[0] != DEFLATED:
            return None
        try:
            return zlib.decompress(base64.urlsafe_b64decode(p[1:] + "=" * (-len(p[1:]) % 4)), -15).decode()
        except (ValueError, zlib.error):
            return None

    return payload.map(one)


def too_long(payload: Column) -> Column:
    return F.length(payload) > LONG
