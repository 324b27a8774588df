"""Candle payloads: one JSON object with an array per field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import clean

# The usual one-letter names; pass another mapping for other vendors.
FIELDS = {"ts": "t", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}


def candles(payloads: DataFrame, ticker: str = "ticker", payload: str = "payload", fields=None) -> DataFrame:
    """Rows from (ticker, payload); times are epoch seconds."""
    fields = fields or FIELDS
    schema = ", ".join(f"`{f}` array<{'bigint' if c == 'ts' else 'double'}>" for c, f in fields.items())
    parsed = payloads.select(F.col(ticker).alias("ticker"), F.from_json(payload, schema).alias("p"))
    zipped = F.arrays_zip(*[F.col("p")[f].alias(c) for c, f in fields.items()])
    rows = parsed.select("ticker", F.explode(zipped).alias("z")).select("ticker", "z.*")
    return clean(rows.withColumn("ts", F.timestamp_seconds("ts")))
