"""Explicit schemas of the inputs; numbers arrive as text and are cast where they parse."""

from __future__ import annotations

from pyspark.sql import types as T


def text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column names of the input files.
PRICES = text("Date", "Price")
FACTORS = text("Date", "Mkt_RF", "SMB", "HML", "RMW", "CMA", "RF")
QUARTERLY = text("caldt", "cpiret", "cpiind", "t30ret", "t90ret", "b10ret", "b10ind")
FLAG = text("observation_date", "USREC")
CODES = text("column", "tcode")
CATALOG = text("index_name", "file_name", "index_short_name", "ticker", "region", "category", "start_date", "end_date")
FX_COLUMNS = {
    "EURUSD BGN Curncy": "EURUSD", "USDJPY BGN Curncy": "USDJPY", "USDCHF BGN Curncy": "USDCHF", "USDCAD BGN Curncy": "USDCAD",
    "AUDUSD BGN Curncy": "AUDUSD", "NZDUSD BGN Curncy": "NZDUSD", "USDNOK BGN Curncy": "USDNOK", "USDSEK BGN Curncy": "USDSEK",
    "GBPUSD BGN Curncy": "GBPUSD",
}
