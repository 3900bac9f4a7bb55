"""Settings of crawls, one text of JSON for each insurer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "insurer_code string, insurer_name string, base_url string, crawl_method string, has_pagination boolean, max_pages int, request_delay double, max_retries int"
NEEDED = ["insurer_code", "insurer_name", "base_url"]
# What settings are where a text leaves them out.
DEFAULTS = {"crawl_method": "static_html", "has_pagination": False, "max_pages": 100, "request_delay": 1.0, "max_retries": 3}


def settings(texts: DataFrame, column: str) -> DataFrame:
    """A row of settings for each text that can be read and has what is needed."""
    read = texts.select(F.from_json(column, SCHEMA).alias("s")).select("s.*").dropna(subset=NEEDED)
    return read.select("insurer_code", "base_url", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in DEFAULTS.items()])
