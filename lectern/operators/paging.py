"""Pages: offset with total, keyset with a probe row, and opaque cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, int(value)))


def offset_page(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0, max_limit: int = 100) -> DataFrame:
    """A page and, on each of its rows, total and has_more. One plan, so count and page agree."""
    limit, offset = clamp(limit, 1, max_limit), max(0, offset)
    page = df.orderBy(*order).offset(offset).limit(limit)
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    return page.join(F.broadcast(total), how="cross").withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int = 24, max_limit: int = 100) -> DataFrame:
    """The next ``limit`` rows after the key values ``after``, plus has_more from one probe row."""
    limit = clamp(limit, 1, max_limit)
    if after is not None:
        df = df.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after)]))
    probe = df.orderBy(*keys).limit(limit + 1)
    return probe.withColumn("_n", F.row_number().over(Window.orderBy(*keys))).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def encode_cursor(values: dict, key: bytes | None = None, bound_to: str = "", limit: int = 512) -> str:
    """base64url JSON, version 1; with ``key`` signed and bound to a user and filters. Raises past ``limit`` bytes."""
    body = json.dumps({"v": 1, **values}, separators=(",", ":"), sort_keys=True).encode()
    if key:
        body += b"." + hmac.new(key, body + bound_to.encode(), hashlib.sha256).hexdigest().encode()
    text = base64.urlsafe_b64encode(body).decode().rstrip("=")
    if len(text) > limit:
        raise ValueError("cursor too long")
    return text


def decode_cursor(text: str, key: bytes | None = None, bound_to: str = "", limit: int = 512) -> dict:
    """The values of ``encode_cursor``. Raises ValueError on anything else."""
    if len(text) > limit:
        raise ValueError("cursor too long")
    try:
        body = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        if key:
            body, _, sign = body.rpartition(b".")
            if not hmac.compare_digest(sign, hmac.new(key, body + bound_to.encode(), hashlib.sha256).hexdigest().encode()):
                raise ValueError("cursor of another reader")
        values = json.loads(body)
        if not isinstance(values, dict) or values.pop("v", None) != 1:
            raise ValueError("not a cursor")
    except (ValueError, UnicodeDecodeError) as e:
        raise ValueError(str(e)) from None
    return values
