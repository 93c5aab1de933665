"""Who may see a row, as a Column that every read goes through, and the same rule in plain Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def access_predicate(role: str, user_id: str | None = None) -> Column:
    """admin: every row; premium: open rows, shared premium rows and own personal rows; any other role: open rows."""
    if role == "admin":
        return F.lit(True)
    allowed = F.col("access_tier") == "open"
    if role == "premium":
        allowed = allowed | ((F.col("access_tier") == "premium") & F.col("is_shared"))
        if user_id is not None:
            allowed = allowed | ((F.col("access_tier") == "personal") & (F.col("owner_id") == user_id))
    return F.coalesce(allowed, F.lit(False))


def may_see(role: str, user_id: str | None, tier: str, shared: bool, owner: str | None) -> bool:
    """The same rule for one row."""
    if role == "admin" or tier == "open":
        return True
    if role != "premium":
        return False
    return (tier == "premium" and bool(shared)) or (tier == "personal" and user_id is not None and owner == user_id)


def corpus_predicate(edition: str | None = None, language: str | None = None, category: str | None = None) -> Column:
    """Narrowing by equality; nothing given narrows nothing. It can only narrow what access allows."""
    parts = [F.col(c) == v for c, v in (("edition", edition), ("language", language), ("category", category)) if v is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def readable(docs: DataFrame, role: str, user_id: str | None = None, **selection: str | None) -> DataFrame:
    """Rows of the active generation of sources that are not deleted, visible to the user, narrowed by the selection."""
    return docs.where((F.col("generation") == "active") & ~F.col("is_deleted")).where(access_predicate(role, user_id)).where(corpus_predicate(**selection))


#: The declaration order of the enums that sort by it.
EDITIONS = ("5e", "5.5e")
ENTRY_TYPES = ("spell", "feat", "item", "glossary")
CITATION_KINDS = ("field", "block")


def ordinal(column: str, order: tuple[str, ...]) -> Column:
    """The position of a value in its enum's declaration order (0 if unknown)."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
