"""Keys, fingerprints and duplicate resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.ranking import first_per_key


def digest(*parts: Column | str, separator: str = "\u001f") -> Column:
    """SHA-256 over the parts with a separator that texts don't hold; a null part differs from an empty one."""
    own = [F.coalesce(F.concat(F.lit("v"), (F.col(p) if isinstance(p, str) else p).cast("string")), F.lit("n")) for p in parts]
    return F.sha2(F.array_join(F.array(*own), separator), 256)


def business_key(organization: Column, title: Column, url: Column, *fallback: Column) -> Column:
    """By title and address where there is one, else by the fallback fields."""
    return F.when(F.coalesce(url, F.lit("")) != "", digest(F.lit("v1"), organization, title, url)).otherwise(digest(F.lit("v1"), organization, title, *fallback))


def stable_id(explicit: Column, *parts: Column, limit: int = 255) -> Column:
    """The explicit id if it is there and short enough, else a derived one."""
    derived = F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    return F.when(F.coalesce(F.length(explicit), F.lit(0)).between(1, limit), explicit).otherwise(derived)


def resolve_duplicates(rows: DataFrame, key: str, content: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): equal copies of a key count once; a key with different copies loses all of them.

    One aggregation with partial results; no copy of the rows is gathered.
    """
    groups = rows.groupBy(key).agg(F.count_distinct(digest(*content)).alias("versions"), F.count("*").alias("copies"), *(F.min(c).alias(c) for c in content))
    return groups.where("versions = 1").drop("versions"), groups.where("versions > 1").select(key, "versions", "copies")


def survivors(rows: DataFrame, key: str, id_col: str, order: list[Column]) -> DataFrame:
    """(id, survivor) for every row: the first of its key in the order."""
    first = first_per_key(rows, [key], order).select(key, F.col(id_col).alias("survivor"))
    return rows.select(key, id_col).join(first, key).select(id_col, "survivor")


def message_key(account: Column, mailbox: Column, message_id: Column, *content: Column) -> Column:
    """By the message's own id, else by its content."""
    by_id = F.concat(F.lit("message_id:"), digest(account, mailbox, message_id))
    return F.when(F.coalesce(message_id, F.lit("")) != "", by_id).otherwise(F.concat(F.lit("content:"), digest(account, *content)))


def conflict(*candidates: Column) -> Column:
    """The one value on which the candidates that are there agree; null if none is there or they differ."""
    own = F.array_distinct(F.array_compact(F.array(*candidates)))
    return F.when(F.size(own) == 1, own[0])
