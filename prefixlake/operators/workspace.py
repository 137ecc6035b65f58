"""User state as pure transforms: saved searches, history, favourites, watch lists, notifications (2.Q, A20, C4, W6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(state: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``state`` with ``rows`` replacing equal keys (case-blind for text)."""
    kinds = dict(state.dtypes)
    folded = [F.lower(k).alias(k) if kinds[k] == "string" else F.col(k) for k in key]
    kept = state.alias("s").join(rows.select(*folded).alias("r"), [(F.lower(f"s.{k}") if kinds[k] == "string" else F.col(f"s.{k}")).eqNullSafe(F.col(f"r.{k}")) for k in key], "left_anti")
    return kept.unionByName(rows)


def saved_searches(state: DataFrame) -> DataFrame:
    """Pinned first, then by name."""
    return state.orderBy(F.desc("pinned"), F.lower("name"))


def add_history(history: DataFrame, entries: DataFrame, cap: int = 500) -> DataFrame:
    """History with the same query's older entries replaced, the newest ``cap`` of each user kept."""
    every = history.join(entries.select("user", "query"), ["user", "query"], "left_anti").unionByName(entries)
    newest = Window.partitionBy("user").orderBy(F.desc("at"), "query")
    return every.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= cap).drop("_n")


def toggle(state: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Favourites toggled: present ones go, absent ones come."""
    gone = state.join(rows.select(*key), key, "left_anti")
    new = rows.join(state.select(*key), key, "left_anti")
    return gone.unionByName(new)


def watchlist_counts(lists: DataFrame, items: DataFrame, events: DataFrame) -> DataFrame:
    """(watchlist, items, unread) of every list."""
    n = items.groupBy("watchlist").agg(F.count(F.lit(1)).alias("items"))
    unread = events.where(~F.col("acknowledged")).groupBy("watchlist").agg(F.count(F.lit(1)).alias("unread"))
    out = lists.join(n, "watchlist", "left").join(unread, "watchlist", "left")
    return out.select("watchlist", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("unread", F.lit(0)).alias("unread"))


def acknowledge(events: DataFrame, watchlist: str | None = None) -> DataFrame:
    """Events of a list, or all, marked read."""
    mine = F.lit(True) if watchlist is None else F.col("watchlist") == watchlist
    return events.withColumn("acknowledged", F.col("acknowledged") | mine)


def prune(state: DataFrame, column: str, cutoff: str) -> DataFrame:
    """Rows not older than the cutoff."""
    return state.where(F.col(column) >= F.lit(cutoff).cast("timestamp"))
