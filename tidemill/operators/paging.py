"""Page and offset limits by bitsets of pages, per-key limits, keyed maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Pages in a word of a bitset.
WORD = 62


def _bits(n: Column) -> Column:
    """A long with one bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _lowest(bits: Column) -> Column:
    """The place of the lowest set bit (WORD or more of none)."""
    return F.bit_count(bits.bitwiseAND(-bits) - 1)


def stops(pages: DataFrame, key: list[str], page: str, last: Column, cap: int | Column) -> DataFrame:
    """Per key, how many pages count: up to the first that is the last or before the first that is missing, and at most cap.

    last: whether no page is asked for after this one; null is no. Of a page captured twice, one that is the
    last will do. A key's pages meet as bitsets, WORD pages in a long, so a key with any number of captures
    sends a row per task and word. Keys without a page 1 have no pages that count.
    """
    cap = F.lit(cap) if isinstance(cap, int) else cap
    n = F.col(page).cast("int")
    each = pages.where((n >= 1) & (n <= cap)).select(*key, F.floor((n - 1) / WORD).cast("int").alias("__w"), _bits((n - 1) % WORD).alias("__bit"), F.coalesce(last, F.lit(False)).alias("__last"), cap.cast("int").alias("__cap"))
    words = each.groupBy(*key, "__w").agg(F.bit_or("__bit").alias("__there"), F.coalesce(F.bit_or(F.when(F.col("__last"), F.col("__bit"))), F.lit(0)).alias("__last"), F.max("__cap").alias("__cap"))
    gap = F.least(_lowest(F.bitwise_not("__there")), F.lit(WORD))
    taken = F.least(gap, F.when(F.col("__last") != 0, _lowest(F.col("__last")) + 1).otherwise(WORD))
    ends = words.withColumn("__end", F.when((gap < WORD) | (F.col("__last") != 0), F.col("__w") * WORD + taken))
    held = ends.groupBy(*key).agg(F.min("__end").alias("__end"), F.collect_set("__w").alias("__ws"), F.max("__w").alias("__top"), F.max("__cap").alias("__cap"))
    missing = F.array_min(F.array_except(F.sequence(F.lit(0), F.col("__top") + 1), F.col("__ws")))  # words: no more than cap / WORD
    return held.select(*key, F.least(F.coalesce("__end", F.col("__cap")), missing * WORD, "__cap").alias("__stop"))


def until_last(pages: DataFrame, key: list[str], page: str, last: Column, cap: int | Column, paged: Column | None = None) -> DataFrame:
    """The pages that stops() counts.

    paged: of which rows this holds; the others all stay, and meet nothing. The stops are a row per key: where
    Spark knows or finds them small, they go to the pages. pages is read twice.
    """
    mine = pages if paged is None else pages.where(paged)
    ends = stops(mine, key, page, last, cap)
    ends = ends.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), "__stop")
    same = F.col(page) <= F.col("__stop")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    taken = mine.where(F.col(page) >= 1).join(ends, same, "left_semi")
    return taken if paged is None else taken.unionByName(pages.where(~paged))


def until_empty(pages: DataFrame, key: list[str], page: str, empty: Column, cap: int | Column, paged: Column | None = None) -> DataFrame:
    """Pages before their key's first empty or missing one, and at most cap of them; pages count from 1.

    paged: of which rows this holds; the others all stay. A page that is there twice is the last that counts.
    For that, rows are numbered by key; where keys may be hot, stops() needs no key's rows together.
    """
    own, end = Window.partitionBy(*key), (F.lit(cap) if isinstance(cap, int) else cap) + 1
    bad = F.min(F.when(empty, F.col(page))).over(own)
    gap = F.min(F.when(F.col("__want") != F.col(page), F.col("__want"))).over(own)
    ranked = pages.withColumn("__want", F.row_number().over(own.orderBy(page)))
    stays = F.col(page) < F.col("__stop")
    return ranked.withColumn("__stop", F.least(F.coalesce(bad, end), F.coalesce(gap, end), end)).where(stays if paged is None else stays | ~paged).drop("__want", "__stop")


def below_total(page: Column, total: Column, size: int, cap: int | Column) -> Column:
    return (page <= cap) & ((page == 1) | ((page - 1) * size < total))


def until_total(pages: DataFrame, page: str, total: str, size: int, cap: int) -> DataFrame:
    """Pages (from 1) whose offset lies below the total, and at most cap of them; the first is always taken."""
    return pages.where(below_total(F.col(page), F.col(total), size, cap))


def first_per_key(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def keyed_lists(rows: DataFrame, group: list[str], key: str, value: str, order: str) -> DataFrame:
    """Per group, a map from key to its values in order."""
    lists = rows.groupBy(*group, key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("__l"))
    entry = F.struct(F.col(key).alias("k"), F.transform("__l", lambda x: x["v"]).alias("v"))
    return lists.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("lists"))
