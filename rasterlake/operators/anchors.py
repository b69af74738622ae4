"""Page headers kept in a table, against those of the files as they are now.

An anchor is a page that was found once: where its header stands, what it says, which
page points to it, and the file's first page and length. It still holds if all of that is
so in the file read again, which takes two lookups by offset and no walk. ``changes``
says of every file what became of it, ``group_counts`` counts the pages of file groups.
Everything is joined by (file, offset) or file; headers of one file may be many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchors(headers: DataFrame) -> DataFrame:
    """Headers (file, page, off, next, ...) with ``prev``, the offset of the page before."""
    return headers.withColumn("prev", F.lag("off").over(Window.partitionBy("file").orderBy("page")))


def _same(fields: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"n.{c}")) for c in fields))


def still_anchored(kept: DataFrame, facts: DataFrame, headers: DataFrame, new_facts: DataFrame) -> DataFrame:
    """(file, page, off, reason): why a kept anchor no longer holds, null if it does.

    ``facts`` are (file, first, length); a file that is gone has none. The first reason counts: gone,
    first page moved, length changed, header changed, chain changed.
    """
    fields = [c for c in headers.columns if c not in ("file", "page", "off")]
    old = kept.alias("a").join(facts.alias("f"), "file").join(new_facts.alias("g"), "file", "left")
    found = old.join(headers.alias("n"), (F.col("a.file") == F.col("n.file")) & (F.col("a.off") == F.col("n.off")), "left")
    before = headers.select(F.col("file").alias("p_file"), F.col("off").alias("p_off"), F.col("next").alias("p_next"))
    linked = found.join(before, (F.col("a.file") == F.col("p_file")) & (F.col("a.prev") == F.col("p_off")), "left")
    enters = F.when(F.col("a.prev").isNull(), F.col("a.off") == F.col("g.first")).otherwise(F.coalesce(F.col("p_next") == F.col("a.off"), F.lit(False)))
    reason = (
        F.when(F.col("g.first").isNull(), "gone")
        .when(F.col("f.first") != F.col("g.first"), "first page moved")
        .when(F.col("f.length") != F.col("g.length"), "length changed")
        .when(F.col("n.off").isNull() | ~_same(fields), "header changed")
        .when(~enters, "chain changed")
    )
    return linked.select("a.file", "a.page", "a.off", reason.alias("reason"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change, pages, kept): new, gone, same, grown, cut or rewritten, the pages there are and the leading ones that stayed.

    A page stayed if its header is the same at the same place; the last old page of a grown file may
    point on, and the last page of one that was cut may end.
    """
    fields = [c for c in old.columns if c not in ("file", "page", "next")]
    same = reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"n.{c}")) for c in fields))
    pairs = old.alias("a").join(new.alias("n"), (F.col("a.file") == F.col("n.file")) & (F.col("a.page") == F.col("n.page")), "full")
    moves = F.col("a.next").eqNullSafe(F.col("n.next")) | (F.coalesce("a.next", F.lit(0)) == 0) | (F.coalesce("n.next", F.lit(0)) == 0)
    page, stays = F.coalesce("a.page", "n.page"), F.coalesce(same & moves, F.lit(False))
    per = pairs.select(F.coalesce("a.file", "n.file").alias("file"), page.alias("page"), F.col("a.page").isNotNull().alias("was"), F.col("n.page").isNotNull().alias("there"), stays.alias("stays"))
    per_file = per.groupBy("file").agg(F.count_if("was").alias("before"), F.count_if("there").alias("pages"), F.coalesce(F.min(F.when(~F.col("stays"), F.col("page"))), F.count("*")).alias("kept"))
    change = (
        F.when(F.col("before") == 0, "new")
        .when(F.col("pages") == 0, "gone")
        .when(F.col("kept") < F.least("before", "pages"), "rewritten")
        .when(F.col("pages") > F.col("before"), "grown")
        .when(F.col("pages") < F.col("before"), "cut")
        .otherwise("same")
    )
    return per_file.select("file", change.alias("change"), "pages", "kept")


def group_counts(files: DataFrame) -> DataFrame:
    """(group, files, failed, pages, usable): pages of a group if every file was measured, and those before its first failure.

    ``files`` are (group, place, file, pages, error), in the order ``place``. A later failure leaves the files before it usable.
    """
    failed = F.col("error").isNotNull() | F.col("pages").isNull()
    stop = files.groupBy("group").agg(F.count("*").alias("files"), F.count_if(failed).alias("failed"), F.min(F.when(failed, F.col("place"))).alias("stop"))
    ahead = files.join(stop, "group").groupBy("group").agg(F.sum(F.when(F.col("stop").isNull() | (F.col("place") < F.col("stop")), F.col("pages"))).alias("usable"))
    whole = F.when(F.col("failed") == 0, F.coalesce("usable", F.lit(0)))
    return stop.join(ahead, "group").select("group", "files", "failed", whole.alias("pages"), F.coalesce("usable", F.lit(0)).alias("usable"))
