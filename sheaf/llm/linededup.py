"""Boilerplate lines by site-relative frequency: the share of a host's pages that hold a line. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import BLANKS, checkpoint, join_groups

#: A line in more than this share of its host's pages is boilerplate. A line on one page only does not recur on the site,
#: so it has no frequency there and is never dropped, whatever the host's size.
MAX_RATIO = 0.05
#: Boilerplate lines of all hosts up to which they are broadcast (16 bytes each, and the host); beyond, lines are joined.
BROADCAST_LINES = 200_000
#: Hosts up to which their page counts are broadcast.
BROADCAST_HOSTS = 200_000


def _bare(text: Column) -> Column:
    """The lines of a text without the blanks at their ends."""
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def _digest(bare: Column) -> Column:
    return F.struct(F.xxhash64(bare).alias("h"), F.xxhash64(F.lit(1), bare).alias("g"))


def _host_key(host: Column) -> Column:
    """A string that is never null, so that null hosts join as one host."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """host, h, g, pages_with, host_pages: the lines over the ratio, of (host, text); host is never null.

    Distinct lines of a page are found among strings, in linear time. Counts are summed by (host, line) before anything is
    shuffled, so no host is one task.
    """
    distinct = F.filter(F.array_distinct(_bare(F.col("text"))), lambda x: x != "")
    per_line = pages.select("host", F.explode(F.transform(distinct, _digest)).alias("d")).groupBy("host", "d.h", "d.g").agg(F.count("*").alias("pages_with"))
    totals = checkpoint(pages.groupBy("host").agg(F.count("*").alias("host_pages")).withColumn("weight", F.col("host_pages")))
    recurring = per_line.where("pages_with > 1")
    if totals.limit(BROADCAST_HOSTS + 1).count() > BROADCAST_HOSTS:
        recurring = checkpoint(recurring)
    return join_groups(recurring, totals, "host", BROADCAST_HOSTS).where(F.col("pages_with") > F.col("host_pages") * F.lit(max_ratio))


def _among(sorted_: Column, wanted: Column) -> Column:
    """Whether wanted is in a sorted array, by halving: as many steps as the array's size has bits."""
    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        right = F.get(sorted_, middle) <= wanted
        return F.struct(F.when(right, middle).otherwise(span["low"]).alias("low"), F.when(right, span["high"]).otherwise(middle).alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.size(sorted_).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(sorted_) + 1)).cast("int")), whole, halve, lambda span: span["low"])
    return F.get(sorted_, found) == wanted


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with text less its boilerplate lines, and n_lines and n_dropped (names of docs' own come first).

    Each row of docs is a page, repeated rows too; null hosts form one host. A page counts once for a line however often it
    holds it, lines are compared without blanks at their ends, and lines of blanks only are never counted nor dropped. Null
    text stays null (no lines). Kept lines stay in order, joined by line feeds; a text of boilerplate only becomes empty.
    Each occurrence of a dropped line goes. A line of one page only stays, so a host of one page loses nothing. An empty
    table gives none; a long text takes time in proportion to its lines.
    """
    keyed = docs.select(*(docs[c] for c in docs.columns), _host_key(docs[host]).alias("__sheaf_host"))
    # At most (lines of a page) / max_ratio lines for a host, so far fewer than the input's.
    found = checkpoint(boilerplate(keyed.select(F.col("__sheaf_host").alias("host"), "text"), max_ratio).select("host", "h", "g", F.col("pages_with").alias("weight")))
    kept = _filtered(keyed, found) if found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else _joined(keyed, found)
    text, lines = F.col("text"), F.size(F.split("text", "\n"))
    extra = {"n_lines": F.when(text.isNull(), 0).otherwise(lines).cast("long"), "n_dropped": F.when(text.isNull() | F.col("__sheaf_kept").isNull(), 0).otherwise(lines - F.size("__sheaf_kept")).cast("long")}
    cleaned = F.when(F.col("__sheaf_kept").isNull(), text).otherwise(F.array_join("__sheaf_kept", "\n"))
    return kept.select(*(cleaned.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), *(v.alias(k) for k, v in extra.items() if k not in docs.columns))


def _filtered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with __sheaf_kept, the kept lines (null where the host has no boilerplate). The few lines found are broadcast; no text is shuffled."""
    per_host = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("h", "g"))).alias("__sheaf_bad"))
    marked = docs.join(F.broadcast(per_host.withColumnRenamed("host", "__sheaf_host")), "__sheaf_host", "left")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), _digest(F.btrim(x, F.lit(BLANKS))).alias("d")))
    kept = F.transform(F.filter(lines, lambda x: ~_among(F.col("__sheaf_bad"), x["d"])), lambda x: x["line"])
    return marked.withColumn("__sheaf_kept", F.when(F.col("__sheaf_bad").isNotNull(), kept))


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The same for any number of lines found: each line is a row of its own, and meets its like by (host, digest).

    Lines that recur most are broadcast (join_groups), so none is a hot task. Rows are put together again by a number
    that is given before and only used once; their other columns travel with the first line.
    """
    own = [c for c in docs.columns if c != "__sheaf_host"]
    rows = docs.select(F.monotonically_increasing_id().alias("__sheaf_row"), "__sheaf_host", F.struct(*(F.col(f"`{c}`") for c in own)).alias("__sheaf_own"))
    lines = rows.select("__sheaf_row", F.col("__sheaf_host").alias("host"), "__sheaf_own", F.posexplode(F.coalesce(F.split(F.col("__sheaf_own")["text"], "\n"), F.array(F.lit("")))).alias("i", "line"))
    bare = F.btrim("line", F.lit(BLANKS))
    # Written once: both parts of join_groups read the same numbers.
    apart = checkpoint(lines.select("__sheaf_row", "host", F.when(F.col("i") == 0, F.col("__sheaf_own")).alias("__sheaf_own"), "i", "line", _digest(bare)["h"].alias("h"), _digest(bare)["g"].alias("g")))
    judged = join_groups(apart, found.withColumn("bad", F.lit(True)), ["host", "h", "g"], BROADCAST_LINES, how="left")
    kept = F.sort_array(F.collect_list(F.when(F.col("bad").isNull(), F.struct("i", "line"))))
    together = judged.groupBy("__sheaf_row").agg(F.first("__sheaf_own", ignorenulls=True).alias("__sheaf_own"), F.transform(kept, lambda x: x["line"]).alias("__sheaf_kept"))
    return together.select("__sheaf_own.*", F.when(F.col("__sheaf_own")["text"].isNotNull(), F.col("__sheaf_kept")).alias("__sheaf_kept"))
