"""The relational operators behind document work, over any tables: merges, region joins, runs and gaps, trees, page sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import broadcast_if_small, checkpoint

#: Ancestors that an inherited value is sought among.
TREE_DEPTH = 64
#: Doublings of the way up in qualified_names: names of up to 2**NAME_DOUBLINGS parts.
NAME_DOUBLINGS = 12

# -- newest wins and change logs ----------------------------------------------------------------------


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row that comes first in order for each key. One aggregation with partial results: a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest)).select(*df.columns)


def newest_value(df: DataFrame, keys: list[str], value: str, order: str, last: bool = False, ties: list[str] = ()) -> DataFrame:
    """Of each key the value of the least order, or of the greatest; of equal orders that of the first or last ties.

    Rows without a value or an order don't count, and a key of none but these has a null.
    """
    known = F.col(value).isNotNull() & F.col(order).isNotNull()
    return df.groupBy(*keys).agg((F.max_by if last else F.min_by)(value, F.when(known, F.struct(order, *ties))).alias(value))


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base under a change log (keys, op `set` or `delete`, order, other columns): the last change of a key counts."""
    last = newest(changes, keys, -F.col(order))
    kept = base.join(last.select(*keys), keys, "left_anti")
    added = last.where("op = 'set'").select(*base.columns)
    return kept.unionByName(added)


def overlay(base: DataFrame, edits: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """Deleted before edited before stored."""
    return base.join(edits.select(*keys), keys, "left_anti").unionByName(edits).join(deleted.select(*keys), keys, "left_anti")


def dictionary(pairs: DataFrame, keys: list[str], name: str, value: str, order: str) -> DataFrame:
    """Entries of dictionaries: the last of equal names counts, and a last null removes the name."""
    last = pairs.groupBy(*keys, name).agg(F.max_by(F.struct(value), order).alias("v"))
    return last.select(*keys, name, F.col(f"v.{value}").alias(value)).where(F.col(value).isNotNull())


# -- references ---------------------------------------------------------------------------------------


def resolve(refs: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Each reference with its object, nulls where it dangles."""
    return refs.join(objects, keys, "left")


def remap(refs: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """column replaced by its new number in names (old, new); rows without one are dropped."""
    return refs.join(names, F.col(column) == F.col("old")).select(*(F.col("new").alias(c) if c == column else F.col(c) for c in refs.columns))


def renumber(df: DataFrame, group: list[str], order: list[str], name: str = "new") -> DataFrame:
    """Dense numbers from 1 in each group. Without a group, by ranges: a count for each range, no single task."""
    if group:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    within = ranged.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    # A row for each partition: no more than there are partitions.
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__part"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return within.join(F.broadcast(before), "__part").withColumn(name, (F.col("__row") + F.col("__before")).cast("long")).drop("__part", "__row", "__before")


def closure(edges: DataFrame, roots: DataFrame, checkpoint_every: int = 4) -> DataFrame:
    """(doc_id, node) reachable from roots over edges (doc_id, src, dst): a frontier that each round joins and cuts by what is known.

    A node is in one frontier only, so it ends at any depth and on cycles.
    """
    known = checkpoint(roots.select("doc_id", "node").distinct())
    frontier, rounds = known, 0
    while not frontier.isEmpty():
        step = frontier.join(edges.withColumnRenamed("src", "node"), ["doc_id", "node"]).select("doc_id", F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.join(known, ["doc_id", "node"], "left_anti"))
        known = known.unionByName(frontier)
        rounds += 1
        if rounds % checkpoint_every == 0:
            known = checkpoint(known)
    return known


def page_leaves(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Leaves of trees in order: doc_id, node, page_no. nodes: doc_id, node, kids array; roots: doc_id, node.

    Level by level with the path as the sort key; a node on its own path is passed over, so it ends at any depth.
    """
    level = roots.select("doc_id", "node", F.array(F.col("node")).alias("seen"), F.array().cast("array<int>").alias("path"))
    leaves = None
    while True:
        joined = checkpoint(level.join(nodes, ["doc_id", "node"]))
        found = joined.where("kids is null").select("doc_id", "node", "path")
        leaves = found if leaves is None else leaves.unionByName(found)
        level = joined.where("kids is not null").select("doc_id", "seen", "path", F.posexplode("kids").alias("i", "kid")).where(~F.array_contains("seen", F.col("kid"))).select("doc_id", F.col("kid").alias("node"), F.array_append("seen", F.col("kid")).alias("seen"), F.array_append("path", F.col("i")).alias("path"))
        if level.isEmpty():
            break
    return leaves.select("doc_id", "node", (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).alias("page_no"))


def inherited(nodes: DataFrame, value: str, depth: int = TREE_DEPTH) -> DataFrame:
    """doc_id, node and the value of the node or its nearest ancestor that has one. nodes: doc_id, node, parent, value."""
    up = nodes.select("doc_id", F.col("node").alias("above"), F.col("parent").alias("next"), F.col(value).alias("found"))
    now, settled = nodes.select("doc_id", "node", "parent", value), None
    for _ in range(depth):
        now = checkpoint(now)
        done = now.where(F.col(value).isNotNull() | F.col("parent").isNull()).select("doc_id", "node", value)
        settled = done if settled is None else settled.unionByName(done)
        waiting = now.where(F.col(value).isNull() & F.col("parent").isNotNull())
        if waiting.isEmpty():
            return settled
        now = waiting.join(up, (waiting["doc_id"] == up["doc_id"]) & (waiting["parent"] == up["above"]), "left").select(waiting["doc_id"], "node", F.col("next").alias("parent"), F.col("found").alias(value))
    return settled.unionByName(now.select("doc_id", "node", F.lit(None).cast(now.schema[value].dataType).alias(value)))


def qualified_names(nodes: DataFrame, doublings: int = NAME_DOUBLINGS) -> DataFrame:
    """doc_id, node, name: own names joined by dots from the root. nodes: doc_id, node, parent, part.

    Each round a node takes over the way that the ancestor it has reached knows, so its way doubles. A parent that isn't
    there ends the way as a root does. Nodes on a cycle, or of more than 2**doublings ancestors, get a null name.
    """
    known = nodes.select(F.col("doc_id").alias("d"), F.col("node").alias("there")).distinct()
    start = nodes.join(known, (F.col("doc_id") == F.col("d")) & (F.col("parent") == F.col("there")), "left")
    now = checkpoint(start.select("doc_id", "node", F.col("there").alias("above"), F.coalesce("part", F.lit("")).alias("name")))
    for _ in range(doublings):
        waiting = now.where("above is not null")
        if waiting.isEmpty():
            break
        up = now.select(F.col("doc_id").alias("d"), F.col("node").alias("reached"), F.col("above").alias("next"), F.col("name").alias("more"))
        longer = F.when(F.col("more") == "", F.col("name")).when(F.col("name") == "", F.col("more")).otherwise(F.concat_ws(".", "more", "name"))
        further = waiting.join(up, (F.col("doc_id") == F.col("d")) & (F.col("above") == F.col("reached"))).select("doc_id", "node", F.col("next").alias("above"), longer.alias("name"))
        now = checkpoint(now.where("above is null").unionByName(further))
    return now.select("doc_id", "node", F.when(F.col("above").isNull(), F.col("name")).alias("name"))


# -- regions ------------------------------------------------------------------------------------------


def hits(points: DataFrame, regions: DataFrame, keys: list[str], x: str = "x", y: str = "y", survive: bool = False) -> DataFrame:
    """Points in any region (x0, y0, x1, y1) of equal keys, edges counting; or those in none.

    The keys make it an equi-join. Few regions are broadcast, so a key that most points share is no hot task; many are
    joined by a shuffle, where the adaptive planner splits the points of a hot key.
    """
    p, r = points.alias("p"), broadcast_if_small(regions).alias("r")
    equal = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in keys]
    inside = F.col(f"p.{x}").between(F.col("r.x0"), F.col("r.x1")) & F.col(f"p.{y}").between(F.col("r.y0"), F.col("r.y1"))
    condition = inside
    for e in equal:
        condition = e & condition
    return p.join(r, condition, "left_anti" if survive else "left_semi")


def overlapping(boxes: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes that touch any region of equal keys; joined as hits() does."""
    b, r = boxes.alias("b"), broadcast_if_small(regions).alias("r")
    condition = (F.col("b.x0") <= F.col("r.x1")) & (F.col("r.x0") <= F.col("b.x1")) & (F.col("b.y0") <= F.col("r.y1")) & (F.col("r.y0") <= F.col("b.y1"))
    for k in keys:
        condition = (F.col(f"b.{k}") == F.col(f"r.{k}")) & condition
    return b.join(r, condition, "left_semi")


def range_lookup(codes: DataFrame, ranges: DataFrame, code: str = "code", bucket: int = 256) -> DataFrame:
    """The value of the first range (low, high, value, seq) that holds each code; single ones (low = high) come first.

    Ranges are cut into buckets of codes, so the join has an equality.
    """
    cut = ranges.select("low", "high", "value", "seq", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))).alias("bucket"))
    keyed = codes.select(code).distinct().withColumn("bucket", F.floor(F.col(code) / bucket))
    joined = keyed.join(cut, "bucket").where(F.col(code).between(F.col("low"), F.col("high")))
    first = joined.groupBy(code).agg(F.min_by(F.struct("low", "value"), F.struct(F.col("low") != F.col("high"), "seq")).alias("first"))
    return codes.join(first.select(code, F.col("first.low").alias("low"), F.col("first.value").alias("value")), code, "left")


# -- runs and gaps ------------------------------------------------------------------------------------


def islands(df: DataFrame, group: list[str], order: list[str], begins: Column, name: str = "island") -> DataFrame:
    """Numbers of the stretches that begin where begins (which may use lag()) is true; the first is 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    flagged = df.withColumn("__begin", F.coalesce(begins, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum("__begin").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__begin")


def gap_islands(df: DataFrame, group: list[str], order: list[str], start: str, end: str, limit: Column) -> DataFrame:
    """A stretch ends where the next start lies more than limit beyond the end before."""
    before = F.lag(end).over(Window.partitionBy(*group).orderBy(*order))
    return islands(df, group, order, before.isNull() | (F.col(start) - before > limit))


def consecutive_runs(df: DataFrame, number: str, group: list[str] = ()) -> DataFrame:
    """(first, n) of runs of consecutive numbers, over distinct numbers."""
    distinct = df.select(*group, number).distinct()
    numbered = renumber(distinct, list(group), [number], "__place")
    return numbered.groupBy(*group, (F.col(number) - F.col("__place")).alias("__run")).agg(F.min(number).alias("first"), F.count("*").alias("n")).drop("__run")


def running(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, before: bool = False) -> DataFrame:
    """The running sum, with or without the row itself."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def next_distance(df: DataFrame, group: list[str], order: list[str], x: str, y: str, otherwise: Column, name: str = "width") -> DataFrame:
    """The distance to the next point of the group, or for the last what otherwise says."""
    w = Window.partitionBy(*group).orderBy(*order)
    far = F.hypot(F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y))
    return df.withColumn(name, F.coalesce(far, otherwise))


def joined_text(df: DataFrame, group: list[str], order: list[str], text: str, separator: str, name: str = "text") -> DataFrame:
    """Texts put together in order; nulls are left out."""
    parts = F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, text))))
    return df.groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p[text]), separator).alias(name))


def union_boxes(df: DataFrame, group: list[str], x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """The box around all; zeros for none."""
    sides = [F.coalesce(f(c), F.lit(0.0)).alias(n) for f, c, n in ((F.min, x0, "x0"), (F.min, y0, "y0"), (F.max, x1, "x1"), (F.max, y1, "y1"))]
    return df.groupBy(*group).agg(*sides)


def placements(df: DataFrame, owner: list[str], seq: str, value: str) -> DataFrame:
    """All values of each owner in order, and where the owner was first seen."""
    together = F.sort_array(F.collect_list(F.struct(seq, value)))
    return df.groupBy(*owner).agg(F.min(seq).alias("first_seq"), F.transform(together, lambda p: p[value]).alias("values"))


# -- pages as sets ------------------------------------------------------------------------------------


def _renumbered(pages: DataFrame, doc: str, order: list, page: str) -> DataFrame:
    numbered = pages.withColumn("__new", (F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1).cast("long"))
    return numbered.withColumn(page, F.col("__new")).drop("__new")


def merge_pages(first: DataFrame, second: DataFrame, doc: str = "doc_id", page: str = "page_no", at: int | None = None) -> DataFrame:
    """The pages of second put into first at a place (cut to what there is), or at its end."""
    place = F.lit(1 << 40) if at is None else F.lit(max(at, 0))
    a = first.withColumn("__k", F.when(F.col(page) < place, 0).otherwise(2))
    b = second.withColumn("__k", F.lit(1))
    return _renumbered(a.unionByName(b), doc, ["__k", page], page).drop("__k")


def extract_pages(pages: DataFrame, wanted: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """The pages named by wanted (doc, page, seq), in its order and as often; those that don't exist are passed over."""
    joined = wanted.join(pages, [doc, page]).withColumn("__order", F.col("seq")).drop("seq")
    return _renumbered(joined, doc, ["__order"], page).drop("__order")


def remove_pages(pages: DataFrame, gone: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    return _renumbered(pages.join(gone.select(doc, page).distinct(), [doc, page], "left_anti"), doc, [page], page)


def insert_page(pages: DataFrame, new: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """new has a page for each document, at the place that its page column says, cut to what there is."""
    a = pages.withColumn("__k", F.col(page) * 2.0)
    b = new.withColumn("__k", F.greatest(F.col(page), F.lit(0)) * 2.0 - 1.0)
    return _renumbered(a.unionByName(b), doc, ["__k"], page).drop("__k")


def reorder_pages(pages: DataFrame, permutation: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """permutation: doc, page, new_no. Documents for which it is no bijection get no row."""
    joined = pages.select(doc, page).join(permutation, [doc, page], "full")
    counts = joined.groupBy(doc).agg(F.count("*").alias("n"), F.countDistinct("new_no").alias("d"), F.min("new_no").alias("low"), F.max("new_no").alias("high"))
    known = pages.groupBy(doc).agg(F.count("*").alias("m"))
    good = counts.join(known, doc).where("n = m and d = m and low = 0 and high = m - 1").select(doc)
    return pages.join(permutation, [doc, page]).join(good, doc, "left_semi").withColumn(page, F.col("new_no").cast("long")).drop("new_no")


def is_defined(stored: DataFrame, edited: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """(stored or edited) and not deleted."""
    return stored.select(*keys).unionByName(edited.select(*keys)).distinct().join(deleted.select(*keys).distinct(), keys, "left_anti")
