"""Queries of the relational operators, over the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import relational as R
from sheaf.plans.registry import query

_BOXES = "(SELECT 'A' AS l_returnflag, 5.0 AS x0, 1000.0 AS y0, 20.0 AS x1, 30000.0 AS y1 UNION ALL SELECT 'A', 30.0, 0.0, 31.0, 90000.0 UNION ALL SELECT 'N', 0.0, 20000.0, 50.0, 40000.0)"


def _regions(df):
    rows = [("A", 5.0, 1000.0, 20.0, 30000.0), ("A", 30.0, 0.0, 31.0, 90000.0), ("N", 0.0, 20000.0, 50.0, 40000.0)]
    return df.sparkSession.createDataFrame(rows, "l_returnflag string, x0 double, y0 double, x1 double, y1 double")


# -- joins --------------------------------------------------------------------------------------------


@query("jn01_resolve", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey + 1")
def _resolve(t):
    refs = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + 1).alias("ref"))
    objects = t("orders").select(F.col("o_orderkey").alias("ref"), "o_totalprice")
    return R.resolve(refs, objects, ["ref"]).drop("ref")


@query("jn02_resources", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _resources(t):
    # Both tables of names are of fixed size; Catalyst broadcasts them by their measured size.
    names = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


def _tree(t):
    """Regions, nations and customers as one tree of three levels; doc_id is the region."""
    region = t("region").select(F.col("r_regionkey").alias("doc_id"), (-F.col("r_regionkey") - 1).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("part"), F.col("r_name").alias("value"))
    nation = t("nation").select(F.col("n_regionkey").alias("doc_id"), (-F.col("n_nationkey") - 100).cast("long").alias("node"), (-F.col("n_regionkey") - 1).cast("long").alias("parent"), F.col("n_name").alias("part"), F.when(F.length("n_name") % 2 == 0, F.col("n_name")).alias("value"))
    customer = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc_id"), F.col("c_custkey").alias("node"), (-F.col("c_nationkey") - 100).cast("long").alias("parent"), F.col("c_name").alias("part"), F.when(F.col("c_acctbal") < 0, F.col("c_name")).alias("value"))
    return region.unionByName(nation).unionByName(customer)


@query("jn03_inherited", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN c_name END, CASE WHEN length(n_name) % 2 = 0 THEN n_name END, r_name) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _inherited(t):
    return R.inherited(_tree(t), "value").where("node >= 0").select(F.col("node").alias("c_custkey"), "value")


@query("prj14_qualified_names", "SELECT c_custkey, r_name || '.' || n_name || '.' || c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _qualified_names(t):
    return R.qualified_names(_tree(t)).where("node >= 0").select(F.col("node").alias("c_custkey"), "name")


@query("src24_page_leaves", "SELECT c_custkey, n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) - 1 AS INTEGER) AS page_no FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _page_leaves(t):
    tree = _tree(t)
    kids = tree.where("parent is not null").groupBy("doc_id", F.col("parent").alias("node")).agg(F.sort_array(F.collect_list(F.struct((F.when(F.col("node") < 0, -F.col("node")).otherwise(F.col("node"))).alias("k"), "node"))).alias("k")).select("doc_id", "node", F.transform("k", lambda x: x["node"]).alias("kids"))
    nodes = tree.select("doc_id", "node").join(kids, ["doc_id", "node"], "left")
    leaves = R.page_leaves(nodes, tree.where("parent is null").select("doc_id", "node")).where("node >= 0")
    numbered = leaves.withColumn("page_no", F.row_number().over(R.Window.partitionBy("doc_id").orderBy("page_no")) - 1)
    return numbered.select(F.col("node").alias("c_custkey"), F.col("doc_id").alias("n_regionkey"), "page_no")


_POINTS = ("l_orderkey", "l_linenumber")


@query("jn04_region_hits", f"SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM {_BOXES} r WHERE r.l_returnflag = l.l_returnflag AND l_quantity BETWEEN x0 AND x1 AND l_extendedprice BETWEEN y0 AND y1)")
def _region_hits(t):
    return R.hits(t("lineitem"), _regions(t("lineitem")), ["l_returnflag"], "l_quantity", "l_extendedprice").select(*_POINTS)


@query("jn05_survivors", f"SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM {_BOXES} r WHERE r.l_returnflag = l.l_returnflag AND l_quantity BETWEEN x0 AND x1 AND l_extendedprice BETWEEN y0 AND y1)")
def _survivors(t):
    return R.hits(t("lineitem"), _regions(t("lineitem")), ["l_returnflag"], "l_quantity", "l_extendedprice", survive=True).select(*_POINTS)


@query("jn06_overlapping", f"SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM {_BOXES} r WHERE r.l_returnflag = l.l_returnflag AND l_quantity <= x1 AND x0 <= l_quantity + 2 AND l_extendedprice <= y1 AND y0 <= l_extendedprice + 500)")
def _overlapping(t):
    boxes = t("lineitem").select(*_POINTS, "l_returnflag", F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"), (F.col("l_quantity") + 2).alias("x1"), (F.col("l_extendedprice") + 500).alias("y1"))
    return R.overlapping(boxes, _regions(boxes), ["l_returnflag"]).select(*_POINTS)


@query("jn07_range_lookup", """
    WITH r AS (SELECT p_partkey AS low, p_partkey + p_size - 1 AS high, p_brand AS value FROM part), c AS (SELECT DISTINCT l_partkey AS code FROM lineitem)
    SELECT code, low, value FROM (SELECT code, low, value, row_number() OVER (PARTITION BY code ORDER BY low <> high, low) AS n FROM c LEFT JOIN r ON code BETWEEN low AND high) WHERE n = 1""")
def _range_lookup(t):
    ranges = t("part").select(F.col("p_partkey").alias("low"), (F.col("p_partkey") + F.col("p_size") - 1).alias("high"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("seq"))
    return R.range_lookup(t("lineitem").select(F.col("l_partkey").alias("code")).distinct(), ranges)


@query("jn09_remap", "WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS new FROM customer) SELECT o_orderkey, new AS o_custkey FROM orders JOIN n ON o_custkey = c_custkey")
def _remap(t):
    names = R.renumber(t("customer").select("c_custkey", "c_mktsegment"), [], ["c_mktsegment", "c_custkey"]).select(F.col("c_custkey").alias("old"), "new")
    return R.remap(t("orders").select("o_orderkey", "o_custkey"), names, "o_custkey")


@query("jn10_containing_page", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_custkey END, p.l_suppkey) AS page FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey) p ON l_orderkey = o_orderkey")
def _containing_page(t):
    listed = R.newest_value(t("lineitem"), ["l_orderkey"], "l_suppkey", "l_suppkey")
    named = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))
    return t("orders").join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce(named, F.col("l_suppkey")).alias("page"))


# -- aggregations -------------------------------------------------------------------------------------


@query("ag01_union_boxes", "SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_extendedprice) AS x1, max(l_tax) AS y1 FROM lineitem GROUP BY l_orderkey")
def _union_boxes(t):
    return R.union_boxes(t("lineitem"), ["l_orderkey"], "l_quantity", "l_discount", "l_extendedprice", "l_tax")


@query("ag02_joined_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _joined_text(t):
    return R.joined_text(t("conversations"), ["conv_id"], ["turn"], "text", "\n")


@query("ag03_region_bounds", "SELECT l_returnflag, l_linestatus, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY ALL")
def _region_bounds(t):
    return R.union_boxes(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice", "l_quantity", "l_extendedprice")


@query("ag05_newest_wins", "SELECT o_custkey, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderstatus, max({'d': o_orderdate, 'k': o_orderkey}).k AS o_orderkey FROM orders GROUP BY o_custkey")
def _newest_wins(t):
    orders = t("orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return R.newest(orders, ["o_custkey"], -F.col("at"), -F.col("o_orderkey")).drop("at")


@query("src09_section_merge", "SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def _section_merge(t):
    """Of rows of equal numbers the one that stands first in the files, which the SQL leaves open and DuckDB takes on one thread."""
    lines = t("lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return R.newest_value(lines, ["l_partkey"], "l_suppkey", "seq", ties=["file", "row"])


@query("ag06_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _last_wins(t):
    return R.newest_value(t("events"), ["user_id"], "event_type", "event_id", last=True)


@query("ag07_removed_text", "SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS removed FROM events WHERE value > 0 GROUP BY user_id")
def _removed_text(t):
    return R.joined_text(t("events").where("value > 0"), ["user_id"], ["event_id"], "event_type", "", "removed")


@query("ag08_reachable", """
    WITH roots AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders JOIN roots ON o_custkey = c_custkey), p AS (SELECT DISTINCT l_partkey FROM lineitem JOIN o ON l_orderkey = o_orderkey)
    SELECT 'c' AS kind, c_custkey AS id FROM roots UNION ALL SELECT 'o', o_orderkey FROM o UNION ALL SELECT 'p', l_partkey FROM p""")
def _reachable(t):
    node = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    edges = t("orders").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst")).unionByName(t("lineitem").select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst"))).withColumn("doc_id", F.lit(0))
    roots = t("customer").where("c_acctbal < 0").select(F.lit(0).alias("doc_id"), node("c", "c_custkey").alias("node"))
    found = R.closure(edges, roots)
    return found.select(F.substring("node", 1, 1).alias("kind"), F.substring("node", F.lit(2), F.length("node")).cast("long").alias("id"))


@query("ag09_placements", "SELECT l_suppkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS first_seq, string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ',' ORDER BY l_orderkey * 10 + l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS quantities FROM lineitem GROUP BY ALL")
def _placements(t):
    rows = t("lineitem").select("l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("int").cast("string").alias("q"))
    return R.placements(rows, ["l_suppkey", "l_returnflag"], "seq", "q").select("l_suppkey", "l_returnflag", "first_seq", F.array_join("values", ",").alias("quantities"))


@query("ag10_highest_number", "SELECT o_orderpriority, max(o_orderkey) + 1 AS size FROM orders GROUP BY o_orderpriority")
def _highest_number(t):
    return t("orders").groupBy("o_orderpriority").agg((F.max("o_orderkey") + 1).alias("size"))


# -- windows ------------------------------------------------------------------------------------------


@query("wn01_char_width", "SELECT event_id, round(coalesce(sqrt(power(lead(event_id) OVER w - event_id, 2) + power(lead(value) OVER w - value, 2)), 0.5 * value), 6) AS width FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _char_width(t):
    return R.next_distance(t("events").withColumn("x", F.col("event_id").cast("double")), ["user_id"], ["event_id"], "x", "value", 0.5 * F.col("value")).select("event_id", F.round("width", 6).alias("width"))


_SECONDS = "epoch_us(ts) / 1000000.0"


def _timed(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    return t("events").select("event_id", "user_id", "event_type", at.alias("start"), (at + 30.0).alias("end"))


@query("wn03_fragments", f"WITH e AS (SELECT event_id, user_id, {_SECONDS} AS s, lag({_SECONDS} + 30.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, CAST(sum(CASE WHEN before IS NULL OR s - before > 36000.0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS fragment FROM e")
def _fragments(t):
    return R.gap_islands(_timed(t), ["user_id"], ["start", "event_id"], "start", "end", F.lit(36000.0)).select("event_id", F.col("island").alias("fragment"))


@query("wn05_words", f"""
    WITH e AS (SELECT event_id, user_id, event_type, {_SECONDS} AS s FROM events),
    k AS (SELECT *, event_type <> lag(event_type) OVER w OR lag(event_type) OVER w IS NULL OR s - lag(s + 30.0) OVER w > 7200.0 AS begins FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
    i AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS word FROM k)
    SELECT user_id, CAST(word AS INTEGER) AS word, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, word""")
def _words(t):
    w = R.Window.partitionBy("user_id").orderBy("start", "event_id")
    begins = (F.col("event_type") != F.lag("event_type").over(w)) | (F.col("start") - F.lag("end").over(w) > 7200.0)
    return R.islands(_timed(t), ["user_id"], ["start", "event_id"], begins, "word").groupBy("user_id", "word").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("wn07_consecutive_runs", "SELECT min(k) AS first, count(*) AS n FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS run FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 30)) GROUP BY run")
def _consecutive_runs(t):
    return R.consecutive_runs(t("lineitem").where("l_quantity > 30"), "l_orderkey").select("first", "n")


@query("wn08_merged_runs", """
    WITH k AS (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS before FROM lineitem),
    i AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM l_returnflag THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING) AS island FROM k)
    SELECT l_orderkey, CAST(island AS INTEGER) AS island, string_agg(l_returnflag || l_linenumber, '' ORDER BY l_linenumber, l_extendedprice) AS text FROM i GROUP BY l_orderkey, island""")
def _merged_runs(t):
    w = R.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")
    before = F.lag("l_returnflag").over(w)
    flagged = R.islands(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_extendedprice"], before.isNull() | (before != F.col("l_returnflag")))
    return R.joined_text(flagged.withColumn("c", F.concat("l_returnflag", F.col("l_linenumber").cast("string"))), ["l_orderkey", "island"], ["l_linenumber", "l_extendedprice"], "c", "")


@query("wn09_text_advance", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM lineitem")
def _text_advance(t):
    return R.running(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_extendedprice"], F.col("l_quantity").cast("long"), "x", before=True).select(*_POINTS, "l_partkey", "x")


@query("wn10_stack_depth", "SELECT event_id, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM events")
def _stack_depth(t):
    step = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    return R.running(t("events"), ["user_id"], ["event_id"], step, "depth").select("event_id", "depth")


@query("wn11_renumber", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS new FROM orders")
def _renumber(t):
    return R.renumber(t("orders").select("o_orderkey"), [], ["o_orderkey"])


# -- order --------------------------------------------------------------------------------------------


@query("so01_reading_order", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity, l_linenumber) AS INTEGER) AS place FROM lineitem")
def _reading_order(t):
    rows = t("lineitem").withColumn("down", -F.col("l_extendedprice"))
    return R.renumber(rows, ["l_orderkey"], ["down", "l_quantity", "l_linenumber"], "place").select(*_POINTS, "place")


@query("so02_reference_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS place FROM lineitem")
def _reference_order(t):
    return R.renumber(t("lineitem").select(*_POINTS), [], list(_POINTS), "place")


@query("so03_key_order", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS keys FROM part GROUP BY p_brand")
def _key_order(t):
    return t("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("keys"))


@query("so05_clamped_index", "SELECT p_partkey, CAST(least(greatest(p_size - 10, 0), 25) AS INTEGER) AS place FROM part")
def _clamped_index(t):
    return t("part").select("p_partkey", F.least(F.greatest(F.col("p_size") - 10, F.lit(0)), F.lit(25)).alias("place"))


# -- page sets ----------------------------------------------------------------------------------------


def _pages(t):
    return t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "role")


@query("so04_reorder", "SELECT conv_id AS doc_id, max(turn) OVER (PARTITION BY conv_id) - turn AS page_no, role FROM conversations")
def _reorder(t):
    w = R.Window.partitionBy("doc_id")
    permutation = _pages(t).select("doc_id", "page_no", (F.max("page_no").over(w) - F.col("page_no")).alias("new_no"))
    return R.reorder_pages(_pages(t), permutation).select("doc_id", "page_no", "role")


@query("st01_merge_pages", """
    WITH m AS (SELECT conv_id AS doc_id, CASE WHEN turn < 1 THEN 0 ELSE 2 END AS k, turn, role FROM conversations UNION ALL SELECT conv_id, 1, turn, 'copy' FROM conversations WHERE role = 'assistant')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, turn) - 1 AS page_no, role FROM m""")
def _merge_pages(t):
    copies = _pages(t).where("role = 'assistant'").withColumn("role", F.lit("copy"))
    return R.merge_pages(_pages(t), copies, at=1)


@query("st02_extract_pages", "WITH w AS (SELECT conv_id AS doc_id, unnest([1, 0, 1, 99]) AS turn, unnest([0, 1, 2, 3]) AS seq FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS page_no, role FROM w JOIN conversations c ON c.conv_id = doc_id AND c.turn = w.turn")
def _extract_pages(t):
    wanted = _pages(t).select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*(F.lit(i).cast("long") for i in (1, 0, 1, 99)))).alias("seq", "page_no"))
    return R.extract_pages(_pages(t), wanted).select("doc_id", "page_no", "role")


@query("st03_remove_pages", "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page_no, role FROM conversations WHERE turn <> 1")
def _remove_pages(t):
    return R.remove_pages(_pages(t), _pages(t).where("page_no = 1")).select("doc_id", "page_no", "role")


@query("st04_insert_page", "WITH m AS (SELECT conv_id AS doc_id, turn * 2.0 AS k, role FROM conversations UNION ALL SELECT DISTINCT conv_id, 1.0, 'blank' FROM conversations) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS page_no, role FROM m")
def _insert_page(t):
    new = _pages(t).select("doc_id").distinct().select("doc_id", F.lit(1).cast("long").alias("page_no"), F.lit("blank").alias("role"))
    return R.insert_page(_pages(t), new).select("doc_id", "page_no", "role")


@query("st06_flat_kids", "SELECT conv_id AS doc_id, string_agg(role, ',' ORDER BY turn) AS kids, count(*) AS n FROM conversations GROUP BY conv_id")
def _flat_kids(t):
    return R.placements(_pages(t), ["doc_id"], "page_no", "role").select("doc_id", F.array_join("values", ",").alias("kids"), F.size("values").cast("long").alias("n"))


@query("st07_defined", "(SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def _defined(t):
    stored = t("orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    edited = t("lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    deleted = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.is_defined(stored, edited, deleted, ["o_orderkey"])


@query("st08_change_log", """
    WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS op, arg_max(value, event_id) AS value FROM events GROUP BY user_id)
    SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last) UNION ALL SELECT user_id, value FROM last WHERE op <> 'click'""")
def _change_log(t):
    changes = t("events").select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") == "click", "delete").otherwise("set").alias("op"), "event_id", F.col("value").alias("c_acctbal"))
    return R.apply_changes(t("customer").select("c_custkey", "c_acctbal"), changes, ["c_custkey"], "event_id")


@query("prj01_overlay", """
    WITH base AS (SELECT o_orderkey, o_totalprice FROM orders), edits AS (SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS o_totalprice FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey), gone AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.09)
    SELECT * FROM (SELECT * FROM edits UNION ALL SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM edits)) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM gone)""")
def _overlay(t):
    edits = t("lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"))
    gone = t("lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return R.overlay(t("orders").select("o_orderkey", "o_totalprice"), edits, gone, ["o_orderkey"])


@query("prj20_enumerate", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS highest FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def _enumerate(t):
    return t("orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("highest"))


@query("mu02_rotate", "SELECT conv_id, turn, ((turn - 3) * 90 % 360 + 360) % 360 AS rotate FROM conversations")
def _rotate(t):
    from sheaf.functions.scalar import rotation

    return t("conversations").select("conv_id", "turn", rotation((F.col("turn") - 3) * 90).alias("rotate"))


@query("mu19_scrub", "SELECT doc_id, CASE WHEN strpos(text, 'token') > 0 THEN NULL ELSE text END AS text FROM documents")
def _scrub(t):
    from sheaf.functions.scalar import contains

    return t("documents").select("doc_id", F.when(~contains(F.col("text"), F.lit("token")), F.col("text")).alias("text"))
