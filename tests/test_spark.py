"""Operators on DataFrames: expressions against their Python twins, documents end to end, the data source, streams, queries."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sheaf.functions import codecs, numeric, scalar
from sheaf.operators import documents as D
from sheaf.operators import relational as R
from sheaf.operators.author import expected_text
from sheaf.sources import pdf
from sheaf.sources.syntax import format_real, parse_number

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_numbers_as_columns(spark):
    words = ["1", "-2.5", "+7", "4.", ".5", "1e5", "", "-", "99999999999999999999"]
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", scalar.parse_number(F.col("w")).alias("n")).collect()
    for row in found:
        want = parse_number(row["w"].encode())
        assert (row["n"] is None) == (want is None) and (want is None or (row["n"]["int"] if isinstance(want, int) else row["n"]["real"]) == want)
    reals = [0.0, 3.0, -2.5, 0.1, 123456.789, 1e-9, 1 / 3]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in reals], "x double").select(scalar.format_real(F.col("x"))).collect()] == [format_real(x) for x in reals]


@pytest.mark.parametrize("source", [b"{ add }", b"{ exch sub abs sqrt }", b"{ 2 copy gt { pop } { exch pop } ifelse }", b"{ 0 div exch 3 mod add }", b"{ dup 0 lt { neg } if mul 5 idiv }", b"{ 1 2 roll atan }", b"{ cvi exch truncate add floor }", b"{ round exch ceiling 2 bitshift add }", b"{ 3 exp exch ln add }"])
def test_compiled_calculator_equals_interpreter(spark, source):
    points = [(a / 2, b / 3) for a in range(-5, 6) for b in range(-4, 5)]
    program, domain, out = numeric.parse_program(source), [-10.0, 10.0] * 2, [-1000.0, 1000.0]
    plain = numeric.calculator(program, domain, out)
    frame = spark.createDataFrame(points, "a double, b double")
    for row in frame.select("a", "b", numeric.calculator_column(program, [F.col("a"), F.col("b")], domain, out)[0].alias("y")).collect():
        assert row["y"] == pytest.approx(plain([row["a"], row["b"]])[0], abs=1e-9)


def test_codec_columns(spark):
    frame = spark.createDataFrame([(bytearray(b"hello"),), (None,), (bytearray(b""),)], "b binary")
    chain = [("A85", {}), ("Fl", {})]
    packed = frame.select("b", codecs.encoded(F.col("b"), chain)["bytes"].alias("p"))
    assert all(r["b"] == r["x"] for r in packed.select("b", codecs.decoded(F.col("p"), chain)["bytes"].alias("x")).collect())
    assert frame.select(codecs.decoded(F.lit(b"xyz"), [("Fl", {})])["error"]).distinct().collect()[0][0] == "filter"


def test_documents_end_to_end(spark):
    texts = [(1, "a few words\nand more"), (2, ""), (3, None), (4, "long " * 3000)]
    docs = D.author_documents(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: r["error"] for r in docs.collect()} == {1: None, 2: None, 3: "empty", 4: None}
    found = {}
    for r in D.page_texts_of(docs.where("error is null")).collect():
        found.setdefault(r["doc_id"], []).append((r["page_no"], r["text"]))
    assert {k: [t for _, t in sorted(v)] for k, v in found.items()} == {k: expected_text(t) for k, t in texts if t is not None}
    bad = spark.createDataFrame([(9, bytearray(b"not a document")), (8, None)], "doc_id long, content binary")
    assert rows(D.pages_of(bad).select("doc_id", "error")) == [(8, "empty"), (9, "malformed")]


def test_files_and_source(spark, tmp_path):
    docs = D.author_documents(spark.createDataFrame([("a", "first words"), ("b/c", "second")], "doc_id string, text string"))
    pdf.register(spark)
    target = str(tmp_path / "out")
    pdf.write_files(docs, target)
    assert len(os.listdir(target)) == 2 and "a.pdf" in os.listdir(target)
    (tmp_path / "out" / "broken.pdf").write_bytes(b"nothing")
    assert pdf.read_files(spark, target).count() == 3
    found = spark.read.format("pdf").load(target)
    assert {(r["text"], r["error"]) for r in found.collect()} == {("first words", None), ("second", None), (None, "malformed")}
    assert [r["text"] for r in found.where(F.col("path") == f"{target}/a.pdf").where("page_no = 0").collect()] == ["first words"]
    assert spark.read.format("pdf").option("table", "objects").load(f"{target}/a.pdf").where("kind = 'stream'").count() == 1


def test_written_rows_are_not_lost(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    os.makedirs(target)
    (tmp_path / "out" / "1.pdf").write_bytes(b"stood here before")
    docs = D.author_documents(spark.createDataFrame([("1", "first"), ("1", "second"), ("2", "third"), ("2", "third")], "doc_id string, text string"))
    pdf.register(spark)
    pdf.write_files(docs.repartition(4), target)
    assert sorted(os.listdir(target)) == ["1.pdf", "1~2.pdf", "1~3.pdf", "2.pdf", "2~2.pdf"]
    found = sorted(str(r["text"]) for r in spark.read.format("pdf").load(target).collect())
    assert found == ["None", "first", "second", "third", "third"] and (tmp_path / "out" / "1.pdf").read_bytes() == b"stood here before"
    failing = docs.withColumn("content", F.when(F.col("doc_id") == "2", F.expr("raise_error('no')")).otherwise(F.col("content")))
    with pytest.raises(Exception):
        pdf.write_files(failing, target)
    assert sorted(os.listdir(target)) == ["1.pdf", "1~2.pdf", "1~3.pdf", "2.pdf", "2~2.pdf"]
    docs.select("doc_id", "content").limit(1).write.format("pdf").mode("overwrite").save(target)
    assert os.listdir(target) == ["1.pdf"]


def test_large_files_are_a_row_with_a_code(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 " + b"x" * 500)
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    monkeypatch.setattr(pdf, "MAX_FILE", 100)
    found = {r["doc_id"][-5:]: r["error"] for r in D.pages_of(pdf.read_files(spark, str(tmp_path))).collect()}
    assert found["a.pdf"] == "limit" and found["b.pdf"] not in (None, "limit")


def test_counting_partitions_runs_nothing(spark):
    from sheaf.session import spread

    tracker, docs = spark.sparkContext.statusTracker(), spark.read.parquet(f"{SF}/documents.parquet")
    spark.sparkContext.setJobGroup("spread", "none of these may run")
    shuffled = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    joined = shuffled.join(spark.range(7), F.col("k") == F.col("id"))
    assert spread(shuffled) is shuffled and spread(joined) is joined and spread(spark.range(9).coalesce(1).select("id")) is not None
    wide = spread(docs.select("text"))
    assert list(tracker.getJobIdsForGroup("spread")) == []
    spark.sparkContext.setJobGroup("", "")
    assert wide.rdd.getNumPartitions() >= 4


def test_malformed_documents_are_rows(spark):
    from sheaf.functions import crypto
    from sheaf.operators.author import document_of
    from sheaf.sources.syntax import Fault

    sealed = document_of("secret words").save(crypto.protect("aes128", "u", "o"))
    broken = [sealed.replace(b"/R 4", b"/R /X"), sealed.replace(b"/V 4", b"/V (4)"), sealed.replace(b"/P -4", b"/P 1e9999"), sealed.replace(b"/O (", b"/O 7 (")]
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([*broken, sealed])], "doc_id long, content binary")
    found = {r["doc_id"]: (r["text"], r["error"]) for r in D.page_texts_of(frame, password="u").collect()}
    assert found[4] == ("secret words", None) and found[0] == (None, "crypto") and all(e for i, (_, e) in found.items() if i < 4)

    def fails(data):
        yield (1,)
        raise {0: TypeError, 1: MemoryError, 2: RecursionError}.get(len(data), Fault)(*(["own", "message"] if len(data) > 2 else []))

    bad = spark.createDataFrame([(i, bytearray(b"x" * i)) for i in range(4)], "doc_id long, content binary")
    assert rows(D.per_document(bad, fails, "n int").where("error is not null")) == [(0, None, "internal"), (1, None, "limit"), (2, None, "limit"), (3, None, "own")]


def test_names_at_any_depth(spark):
    chain = [(0, i, i - 1 if i else None, f"p{i}") for i in range(300)] + [(1, 1, 2, "a"), (1, 2, 1, "b"), (1, 3, 9, "c"), (1, 4, 3, None), (1, 5, 4, "d")]
    found = {(r["doc_id"], r["node"]): r["name"] for r in R.qualified_names(spark.createDataFrame(chain, "doc_id int, node int, parent int, part string")).collect()}
    assert len(found) == 305 and all(found[0, i] == ".".join(f"p{j}" for j in range(i + 1)) for i in range(300))
    assert [found[1, i] for i in range(1, 6)] == [None, None, "c", "c", "c.d"]


def test_streamed_files(spark, tmp_path):
    from sheaf.streaming import streams

    docs = D.author_documents(spark.createDataFrame([("a", "same"), ("b", "same"), ("c", "other")], "doc_id string, text string"))
    pdf.register(spark)
    pdf.write_files(docs, str(tmp_path / "in"))
    out = streams.drained(streams.arriving_texts(pdf.stream_files(spark, str(tmp_path / "in"))), "append")
    assert sorted(r["text"] for r in out.collect()) == ["other", "same"]


def test_closure_and_trees(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 9, 8), (1, 1, 5)], "doc_id int, src int, dst int")
    roots = spark.createDataFrame([(0, 1), (1, 1)], "doc_id int, node int")
    assert rows(R.closure(edges, roots)) == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 5)]
    nodes = spark.createDataFrame([(0, 1, [2, 5]), (0, 2, [3, 4, 1]), (0, 3, None), (0, 4, None), (0, 5, None)], "doc_id int, node int, kids array<int>")
    assert [(r["node"], r["page_no"]) for r in R.page_leaves(nodes, spark.createDataFrame([(0, 1)], "doc_id int, node int")).orderBy("page_no").collect()] == [(3, 0), (4, 1), (5, 2)]
    tree = spark.createDataFrame([(0, 1, None, "a", "A"), (0, 2, 1, None, None), (0, 3, 2, "c", None), (0, 4, 2, "d", "D")], "doc_id int, node int, parent int, part string, value string")
    assert rows(R.inherited(tree, "value")) == [(0, 1, "A"), (0, 2, "A"), (0, 3, "A"), (0, 4, "D")]
    assert rows(R.qualified_names(tree)) == [(0, 1, "a"), (0, 2, "a"), (0, 3, "a.c"), (0, 4, "a.d")]


def test_page_sets(spark):
    pages = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, "x")], "doc_id int, page_no long, t string")
    wrong = spark.createDataFrame([(0, 0, 2), (0, 1, 0), (0, 2, 1), (1, 0, 5)], "doc_id int, page_no long, new_no int")
    assert [(r["doc_id"], r["page_no"], r["t"]) for r in R.reorder_pages(pages, wrong).orderBy("page_no").collect()] == [(0, 0, "b"), (0, 1, "c"), (0, 2, "a")]
    numbered = R.renumber(spark.range(1000, 0, -7), [], ["id"]).orderBy("id").collect()
    assert [r["new"] for r in numbered] == list(range(1, len(numbered) + 1))


def test_region_joins_are_equi_joins(spark):
    points = spark.createDataFrame([(0, 1.0, 1.0), (0, 5.0, 5.0), (1, 1.0, 1.0)], "k int, x double, y double")
    regions = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    hit = R.hits(points, regions, ["k"])
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(hit) == [(0, 1.0, 1.0)] and hit.count() + R.hits(points, regions, ["k"], survive=True).count() == 3


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["doc_id", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["jn04_region_hits", "ag05_newest_wins", "wn07_consecutive_runs", "fn35_calculator_compiled", "st08_change_log", "mu08_fill_fields"])
def test_queries_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("customer", "documents", "events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name]).to_arrow_table().select(found.columns).to_pylist()
    assert sorted(map(repr, (tuple(r.values()) for r in want))) == sorted(map(repr, map(tuple, found.collect())))


def test_row_queries_against_duckdb(spark):
    """Each query over part's rows, on some of them: all rows go through the same code."""
    import duckdb

    from sheaf.plans import core, rows
    from sheaf.plans.registry import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    names = [n for n in QUERIES if QUERIES[n].__module__ == "sheaf.plans.registry" and ORACLES.get(n, "").startswith("SELECT p_partkey, ") and ORACLES[n].endswith(" FROM part")]
    assert len(names) > 90 and core and rows
    for name in names:
        found = QUERIES[name](spark, SF)
        want = con.execute(ORACLES[name]).to_arrow_table().select(found.columns).to_pylist()
        assert sorted(map(repr, (tuple(r.values()) for r in want))) == sorted(map(repr, map(tuple, found.collect()))), name


def test_equal_numbers_take_the_first_row(spark, tmp_path):
    """As the SQL does on one thread; rows without a value don't count."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    path = str(tmp_path / "lineitem.parquet")
    con.execute(f"COPY (SELECT i % 50 AS l_partkey, CASE WHEN i % 3 > 0 AND i % 50 <> 7 THEN 9000 - i END AS l_suppkey, i % 4 AS l_orderkey, CAST(CASE WHEN i % 11 > 0 THEN i % 2 END AS INTEGER) AS l_linenumber FROM range(9000) t(i)) TO '{path}'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    found = entry.queries()["src09_section_merge"](spark, str(tmp_path))
    assert rows(found) == sorted(con.execute(entry.oracle_sql()["src09_section_merge"]).fetchall(), key=repr)


def test_streams_drain_into_files(spark, tmp_path):
    """Nothing of a result is held by the driver: its plan reads files, in which a later batch adds to or replaces the earlier."""
    from sheaf.streaming import streams

    events = spark.createDataFrame([(i % 7, float(i)) for i in range(100)], "user_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("value") * 5000))
    for k in range(3):
        events.where(F.col("value") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    whole = streams.drained(stream.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    assert "FileScan parquet" in whole._jdf.queryExecution().executedPlan().toString()
    assert rows(whole) == rows(events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    assert rows(streams.drained(stream, "append")) == rows(events)
    found = streams.drained(streams.sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in/*"))))
    assert found.count() == 100 and rows(found.groupBy("user_id").agg(F.sum("n"))) == rows(events.groupBy("user_id").agg(F.count("*")))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store
    (tmp_path / "none").mkdir()
    empty = streams.drained(spark.readStream.schema(events.schema).parquet(str(tmp_path / "none")), "append")
    assert empty.columns == events.columns and empty.count() == 0


@pytest.mark.parametrize("name", ["st02_extract_documents", "mu06_remove_annotation", "mu10_flatten"])
def test_documents_are_made_once(spark, name, monkeypatch):
    """Edits that differ by row take one pass: none over the texts for each of them."""
    from sheaf.plans import documents

    monkeypatch.setattr(documents, "checkpoint", lambda df: df.select("doc_id", "content"))
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    reads = {"st02_extract_documents": 1, "mu06_remove_annotation": 1, "mu10_flatten": 2}[name]  # mu10 reads a checkpoint twice
    assert plan.count("documents.parquet") + plan.count("Relation [") == reads, plan


def test_text_runs_are_the_glyphs_text(spark):
    """Of redacted documents and of pages that have to be taken glyph by glyph."""
    from sheaf.operators import redact
    from sheaf.sources.syntax import Ref, Stream

    def redacted(document):
        for page in document.page_refs():
            redact.mark(document, page, [60.0, 600.0, 200.0, 740.0])
        return redact.apply_all(document)

    def tilted(document):
        for page in document.page_refs():
            contents = document.dictionary(page)["Contents"]
            document.set(Ref(contents.number, 0), Stream({}, document.content(document.dictionary(page)).replace(b"Tf", b"Tf 1 0.1 0 1 0 0 cm")))

    docs = D.author_documents(spark.createDataFrame([(i, f"a few (words) \u00e4 {i} " * 90 * i) for i in range(4)], "doc_id long, text string"))
    for edit in (redacted, tilted):
        edited = D.edit_documents(docs, edit)
        glyphs = D.glyphs_of(edited).groupBy("doc_id", "page_no", "run_seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_seq", "unicode"))), lambda g: g["unicode"]), "").alias("text"))
        assert rows(D.text_runs_of(edited).where("text is not null").select("doc_id", "page_no", "run_seq", "text")) == rows(glyphs.where("run_seq is not null"))
