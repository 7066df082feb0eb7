"""Queries over documents: each text becomes a document, goes through an operator, and is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import crypto
from sheaf.operators import documents as D
from sheaf.operators import forms, pages, redact, text
from sheaf.plans.registry import query
from sheaf.session import checkpoint
from sheaf.sources.syntax import Ref

# A text's words parted by single blanks: what the documents read back as, page by page and line by line.
_WORDS = r"trim(regexp_replace(text, '[\x{00}-\x{20}\x{7f}-\x{a0}]+', ' ', 'g'))"
_SOLID = r"regexp_replace(text, '[\x{00}-\x{20}\x{7f}-\x{a0}]+', '', 'g')"


def _authored(t, **options):
    return D.author_documents(t("documents").select("doc_id", "text"), **options)


def _authored_as(t, edit, **options):
    """Texts laid out and edited in one pass: the document isn't written and read in between. What edit returns is the content."""
    def run(value):
        from sheaf.operators.author import document_of

        yield (edit(document_of(value, **options)),)

    return D.per_document(t("documents").select("doc_id", "text"), run, "content binary", value="text")


def _edited_by_id(docs, n, edit, password=None):
    """Each row edited by edit(doc_id % n), so that what is expected differs from row to row."""
    edits = [edit(k) for k in range(n)]
    return D.edit_documents_by_key(docs, lambda key, document: edits[(key or 0) % n](document), password)


def _words_again(pages):
    """The texts of a document's pages as words parted by single blanks."""
    parts = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), " ")
    return pages.groupBy("doc_id").agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))


@query("ct13_extract_text", f"SELECT doc_id, {_WORDS} AS text FROM documents")
def _extract_text(t):
    return _words_again(D.page_texts_of(_authored(t, compress=True)))


@query("fn17_search_documents", "SELECT doc_id, CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS BIGINT) AS n FROM documents WHERE strpos(text, 'tion') > 0")
def _search_documents(t):
    return D.matches_of(_authored(t), "tion").where("error is null").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("fn17_search_ignoring_case", "SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'tion', ''))) / 4 AS BIGINT) AS n, CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS BIGINT) AS as_written FROM documents WHERE strpos(lower(text), 'tion') > 0")
def _search_ignoring_case(t):
    found = D.matches_of(_authored(t), "TiOn", ignore_case=True).where("error is null")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "tion").alias("as_written"))


@query("wn06_words", f"SELECT doc_id, CAST(CASE WHEN length({_WORDS}) = 0 THEN 0 ELSE len(string_split({_WORDS}, ' ')) END AS BIGINT) AS n, CAST(length({_SOLID}) AS BIGINT) AS chars FROM documents")
def _words(t):
    found = D.words_of(_authored(t)).where("error is null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))
    return t("documents").select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("chars", F.lit(0)).alias("chars"))


@query("ct10_glyphs", f"SELECT doc_id, CAST(length({_SOLID}) AS BIGINT) AS n FROM documents WHERE length({_SOLID}) > 0")
def _glyphs(t):
    return D.glyphs_of(_authored(t)).where("error is null and unicode <> ' '").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("src01_summaries", f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(string_split({_WORDS}, ' ')[1:3], ' ') END AS title, CAST(CASE WHEN text IS NOT NULL THEN doc_id % 3 END AS INTEGER) AS more, CASE WHEN text IS NOT NULL THEN false END AS repaired, CASE WHEN text IS NOT NULL THEN false END AS encrypted FROM documents")
def _summaries(t):
    """Titled by their first words; pages that the root doesn't count differ by as many as were taken off its number."""
    docs = D.per_document(t("documents").select("doc_id", "text"), _titled, "content binary", value="text")
    s = D.summaries_of(_edited_by_id(docs, 3, lambda k: lambda d: d.update(d.catalog["Pages"], Count=len(d.page_refs()) - k)))
    return s.select("doc_id", "title", (F.col("leaf_pages") - F.col("declared_pages")).alias("more"), "repaired", "encrypted")


@query("prj06_pages", "SELECT doc_id, CAST(100 + doc_id % 5 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height, CAST(doc_id % 5 % 4 * 90 AS INTEGER) AS rotate FROM documents WHERE text IS NOT NULL")
def _pages(t):
    """The boxes and rotation of all pages, which are alike in a document: a width for each would be a row for each."""
    def edit(k):
        def run(document):
            for i in range(len(document.page_refs())):
                pages.set_box(document, i, "crop", [0, 0, 100 + k, 792])
                pages.rotate(document, i, k % 4 * 90)

        return run

    return D.pages_of(_edited_by_id(_authored(t), 5, edit)).where("error is null").select("doc_id", "width", "height", "rotate").distinct()


@query("src10_recovered_text", f"SELECT doc_id, {_WORDS} AS text, true AS repaired FROM documents")
def _recovered(t):
    broken = _authored(t).select("doc_id", F.expr("unhex(replace(hex(content), hex('startxref'), hex('startxxxx')))").alias("content"))
    repaired = D.summaries_of(broken).select("doc_id", "repaired")
    return _words_again(D.page_texts_of(broken)).join(repaired, "doc_id")


@query("src13_tokens", "SELECT p_partkey AS doc_id, 'integer:' || p_partkey || '|real:' || p_size || '.5|name:/N' || p_size || '|string:(' || p_name || ')|delimiter:[|keyword:obj|delimiter:]|delimiter:<<|name:/K|integer:' || p_size || '|delimiter:>>' AS tokens FROM part")
def _tokens(t):
    """All tokens of each row, in order."""
    size = F.col("p_size").cast("string")
    data = F.concat(F.col("p_partkey").cast("string"), F.lit(" "), size, F.lit(".5/N"), size, F.lit("("), F.col("p_name"), F.lit(") [obj]<</K "), size, F.lit(">> % to the end"))
    found = D.tokens_of(t("part").select(F.col("p_partkey").alias("doc_id"), F.encode(data, "UTF-8").alias("content"))).where("error is null")
    listed = F.array_sort(F.collect_list(F.struct("token_offset", F.concat_ws(":", "kind", "token").alias("x"))))
    return found.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["x"]), "|").alias("tokens"))


@query("src07_xref", "SELECT doc_id, doc_id % 3 AS added, true AS all_reachable FROM documents WHERE text IS NOT NULL")
def _xref(t):
    """Every object of a rewritten document has an entry, and a later section has those that were added."""
    def edit(k):
        def run(document):
            for _ in range(k):
                document.add({"Nobody": 1})
            return document.save_incremental()

        return run

    docs = _edited_by_id(_authored(t), 3, edit)
    entries = D.xref_of(docs).where("error is null")
    sections = entries.groupBy("doc_id").agg(F.max("section_seq").alias("last"))
    counted = entries.join(sections, "doc_id").where("entry = 'uncompressed'").groupBy("doc_id").agg(F.countDistinct("obj_num").alias("n"), F.count_if(F.col("section_seq") < F.col("last")).alias("added"))
    objects = D.objects_of(docs).groupBy("doc_id").agg(F.count("obj_num").alias("m"))
    return counted.join(objects, "doc_id").select("doc_id", "added", (F.col("n") == F.col("m")).alias("all_reachable"))


@query("prj21_references", "SELECT doc_id, doc_id % 3 AS dangling FROM documents WHERE text IS NOT NULL")
def _references(t):
    """References to what isn't there, as many as were put in."""
    def edit(k):
        def run(document):
            document.update(document.trailer["Root"], Lost=[Ref(90_000 + i, 0) for i in range(k)])
            return document.save_incremental()  # a rewrite would put null for them

        return run

    objects = D.objects_of(_edited_by_id(_authored(t), 3, edit)).where("error is null")
    edges = objects.select("doc_id", F.explode("refs").alias("obj_num"))
    known = objects.select("doc_id", "obj_num", F.lit(1).alias("known"))
    return edges.join(known, ["doc_id", "obj_num"], "left").groupBy("doc_id").agg(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("dangling"))


@query("snk02_incremental", "SELECT doc_id, CAST(doc_id % 3 * 90 + 90 AS INTEGER) AS rotate, 2 AS sections, true AS prefix FROM documents WHERE text IS NOT NULL")
def _incremental(t):
    """All pages turned, in a section behind what was there."""
    def edit(k):
        def run(document):
            for i in range(len(document.page_refs())):
                pages.rotate(document, i, k * 90 + 90)
            return document.save_incremental()

        return run

    docs = _authored(t).where("error is null")
    edited = checkpoint(_edited_by_id(docs, 3, edit))  # read more than once
    turned = D.pages_of(edited).select("doc_id", "rotate").distinct()
    sections = D.xref_of(edited).groupBy("doc_id").agg((F.max("section_seq") + 1).alias("sections"))
    same = docs.select("doc_id", F.col("content").alias("old")).join(edited, "doc_id").select("doc_id", (F.substring("content", F.lit(1), F.length("old")) == F.col("old")).alias("prefix"))
    return turned.join(sections, "doc_id").join(same, "doc_id")


@query("snk03_rewrite_collects", "SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS collected FROM documents WHERE text IS NOT NULL")
def _rewrite(t):
    """What nothing leads to is left out of a rewrite."""
    def orphans(k):
        def run(document):
            for _ in range(k):
                document.add({"Nobody": 1})
            return document.save_incremental()

        return run

    with_orphans = _edited_by_id(_authored(t).where("error is null"), 3, orphans)
    rewritten = D.edit_documents(with_orphans, lambda document: document.save())
    counts = [D.summaries_of(d).select("doc_id", F.col("n_objects").alias(n)) for d, n in ((with_orphans, "a"), (rewritten, "b"))]
    return counts[0].join(counts[1], "doc_id").select("doc_id", (F.col("a") - F.col("b")).alias("collected"))


def _encrypted(method):
    @query(f"fn68_encrypt_{method}", f"SELECT doc_id, {_WORDS} AS text FROM documents")
    def run(t):
        sealed = _authored_as(t, lambda document: document.save(crypto.protect(method, "open sesame", "the owner")), compress=True)
        return _words_again(D.page_texts_of(sealed, password="the owner"))


for _method in ("rc4_40", "rc4_128", "aes128", "aes256"):
    _encrypted(_method)


@query("fn66_wrong_password", "SELECT doc_id, CASE WHEN text IS NULL THEN 'empty' WHEN doc_id % 3 = 2 THEN 'needsPassword' END AS error FROM documents")
def _wrong_password(t):
    """The password asked for is the user's, the owner's or none of a document."""
    sealed = _edited_by_id(_authored(t, compress=True), 3, lambda k: lambda document: document.save(crypto.protect("rc4_128", *(("c", "b"), ("a", "c"), ("a", "b"))[k])))
    return D.summaries_of(sealed, password="c").select("doc_id", "error")


def _redact(document):
    """One mark on each page, with a quadrilateral for each match, well within it so that its neighbours' edges aren't touched."""
    for page in document.page_refs():
        boxes = [m[2] for m in text.page_matches(document, document.dictionary(page), "tion")]
        quads = [[x0 + 0.5, y0 - 1, x1 - 0.5, y0 - 1, x0 + 0.5, y0 + 1, x1 - 0.5, y0 + 1] for x0, y0, x1, _ in boxes]
        if quads:
            redact.mark(document, page, list(text.union_box(boxes)), fill=(), quads=quads)
    return redact.apply_all(document)


@query("mu13_redaction", f"SELECT doc_id, CAST(length({_SOLID}) - (length(text) - length(replace(text, 'tion', ''))) AS BIGINT) AS chars, false AS still_there FROM documents")
def _redaction(t):
    """The marked words are gone, all other characters are left."""
    done = checkpoint(_authored_as(t, _redact))  # read more than once
    glyphs = D.text_runs_of(done).groupBy("doc_id").agg(F.sum(F.char_length(F.replace("text", F.lit(" "), F.lit("")))).alias("chars"))
    bytes_left = done.select("doc_id", (F.position(F.lit(b"tion"), F.col("content")) > 0).alias("still_there"))
    return bytes_left.join(glyphs, "doc_id", "left").select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), "still_there")


@query("snk04_residue", "SELECT doc_id, CASE WHEN strpos(text, 'tion') > 0 THEN 'residue' END AS error FROM documents")
def _residue(t):
    """A null text is a document without words."""
    texts = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return D.edit_documents(D.author_documents(texts, compress=True), lambda document: document.save_sanitized([b"tion"])).select("doc_id", "error")


def _with_marks(document, offset=0):
    page = document.page_refs()[0]
    for i, kind in enumerate(forms.SUBTYPES):
        forms.add_annotation(document, page, kind, [100.0 + i + offset, 100.0, 200.0, 150.0], [1.0, 0.0, 0.0], "note", points=[100, 100, 200, 150], strokes=[[100, 100, 120, 120]], uri="http://example.org", name="Draft")


@query("mu04_annotations", "SELECT subtype, drawn, count(*) AS n FROM (SELECT unnest(['Text', 'Link', 'Highlight', 'Underline', 'Squiggly', 'StrikeOut', 'Square', 'Circle', 'Line', 'Ink', 'FreeText', 'Stamp', 'Redact']) AS subtype FROM documents) JOIN (SELECT unnest(['Text', 'Link', 'Highlight', 'Underline', 'Squiggly', 'StrikeOut', 'Square', 'Circle', 'Line', 'Ink', 'FreeText', 'Stamp', 'Redact']) AS subtype, unnest([false, false, true, true, true, true, true, true, true, true, true, false, false]) AS drawn) USING (subtype) GROUP BY ALL")
def _annotations(t):
    return D.annotations_of(D.edit_documents(_authored(t), _with_marks)).groupBy("subtype", "drawn").agg(F.count("*").alias("n"))


@query("mu06_remove_annotation", "SELECT doc_id, 13 - doc_id % 4 AS n FROM documents WHERE text IS NOT NULL")
def _remove_annotation(t):
    def remove_some(k):
        def run(document):
            page = document.page_refs()[0]
            for _ in range(k):
                forms.remove_annotation(document, page, forms.annotation_refs(document, page)[0])

        return run

    edited = _edited_by_id(D.edit_documents(_authored(t), _with_marks), 4, remove_some)
    return D.annotations_of(edited).where("error is null").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("prj11_redaction_regions", "SELECT doc_id, 0 AS page_no, CAST(112 + doc_id % 3 AS DOUBLE) AS x0, 100.0::DOUBLE AS y0, 200.0::DOUBLE AS x1, 150.0::DOUBLE AS y1 FROM documents WHERE text IS NOT NULL")
def _redaction_regions(t):
    marked = _edited_by_id(_authored(t), 3, lambda k: lambda document: _with_marks(document, k))
    return D.redaction_regions_of(marked).where("error is null").select("doc_id", "page_no", "x0", "y0", "x1", "y1")


def _with_form(document):
    page = document.page_refs()[0]
    forms.add_field(document, page, "name", [100.0, 20.0, 300.0, 34.0], value="before")
    forms.add_field(document, page, "agree", [320.0, 20.0, 334.0, 34.0], "Btn", states=("Yes",))


def _fill(document):
    forms.set_value(document, forms.field_named(document, "name"), "after")
    forms.set_value(document, forms.field_named(document, "agree"), "Yes")


@query("mu08_fill_fields", "SELECT doc_id, unnest(['name', 'agree']) AS name, unnest(['Tx', 'Btn']) AS kind, unnest(['after', 'Yes']) AS value FROM documents")
def _fill_fields(t):
    filled = D.edit_documents(D.edit_documents(_authored(t), _with_form), _fill)
    return D.fields_of(filled).select("doc_id", "name", "kind", "value")


@query("mu10_flatten", r"SELECT doc_id, CAST(0 AS BIGINT) AS fields, 'after' || doc_id % 3 AS shown FROM documents WHERE text IS NOT NULL")
def _flatten(t):
    """No field is left, and its value is part of some page's text."""
    def flat(k):
        def run(document):
            forms.set_value(document, forms.field_named(document, "name"), f"after{k}")
            forms.flatten(document)

        return run

    done = checkpoint(_edited_by_id(D.edit_documents(_authored(t), _with_form), 3, flat).where("error is null"))  # read more than once
    left = D.fields_of(done).groupBy("doc_id").agg(F.count("name").alias("fields"))
    shown = D.page_texts_of(done).groupBy("doc_id").agg(F.max(F.regexp_extract("text", r"after\d", 0)).alias("shown"))
    return shown.join(left, "doc_id", "left").select("doc_id", F.coalesce("fields", F.lit(0)).alias("fields"), "shown")


@query("mu01_page_edits", "SELECT doc_id, CAST(1 + doc_id % 3 AS INTEGER) AS difference, CAST(270 - doc_id % 3 * 90 AS INTEGER) AS rotate, '' AS first_text, CAST(100 + doc_id % 3 AS DOUBLE) AS first_width FROM documents WHERE text IS NOT NULL")
def _page_edits(t):
    """Blank pages in front, the last page turned, then all in reverse and back."""
    def edit(k):
        def run(document):
            for _ in range(k + 1):
                pages.insert_blank(document, 0)
            n = len(document.page_refs()) - 1
            pages.rotate(document, n, -90 * (k + 1))
            pages.reorder(document, list(range(n, -1, -1)))
            pages.reorder(document, list(range(n, -1, -1)))
            pages.set_box(document, 0, "crop", [0, 0, 100 + k, 100])

        return run

    docs = _authored(t).where("error is null")
    edited = checkpoint(_edited_by_id(docs, 3, edit))  # read more than once
    last = D.pages_of(edited).groupBy("doc_id").agg(F.max_by("rotate", "page_no").alias("rotate"), F.count("*").alias("n"), F.min_by("width", "page_no").alias("first_width"))
    first = D.page_texts_of(edited).groupBy("doc_id").agg(F.min_by("text", "page_no").alias("first_text"))
    before = D.pages_of(docs).groupBy("doc_id").agg(F.count("*").alias("m"))
    return last.join(before, "doc_id").join(first, "doc_id").select("doc_id", (F.col("n") - F.col("m")).cast("int").alias("difference"), "rotate", "first_text", "first_width")


@query("st02_extract_documents", "SELECT doc_id, 1 + doc_id % 3 AS n, true AS same FROM documents WHERE text IS NOT NULL")
def _extract_documents(t):
    """The first page several times, in a document of its own."""
    out = _edited_by_id(_authored(t), 3, lambda k: lambda document: pages.extract(document, [0] * (k + 1)).save())
    return D.page_texts_of(out).where("error is null").groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("text") == F.max("text")).alias("same"))


@query("st01_merge_documents", r"SELECT conv_id AS doc_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '[\x{00}-\x{20}\x{7f}-\x{a0}]+', ' ', 'g')) AS text FROM conversations GROUP BY conv_id")
def _merge_documents(t):
    turns = t("conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    authored = D.per_document(turns, _one_document, "content binary", key="key", value="text")
    merged = D.merge_documents(authored.select(F.col("key.conv_id").alias("group_id"), F.col("key.turn").alias("seq"), "content"))
    return _words_again(D.page_texts_of(merged.withColumnRenamed("group_id", "doc_id")))


def _titled(value: str):
    from sheaf.operators.author import document_of, wrapped

    yield (document_of(value, " ".join(" ".join(wrapped(value)).split()[:3])).save(),)


def _one_document(value: str):
    from sheaf.operators.author import document_of

    yield (document_of(value).save(),)


@query("ct14_generator", f"SELECT doc_id, CAST(1 AS DOUBLE) AS begins, CAST(1 AS DOUBLE) AS fonts, CAST(length({_SOLID}) AS BIGINT) AS shown FROM documents WHERE text IS NOT NULL")
def _generator(t):
    """Each page begins its text once, in one font; what all pages show is the text."""
    ops = D.content_operators_of(_authored(t)).where("error is null")
    plain = F.regexp_replace(F.get("operands", F.lit(0)), r"\\[0-7]{3}", "x")
    shown = F.char_length(F.regexp_replace(F.regexp_replace(plain, r"^\(|\)$", ""), r"\\([()\\])| ", "$1"))
    of = lambda op: F.count_if(F.col("operator") == op)
    return ops.groupBy("doc_id").agg((of("BT") / F.countDistinct("page_no")).alias("begins"), (of("Tf") / F.countDistinct("page_no")).alias("fonts"), F.coalesce(F.sum(F.when(F.col("operator") == "Tj", shown)), F.lit(0)).alias("shown"))


@query("prj08_display_items", f"SELECT doc_id, 'text' AS kind, CAST(length({_SOLID}) AS BIGINT) AS chars FROM documents WHERE length({_SOLID}) > 0")
def _display_items(t):
    found = D.display_items_of(_authored(t)).where("error is null and kind = 'text'")
    return found.groupBy("doc_id", "kind").agg(F.sum(F.char_length(F.replace("text", F.lit(" "), F.lit("")))).alias("chars"))


@query("ud04_object_kinds", "SELECT kind, count(*) AS documents FROM (SELECT unnest(['dictionary', 'stream']) AS kind FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'string' FROM documents WHERE text IS NOT NULL AND doc_id % 3 > 0 UNION ALL SELECT 'array' FROM documents WHERE text IS NOT NULL AND doc_id % 3 > 1) GROUP BY kind")
def _object_kinds(t):
    """Objects of other kinds, put into some of the documents, are among their rows."""
    def edit(k):
        return lambda document: document.update(document.trailer["Root"], More=[document.add(v) for v in (b"text", [1, 2])[:k]])

    return D.objects_of(_edited_by_id(_authored(t), 3, edit)).where("error is null").select("doc_id", "kind").distinct().groupBy("kind").agg(F.count("*").alias("documents"))


@query("src10_never_fails", "SELECT doc_id, CASE WHEN text IS NULL OR doc_id % 5 = 4 THEN 'empty' WHEN doc_id % 5 = 0 THEN 'malformed' WHEN doc_id % 5 = 2 THEN 'crypto' END AS error, CASE WHEN text IS NOT NULL AND doc_id % 5 IN (1, 3) THEN doc_id % 5 = 1 END AS repaired FROM documents")
def _never_fails(t):
    """Texts as they are, documents cut off somewhere, with a broken encryption entry, whole, or null: a row for each."""
    def seal(k):
        return (lambda document: document.save(crypto.protect("aes128", "", "o"))) if k == 2 else lambda document: document.save()

    n, data = F.col("doc_id") % 5, F.col("content")
    spoiled = F.when(n == 0, F.encode("text", "UTF-8")).when(n == 1, F.substring(data, F.lit(1), (F.length(data) - 30 - F.col("doc_id") % 40).cast("int"))).when(n == 2, F.expr("unhex(replace(hex(content), hex('/R 4'), hex('/R /')))")).when(n == 3, data)
    docs = _edited_by_id(_authored(t), 5, seal).drop("error").join(t("documents").select("doc_id", "text"), "doc_id").select("doc_id", spoiled.alias("content"))
    return D.summaries_of(docs).select("doc_id", "error", "repaired")