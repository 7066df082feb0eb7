"""Documents as relations: (doc_id, content) to tables of objects, pages, glyphs, words, fields and so on.

Each is one narrow pass: a document is opened once in the task that holds its row, and nothing is shuffled. A document
that can't be read gives one row with its error's code and nulls, never a failed job: the code of the Fault, `limit` where
the interpreter ran out of depth or memory, or `internal` for what no Fault foresees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sheaf.operators import author, content, forms, pages, redact, render, text
from sheaf.session import spread
from sheaf.sources.document import Document, sections
from sheaf.sources.syntax import Fault, Stream, code_of, format_value, kind_of, references, tokens

#: Rows put into one Arrow batch on the way back.
BATCH_ROWS = 4096


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def per_document(docs: DataFrame, rows_of: Callable[..., Iterable[tuple]], columns: str, key: str = "doc_id", value: str = "content", keyed: bool = False) -> DataFrame:
    """key, the columns of each row that rows_of(value) gives, and error: null, or the code of what ended it.

    keyed: it is rows_of(key, value).
    A null value is `empty`, or `limit` where docs has a column length that says that there is content.
    """
    kind = dict(docs.dtypes)[key]
    ddl = f"{key} {kind}, {columns}, error string"
    schema = _arrow_schema(ddl)
    width, sized = len(schema) - 2, "length" in docs.columns and value == "content"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            lengths = batch.column("length").to_pylist() if sized else [None] * batch.num_rows
            for name, data, length in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist(), lengths, strict=True):
                try:
                    if data is None:
                        raise Fault("limit" if length else "empty", "no content")
                    for row in rows_of(name, data) if keyed else rows_of(data):
                        rows.append((name, *row, None))
                        if len(rows) >= BATCH_ROWS:
                            yield pack(rows)
                            rows = []
                except Exception as error:
                    rows.append((name, *[None] * width, code_of(error)))
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return spread(docs.select(key, value, *["length"] * sized)).mapInArrow(run, ddl)


# -- to documents -------------------------------------------------------------------------------------


def author_documents(texts: DataFrame, title: bool = False, compress: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, content, error): each text laid out as a document."""
    return per_document(texts, lambda t: [(author.document_of(t, "Document" if title else None, compress).save(),)], "content binary", value="text")


def edit_documents(docs: DataFrame, edit: Callable[[Document], bytes | None], password: str | None = None) -> DataFrame:
    """(doc_id, content, error) after edit(document); what it returns is the new content, else a full rewrite."""
    def run(data: bytes):
        document = Document(data, password)
        out = edit(document)
        yield (document.save() if out is None else out,)

    return per_document(docs, run, "content binary")


def edit_documents_by_key(docs: DataFrame, edit: Callable[[object, Document], bytes | None], password: str | None = None) -> DataFrame:
    """(doc_id, content, error) after edit(doc_id, document), in one pass over the documents."""
    def run(key, data: bytes):
        document = Document(data, password)
        out = edit(key, document)
        yield (document.save() if out is None else out,)

    return per_document(docs, run, "content binary", keyed=True)


def merge_documents(parts: DataFrame) -> DataFrame:
    """(group_id, seq, content) to (group_id, content, error): the pages of a group's documents in order of seq.

    A merged document is one file, so a group's documents must fit one task.
    """
    ddl = f"group_id {dict(parts.dtypes)['group_id']}, content binary, error string"

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            out = Document()
            for data in table.sort_by("seq").column("content").to_pylist():
                source = Document(data)
                pages.merge(out, source, list(range(len(source.page_refs()))))
            row = [out.save(), None]
        except Exception as error:
            row = [None, code_of(error)]
        return pa.table({"group_id": [key[0].as_py()], "content": pa.array([row[0]], pa.binary()), "error": pa.array([row[1]], pa.string())})

    return parts.groupBy("group_id").applyInArrow(merged, ddl)


# -- from documents -----------------------------------------------------------------------------------


def _opened(function, password=None):
    return lambda data: function(Document(data, password))


def tokens_of(docs: DataFrame) -> DataFrame:
    """token_offset, kind, token of the bytes."""
    return per_document(docs, tokens, "token_offset int, kind string, token string")


def xref_of(docs: DataFrame) -> DataFrame:
    """Every section's entries, section_seq 0 being the newest."""
    def run(data: bytes):
        for sequence, entries, _ in sections(data):
            for number, e in sorted(entries.items()):
                yield sequence, number, ("free", "uncompressed", "compressed")[e.kind], e.place, e.extra

    return per_document(docs, run, "section_seq int, obj_num int, entry string, f1 long, f2 long")


def summaries_of(docs: DataFrame, password: str | None = None) -> DataFrame:
    """One row a document: declared and real number of pages, objects, highest number, whether it had to be repaired, encryption, title."""
    def run(d: Document):
        yield d.page_count(), len(d.page_refs()), len(d.numbers()), max(d.numbers(), default=0), d.repaired, "Encrypt" in d.trailer, forms.metadata(d).get("Title")

    return per_document(docs, _opened(run, password), "declared_pages int, leaf_pages int, n_objects int, highest int, repaired boolean, encrypted boolean, title string")


def objects_of(docs: DataFrame, password: str | None = None) -> DataFrame:
    """Every object: kind, canonical value, a dictionary's entries as canonical values by key, references, a stream's raw bytes."""
    def run(d: Document):
        for number in d.numbers():
            v = d.get(number)
            entries = v.entries if isinstance(v, Stream) else v if isinstance(v, dict) else None
            flat = None if entries is None else {k: format_value(x).decode("latin-1") for k, x in entries.items()}
            yield number, kind_of(v), format_value(v).decode("latin-1"), flat, [r.number for r in references(v)], v.raw if isinstance(v, Stream) else None

    return per_document(docs, _opened(run, password), "obj_num int, kind string, value string, entries map<string,string>, refs array<int>, raw binary")


def pages_of(docs: DataFrame, password: str | None = None) -> DataFrame:
    """Leaves in order with inherited boxes and rotation; width and height are those of the crop box."""
    def run(d: Document):
        for i, ref in enumerate(d.page_refs()):
            a = d.attributes(d.dictionary(ref))
            yield i, ref.number, a["media"], a["crop"], a["rotate"], a["crop"][2] - a["crop"][0], a["crop"][3] - a["crop"][1]

    return per_document(docs, _opened(run, password), "page_no int, obj_num int, media array<double>, crop array<double>, rotate int, width double, height double")


def _leaves(d: Document):
    for i, ref in enumerate(d.page_refs()):
        yield i, d.dictionary(ref)


def content_operators_of(docs: DataFrame) -> DataFrame:
    """The operators of each page with their operands as syntax."""
    def run(d: Document):
        for i, page in _leaves(d):
            for seq, (op, operands) in enumerate(content.lexemes(d.content(page))):
                shown = [operands[0]] if op == "BI" else operands
                yield i, seq, op, [format_value(v).decode("latin-1") for v in shown]

    return per_document(docs, _opened(run), "page_no int, seq int, operator string, operands array<string>")


def display_items_of(docs: DataFrame) -> DataFrame:
    def run(d: Document):
        for i, page in _leaves(d):
            for seq, item in enumerate(content.Interpreter(d).page(page)):
                shown = "".join(g.text for g in item.glyphs) if item.glyphs else None
                yield i, seq, item.kind, list(item.ctm), shown, item.paint or None, list(item.color) if item.color else None, len(item.path) if item.path else 0, str(item.name) if item.name is not None else None

    return per_document(docs, _opened(run), "page_no int, seq int, kind string, ctm array<double>, text string, paint string, color array<double>, segments int, name string")


def glyphs_of(docs: DataFrame) -> DataFrame:
    def run(d: Document):
        for i, page in _leaves(d):
            runs = [x for x in content.Interpreter(d).page(page) if x.kind == "text"]
            for r, item in enumerate(runs):
                for k, g in enumerate(item.glyphs):
                    yield i, r, k, g.code, g.text, g.x, g.y, g.advance, item.font_size, item.mode

    return per_document(docs, _opened(run), "page_no int, run_seq int, glyph_seq int, code int, unicode string, x double, y double, advance double, font_size double, render_mode int")


def text_runs_of(docs: DataFrame) -> DataFrame:
    """The text of each run of glyphs, as glyphs_of has it glyph by glyph."""
    def run(d: Document):
        for i, page in _leaves(d):
            machine = content.Runs(d)
            try:
                machine.page(page)
                shown = [t.text for t in machine.texts]
            except content.Intricate:
                shown = ["".join(g.text for g in x.glyphs) for x in content.Interpreter(d).page(page) if x.kind == "text"]
            for r, found in enumerate(shown):
                yield i, r, found

    return per_document(docs, _opened(run), "page_no int, run_seq int, text string")


def words_of(docs: DataFrame) -> DataFrame:
    """Words in reading order with their boxes."""
    def run(d: Document):
        for i, page in _leaves(d):
            for b, block in enumerate(text.page_blocks(d, page)):
                for n, line in enumerate(block):
                    for w, word in enumerate(line):
                        yield (i, b, n, w, "".join(c.text for c in word), *text.union_box(c.box for c in word))

    return per_document(docs, _opened(run), "page_no int, block int, line int, word int, text string, x0 double, y0 double, x1 double, y1 double")


def page_texts_of(docs: DataFrame, password: str | None = None, own_resources: bool = False, invisible: bool = True) -> DataFrame:
    def run(d: Document):
        for i, page in _leaves(d):
            yield i, text.page_text(d, page, own_resources=own_resources, invisible=invisible)

    return per_document(docs, _opened(run, password), "page_no int, text string")


def matches_of(docs: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    def run(d: Document):
        for i, page in _leaves(d):
            for start, end, box, found in text.page_matches(d, page, needle, ignore_case):
                yield (i, start, end, *box, found)

    return per_document(docs, _opened(run), "page_no int, start int, stop int, x0 double, y0 double, x1 double, y1 double, text string")


def annotations_of(docs: DataFrame) -> DataFrame:
    def run(d: Document):
        for i, ref in enumerate(d.page_refs()):
            for k, a in enumerate(forms.annotation_refs(d, ref)):
                e = d.dictionary(a)
                yield i, k, str(d.resolve(e.get("Subtype"))), d.rectangle(e.get("Rect")), int(d.number(e.get("F")) or 0), "AP" in e

    return per_document(docs, _opened(run), "page_no int, seq int, subtype string, rect array<double>, flags int, drawn boolean")


def fields_of(docs: DataFrame) -> DataFrame:
    def run(d: Document):
        for k, f in enumerate(forms.fields(d)):
            yield k, f.name, f.kind, f.flags, "|".join(f.value) if isinstance(f.value, list) else f.value, len(f.widgets)

    return per_document(docs, _opened(run), "seq int, name string, kind string, flags int, value string, n_widgets int")


def redaction_regions_of(docs: DataFrame) -> DataFrame:
    def run(d: Document):
        for i, ref in enumerate(d.page_refs()):
            for k, m in enumerate(redact.marks(d, ref)):
                for box in redact.region_of(d, m).boxes:
                    yield (i, k, *box)

    return per_document(docs, _opened(run), "page_no int, seq int, x0 double, y0 double, x1 double, y1 double")


def rendered_pages_of(docs: DataFrame, dpi: float = 72.0, password: str | None = None) -> DataFrame:
    """Each page's pixels from the top: width, height and rgb, 3 bytes a pixel. A page above images.MAX_PIXELS is an error row."""
    def run(d: Document):
        for i, page in _leaves(d):
            raster = render.render(d, page, dpi / 72)
            yield i, raster.width, raster.height, raster.pixels[..., :3].tobytes()

    return per_document(docs, _opened(run, password), "page_no int, width int, height int, rgb binary")
