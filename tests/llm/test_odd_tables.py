"""Each operator on nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names, and empty tables."""

import random
import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from sheaf.llm import bpe, chat, decontaminate, langid, linededup, quality, secrets, simhash, toxicity, warc

RNG = random.Random(9)
WORDS = ["".join(RNG.choices("etaoinshrdlu", k=RNG.randrange(1, 9))) for _ in range(3000)]
#: Some 300,000 characters in 40,000 words and 4,000 lines.
LONG = "\n".join(" ".join(RNG.choices(WORDS, k=10)) for _ in range(4000))
ITEM = " ".join(LONG.split()[30_000:30_014])
ROWS = [(1, None), (1, None), (2, ""), (3, " \t\n"), (4, LONG), (4, LONG), (None, LONG + "\nend"), (None, None), (5, "a b c"), (5, "a b c d"), (6, 'token = "0123456789abcdef0123"'), (-(1 << 63), "least id"), ((1 << 63) - 1, "x" * 100_000)]
CLASHING = ("n_words", "kept", "host", "row", "place", "segment", "hits", "items", "h", "g", "digest", "weight", "fp", "least", "root", "score", "held_out", "toxic_score", "spans", "n_tokens", "i", "line", "bad", "d2", "u", "start", "m", "q")


@pytest.fixture(scope="module")
def table(spark):
    frame = spark.createDataFrame([(d, t, "en" if n % 3 else None, "s" if n % 2 else None) for n, (d, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit(n) for n, c in enumerate(CLASHING)}).repartition(3).cache()


def listed(frame, *columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())


def wanted(rows):
    return sorted(repr(tuple(r)) for r in rows)


def test_bpe(table):
    run = lambda df: bpe.encode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert listed(run(table), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted((d, *brute.bpe(t)) for d, t in ROWS)
    assert run(table.limit(0)).count() == 0


def test_simhash(table):
    found = simhash.near_duplicates(table).collect()
    prints = [f"{brute.simhash(t):016x}" for _, t in ROWS]
    assert sorted(r["fingerprint"] for r in found) == sorted(prints)
    groups = {}
    for r in found:
        groups.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(v) == 1 for v in groups.values()) and groups["0" * 16] == {1}
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_langid(table):
    found = langid.held_out_predictions(table).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.held_out_predictions(table.limit(0)).count() == 0


def test_decontamination(spark, table):
    items = [(1, ITEM), (1, ITEM), (None, "a b c"), (3, None), (4, ""), (5, "least")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("n_words", F.lit(1))
    for block in (decontaminate.BLOCK_WORDS, 8):
        found = decontaminate.summary(decontaminate.contamination(table, benchmark, block_words=block))
        assert listed(found, *found.columns) == wanted(brute.contamination(ROWS, items))
    near = decontaminate.near_items(table, benchmark).collect()
    assert sorted((repr(r["doc_id"]), repr(r["item_id"]), r["n_places"]) for r in near) == sorted((repr(ROWS[n][0]), repr(item), k) for (n, item), k in brute.proximity(ROWS, items).items())
    assert decontaminate.near_items(table.limit(0), benchmark).count() == 0 == decontaminate.contamination(table.limit(0), benchmark.limit(0)).count()


def test_revisits(spark):
    rows = [(1, "http://a/" + "x" * 50_000, 1, "response", '"e"', None, {"server": "s" * 50_000}), (2, "http://a/" + "x" * 50_000, 2, "revisit", '"e"', None, None), (2, "http://a/" + "x" * 50_000, 2, "revisit", '"e"', None, None), (None, None, None, "revisit", None, None, None), (None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    extra = frame.withColumns({c: F.lit(n) for n, c in enumerate(("url_key", "outcome", "resolved_id", "full", "k", "part", "before"))})
    found = warc.resolve_revisits(extra).collect()
    assert sorted((r["record_id"] or 0, r["resolved_id"] or 0, r["outcome"]) for r in found) == [(0, 0, "no_response"), (2, 1, "resolved"), (2, 1, "resolved")]
    assert warc.resolve_revisits(extra.limit(0)).count() == 0


def test_secrets(table):
    found = secrets.scan(table, secrets.fit(table))
    spans = lambda t: [f"{k}:{s}:{e}" for s, e, k in brute.secret_spans(t)]
    assert listed(found, "doc_id", "base_sha256") == wanted((d, brute.sha(",".join(spans(t)).encode())) for d, t in ROWS)
    assert secrets.scan(table.limit(0), secrets.fit(table.limit(0))).count() == 0


def test_preferences(spark):
    rows = [(-(1 << 63), 0, "user", "q"), (-(1 << 63), 1, "assistant", LONG), (1, 0, "user", "same"), (1, 1, "assistant", "a"), (2, 0, "user", "z"), (2, 1, "assistant", LONG), (2, 1, "assistant", LONG), ((1 << 63) - 1, 0, "assistant", "last"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(n) for n, c in enumerate(("turns", "at", "other", "has", "next_of", "all", "n", "p", "c", "r"))})
    made = chat.format_preferences(chat.neighbour_pairs(frame).withColumns({c: F.lit(n) for n, c in enumerate(("n", "p", "c", "r", "prompt", "status"))})).collect()
    found = {r["pair_id"]: r for r in made}
    assert len(made) == 5 and found[1]["status"] == "ok" and found[1]["prompt"] == "<|user|>\nsame<|end|>\n"
    assert found[1]["rejected_text"] == f"<|assistant|>\n{LONG}<|end|>\n" and found[-(1 << 63)]["chosen_text"] == f"<|assistant|>\n{LONG}<|end|>\n" and found[-(1 << 63)]["rejected_text"] == ""
    assert found[2]["n_prompt_turns"] == 2 and found[None]["status"] == "identical"
    assert chat.neighbour_pairs(frame.limit(0)).count() == 0


def test_toxicity(spark, table):
    labels = spark.createDataFrame([(i, i % 2) for i in (4, 4, 5, 6, 7)] + [(None, 1), (4, None)], "doc_id long, toxic int").withColumn("text", F.lit("x")).withColumn("score", F.lit(1))
    found = toxicity.held_out_scores(table, labels).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.held_out_scores(table.limit(0), labels.limit(0)).count() == 0


def test_quality(table):
    found = quality.verdicts(table)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert listed(found, "doc_id", *names) == wanted((d, *brute.quality(t)) for d, t in ROWS)
    assert quality.verdicts(table.limit(0)).count() == 0


def test_line_dedup(table):
    rows = [r for r in table.collect()]
    want = brute.line_dedup([(r["source"], r["text"]) for r in rows])
    found = linededup.drop_boilerplate(table)
    assert found.columns[: len(table.columns)] == table.columns
    assert listed(found, "doc_id", "text", "n_lines", "n_dropped") == wanted((r["doc_id"], *w) for r, w in zip(rows, want, strict=True))
