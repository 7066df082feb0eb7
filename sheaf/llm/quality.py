"""Quality rules: counts over words and lines, and robust multivariate outliers. DataFrame functions only.

The verdict: a minimum covariance determinant estimate of five transformed statistics in each group of (lang, source).
From several deterministic starts (medians with the scatter of medians alone, of squashed and of spatial signs),
concentration steps take the mean and covariance of the HALF of the group's rows that lie nearest; the start that leads
to the least determinant is carried on. The covariance is made consistent for normal rows and regularised by a target
(FLOOR), as most rows lack some of what is counted. Rows beyond the chi-square quantile of TAIL are rejected. A group too
small for that is judged by the estimate of its language's rows, or of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import blank_words, checkpoint, join_groups, spread

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of a group's rows that an estimate is made of.
HALF = 0.75
#: Concentration steps of all starts, and of the best afterwards.
FIRST_STEPS, MORE_STEPS = 2, 4
#: A concentration step takes the rows up to the nearest HALF's last, and those that tie with it in a so-manieth of a doubling.
BINS = 64
#: Groups with fewer rows than this are judged by their language's estimate; languages with fewer, by that of all rows.
MIN_GROUP = 50
#: Share of rows of a normal distribution that are beyond the cutoff: about one in a corpus of 10**10 documents.
TAIL = 1e-10
#: Standard deviations of the target: of what most rows lack, the spread is zero, and any trace were an outlier.
FLOOR = (0.4, 0.35, 0.35, 0.35, 0.6)
#: Groups up to which their estimates (31 numbers each) are broadcast; of more, the largest are.
BROADCAST_GROUPS = 20_000
#: Rejected texts up to which their digests (16 bytes each) are broadcast.
BROADCAST_TEXTS = 500_000


def chi_square(x: float, k: int) -> float:
    """Share of the chi-square distribution of an odd number of degrees of freedom up to x."""
    below = math.erf(math.sqrt(x / 2))
    for i in range(1, k, 2):
        below -= (x / 2) ** (i / 2) * math.exp(-x / 2) / math.gamma(i / 2 + 1)
    return below


def chi_square_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < share else (low, middle)
    return low


#: Squared distance above which a row is rejected.
CUTOFF = chi_square_quantile(1 - TAIL, 5)
#: Of normal rows, the covariance of the nearest HALF is this much too small.
CONSISTENCY = HALF / chi_square(chi_square_quantile(HALF, 5), 7)
_NAMES = ["x0", "x1", "x2", "x3", "x4"]
_PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]


def _digest() -> Column:
    """128 bits of all that a verdict depends on."""
    of = (F.col("text"), F.lit(0), F.col("lang").isNull(), F.col("lang"), F.lit(0), F.col("source").isNull(), F.col("source"))
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit(1), *of).alias("b"))


def statistics(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, lang, source, digest, the carried columns and the counts of each row; one pass, nothing is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = docs.select("doc_id", "lang", "source", _digest().alias("digest"), *carried, text.alias("t"), blank_words(F.col("text")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("w")
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.lit([]).cast("array<long>"))
    known = with_words.columns[:-2]
    counted = with_words.select(
        *known,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate("t", "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), hashes.alias("h"),
    )
    halfway = counted.select(*known, "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "h", F.size(F.array_distinct("h")).alias("different"))
    # Only texts that repeat a window are looked at further: windows sorted by hash, then the places of those with an equal neighbour.
    placed = F.when(F.col("different") < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s")
    sorted_ = halfway.select("*", placed).drop("h", "different")
    s = F.col("s")
    same = lambda e, j: (F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"])
    places = sorted_.select("*", F.sort_array(F.transform(F.filter(s, lambda e, j: F.coalesce(same(e, j), F.lit(False))), lambda e: e["i"])).alias("p")).drop("s")
    p = F.col("p")
    gaps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
    covered = F.when(p.isNull(), 0).otherwise(F.aggregate(gaps, F.lit(0), lambda a, b: a + b)).cast("long")
    return places.select("*", covered.alias("n_repeat_words")).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.log1p(100.0 * F.col(c) / words)
    return [F.log1p(F.col("n_words").cast("double")), F.col("word_chars") / words, share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]


def _swept(flat: str) -> str:
    """SQL of the inverse q (an array of 25) of a symmetric positive matrix and the logarithm of its determinant, by sweeping each pivot.

    Expressions of this size are given as SQL: as Columns, each of their parts were a call from Python to the JVM.
    """
    pivot = "get(h.q, k * 6)"
    cell = f"CASE WHEN p div 5 = k AND p % 5 = k THEN -1 / {pivot} WHEN p div 5 = k OR p % 5 = k THEN x / {pivot} ELSE x - get(h.q, CAST(p div 5 AS INT) * 5 + k) * get(h.q, k * 5 + p % 5) / {pivot} END"
    step = f"named_struct('q', transform(h.q, (x, p) -> {cell}), 'log_det', h.log_det + ln({pivot}))"
    return f"aggregate(sequence(0, 4), named_struct('q', {flat}, 'log_det', 0.0D), (h, k) -> {step}, h -> named_struct('q', transform(h.q, x -> -x), 'log_det', h.log_det))"


def _estimate(moments: DataFrame) -> DataFrame:
    """g, start, weight, m (means), q (inverse scatter) and log_det, of g, start, weight, m0..m4 and s00..s44 (scatter, target included)."""
    scatter = ", ".join(f"s{max(i, j)}{min(i, j)}" for i in range(5) for j in range(5))
    whole = moments.selectExpr("g", "start", "weight", "array(m0, m1, m2, m3, m4) AS m", f"{_swept(f'array({scatter})')} AS e")
    return whole.selectExpr("g", "start", "weight", "m", "e.q", "e.log_det")


#: The squared distance of x0..x4 from m under q.
_DISTANCE = " + ".join(f"{1 if i == j else 2}.0D * get(q, {5 * i + j}) * (x{i} - get(m, {i})) * (x{j} - get(m, {j}))" for i, j in _PAIRS)


def _concentrated(rows: DataFrame, now: DataFrame) -> DataFrame:
    """A concentration step of each (g, start) of now: sums by bins of distance, then those of the nearest bins.

    One pass over rows, whose sums are made before anything is shuffled; a group has a bin for each so-manieth of a
    doubling at most, however many rows.
    """
    scored = join_groups(rows, now, "g", 3 * BROADCAST_GROUPS)
    binned = scored.selectExpr("g", "start", "m", f"floor({BINS} * log2({_DISTANCE} + 1)) AS bin", *(f"x{i} - get(m, {i}) AS y{i}" for i in range(5)))
    sums = [f"sum(y{i}) AS t{i}" for i in range(5)] + [f"sum(y{i} * y{j}) AS t{i}{j}" for i, j in _PAIRS]
    per_bin = binned.groupBy("g", "start", "bin").agg(*map(F.expr, ["count(*) AS n", "first(m) AS m", *sums]))
    of = "OVER (PARTITION BY g, start"
    near = per_bin.selectExpr("*", f"coalesce(sum(n) {of} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before", f"sum(n) {of}) AS weight").where(f"before < {HALF} * weight")
    names = [c for c in per_bin.columns if c[0] == "t"]
    total = near.groupBy("g", "start").agg(*map(F.expr, ["first(weight) AS weight", "first(m) AS m", "sum(n) AS n", *(f"sum({c}) AS {c}" for c in names)]))
    scatter = [f"{CONSISTENCY!r}D * (t{i}{j} / n - (t{i} / n) * (t{j} / n)) + {FLOOR[i] ** 2 if i == j else 0.0!r}D AS s{i}{j}" for i, j in _PAIRS]
    return _estimate(total.selectExpr("g", "start", "weight", *(f"get(m, {i}) + t{i} / n AS m{i}" for i in range(5)), *scatter))


def _starts(rows: DataFrame) -> DataFrame:
    """The estimates of each (g, start): medians, and scatters of medians' deviations with three sorts of correlation."""
    names = [f"m{i}" for i in range(5)]
    medians = checkpoint(rows.groupBy("g").agg(*map(F.expr, ["count(*) AS weight", *(f"percentile_approx(x{i}, 0.5D, 1000) AS m{i}" for i in range(5))])))
    away = join_groups(rows, medians, "g", BROADCAST_GROUPS).groupBy("g").agg(*map(F.expr, ["count(*) AS weight", *(f"first({m}) AS {m}" for m in names), *(f"percentile_approx(abs(x{i} - m{i}), 0.5D, 1000) AS a{i}" for i in range(5))]))
    spreads = checkpoint(away.selectExpr("g", "weight", *names, *(f"sqrt(pow(1.4826D * a{i}, 2) + {FLOOR[i] ** 2!r}D) AS d{i}" for i in range(5))))
    scaled = join_groups(rows, spreads, "g", BROADCAST_GROUPS).selectExpr("g", *(f"(x{i} - m{i}) / d{i} AS z{i}" for i in range(5)))
    # u: squashed deviations; v: spatial signs.
    both = scaled.selectExpr("*", f"sqrt({' + '.join(f'z{i} * z{i}' for i in range(5))}) AS r").selectExpr("g", *(f"tanh(z{i}) AS u{i}" for i in range(5)), *(f"z{i} / CASE WHEN r > 0 THEN r ELSE 1.0D END AS v{i}" for i in range(5)))
    products = both.groupBy("g").agg(*map(F.expr, [*(f"avg({k}{i} * {k}{j}) AS {k}{i}{j}" for k in "uv" for i, j in _PAIRS), *(f"avg(u{i}) AS u{i}" for i in range(5))]))
    covariance = {"u": lambda i, j: f"(u{i}{j} - u{i} * u{j})", "v": lambda i, j: f"v{i}{j}"}

    def correlation(k: str, i: int, j: int) -> str:
        c = covariance[k]
        scale = f"sqrt({c(i, i)} * {c(j, j)})"
        return "1.0D" if i == j else f"CASE WHEN {scale} > 1e-12D THEN 0.99D * {c(i, j)} / {scale} ELSE 0.0D END"  # inside of -1 and 1: the scatter can be inverted

    found = spreads.join(products, "g") if spreads.limit(BROADCAST_GROUPS + 1).count() > BROADCAST_GROUPS else spreads.join(F.broadcast(products), "g")
    kinds = [lambda i, j: f"{float(i == j)}D", lambda i, j: correlation("u", i, j), lambda i, j: correlation("v", i, j)]
    scatters = ", ".join(f"named_struct('start', {n}, {', '.join(f"'s{i}{j}', {kind(i, j)} * d{i} * d{j}" for i, j in _PAIRS)})" for n, kind in enumerate(kinds))
    return _estimate(found.selectExpr("g", "weight", *names, f"explode(array({scatters})) AS s").selectExpr("g", "weight", *names, "s.*"))


def estimates(rows: DataFrame) -> DataFrame:
    """g, weight (rows), m (location) and q (inverse scatter) of each g of (g, x0..x4), by minimum covariance determinant.

    Of starts with the same determinant, the first is carried on. Each step is checkpointed; rows are read from what is.
    """
    now = checkpoint(_starts(rows))
    for _ in range(FIRST_STEPS):
        now = checkpoint(_concentrated(rows, now))
    best = F.min_by(F.struct("weight", "m", "q", "log_det"), F.struct(F.round("log_det", 9), "start"))
    now = checkpoint(now.groupBy("g").agg(best.alias("b")).select("g", F.lit(0).alias("start"), "b.*"))
    for _ in range(MORE_STEPS):
        now = checkpoint(_concentrated(rows, now))
    return now.select("g", "weight", "m", "q")


def _pools(rows: DataFrame) -> DataFrame:
    """g, used (whose estimate judges the group) and fits (the estimates that its rows go into) of each g of (g, l, base_failed).

    A group's estimate is its own, its language's (l) or that of all rows: the first with MIN_GROUP rows to learn from,
    or the last. Language and corpus are fitted on all their rows, those of large groups too, where a group needs them.
    """
    sizes = checkpoint(rows.groupBy("g", "l").agg(F.count_if(~F.col("base_failed")).alias("n"), F.count("*").alias("weight")))
    languages = checkpoint(sizes.groupBy("l").agg(F.sum("n").alias("of_l"), F.min("n").alias("least"), F.count("*").alias("groups")))
    wide = (F.col("least") < MIN_GROUP) & (F.col("of_l") >= MIN_GROUP)
    rest = not languages.where(F.col("of_l") < MIN_GROUP).isEmpty()
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("k"))
    own, language, corpus = key(0, F.col("g")), key(1, F.col("l")), key(2, F.lit(0))
    fits = F.filter(F.array(F.when(F.col("n") >= MIN_GROUP, own), F.when(wide, language), F.when(F.lit(rest), corpus)), lambda x: x.isNotNull())
    used = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("of_l") >= MIN_GROUP, language).otherwise(corpus)
    return checkpoint(join_groups(sizes, languages, "l", BROADCAST_GROUPS, weight="groups").select("g", "weight", used.alias("used"), fits.alias("fits")))


def _rows(docs: DataFrame, *carried: Column) -> DataFrame:
    """statistics() with base_failed, the keys of the row's group (g) and language (l), and the vector x0..x4."""
    language = F.xxhash64("lang", F.col("lang").isNull())
    group = F.xxhash64("lang", F.col("lang").isNull(), "source", F.col("source").isNull())
    return statistics(docs, *carried).select("*", base_failed().alias("base_failed"), group.alias("g"), language.alias("l"), *(v.alias(x) for v, x in zip(_vector(), _NAMES, strict=True)))


def _judges(rows: DataFrame) -> DataFrame:
    """g, weight, m and q: the estimate that judges each group of _rows()."""
    pools = _pools(rows)
    passed = join_groups(rows.where(~F.col("base_failed")), pools, "g", BROADCAST_GROUPS)
    estimate = estimates(passed.select(F.explode("fits").alias("g"), *_NAMES)).withColumnsRenamed({"g": "used", "weight": "learned"})
    return checkpoint(join_groups(pools, estimate, "used", BROADCAST_GROUPS, weight="learned").select("g", "weight", "m", "q"))


def _judged(rows: DataFrame, judges: DataFrame) -> DataFrame:
    """rows with d2 and kept."""
    scored = join_groups(rows, judges, "g", BROADCAST_GROUPS, how="left").select(*(F.col(c) for c in rows.columns), F.expr(_DISTANCE).alias("d2"))
    return scored.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("d2") > CUTOFF, F.lit(False)))


def verdicts(docs: DataFrame) -> DataFrame:
    """The counts, base_failed, kept and d2 of each row of (doc_id, text, lang, source).

    base_failed and d2 > CUTOFF reject. Null text has no words, and so fails. Null lang and source are values of their
    own. The fit takes the rows that did not fail, all of them; groups of fewer than MIN_GROUP of these are judged by
    their language's estimate, and languages of fewer by that of all rows. So d2 is null only if all rows failed.
    Repeated rows count as often as they stand there; an empty table gives none; other columns are ignored. A long text
    takes memory in proportion to itself.
    """
    rows = checkpoint(_rows(spread(docs)))
    return _judged(rows, _judges(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that verdicts() rejects; ids play no part, so they may repeat or be null.

    What was rejected is known by digests of (text, lang, source), which are broadcast while they are few. Of more, each
    row is counted anew where it is, and judged by its group's estimate; no text is shuffled either way.
    """
    rows = checkpoint(_rows(spread(docs)))
    judges = _judges(rows)
    bad = checkpoint(_judged(rows, judges).where("not kept").select("digest").distinct())
    if bad.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        named = F.broadcast(bad.withColumnRenamed("digest", "__sheaf_digest"))
        return docs.withColumn("__sheaf_own", _digest()).join(named, F.col("__sheaf_own") == F.col("__sheaf_digest"), "left_anti").drop("__sheaf_own")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__sheaf_row")
    # A filter isn't pushed below a number of the row. It would be put before the scan otherwise, with each step of the counts written out
    # wherever the next one uses it, so windows were sorted again for each window of a text.
    counted = _rows(docs, whole).withColumn("__sheaf_once", F.monotonically_increasing_id())
    return _judged(counted, judges).where("kept AND __sheaf_once >= 0").select("__sheaf_row.*")
