"""Quality rules whose cutoffs labelled good texts vouch for.

Each measure of a text is a whole number per thousand; a rule rejects texts whose measure is above its cutoff. Labelled
texts that pass the base are dealt by a hash of their ids: a quarter proposes, the rest is a holdout. In each stratum the proposing part
gives, for a few budgets of false rejections, the lowest cutoff of each measure that keeps to the budget; measures that
don't reject bad texts more often than good ones stay out. So each stratum has one path of rule sets, fixed before the
holdout is looked at. Along it, from the smallest budget on, the good texts of the holdout test the hypothesis that all
rules together reject more than ``alpha`` of good texts: with k of n rejected, the exact binomial probability of at
most k must be at most ``delta`` over the number of strata (Bonferroni); the first set that fails ends the path, so
its steps need no further correction. With probability ``1 - delta`` no stratum loses more than ``alpha`` of its good
texts to the rules, if its labels are a fair sample; where labels are too few to show that, there is no rule. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import SEPARATOR_RUN, SEPARATORS, log_factorial, text_of, written

SYMBOLS = "#*$%&|<>"
#: Measures per thousand: symbols and capitals of all word characters, exclamation marks and repeated words of all
#: words, repeated lines of all lines with a word.
MEASURES = ("symbols", "capitals", "exclamations", "repeated_words", "repeated_lines")
GRID = (10, 20, 50, 100, 150, 200, 250, 300, 400, 500, 700)
ALPHA, DELTA = 0.02, 0.05
#: Budgets of the path, as shares of ``alpha`` over the number of measures.
BUDGETS = (0.0, 0.5, 1.0)
#: Ids whose hash is below this propose; the others are the holdout.
PROPOSING = "4"


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(windows: Column) -> Column:
    """Words in windows that come twice or more, from the hashes of all three-word windows in order.

    Hashes are sorted with their places; a place whose neighbour has the same hash is repeated, and each such place
    adds the words of its window that the one before didn't have.
    """

    def count(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(F.transform(F.array(placed), count)[0])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row: id, stratum, the base counts, ``base_failed`` and the measures.

    A null text is empty; a null stratum is the stratum of the empty string. Windows are compared by 64-bit hashes.
    """
    words = F.array_remove(F.split("t", SEPARATOR_RUN), "")
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text_of(F.col(text_col).cast("string")).alias("t"))
    cut = own.withColumn("w", words)
    hashed = cut.withColumn("h", F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    lines = hashed.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(without(x, SEPARATORS)) > 0))
    long = lambda c: c.cast("bigint")
    counted = lines.select(
        "doc_id",
        "stratum",
        long(F.size("w")).alias("n_words"),
        long(F.length(without(F.col("t"), SEPARATORS))).alias("word_chars"),
        long(F.length("t") - F.length(without(F.col("t"), SYMBOLS))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("h"))).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))).alias("n_capitals"),
        long(F.length("t") - F.length(without(F.col("t"), "!"))).alias("n_exclamations"),
    )
    share = lambda a, b: (1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("bigint")
    of = (("n_symbols", "word_chars"), ("n_capitals", "word_chars"), ("n_exclamations", "n_words"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"))
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumns({m: share(*x) for m, x in zip(MEASURES, of, strict=True)})


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Logarithm of the probability of at most k of n at rate p, for k below n p.

    Terms are added from the k-th downwards until twelve standard deviations below it, where they are under the last
    place of a double.
    """
    rate = F.lit((1 - p) / p)
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    many = F.least(k, F.ceil(12 * F.sqrt(n * F.lit(p)) + 40).cast("bigint"))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] * (k - i) / (n - k + i + 1) * rate
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    return top + F.log(F.aggregate(F.slice(F.sequence(F.lit(0).cast("bigint"), many), F.lit(1), many), one, add, lambda a: a["s"]))


def proposed(labelled: DataFrame, alpha: float, grid: tuple[int, ...]) -> DataFrame:
    """For each stratum, measure and budget the cutoff that labelled rows (stratum, y, measures) propose: stratum, (measure)_(budget's number)."""
    good, bad = F.col("y") == 1, F.col("y") == 0
    long = labelled.select("stratum", "y", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES))).alias("x")).select("stratum", "y", "x.*")
    sums = [F.struct(F.lit(c).alias("cutoff"), F.count_if(good & (F.col("value") > c)).alias("k"), F.count_if(bad & (F.col("value") > c)).alias("caught")) for c in grid]
    tests = long.groupBy("stratum", "measure").agg(F.count_if(good).alias("n"), F.count_if(bad).alias("bad"), F.array(*sums).alias("x")).select("stratum", "measure", "n", "bad", F.explode("x").alias("x"))

    def lowest(share: float) -> Column:
        return F.min(F.when(F.col("x.k") <= F.lit(share * alpha / len(MEASURES)) * F.col("n"), F.col("x")))

    best = tests.groupBy("stratum", "measure", "n", "bad").agg(*(lowest(b).alias(f"b{i}") for i, b in enumerate(BUDGETS)))
    useful = lambda c: F.when(F.col(f"{c}.caught") * F.col("n") > F.col(f"{c}.k") * F.col("bad"), F.col(f"{c}.cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("measure") == m, useful(f"b{i}"))).alias(f"{m}_{i}") for m in MEASURES for i in range(len(BUDGETS))))


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grid: tuple[int, ...] = GRID) -> DataFrame:
    """One row for each stratum with a good text in the holdout: the certified cutoff of each measure, or null.

    ``labelled`` are measured rows that pass the base, with ``y`` (1 good, 0 bad) and ``proposes``.
    """
    steps = range(len(BUDGETS))
    paths = proposed(labelled.filter("proposes"), alpha, grid).withColumnRenamed("stratum", "of")
    held = labelled.filter(~F.col("proposes") & (F.col("y") == 1)).join(paths, F.col("stratum") == F.col("of"), "left")

    def rejects(i: int) -> Column:
        return F.coalesce(*(F.when(F.col(m) > F.col(f"{m}_{i}"), True) for m in MEASURES), F.lit(False))

    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(rejects(i)).alias(f"k{i}") for i in steps), *(F.first(f"{m}_{i}").alias(f"{m}_{i}") for m in MEASURES for i in steps))
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))
    tests = counts.crossJoin(F.broadcast(strata))  # one row
    passed, so_far = F.lit(-1), F.lit(True)
    for i in steps:
        so_far = so_far & (F.col(f"k{i}") < F.col("n") * alpha) & (binomial_tail(F.col(f"k{i}"), F.col("n"), alpha) <= F.log(F.lit(delta) / F.col("strata")))
        passed = F.when(so_far, F.lit(i)).otherwise(passed)
    told = tests.withColumn("passed", passed)
    return told.select("stratum", *(F.coalesce(*(F.when(F.col("passed") == i, F.col(f"{m}_{i}")) for i in steps)).alias(f"{m}_cutoff") for m in MEASURES))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs``: the base counts, ``base_failed``, ``kept`` and the measures.

    Good texts are rows whose id all labels call 1, bad ones those whose id some label calls 0; null labels, ids without
    labels, and null ids teach nothing. Without labels only the base decides. Each row has its own verdict, copies and
    repeated ids too; other columns are left out.
    """
    rows = written(measured(docs, id_col, text_col, stratum_col))
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("y"))
    labelled = rows.filter(~F.col("base_failed")).join(marks, "doc_id").withColumn("proposes", F.md5(F.col("doc_id").cast("string")) < PROPOSING)
    rules = cutoffs(written(labelled.select("stratum", "y", "proposes", *MEASURES)), alpha, delta)
    judged = rows.join(rules, "stratum", "left")
    over = F.coalesce(*(F.when(F.col(m) > F.col(f"{m}_cutoff"), True) for m in MEASURES), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:]) AS c FROM d WHERE len(w) > 2),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, sum(least(3, i - prev))::BIGINT AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -3) AS prev FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_BLANK}, '')) > 0) AS l FROM d),
base AS MATERIALIZED (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(translate(t, {_BLANK}, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
m AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_capitals // greatest(word_chars, 1) AS capitals,
    1000 * n_exclamations // greatest(n_words, 1) AS exclamations, 1000 * n_repeat_words // greatest(n_words, 1) AS repeated_words, 1000 * n_dup_lines // greatest(n_lines, 1) AS repeated_lines
  FROM base),
y AS MATERIALIZED (SELECT m.*, y, md5(m.doc_id::VARCHAR) < '{PROPOSING}' AS proposes FROM (FROM m WHERE NOT base_failed) m JOIN (SELECT doc_id, min(quality) AS y FROM labels WHERE quality IN (0, 1) GROUP BY 1) USING (doc_id)),
long AS ({' UNION ALL '.join(f"SELECT stratum, y, '{m}' AS measure, {m} AS value FROM y WHERE proposes" for m in MEASURES)}),
tests AS (
  SELECT stratum, measure, cutoff, count(*) FILTER (y = 1) AS n, count(*) FILTER (y = 0) AS bad, count(*) FILTER (y = 1 AND value > cutoff) AS k, count(*) FILTER (y = 0 AND value > cutoff) AS caught
  FROM long, (SELECT unnest({list(GRID)}) AS cutoff) GROUP BY ALL),
budgets AS (SELECT unnest(range({len(BUDGETS)})) AS step, unnest({[b * ALPHA / len(MEASURES) for b in BUDGETS]}::DOUBLE[]) AS budget),
best AS (SELECT stratum, measure, step, arg_min(struct_pack(cutoff := cutoff, useful := caught * n > k * bad), cutoff) AS b FROM tests, budgets WHERE k <= budget * n GROUP BY ALL),
paths AS (SELECT stratum, measure, step, b.cutoff AS cutoff FROM best WHERE b.useful),
held AS MATERIALIZED (SELECT row_number() OVER () AS row, * FROM y WHERE NOT proposes AND y = 1),
sizes AS (SELECT stratum, count(*) AS n, count(*) OVER () AS strata FROM held GROUP BY 1),
values_ AS ({' UNION ALL '.join(f"SELECT row, stratum, '{m}' AS measure, {m} AS value FROM held" for m in MEASURES)}),
hits AS (SELECT stratum, step, count(DISTINCT row) AS k FROM values_ JOIN paths USING (stratum, measure) WHERE value > cutoff GROUP BY ALL),
each AS (SELECT stratum, step, n, strata, coalesce(k, 0) AS k FROM sizes CROSS JOIN budgets LEFT JOIN hits USING (stratum, step)),
tail AS (SELECT stratum, step, n, strata, k, sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM each) GROUP BY ALL),
passed AS (SELECT stratum, max(step) AS step FROM (SELECT *, bool_and(k < n * {ALPHA}::DOUBLE AND p <= {DELTA}::DOUBLE / strata) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM tail) WHERE ok GROUP BY 1),
rules AS (SELECT stratum, {', '.join(f"min(cutoff) FILTER (measure = '{m}') AS {m}_cutoff" for m in MEASURES)} FROM paths JOIN passed USING (stratum, step) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f"coalesce({m} > {m}_cutoff, false)" for m in MEASURES)}) AS kept
FROM m LEFT JOIN rules USING (stratum)
"""
