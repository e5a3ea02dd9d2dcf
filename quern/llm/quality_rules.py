"""Quality rules with thresholds that the corpus sets itself.

Each document gets counts over its whole text.  A mergeable quantile sketch per
(lang, source) - a histogram whose bucket edges keep ``SKETCH_BITS`` leading
bits, so two sketches merge by adding counts and a quantile is off by at most
one part in 64 - gives each rule's median and a high quantile; a document is
dropped where a rate lies above ``high + FENCE * (high - median)`` of its own
group.  Nothing else decides: where nine of ten documents of a group have no
symbols at all, any are too many there.  Sketches of
groups with under ``min_group`` documents are replaced by the merged sketch of
their language, or of all documents.

Everything is DataFrame expressions: counting is a map over rows, a sketch is a
partial aggregation before its shuffle (a hot source sends a few rows a task),
and the thresholds come back by an ordinary join whose small side Spark measures
at run time.

Defined cases: a rate just at the fence is inside; texts of any length count
whole; a null text counts as empty (0 words, so base_failed); a null
lang or source is the group ''; repeated rows each count and each give a row; an
empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable

SKETCH_BITS = 7
FENCE = 2
#: Rule -> (numerator, denominator, per cent of the high quantile), as rates per ``SCALE``.
SCALE = 1_000_000
RULES = {
    "symbols": ("n_symbols", "n_words", 90),
    "bangs": ("n_bangs", "n_words", 90),
    "dup_lines": ("n_dup_lines", "n_lines", 95),
    "repeats": ("n_repeat_words", "n_words", 90),
    "word_length": ("word_chars", "n_words", 90),
}


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in three-word windows that the text holds twice or more.

    Windows are hashed to 64 bits; only a text with an equal pair sorts them.
    ``words`` has to be a plain column, since it is named in several lambdas.
    """
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(n >= 4, grams)


def counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines, n_repeat_words (long)."""
    keep = keep or []
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    size = F.char_length(t)
    base = docs.select(
        *keep,
        F.regexp_extract_all(t, F.lit(r"[^ \t-\r]+"), F.lit(0)).alias("_words"),
        F.char_length(_without(t, " \t\n\x0b\x0c\r")).alias("word_chars"),
        (size - F.char_length(_without(t, "#*$%&|<>"))).alias("n_symbols"),
        (size - F.char_length(_without(t, "!?"))).alias("n_bangs"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    words = F.col("_words")
    base = base.select(
        *keep,
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_bangs",
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _repeat_words(words, n).alias("_grams"),
    )
    grams = F.col("_grams")
    repeats = F.size(grams) != F.size(F.array_distinct(grams))
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    base = base.withColumn("_sorted", F.when(repeats, pairs)).drop("_grams")
    s = F.col("_sorted")
    last = F.size(s) - 1
    same = F.filter(
        s,
        lambda x, k: ((k > 0) & (x["g"] == F.get(s, k - 1)["g"])) | ((k < last) & (x["g"] == F.get(s, k + 1)["g"])),
    )
    base = base.withColumn("_starts", F.array_sort(F.transform(same, lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("c"), F.lit(-3).alias("p")),
        lambda a, x: F.struct((a["c"] + F.least(F.lit(3), x - a["p"])).alias("c"), x.alias("p")),
        lambda a: a["c"],
    )
    out = base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    made = ["n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_repeat_words"]
    return out.select(*keep, *(F.col(c).cast("long").alias(c) for c in made))


def _rates(counted: DataFrame) -> DataFrame:
    rate = {r: (F.col(a) * SCALE / F.greatest(F.col(b), F.lit(1))).cast("long") for r, (a, b, _) in RULES.items()}
    return counted.withColumns({f"r_{r}": c for r, c in rate.items()})


def _bucket(v: Column) -> Column:
    """The least number with the same leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(rated: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the histogram sketch of each rule in each group.

    Add the n of equal buckets to merge sketches of parts of the data.
    """
    long = rated.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"r_{r}").alias("v")) for r in RULES))).alias("x"))
    return long.groupBy("lang", "source", F.col("x.rule").alias("rule"), _bucket(F.col("x.v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, group: list[str]) -> DataFrame:
    """For each group: its documents and the upper fence of each rule."""
    merged = sketch.groupBy(*group, "rule", "bucket").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    ordered = Window.partitionBy(*group, "rule").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group, "rule")
    ranked = merged.select(*group, "rule", "bucket", F.sum("n").over(ordered).alias("upto"), F.sum("n").over(whole).alias("total"))
    level = F.create_map(*(x for r, (_, _, p) in RULES.items() for x in (F.lit(r), F.lit(p))))[F.col("rule")]
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
    per_rule = ranked.groupBy(*group, "rule").agg(F.max("total").alias("total"), at(F.lit(50)).alias("median"), at(level).alias("high"))
    fence = F.col("high") + FENCE * (F.col("high") - F.col("median"))
    return per_rule.groupBy(*group).agg(F.max("total").alias("docs"), *(F.max(F.when(F.col("rule") == r, fence)).alias(f"f_{r}") for r in RULES))


def thresholds(sketch: DataFrame, min_group: int) -> DataFrame:
    """lang, source, f_<rule>: the fence of each group, from the merged sketch of its language or of all documents where it is small."""
    own = _fences(sketch, ["lang", "source"])
    lang = _fences(sketch, ["lang"]).select("lang", F.col("docs").alias("lang_docs"), *(F.col(f"f_{r}").alias(f"l_{r}") for r in RULES))
    every = _fences(sketch.withColumn("all", F.lit(1)), ["all"]).select("all", *(F.col(f"f_{r}").alias(f"a_{r}") for r in RULES))
    joined = own.join(lang, "lang").withColumn("all", F.lit(1)).join(every, "all")
    pick = {r: F.when(F.col("docs") >= min_group, F.col(f"f_{r}")).when(F.col("lang_docs") >= min_group, F.col(f"l_{r}")).otherwise(F.col(f"a_{r}")) for r in RULES}
    return joined.select("lang", "source", *(c.alias(f"f_{r}") for r, c in pick.items()))


def judge(docs: DataFrame, min_group: int = 20) -> DataFrame:
    """doc_id, lang, source, all counts, base_failed, kept for each row of ``docs``."""
    group = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    # The fences of all documents are one row, so the join with them below is no cross product.
    rated = durable(_rates(counts(docs.select("doc_id", *group, "text"), keep=["doc_id", "lang", "source"])), "quality-counts")
    fences = thresholds(sketches(rated), min_group)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.lit(True)
    for r in RULES:
        inside &= _bucket(F.col(f"r_{r}")) <= F.col(f"f_{r}")
    return rated.join(fences, ["lang", "source"]).withColumn("base_failed", failed).withColumn("kept", ~failed & inside)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    rules = ", ".join(f"('{r}', n.{a} * {SCALE} // greatest(n.{b}, 1), {p})" for r, (a, b, p) in RULES.items())
    one = """
SELECT {g}, rule, max(total) AS docs, min(high) + FENCE * (min(high) - min(median)) AS fence FROM (
  SELECT {g}, rule, total, CASE WHEN upto * 100 >= total * 50 THEN bucket END AS median, CASE WHEN upto * 100 >= total * level THEN bucket END AS high FROM (
    SELECT {g}, rule, level, bucket, sum(c) OVER (PARTITION BY {g}, rule ORDER BY bucket) AS upto, sum(c) OVER (PARTITION BY {g}, rule) AS total
    FROM (SELECT {g}, rule, level, bucket, count(*) AS c FROM bucketed GROUP BY ALL)))
GROUP BY {g}, rule""".replace("FENCE", str(FENCE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
n AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, len(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(regexp_replace(t, '[^!?]+', '', 'g'))::BIGINT AS n_bangs,
  coalesce(n_lines, 0) AS n_lines, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
rates AS (SELECT n.doc_id, n.lang, n.source, r.rule, r.v, r.level FROM n, LATERAL (VALUES {rules}) r(rule, v, level)),
bucketed AS (SELECT *, (v >> greatest(length(bin(v)) - {SKETCH_BITS}, 0)) << greatest(length(bin(v)) - {SKETCH_BITS}, 0) AS bucket FROM rates),
own AS ({one.format(g="lang, source")}), byl AS ({one.format(g="lang")}), every AS ({one.format(g="1").replace("SELECT 1, ", "SELECT ").replace("PARTITION BY 1, rule", "PARTITION BY rule").replace("GROUP BY 1, rule", "GROUP BY rule")}),
fence AS (SELECT own.lang, own.source, own.rule, CASE WHEN own.docs >= 20 THEN own.fence WHEN byl.docs >= 20 THEN byl.fence ELSE every.fence END AS f
  FROM own JOIN byl ON own.lang = byl.lang AND own.rule = byl.rule JOIN every ON own.rule = every.rule),
good AS (SELECT doc_id, bool_and(bucket <= f) AS inside FROM bucketed JOIN fence USING (lang, source, rule) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND inside AS kept
FROM n JOIN good USING (doc_id)"""


ORACLE_SQL = _sql()
