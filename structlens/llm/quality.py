"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base statistics come from array functions inside one projection: no row
is exploded and no text is shuffled. Thresholds are chosen on labelled holdout rows:
in each stratum, for each rule, the strictest cutoff of a fixed grid whose number of
rejected good documents k satisfies P(Binomial(n, alpha_rule) <= k) <= delta / tests. Then, with
probability 1 - delta over the draw of the holdout, no chosen cutoff rejects more than
alpha_rule of the good documents of its stratum (Bonferroni over strata, rules and
cutoffs), and all rules together no more than alpha. A stratum with too few
labels gets no cutoff, so nothing is rejected there beyond the base rules.

Defined results: a null or empty text has no words and fails the base rules; a null
stratum is a stratum of its own; conflicting labels of one document count as not
good; repeated rows are judged one by one; an empty table gives an empty result.
Trigrams are compared by a 64-bit hash of their three words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread
from . import _work
from ._text import WORD

#: Rule -> cutoffs, strictest first; a document is rejected by a rule if its value is greater.
GRID = {
    "symbol_ratio": (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "dup_line_ratio": (0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "repeat_ratio": (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
    "mean_word_chars": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}
SYMBOLS = "#*$%&|<>"
#: Up to so many strata, cutoffs reach the documents by a broadcast (under 10 MB); beyond, by a join.
BROADCAST_STRATA = 50_000


def _covered(hashes: Column) -> Column:
    """Words in 3-word windows whose hash occurs twice or more; ``hashes`` has one for each window."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(sorted_pairs: Column) -> Column:
        twin = F.filter(sorted_pairs, lambda p, j: (F.get(sorted_pairs, j - 1)["h"] == p["h"]) | (F.get(sorted_pairs, j + 1)["h"] == p["h"]))
        at = F.sort_array(F.transform(twin, lambda p: p["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    return F.get(F.transform(F.array(pairs), count), F.lit(0))


def base_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), text.alias("t")))
    rows = rows.select("doc_id", "stratum", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    n = F.size("w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    rows = rows.select(
        "doc_id", "stratum", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"), hashes.alias("h"),
    )
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(repeated, _covered(F.col("h"))), F.lit(0)).cast("long")).drop("h")


def _judged(stats: DataFrame) -> DataFrame:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return stats.withColumns({"base_failed": failed, "symbol_ratio": per_word("n_symbols"), "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_ratio": per_word("n_repeat_words"), "mean_word_chars": per_word("word_chars")})


def cutoffs(stats: DataFrame, good_ids: DataFrame, *, alpha: float = 0.02, delta: float = 0.05, grid=GRID) -> DataFrame:
    """One row a stratum: its number of good holdout documents, the allowed rejections, a cutoff a rule (null: none)."""
    good = stats.where(~F.col("base_failed")).join(good_ids, "doc_id", "left_semi")
    counts = [F.count_if(F.col(rule) > cut).alias(f"{rule}_{j}") for rule, cuts in grid.items() for j, cut in enumerate(cuts)]
    by = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    tests = F.count(F.lit(1)).over(every) * sum(map(len, grid.values()))
    by = _work.keep(by.withColumn("level", F.lit(delta) / tests), "holdout")
    rate = alpha / len(grid)
    run = W.partitionBy("stratum").orderBy("i")
    # log P(i) - log P(i - 1), summed up: the exact binomial distribution without factorials
    step = F.when(F.col("i") == 0, F.col("n") * F.log(F.lit(1 - rate))).otherwise(F.log((F.col("n") - F.col("i") + 1) / F.col("i")) + F.log(F.lit(rate / (1 - rate))))
    terms = by.select("stratum", "n", "level", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") * rate))).alias("i"))
    terms = terms.withColumn("p", F.exp(F.sum(step).over(run))).withColumn("cdf", F.sum("p").over(run))
    allowed = terms.where("cdf <= level").groupBy("stratum").agg(F.max("i").alias("allowed")).withColumnRenamed("stratum", "a_stratum")
    chosen = by.join(allowed, by["stratum"].eqNullSafe(allowed["a_stratum"]), "left")
    pick = lambda rule, cuts: F.coalesce(*[F.when(F.col(f"{rule}_{j}") <= F.col("allowed"), F.lit(cut)) for j, cut in enumerate(cuts)]).alias(f"cut_{rule}")
    return chosen.select(F.col("stratum").alias("c_stratum"), F.col("n").alias("n_good"), "allowed", *[pick(*x) for x in grid.items()])


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = 0.02, delta: float = 0.05, grid=GRID) -> DataFrame:
    """Base statistics, ratios, base_failed and kept of every document."""
    stats = _work.keep(_judged(base_statistics(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col)), "quality")
    good = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    cuts = _work.keep(cutoffs(stats, good, alpha=alpha, delta=delta, grid=grid), "cutoffs")
    right = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    out = stats.join(right, stats["stratum"].eqNullSafe(cuts["c_stratum"]), "left")
    passed = ~F.col("base_failed")
    for rule in grid:
        passed = passed & F.coalesce(F.col(rule) <= F.col(f"cut_{rule}"), F.lit(True))
    return out.withColumn("kept", passed).drop("c_stratum")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    rate, tests = 0.02 / len(GRID), sum(map(len, GRID.values()))
    counts = ", ".join(f"count(*) FILTER ({rule} > {cut}::DOUBLE) AS {rule}_{j}" for rule, cuts in GRID.items() for j, cut in enumerate(cuts))
    picks = ", ".join("coalesce(" + ", ".join(f"CASE WHEN {rule}_{j} <= allowed THEN {cut}::DOUBLE END" for j, cut in enumerate(cuts)) + f") AS cut_{rule}" for rule, cuts in GRID.items())
    passed = " AND ".join(f"coalesce({rule} <= cut_{rule}, true)" for rule in GRID)
    return f"""
WITH docs AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
stats AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols / greatest(n_words, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word_chars FROM stats),
good AS (
  SELECT j.* FROM judged j WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
held AS (
  SELECT lang, count(*) AS n, {counts} FROM good GROUP BY lang),
terms AS (
  SELECT lang, n, unnest(range(0, CAST(ceil(n * {rate}::DOUBLE) AS BIGINT) + 1)) AS i FROM held),
steps AS (
  SELECT lang, i, exp(sum(CASE WHEN i = 0 THEN n * ln(1 - {rate}::DOUBLE) ELSE ln((n - i + 1) / i) + ln({rate / (1 - rate)}::DOUBLE) END) OVER (PARTITION BY lang ORDER BY i)) AS p FROM terms),
tails AS (
  SELECT lang, i, sum(p) OVER (PARTITION BY lang ORDER BY i) AS cdf FROM steps),
allowed AS (
  SELECT lang, max(i) AS allowed FROM tails WHERE cdf <= 0.05::DOUBLE / ((SELECT count(*) FROM held) * {tests}) GROUP BY lang),
cuts AS (
  SELECT h.lang, {picks} FROM held h LEFT JOIN allowed a ON h.lang IS NOT DISTINCT FROM a.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passed} AS kept
FROM judged j LEFT JOIN cuts c ON j.lang IS NOT DISTINCT FROM c.lang
"""


ORACLE_SQL = _oracle()
