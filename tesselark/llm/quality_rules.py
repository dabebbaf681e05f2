"""Operator 9 [native]: base text statistics and a hashed n-gram log-likelihood ratio.

Every text's words and word pairs are hashed into a fixed number of features. Two multinomials with additive smoothing are
estimated: one over the whole corpus, one over the trusted documents. A document's verdict is the mean over its
features of log(trusted / corpus); it is kept if that mean is at least a fixed threshold, so every document gets the same
verdict on every run.

The trusted ids (quality 1, toxic 0 in ``labels``) are a documented bounded sample, ``max_trusted`` ids of least
hash; so they may be broadcast. Everything else covers the whole corpus. The feature table has ``n_features``
numbers whatever the input, and reaches the scoring pass as a scalar subquery. Texts are never shuffled.

Defined cases: null and empty texts have no words, fail the base rule and are not kept; repeated rows count as often as they
occur; a table without labels keeps what passes the base rule; an empty table gives no rows; all columns of the input stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm.common import WHITE, WHITE_RUN, column, documents, let, own_prefix, text_of

N_FEATURES, MAX_TRUSTED, SMOOTHING, THRESHOLD = 1 << 14, 20_000, 1.0, -0.08
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS = 5, 10
LONGS = "array<bigint>"


def word_hashes(text: Column) -> Column:
    """The 64-bit hash of each word, in order; no element for a text without words."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast(LONGS)).otherwise(F.transform(F.split(trimmed, WHITE_RUN), lambda w: F.xxhash64(w)))


def windows(hashes: Column, size: int) -> Column:
    """The hash of each run of size words; hashes must be a bound variable or a column that is not computed here."""
    return F.when(
        F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))))
    ).otherwise(F.array().cast(LONGS))


def _covered(starts: Column, size: int) -> Column:
    """How many positions runs of size from these ascending starts cover."""
    steps = F.transform(starts, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - x, F.lit(size))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words that lie in a run of size words which occurs twice or more."""

    def in_repeats(all_: Column) -> Column:
        ordered = F.sort_array(F.transform(all_, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j) ["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])

        return let(F.sort_array(let(ordered, starts)), lambda p: _covered(p, size))

    return let(windows(hashes, size), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(in_repeats(h)))


def text_counts(text: Column) -> Column:
    """struct(word_chars, n_symbols, n_dup_lines) of a text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return F.struct(
        F.length(F.regexp_replace(text, WHITE_RUN, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def verdict(text: Column, table: Column, n_features: int, threshold: float) -> Column:
    """struct(n_words, n_repeat_words, base_failed, ratio, kept). One expression that hashes the words once: what is bound here is not written out
    again for each field, also where a filter on kept is moved below a projection."""
    total = lambda t, f: F.aggregate(f, F.lit(0.0), lambda a, x: a + F.get(t, x))
    ratio = lambda h: let(features(h, n_features), lambda f: let(table, lambda t: total(t, f)) / F.greatest(F.size(f), F.lit(1)))
    base = lambda h: F.struct(F.size(h).cast("long").alias("n"), repeated_words(h).alias("repeat"), ratio(h).alias("ratio"))

    def whole(x: Column) -> Column:
        failed = (x["n"] < LEAST_WORDS) | (100 * x["repeat"] > 20 * x["n"])
        kept = ~failed & (x["ratio"] >= threshold)
        return F.struct(x["n"].alias("n_words"), x["repeat"].alias("n_repeat_words"), failed.alias("base_failed"), x["ratio"].alias("ratio"), kept.alias("kept"))

    return let(word_hashes(text), lambda h: let(base(h), whole))


def features(hashes: Column, n_features: int) -> Column:
    """Feature numbers of all words and all word pairs; hashes as in windows()."""
    number = lambda x: F.pmod(x, F.lit(n_features)).cast("int")
    return F.concat(F.transform(hashes, number), F.transform(windows(hashes, 2), number))


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col("doc_id").alias("_tk_id")).distinct()
    return good.orderBy(F.xxhash64("_tk_id"), "_tk_id").limit(max_trusted)


def feature_ratios(docs: DataFrame, trusted: DataFrame, n_features: int = N_FEATURES, smoothing: float = SMOOTHING, text_col: str = "text") -> DataFrame:
    """One row, one column: log(trusted / corpus) for each feature; zeros if nothing is trusted. trusted is bounded (see trusted_ids)."""
    marked = docs.select(F.col("doc_id").alias("_tk_doc"), text_of(text_col).alias("_tk_text")).join(F.broadcast(trusted.withColumn("_tk_trusted", F.lit(1))), F.col("_tk_doc") == F.col("_tk_id"), "left")
    each = marked.select(F.coalesce("_tk_trusted", F.lit(0)).alias("t"), F.explode(let(word_hashes(F.col("_tk_text")), lambda h: features(h, n_features))).alias("f"))
    counts = each.groupBy("f").agg(F.count(F.lit(1)).alias("corpus"), F.sum("t").alias("trusted"))
    spread = docs.sparkSession.range(n_features).select(F.col("id").cast("int").alias("f")).join(counts, "f", "left").na.fill(0)
    table = spread.agg(F.sort_array(F.collect_list(F.struct("f", "corpus", "trusted"))).alias("x"), F.sum("corpus").alias("nc"), F.sum("trusted").alias("nt"))
    share = lambda n, total: F.log((n + smoothing) / (total + smoothing * n_features))
    ratio = F.transform("x", lambda x: F.when(F.col("nt") == 0, 0.0).otherwise(share(x["trusted"], F.col("nt")) - share(x["corpus"], F.col("nc"))))
    return table.select(ratio.alias("ratios"))


def quality_rules(docs: DataFrame, labels: DataFrame, n_features: int = N_FEATURES, max_trusted: int = MAX_TRUSTED, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs and two struct columns in the end, <prefix>counts as text_counts() and <prefix>verdict as verdict(); the prefix is own_prefix(docs)."""
    p, text = own_prefix(docs), text_of(text_col)
    ratios = feature_ratios(docs, trusted_ids(labels, max_trusted), n_features, text_col=text_col).scalar()
    scored = docs.withColumn(f"{p}table", ratios)
    return scored.select(*map(column, docs.columns), text_counts(text).alias(f"{p}counts"), verdict(text, F.col(f"{p}table"), n_features, threshold).alias(f"{p}verdict"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    counts, own = (column(c) for c in out.columns[-2:])
    return out.select(
        "doc_id", own["n_words"].alias("n_words"), *(counts[x].alias(x) for x in ("word_chars", "n_symbols", "n_dup_lines")), *(own[x].alias(x) for x in ("n_repeat_words", "base_failed", "kept", "ratio"))
    )
