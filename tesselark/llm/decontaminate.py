r"""Operator 4 [native]: benchmark decontamination by winnowing.

Both sides are cut into words (A-Z lowered). From every run of 6 consecutive 5-word hashes the least is kept as a
fingerprint; so any 10 words that a document shares with an item hold a fingerprint kept on both sides (6 + 5 - 1 = 10). An
equi-join of the distinct fingerprints finds the candidate documents. In those the hits are extended: all 10-word windows
are compared with the items' windows by 128-bit hash, and the words that matching windows cover are counted. Items of fewer
than 10 words are one window of their own length; if there are any, all runs of those lengths (at most 9 lengths) are fingerprints.

A small benchmark is broadcast by Spark's own size rule, a large one is joined by shuffle, where only hashes move. The ids of candidates and of
documents with hits are stored tables: while Spark's size rule lets it broadcast them, no text is shuffled. No step gathers the documents of an item, a key or a passage.

Defined cases: null text has no words; rows equal in id and text get equal results; equal item_ids are one item; an item without id counts
under the name "null"; items without words never occur; empty tables give no rows or no hits; all input columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm.common import column, discard, documents, let, own_prefix, text_of, written
from tesselark.llm.line_dedup import lowered
from tesselark.llm.quality_rules import LONGS, windows

SPAN, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def hashed(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def least_of_runs(hashes: Column, run: int) -> Column:
    """The distinct minima of all runs of that many hashes (shorter runs at the end included), by doubling."""

    def step(values: Column, by: int) -> Column:
        return let(values, lambda v: F.transform(v, lambda x, i: F.least(x, F.get(v, i + by))))

    width, out = 1, hashes
    while width * 2 <= run:
        out, width = step(out, width), width * 2
    if width < run:
        out = step(out, run - width)
    return F.array_distinct(out)


def fingerprints(hashes: Column, short: list[int], span: int, gram: int) -> Column:
    """Fingerprints of bound word hashes. Lengths are told apart by mixing them into the hash."""
    kept = least_of_runs(windows(hashes, gram), span - gram + 1)
    marked = lambda n: F.transform(windows(hashes, n), lambda x: F.xxhash64(F.lit(n), x))
    parts = [kept, *map(marked, short)]
    return F.array_distinct(F.concat(*parts)) if short else kept


def all_windows(hashes: Column, others: Column, lengths: list[int]) -> Column:
    """start, length and a 128-bit hash of every run of the given lengths; each half is made from word hashes of its own."""

    def of(n: int) -> Column:
        half = lambda h, i: F.xxhash64(*(F.get(h, i + k) for k in range(n)))
        number = lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), half(hashes, i).alias("w1"), half(others, i).alias("w2"))
        none = F.array().cast("array<struct<at:int,n:int,w1:bigint,w2:bigint>>")
        return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), number)).otherwise(none)

    return F.concat(*map(of, lengths))


def window_rows(words_: Column, lengths: list[int]) -> Column:
    """all_windows() of words, each word hashed twice."""
    return let(words_, lambda w: let(hashed(w), lambda h: let(F.transform(w, lambda x: F.xxhash64(F.lit(1), x)), lambda g: all_windows(h, g, lengths))))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and, as last column, <prefix>hits: struct(n_words, n_hit, items: the sorted item ids as strings); the prefix is own_prefix(docs)."""
    p, text = own_prefix(docs), text_of(text_col)
    key = [F.coalesce(column(id_col).cast("string"), F.lit("null")).alias(f"{p}id"), F.xxhash64(text).alias(f"{p}row")]
    own_key = [f"{p}id", f"{p}row"]
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(text_of("text")).alias("w")).where(F.size("w") > 0)
    items = written(items)
    short = sorted(r[0] for r in items.where(F.size("w") < span).select(F.size("w")).distinct().collect())  # span - 1 numbers at most
    marks = items.select(F.explode(let(hashed(F.col("w")), lambda h: fingerprints(h, short, span, gram))).alias("f")).distinct()

    source = docs.select(*key, F.explode(let(hashed(words(text)), lambda h: fingerprints(h, short, span, gram))).alias("f"))
    candidates = written(source.join(marks, "f").select(*own_key).distinct())

    # second pass: the candidates' windows against the items' windows. What is joined to texts is a stored table of ids, whose size Spark knows: a
    # small one is broadcast by its rule, a large one is joined by shuffle
    lengths = [*short, span]
    own = lambda n: F.when(F.size("w") >= span, F.lit(n == span)).otherwise(F.size("w") == n)
    windows_of = lambda n: items.where(own(n)).select("item", F.explode(window_rows(F.col("w"), [n])).alias("w"))
    item_windows = reduce(DataFrame.unionByName, map(windows_of, lengths)).select("item", "w.n", "w.w1", "w.w2").groupBy("n", "w1", "w2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    candidates = docs.select(*key, text.alias("text")).join(candidates, own_key, "left_semi")
    spread = candidates.select(*own_key, F.explode(window_rows(words(F.col("text")), lengths)).alias("w"))
    spread = spread.select(*own_key, "w.at", "w.n", "w.w1", "w.w2")
    hits = spread.join(item_windows, ["n", "w1", "w2"]).groupBy(*own_key).agg(F.collect_set(F.struct("at", "n")).alias("runs"), F.collect_set("items").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1))))
    hits = written(hits.select(*own_key, F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")))
    discard(items)
    n_words = F.size(words(text)).cast("long")
    joined = docs.withColumns(dict(zip(own_key, key, strict=True))).join(hits.withColumnsRenamed({"n_hit": f"{p}n_hit", "items": f"{p}items"}), own_key, "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *map(column, docs.columns),
        F.struct(n_words.alias("n_words"), F.coalesce(f"{p}n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(f"{p}items", none).alias("items")).alias(f"{p}hits"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    x = column(out.columns[-1])
    return out.select(
        "doc_id", x["n_words"].alias("n_words"), x["n_hit"].alias("n_hit"), F.size(x["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(x["items"], ",").cast("binary"), 256).alias("items_sha256"), (x["n_hit"] > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iwin AS (
  SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, d.n, i, item_id FROM dwin d JOIN iwin USING (n, win)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""
