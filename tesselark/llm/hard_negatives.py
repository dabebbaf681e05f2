"""Operator 11: hard-negative mining over a vector-approximation file.

Components become integers, floor(scale * x), so scores (inner products) are exact. The file holds for each row its vector and its
approximation: each dimension is quantised into 16 cells, two cells to a byte. Cell borders are quantiles of a bounded sample
(MARKS_VALUES component values); every row is approximated. For a block of anchors a table holds, for each byte of the approximation and
each of its 256 values, the least and the greatest share of the score that these two cells allow, so a row's lower and upper bound are
sums of table entries. A row is scored exactly only if its bounds let it enter the anchor's best positives, or one of its windows.

Two scans, each a grid of blocks: all rows are dealt into blocks, the anchors (a stated query set) into blocks, and each pair of blocks is
one group of bounded size. The first scan finds an anchor's positives: the best rows of its own label. A positive's score sets a window,
low * positive <= 100 * negative <= high * positive; the second scan finds the best rows of other labels in each window. A block gives at most
as many rows as are asked for, the kth best lower bound so far being the least score still of use, and the blocks' rows are merged by rank.
No block is of one label, so a frequent label or vector is spread like the others.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part; a row without id takes part, is no
anchor, comes last among ties and is returned with a null id; rows of equal id are separate rows, ties among them broken by their place in
the file; missing components of shorter vectors count as 0, an empty vector scores 0 with all; a positive with a negative score has no
negatives; scores beyond 2^55 either way count as 2^55; an empty table gives no rows; extra columns are ignored. Vectors hold no text; a vector
of very many dimensions makes blocks of fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselark.llm.common import stored_again, written

CELLS = 16
#: Component values of the sample that cell borders are taken from, at most (100 rows at least).
MARKS_VALUES = 1 << 20
#: Bytes of the rows' vectors in one block at most (1,024 rows at least); a block of anchors holds half as many rows.
BLOCK_BYTES = 32 << 20
#: Rows and anchors that are bounded at once within a block, and pairs that are scored at once.
ROWS_AT_ONCE, ANCHORS_AT_ONCE, PAIRS_AT_ONCE = 2048, 64, 1 << 15
NO_ID = (1 << 63) - 1
LARGEST = 1 << 55
FILE = "row long, vec_id long, label long, anchor boolean, cells binary, vector array<double>"


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows of a float64 matrix, zeros where a vector is shorter than dims."""
    n, values = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(n), dims))
    at = np.repeat(np.arange(len(n)), n)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def integers(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * values.astype("float64"))


def vector_file(vectors: DataFrame, anchor: Column, scale: float) -> tuple[DataFrame, np.ndarray]:
    """FILE, stored, and the borders between each dimension's cells (dimensions x 15, whole numbers)."""
    finite = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    dims = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    sample = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "embedding").limit(max(100, MARKS_VALUES // dims)).toArrow()["embedding"].combine_chunks()
    known = integers(matrix(sample, dims), scale) if len(sample) else np.zeros((1, dims))
    marks = np.ceil(np.quantile(known, np.arange(1, CELLS) / CELLS, axis=0).T)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(matrix(b["embedding"], dims), scale)
            cells = np.zeros((len(x), dims + dims % 2), dtype="uint8")
            for d in range(dims):
                cells[:, d] = np.searchsorted(marks[d], x[:, d], side="right")
            packed = cells[:, ::2] * CELLS + cells[:, 1::2]
            offsets = pa.array(np.arange(len(x) + 1) * dims, pa.int32())
            columns = [b["row"], b["vec_id"], b["label"], b["anchor"], pa.array([p.tobytes() for p in packed], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "label", "anchor", "cells", "vector"])

    return written(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(approximate, FILE)), marks


class Block:
    """Rows of one block: ids, labels, vectors, and approximations with one line for each byte."""

    def __init__(self, rows: pa.Table, dims: int):
        rows = rows.combine_chunks().sort_by("label")
        self.row, self.vec_id, self.label = (rows[c].to_numpy() for c in ("row", "vec_id", "label"))
        self.x = matrix(rows["vector"].combine_chunks(), dims) if len(rows) else np.zeros((0, dims))
        self.cells = np.frombuffer(b"".join(rows["cells"].to_pylist()), dtype="uint8").reshape(len(rows), -1).T.astype("intp") if len(rows) else None
        self.extent = (self.x.min(axis=0), self.x.max(axis=0)) if len(rows) else None


def tables(queries: np.ndarray, block: Block, marks: np.ndarray) -> np.ndarray:
    """Least and greatest shares of the score: a table of 256 x (2 x queries) for each byte of an approximation. A cell reaches from its border to
    the whole number before the next; the outer cells reach to the block's least and greatest component."""
    low, high = block.extent
    lows = np.column_stack([np.minimum(low, marks[:, 0]), marks])
    highs = np.column_stack([marks - 1, np.maximum(high, marks[:, -1])])
    a, b = queries[:, :, None] * lows, queries[:, :, None] * highs
    parts = np.concatenate([np.minimum(a, b), np.maximum(a, b)])
    if parts.shape[1] % 2:
        parts = np.concatenate([parts, np.zeros((len(parts), 1, CELLS))], axis=1)
    pairs = parts[:, ::2, :, None] + parts[:, 1::2, None, :]
    whole = "int32" if np.abs(pairs).max(axis=(0, 2, 3)).sum() < 1 << 30 else "float64"
    return np.ascontiguousarray(pairs.reshape(len(parts), -1, CELLS * CELLS).transpose(1, 2, 0).astype(whole))


def bounds(table: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, rows x queries."""
    out = table[0][cells[0]]
    for share, c in zip(table[1:], cells[1:], strict=True):
        out += share[c]
    n = out.shape[1] // 2
    return out[:, :n], out[:, n:]


def exact_in_double(x: np.ndarray, y: np.ndarray) -> bool:
    return len(x) == 0 or len(y) == 0 or float((np.abs(x).max(axis=0) * np.abs(y).max(axis=0)).sum()) < float(1 << 52)


def scores(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the pairs (x[i], y[j]) as whole numbers."""
    out = np.empty(len(i), dtype="int64")
    for at in range(0, len(i), PAIRS_AT_ONCE):
        own = slice(at, at + PAIRS_AT_ONCE)
        if exact:
            out[own] = np.einsum("ij,ij->i", x[i[own]], y[j[own]])
        else:
            out[own] = [max(-LARGEST, min(LARGEST, sum(int(a) * int(b) for a, b in zip(x[p], y[q], strict=True)))) for p, q in zip(i[own], j[own], strict=True)]
    return out


def kth(best: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The k best lower bounds of each query so far (k x queries, in any order), with those of further rows."""
    k, both = len(best), np.concatenate([best, lower])
    return np.partition(both, len(both) - k, axis=0)[len(both) - k :]


def first(found: dict[str, np.ndarray], by: list[str], k: int) -> dict[str, np.ndarray]:
    """The first k rows of each group: higher scores, then smaller ids, then earlier rows."""
    order = np.lexsort([found["row"], found["vec_id"], -found["score"], *(found[c] for c in reversed(by))])
    found = {c: v[order] for c, v in found.items()}
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([found[c][1:] != found[c][:-1] for c in by], axis=0)
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return {c: v[place < k] for c, v in found.items()}


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def scan(block: Block, y: np.ndarray, windows: np.ndarray, marks: np.ndarray, k: int, allowed, chosen: np.ndarray) -> dict[str, np.ndarray]:
    """The first k rows in each window of each anchor: q, w, score, vec_id, row. y: the anchors' vectors; windows: anchors x windows x (least, greatest
    score); chosen: the block's rows to look at; allowed(rows, q): which rows may be returned for which anchor (rows x anchors)."""
    exact, n_windows = exact_in_double(block.x, y), windows.shape[1]
    empty = {c: np.empty(0, dtype="int64") for c in ("q", "w", "score", "vec_id", "row")}
    everything = [empty]
    for start in range(0, len(y), ANCHORS_AT_ONCE):
        q = np.arange(start, min(len(y), start + ANCHORS_AT_ONCE))
        low, high = windows[q, :, 0], windows[q, :, 1]
        table = tables(y[q], block, marks) if exact and len(chosen) else None
        best = np.full((n_windows, k, len(q)), -float("inf"))
        found = empty
        for at in range(0, len(chosen), ROWS_AT_ONCE):
            rows = chosen[at : at + ROWS_AT_ONCE]
            may = allowed(rows, q)
            if exact:
                lower, upper = bounds(table, block.cells[:, rows])
                possible = np.zeros_like(may)
                for w in range(n_windows):
                    sure = may & (lower >= low[:, w]) & (upper <= high[:, w])
                    if sure.any():
                        best[w] = kth(best[w], np.where(sure, lower, -float("inf")))
                    possible |= (upper >= np.maximum(low[:, w], best[w].min(axis=0))) & (lower <= high[:, w])
                may &= possible
            i, j = np.nonzero(may)
            s = scores(block.x, y, rows[i], q[j], exact)
            parts = [found]
            for w in range(n_windows):
                own = (s >= low[j, w]) & (s <= high[j, w])
                at_rows = rows[i[own]]
                parts.append({"q": q[j[own]], "w": np.full(len(at_rows), w), "score": s[own], "vec_id": block.vec_id[at_rows], "row": block.row[at_rows]})
            found = first(joined(parts), ["q", "w"], k)
        everything.append(found)
    return joined(everything)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. vectors: vec_id, embedding, label; anchor: tells the anchors."""
    spark = vectors.sparkSession
    file, marks = vector_file(vectors, anchor, scale)
    dims = len(marks)
    n, n_anchors = file.agg(F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1))).first()
    block_rows = max(1024, BLOCK_BYTES // (8 * dims))
    n_blocks = max(-(-n // block_rows), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    n_parts = max(1, -(-n_anchors // (block_rows // 2)))
    own, part = F.pmod(F.xxhash64("row"), F.lit(n_blocks)), F.pmod(F.xxhash64("row"), F.lit(n_parts))
    copies = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def grid(queries: DataFrame, run, schema: str) -> DataFrame:
        """run(block's rows, anchors) for each pair of blocks."""
        left = file.select("row", "vec_id", "label", "cells", "vector", own.cast("int").alias("block"), copies(n_parts).alias("part"))
        right = queries.select("*", part.cast("int").alias("part"), copies(n_blocks).alias("block"))
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)

    def best_positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        """An anchor is a row of its own label: only rows of that label are looked at, one label at a time."""
        block, queries = Block(rows, dims), anchors.combine_chunks()
        y, label, row = matrix(queries["vector"].combine_chunks(), dims) if len(queries) else np.zeros((0, dims)), queries["label"].to_numpy(), queries["row"].to_numpy()
        parts = []
        for x in np.unique(label):
            q = np.flatnonzero(label == x)
            chosen = np.arange(np.searchsorted(block.label, x, side="left"), np.searchsorted(block.label, x, side="right"))
            every = np.broadcast_to(np.array([-float("inf"), float("inf")]), (len(q), 1, 2))
            found = scan(block, y[q], every, marks, positives, lambda rows, at, q=q: block.row[rows][:, None] != row[q[at]][None, :], chosen)
            parts.append({**found, "q": q[found["q"]]})
        found = joined(parts) if parts else {c: np.empty(0, dtype="int64") for c in ("q", "score", "vec_id", "row")}
        q = pa.array(found["q"])
        return pa.table({"anchor_row": queries["row"].take(q), "anchor_id": queries["vec_id"].take(q), "positive_id": found["vec_id"], "positive_score": found["score"], "row": found["row"]})

    def best_negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        block, queries = Block(rows, dims), anchors.combine_chunks()
        y, label = matrix(queries["vector"].combine_chunks(), dims) if len(queries) else np.zeros((0, dims)), queries["label"].to_numpy()
        kinds = [sorted(x) for x in queries["positive_scores"].to_pylist()]
        windows = np.empty((len(kinds), positives, 2))
        windows[:] = [1, 0]  # no score lies in it
        for a, known in enumerate(kinds):
            for w, p in enumerate(known):
                windows[a, w] = -(-low * p // 100), high * p // 100
        found = scan(block, y, windows, marks, negatives, lambda rows, at: block.label[rows][:, None] != label[at][None, :], np.arange(len(block.row)))
        score = pa.array([kinds[a][w] for a, w in zip(found["q"], found["w"], strict=True)], pa.int64())
        return pa.table({"anchor_row": queries["row"].take(pa.array(found["q"])), "positive_score": score, "negative_id": found["vec_id"], "negative_score": found["score"], "row": found["row"]})

    anchors = stored_again(file).where("anchor").select("row", "vec_id", "label", "vector")
    near = grid(anchors, best_positives, "anchor_row long, anchor_id long, positive_id long, positive_score long, row long")
    place = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "row"))
    near = written(near.withColumn("place", place).where(F.col("place") <= positives).select("anchor_row", "anchor_id", "positive_id", "positive_score"))
    wanted = near.where("positive_score >= 0").groupBy(F.col("anchor_row").alias("row")).agg(F.collect_set("positive_score").alias("positive_scores"))
    far = grid(anchors.join(wanted, "row"), best_negatives, "anchor_row long, positive_score long, negative_id long, negative_score long, row long")
    rank = F.row_number().over(Window.partitionBy("anchor_row", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "row"))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives).drop("row")
    out = near.join(far, ["anchor_row", "positive_score"])
    named = lambda c: F.nullif(c, F.lit(NO_ID)).alias(c)
    return out.select("anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS rid
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, b.vec_id, b.rid, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM clean a JOIN clean b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0
), near AS (
  SELECT arid, anchor_id, vec_id AS positive_id, score AS positive_score, rid AS prid FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) <= 5
), far AS (
  SELECT n.anchor_id, n.positive_id, s.vec_id AS negative_id, n.positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY n.arid, n.prid ORDER BY s.score DESC, s.vec_id, s.rid) AS rank
  FROM near n JOIN scored s ON s.arid = n.arid AND NOT s.same AND 30 * n.positive_score <= 100 * s.score AND 100 * s.score <= 90 * n.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM far WHERE rank <= 10
"""
