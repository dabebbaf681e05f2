"""Operator 5: n-gram Jaccard self-join, size-aware heavy-light.

Documents are sets of word shingles; two link when 100 * intersection >= 80 * union. The result is each
document's component.

Light sets (at most ``boundary`` shingles): for sizes i and j a link needs an overlap of o = ceil(4 (i + j) / 9); every
subset of that fixed size o is enumerated and an equal subset is a link. Heavy sets: inverted lists are scanned. The boundary is
where enumeration stops being cheaper, computed from the histogram of small sizes.

Keeping the lists short, all exactly:
* Equal sets are one class and only its least id goes on.
* Shingles are ordered by hash. Linked sets must share at least L of their first P shingles (adaptive prefix bound). Where a
  document shares fewer than L of its own P with anybody, it has no link; most documents end here, before their texts move.
  Shingles that many documents of one task hold are counted there and shuffled as one row, so no frequent shingle gathers its documents.
* Of the remaining sets all shingles are counted; sets with fewer than 4/5 shared ones end here, the others index their rarest shared ones.
* Lists are scanned in rounds: each list pairs its members with one pivot, pairs are verified by exact intersection, components
  are formed, and lists within one component are dropped. When pivots stop paying, every pair of different components that a list
  still holds (the list's main component is never paired with itself) is verified. So no link between
  components is lost, and copies are not paired among themselves.

Shuffled: about a quarter of the shingle hashes, the texts once (to meet the ids that remain, unless these are few enough to be broadcast), and the remaining sets.

Defined cases: null text or one without words is the empty set and links with nothing; a text of fewer than five words is one
shingle; rows of equal doc_id are one document, its text that of the row with the largest set (of equal sizes, of the
larger hashes); rows without doc_id are one such document, and it stands as the last id, 9223372036854775807, where it is named by
component_id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselark.llm.common import column, discard, documents, temporary, text_of, written
from tesselark.llm.components import components
from tesselark.llm.line_dedup import LAST_ID

SHINGLE, EXTRA, FREQUENT, CHUNK_TOKENS, KNOWN_WORDS = 5, 12, 32, 400_000, 300_000
MAX_BOUNDARY, LIST_ROW_COST, MAX_ROUNDS = 20, 6.0, 6
BIT_WORDS = ("w0", "w1", "w2", "w3")
MULTIPLIER, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * MIX1
    v = (v ^ (v >> np.uint64(27))) * MIX2
    return v ^ (v >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; word hashes are kept for at most KNOWN_WORDS words."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.number, self.hashes = size, {}, array("Q")

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        # bytes.split() and bytes.lower() know ASCII only, which is the contract's word rule
        words = [t.encode("utf-8").lower().split() for t in texts]
        flat = [w for x in words for w in x]
        new = set(flat).difference(self.number)
        if len(self.number) + len(new) > KNOWN_WORDS:
            self.number, self.hashes, new = {}, array("Q"), set(flat)
        for w in new:
            self.number[w] = len(self.hashes)
            self.hashes.append(xxhash.xxh3_64_intdigest(w))
        codes = np.fromiter(map(self.number.__getitem__, flat), dtype=np.int64, count=len(flat))
        h = np.frombuffer(self.hashes, dtype=np.uint64)[codes] if flat else np.empty(0, np.uint64)
        n = max(0, len(h) - self.size + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(self.size):
            runs = runs * MULTIPLIER + h[k : k + n]
        runs, out, at = mixed(runs), [], 0
        for x in words:
            if len(x) >= self.size:
                out.append(np.unique(runs[at : at + len(x) - self.size + 1]))
            else:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(x) + b"\n")] * bool(x), dtype=np.uint64))
            at += len(x)
        return out


def prefix_length(n: int, extra: int = EXTRA) -> int:
    """P: how many of n shingles (by hash) are looked at."""
    return min(n, n - -(-4 * n // 5) + max(1, n // extra))


def needed(n: int, extra: int = EXTRA) -> int:
    """L: how many of them any linked set shares; the partner may be as small as 4 n / 5."""
    return max(1, -(-4 * n // 5) // extra)


def overlap(i: int, j: int) -> int:
    """The least intersection of linked sets of sizes i and j."""
    return -(-4 * (i + j) // 9)


def partners(n: int) -> range:
    """Sizes that a set of size n can link with."""
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def subset_cost(n: int, boundary: int) -> int:
    return sum(math.comb(n, overlap(n, j)) for j in partners(n) if j <= boundary and overlap(n, j) <= min(n, j))


def boundary_by_cost(histogram: dict[int, int]) -> int:
    """The largest light size: the one of least cost in rows to enumerate (light) and rows to index and verify (heavy)."""
    cost = lambda b: sum(
        c * ((subset_cost(n, b) if n <= b else 0) + (prefix_length(n) * LIST_ROW_COST if n > 4 * b // 5 else 0)) for n, c in histogram.items()
    )
    return min(range(MAX_BOUNDARY + 1), key=lambda b: (cost(b), b))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def parities(s: np.ndarray) -> dict[str, int]:
    """256 bits, each telling whether an odd number of elements fall on it."""
    odd = np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return dict(zip(BIT_WORDS, np.packbits(odd.astype(np.uint8)).view(np.int64).tolist(), strict=True))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document a row (key: id) with info; per set and chunk of texts one row (key: the set's first hash) with the length of its prefix as w, and
    one for each shingle of the prefix, but those that FREQUENT sets of the chunk share are one row without key."""
    shingler = Shingler()
    info_type = pa.struct([("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())])
    schema = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("w", pa.int32()), ("info", info_type)])
    ids, infos, tokens, owners, seen, size = [], [], [], [], {}, 0

    def rows(token: np.ndarray, key: np.ndarray | None, w: np.ndarray | None, info: pa.Array | None) -> pa.RecordBatch:
        n = len(token)
        columns = [pa.nulls(n, f.type) if x is None else pa.array(x, f.type) for x, f in zip((key, w, info), list(schema)[1:], strict=True)]
        return pa.RecordBatch.from_arrays([_signed(token), *columns], schema=schema)

    def flush() -> Iterator[pa.RecordBatch]:
        all_tokens = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
        all_owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
        sets = np.array([s1 for s1, _ in seen], dtype=np.int64)
        _, back, times = np.unique(all_tokens, return_inverse=True, return_counts=True)
        often = times[back] >= FREQUENT
        lengths = np.bincount(all_owners, minlength=len(sets)).astype(np.int32)
        spread = lambda x: mixed(x.view(np.uint64) + MULTIPLIER)  # noqa: E731  these rows go anywhere
        own = np.array(ids, dtype=np.int64)
        yield rows(spread(own), own, None, pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*infos, strict=True), info_type, strict=True)], fields=list(info_type)))
        yield rows(spread(sets), sets, lengths, None)
        yield rows(all_tokens[~often], sets[all_owners[~often]] if len(sets) else np.empty(0, np.int64), None, None)
        yield rows(np.unique(all_tokens[often]), None, None, None)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, s in zip(part["id"].to_pylist(), shingler.sets(part["text"].to_pylist()), strict=True):
                s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64).tolist()
                if len(s) and (s1, s2) not in seen:
                    p = s[: prefix_length(len(s))]
                    tokens.append(p)
                    owners.append(np.full(len(p), len(seen), dtype=np.int64))
                    seen[s1, s2] = True
                    size += len(p)
                ids.append(doc_id)
                infos.append((len(s), s1, s2))
            if size >= CHUNK_TOKENS or len(ids) >= CHUNK_TOKENS:
                yield from flush()
                ids, infos, tokens, owners, seen, size = [], [], [], [], {}, 0
    if ids:
        yield from flush()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets that the classes name; a task gives one row an id."""
    shingler, given = Shingler(), set()
    bits = pa.struct([(k, pa.int64()) for k in BIT_WORDS])
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("bits", bits), ("shingles", pa.list_(pa.int64()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for doc_id, s1, s2, s in zip(*(part[c].to_pylist() for c in ("id", "s1", "s2")), shingler.sets(part["text"].to_pylist()), strict=True):
                if doc_id not in given and tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64).tolist()) == (s1, s2):
                    given.add(doc_id)
                    rows.append((doc_id, len(s), parities(s), s.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _subset_rows(boundary: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                part = batch.slice(at, 64)
                for doc_id, n, shingles in zip(part["id"].to_pylist(), part["n"].to_pylist(), part["shingles"].to_pylist(), strict=True):
                    for j in partners(n):
                        o = overlap(n, j)
                        if j <= boundary and o <= min(n, j):
                            for c in combinations(shingles, o):
                                k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(np.array(c, dtype=np.int64).tobytes()), dtype=np.int64)
                                out.append({"lo": min(n, j), "hi": max(n, j), "k1": int(k1), "k2": int(k2), "id": doc_id, "n": n})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("lo", pa.int32()), ("hi", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("n", pa.int32())])
    return rows


def light_links(sets: DataFrame, boundary: int) -> DataFrame:
    """Links a, b among sets of at most boundary shingles: all holders of a subset link to the least holder of the other size."""
    key = ["lo", "hi", "k1", "k2"]
    rows = sets.where(F.col("n") <= boundary).mapInArrow(_subset_rows(boundary), "lo int, hi int, k1 long, k2 long, id long, n int")
    heads = rows.groupBy(*key).agg(F.min(F.when(F.col("n") == F.col("lo"), F.col("id"))).alias("first"), F.min(F.when(F.col("n") == F.col("hi"), F.col("id"))).alias("last"))
    heads = heads.where("first is not null and last is not null")
    other = F.when(F.col("n") == F.col("lo"), F.col("last")).otherwise(F.col("first"))
    return rows.join(heads, key).select(F.col("id").alias("a"), other.alias("b")).where("a <> b").distinct()


def index_rows(sets: DataFrame, boundary: int) -> DataFrame:
    """token, id, n, bits, pos: the rarest shared shingles of each set that may link with a heavy one, and their places in the set.

    In the order of (how many sets hold it, hash), linked sets share one of their first n - ceil(4 n / 5) + 1 shingles. Those that no other
    set holds come first and pair nobody; a set with fewer than ceil(4 n / 5) others has no link."""
    heavy = sets.where(F.col("n") > 4 * boundary // 5)
    rows = heavy.select("id", F.explode("shingles").alias("token"))
    # stored, so that the join below is one of plain shuffles, whose long lists adaptive execution splits
    shared = written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 2"))
    own = Window.partitionBy("id")
    least = F.ceil(4 * F.col("n") / 5)
    rows = rows.join(shared.hint("merge"), "token").withColumn("cnt", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "token")))
    rows = rows.join(heavy.select("id", "n", "bits").hint("merge"), "id").where((F.col("cnt") >= least) & (F.col("rank") <= F.col("cnt") - least + 1))
    return rows.select("token", "id", "n", "bits", (F.col("n") - F.col("cnt") + F.col("rank")).cast("int").alias("pos"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs a, b that link."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")).hint("merge")
    both = F.size(F.array_intersect("s_a", "s_b"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("both", both)
    return joined.where(100 * F.col("both") >= 80 * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b").distinct()


def may_link(a: Column, b: Column, boundary: int) -> Column:
    """Whether two index rows of a token may be of linked sets of which one is heavy. No linked pair is lost: at the first token that
    two sets share, what follows in either must hold the rest of the overlap; and of two bit maps of parities, no
    more bits differ than elements of the sets do."""
    both = a["n"] + b["n"]
    sizes = (5 * F.least(a["n"], b["n"]) >= 4 * F.greatest(a["n"], b["n"])) & (F.greatest(a["n"], b["n"]) > boundary)
    rest = 9 * (1 + F.least(a["n"] - a["pos"], b["n"] - b["pos"])) >= 4 * both
    differ = sum((F.bit_count(a["bits"][k].bitwiseXOR(b["bits"][k])) for k in BIT_WORDS[1:]), F.bit_count(a["bits"][BIT_WORDS[0]].bitwiseXOR(b["bits"][BIT_WORDS[0]])))
    return sizes & rest & (9 * differ <= both)


def heavy_links(index: DataFrame, sets: DataFrame, boundary: int, links: DataFrame) -> DataFrame:
    """links and those that the inverted lists add, until no list holds a link between two components."""
    previous = None
    for turn in range(MAX_ROUNDS + 1):
        known = components(links)
        rows = index.join(known.hint("merge"), "id", "left").select("token", F.struct("id", "n", "bits", "pos", F.coalesce("component", "id").alias("c")).alias("x"))
        order = F.col("x.id") if turn == 0 else F.xxhash64(F.lit(turn), "x.id")
        # lists and main are stored, so that they are joined to the rows by plain shuffles, whose long lists adaptive execution splits
        lists = written(rows.groupBy("token").agg(F.min_by("x", F.struct(order, "x.id")).alias("pivot"), F.min("x.c").alias("c0"), F.max("x.c").alias("c1")).where("c0 <> c1").drop("c0", "c1"))
        rows = written(rows.join(lists, "token"))
        sizes = rows.groupBy("token", "x.c").agg(F.count(F.lit(1)).alias("k"))
        main = written(sizes.groupBy("token").agg(F.max(F.struct("k", "c")).alias("main"), F.sum("k").alias("all")))
        left, listed = main.select(F.sum((F.col("all") - F.col("main.k")) * F.col("all")), F.sum("all")).first()
        if not left:
            discard(rows, lists, main)
            return links
        # left: pairs to come if every list were finished now; go on with pivots while those are many and at least halve each time
        final = left <= 4 * listed or turn == MAX_ROUNDS or (previous is not None and 2 * left > previous)
        if final:
            minor = rows.join(main.select("token", F.col("main.c").alias("main")), "token").where(F.col("x.c") != F.col("main")).select("token", F.col("x").alias("y"))
            pairs = rows.select("token", "x").join(minor, (rows["token"] == minor["token"]) & (F.col("x.c") != F.col("y.c")) & may_link(F.col("x"), F.col("y"), boundary))
        else:
            pairs = rows.withColumn("y", F.col("pivot")).where((F.col("x.c") != F.col("y.c")) & may_link(F.col("x"), F.col("y"), boundary))
        pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        added = verified(pairs, sets)
        old, links, previous = links, written(links.unionByName(added).distinct()), left
        discard(rows, lists, main, old)
        if final:
            return links
    return links


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    with temporary() as keep:
        sizes, found = map(keep, _joined(docs, id_col, text_col))
    sizes = sizes.where("doc").select(F.col("key").alias("id"), F.col("info.n").cast("long").alias("n_shingles"))
    return sizes.join(found, "id", "left").select(F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _joined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: what is known of documents and sets, and the components of documents that have links."""
    source = docs.select(F.coalesce(column(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text_of(text_col).alias("text"))
    first = source.mapInArrow(_first_pass, "token long, key long, w int, info struct<n:int,s1:long,s2:long>")
    # a shingle that one set holds is that set's own; a set shares what is left of its prefix. Rows of a shingle are added up before they are shuffled
    kind = F.when(F.col("info").isNotNull(), 1).when(F.col("w").isNotNull(), 2).otherwise(0)
    weight = F.when(kind > 0, F.coalesce("w", F.lit(1))).when(F.col("key").isNull(), FREQUENT).otherwise(1)
    counted = first.select(kind.cast("byte").alias("kind"), F.when(kind == 0, F.col("token")).otherwise(F.col("key")).alias("of"), "info.n", "info.s1", "info.s2", F.when(kind == 0, F.col("key")).alias("key"), weight.cast("int").alias("weight"))
    counted = counted.groupBy("kind", "of", "n", "s1", "s2").agg(F.sum("weight").alias("sum"), F.min("key").alias("key")).where("kind > 0 or sum = 1")
    is_doc = F.col("kind") == 1
    shares = counted.select(is_doc.alias("doc"), F.when(F.col("kind") > 0, F.col("of")).otherwise(F.col("key")).alias("key"), F.when(is_doc, F.struct("n", "s1", "s2")).alias("info"), F.when(F.col("kind") > 0, F.col("sum")).otherwise(-1).alias("sum"))
    both = written(shares.groupBy("doc", "key").agg(F.max("info").alias("info"), F.sum("sum").alias("shared")))
    found = both.where("doc").select(F.col("key").alias("id"), "info.n", "info.s1", "info.s2")
    shared = both.where("not doc").select(F.col("key").alias("s1"), "shared")

    # equal sets: one class, its least id goes on. Counts belong to sets, by their first hash, as a row that sent a set's shingles may
    # not be the one that stands for its id; a set sent by several tasks, or two of equal first hash, count more, which only lets them go on
    classes = found.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")).join(shared, "s1", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    classes = written(classes)
    histogram = {r["n"]: r["count"] for r in classes.where(F.col("n").between(1, 2 * MAX_BOUNDARY)).groupBy("n").count().collect()}
    boundary = boundary_by_cost(histogram)
    least = F.greatest(F.lit(1), F.floor(F.ceil(4 * F.col("n") / 5) / EXTRA))
    remain = written(classes.where((F.col("n") > 0) & ((F.col("n") <= boundary) | (F.col("shared") >= least))).select(F.col("rep").alias("id"), "s1", "s2"))
    # joins of tables that grow with the documents are sort-merge joins at every size, so that what is shuffled grows in proportion
    sets = written(source.join(remain.hint("merge"), "id").mapInArrow(_sets, "id long, n int, bits struct<w0:long,w1:long,w2:long,w3:long>, shingles array<long>"))
    if not both.where("doc and shared > 1").isEmpty():  # several rows of an id may have given its set in several tasks
        given, sets = sets, written(sets.dropDuplicates(["id"]))
        discard(given)

    members = found.where("n > 0").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"])
    links = written(light_links(sets, boundary))
    index = written(index_rows(sets, boundary))
    links = heavy_links(index, sets, boundary, links)
    edges = links.unionByName(members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    return both, written(components(edges))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM w
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other
), component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM component LEFT JOIN n USING (doc_id)
"""
