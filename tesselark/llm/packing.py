"""Operator 1: best-fit decreasing packing of token pieces.

Documents are encoded, closed with an end id and cut into pieces of at most ``capacity`` tokens (only a document's
first piece may be shorter than that if it is cut). Shorter pieces are dealt into groups of a fixed size, and each group is packed by
best-fit decreasing: a segment tree over remaining capacities (0 to capacity) finds the tightest open sequence in
log2(capacity) steps a piece. Pieces of just the capacity are sequences by themselves. A group of 65,536 pieces wastes about as little as one global run would (it leaves
one or two badly filled sequences), while memory is bounded by the group and groups run in parallel.

Ids are those of the ``tokenizers`` file. They are made by tiktoken from the same vocabulary, several times faster;
the tests hold both equal. A text with a special token's string, or with a run of white space that its matcher's stack could not hold, goes to ``tokenizers`` itself.

Defined cases: null and empty texts are one piece with the end id alone; repeated ids are separate documents
(pieces of equal doc_id and piece number then occur twice); a very long text, of words or of one run of any character, gives as many pieces as it fills,
and one document is encoded at a time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselark.llm.common import documents, text_of, written

CAPACITY, END_ID, PIECES_PER_GROUP = 1024, 2, 65_536
#: The fast encoder's matcher goes back over a run of white space on its stack, which overflows at some 10^6 characters.
LONG_WHITE = re.compile(r"\s{65536}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str):
    """Functions from text to an array of unsigned 32-bit ids, and from a list of ids to bytes."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or (len(text) >= 65536 and LONG_WHITE.search(text)):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode, fast.decode_bytes


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """PIECES, and the ids themselves if with_ids."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    paths = json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(*paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = np.append(encode(text), np.array([end_id], dtype="<u4"))
                    first, piece, start = len(ids) % capacity or capacity, 0, 0
                    while start < len(ids):
                        own = ids[start : start + (capacity if piece else first)]
                        row = (doc_id, piece, start, len(own), zlib.crc32(own.tobytes()))
                        rows.append((*row, own.astype("int32")) if with_ids else row)
                        start, piece = start + len(own), piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(pieces, PIECES + (", ids array<int>" if with_ids else ""))


class OpenSequences:
    """Open sequences by remaining capacity: leaf c of the tree tells whether one with exactly c free tokens is open."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.base)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, free: int, sequence: int) -> None:
        self.at[free].append(sequence)
        i = free + self.base
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (free, sequence) of the tightest open sequence with at least need free tokens."""
        tree, i = self.any, need + self.base
        if not tree[i]:
            while i > 1 and not (i & 1 == 0 and tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        free = i - self.base
        sequence = self.at[free].pop()
        if not self.at[free]:
            while i and not (i < self.base and (tree[2 * i] or tree[2 * i + 1])):
                tree[i] = 0
                i >>= 1
        return free, sequence


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each length, which must come in decreasing order; and how many sequences there are."""
    opened, sequences, offsets, n = OpenSequences(capacity), [], [], 0
    for length in lengths:
        found = opened.take(length)
        if found is None:
            free, sequence, n = capacity, n, n + 1
        else:
            free, sequence = found
        sequences.append(sequence)
        offsets.append(capacity - free)
        if free > length:
            opened.put(free - length, sequence)
    return sequences, offsets, n


def pack_pieces(pieces: DataFrame, n_groups: int, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a stored table) with sequence_id and offset; pieces of a group are taken by decreasing length, then by id. Rows are dealt by their
    place in the table, so that repeated rows spread as well."""
    keep = pieces.columns

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.select(keep).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        own, offsets, _ = best_fit(group["length"].to_pylist(), capacity)
        group = group.append_column("sequence_id", pa.array((key[0].as_py() << 32) + np.array(own, dtype="int64")))
        return group.append_column("offset", pa.array(offsets, pa.int64()))

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))
    return dealt.groupBy("_group").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, pieces_per_group: int = PIECES_PER_GROUP, **how) -> DataFrame:
    """PACKED for all documents (and ids with with_ids=True). A piece that fills a sequence alone needs no packing and joins no group: its
    sequence_id is negative. The others are counted exactly, so a group holds about pieces_per_group of them."""
    pieces = written(token_pieces(docs, capacity, **how))
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return pack_pieces(rest, max(1, -(-rest.count() // pieces_per_group)), capacity).unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and input_ids of each packed sequence; packed must carry ids. A sequence is bounded by capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("input_ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
