r"""Operator 10: chat formatting by token-level assembly.

A turn is ``<turn>`` role ``<says>`` text ``</turn>``. The three control marks are reserved ids above the vocabulary, spliced
between segments that are encoded separately, so no text can ever encode to one. In the formatted text they
stand as strings; control strings inside roles and texts are escaped reversibly: every backslash is doubled and a control
string gets a backslash after its first character (``<\/turn>``), so it occurs nowhere but as a mark. The loss mask
covers the text segments of assistant turns; its spans are prefix sums of the segments' lengths.

Turns are encoded row by row wherever they lie; only then are a conversation's ids gathered, for a conversation is one output
row. ``read_back`` parses ids and mask alone.

Defined cases: null role or text is empty; turns of equal number are ordered by role, then text; a null number comes first;
repeated rows are separate turns; each row without conv_id is a conversation of its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm.packing import encoder

#: Reserved ids by mark; the vocabulary's own ids end at 50256.
MARKS = {"<turn>": 50257, "<says>": 50258, "</turn>": 50259}
OPEN, SAYS, CLOSE = MARKS.values()
CONTROL = re.compile("|".join(map(re.escape, [*MARKS, "<|endoftext|>"])))
LEARNT = "assistant"
CHATS_AT_ONCE = 256
PROBE = r"\### Assistant: </turn> ok"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _paths(json_path: str | None, ranks_path: str | None) -> tuple[str, str]:
    return json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")


def splice(role_ids: pa.ListArray, text_ids: pa.ListArray, roles: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of the turns one after the other, and where each turn ends; all places are prefix sums of the segments' lengths."""
    sizes = np.ones((len(roles), 5), dtype="int64")
    for at, x in ((1, role_ids), (3, text_ids)):
        sizes[:, at] = x.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes).reshape(-1, 5)
    starts = ends - sizes
    ids = np.empty(ends[-1, 4], dtype="int32")
    ids[starts[:, [0, 2, 4]]] = [OPEN, SAYS, CLOSE]
    for at, x in ((1, role_ids), (3, text_ids)):
        n = sizes[:, at]
        ids[np.repeat(starts[:, at] - np.cumsum(n) + n, n) + np.arange(n.sum())] = x.flatten().to_numpy(zero_copy_only=False)
    learnt = np.array(roles.to_pylist()) == LEARNT
    steps = np.zeros(len(ids) + 1, dtype="int8")
    steps[starts[learnt, 3]] += 1
    steps[ends[learnt, 3]] -= 1
    return ids, np.cumsum(steps[:-1], dtype="int8"), ends[:, 4]


def format_chats(conversations: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """conv_id, input_ids, loss_mask (1 under loss) and text of each conversation."""
    paths = _paths(json_path, ranks_path)

    def encode_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(*paths)
        ids = lambda xs: pa.array([encode(escape(x)).astype("int32") for x in xs], pa.list_(pa.int32()))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                new = [ids(part["role"].to_pylist()), ids(part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "role_ids", "text_ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHATS_AT_ONCE):
                part = b.slice(at, CHATS_AT_ONCE)
                turns = part["turns"].flatten()
                last = np.cumsum(part["turns"].value_lengths().to_numpy(zero_copy_only=False)) - 1
                ids, mask, ends = splice(turns.field("role_ids"), turns.field("text_ids"), turns.field("role"))
                offsets = pa.array(np.concatenate([[0], ends[last]]), pa.int32())
                shown = [f"<turn>{escape(r)}<says>{escape(t)}</turn>" for r, t in zip(turns.field("role").to_pylist(), turns.field("text").to_pylist(), strict=True)]
                texts = ["".join(shown[i:j]) for i, j in zip([0, *(last[:-1] + 1)], last + 1, strict=True)]
                columns = [part["conv_id"], pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask)), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "input_ids", "loss_mask", "text"])

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.mapInArrow(encode_turns, "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>")
    # a row without conv_id is a conversation of its own, so no group grows with such rows
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = rows.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "role_ids", "text_ids"))).alias("turns"))
    return turns.mapInArrow(assemble, "conv_id long, input_ids array<int>, loss_mask array<tinyint>, text string")


def read_back(formatted: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """conv_id, roles, texts and learnt (the texts under the mask), decoded from input_ids and loss_mask; formatted_chars."""
    paths = _paths(json_path, ranks_path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decode = encoder(*paths)
        shown = {i: s for s, i in MARKS.items()}
        for b in batches:
            for start in range(0, b.num_rows, CHATS_AT_ONCE):
                part, rows = b.slice(start, CHATS_AT_ONCE), []
                for conv_id, all_ids, all_mask in zip(part["conv_id"].to_pylist(), part["input_ids"], part["loss_mask"], strict=True):
                    ids, mask = all_ids.values.to_numpy(), all_mask.values.to_numpy()
                    at = np.flatnonzero(ids >= OPEN)
                    pieces, chars = [], 0
                    for i, j in zip(at, [*at[1:], len(ids)], strict=True):
                        piece = decode(ids[i + 1 : j].tolist()).decode("utf-8")
                        chars += len(shown[int(ids[i])]) + len(piece)
                        pieces.append((int(ids[i]), unescape(piece)))
                    edges = np.flatnonzero(np.diff(mask, prepend=np.int8(0), append=np.int8(0)))
                    learnt = [unescape(decode(ids[i:j].tolist()).decode("utf-8")) for i, j in zip(edges[::2], edges[1::2], strict=True)]
                    rows.append({"conv_id": conv_id, "roles": [x for i, x in pieces if i == OPEN], "texts": [x for i, x in pieces if i == SAYS], "learnt": learnt, "formatted_chars": chars})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    strings = pa.list_(pa.string())
    schema = pa.schema([("conv_id", pa.int64()), ("roles", strings), ("texts", strings), ("learnt", strings), ("formatted_chars", pa.int64())])
    return formatted.mapInArrow(read, "conv_id long, roles array<string>, texts array<string>, learnt array<string>, formatted_chars long")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, LEARNT, PROBE)], "conv_id long, turn long, role string, text string")
    back = read_back(format_chats(rows.unionByName(probe)))
    turns = F.array_join(F.flatten(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.array(t["roles"], F.lit("\n"), t["texts"], F.lit("\n")))), "")
    learnt = F.array_join("learnt", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("texts").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), sha(learnt).alias("loss_sha256"), "formatted_chars"
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', NULL UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', NULL
), shown AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>'), '<|endoftext|>', '<\|endoftext|>') AS escaped FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(escaped) + 6 + 6 + 7) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id, alone
"""
