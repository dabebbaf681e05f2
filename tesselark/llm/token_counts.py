"""Operator 7: unigram token counts by dynamic programming shared over a trie.

A pre-token is a word (a run of characters that are not ASCII white space) behind the word mark. Its count is the number of pieces
on its best path under a unigram model. A task reads its texts in chunks; the pre-tokens of a chunk not met before are sorted, which
walks their trie depth first: every distinct prefix is one node, its forward score is computed once, and a terminal's count is
stored for later chunks while at most ``max_known`` are. A text's count is the sum over its words. Nothing is shuffled there; a task holds at most
``max_known`` terminal counts or those of one chunk, and the texts of one chunk.

The pieces are those of a public vocabulary, which holds no probabilities. They are estimated from all documents: each task counts its words, cuts
each distinct one by the vocabulary's own merges, and the pieces' counts are added up over tasks, one number a piece. A piece's score is the
logarithm of its share, with one added to each count. A character that no piece covers costs as many tokens as it has bytes, at a score
below every piece. Of equal scores the path with fewer tokens wins.

Defined cases: null and empty texts have 0 tokens; a very long word is walked to its end, with no more held of it than of others beside the word itself; repeated rows and ids are counted each; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm.common import column, documents, text_of

#: Forward scores are shared between words up to this depth of the trie; beyond it a word's own are kept only as far back as a piece reaches.
SHARED_DEPTH = 1024
MARK, MAX_KNOWN, MAX_COUNTED, CHUNK_BYTES, CHUNK_ROWS = "▁", 200_000, 100_000, 8 << 20, 4096


@lru_cache(maxsize=2)
def vocabulary(model_path: str):
    """The tokenizer of a model file and its pieces by id; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return model, {i: model.id_to_piece(i) for i in range(model.get_piece_size()) if not skip(i)}


def piece_scores(docs: DataFrame, model_path: str | None = None) -> dict[str, float]:
    """Piece to log((count + 1) / (all counts + pieces)), the counts taken over all documents. One number a piece comes to the driver."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    schema = pa.schema([("piece", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = vocabulary(path)
        words, pieces = Counter(), Counter()

        def cut() -> None:
            for ids, n in zip(model.encode([w.decode("utf-8") for w in words], num_threads=1), words.values(), strict=True):
                for i in ids:
                    pieces[i] += n
            words.clear()

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for t in b["text"].slice(at, 256).to_pylist():
                    words.update(t.encode("utf-8").split())
                if len(words) > MAX_COUNTED:
                    cut()
        cut()
        found = [(i, n) for i, n in pieces.items() if i in known]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())], schema=schema)

    counts = {r["piece"]: r["n"] for r in docs.select(text_of().alias("text")).mapInArrow(counted, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    known = vocabulary(path)[1]
    total = sum(counts.values()) + len(known)
    return {piece: math.log((counts.get(i, 0) + 1) / total) for i, piece in known.items()}


class TrieCounter:
    """Token counts of pre-tokens; each prefix is scored once within a call of learn(), and nodes counts them."""

    def __init__(self, scores: dict[str, float]):
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.longest = max(map(len, scores), default=1)
        self.known: dict[bytes, int] = {}
        self.nodes = 0

    def learn(self, words: list[bytes]) -> None:
        best, tokens, alive = [0.0], [0], [[(0, self.root)]]  # by depth; alive: pieces that may go on, as (where it began, its node)
        before = ""
        for word in sorted(MARK + w.decode("utf-8") for w in words):
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            del best[same + 1 :], tokens[same + 1 :], alive[same + 1 :]
            for at in range(same, min(len(word), SHARED_DEPTH)):
                alive.append(self._step(word[at], at, alive[at], best, tokens, 0))
            n = tokens[-1] if len(word) <= SHARED_DEPTH else self._rest(word, best, tokens, alive[-1])
            self.known[word[1:].encode("utf-8")] = n
            before = word

    def _step(self, c: str, at: int, alive: list, best: list[float], tokens: list[int], base: int) -> list:
        """Append the best score and count at depth at + 1 and return the pieces that may go on from there. best and tokens begin at depth base."""
        on, top = [], None
        for start, node in alive:
            node = node.get(c)
            if node is not None:
                on.append((start, node))
                if "" in node:
                    way = (best[start - base] + node[""], -tokens[start - base] - 1)
                    top = way if top is None or way > top else top
        if c not in self.root or "" not in self.root[c]:
            way = (best[at - base] + self.unknown, -tokens[at - base] - len(c.encode("utf-8")))
            top = way if top is None or way > top else top
        self.nodes += 1
        best.append(top[0])
        tokens.append(-top[1])
        on.append((at + 1, self.root))
        return on

    def _rest(self, word: str, best: list[float], tokens: list[int], alive: list) -> int:
        """The count of a word longer than SHARED_DEPTH, of whose further depths at most 2 * longest + 1,024 are held at once."""
        base = max(0, SHARED_DEPTH - self.longest)
        best, tokens = best[base:], tokens[base:]
        for at in range(SHARED_DEPTH, len(word)):
            alive = self._step(word[at], at, alive, best, tokens, base)
            if len(best) > 2 * self.longest + 1024:
                gone = len(best) - self.longest - 1
                del best[:gone], tokens[:gone]
                base += gone
        return tokens[-1]

    def counts(self, texts: list[list[bytes]], max_known: int) -> list[int]:
        """Tokens of each text's words. All their new words are learned in one trie; where more than max_known would be known, those of earlier calls are dropped."""
        words = set().union(*texts)
        new = words.difference(self.known)
        if len(self.known) + len(new) > max_known:
            self.known, new = {}, words
        self.learn(list(new))
        return [sum(map(self.known.__getitem__, x)) for x in texts]


def token_counts(docs: DataFrame, scores: dict[str, float], max_known: int = MAX_KNOWN, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each row, under the given scores of pieces."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, ids, texts, size = TrieCounter(shared.value), [], [], 0

        def done() -> pa.RecordBatch:
            words = [t.split() for t in texts]
            n = counter.counts(words, max_known)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in words], pa.int64()), pa.array(n, pa.int64())], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                new = [t.encode("utf-8") for t in part["text"].to_pylist()]
                ids, texts, size = ids + part["doc_id"].to_pylist(), texts + new, size + sum(map(len, new))
                if size >= chunk_bytes or len(ids) >= CHUNK_ROWS:
                    yield done()
                    ids, texts, size = [], [], 0
        if ids:
            yield done()

    rows = docs.select(column("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_pretokens long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return token_counts(docs, piece_scores(docs))
