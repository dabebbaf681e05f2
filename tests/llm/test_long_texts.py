"""Texts of one unbroken run: every operator and pipeline stage reads them to the end, without an overflow and in time that grows with the text."""

import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from tokenizers import Tokenizer

import corpus_pipeline
from tesselark.llm import chat, decontaminate, line_dedup, ngram_join, packing, pii, quality_rules, sharding, token_counts, turn_repair

N = 120_000
RUNS = {
    "humps": "Ab" * (N // 2), "hyphens": "AB" + "-CD" * (N // 3), "domain": "a@b" + ".c" * (N // 2), "dots": ".c" * (N // 2), "spaces": "a" + " " * N + "b", "newlines": "\n" * N, "word": "x" * N,
    "keys": "sk-" * (N // 3), "capitals": "A" * N, "names": "Anna " * (N // 5), "initials": "A. " * (N // 3), "cyrillic": "Аб" * (N // 2), "lines": "a line that comes again\n" * (N // 20),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(RUNS.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).cache()


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("labels", "benchmark")}


def test_personal_data(docs):
    out = {r["doc_id"]: r for r in pii.replace_entities(docs, "key").collect()}
    found = {name: out[i][-1] for i, name in enumerate(RUNS)}
    assert found["domain"] > 0 and found["capitals"] == 1 and found["names"] > 0
    assert all(found[k] == 0 for k in ("dots", "spaces", "newlines", "word", "lines"))
    assert all(len(out[i]["text"]) >= N - 3 for i, k in enumerate(RUNS) if k not in ("names", "domain"))


def test_packing_equals_tokenizers():
    encode, _ = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in (*RUNS.values(), "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x" + " " * 200_000):
        assert np.array_equal(encode(t), plain.encode(t, add_special_tokens=False).ids)


def test_packing_and_token_counts(docs):
    assert packing.pack_documents(docs).select("doc_id").distinct().count() == len(RUNS)
    assert token_counts.token_counts(docs, {"▁": -1.0, "x": -2.0, "xx": -2.5}).count() == len(RUNS)


def test_a_long_word_holds_little_memory():
    counter = token_counts.TrieCounter({"▁": -1.0, "a": -2.0, "aaa": -4.0, "ab": -2.5})
    word = (b"aaab" * 200_000)[:700_001]
    tracemalloc.start()
    counter.learn([word, word[:5000], word[:5000] + b"x", b"a"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * len(word)
    plain = token_counts.TrieCounter({"▁": -1.0, "a": -2.0, "aaa": -4.0, "ab": -2.5})
    for w in (word[:3000], word[:5000], word[:5000] + b"x", b"a"):
        assert counter_of(plain, w) == brute_tokens(w.decode())
    assert counter.known[word[:5000]] == brute_tokens(word[:5000].decode())


def counter_of(counter, word):
    counter.learn([word])
    return counter.known[word]


def brute_tokens(word):
    scores, text = {"▁": -1.0, "a": -2.0, "aaa": -4.0, "ab": -2.5}, "▁" + word
    best = [(0.0, 0)]
    for at in range(1, len(text) + 1):
        ways = [(best[at - len(p)][0] + s, best[at - len(p)][1] - 1) for p, s in scores.items() if text[:at].endswith(p)]
        if text[at - 1] not in scores:
            ways.append((best[at - 1][0] + min(scores.values()) - 10.0, best[at - 1][1] - 1))
        best.append(max(ways))
    return -best[-1][1]


def test_other_operators(docs, tables):
    n = len(RUNS)
    assert sharding.stratified_shards(docs).count() == n
    assert decontaminate.contamination(docs, tables["benchmark"]).count() == n
    assert ngram_join.ngram_components(docs).count() == n
    assert line_dedup.dedup_lines(docs).count() == n
    assert quality_rules.quality_rules(docs, tables["labels"]).count() == n


def test_conversations(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", text) for i, text in enumerate(RUNS.values()) for t in range(2)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(chats)).count() == len(RUNS)
    turns = turn_repair.turns_of(chats, turn_repair.F.lit(1))
    plans = turn_repair.repair_plans(turns)
    assert turn_repair.digests(turn_repair.repaired_turns(turns, plans)).count() > 0 and plans.count() == len(RUNS)


def test_pipeline_stages(spark, docs):
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, now, DATA).count() >= 0
