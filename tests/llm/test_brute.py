"""Operators against brute-force versions in plain Python, on hand-made documents with every awkward case and on the smallest test table."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import xxhash
from conftest import DATA, table
from pyspark.sql import functions as F

import corpus_pipeline
from tesselark.llm import chat, components, cotraining, decontaminate, line_dedup, ngram_join, packing, pii, quality_rules, sharding, token_counts
from tesselark.llm.queries import QUERIES, SQL

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"
PROSE = " ".join(f"word{i * 7919 % 613}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t"), (4, PROSE), (5, PROSE), (6, PROSE.upper() + " tail"), (7, "one two three"), (8, "One  two\nthree"), (9, "A line that repeats\nA line that repeats\nshort"),
    (10, " a line THAT repeats \nanother line here"), (11, "x " * 40_000), (12, PROSE + " " + "extra " * 30), (13, "Straße ÜBER Žluť слово 漢字 " * 6), (14, "Mail anna@example.org or call +49 30 1234567. Mr John Smith, again anna@example.org. Card 4111 1111 1111 1111, IP 10.1.2.3"),
    (15, "<|endoftext|> and </turn> \\ done"), (16, "Smith wrote to ANNA; anna@example.org"), (7, "one two three"),
]
#: Extra columns named like the operators' own working and result columns.
EXTRA = "token id n line pos seen value row w f h hits sbar _tk_n_hit _tk_lost _tk_new _tk_words _tk_verdict _tk_hits _tk_lines _tk__id piece length _group a.b".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else "hot", None, *EXTRA) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def whole(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# brute force


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets[i] = max(sets.get(i, set()), shingles(t), key=len)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def key_of(line):
    return line.strip(WHITE).translate(LOW)


def brute_lines(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders[key_of(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key_of(x), ())) >= 2 and i != min(holders[key_of(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_hits(rows, items):
    where = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            where[tuple(w[i : i + n])].add("null" if item is None else str(item))
    lengths = {len(k) for k in where}
    out = []
    for i, text in rows:
        w, hit, found = bench_words(text), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if (own := where.get(tuple(w[at : at + n]))) is not None:
                    hit |= set(range(at, at + n))
                    found |= own
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_word(w):
    return xxhash.xxh64_intdigest(w.encode(), seed=42)


def hash_pair(a, b):
    return xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42))


def brute_features(text, n):
    h = [hash_word(w) for w in words(text)]
    return [signed(x) % n for x in h] + [signed(hash_pair(a, b)) % n for a, b in zip(h, h[1:], strict=False)]


def brute_quality(rows, trusted):
    return sorted(judged(rows, trusted))


def judged(rows, trusted, n=quality_rules.N_FEATURES):
    """In the order of rows."""
    corpus, good = Counter(), Counter()
    for i, t in rows:
        f = brute_features(t, n)
        corpus.update(f)
        if i in trusted:
            good.update(f)
    nc, ng = sum(corpus.values()), sum(good.values())
    ratio = lambda x: 0.0 if ng == 0 else math.log((good[x] + 1) / (ng + n)) - math.log((corpus[x] + 1) / (nc + n))
    out = []
    for i, t in rows:
        t = t or ""
        w = words(t)
        places = defaultdict(list)
        for k in range(len(w) - 4):
            places[tuple(w[k : k + 5])].append(k)
        repeated = {p for at in places.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if x.strip(WHITE)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        f = brute_features(t, n)
        mean = sum(map(ratio, f)) / max(1, len(f))
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed, not failed and mean >= quality_rules.THRESHOLD))
    return out


# queries with SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert table(QUERIES[name](spark, DATA).toPandas()) == table(con.execute(SQL[name]).df())


# one operator each


def packed_rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect())


def check_packing(rows, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for i, text in documents:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first, at, piece = len(ids) % 1024 or 1024, 0, 0
        while at < len(ids):
            own = ids[at : at + (1024 if piece else first)]
            wanted.append((i, piece, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
            at, piece = at + len(own), piece + 1
    assert Counter(r[:5] for r in rows) == Counter(wanted)
    by = defaultdict(list)
    for *_, length, _crc, sequence, offset in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by), -(-sum(r[3] for r in rows) // 1024)


def test_packing(docs, none, small):
    check_packing(packed_rows(packing.pack_documents(docs)), whole(docs))
    used, bound = check_packing(packed_rows(packing.pack_documents(small)), whole(small))
    assert used <= bound * 1.02 + 1
    assert packing.pack_documents(none).count() == 0


def test_best_fit_is_tightest():
    """Each length goes where the least room is left, by a plain search over all open sequences."""
    lengths = sorted((i * 7919 % 1024 + 1 for i in range(3000)), reverse=True)
    own, offsets, n = packing.best_fit(lengths, 1024)
    free = []
    for x, sequence, offset in zip(lengths, own, offsets, strict=True):
        fits = [f for f in free if f >= x]
        if sequence == len(free):
            assert not fits
            free.append(1024)
        else:
            assert free[sequence] == min(fits)
        assert offset == 1024 - free[sequence]
        free[sequence] -= x
    assert n == len(free)


def test_repeated_and_long_documents_pack(spark):
    """Equal rows spread over groups; pieces of full length are sequences by themselves."""
    docs = spark.createDataFrame([(1, "same words here")] * 500 + [(2, "y z " * 30_000)], "doc_id long, text string")
    rows = packed_rows(packing.pack_documents(docs, pieces_per_group=50))
    check_packing(rows, whole(docs))
    assert len({r[5] >> 32 for r in rows if r[5] >= 0}) > 5
    assert all((r[5] < 0) == (r[3] == 1024) for r in rows)


def test_packed_sequences_round_trip(docs):
    ids = packing.sequences(packing.pack_documents(docs, with_ids=True))
    assert ids.select(F.sum(F.size("input_ids"))).first()[0] == packing.pack_documents(docs).select(F.sum("length")).first()[0]


def reference_logistic(x, y, weight, l2=cotraining.L2, steps=150, rate=0.5):
    """The same steps, one coefficient at a time."""
    x = [[*map(float, r), 1.0] for r in x]
    k, total = len(x[0]), sum(weight)
    w, m, v = [0.0] * k, [0.0] * k, [0.0] * k
    for t in range(1, steps + 1):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(r, w, strict=True)))))) for r in x]
        for j in range(k):
            g = sum(c * (q - yy) * r[j] for c, q, yy, r in zip(weight, p, y, x, strict=True)) / total + l2 * w[j]
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.99 * v[j] + 0.01 * g * g
            w[j] -= rate / (1 + t / 30) * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.99**t)) + 1e-6)
    return w


def test_logistic_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=60) > 0).astype(float)
    weight = rng.choice([0.5, 1.0], 60)
    assert np.allclose(cotraining.logistic(x, y, weight), reference_logistic(x, y, weight), atol=2e-3)


def auc(scores, labels):
    """The share of pairs of a good and a bad row that the score orders right (ties half)."""
    good, bad = ([s for s, y in zip(scores, labels, strict=True) if y == k] for k in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_classifier_held_out(spark):
    """Held-out labels: well above a constant, whose AUC and mean of both classes' accuracy are one half."""
    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = cotraining.fit(documents, labels.where("doc_id % 4 <> 0"))
    out = cotraining.score(documents, model).join(labels.where("doc_id % 4 = 0").withColumnRenamed("toxic", "true"), "doc_id").collect()
    of = lambda k: [r["kept"] == bool(k) for r in out if r["quality"] == k]
    balanced = (sum(of(0)) / len(of(0)) + sum(of(1)) / len(of(1))) / 2
    assert len(of(0)) > 50 and balanced >= 0.9, balanced
    assert auc([r["score"] for r in out], [r["quality"] for r in out]) >= 0.97
    found, planted, right = sum(r["toxic"] for r in out), sum(r["true"] for r in out), sum(r["toxic"] and r["true"] for r in out)
    print("toxic, held out:", planted, "found", found, "right", right, "of", len(out))
    assert planted > 50 and right >= 0.75 * planted and right >= 0.95 * found


def two_view_world(spark, n=3000, labelled=60):
    """Documents whose class either view tells: by words, half of them never labelled, and by source, each of 40 sources seldom labelled."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.5)
        rare = i >= labelled and rng.random() < 0.6  # rare rows use words that no labelled row has
        words = [f"{'rare' if rare else 'usual'}{'good' if y else 'bad'}{rng.integers(6)}" for _ in range(6)] + [f"noise{rng.integers(50)}" for _ in range(14)]
        rows.append((i, " ".join(words), "en", f"{'good' if y else 'bad'}-source{rng.integers(3)}"))
        labels.append((i, y, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cotraining_beats_the_labels_alone(spark):
    """Words that no labelled row has are learnt from the other view's pseudo-labels."""
    docs, labels = two_view_world(spark)
    few = labels.where("doc_id < 60")
    content = []
    for rounds in (0, cotraining.ROUNDS):
        out = cotraining.score(docs, cotraining.fit(docs, few, rounds=rounds)).join(labels.where("doc_id >= 60"), "doc_id").collect()
        content.append(auc([r["p_content"] for r in out], [r["quality"] for r in out]))
    assert content[1] > content[0] + 0.05 and content[1] > 0.9, content


def test_the_surest_rows_are_picked_from_all(spark):
    """surest() against a sort of all rows on one machine; copies count once, sampled ids not at all."""
    docs, labels = two_view_world(spark, 600)
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 10_000)).repartition(7)
    table = cotraining.feature_table(docs, []).cache()
    sample = cotraining.labelled_sample(docs, labels.where("doc_id < 60"))
    own = cotraining.feature_table(sample, []).toArrow().sort_by("doc_id")
    y = np.array([r["quality"] for r in labels.where("doc_id < 60").orderBy("doc_id").collect()])
    run = cotraining.CoTraining(("content", "names"), cotraining.Views.of(own), y, np.arange(60) % 5 == 0, cotraining.L2, 40)
    run.fit()
    picked = cotraining.surest(table, [run], frozenset(range(60)))
    rows = table.toArrow()
    views = cotraining.Views.of(rows)
    for (_, i, label), got in picked.items():
        m = views.margin(run.target.views[i], run.target.weights[i]) * (1 if label else -1)
        free = {h: s for h, s, d in zip(rows["h"].to_pylist(), m.tolist(), rows["doc_id"].to_pylist(), strict=True) if d >= 60 and s > cotraining.SURE}
        assert got == sorted(h for h, _ in sorted(free.items(), key=lambda x: (-x[1], x[0]))[: run.wanted(label)])
    assert sum(map(len, picked.values())) > 20


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (2, None, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert cotraining.score(docs, cotraining.fit(docs, labels)).count() == len(TEXTS)
    assert cotraining.score(none, cotraining.fit(none, labels)).count() == 0
    assert cotraining.labelled_sample(docs, labels).where("doc_id = 7").count() == 1  # of its two rows


@pytest.mark.parametrize("which", ["docs", "small"])
def test_sharding(request, which):
    check_sharding(request.getfixturevalue(which))


def check_sharding(df):
    rows = sharding.stratified_shards(df).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in whole(df))
    by, mix = defaultdict(list), defaultdict(Counter)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        mix[r["source"]][r["shard"]] += 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    counts = [len(by[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(max(c[s] for s in range(8)) - min(c[s] for s in range(8)) <= 2 for c in mix.values())


def test_sharding_empty(none):
    assert sharding.stratified_shards(none).count() == 0


def test_sharding_of_repeated_rows(spark):
    """Three thousand equal rows among a thousand others: blocks keep the law and the mixture."""
    df = spark.createDataFrame([(5, "same", "hot")] * 3000 + [(i, f"text {i}", f"s{i % 3}") for i in range(100, 1100)], "doc_id long, text string, source string")
    check_sharding(df)


def test_sharding_follows_the_fractional_rank(small):
    """Shards and slots are the cuts of the order by (seeded rank in the source + the source's start) / the source's size."""
    rows = sharding.stratified_shards(small).collect()
    pos = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    assert len(pos) == len(rows)
    sizes = Counter(r["source"] for r in rows)
    hashes = {r["doc_id"]: r["h"] for r in small.select("doc_id", F.xxhash64(F.lit(sharding.SEED), F.col("doc_id").cast("long"), F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 1).cast("long"), F.lit(0).cast("long")).alias("h")).collect()}
    starts = {r["source"]: (r["p"] + 0.5) / (1 << 20) for r in small.select("source", F.pmod(F.xxhash64(F.lit(sharding.SEED), F.concat(F.lit("s:"), "source")), F.lit(1 << 20)).alias("p")).distinct().collect()}
    buckets = min(sharding.MAX_BUCKETS, 1 << (len(rows) // sharding.ROWS_PER_BUCKET).bit_length())
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((hashes[r["doc_id"]] % buckets, hashes[r["doc_id"]], r["doc_id"]))
    order = sorted((((k + starts[s]) / sizes[s]), "s:" + s, h, i) for s, own in by.items() for k, (_, h, i) in enumerate(sorted(own)))
    cut = [-(-s * len(rows) // 8) for s in range(9)]
    want = {x[3]: next((s, k - cut[s]) for s in range(8) if cut[s] <= k < cut[s + 1]) for k, x in enumerate(order)}
    assert pos == want


def test_decontamination(spark, docs, none):
    items = [("a", " ".join(PROSE.split()[20:45])), ("b", "two three"), ("c", None), (None, "extra " * 12), ("e", "!!"), ("a", "SLOVO слово 漢字 straße")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    out = decontaminate.contamination(docs, benchmark)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = sorted((r["doc_id"], r[-1]["n_words"], r[-1]["n_hit"], ",".join(r[-1]["items"])) for r in out.collect())
    assert got == brute_hits(whole(docs), items)
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert all(r[-1]["n_hit"] == 0 for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())


def test_ngram_join(docs, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == brute_components(whole(docs))
    assert ngram_join.ngram_components(none).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_ngram_join_of_repeated_ids(spark, parts):
    """A set first met under an id whose other row is larger still links the documents that hold it."""
    base = [f"w{i}" for i in range(60)]
    text, near, larger = " ".join(base), " ".join(["x", *base[1:]]), " ".join(f"y{i}" for i in range(90))
    rows = [(7, text), (7, larger), (8, text), (9, near), (None, near), (None, text)]
    for own in [rows] if parts == 1 else [rows[::-1]]:
        found = ngram_join.ngram_components(spark.createDataFrame(own, "doc_id long, text string").repartition(parts) if parts > 1 else spark.createDataFrame(own, "doc_id long, text string").coalesce(1))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
        assert {k: v for k, v in got.items() if k} == {7: (86, 7), 8: (56, 8), 9: (56, 8)} and got[None] == (56, 8)


def test_ngram_join_of_a_large_group(spark):
    """A group of near copies, each with a word of its own, more than a task marks as frequent."""
    base = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*base[: 10 + i % 30], f"own{i}", *base[11 + i % 30 :]])) for i in range(300)] + [(1000 + i, f"other {i} " * 3) for i in range(50)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute_components(rows)


def test_ngram_join_near_the_border(spark):
    """Chains and stars of copies whose similarities lie on both sides of 0.8, with short and long sets."""
    base = [f"w{i}" for i in range(90)]
    rows = []
    for k in range(120):
        n = (8, 12, 16, 25, 40, 86)[k % 6]
        w = base[:n]
        for j in range(k % 4):
            w[(k * 13 + j * 29) % n] = f"u{k * (j % 2)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_pair_filters_lose_no_link():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(20, 200))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 12], rng.integers(0, 2**63, n // 12).astype(np.uint64)])
        x, y = ngram_join.parities(np.unique(a)), ngram_join.parities(np.unique(b))
        differ = sum(((x[k] ^ y[k]) & (2**64 - 1)).bit_count() for k in x)
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


@pytest.mark.parametrize("batches", [1, 3])
def test_line_dedup(docs, none, batches):
    out = line_dedup.dedup_lines(docs, batches=batches)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert sorted((r["doc_id"], r[-1]["n_lines"], r[-1]["n_dropped"], r["text"]) for r in out.collect()) == brute_lines(whole(docs))
    assert line_dedup.dedup_lines(none, batches=batches).count() == 0


def test_token_counts(docs, none, small):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, pieces = token_counts.vocabulary(path)
    counts = Counter(i for _, t in whole(small) for w in words(t) for i in model.encode(w))
    total = sum(n for i, n in counts.items() if i in pieces) + len(pieces)
    scores = token_counts.piece_scores(small)
    assert scores == {x: math.log((counts[i] + 1) / total) for i, x in pieces.items()}
    assert len(set(token_counts.piece_scores(none).values())) == 1
    unknown = min(scores.values()) - 10.0
    longest = max(map(len, scores))

    def brute(word):
        w = token_counts.MARK + word
        best = [(0.0, 0)] + [None] * len(w)
        for end in range(1, len(w) + 1):
            ways = [(best[k][0] + scores[w[k:end]], best[k][1] - 1) for k in range(max(0, end - longest), end) if w[k:end] in scores]
            c = w[end - 1]
            if c not in scores:
                ways.append((best[end - 1][0] + unknown, best[end - 1][1] - len(c.encode())))
            best[end] = max(ways)
        return -best[-1][1]

    known = {}
    for df in (docs, small.limit(40)):
        got = sorted(tuple(r) for r in token_counts.token_counts(df, scores).collect())
        want = []
        for i, t in whole(df):
            w = words(t)
            for x in set(w).difference(known):
                known[x] = brute(x)
            want.append((i, len(w), sum(known[x] for x in w)))
        assert got == sorted(want)
    total = token_counts.token_counts(docs, scores).agg(F.sum("n_tokens")).first()[0]
    for how in ({"max_known": 3}, {"chunk_bytes": 1}):
        assert token_counts.token_counts(docs, scores, **how).agg(F.sum("n_tokens")).first()[0] == total
    assert token_counts.token_counts(none, scores).count() == 0


def test_each_distinct_prefix_is_scored_once(small):
    scores = {token_counts.MARK: -1.0, "a": -2.0, "th": -3.0, "the": -2.5}
    own = sorted({w.encode() for _, t in whole(small) for w in words(t)})
    trie = token_counts.TrieCounter(scores)
    trie.learn(own)
    assert trie.nodes == len({(token_counts.MARK + w.decode())[:k] for w in own for k in range(1, len(w.decode()) + 2)})
    trie.counts([own], 10**6)
    assert trie.nodes == len({(token_counts.MARK + w.decode())[:k] for w in own for k in range(1, len(w.decode()) + 2)})  # terminal counts are stored
    over = token_counts.TrieCounter(scores)
    assert over.counts([own[::2], own[1::2], own], 3) == [sum(trie.known[w] for w in x) for x in (own[::2], own[1::2], own)]
    assert over.nodes == trie.nodes  # also of more words than are kept, each prefix of a call is scored once


def test_pii(docs, none):
    out = pii.replace_entities(docs, "key")
    assert out.columns[: len(docs.columns)] == docs.columns
    by = defaultdict(list)
    for r in out.collect():
        by[r["doc_id"]].append((r["text"], r[-1]))
    source = dict(TEXTS)
    for i in (1, 2, 4, 7, 11, 13):
        assert all(t == source[i] and n == 0 for t, n in by[i])
    (text, n), (other, _) = by[14][0], by[16][0]
    assert n >= 5 and not any(x in text for x in ("anna@example.org", "1234567", "John Smith", "4111 1111 1111 1111", "10.1.2.3"))
    mails = re.findall(r"[\w.]+@[\w.]+\w", text + " " + other)
    assert len(mails) == 3 and len(set(mails)) == 1
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", text)[0].replace(" ", "")
    assert sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(card)) % 10 == 0
    assert pii.replace_entities(none, "key").count() == 0


def brute_names(text):
    """Family and given names of a text's persons by plain string steps: title or listed given name, then one or two capitalised words."""
    tokens = [w.strip(".,;:!?") for w in text.split(" ")]
    name = lambda w: bool(w) and w.replace("-", "").isalpha() and w[0].isupper() and (w[1:].islower() or "-" in w or (w.isupper() and len(w) > 1))
    titles = {x for t in (*pii.MALE_TITLES, *pii.FEMALE_TITLES, *pii.TITLES) for x in (t, t.upper())}
    given = {n.title() for n in pii.Names.spellings([*pii.MALE_GIVEN, *pii.FEMALE_GIVEN])}
    found, i = set(), 0
    while i < len(tokens):
        own = []
        if tokens[i] in titles or (tokens[i].title() in given and i + 1 < len(tokens) and name(tokens[i + 1])):
            j = i + 1 if tokens[i] in titles else i
            while j < len(tokens) and len(own) < 2 and name(tokens[j]) and not (own and text.split(" ")[j - 1][-1] in ".,;:!?"):
                own.append(tokens[j].title())
                j += 1
            i = max(i + 1, j)
        else:
            i += 1
        found |= set(own)
    return found


PEOPLE = [
    "Mr John Smith arrived. Smith left, and John left too.", "yesterday Dr Wagner spoke with Wagner about wagner", "там Иван Петров, Петров и Петров", "we met Maria Garcia and Priya Patel; later Patel rang Garcia",
    "Mr JOHN SMITH, then SMITH and Smith", "for Frau Anna-Lena Schulz and Herr Schulz", "nobody is named here, nor The Apache License", "Alex Novak wrote to Mrs Novak; Alex left",
]


def test_pii_persons_against_brute_force(spark):
    """Every name that the plain version finds is gone from its document, in whatever case, alone or with others; all other words stay in their
    places; and a name maps to one surrogate within and across documents."""
    rows = {r["doc_id"]: r for r in pii.replace_entities(spark.createDataFrame(list(enumerate(PEOPLE)), "doc_id long, text string"), "key").collect()}
    became = defaultdict(set)
    for i, text in enumerate(PEOPLE):
        names = brute_names(text)
        assert bool(names) == (rows[i][-1] > 0)
        old, new = re.findall(r"[\w-]+|[^\w-]+", text), re.findall(r"[\w-]+|[^\w-]+", rows[i]["text"])
        assert len(old) == len(new)
        n = 0
        for a, b in zip(old, new, strict=True):
            if a.title() in names and a[0].isupper():
                assert a.title() != b.title() and a.isupper() == b.isupper()
                became[a.title()].add(b.title())
                n += 1
            else:
                assert a == b
        assert n >= rows[i][-1] >= n / 2  # a person of two names is one
    assert all(len(x) == 1 for x in became.values()), became
    assert len({next(iter(x)) for x in became.values()}) == len(became) > 10 and not {y for x in became.values() for y in x} & set(became)


def test_pii_more_ways_to_name_a_person(spark):
    texts = ["J. R. Smith wrote", "Name: Karla Zubrow here", "Kim Zubrow <kim@x.org>", "Kara K. Zubrow left", "Frau von der Leyen", "Sincerely, Karla Zubrow", "ich heiße Karla Zubrow", "Vitamin C. The end of plan B. However it ends"]
    out = {r["doc_id"]: r["text"] for r in pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    for i, name in enumerate(["Smith", "Karla", "Zubrow", "Zubrow", "Leyen", "Zubrow", "Zubrow"]):
        assert name not in out[i]
    assert out[7] == texts[7]
    mine = pii.replace_entities(spark.createDataFrame([(0, "Zork Blarg came")], "doc_id long, text string"), "key", pii.Names(male=["Zork"], female=[])).first()
    assert mine[-1] == 1 and "Blarg" not in mine["text"]


def iban_rest(iban):
    bare = re.sub("[^0-9A-Z]", "", iban)
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def test_pii_ibans_stay_valid_and_the_key_counts(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE11 3704 0044 0532 0130 00"]
    df = spark.createDataFrame(list(enumerate(ibans)), "doc_id long, text string")
    one, two = ({r["doc_id"]: r["text"] for r in pii.replace_entities(df, key).collect()} for key in ("a", "b"))
    for i, old in enumerate(ibans):
        assert one[i] != old and one[i][:2] == old[:2] and one[i] != two[i] and [c.isdigit() for c in one[i]] == [c.isdigit() for c in old]
    assert iban_rest(one[0]) == iban_rest(one[1]) == 1
    with pytest.raises(TypeError):
        pii.replace_entities(df)


def test_pii_surrogates_are_distinct(spark):
    entities = spark.createDataFrame([("ip", f"10.0.{i // 200}.{i % 200 + 1}") for i in range(800)] + [("ssn", f"{100 + i}-{i % 90 + 10}-{1000 + i}") for i in range(200)], "kind string, value string")
    rows = pii.surrogate_table(entities, "key").collect()
    new, old = {r["surrogate"] for r in rows}, {r["value"] for r in rows}
    assert len(rows) == 1000 and len(new) == 1000 and not new & old


def test_pii_more_names_than_three_syllables_give(spark):
    entities = spark.range(70_000).select(F.lit("family:nl").alias("kind"), F.concat(F.lit("Q"), F.col("id")).alias("value"))
    out = pii.surrogate_table(entities, "key")
    assert out.agg(F.count("surrogate"), F.countDistinct("surrogate"), F.countDistinct("value")).first() == (70_000,) * 3


def test_pii_long_and_prefixed_secrets(spark):
    letters = "Ab3dEf6hIj9lMn2pQr5tUv8x"
    secrets = ["0123456789abcdef" * 16, "0123456789ABCDEF" * 16, "sk_" + letters * 4 + "Zz01", "sk_live_" + letters, "sk-proj-" + letters[:12] + "-" + letters[12:], "xoxb-1234567890123456-" + letters, "ghp_" + "a1" * 5000, "ab12" * 10]
    plain = ["sk-some-hyphenated-words-here", "pk_of_the_table_of_orders", "sk-2", "0123456789abcdef"]
    rows = {r["doc_id"]: r for r in pii.replace_entities(spark.createDataFrame([(i, f"key {t}, end") for i, t in enumerate(secrets + plain)], "doc_id long, text string"), "key").collect()}
    for i, t in enumerate(secrets):
        new = rows[i]["text"]
        assert rows[i][-1] == 1 and len(new) == len(t) + 9 and t not in new and not any(p in new for p in re.findall(r"[0-9A-Za-z]{12}", t)), t
    assert all(rows[len(secrets) + i]["text"] == f"key {t}, end" for i, t in enumerate(plain))


def test_pii_nearly_full_and_full_spaces(spark, monkeypatch):
    """100 addresses look like 1@2.co: 50 fill them to the last one, 51 cannot all get one."""
    monkeypatch.setattr(pii, "MAX_ATTEMPTS", 3)
    mails = lambda n: spark.createDataFrame([("email", f"{i // 10}@{i % 10}.co") for i in range(n)], "kind string, value string")
    rows = pii.surrogate_table(mails(50), "key").collect()
    new, old = {r["surrogate"] for r in rows}, {r["value"] for r in rows}
    assert len(new | old) == 100 and len(rows) == 50
    with pytest.raises(ValueError, match="full"):
        pii.surrogate_table(mails(51), "key")


def test_quality_rules(spark, small, docs, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.where("quality = 1 and coalesce(toxic, 0) = 0").collect()}
    for df in (small, docs):
        out = quality_rules.quality_rules(df, labels)
        got = sorted((r["doc_id"], r[-1]["n_words"], *r[-2], r[-1]["n_repeat_words"], r[-1]["base_failed"], r[-1]["kept"]) for r in out.collect())
        assert got == brute_quality(whole(df), trusted)
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert all(r[-1]["kept"] != r[-1]["base_failed"] for r in quality_rules.quality_rules(small, labels.limit(0)).collect())


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "<turn>\\</turn><|endoftext|>"), (1, 1, "assistant", None), (None, 0, None, "x"), (2, 5, "assistant", ""), (2, None, "system", "漢字 \\\\ <says>"), (2, 5, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert set(got) == {1, 2, None}
    alone = spark.createDataFrame([(None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    assert sorted((r["roles"], r["texts"]) for r in chat.read_back(chat.format_chats(alone)).collect()) == [(["assistant"], ["y"]), (["user"], ["x"]), (["user"], ["x"])]
    order = lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=order)
        assert (r["roles"], r["texts"]) == ([x[2] or "" for x in own], [x[3] or "" for x in own])
        assert "".join(r["learnt"]) == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert chat.format_chats(turns.limit(0)).count() == 0


# what operators store


def stored(spark):
    import glob

    from tesselark.llm import common

    return glob.glob(common.scratch_dir(spark).removeprefix("file://") + "/*")


def test_only_what_results_read_stays_stored(spark, docs):
    from tesselark.llm import common

    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), spark.createDataFrame([("a", PROSE)], "item_id string, text string")
    runs = {
        "op1": (lambda: packing.pack_documents(docs), 1), "op3": (lambda: sharding.stratified_shards(docs), 1), "op4": (lambda: decontaminate.contamination(docs, items), 2),
        "op5": (lambda: ngram_join.ngram_components(docs), 2), "op6": (lambda: line_dedup.dedup_lines(docs), 4), "op8": (lambda: pii.replace_entities(docs, "key"), 4), "op9": (lambda: quality_rules.quality_rules(docs, labels), 0),
    }
    for name, (run, most) in runs.items():
        common.clean_up(spark)
        out = run()
        assert len(stored(spark)) <= most, (name, len(stored(spark)))
        out.collect()
    with common.temporary() as keep:
        kept = keep(common.written(docs))
        common.written(docs)
    assert kept.count() == len(TEXTS) and len(stored(spark)) <= 2
    common.clean_up(spark)
    assert not stored(spark)


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tesselark import storage
    from tesselark.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    for folder in (common.shared_dir, storage.checkpoint_dir):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            folder(far)


# the pipeline


def brute_stage(name, rows, trusted, items):
    """(id, text) rows that a stage keeps."""
    if name == "quality_rules":
        return [r for r, x in zip(rows, judged(rows, trusted), strict=True) if x[-1]]
    if name == "line_dedup":
        return sorted((i, t) for i, _, _, t in brute_lines(rows) if t.strip(WHITE))
    if name == "ngram_join":
        order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
        root = brute_components([(k, rows[i][1]) for k, i in enumerate(order)])
        return [rows[i] for k, i in enumerate(order) if root[k][1] == k]
    hits = [brute_hits([r], items)[0][2] for r in rows]
    return [r for r, h in zip(rows, hits, strict=True) if not h]


def test_pipeline_stages(spark, small):
    """Each stage against brute force on what its predecessor kept."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.where("quality = 1 and coalesce(toxic, 0) = 0").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows, df = sorted(whole(small)), small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, DATA)
        rows = brute_stage(name, rows, trusted, items)
        assert df.columns == small.columns
        df = df.checkpoint()
        assert sorted(whole(df)) == sorted(rows), name
    assert len(rows) > 50
    check_packing(packed_rows(corpus_pipeline.packing_stage(spark, df, DATA)), rows)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t"), (4, PROSE), (4, PROSE), (None, PROSE), (None, PROSE), (5, PROSE + " tail"), (6, "one two three four five six seven eight nine ten eleven"),
    (7, "\n".join([" ".join(f"line{k}word{j}" for j in range(12)) for k in range(6)])), (8, "line0word0 " + " ".join(f"line0word{j}" for j in range(1, 12)) + "\n \n\t"), (9, " ".join(f"q{j}" for j in range(60_000))), (10, "x " * 50_000),
]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_pipeline_stage_on_awkward_rows(spark, none, stage):
    """Nulls, empty and very long texts, ties, repeated rows, rows without id, an empty table, and columns named like the stages' own."""
    run = dict(corpus_pipeline.STAGES)[stage]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.where("quality = 1 and coalesce(toxic, 0) = 0").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    passage = AWKWARD + [(11, f"before {items[0][1]} after")]
    df = spark.createDataFrame([(i, t, None, "hot", None, *EXTRA) for i, t in passage], SCHEMA).repartition(3)
    out = run(spark, df, DATA)
    assert run(spark, none, DATA).count() == 0
    if stage == "packing":
        check_packing([r for r in packed_rows_with_nulls(out)], passage)
        return
    assert out.columns == df.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    if stage == "line_dedup":  # rows without id are the last document
        want = [(None if i == line_dedup.LAST_ID else i, t) for i, t in brute_stage(stage, [(line_dedup.LAST_ID if i is None else i, t) for i, t in passage], trusted, items)]
    else:
        want = brute_stage(stage, passage, trusted, items)
    assert sorted(whole(out), key=order) == sorted(want, key=order)


def packed_rows_with_nulls(df):
    return [tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]


def test_pipeline_leaves_only_what_its_result_reads(spark):
    from tesselark.llm import common

    common.clean_up(spark)
    out = corpus_pipeline.run(spark, DATA)
    assert len(stored(spark)) <= 2  # the last stage's documents and its pieces
    assert out.count() > 50
    common.clean_up(spark)


def test_components_of_stars_paths_cycles_and_trees(spark):
    path, star = [(i, i + 1) for i in range(100, 140)], [(200, i) for i in range(201, 260)]
    cycle, high, tree = [(300 + i, 300 + (i + 1) % 9) for i in range(9)], [(450, i) for i in range(400, 450)], [(500 + i, 500 + i // 2) for i in range(1, 64)]
    mixed = [(int(a), int(b)) for a, b in np.random.default_rng(3).integers(600, 900, (200, 2)) if a != b]
    for edges in ([], star, path, cycle, high, star + star[::-1] + path, path + star + cycle + high + tree + mixed):
        least = {i: i for e in edges for i in e}
        while any(least[a] != least[b] for a, b in edges):
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
        assert len(got) == len(least) and {r["id"]: r["component"] for r in got} == least
