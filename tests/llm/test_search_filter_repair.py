"""Hard negatives, URL filters and conversation repair against brute-force versions in plain Python, on awkward rows and on random ones."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselark.llm import hard_negatives, turn_repair, url_filter
from tesselark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_url_filter", "op13_turn_repair"])
def test_query_equals_sql(spark, con, name):
    df, other = QUERIES[name](spark, DATA), con.execute(SQL[name])
    order = sorted(df.columns)
    names = [d[0] for d in other.description]
    assert order == sorted(names)
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == sorted(str([r[names.index(c)] for c in order]) for r in other.fetchall())


# hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    id_key = lambda i: math.inf if i is None else i
    out = []
    for a, (i, v, label) in enumerate(ok):
        if not is_anchor(i):
            continue
        score = [sum(x * y for x, y in itertools.zip_longest(v, w, fillvalue=0)) for _, w, _ in ok]
        best = sorted((b for b in range(len(ok)) if b != a and ok[b][2] == label), key=lambda b: (-score[b], id_key(ok[b][0])))[:positives]
        for p in best:
            far = [b for b in range(len(ok)) if ok[b][2] != label and low * score[p] <= 100 * score[b] <= high * score[p]]
            far.sort(key=lambda b: (-score[b], id_key(ok[b][0])))
            out += [(i, ok[p][0], rank, ok[b][0], score[p], score[b]) for rank, b in enumerate(far[:negatives], 1)]
    return out


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row string, block string")
    return list(map(tuple, hard_negatives.mine_hard_negatives(df.repartition(3), F.col("vec_id") % 4 == 0, **how).collect()))


def in_any_order(rows):
    return sorted(map(str, rows))


def test_negatives_equal_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for i in range(260):
        centre = i % 3
        rows.append((i, [draw.gauss(0.4 if d == centre else 0.1, 0.2) for d in range(7)], i % 5 % 3, "x", "y"))
    same = [0.25] * 7
    rows += [(1000 + i, same, i % 2, "x", "y") for i in range(40)]  # ties
    rows += [(1004, same, 0, "x", "y"), (8, rows[8][1], 2, "x", "y")]  # repeated ids
    rows += [(None, same, 1, "x", "y"), (2000, None, 1, "x", "y"), (2004, same, None, "x", "y"), (2008, [0.1, None], 1, "x", "y"), (2012, [math.nan] * 7, 1, "x", "y"), (2016, [math.inf] * 7, 1, "x", "y")]
    rows += [(2020, [], 0, "x", "y"), (2024, [0.5, 0.5], 1, "x", "y"), (2028, [-0.4] * 7, 1, "x", "y")]
    want = brute_negatives([r[:3] for r in rows], lambda i: i is not None and i % 4 == 0)
    assert len(want) > 500
    assert in_any_order(mined(spark, rows)) == in_any_order(want)


def test_negatives_with_small_blocks(spark, monkeypatch):
    """Many blocks of rows and anchors, few rows at once: the same rows."""
    draw = random.Random(6)
    rows = [(i, [draw.uniform(-0.1, 0.5) for _ in range(5)], i % 2, "x", "y") for i in range(300)]
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 3)
    want = brute_negatives([r[:3] for r in rows], lambda i: i % 4 == 0, negatives=3)
    assert in_any_order(mined(spark, rows, negatives=3)) == in_any_order(want)


def test_bounds_hold_every_score():
    draw = np.random.default_rng(1)
    x, y = np.floor(draw.normal(0, 30, (500, 9))), np.floor(draw.normal(0, 30, (8, 9)))
    marks = np.ceil(np.quantile(x[:100], np.arange(1, hard_negatives.CELLS) / hard_negatives.CELLS, axis=0).T)
    cells = np.zeros((500, 10), dtype="int64")
    for d in range(9):
        cells[:, d] = np.searchsorted(marks[d], x[:, d], side="right")
    block = type("Block", (), {"extent": (x.min(axis=0), x.max(axis=0))})
    lower, upper = hard_negatives.bounds(hard_negatives.tables(y, block, marks), (cells[:, ::2] * hard_negatives.CELLS + cells[:, 1::2]).T)
    exact = x @ y.T
    assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).mean() < 2 * np.abs(exact).mean() + 5000


def test_huge_components_and_empty_table(spark):
    rows = [(i, [3e30 if i % 2 else 1.0, 1.0], i % 3, "x", "y") for i in range(24)]
    assert all(abs(r[4]) <= hard_negatives.LARGEST for r in mined(spark, rows))
    assert mined(spark, []) == []


# URL filters

WORDS = ["net", "example.net", "a.example.net", "xnet", "example.com", "org", "b.org", "spam.com", "EXAMPLE.Net", "", "münchen.net", "net:80", "me@example.net"]
PATHS = ["", "/", "/en/", "/en", "/de/x", "/fr/", "/EN/", "/fr/a*b", "//", "/spam/x.exe", "/a/wp-login.php", "/en/\nx"]
TAILS = ["", "?q=/de/", "#/fr/", "?a#b"]


def urls():
    out = [f"{scheme}{h}{p}{t}" for scheme, (h, p, t) in zip(itertools.cycle(["http://", "https://", "x://"]), itertools.product(WORDS, PATHS, TAILS), strict=False)]
    return [*out, None, "", "no scheme/de/", "://", "http:/x.net/", "a://b://net/", "http://net/" + "a" * 5000 + ".exe", "http://" + "x." * 4000 + "org/fr/" + "é" * 3000]


def brute_url(url, sites, globs, default):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in sites if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], max(fits)[4], None
    expression = lambda g: re.sub(r"(\\\*)+", lambda m: ".*" if len(m[0]) > 2 else "[^/]*", re.escape(g))
    fits = [(len(g), v == "block", g, v) for v, g in globs if re.fullmatch(expression(g), f".{host}{path}", re.S)]
    return (host, path, None, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default, None)


@pytest.mark.parametrize("default", ["allow", "block"])
def test_urls_equal_brute_force(spark, default):
    given_ = urls()
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(given_)], "page_id long, url string, host string").repartition(3)
    more = (*url_filter.GLOBS, ("allow", "*.spam.com/en*"), ("block", "*"), ("allow", "**b**e"))
    got = {r[0]: tuple(r)[1:] for r in url_filter.filter_urls(df, globs=more, default=default).collect()}
    assert got == {i: brute_url(u, url_filter.SITE_RULES, more, default) for i, u in enumerate(given_)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab/*", max_size=9), min_size=1, max_size=40), st.lists(st.binary(max_size=12).map(lambda b: bytes(b"ab/"[x % 3] for x in b)), min_size=1, max_size=30))
def test_automaton_equals_expressions(globs, texts):
    expressions = [re.compile(re.sub(r"(\\\*)+", lambda m: ".*" if len(m[0]) > 2 else "[^/]*", re.escape(g)), re.S) for g in globs]
    i, which = url_filter.Automaton(globs).fits(texts)
    want = {(k, w) for k, t in enumerate(texts) for w, e in enumerate(expressions) if e.fullmatch(t.decode())}
    assert set(zip(i.tolist(), which.tolist(), strict=True)) == want


def test_thousands_of_rules(spark):
    """3,000 rules in over 500 words; escapes keep a rule's own stars and backslashes plain."""
    sites = [("block", f"site{i}.com", f"/p{i % 7}*\\") for i in range(3000)]
    rows = [(i, f"https://w.site{i}.com/p{i % 7}*\\x" if i % 2 else f"https://site{i}.com/p{i % 7}zz") for i in range(60)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), sites, ()).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {i: "block" if i % 2 else "allow" for i in range(60)}


def test_no_rules_and_no_pages(spark):
    df = spark.createDataFrame([(None, "http://a/b"), (1, None)], "page_id long, url string")
    assert sorted((r["page_id"] or 0, r["verdict"], r["host"]) for r in url_filter.filter_urls(df, (), ()).collect()) == [(0, "allow", "a"), (1, "allow", "")]
    assert url_filter.filter_urls(df.limit(0)).collect() == []


# conversation repair


def brute_path(initials, faults):
    """The least (cost, audit) by a search over whole audits in order of cost, then letters."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(initials) and state in ("", "a"):
            return cost, audit
        if (at, state) in seen and len(seen) > 5000:
            continue
        seen.add((at, state))
        if cost > 4 * len(initials):
            continue
        role = next(r for r in "ua" if (state, r) in steps)
        heapq.heappush(heap, (cost + 3, audit + "I", at, steps[state, role]))
        if at < len(initials):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if faults[at] != turn_repair.LOST:
                more = 3 * (faults[at] == turn_repair.CUT)
                if (state, initials[at]) in steps:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, steps[state, initials[at]]))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, steps[state, role]))
    raise AssertionError


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaa-u"), st.sampled_from([0, 0, 0, 1, 2])), max_size=5))
def test_cheapest_equals_search(turns):
    initials, faults = "".join(x for x, _ in turns), bytes(y for _, y in turns)
    assert turn_repair.cheapest(initials, faults) == brute_path(initials, faults)


def brute_plan(turns):
    """turns: (turn, role, text) in order, as they are after damage."""
    counts, seen, initials, faults = defaultdict(int), set(), "", []
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        initials += role[:1] if role[:1] in tuple("sua") else "-"
        faults.append({None: 0, "truncated": 1}.get(fault, 2))
    cost, audit = turn_repair.cheapest(initials, bytes(faults))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    out, rest, state = [], list(turns), ""
    for edit in audit:
        role = "assistant" if state == "u" else "user"
        if edit == "I":
            out.append(f"{role}:")
        else:
            _, own, text = rest.pop(0)
            if edit == "D":
                continue
            role = own if edit == "K" else role
            out.append(f"{role}:{text}")
        state = role[0]
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_repair(rows):
    """By conv_id what op13 returns; rows (conv_id, turn, role, text)."""
    after = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (c, turn))
        harm, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        text, role = ("" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text), "user" if harm == 4 else role
        after[c] += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    mark = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {c: brute_plan(sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, mark(r)))) for c, x in after.items()}


def repaired(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r[c] for c in names) for r in out}


def test_repair_equals_brute_force(spark, tmp_path):
    draw, rows = random.Random(3), []
    for c in range(120):
        for turn in range(draw.randrange(1, 9)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "User"])
            rows.append((c, draw.choice([turn, turn, turn, None, turn + 3]), role, draw.choice(["Yes.", "No!", "cut", "", "  \n", None, "Why?\t", "Über . ", "Yes.", "long " * 50])))
    rows += [(None, t, "user", "Hi.") for t in range(4)] + [(None, None, None, None)] * 3 + rows[:5]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", "word " * 20_000 + ".") for t in range(4)]
    assert repaired(spark, tmp_path, rows) == brute_repair(rows)


def test_dropped_conversations_and_empty_table(spark, tmp_path):
    dropped = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, tmp_path, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(spark, tmp_path, []) == {}


def test_long_conversation():
    """Ten thousand turns, a third of them faulty: cost and audit in time that grows with the turns."""
    draw = random.Random(2)
    initials = "".join(draw.choice("uaua-") for _ in range(10_000))
    cost, audit = turn_repair.cheapest(initials, bytes(draw.choice([0, 0, 1, 2]) for _ in range(10_000)))
    assert cost > 0 and len(audit) - audit.count("I") == 10_000


def test_repaired_turns_are_a_legal_conversation(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    turns = turn_repair.damaged(rows)
    plans = turn_repair.written(turn_repair.repair_plans(turns))
    by = defaultdict(list)
    for r in turn_repair.repaired_turns(turns, plans).collect():
        by[r["conv_id"]].append((r["place"], r["role"][0]))
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(x for _, x in sorted(v))) for v in by.values())
    assert all([p for p, _ in v] == list(range(len(v))) for v in by.values())
