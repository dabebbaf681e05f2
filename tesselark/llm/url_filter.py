r"""Operator 12: URL filters by a bit-parallel wildcard automaton.

A pattern is a glob over bytes: ``*`` stands for any run without ``/``, ``**`` for any run, a backslash makes the next character plain. All patterns
are packed one behind the other into 64-bit words, one bit a state (a pattern of m plain bytes has m + 1 states). With one mask of states that a byte leads
into and one of states that it may stay in (a wildcard stands there), a step for all patterns is ``(states << 1) & enter[byte] | states &
stay[byte]``, the shift carrying over words; no mask enters a pattern's first state, so patterns do not run into each other. The URLs of a batch
go on side by side, byte by byte. Where only a few long ones are left, each goes on alone with the same masks as whole numbers.

A canonical URL is a dot, the host in lower case (A-Z) and the path, without query or fragment. A site rule (host, path) becomes the glob
``*.host`` + path + ``**``, which fits the host, all its subdomains and every path that begins with the rule's. The longest fitting site rule gives the
verdict (equal lengths: the longer host, then block before allow); where none fits, the longest fitting glob does; where none of those fits, the default.

Rows are judged one by one, nothing is shuffled. The rules go to the executors as masks, 4,096 bytes for each 64 states.

Defined cases: a null URL or one without ``://`` has an empty host and an empty path, which only a glob for ``.`` alone could fit; an empty path begins
with no rule's path; repeated rows are judged alike; a null page_id stays null; texts of any length are read to their end; an empty table gives no rows;
an empty list of rules leaves the default; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselark.llm.common import LOWER, UPPER, column

BLOCK, ALLOW = "block", "allow"
#: Site rules of the named query: verdict, host, path.
SITE_RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))
#: Globs of the named query over canonical URLs, for what no site rule fits.
GLOBS = ((BLOCK, "*spam*/**"), (BLOCK, "*pills*/**"), (BLOCK, "*casino*/**"), (BLOCK, "**/wp-login*"), (BLOCK, "**.exe"))
#: So many URLs or fewer go on alone; state words of URLs side by side.
ALONE, WORDS_AT_ONCE = 4, 1 << 18


def literal(text: str) -> str:
    """A glob that fits just this text."""
    return text.replace("\\", "\\\\").replace("*", "\\*")


def states_of(glob: str) -> tuple[bytes, list[str]]:
    """The plain bytes of a glob, and before each of them and at the end the wildcard that stands there ("" for none)."""
    plain, wild, at = bytearray(), [""], 0
    while at < len(glob):
        if glob[at] == "*":
            end = at
            while end < len(glob) and glob[end] == "*":
                end += 1
            wild[-1], at = max(wild[-1], "**" if end - at > 1 else "*", key=len), end
            continue
        at += glob[at] == "\\" and at + 1 < len(glob)
        for byte in glob[at].encode():
            plain.append(byte)
            wild.append("")
        at += 1
    return bytes(plain), wild


class Automaton:
    """All globs as masks over packed states."""

    def __init__(self, globs: Sequence[str]):
        parsed = [states_of(g) for g in globs]
        starts = np.cumsum([0, *(len(wild) for _, wild in parsed)])
        self.words = max(1, -(-int(starts[-1]) // 64))
        enter, stay = np.zeros((2, 256, self.words * 64), dtype=bool)
        first, last = np.zeros((2, self.words * 64), dtype=bool)
        for (plain, wild), start in zip(parsed, starts[:-1], strict=True):
            first[start] = last[start + len(plain)] = True
            for k, byte in enumerate(plain):
                enter[byte, start + k + 1] = True
            for k, w in enumerate(wild):
                stay[:, start + k] = bool(w)
                if w == "*":
                    stay[ord("/"), start + k] = False
        self.enter, self.stay, self.first, self.last = (self._packed(x) for x in (enter, stay, first, last))
        self.owner = np.repeat(np.arange(len(globs)), np.diff(starts))

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view("<u8")

    def states_after(self, urls: list[bytes]) -> np.ndarray:
        """The states of all patterns at the end of each URL (URLs x words)."""
        lengths = np.array([len(u) for u in urls], dtype="int64")
        order = np.argsort(-lengths, kind="stable")
        lengths, text = lengths[order], np.frombuffer(b"".join(urls[i] for i in order), dtype="uint8")
        starts, now = np.cumsum(lengths) - lengths, np.tile(self.first, (len(urls), 1))
        at, active = 0, int(np.count_nonzero(lengths > 0))
        while active > ALONE:
            byte, states = text[starts[:active] + at], now[:active]
            moved = states << np.uint64(1)
            moved[:, 1:] |= states[:, :-1] >> np.uint64(63)
            now[:active] = (moved & self.enter[byte]) | (states & self.stay[byte])
            at += 1
            while active and lengths[active - 1] <= at:
                active -= 1
        if active:
            whole = lambda x: int.from_bytes(x.astype("<u8").tobytes(), "little")
            enter, stay = [whole(x) for x in self.enter], [whole(x) for x in self.stay]
            for i in range(active):
                states = whole(now[i])
                for byte in text[starts[i] + at : starts[i] + lengths[i]].tobytes():
                    states = (states << 1) & enter[byte] | states & stay[byte]
                now[i] = np.frombuffer(states.to_bytes(self.words * 8, "little"), dtype="<u8")
        out = np.empty_like(now)
        out[order] = now
        return out

    def fits(self, urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (URL, glob) that fit, by places in the two lists."""
        ends = self.states_after(urls) & self.last
        i, bit = np.nonzero(np.unpackbits(ends.view("uint8"), axis=1, bitorder="little"))
        return i, self.owner[bit]


def filter_urls(pages: DataFrame, site_rules: Sequence[tuple[str, str, str]] = SITE_RULES, globs: Sequence[tuple[str, str]] = GLOBS, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule (the site rule that decided, host and path), verdict, glob (the glob that decided) of each row."""
    sites = sorted(site_rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != BLOCK, r))
    others = sorted(globs, key=lambda g: (-len(g[1]), g[0] != BLOCK, g))
    # by falling rank: what decides, its verdict
    ranked = [(v, host + path, None) for v, host, path in sites] + [(v, None, g) for v, g in others]
    verdicts, rules, named = (np.array([*x, y], dtype=object) for x, y in zip(zip(*ranked, strict=True) if ranked else [()] * 3, (default, None, None), strict=True))
    automaton = Automaton([f"*.{literal(host)}{literal(path)}**" for _, host, path in sites] + [g for _, g in others])
    at_once = max(1, WORDS_AT_ONCE // automaton.words)
    out = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict", "glob"))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                b = whole.slice(start, at_once)
                best = np.full(b.num_rows, len(ranked))
                i, which = automaton.fits([x.encode() for x in b["canonical"].to_pylist()])
                np.minimum.at(best, i, which)
                columns = [b["page_id"], b["host"], b["path"], *(pa.array(x[best], pa.string()) for x in (rules, verdicts, named))]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    url = F.coalesce(column("url").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    parts = pages.select(column("page_id").alias("page_id"), F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))
    return parts.select("*", F.concat(F.lit("."), "host", "path").alias("canonical")).mapInArrow(judge, out)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


OP12_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), globs(verdict, pattern, expression) AS (VALUES ('block', '*spam*/**', '^[^/]*spam[^/]*/'), ('block', '*pills*/**', '^[^/]*pills[^/]*/'), ('block', '*casino*/**', '^[^/]*casino[^/]*/'),
  ('block', '**/wp-login*', '/wp-login[^/]*$'), ('block', '**.exe', '\.exe$')
), judged AS (
  SELECT page_id, host, path,
    (SELECT max_by({'rule': h || p, 'verdict': verdict}, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS site,
    (SELECT max_by({'pattern': pattern, 'verdict': verdict}, length(pattern)) FROM globs WHERE regexp_matches('.' || host || path, expression, 's')) AS other
  FROM hosts
)
SELECT page_id, host, path, site.rule AS rule, coalesce(site.verdict, other.verdict, 'allow') AS verdict, CASE WHEN site IS NULL THEN other.pattern END AS "glob" FROM judged
"""
