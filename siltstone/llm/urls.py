"""URL rules and a bit-parallel wildcard automaton.

Glob patterns over a canonical URL (host and path) are packed, one after the other, into a multiword Shift-And mask: a
bit stands for a position in a pattern, a step shifts all of them at once, keeps those that accept the next byte, and
keeps a bit in place where a star stands after it. `*` matches within a host or a path part, `**` anything, `?` one byte
but `/`. All patterns run over all URLs of a batch at the same time, a byte a step.

A host and path rule is a pattern too: the host as it is, or anything that ends with a dot before it, then the path's
beginning. The rule with the longest host and path wins; the rest is judged by the block patterns.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and no block pattern, and is
allowed; URLs of any length are taken whole; repeated rows are judged alike; ties between rules go to the first; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ascii_lower

#: (verdict, host, path): fixed values of the production rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Globs over host and path that block what no rule decides.
HOSTS = ("spam", "cheap-pills", "casino", "betting", "payday-loan", "phish", "malware", "warez", "porn", "escort")
FOLDERS = ("login", "signin", "cart", "checkout", "wp-admin", "cgi-bin")
FILES = ("exe", "msi", "apk", "dmg", "iso", "zip")
BLOCK = (*[g for h in HOSTS for g in (f"*{h}*/**", f"*{h}*")], *[f"**/{f}/**" for f in FOLDERS], *[f"**.{f}" for f in FILES])
#: Rows of state that are stepped together.
ROWS = 1 << 14


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Automaton:
    """Multiword Shift-And masks of glob patterns, each anchored at both ends."""

    def __init__(self, globs: list[str]):
        takes: list[np.ndarray] = []
        stays: list[np.ndarray] = []
        self.first, self.last = [], []
        for g in globs:
            self.first.append(len(takes))
            takes.append(np.zeros(256, bool))  # the state before the first byte
            stays.append(np.zeros(256, bool))
            raw, i = g.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    stays[-1][:] = True
                    i += 2
                elif raw[i : i + 1] == b"*":
                    own = np.ones(256, bool)
                    own[ord("/")] = False
                    stays[-1] |= own
                    i += 1
                else:
                    one = np.zeros(256, bool)
                    if raw[i : i + 1] == b"?":
                        one[:] = True
                        one[ord("/")] = False
                    else:
                        one[raw[i]] = True
                    takes.append(one)
                    stays.append(np.zeros(256, bool))
                    i += 1
            self.last.append(len(takes) - 1)
        self.words = max(1, (len(takes) + 63) // 64)
        self.take, self.stay = self._pack(takes), self._pack(stays)
        start = np.zeros((max(1, len(takes)), 1), bool)
        start[self.first] = True
        self.start = self._pack(list(start))[0]

    def _pack(self, masks: list[np.ndarray]) -> np.ndarray:
        """(byte, word) masks with a bit for each state."""
        m = np.zeros((len(masks[0]) if masks else 256, self.words * 64), bool)
        for i, x in enumerate(masks):
            m[:, i] = x
        return np.packbits(m, axis=1, bitorder="little").view(np.uint64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """(text, pattern) matches."""
        out = np.zeros((len(texts), len(self.first)), bool)
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            own, joined = size[rows], np.frombuffer(b"".join(texts[i] for i in rows) + b"\0", np.uint8)
            begin = np.cumsum(own) - own
            state = np.repeat(self.start[None, :], len(rows), axis=0)
            left = len(rows)
            for step in range(int(own.max(initial=0))):
                while own[left - 1] <= step:  # sorted by length: those that ended keep their state
                    left -= 1
                s, c = state[:left], joined[begin[:left] + step]
                moved = s << np.uint64(1)
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
                state[:left] = (moved & self.take[c]) | (s & self.stay[c])
            last = np.array(self.last, np.int64)
            out[rows] = (state[:, last // 64] >> (last % 64).astype(np.uint64)) & np.uint64(1)
        return out


class Filter:
    """Rules and block patterns in one automaton."""

    def __init__(self, rules: tuple[tuple[str, str, str], ...] = RULES, block: tuple[str, ...] = BLOCK):
        self.rules = sorted(rules, key=lambda r: -(len(r[1]) + len(r[2])))
        globs = [g for _, host, path in self.rules for g in (f"{host}{path}**", f"*.{host}{path}**")]
        self.n, self.automaton = len(globs), Automaton([*globs, *block])

    def judge(self, urls: list[str]) -> tuple[list[str | None], list[str]]:
        """Rule (as host and path) and verdict of canonical URLs."""
        m = self.automaton.match([u.encode() for u in urls])
        fits = m[:, : self.n : 2] | m[:, 1 : self.n : 2]
        which = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
        bad = m[:, self.n :].any(axis=1)
        names = [h + p for _, h, p in self.rules]
        rule = [names[i] if i >= 0 else None for i in which.tolist()]
        return rule, [self.rules[i][0] if i >= 0 else "block" if b else "allow" for i, b in zip(which.tolist(), bad.tolist(), strict=True)]


def judge(pages: DataFrame, filters: Filter | None = None, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    own = filters or Filter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rule, verdict = own.judge([h + p for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    url = F.col(url_col)
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return p.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _regex(glob: str) -> str:
    """The glob as a regular expression."""
    kinds = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(kinds.get(part) or re.escape(part) for part in re.split(r"(\*\*|\*|\?)", glob) if part)


_BLOCKED = "|".join(map(_regex, BLOCK))
ORACLE_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_full_match(host || path, '(?s){_BLOCKED}') THEN 'block'
  ELSE 'allow' END AS verdict
FROM j
"""
