"""Secret scans behind a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query. A block of documents is
indexed by those trigrams that some rule asks for, the rule's query is answered by
intersecting and uniting postings, and only the documents it leaves are matched by the
expression. Rules that demand no trigram (long hex runs) scan every document. Blocks are
index shards: nothing is shuffled, and a document's text is read in one place once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.trigrams import candidates, trigram_query, trigrams_of
from barloom.session import ship_package


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the least length of group ``group``; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    @cached_property
    def match(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches that are long enough, in code points."""
        return [m.span() for m in self.match.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The three base kinds, in the order in which spans that start together are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
# Kinds that the index makes cheap to add.
MORE = (
    # to the END line, else over the lines of the body that follow; line ends may be escaped
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:(?:\s*[A-Za-z-]{1,32}:[^\n]{0,200}\n)*(?:[A-Za-z0-9+/=\s\\]*-----END [A-Z ]{0,32}PRIVATE KEY-----|(?:[\s\\]*[A-Za-z0-9+/=]{40,})+(?:\s{1,4}[A-Za-z0-9+/=]+\r?(?m:$))?))?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,99}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE
#: Bytes of text indexed as one shard.
SHARD = 2_000_000


class Index:
    """Inverted index of a shard for the trigrams that some rule's query names."""

    def __init__(self, texts: list[str], wanted: np.ndarray) -> None:
        folded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, folded), np.int64, len(folded)) + 2
        raw = np.frombuffer(b"\0\0".join(folded) + b"\0\0", np.uint8)
        hit = np.flatnonzero(wanted[0][raw[:-2]] & wanted[1][raw[1:-1]] & wanted[2][raw[2:]]) if len(raw) > 2 else np.zeros(0, np.int64)
        code = raw[hit].astype(np.int32) << 16 | raw[hit + 1].astype(np.int32) << 8 | raw[hit + 2]
        doc = np.searchsorted(np.cumsum(sizes), hit, "right")
        found = np.unique(code.astype(np.int64) << 32 | doc)
        self.codes, self.docs = (found >> 32).astype(np.int64), (found & 0xFFFFFFFF).astype(np.int64)

    def postings(self, trigram: str) -> set[int]:
        a, b, c = trigram.encode()[:3]
        code = a << 16 | b << 8 | c
        lo, hi = np.searchsorted(self.codes, [code, code + 1])
        return set(self.docs[lo:hi].tolist())


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        queries = [trigram_query(r.pattern) for r in rules]
        plain = all(len(t.encode()) == 3 for q in queries for t in trigrams_of(q))
        self.queries = queries if plain else [q if all(len(t.encode()) == 3 for t in trigrams_of(q)) else True for q in queries]
        #: Bytes that stand first, second and third in some wanted trigram: a cheap first sieve.
        self.wanted = np.zeros((3, 256), bool)
        for q in self.queries:
            for t in trigrams_of(q):
                for place, byte in enumerate(t.encode()):
                    self.wanted[place, byte] = True

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end), in order of start, then rule."""
        index = Index(texts, self.wanted)
        everything = set(range(len(texts)))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for i in candidates(query, index.postings, everything):
                out[i] += [(a, number, b) for a, b in rule.spans(texts[i])]
        for spans in out:
            spans.sort()
        return out


def _shards(texts: pd.Series) -> Iterator[list[str]]:
    shard, size = [], 0
    for t in texts:
        t = t or ""
        shard.append(t)
        size += len(t)
        if size >= SHARD:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``secrets``: array of (kind, start, end), code points, end exclusive, by start, then rule.

    Null and empty texts have none. A column called secrets is replaced; every row is kept.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        for part in parts:
            found = [s for shard in _shards(part) for s in scanner.scan(shard)]
            yield pd.Series([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in found], dtype=object)

    return docs.withColumn("secrets", spans("text"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for every row of ``docs``."""
    found = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )


def mask(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """The text with every span, overlapping ones as one, replaced by its first rule's kind in brackets."""
    out, at = [], 0
    for start, number, end in spans:
        if start >= at:
            out += [text[at:start], f"[{rules[number].kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets in ``text`` masked and ``n_chars``, if there, made to fit. Every row is kept; null text stays null."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        for part in parts:
            found = [s for shard in _shards(part) for s in scanner.scan(shard)]
            yield pd.Series([None if t is None else mask(t, s, rules) if s else t for t, s in zip(part, found)], dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out
