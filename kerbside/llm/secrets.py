"""Secret scans over a trigram inverted index.

Every rule is a regular expression. From it a Boolean trigram query is
derived: which three-byte strings any match must contain, as alternatives of
conjunctions. Texts are indexed in blocks (the rows of one batch): a posting
list per trigram names the texts of the block holding it, kept for just the
trigrams that some query asks for. Intersecting and uniting posting lists
leaves the candidates of each rule, and only those are verified with the
expression itself. Rules without mandatory trigrams scan every text.

Index, intersection and verification of a block happen in one task, so texts
are read once and never shuffled, whatever the share of candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import small_batches

_MAX_STRINGS = 64


class Rule(NamedTuple):
    """A kind of secret: its expression, and the least length of ``group`` for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_any_case(w) for w in ("password", "passwd", "secret", "token")] + [_any_case("api") + "_?" + _any_case("key")])

# The three base kinds.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # maximal runs, so the short ones need not be matched first
)
# Published formats of further credentials, each with a mandatory literal.
EXTRA = (
    Rule("session", r"ASIA[A-Z0-9]{16}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + EXTRA

# A query is a set of alternatives; each is the set of trigrams that must all occur.
Query = frozenset[frozenset[bytes]]
_ALL: Query = frozenset([frozenset()])


def _trigrams(text: str) -> frozenset[bytes]:
    data = text.encode()
    return frozenset(data[i:i + 3] for i in range(len(data) - 2))


def _and(a: Query, b: Query) -> Query:
    both = frozenset(x | y for x in a for y in b)
    return frozenset(x for x in both if not any(y < x for y in both))


def _of(strings: set[str]) -> Query:
    found = frozenset(_trigrams(s) for s in strings)
    return frozenset(x for x in found if not any(y < x for y in found))


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(all strings that the tree can match, if few; what any match must contain)."""
    runs: set[str] = {""}      # strings of the exact run that ends here
    query = _ALL
    exact = True
    for op, value in tree:
        name = str(op)
        strings: set[str] | None = None
        inner = _ALL
        if name == "LITERAL":
            strings = {chr(value)}
        elif name == "IN":
            codes = [c for kind, v in value for c in (
                [v] if str(kind) == "LITERAL" else range(v[0], v[1] + 1) if str(kind) == "RANGE" else [None] * 99)]
            strings = {chr(c) for c in codes} if None not in codes and len(codes) <= 4 else None
        elif name == "SUBPATTERN":
            strings, inner = _walk(value[-1])
        elif name == "BRANCH":
            parts = [_walk(branch) for branch in value[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*[s for s, _ in parts])
            inner = frozenset().union(*[q for _, q in parts])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = value
            one, body_query = _walk(body)
            if one is not None and (low, high) == (0, 1):
                strings = one | {""}
            elif one is not None and low == high and low <= 4:
                strings = {"".join(p) for p in product(one, repeat=low)} if len(one) ** low <= _MAX_STRINGS else None
            if low:
                inner = body_query
        elif name == "AT":
            strings = {""}
        joined = {a + b for a, b in product(runs, strings)} if strings is not None else None
        if joined is not None and len(joined) <= _MAX_STRINGS:
            runs = joined
        else:
            query = _and(_and(query, _of(runs)), _of(strings) if strings is not None else inner)
            runs, exact = {""}, False
    if exact:
        return runs, _of(runs)
    return None, _and(query, _of(runs))


def trigram_query(pattern: str) -> Query:
    """The trigrams that any match of ``pattern`` must contain; an empty alternative means none."""
    return _walk(re._parser.parse(pattern))[1]


class BlockIndex:
    """Posting lists of a block of texts for the trigrams that the queries ask for."""

    def __init__(self, wanted: list[bytes]):
        self.number = {t: i + 1 for i, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.uint16)
        for trigram, i in self.number.items():
            self.table[trigram[0] << 16 | trigram[1] << 8 | trigram[2]] = i

    def postings(self, data: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        """Trigram number to the sorted texts holding it; ``ends`` are the ends of the texts in ``data``."""
        if len(data) < 3:
            return {}
        wide = data.astype(np.uint32)
        codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        found = self.table[codes]
        at = np.flatnonzero(found)
        text = np.searchsorted(ends, at, side="right")
        inside = at + 3 <= ends[text]
        pairs = np.unique(found[at[inside]].astype(np.int64) << 32 | text[inside])
        trigram = pairs >> 32
        cuts = np.flatnonzero(np.diff(trigram)) + 1
        return {int(part[0] >> 32): part & 0xFFFFFFFF for part in np.split(pairs, cuts) if len(part)}

    def candidates(self, postings: dict[int, np.ndarray], query: Query, texts: int) -> np.ndarray:
        none = np.zeros(0, np.int64)
        united = none
        for trigrams in query:
            lists = sorted((postings.get(self.number[t], none) for t in trigrams), key=len)
            if not lists:
                return np.arange(texts)
            met = lists[0]
            for other in lists[1:]:
                met = np.intersect1d(met, other, assume_unique=True)
            united = np.union1d(united, met)
        return united


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): all verified spans, ordered by start, then by the order of the rules.

    A span is a struct of kind, start and end in code points, end exclusive.
    Matches of a rule are leftmost and do not overlap; one that is too short
    is dropped after it has used up its text. Null and empty texts have no
    spans, repeated rows are scanned each, an empty table gives no rows.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for q in queries if frozenset() not in q for x in q for t in x})
    rows = small_batches(docs).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = BlockIndex(wanted)
        checks = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            column = batch.column(1)
            texts = column.to_pylist()
            encoded = [t.encode() if t else b"" for t in texts]
            ends = np.cumsum([len(e) for e in encoded]) if encoded else np.zeros(0, np.int64)
            postings = index.postings(np.frombuffer(b"".join(encoded), np.uint8), ends)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, query, check) in enumerate(zip(rules, queries, checks)):
                for i in index.candidates(postings, query, len(texts)).tolist():
                    for m in check.finditer(texts[i] or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[i].append((m.start(), k, m.end()))
            listed = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(s)] for s in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(listed, kind)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans; cases as in ``scan``."""
    base = [r.kind for r in BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kinds):
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    return scan(docs).select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(of(base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
