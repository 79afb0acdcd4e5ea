"""Secret scan through a trigram inverted index.

Every rule's regular expression is turned into a Boolean query on trigrams that any match must hold. Texts are indexed in
segments: postings list, for each trigram that some query names, the segment's texts that hold it. A rule's query is
answered by uniting and intersecting postings, and only the texts it leaves are searched by the expression itself. A rule
without mandatory trigrams, such as a run of hexadecimal digits, has the query "all texts" and scans fully.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import product
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plazaflow.llm.common import batches, texts, utf8


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose `group` is shorter than `least` characters are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False  # letters in either case

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


#: The base rules, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: The rest of a private key: up to the END line of the same label, with no other BEGIN between; where there
#: is none, over all following lines of base64 or PEM headers (line ends also as a backslash and n) and long runs of base64.
_EOL = r"(?:\r?\n|(?:\\r)?\\n)"
_BASE64_LINE = rf"""(?:[\x20\t]*{_EOL})+[\x20\t>]*(?:[A-Za-z0-9+/=]+|(?:Proc-Type|DEK-Info):[^\r\n\\]*)(?=[\x20\t]*(?:[\r\n"']|\\[rn]|\Z))"""
_KEY_BODY = rf"(?:(?:(?!-----BEGIN\x20)[\s\S])*?-----END\x20\1PRIVATE\x20KEY-----|(?:{_BASE64_LINE}|[\x20\t]+[A-Za-z0-9+/=]{{40,}})*)"
#: Published formats of other credentials.
MORE = (
    Rule("temporary", r"ASIA[A-Z0-9]+", 20),
    Rule("private_key", r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----" + _KEY_BODY),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]+", 24),
)
RULES = BASE + MORE

#: A query is None (all texts), a trigram, or ("and" | "or", queries).
Query = str | tuple | None
#: Exact sets larger than this, and classes of more characters, are given up.
EXACT, CLASS = 64, 6


def _both(kind: str, parts: list[Query]) -> Query:
    """Conjunction or disjunction in the smallest form."""
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(q for p in parts if p is not None for q in (p[1] if isinstance(p, tuple) and p[0] == kind else (p,))))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _grams(strings: set[str]) -> Query:
    """What a text that holds one of the strings must hold."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _characters(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < CLASS:
            found |= {chr(x) for x in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= CLASS else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """Of a sequence: all strings that it matches, in lower case, if they are few, else None; and its query."""
    exact: set[str] | None = {""}
    queries: list[Query] = []
    whole = True
    for kind, value in tree:
        part, query = _item(kind, value)
        if part is not None and len(exact) * len(part) <= EXACT:
            exact = {a + b for a, b in product(exact, part)}
            continue
        queries += [_grams(exact), query]
        whole, exact = False, part if part is not None else {""}
    return (exact, _grams(exact)) if whole else (None, _both("and", [*queries, _grams(exact)]))


def _item(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, None
    if kind is op.IN:
        found = _characters(value)
        return ({x.lower() for x in found}, None) if found else (None, None)
    if kind is op.SUBPATTERN:
        return _walk(value[3])
    if kind is op.BRANCH:
        parts = [_walk(x) for x in value[1]]
        every = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
        return (every if every is not None and len(every) <= EXACT else None), _both("or", [p[1] for p in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        part, query = _walk(inner)
        if (low, high) == (0, 1) and part is not None:
            return part | {""}, None
        return (part, query) if low == high == 1 else (None, query if low else None)
    return (set([""]), None) if kind is op.AT else (None, None)


def trigram_query(pattern: str) -> Query:
    """Boolean query on lower-case trigrams that every text with a match of `pattern` satisfies; None if there is none."""
    exact, query = _walk(parser.parse(pattern))
    return _grams(exact) if exact is not None else query


def _named(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_named, query[1]))


class Index:
    """Postings of one segment, for the trigrams of some queries only."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, trigrams: dict[str, int]):
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.rows = len(starts) - 1
        wanted = np.zeros(1 << 16, bool)
        wanted[[code >> 8 for code in trigrams.values()]] = True
        lead = low[:-1].astype(np.uint16) << 8 | low[1:]
        at = np.flatnonzero(wanted[lead[:-1]]) if len(low) > 2 else np.zeros(0, np.int64)
        code = lead[at].astype(np.int64) << 8 | low[at + 2] if len(at) else at
        row = np.searchsorted(starts, at, "right") - 1
        inside = at + 3 <= starts[row + 1] if len(at) else np.zeros(0, bool)
        at, code, row = at[inside], code[inside], row[inside]
        self.postings = {gram: np.unique(row[code == value]) for gram, value in trigrams.items()}

    def rows_of(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings[query]
        found = [self.rows_of(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        for more in found[1:]:
            found[0] = np.intersect1d(found[0], more, assume_unique=True)
        return found[0]


def spans(text: str, rule: Rule, search: re.Pattern) -> list[tuple[int, int]]:
    """The rule's matches in a text: leftmost, not overlapping; those that are too short are dropped afterwards."""
    return [m.span() for m in search.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(rule, rule.compiled(), trigram_query(rule.pattern)) for rule in rules]
        grams = sorted(set().union(*(_named(q) for _, _, q in self.rules)))
        assert all(len(g.encode()) == 3 for g in grams), "rules are written in ASCII"
        self.trigrams = {g: int.from_bytes(g.encode(), "big") for g in grams}

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule's number, end) of every secret in each text, sorted; places count code points."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        index, strings = Index(*utf8(column), self.trigrams), texts(column)
        for k, (rule, search, query) in enumerate(self.rules):
            for i in index.rows_of(query):
                found[i] += [(a, k, b) for a, b in spans(strings[i], rule, search)]
        for each in found:
            each.sort()
        return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): what each rule finds in a whole text, by start and then rule.

    A map without any shuffle, in segments of some megabytes. A null or empty text has no spans; repeated rows and null
    ids come out as they go in; other columns are dropped, whatever their names.
    """
    schema = "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches(source, "text"):
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in each] for each in scanner.scan(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def listing(each: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in each)


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): find_secrets() as counts, a digest of the base rules' spans and a list."""
    names = ["doc_id", *(f"n_{r.kind}" for r in BASE), "base_sha256", "spans"]
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches(source, "text"):
            found = scanner.scan(batch.column("text"))
            base = [[x for x in each if x[1] < len(BASE)] for each in found]
            counts = [pa.array([sum(x[1] == k for x in each) for each in base], pa.int64()) for k in range(len(BASE))]
            hashes = pa.array([sha256(listing(each, rules).encode()).hexdigest() for each in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *counts, hashes, pa.array([listing(x, rules) for x in found], pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns; in `text` every secret gives way to `mask`, overlapping ones to a single mask; null stays null."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches(source, "text"):
            column = batch.column("text")
            out = []
            for text, each in zip(column.to_pylist(), scanner.scan(column)):
                if each:
                    parts, end = [], 0
                    for a, _, b in each:
                        if a >= end:
                            parts += [text[end:a], mask]
                        end = max(end, b)
                    text = "".join([*parts, text[end:]])
                out.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, column.type))

    return docs.mapInArrow(run, docs.schema)
