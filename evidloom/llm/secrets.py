"""Secret scans: all rules, whole, as one minimal automaton that reads the bytes of a text once.

The combined automaton tells at which byte a rule's match is sure and at which it ends, leftmost, longest and without
overlaps for each kind. Where it began is read backwards from the byte where it was sure, no farther than the
kind's last match, so every byte is read once forwards and at most once backwards for each kind: the time is linear,
whatever the text. Texts without secrets cost one table step for each byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.byte_automaton import Combined, backward, parsed
from evidloom.llm.common import giving_back


@dataclass(frozen=True)
class Rule:
    """``pattern`` consumes text; a match stays if it also is a match of ``kept``.

    ``by_length``: a match of the pattern is one of ``kept`` exactly if it is long enough. Lengths are then compared
    where a match ends and not counted by the automaton, whose states they would multiply.
    """

    kind: str
    pattern: str
    kept: str
    by_length: bool = False


def either_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


_ASSIGN = "(" + either_case("password|passwd|secret|token|api_?key") + r")[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]"
BASE = (
    Rule("assign", _ASSIGN + "+", _ASSIGN + "{12,}"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14,}", True),
    Rule("hex", "[0-9a-f]{16,}", "[0-9a-f]{16,}"),  # shorter runs of these letters are everywhere and end nothing
)
#: Token formats with a fixed beginning, and headers of private keys.
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{16,}", True),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}", True),
    Rule("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{20,}", True),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
SPAN = "array<struct<kind:string,start:int,end:int>>"


class Event:
    """Stands in a row where a step tells something; a step from it fails, which ends the plain loop."""

    __slots__ = ("to", "told")

    def __init__(self, to: list, told: tuple):
        self.to, self.told = to, told


class Scanner:
    """Spans of secrets in bytes; made once on the driver, its arrays go to the tasks."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + ADDED):
        self.kinds = [r.kind for r in rules]
        self.any = Combined([(r.pattern.encode(), (r.pattern if r.by_length else r.kept).encode()) for r in rules])
        self.least = [int(parsed(r.kept.encode()).getwidth()[0]) if r.by_length else 0 for r in rules]
        self.back = [backward(r.pattern.encode()) for r in rules]
        self.rows = None

    def tables(self) -> Scanner:
        """Rows as lists of rows, which a task steps through fastest; a row's last entry is its number."""
        if self.rows is None:
            a = self.any
            rows: list[list] = [[] for _ in range(a.states)]
            for i, (to, code) in enumerate(zip(a.next.tolist(), a.code.tolist(), strict=True)):
                rows[i] += [Event(rows[x], a.events[c]) if c else rows[x] for x, c in zip(to, code, strict=True)]
                rows[i].append(i)
            self.rows, self.letters = rows, bytes(a.of_byte.tolist())
            self.steps = [(step.tolist(), whole.tolist(), dead) for step, whole, dead in self.back]
        return self

    def __getstate__(self):
        return self.__dict__ | {"rows": None, "letters": None, "steps": None}

    def _begin(self, k: int, data: bytes, end: int, lo: int) -> int:
        """Where the longest match of a rule that ends at ``end`` begins, from ``lo`` on."""
        rows, whole, dead = self.steps[k]
        state, found = 0, end
        for i in range(end - 1, lo - 1, -1):
            state = rows[state][data[i]]
            if whole[state]:
                found = i
            elif state == dead:
                break
        return found

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end), in order."""
        read, n, row, out = data.translate(self.letters), len(data), self.rows[0], []
        begun, free = [0] * len(self.kinds), [0] * len(self.kinds)

        def close(k: int, end: int, kept: bool) -> None:
            if kept and end - begun[k] >= self.least[k]:
                out.append((begun[k], k, end))
            free[k] = end

        steps = iter(read)
        while True:
            try:
                for b in steps:
                    row = row[b]
                at, more = n - 1, False
            except TypeError:  # the byte before told something; the one that failed is still to be read
                at, more = n - steps.__length_hint__() - 2, True
            if type(row) is not Event:
                break
            for k, opens, closes, kept in row.told:
                if closes:
                    close(k, at, kept)
                if opens:
                    begun[k] = self._begin(k, data, at + 1, free[k])
            row = row.to[read[at + 1]] if more else row.to
        for k, kept in self.any.at_end[row[-1]]:
            close(k, n, kept)
        return sorted(out)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """The same with places counted in code points."""
        data = text.encode()
        found = self.find(data)
        if found and len(data) != len(text):
            chars = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))
            found = [(int(chars[a]), k, int(chars[b])) for a, k, b in found]
        return found


def redacted(text: str, spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """The text with each stretch of overlapping secrets replaced by the first one's kind in brackets."""
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kinds[k]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


@lru_cache(maxsize=4)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + ADDED, redact: bool = False, name: str = "secrets") -> DataFrame:
    """``docs`` with a column ``name``: the text's secrets as (kind, start, end), in code points, end exclusive.

    With ``redact`` the text column has the secrets replaced. One pass without a shuffle; all rows and other columns
    stay, ``name`` must be new. A null text stays null and has no secrets. The automaton is bounded by the rules.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{name} is taken")
    sent = docs.sparkSession.sparkContext.broadcast(scanner_of(rules))
    at = docs.columns.index(text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value.tables()
        for batch in batches:
            texts, found = batch.column(at), []
            new = []
            for t in texts:
                text = t.as_py()
                spans = scanner.spans(text) if text else []
                found.append([{"kind": scanner.kinds[k], "start": a, "end": b} for a, k, b in spans])
                if redact:
                    new.append(redacted(text, spans, scanner.kinds) if spans else text)
            columns = list(batch.columns)
            if redact:
                columns[at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, span)], [*batch.schema.names, name])

    return docs.mapInArrow(giving_back(run), docs.select("*", F.lit(None).cast(SPAN).alias(name)).schema)


def digest(scanned: DataFrame, id_col: str = "doc_id", name: str = "secrets", base: tuple[str, ...] = tuple(r.kind for r in BASE)) -> DataFrame:
    """Per row: counts of the base kinds, the hash of the base spans' list, and the list of all spans."""

    def listed(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter(name, lambda s: s["kind"].isin(*base))
    kinds = F.transform(name, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in base]
    return scanned.select(F.col(id_col).alias("doc_id"), *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col(name)).alias("spans"))


def _oracle(rules: tuple[Rule, ...]) -> str:
    """The contract in DuckDB: each rule's matches and the gaps between them give their places."""
    quoted = [(r.kind, r.pattern.replace("'", "''"), r.kept.replace("'", "''")) for r in rules]
    found = " UNION ALL ".join(f"SELECT row, {k} AS k, '{kind}' AS kind, '{kept}' AS kept, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for k, (kind, p, kept) in enumerate(quoted))
    counts = ", ".join(f"count(s.k) FILTER (s.k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    listed = "string_agg(s.kind || ':' || s.lo || ':' || s.hi, ',' ORDER BY s.lo, s.k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT row, k, kind, kept, unnest(m) AS w, unnest(g[:len(m)]) AS gap, unnest(range(len(m))) AS i FROM found WHERE len(m) > 0),
placed AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY row, k ORDER BY i) AS hi FROM each),
s AS (SELECT row, k, kind, hi - length(w) AS lo, hi FROM placed WHERE regexp_full_match(w, kept))
SELECT doc_id, {counts}, sha256(coalesce({listed} FILTER (s.k < {len(BASE)}), '')) AS base_sha256, coalesce({listed}, '') AS spans
FROM d LEFT JOIN s USING (row) GROUP BY row, doc_id
"""


ORACLE = _oracle(BASE + ADDED)
