"""Secret scans: one minimal deterministic automaton of all rules marks, in one pass over the bytes, where secrets begin.

The rules are compiled whole and read backwards, so a pass from the end says of each byte which rules have a match that
begins there. Matches are taken from the left, as a search would; each one's end is the last byte at which the rule's
own anchored automaton accepts. No regular expression engine takes part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spindrift.llm.automaton import Automaton, compile_rules
from spindrift.llm.base import read, sha256_hex, slices


@dataclass(frozen=True)
class Secret:
    """``pattern`` says what uses up text, ``enough`` (by default the same) which of that is long enough to be kept. The
    longest match counts, which for these patterns is the greedy one."""

    kind: str
    pattern: str
    enough: str = ""


_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The first three are the base kinds, in their order; the others are the method's own.
RULES = (
    Secret("assign", _KEY + r"[A-Za-z0-9+/_.=-]+", _KEY + r"[A-Za-z0-9+/_.=-]{6,}"),
    Secret("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}"),
    Secret("hex", r"[0-9a-f]{24,}"),  # runs are maximal, so short ones use up nothing that another could use
    Secret("github", r"gh[oprsu]_[A-Za-z0-9]+", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Secret("slack", r"xox[abprs]-[A-Za-z0-9][A-Za-z0-9-]*", r"xox[abprs]-[A-Za-z0-9][A-Za-z0-9-]{9,}"),
    Secret("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Secret("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


@cache
def machine(rules: tuple[Secret, ...] = RULES) -> Automaton:
    """All rules at once, backwards: bit k where a match of rule k begins."""
    return compile_rules([r.pattern for r in rules], backwards=True)


@cache
def ends(rule: Secret) -> Automaton:
    """One rule from where it begins: bit 0 for its pattern, bit 1 where that is enough."""
    return compile_rules([rule.pattern, rule.enough or rule.pattern], anchored=True)


def find_spans(texts: list[str], rules: tuple[Secret, ...] = RULES) -> list[list[tuple[int, int, str, str]]]:
    """Of each text its spans: start, end (code points, end exclusive), kind and matched text, by start then rule.

    All texts go through the automaton as one string of bytes, parted by line feeds, which no rule can cross.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])
    data = b"\n".join(raw) + b"\n"
    at, bits = machine(rules).accepted(data[::-1])
    at, bits = len(data) - 1 - at[::-1], bits[::-1]
    doc = np.searchsorted(starts, at, side="right") - 1
    out: list[list[tuple[int, int, str, str]]] = [[] for _ in texts]
    for k, rule in enumerate(rules):
        hit = (bits >> k) & 1 == 1
        used, last, counted, chars = 0, -1, 0, 0
        for d, begin in zip(doc[hit].tolist(), at[hit].tolist()):
            if begin < used:
                continue
            used, accepted = ends(rule).longest(data, begin)
            if not accepted >> 1 & 1:
                continue
            if d != last:
                last, counted, chars = d, int(starts[d]), 0
            chars += len(data[counted:begin].decode("utf-8", "surrogatepass"))
            counted = begin
            found = data[begin:used].decode("utf-8", "surrogatepass")
            out[d].append((chars, chars + len(found), rule.kind, found))
    order = {r.kind: i for i, r in enumerate(rules)}
    return [sorted(spans, key=lambda s: (s[0], order[s[2]])) for spans in out]


def joined(spans: list[tuple[int, int, str, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans)


def scan(docs: DataFrame, rules: tuple[Secret, ...] = RULES) -> DataFrame:
    """doc_id and ``found``: an array of (start, end, kind, secret) for each row of ``docs``, empty for a null text.

    One Arrow pass, no shuffle; batches are cut to bound memory. Repeated rows give repeated results, an empty table
    none, a null doc_id stays null; spans of different kinds may overlap, and of equal starts the kind listed first
    comes first. Only doc_id and text are read.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("secret", T.StringType())])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("found", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("secret", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = find_spans([x or "" for x in part.column(1).to_pylist()], rules)
            rows = [[{"start": a, "end": b, "kind": c, "secret": s} for a, b, c, s in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, type=kind)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    schema = T.StructType([docs.schema["doc_id"]] + T._parse_datatype_string("n_assign long, n_access long, n_hex long, base_sha256 string, spans string").fields)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column(1).to_pylist():
                spans = [(s["start"], s["end"], s["kind"], "") for s in found]
                base = [s for s in spans if s[2] in BASE_KINDS]
                rows.append((*(sum(s[2] == k for s in base) for k in BASE_KINDS), sha256_hex(joined(base)), joined(spans)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=k) for c, k in zip(columns, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(docs).mapInArrow(digest, schema)


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The rules for SQL: kind, what uses up text, what is kept of that; the first three are base kinds.
_SQL_KEY = _either_case("(password|passwd|secret|token|api_?key)") + r"""["'']?\x20*[:=]\x20*["'']?"""
_SQL_RULES = (
    ("assign", _SQL_KEY + "[A-Za-z0-9+/_.=-]+", _SQL_KEY + "[A-Za-z0-9+/_.=-]{6,}"),
    ("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    ("hex", "[0-9a-f]+", "[0-9a-f]{24,}"),
    ("github", "gh[oprsu]_[A-Za-z0-9]+", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    ("slack", "xox[abprs]-[A-Za-z0-9][A-Za-z0-9-]*", "xox[abprs]-[A-Za-z0-9][A-Za-z0-9-]{9,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", ".*"),
)
#: Each rule cuts the texts at its matches, so a match begins where the parts and matches before it end.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  {cuts}
), each AS (
  SELECT r, k, kind, enough, unnest(ms) AS m, unnest(parts[1:len(ms)]) AS part, unnest(range(1, len(ms) + 1)) AS i FROM cut
), placed AS (
  SELECT r, k, kind, m, enough, sum(length(part) + length(m)) OVER (PARTITION BY r, k ORDER BY i) - length(m) AS a FROM each
), spans AS (
  SELECT r, k, kind, a, kind || ':' || a::BIGINT || ':' || (a + length(m))::BIGINT AS span FROM placed WHERE regexp_full_match(m, enough)
), joined AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(span, ',' ORDER BY a, k) FILTER (k <= 2) AS base, string_agg(span, ',' ORDER BY a, k) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (r)
""".replace("{cuts}", "\n  UNION ALL ".join(
    f"SELECT r, {k} AS k, '{kind}' AS kind, '{enough}' AS enough, regexp_extract_all(t, '{used}') AS ms, string_split_regex(t, '{used}') AS parts FROM docs"
    for k, (kind, used, enough) in enumerate(_SQL_RULES)
))
