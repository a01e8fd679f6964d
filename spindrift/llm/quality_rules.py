"""Quality rules: a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per failed rule; a policy is
a versioned mask, so a new policy, a verdict and an ablation (what would come back if one rule went) are bit
operations over the ledger and never touch a text again.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.base import read, scan_texts

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")
_WORDS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint"}


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0d only
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    dup = 0
    if b"\n" in raw:
        lines = Counter(x for x in raw.split(b"\n") if x.strip())
        dup = sum(lines.values()) - len(lines)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0  # words before it are counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, len(_SYMBOL.findall(text)), dup, repeated


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate over the measurements; ``bit`` never changes once a ledger was written."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", 3, "n_dup_lines >= 5 AND 12 * n_dup_lines > n_words"),
    Rule("word_length", 4, "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)

#: Policy versions: the rules that reject.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length"),
}
BASE_POLICY, POLICY = 1, 2


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in names)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements, and ``failed_bits``: every rule evaluated once.

    A null or empty text has no words and fails ``few_words``. Repeated rows give repeated rows, an
    empty table none; ties do not arise.
    """
    measured = scan_texts(docs, measure, _WORDS)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed_bits", total.cast("bigint"))


def rejected(policy: int, bits: Column | None = None) -> Column:
    bits = F.col("failed_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("bigint")) != 0


def ablation(rows: DataFrame, policy: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: rows that fail it, that fail it alone, and rows kept if it went. One aggregation."""
    mask = mask_of(POLICIES[policy], rules)
    own = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("bigint"))
    chosen = [r for r in rules if r.name in POLICIES[policy]]
    counts = [F.count(F.when(own.bitwiseAND(F.lit(1 << r.bit).cast("bigint")) != 0, 1)).alias(f"f{r.bit}") for r in chosen]
    alone = [F.count(F.when(own == (1 << r.bit), 1)).alias(f"a{r.bit}") for r in chosen]
    one = rows.agg(F.count(F.when(own == 0, 1)).alias("kept"), F.bit_or(own).alias("seen_bits"), *counts, *alone)
    each = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"a{r.bit}").alias("n_failed_alone"), (F.col("kept") + F.col(f"a{r.bit}")).alias("n_kept_without"))
        for r in chosen
    ])
    return one.select(F.inline(each))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", *_WORDS, rejected(BASE_POLICY).alias("base_failed"), (~rejected(POLICY)).alias("kept"), "failed_bits")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT doc_id, r, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), tri AS (
  SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1
), rw AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r
), ln AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN ln ON ln.r = w.r LEFT JOIN rw ON rw.r = w.r
), b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (n_dup_lines >= 5 AND 12 * n_dup_lines > n_words)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::INT)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  (failed_bits & 31) = 0 AS kept, failed_bits
FROM b
"""


def quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does to all documents: a row a rule, zeros where there are no documents."""
    return ablation(ledger(read(spark, sf_dir, "documents")), POLICY)


ABLATION = f"""
WITH bits AS (SELECT failed_bits & {mask_of(POLICIES[POLICY])} AS b FROM ({ORACLE})),
rules(rule, bit) AS (VALUES {", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES if r.name in POLICIES[POLICY])})
SELECT rule, count(CASE WHEN b & bit <> 0 THEN 1 END) AS n_failed, count(CASE WHEN b = bit THEN 1 END) AS n_failed_alone,
  count(CASE WHEN b = 0 OR b = bit THEN 1 END) AS n_kept_without
FROM rules LEFT JOIN bits ON TRUE GROUP BY rule
"""
