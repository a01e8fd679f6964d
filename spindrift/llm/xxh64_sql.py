"""XXH64 in DuckDB's SQL, for the statements that the queries are compared with.

``rows`` is always a subquery with a column h; each step wraps it and replaces one column. Words of 64 bits are held as
UHUGEINT, so that no product overflows.
"""

from __future__ import annotations

#: The hash's primes (fixed values).
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WORD = 1 << 64


def times(x: str, prime: int, plus: int = 0) -> str:
    return f"(({x}) * {prime}::UHUGEINT + {plus}::UHUGEINT) % {WORD}::UHUGEINT"


def turned(bits: int, x: str = "h") -> str:
    return f"(({x} * {1 << bits}::UHUGEINT) % {WORD}::UHUGEINT + {x} // {1 << (64 - bits)}::UHUGEINT)"


def steps(rows: str, *each: str, column: str = "h", where: str = "") -> str:
    """``rows`` with its ``column`` replaced by one step after another, in the rows that ``where`` holds of."""
    for step in each:
        value = f"CASE WHEN {where} THEN {step} ELSE {column} END" if where else step
        rows = f"(SELECT * REPLACE (({value})::UHUGEINT AS {column}) FROM {rows})"
    return rows


FINISH = (
    f"xor(h, h // {1 << 33}::UHUGEINT)", times("h", P2), f"xor(h, h // {1 << 29}::UHUGEINT)", times("h", P3), f"xor(h, h // {1 << 32}::UHUGEINT)",
)


def number(data: bytes) -> int:
    return int.from_bytes(data, "little")


def start(size: int | str) -> str:
    return f"(h + {P5}::UHUGEINT + {size}::UHUGEINT) % {WORD}::UHUGEINT"


def byte_steps(byte: str) -> tuple[str, ...]:
    return f"xor(h, {times(byte, P5)})", turned(11), times("h", P1)


def four_steps(four: str) -> tuple[str, ...]:
    return f"xor(h, {times(four, P1)})", turned(23), times("h", P2, P3)


def long_hashed(rows: str, value: str, seed: str) -> str:
    """``rows`` with h, the hash of a whole number under ``seed``, which stays where the number is null."""
    unsigned = f"CASE WHEN {value} < 0 THEN ({value}::HUGEINT + {WORD})::UHUGEINT ELSE {value}::UHUGEINT END"
    mixed = steps(
        f"(SELECT *, {unsigned} AS h, ({seed})::UHUGEINT AS seed FROM {rows})",
        times("h", P2), turned(31), times("h", P1), f"xor(h, (seed + {P5 + 8}::UHUGEINT) % {WORD}::UHUGEINT)", turned(27), times("h", P1, P4), *FINISH,
    )
    return f"(SELECT * EXCLUDE (h, seed), coalesce(h, seed) AS h FROM {mixed})"


def _taken(at: str, size: int) -> str:
    """The number that ``size`` bytes from ``at`` on are, lowest byte first; ``backwards`` holds all bytes, last first."""
    return f"coalesce(try_cast('0x' || substr(backwards, 2 * (size - ({at}) - {size}) + 1, {2 * size}) AS UBIGINT), 0)::UHUGEINT"


def text_hashes(texts: str, seed: int) -> str:
    """Further parts of a WITH RECURSIVE: ``hashed`` (g, h) of each of the distinct texts g in ``texts``.

    Texts of 32 bytes or more go through four lanes, a row each, one stripe of 32 bytes a step.
    """
    lane = f"[{(seed + P1 + P2) % WORD}::UHUGEINT, {(seed + P2) % WORD}::UHUGEINT, {seed}::UHUGEINT, {(seed - P1) % WORD}::UHUGEINT]"
    stripe = steps(
        f"(SELECT g, size, backwards, lane, pos + 32 AS pos, (h + {times(_taken('pos + 8 * lane', 8), P2)}) % {WORD}::UHUGEINT AS h FROM lanes WHERE pos + 32 <= size)",
        turned(31), times("h", P1),
    )
    turns = " + ".join(f"({turned(bits, f'v{i}')})" for i, bits in enumerate((1, 7, 12, 18)))
    together = f"(SELECT *, ({turns}) % {WORD}::UHUGEINT AS h FROM ends)"
    for i in range(4):
        together = steps(together, times(f"v{i}", P2), turned(31, f"v{i}"), times(f"v{i}", P1), column=f"v{i}")
        together = steps(together, f"xor(h, v{i})", times("h", P1, P4))
    rest = steps(f"(SELECT g, size, backwards, size // 32 * 32 AS pos, h, 0::UHUGEINT AS w FROM begun)", f"(h + size::UHUGEINT) % {WORD}::UHUGEINT")
    for i in range(3):
        there = f"size - pos >= {8 * i + 8}"
        rest = steps(rest, _taken(f"pos + {8 * i}", 8), times("w", P2), turned(31, "w"), times("w", P1), column="w", where=there)
        rest = steps(rest, "xor(h, w)", turned(27), times("h", P1, P4), where=there)
    rest = steps(rest, *four_steps(_taken("size // 8 * 8", 4)), where="size % 8 >= 4")
    for i in range(3):
        rest = steps(rest, *byte_steps(_taken(f"size // 4 * 4 + {i}", 1)), where=f"size % 4 > {i}")
    return f"""bytes AS (
  SELECT g, octet_length(encode(g)) AS size, array_to_string(list_reverse(regexp_extract_all(hex(encode(g)), '..')), '') AS backwards FROM {texts}
), lanes AS (
  SELECT g, size, backwards, i AS lane, 0::BIGINT AS pos, {lane}[i + 1] AS h FROM bytes, range(0, 4) AS four(i) WHERE size >= 32
  UNION ALL SELECT g, size, backwards, lane, pos, h FROM {stripe}
), ends AS (
  SELECT g, {", ".join(f"max(h) FILTER (lane = {i}) AS v{i}" for i in range(4))} FROM lanes WHERE pos + 32 > size GROUP BY g
), begun AS (
  SELECT g, size, backwards, {(seed + P5) % WORD}::UHUGEINT AS h FROM bytes WHERE size < 32
  UNION ALL SELECT g, size, backwards, h FROM {together} JOIN bytes USING (g)
), hashed AS (
  SELECT g, h FROM {steps(rest, *FINISH)}
)"""
