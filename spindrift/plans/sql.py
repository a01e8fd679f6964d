"""Common table expressions that the queries' SQL is put together from.

They are over a chunk table ``c`` (vid, idx, ...) and a question table ``q0`` (qid, vid, oi, own): oi is the oracle's
place, own the number of the video's chunks.
"""

from __future__ import annotations

METRICS = """count(*) AS n, round(avg((rank = 0)::INT), 6) AS top1, round(avg((rank < 3)::INT), 6) AS top3,
  round(avg(1.0 / (rank + 1)), 6) AS mrr, round(avg(1.0 / pool), 6) AS random"""

WITHIN_POOLS = "wp AS (SELECT q.qid, d.vid, d.idx, d.idx = q.oi AS is_oracle FROM q0 q JOIN c d USING (vid))"


def draw(seed: int, *keys: str, below: str = "n") -> str:
    key = " || '|' || ".join(f"({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 12))::BIGINT % {below})"


def cross_pools(name: str = "xp", size: str = "own", excluded: str = "FALSE", seed: int = 0) -> str:
    """``name`` (qid, vid, idx, is_oracle): pools of ``size`` chunks, none of videos for which ``excluded`` holds."""
    return f"""{name}_ring AS (
  SELECT vid, idx, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', vid::VARCHAR, idx::VARCHAR)), vid, idx) - 1 AS pos
  FROM c WHERE NOT ({excluded})),
{name}_ask AS (
  SELECT qid, vid, {size} - 1 AS want, {size} - 1 + own AS reach, n FROM q0, (SELECT count(*) AS n FROM {name}_ring) WHERE {size} > 1),
{name}_draw AS (
  SELECT qid, k, {draw(seed, "qid", "k")} AS pos FROM (SELECT qid, n, unnest(range(0, 2 * reach)) AS k FROM {name}_ask)
  UNION ALL
  SELECT qid, 2 * reach + k, ({draw(seed, "qid")} + k) % n FROM (SELECT qid, n, reach, unnest(range(0, least(n, reach))) AS k FROM {name}_ask)),
{name}_step AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY min(k)) AS step FROM {name}_draw GROUP BY qid, pos),
{name}_met AS (
  SELECT a.qid, r.vid, r.idx, a.want, row_number() OVER (PARTITION BY a.qid ORDER BY s.step) AS rn
  FROM {name}_step s JOIN {name}_ask a USING (qid) JOIN {name}_ring r USING (pos) WHERE s.step <= least(n, reach) AND r.vid <> a.vid),
{name} AS (
  SELECT qid, vid, oi AS idx, TRUE AS is_oracle FROM q0
  UNION ALL SELECT qid, vid, idx, FALSE FROM {name}_met WHERE rn <= want)"""


def ranks(name: str, scores: str, keys: str = "qid") -> str:
    """``name`` (keys, rank, pool) of ``scores`` (keys, is_oracle, score)."""
    return f"""{name} AS (
  SELECT {keys}, count(CASE WHEN score >= os THEN 1 END) - 1 AS rank, count(*) AS pool
  FROM (SELECT {keys}, score, max(CASE WHEN is_oracle THEN score END) OVER (PARTITION BY {keys}) AS os FROM {scores}) GROUP BY {keys})"""


def wilson(k: str = "k", n: str = "n") -> tuple[str, str]:
    """Both ends of the interval; null without trials."""
    z = "1.959963984540054"
    p = f"({k} / {n}::DOUBLE)"
    centre, half = f"({p} + {z} * {z} / (2 * {n}))", f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n}))"
    scale = f"(1 + {z} * {z} / {n})"
    return f"CASE WHEN {n} > 0 THEN round(greatest(({centre} - {half}) / {scale}, 0), 6) END", f"CASE WHEN {n} > 0 THEN round(least(({centre} + {half}) / {scale}, 1), 6) END"


def mcnemar(n10: str = "n10", n01: str = "n01") -> str:
    n, m = f"({n10} + {n01})", f"least({n10}, {n01})"
    term = f"exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) - {n} * ln(2))"
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, {m} + 1), lambda j: {term}))), 6) END"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda y: y / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


def plus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"


def hashed(words: str, dim: int = 32) -> str:
    """The vector of signed word hashes, before it is made a unit vector."""
    place = "('0x' || substr(md5(w), 1, 2))::INT % " + str(dim)
    sign = "(CASE WHEN ('0x' || substr(md5(w), 3, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END)"
    return f"list_transform(range(0, {dim}), lambda i: coalesce(list_sum(list_transform({words}, lambda w: CASE WHEN {place} = i THEN {sign} ELSE 0.0 END)), 0.0))"
