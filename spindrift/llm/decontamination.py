"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

A benchmark window is a run of words. For a document to hold it, it must hold all its shingles, so by the prefix
filter one suffices to find it: the rarest of the window's shingles over the corpus. Each place of a document that has
such a prefix shingle is joined to its windows; the shingle's place in the window fixes where the window would begin
(positional bound) and end (length bound); what is left is compared word by word.

The texts are read twice, once to count and once to join. Both times the places of a text are made, hashed and looked
up one by one in the stage that reads it; no text, and no shingle that isn't looked for, is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.base import checkpointed, read, repeated, text_key

#: Words in a window, words in a shingle.
WINDOW, SHINGLE = 13, 3
#: Hashes of shingles (16 bytes each), and bytes of windows, that are broadcast at most; beyond it rows are dealt by hash.
HASHES, WINDOW_BYTES = 1 << 22, 64 << 20
#: ASCII characters that are in no word; all others, but for A-Z, which become a-z, stand for themselves.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BETWEEN
_TO = "abcdefghijklmnopqrstuvwxyz" + " " * len(_BETWEEN)


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lower-cased text; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), " "), "")


def _hash(words: str, at: str, size: int) -> str:
    return f"xxhash64({', '.join(f'get({words}, {at} + {k})' for k in range(size))})"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words (array): the windows of each item, or all its words where they are fewer; no words, no window."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("all"))
    cuts = F.expr(f"transform(sequence(1, greatest(size(all) - {window} + 1, 1)), i -> slice(all, i, {window}))")
    return words.filter(F.size("all") > 0).select("item_id", F.explode(F.array_distinct(cuts)).alias("words"))


def _places(texts: DataFrame, sizes: list[int], own: bool) -> DataFrame:
    """``texts`` (words, n, ...) once for each shingle: its place p from 0, its hash h, in ``sizes`` words; with ``own``
    once more with p = -1 and no hash, for the document itself."""
    first, least = (-1, 1) if own else (0, min(sizes))
    each = texts.withColumn("p", F.explode(F.expr(f"if(n >= {least}, sequence({first}, n - {least}), " + ("array(-1))" if own else "cast(array() as array<int>))"))))
    if len(sizes) > 1:
        each = each.withColumn("s", F.explode(F.expr(f"if(p < 0, array(0), array({', '.join(map(str, sizes))}))")))
    else:
        each = each.withColumn("s", F.lit(sizes[0]))
    hashes = " ".join(f"WHEN p >= 0 AND s = {s} AND p + {s} <= n THEN {_hash('words', 'p', s)}" for s in sizes)
    return each.withColumn("h", F.expr(f"CASE {hashes} END")).drop("s")


def _windows(benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (w, words, len, s), and the items that hold them (w, item)."""
    of_items = benchmark_windows(benchmark, window).select(F.col("item_id").cast("string").alias("item"), "words")
    distinct = of_items.select("words").distinct().select(F.monotonically_increasing_id().alias("w"), "words", F.size("words").alias("len"), F.least(F.size("words"), F.lit(shingle)).alias("s"))
    distinct = checkpointed(distinct)
    return distinct, of_items.join(distinct.select("w", "words"), "words").select("w", "item").distinct()


def _prefixes(texts: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """windows with h and ``at``, their rarest shingle over ``texts`` and its place; of equals the first. Windows with a
    shingle that no text holds are left out."""
    of = " ".join(f"WHEN s = {s} THEN transform(sequence(0, len - {s}), i -> {_hash('words', 'i', s)})" for s in sizes)
    shingles = windows.select("w", F.posexplode(F.expr(f"CASE {of} END")).alias("at", "h"))
    wanted = checkpointed(shingles.select("h").distinct())
    seen = _places(texts, sizes, own=False).select("h")
    if wanted.count() <= HASHES:
        seen = seen.join(F.broadcast(wanted), "h", "left_semi")
        counts = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = seen.filter("h IS NOT NULL").groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(wanted, "h", "left_semi")
    ranked = shingles.join(counts, "h", "left").groupBy("w").agg(F.min_by(F.struct("h", "at", "n"), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("x"))
    rarest = ranked.filter("x.n IS NOT NULL").select("w", "x.h", "x.at")
    return checkpointed(windows.select("w", "words", "len").join(rarest, "w"))


def _hits(texts: DataFrame, prefix: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """doc_id, row_key, n and, of each window that a text holds, w and where it begins; and a row for each text with w
    null."""
    by = prefix.select("h", "at", "w", F.col("len").alias("w_len"), F.col("words").alias("w_words"))
    rows = _places(texts, sizes, own=True)
    same = "p - at >= 0 AND p - at + w_len <= n AND slice({words}, greatest(p - at{less}, 0) + 1, w_len) = w_words"
    out = ["doc_id", "row_key", "n", "w", F.expr("CASE WHEN w IS NOT NULL THEN p - at END").alias("begin"), "w_len"]
    size = prefix.agg(F.coalesce(F.sum(F.expr("aggregate(words, 64L, (x, y) -> x + octet_length(y) + 24)")), F.lit(0))).first()[0]
    if size <= WINDOW_BYTES:
        met = rows.join(F.broadcast(by), "h", "left")
        return met.filter("p < 0 OR w IS NOT NULL AND " + same.format(words="words", less="")).select(*out)
    hashes = checkpointed(prefix.select("h").distinct())
    few = rows.filter("p >= 0").join(F.broadcast(hashes) if hashes.count() <= HASHES else hashes, "h", "left_semi")
    # the words around the place go along, as far as a window can reach
    near = few.select("doc_id", "row_key", "n", "p", "h", F.expr(f"greatest(p - {window}, 0)").alias("base"), F.expr(f"slice(words, greatest(p - {window}, 0) + 1, {2 * window})").alias("near"))
    met = near.join(by, "h").filter(same.format(words="near", less=" - base")).select(*out)
    alone = texts.select("doc_id", "row_key", "n", F.lit(None).cast("bigint").alias("w"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("w_len"))
    return met.unionByName(alone)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of ``docs``.

    A null or empty text has no words and no hits; so has every document if the benchmark is empty. Rows that agree in
    doc_id and text, null doc_ids too, are judged once and given back as often as they came. A word counts once however
    many windows cover it, an item once however often it occurs, an item without an id not at all. No documents give
    no rows. Of equally rare shingles the first one serves; the result doesn't depend on it.
    """
    texts = docs.select("doc_id", text_key().alias("row_key"), words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    windows, items = _windows(benchmark, window, shingle)
    sizes = sorted(r[0] for r in windows.select("s").distinct().collect()) or [shingle]
    hits = _hits(texts, _prefixes(texts, windows, sizes), sizes, window)
    documents = hits.groupBy("doc_id", "row_key", "n").agg(
        F.count(F.when(F.col("w").isNull(), 1)).alias("n_rows"), F.collect_set(F.when(F.col("w").isNotNull(), F.struct("begin", (F.col("begin") + F.col("w_len")).alias("end")))).alias("spans"), F.collect_set("w").alias("ws"),
    )
    covered = """aggregate(array_sort(spans), named_struct('n', 0L, 'reach', 0), (a, x) -> named_struct(
        'n', a.n + greatest(0, x.end - greatest(x.begin, a.reach)), 'reach', greatest(a.reach, x.end)), a -> a.n)"""
    counted = documents.select("doc_id", "row_key", "n", "n_rows", F.expr(covered).alias("n_hit"), F.explode_outer("ws").alias("w"))
    # a window whose items have no id keeps its hits
    named = counted.join(items, "w", "left").groupBy("doc_id", "row_key", "n").agg(F.max("n_rows").alias("n_rows"), F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    out = named.select(
        "doc_id", "row_key", F.col("n").cast("bigint").alias("n_words"), "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n"))).alias("contaminated"), "n_rows",
    )
    return repeated(out, "n_rows", "doc_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row_key")


ORACLE = r"""
WITH bw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), dg AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)
), hit AS (
  SELECT r, i, n, item FROM dg JOIN win USING (n, g)
), cov AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), its AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
