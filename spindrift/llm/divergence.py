"""Source divergence audit: how the sources of a language differ in the terms they use.

Terms are counted where texts are read. Divergences of sources are sums over all kept terms, but computed over sparse
counts: a pair's sum is first taken as if no term occurred in either (the baseline), then corrected, once for the counts
of each source by how often each count comes, and once for the terms that both have. The terms that set a source apart
from its language are ranked by radix selection: histograms over the bits of the values, built across all tasks, find
each group's kth value, and ties are refined by the bytes of the terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.checkpoints import checkpointed, written, written_for_now
from spindrift.llm.base import BROADCAST_ROWS, looked_up, read, slices

MIN_DOCS, TOP = 10, 10
#: Probabilities are whole parts of this.
UNIT = 1_000_000_000
#: Bits of a value, and of them those that one histogram looks at.
BITS, STEP = 30, 10
#: Ties of a group that one task sorts; more are refined by two bytes at a time.
FEW_TIES = 4096
#: Sources of a tile: a task sums the pairs of two such blocks in one array of 2 MB.
TILE = 512
#: (lang, source, term) that a task holds before it hands its counts on.
HELD = 1 << 19
#: Letters A-Z become lower case and other ASCII a blank; all else, the bytes of other characters, stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n over whole texts: how often a group's texts have the term; nulls are empty. Under a null
    source n is the number of the language's documents with the term. The term '' stands for the documents themselves,
    so a group without terms is there.

    Each task adds up what it reads, up to HELD numbers at a time.
    """

    def rows(counts: dict[tuple, Counter]) -> pa.RecordBatch:
        names, sizes = list(counts), [len(c) for c in counts.values()]
        of = pa.array(np.repeat(np.arange(len(names)), sizes))
        columns = [pa.array([g[i] for g in names], pa.string()).take(of) for i in (0, 1)]
        columns.append(pa.array(list(chain.from_iterable(counts.values())), pa.binary()).cast(pa.string()))
        columns.append(pa.array(list(chain.from_iterable(c.values() for c in counts.values())), pa.int64()))
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        for batch in slices(batches, 2):
            met: dict[tuple, list] = {}
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
                once = met.setdefault((lang, None), [])
                once += set(found)
                once.append(b"")
                found.append(b"")
                met.setdefault((lang, source), []).extend(found)
            for group, terms in met.items():
                counts.setdefault(group, Counter()).update(terms)
            if sum(map(len, counts.values())) > HELD:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    read_as = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*read_as).mapInArrow(work, "lang string, source string, term string, n bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def whole(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers that aren't negative."""
    return F.call_function("div", a, b)


def probability(count: Column, size: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / size), exact: three digits at a time, so sizes up to 9 * 10**15 don't overflow."""
    rest, out = count + 2, F.lit(0).cast("bigint")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + whole(rest, size), rest % size
    return out + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); below 2**63, as p and q are at most UNIT + 1."""
    return whole((p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def tables(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The groups and the cells, both written.

    Groups (lang, source, gid, idx, tiles, n, terms, p0): each occurring (lang, source), its number within the language,
    how many kept terms occur in it and in the language, and the probability of a term that doesn't occur in it. Cells
    (lang, gid, idx, tiles, term, p, p0, value): each kept term that occurs in a group; value, where the group has more
    of it than its language, says how much.
    """
    with written_for_now(counted(docs)) as every:
        kept = checkpointed(every.filter(F.col("source").isNull() & (F.col("term") != "") & (F.col("n") >= min_docs)).select("lang", "term"))
        own = every.filter(F.col("source").isNotNull())
        sent = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
        cells = own.join(sent, ["lang", "term"], "left_semi").withColumnRenamed("n", "times")
        totals = checkpointed(cells.groupBy("lang", "term").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("n")))
        langs = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
        of_group = cells.groupBy("lang", "source").agg(F.sum("times").alias("group_total"), F.count(F.lit(1)).alias("n"))
        there = own.filter("term = ''").select("lang", "source").join(of_group, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = there.fillna(0, ["group_total", "n", "terms", "lang_total"])
        in_lang = W.partitionBy("lang")
        groups = groups.select(
            "lang", "source", "n", "terms", F.monotonically_increasing_id().alias("gid"), (F.row_number().over(in_lang.orderBy("source")) - 1).cast("bigint").alias("idx"),
            whole(F.count(F.lit(1)).over(in_lang) + (TILE - 1), F.lit(TILE)).alias("tiles"), (F.col("group_total") + 2 * F.col("terms")).alias("size"), (F.col("lang_total") + 2 * F.col("terms")).alias("lang_size"),
        )
        groups = checkpointed(groups.withColumn("p0", F.when(F.col("terms") > 0, probability(F.lit(0), F.col("size")))))
        # terms meet their totals, which say that they are kept, and their groups
        met = _placed(_placed(own.withColumnRenamed("n", "times"), totals, "lang", "term"), groups.drop("terms"), "lang", "source")
        met = met.withColumns({"p": probability(F.col("times"), F.col("size")), "q": probability(F.col("total"), F.col("lang_size"))})
        value = F.when(F.col("p") > F.col("q"), apart(F.col("p"), F.col("q")))
        return groups, written(met.select("lang", "gid", "idx", "tiles", "term", "p", "p0", value.alias("value")))


def _placed(rows: DataFrame, state: DataFrame, *key: str) -> DataFrame:
    """``rows`` with their group's row of ``state``, which is written already: by broadcast up to BROADCAST_ROWS groups,
    beyond by looking up."""
    return rows.join(F.broadcast(state.drop("n")), list(key)) if state.count() <= BROADCAST_ROWS else looked_up(rows, state, *key)


def top(rows: DataFrame, k: int = TOP, few_ties: int = FEW_TIES) -> DataFrame:
    """gid, term, value, rank: of each gid the k largest values (at most 2**BITS), of equal ones the smallest terms by bytes.

    Each turn narrows a group's kth value by STEP bits: a histogram over them, of the rows that share the bits found so
    far, is summed up from above until k is reached. A group's rows are never gathered or sorted.
    """
    sizes = checkpointed(rows.groupBy("gid").agg(F.count(F.lit(1)).alias("n")))
    state = checkpointed(sizes.filter(F.col("n") > k).withColumns({"bits": F.lit(0).cast("bigint"), "need": F.lit(k).cast("bigint")}))
    down = W.partitionBy("gid").orderBy(F.col("digit").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    for shift in range(BITS - STEP, -1, -STEP):
        near = _placed(rows, state, "gid").filter(F.shiftright("value", shift + STEP) == F.col("bits"))
        digit = F.shiftright("value", shift).bitwiseAND((1 << STEP) - 1).alias("digit")
        histogram = near.groupBy("gid", "bits", "need", digit).agg(F.count(F.lit(1)).alias("m")).withColumn("to", F.sum("m").over(down))
        reached = histogram.filter("to >= need").groupBy("gid").agg(F.max(F.struct("digit", (F.col("bits") * (1 << STEP) + F.col("digit")).alias("bits"), (F.col("need") - F.col("to") + F.col("m")).alias("need"))).alias("s"))
        state = checkpointed(reached.join(sizes, "gid").select("gid", "n", "s.bits", "s.need"))
    placed = _placed(rows, state, "gid")
    few = rows.join(sizes.filter(F.col("n") <= k).select("gid"), "gid", "left_semi")
    ties = checkpointed(placed.filter("value = bits").select("gid", "term", "value", "need"))
    found = few.select("gid", "term", "value").unionByName(placed.filter("value > bits").select("gid", "term", "value")).unionByName(_first_terms(ties, few_ties))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("gid").orderBy(F.col("value").desc(), "term")))


def _first_terms(ties: DataFrame, few: int) -> DataFrame:
    """gid, term, value: of each gid the ``need`` smallest terms by bytes.

    Where a group has more than ``few``, a histogram over the two bytes behind what all its terms begin with (which the
    smallest and the largest of them have in common) tells which terms are in, which are out, and which still tie.
    """
    names, taken = ["gid", "term", "value"], []
    up = W.partitionBy("gid").orderBy("pair").rowsBetween(W.unboundedPreceding, W.currentRow)
    while True:
        groups = ties.groupBy("gid", "need").agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("low"), F.max("term").alias("high"))
        many = checkpointed(groups.filter((F.col("n") > few) & (F.col("n") > F.col("need"))))
        if many.isEmpty():
            break
        differ = "filter(sequence(1, least(octet_length(low), octet_length(high))), i -> substring(encode(low, 'utf-8'), i, 1) <> substring(encode(high, 'utf-8'), i, 1))"
        many = checkpointed(many.select("gid", "n", F.expr(f"coalesce(array_min({differ}), least(octet_length(low), octet_length(high)) + 1)").alias("at")))
        open_ = _placed(ties, many, "gid").withColumn("pair", F.expr("hex(substring(encode(term, 'utf-8'), at, 2))"))
        histogram = open_.groupBy("gid", "need", "pair").agg(F.count(F.lit(1)).alias("m")).withColumn("to", F.sum("m").over(up))
        reached = histogram.filter("to >= need").groupBy("gid").agg(F.min(F.struct("pair", (F.col("need") - F.col("to") + F.col("m")).alias("need"))).alias("s"))
        last = checkpointed(reached.join(many.select("gid", "n"), "gid").select("gid", "n", F.col("s.pair").alias("last"), "s.need"))
        met = checkpointed(_placed(open_.drop("need"), last, "gid"))
        taken.append(met.filter("pair < last").select(names))
        rest = ties.join(many.select("gid"), "gid", "left_anti")
        ties = checkpointed(rest.unionByName(met.filter("pair = last").select(*names, "need")))
    out = ties.withColumn("place", F.row_number().over(W.partitionBy("gid").orderBy("term"))).filter("place <= need").select(names)
    for more in taken:
        out = out.unionByName(more)
    return out


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, cut so that the rows of a term, which are as many as a language's sources at most, stay together."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        same = pc.equal(table["term"], table["term"][-1]).to_numpy()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _shared(cells: DataFrame) -> DataFrame:
    """lang, a, b, v: what the terms that both sources have add to the pair a < b, summed up in each task by tiles.

    A term's sources are cut into blocks of TILE; the cells of a language with more than one block go to each pair of
    blocks that theirs is in. A tile's pairs are summed in one array, and a task hands on its sums, not pairs of cells.
    """
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    tiled = cells.select("lang", "term", "idx", "p", "p0", whole(F.col("idx"), F.lit(TILE)).alias("own"), other.alias("other"))
    tiled = tiled.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "term", "idx", "p", "p0")

    def handed_on(lang: str, a: int, b: int, tile: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(tile)
        v = tile[i, j]
        i, j = i + a * TILE, j + b * TILE
        upper = i < j
        return pa.RecordBatch.from_arrays([pa.array([lang] * int(upper.sum()), pa.string()), pa.array(i[upper]), pa.array(j[upper]), pa.array(v[upper])], names=["lang", "a", "b", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, np.zeros((TILE, TILE), np.int64)
        for cells in _whole_runs(batches):
            changed, other_tile = np.zeros(cells.num_rows + 1, bool), np.zeros(cells.num_rows, bool)
            changed[[0, -1]] = other_tile[0] = True
            for name in ("lang", "a", "b", "term"):
                code = cells[name].combine_chunks().dictionary_encode().indices.to_numpy()
                if name == "term":
                    changed[:-1] |= other_tile
                    changed[1:-1] |= code[1:] != code[:-1]
                else:
                    other_tile[1:] |= code[1:] != code[:-1]
            idx, p, p0 = (cells[name].to_numpy() for name in ("idx", "p", "p0"))
            starts = np.flatnonzero(changed).tolist()
            for x, y in zip(starts, starts[1:]):
                if other_tile[x]:
                    own = tuple(cells[name][x].as_py() for name in ("lang", "a", "b"))
                    if key not in (None, own):
                        yield handed_on(*key, tile)
                        tile[:] = 0
                    key = own
                if y - x < 2:
                    continue
                _, a, b = key
                if a == b:
                    i = idx[x:y] - a * TILE
                    pi, bi = p[x:y, None], p0[x:y, None]
                    tile[i[:, None], i] += _apart(pi, pi.T) - _apart(pi, bi.T) - _apart(bi, pi.T) + _apart(bi, bi.T)
                else:
                    left = idx[x:y] // TILE == a
                    i, j, pi, pj, bi, bj = idx[x:y][left], idx[x:y][~left], p[x:y][left, None], p[x:y][~left], p0[x:y][left, None], p0[x:y][~left]
                    tile[np.ix_(i - a * TILE, j - b * TILE)] += _apart(pi, pj) - _apart(pi, bj) - _apart(bi, pj) + _apart(bi, bj)
        if key is not None:
            yield handed_on(*key, tile)

    dealt = tiled.repartition("lang", "a", "b", "term").sortWithinPartitions("lang", "a", "b", "term")
    return dealt.mapInArrow(work, "lang string, a bigint, b bigint, v bigint")


def pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, a, b, value of each ordered pair of different sources of a language, summed over all kept terms.

    With p0 for a term that a source lacks, sum f(p, q) is terms * f(p0, q0), plus f(p, q0) - f(p0, q0) for each term of
    the one, likewise for each term of the other, plus f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) for each term of both.
    The middle parts depend on a term's count only, so they are taken once for each count that comes.
    """
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("block")
    others = groups.select("lang", whole(F.col("idx"), F.lit(TILE)).alias("block"), F.col("idx").alias("b"), F.col("p0").alias("q0"))
    base = groups.select("lang", F.col("idx").alias("a"), "p0", "terms", block).join(others, ["lang", "block"]).filter("a <> b")
    base = base.select("lang", "a", "b", F.coalesce(F.col("terms") * apart(F.col("p0"), F.col("q0")), F.lit(0)).alias("v"))
    often = cells.groupBy("lang", F.col("idx").alias("a"), "tiles", "p", "p0").agg(F.count(F.lit(1)).alias("m")).select("lang", "a", "p", "p0", "m", block)
    one = often.join(others, ["lang", "block"]).filter("a <> b")
    one = one.select("lang", "a", "b", (F.col("m") * (apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0")))).alias("v"))
    # what is added to a pair is added to it either way round
    added = one.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "v").unionByName(_shared(cells))
    added = added.groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    turned = added.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "v")
    every = base.unionByName(turned.select("lang", "x.a", "x.b", "v"))
    return every.groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language by divergence, largest first, ties by name; ``term``: the k terms
    that the source has more of than its language, by divergence from it, ties by bytes. A null text, lang or source is
    ''. Repeated rows are documents of their own. A language without kept terms has pairs of value 0 and no terms; a
    language of one source has no pairs; an empty table gives no rows. Only these three columns are read.
    """
    groups, cells = tables(docs, min_docs)
    names = groups.select("gid", "lang", "source")
    terms = top(cells.filter("value IS NOT NULL").select("gid", "term", "value"), k).join(names, "gid")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    named = groups.select("lang", F.col("idx").alias("a"), "source")
    found = pairs(groups, cells).join(named, ["lang", "a"]).join(named.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


_P = "(1 + ({unit}::HUGEINT * ({count} + 2)) // ({n} + 2 * v))::BIGINT".replace("{unit}", str(UNIT))
ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), words AS (
  SELECT r, lang, source, unnest(ts) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}
), cells AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (
  SELECT lang, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN (SELECT lang, count(DISTINCT term) AS v, sum(c)::BIGINT AS n FROM cells GROUP BY lang) USING (lang)
), groups AS (
  SELECT lang, source, v, coalesce(m, 0) AS m FROM (SELECT DISTINCT lang, source FROM docs) JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(c)::BIGINT AS m FROM cells GROUP BY lang, source) USING (lang, source)
), p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c, 0) AS c, {_P.format(count="coalesce(c, 0)", n="m")} AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN cells USING (lang, source, term)
), q AS (
  SELECT lang, term, {_P.format(count="sum(c)", n="any_value(n)").replace("* v", "* any_value(v)")} AS q FROM cells JOIN langs USING (lang) GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), term AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM every
UNION ALL
SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term QUALIFY rank <= {TOP}
"""
