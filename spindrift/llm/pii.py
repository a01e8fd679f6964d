"""Personal data by bootstrapped contextual extraction.

Base patterns find seed entities. The words around entities make lexical patterns; patterns and identifier-like strings
form a bipartite graph, whose edges say which pattern was seen around which string. Spark scores the graph in rounds:
a pattern is worth what it is seen around, a string what it is seen in. Patterns that are confident, from many
different seeds in many documents, then mark identifiers that no base pattern knows; these in turn speak for further
patterns, until none is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.base import checkpointed, read, slices, text_key

BASE_KINDS = ("email", "ip", "card", "phone")
FOUND_KIND = "context"
ROUNDS = 3
#: A pattern is trusted from so many different seeds, in so many different texts, and at this confidence.
MIN_SEEDS, MIN_TEXTS, CONFIDENCE = 5, 5, 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Identifier-like: digits among letters and the signs that identifiers are written with, of any length.
_CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._@+/-]{5,}")
#: What stands for the word before at a text's beginning, and for the word after at its end; no word looks like them.
START, END = "<start>", "<end>"
#: Patterns, and their bytes, that are sent to all tasks at most; more are joined.
MOST_SENT, MOST_BYTES = 200_000, 32 << 20


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            free = m.end()
            yield a, free
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points) by kind as listed, then start. Matches that fail are dropped, not tried again."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_EDGE = " \t\r\n\v\f.,;:!?|()[]{}\"'*#$%&<>="


_WORD = re.compile(rf"[^\s{re.escape(_EDGE)}]+")


class _Words:
    """A text cut once into words: at blanks and punctuation, and where a mention begins or ends. So a word is the
    neighbour of one mention on either side (more only where mentions begin or end together), and the neighbours of all
    of a text's mentions are no longer than the text, whatever it is made of."""

    def __init__(self, text: str, spans: list[tuple[int, int]]):
        self.text = text
        cuts = sorted({x for span in spans for x in span})
        self.starts, self.ends = [], []
        i = 0
        for m in _WORD.finditer(text):
            a, b = m.span()
            while i < len(cuts) and cuts[i] <= a:
                i += 1
            while i < len(cuts) and cuts[i] < b:
                self.starts.append(a)
                self.ends.append(cuts[i])
                a = cuts[i]
                i += 1
            self.starts.append(a)
            self.ends.append(b)

    def around(self, a: int, b: int) -> tuple[str, str]:
        """The words before ``a`` and after ``b``, in lower case."""
        i, j = bisect_left(self.starts, a) - 1, bisect_left(self.starts, b)
        left = self.text[self.starts[i] : self.ends[i]].lower() if i >= 0 else START
        return left, self.text[self.starts[j] : self.ends[j]].lower() if j < len(self.starts) else END


def mentions(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, str, str, bool, int, int]]]:
    """The base spans, and what enters the graph: (string, left, right, is a seed, start, end) of each base span and of
    each identifier-like string (four digits at least) that overlaps none."""
    spans = base_spans(text)
    taken = sorted((a, b) for _, a, b in spans)
    other = []
    if any(c in text for c in "0123456789"):
        i = 0
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            if sum(map(m.group().count, "0123456789")) < 4:
                continue
            while b > a and text[b - 1] in ".-/@+":
                b -= 1
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if b - a < 6 or any(x < b and y > a for x, y in taken[max(0, i - 1) : i + 2]):
                continue
            other.append((a, b))
    if not taken and not other:
        return spans, []
    words = _Words(text, taken + other)
    return spans, [(text[a:b].lower(), *words.around(a, b), seed, a, b) for own, seed in ((taken, True), (other, False)) for a, b in own]


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_MENTION = T.StructType([T.StructField("string", T.StringType()), T.StructField("left", T.StringType()), T.StructField("right", T.StringType()), T.StructField("seed", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SPAN_FIELDS = (("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()))
_MENTION_FIELDS = (("string", pa.string()), ("left", pa.string()), ("right", pa.string()), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()))


def _lists(rows: list[list[tuple]], fields: tuple) -> pa.ListArray:
    """An array of lists of structs, made column by column."""
    offsets = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    columns = list(zip(*(x for row in rows for x in row))) or [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(offsets, structs)


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, spans (base), mentions: one Arrow pass over whole texts, a row for each row of ``docs``. Time and
    bytes grow as the texts do."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("row_key", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("mentions", T.ArrayType(_MENTION))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            rows = [mentions(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([r[0] for r in rows], _SPAN_FIELDS), _lists([r[1] for r in rows], _MENTION_FIELDS)], names=["doc_id", "row_key", "spans", "mentions"])

    return docs.select("doc_id", text_key().alias("row_key"), "text").mapInArrow(work, schema)


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_texts: int = MIN_TEXTS, confidence: float = CONFIDENCE) -> DataFrame:
    """left, right, score of the patterns that mark identifiers.

    The graph has an edge for each distinct (pattern, string). A seed string weighs 1 throughout, another what its
    patterns say; a pattern scores the mean weight of its strings, a string the score of its best pattern. Counts of
    seeds and texts are of distinct ones, so thousands of copies of one text vouch no more than one. Aggregates are
    partial before each shuffle. Ties need no order: all that pass are trusted.

    Strings that a trusted pattern was seen around are discovered: they count as seeds do, at the score that
    discovered them, and the patterns are tested anew until none is added. A pattern once trusted stays so. Each turn
    adds one pattern at least, so there are no more turns than patterns that can be trusted, and commonly a few: as many
    as the longest chain of patterns each of which is trusted for what the one before discovered.
    """
    if rounds < 1:
        raise ValueError("one round at least")
    flat = found.select("row_key", F.explode("mentions").alias("m")).select("row_key", "m.left", "m.right", "m.string", "m.seed")
    texts = flat.select("row_key", "left", "right").distinct().groupBy("left", "right").agg(F.count(F.lit(1)).alias("texts"))
    edges = flat.groupBy("left", "right", "string").agg(F.max("seed").alias("seed"))
    strings = edges.groupBy("left", "right").agg(F.count(F.lit(1)).alias("strings"))
    # of a pattern's strings all may come to count; only one with too few strings or texts can never be trusted
    able = strings.join(texts, ["left", "right"]).filter((F.col("strings") >= min_seeds) & (F.col("texts") >= min_texts))
    graph = checkpointed(edges.join(able.select("left", "right"), ["left", "right"]).withColumn("known", F.when(F.col("seed"), 1.0)))
    trusted = graph.select("left", "right", F.lit(1.0).alias("score")).limit(0)
    while True:
        added = checkpointed(_confident(graph, rounds, min_seeds, confidence).join(trusted.select("left", "right"), ["left", "right"], "left_anti"))
        if added.isEmpty():
            return trusted
        trusted = checkpointed(trusted.unionByName(added))
        unknown = graph.filter("known IS NULL")
        earned = checkpointed(unknown.join(added, ["left", "right"]).groupBy("string").agg(F.max("score").alias("earned")))
        if earned.isEmpty():
            return trusted
        told = unknown.drop("known").join(earned, "string", "left").withColumnRenamed("earned", "known")
        graph = checkpointed(graph.filter("known IS NOT NULL").unionByName(told))


def _confident(graph: DataFrame, rounds: int, min_seeds: int, confidence: float) -> DataFrame:
    """left, right, score of the patterns of ``graph`` with ``min_seeds`` known strings that reach ``confidence``."""
    supported = graph.groupBy("left", "right").agg(F.count("known").alias("seeds")).filter(F.col("seeds") >= min_seeds)
    held = checkpointed(graph.join(supported.select("left", "right"), ["left", "right"]))
    base = F.coalesce("known", F.lit(0.0))
    weighed = held.withColumn("weight", base)
    if not held.isEmpty():
        for _ in range(rounds - 1):
            scores = weighed.groupBy("left", "right").agg(F.avg("weight").alias("score"))
            strings = weighed.filter("NOT seed").select("left", "right", "string").join(scores, ["left", "right"]).groupBy("string").agg(F.max("score").alias("best"))
            weighed = checkpointed(held.join(strings, "string", "left").withColumn("weight", F.when(F.col("seed"), 1.0).otherwise(F.greatest(base, F.coalesce("best", F.lit(0.0))))).drop("best"))
    return weighed.groupBy("left", "right").agg(F.avg("weight").alias("score")).filter(F.col("score") >= confidence)


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, row_key, extra (array of spans): what trusted patterns mark beyond the base spans, by row, where it is any."""
    flat = found.select("doc_id", "row_key", F.explode("mentions").alias("m")).filter("NOT m.seed").select("doc_id", "row_key", "m.*")
    marked = flat.join(patterns.select("left", "right"), ["left", "right"])
    return marked.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct(F.lit(FOUND_KIND).alias("kind"), F.col("start"), F.col("end")))).alias("extra"))


def _marked(found: list, known: frozenset) -> list[tuple[str, int, int]]:
    """The spans of mentions (string, left, right, is a seed, start, end) that ``known`` patterns mark, in order."""
    return sorted({(FOUND_KIND, a, b) for _, left, right, seed, a, b in found if not seed and (left, right) in known})


def _sent(patterns: DataFrame) -> frozenset | None:
    """The patterns, if no more than MOST_SENT, of MOST_BYTES in all."""
    size = patterns.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("left") + F.octet_length("right")).alias("size")).first()
    if size.n > MOST_SENT or (size.size or 0) > MOST_BYTES:
        return None
    return frozenset((r.left, r.right) for r in patterns.select("left", "right").collect())


def find(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, spans (base), extra (found by context): a row for each row of ``docs``.

    A null or empty text has none; rows that agree in doc_id and text share their spans; a null doc_id stays null; an
    empty table gives no rows. Up to MOST_SENT trusted patterns are looked up where the mentions are; more are joined.
    """
    found = checkpointed(extract(docs))
    patterns = checkpointed(trusted_patterns(found))
    known = _sent(patterns)
    none = F.array().cast(T.ArrayType(_SPAN))
    if known is None:
        extra = discovered(found, patterns).withColumnsRenamed({"doc_id": "__id", "row_key": "__key"})
        rows = found.select("doc_id", "row_key", "spans").join(extra, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__key")), "left")
        return rows.select("doc_id", "row_key", "spans", F.coalesce("extra", none).alias("extra"))
    if not known:
        return found.select("doc_id", "row_key", "spans", none.alias("extra"))
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                flat = part.column(3).flatten()
                met = list(zip(*(flat.field(n).to_pylist() for n, _ in _MENTION_FIELDS)))
                ends = list(accumulate(pc.list_value_length(part.column(3)).to_pylist(), initial=0))
                extra = [_marked(met[a:b], sent.value) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], _lists(extra, _SPAN_FIELDS)], names=["doc_id", "row_key", "spans", "extra"])

    schema = T.StructType([*found.schema.fields[:3], T.StructField("extra", T.ArrayType(_SPAN))])
    return found.mapInArrow(work, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; other columns, null and empty texts,
    and texts without such data, as they are. A span that overlaps an earlier one goes with it, under the earlier one's
    kind; of two that begin together the longer one counts. Repeated rows stay, and fare alike; an empty table gives none.

    Trusted patterns are looked up as texts pass, so no text is shuffled; only beyond MOST_SENT of them are the spans
    that they mark joined to the documents.
    """
    found = checkpointed(extract(docs))
    patterns = checkpointed(trusted_patterns(found))
    known = _sent(patterns)
    at, names = docs.columns.index("text"), docs.columns
    if known is None:
        extra = discovered(found, patterns).withColumnsRenamed({"doc_id": "__pii_id", "row_key": "__pii_key", "extra": "__pii_extra"})
        keyed = docs.withColumn("__pii_row", text_key())
        rows = keyed.join(extra, keyed["doc_id"].eqNullSafe(extra["__pii_id"]) & (keyed["__pii_row"] == extra["__pii_key"]), "left").drop("__pii_row", "__pii_id", "__pii_key")
    else:
        rows = docs
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def spans(text: str, given: list | None) -> list[tuple[str, int, int]]:
        if not sent.value:
            return [*base_spans(text), *((s["kind"], s["start"], s["end"]) for s in given or ())]
        base, met = mentions(text)
        return [*base, *_marked(met, sent.value)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            given = batch.column(len(names)).to_pylist() if known is None else [None] * batch.num_rows
            texts = [x if x is None else replaced(x, spans(x, e)) for x, e in zip(batch.column(at).to_pylist(), given)]
            columns = [pa.array(texts, batch.column(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(work, docs.schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]]) if out else text


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    written = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(written.format("spans")), 256).alias("base_sha256"), F.expr(written.format("concat(spans, extra)")).alias("spans"))
