"""Column expressions. All are built in and stay in the JVM, but for the decoding of entities."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.schema import MIN_SECONDS, MIN_WORDS, Z_95


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2norm(v: Column) -> Column:
    """The unit vector. Vector and norm are bound first, so each is made once and not for every component."""
    bound = F.transform(F.array(v), lambda u: F.struct(u.alias("u"), F.greatest(F.sqrt(dot(u, u)), F.lit(1e-12)).alias("n")))
    return F.get(F.transform(bound, lambda s: F.transform(s["u"], lambda x: x / s["n"])), F.lit(0))


def fused(a: Column, b: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """The unit vector of the weighted sum."""
    return l2norm(F.zip_with(a, b, lambda x, y: alpha * x.cast("double") + beta * y.cast("double")))


def representation(name: str, video: Column, text: Column) -> Column:
    if name == "video":
        return F.transform(video, lambda x: x.cast("double"))
    if name == "transcript":
        return F.transform(text, lambda x: x.cast("double"))
    if name == "fused":
        return fused(video, text)
    raise ValueError(f"unknown representation {name!r}")


def wilson(k: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """The interval's ends within [0, 1]; null for no trials or for successes outside them."""
    valid = (n > 0) & (k >= 0) & (k <= n)
    n = F.when(valid, n.cast("double"))
    p = k / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(valid, F.greatest(centre - half, F.lit(0.0))), F.when(valid, F.least(centre + half, F.lit(1.0)))


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series from n + 9 on, divided back; exact to some 1e-12."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    for k in range(1, 9):
        series = series - F.log(n + k)
    return series


def mcnemar_p(n10: Column, n01: Column) -> Column:
    """Two-sided exact p; none discordant: 1.

    Binomial terms are added from the largest of the tail downwards. They shrink faster the farther they are out, and
    40 standard deviations hold all that a double can tell, so counts of any size take few terms and don't underflow.
    """
    m, n = F.least(n10, n01).cast("bigint"), (n10 + n01).cast("bigint")
    top = log_factorial(n) - log_factorial(m) - log_factorial(n - m) - n * F.log(F.lit(2.0))
    terms = F.least(m, F.ceil(20 * F.sqrt(n)) + 40)
    start = F.struct(top.alias("l"), F.exp(top).alias("s"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["l"] + F.log((m - j + 1) / (n - m + j))
        return F.struct(term.alias("l"), (acc["s"] + F.exp(term)).alias("s"))

    js = F.when(terms > 0, F.sequence(F.lit(1).cast("bigint"), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(js, start, step, lambda a: a["s"])))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))


def parse_answer(text: Column) -> Column:
    """The first of the digits 0 to 3 anywhere; null if there is none."""
    return F.nullif(F.regexp_extract(text, "[0-3]", 0), F.lit("")).try_cast("int")


def correct(pred: Column, gold: Column) -> Column:
    """Null if unlabelled; else whether an answer was read and is the label."""
    return F.when(gold.isNotNull(), F.coalesce(pred == gold, F.lit(False)))


#: White space of any script, and the four separators that strip and split take for it, too.
_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"(?U)^{_BLANK}+", ""), f"(?U){_BLANK}+$", "")


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """Entities of all kinds decoded. Only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescaped(F.when(F.contains(text, F.lit("&")), text)), text)


def normalized_line(text: Column) -> Column:
    """Entities decoded, white space of any kind collapsed to one blank, ends bare."""
    return F.trim(F.regexp_replace(unescaped(text), f"(?U){_BLANK}+", " "))


def lines(text: Column) -> Column:
    return F.split(text, "[\\r\\n\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]+")


def render_query(form: str, q: Column, options: list[Column], gold: Column) -> Column:
    """Null where a part is null, so that the caller can see that a form isn't available."""
    if form == "question":
        return q
    if form == "question+options":
        out = q
        for o in options:
            out = F.concat(out, F.lit(" "), o)
        return out
    if form == "answer":
        return gold
    raise ValueError(f"unknown query form {form!r}")


#: The sentence that ends a prompt (fixed value).
INSTRUCTION = "Answer with the number of the correct option, and nothing else."


def render_prompt(q: Column, options: list[Column]) -> Column:
    parts = [q]
    for i, o in enumerate(options):
        parts += [F.lit(f"\n{i}. "), o]
    return F.concat(*parts, F.lit(f"\n{INSTRUCTION}"))


def content_parts(prompt: Column, transcript: Column, question_first: bool = False) -> Column:
    """(kind, text) in order: the clip, the transcript unless empty, the question; or the question first."""
    video = F.struct(F.lit("video").alias("kind"), F.lit("").alias("text"))
    said = F.struct(F.lit("text").alias("kind"), F.coalesce(transcript, F.lit("")).alias("text"))
    asked = F.struct(F.lit("text").alias("kind"), prompt.alias("text"))
    parts = F.array(asked, video, said) if question_first else F.array(video, said, asked)
    return F.filter(parts, lambda p: (p["kind"] == "video") | (p["text"] != ""))


def frame_indices(total: Column, wanted: Column) -> Column:
    """Evenly spread frame numbers, halves to even; null for counts that aren't positive."""
    n = F.least(wanted, total).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.bround(i * (total - 1) / F.greatest(n - 1, F.lit(1)).cast("double"), 0).cast("int"))
    return F.when((total > 0) & (wanted > 0), spread)


def window_frame_indices(total: Column, fps: Column, wanted: Column, start: Column, end: Column) -> Column:
    """Frame numbers within [start, end) seconds; null for unusable counts or an empty window."""
    lo = F.greatest(F.lit(0), F.bround(start * fps, 0).cast("int"))
    hi = F.least(total.cast("int") - 1, F.bround(end * fps, 0).cast("int") - 1)
    inner = frame_indices(hi - lo + 1, wanted)
    return F.when((total > 0) & (fps > 0) & (hi >= lo), F.transform(inner, lambda i: i + lo))


def windows_at_once(windows: Column) -> tuple[Column, Column]:
    """Frame numbers of many windows (array of arrays) as one pass reads them, and how many each window has."""
    return F.flatten(windows), F.transform(windows, F.size)


def split_again(frames: Column, sizes: Column) -> Column:
    """What one pass returned, by window; an error if it isn't as many as were asked for."""
    starts = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    parts = F.zip_with(starts, sizes, lambda a, n: F.slice(frames, a + 1, n))
    wrong = F.raise_error(F.concat(F.lit("frames decoded and asked for: "), F.size(frames).cast("string"), F.lit(", "), total.cast("string")))
    return F.when(F.size(frames) == total, parts).otherwise(wrong.cast("array<array<int>>"))


def frame_budget(duration: Column, fps: float, most: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(duration * fps).cast("int")))


def seconds_of(stamp: Column) -> Column:
    """``HH:MM:SS.mmm`` or ``MM:SS.mmm`` as seconds; null for what is neither."""
    parts = F.transform(F.split(stamp, ":"), lambda x: x.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s * 60 + x)


def stamp_of(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def uninformative(text: Column, seconds: Column) -> Column:
    """Fewer than 20 words, or shorter than 45 s; an empty text has no words."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return (words < MIN_WORDS) | (seconds < MIN_SECONDS)


def failure_reason(message: Column, needles: list[tuple[str, str]]) -> Column:
    """The reason of the first needle that the lower-cased message holds; null for none."""
    low, out = F.lower(message), F.lit(None).cast("string")
    for needle, reason in reversed(needles):
        out = F.when(F.contains(low, F.lit(needle)), reason).otherwise(out)
    return out


def draw(seed: int, *keys: Column) -> Column:
    """A reproducible order for sampling that doesn't depend on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def encoder_of(stem: Column) -> Column:
    return F.regexp_replace(stem, "_[^_]*$", "")


def temperature(log_t: Column) -> Column:
    return F.greatest(F.exp(log_t), F.lit(0.01))
