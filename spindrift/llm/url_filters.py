"""URL filters: one trie over reversed host labels, then path segments; the longest rule that fits decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.base import read

#: The lists (fixed values): verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The verdict where no rule fits.
DEFAULT = "allow"
#: The trie is broadcast; lists beyond this are refused rather than sent.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Entry:
    verdict: str
    rule: str


class Trie:
    """Nodes are dicts: host labels from the right, then the key 1 leads to the path part, keyed by whole segments.

    A rule's path is a string prefix: its segments up to the last slash must be equal, the rest begins the next one.
    """

    def __init__(self, rules: tuple[tuple[str, str, str], ...]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(1, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(2, {})[rest] = Entry(verdict, host + path)

    def match(self, host: str, path: str) -> Entry | None:
        """The longest rule, host and path together, of all hosts from the url's own up; of equally long ones that of the
        deeper host."""
        hosts, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if 1 in node:
                hosts.append(node[1])
        segments = path.split("/")
        found, longest = None, -1
        for node in reversed(hosts):
            for i, segment in enumerate(segments):
                for rest, entry in node.get(2, {}).items():
                    if len(entry.rule) > longest and segment.startswith(rest):
                        found, longest = entry, len(entry.rule)
                if i == len(segments) - 1 or segment not in node:
                    break
                node = node[segment]
        return found


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z lower-cased; empty for null or no ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = DEFAULT, key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule (null where none fits) and verdict, a row for each row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and so the default verdict. Repeated rows stay; an
    empty table gives none; a null key stays null. Of two entries for one host and path the later one counts.
    Only ``key`` and ``url`` are read. The trie is bounded by MAX_RULES and broadcast once per executor.
    """
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = trie.value
        for pdf in batches:
            entries = [found.match(h, p) for h, p in zip(pdf["host"], pdf["path"], strict=True)]
            yield pdf.assign(rule=[e.rule if e else None for e in entries], verdict=[e.verdict if e else default for e in entries])

    split = pages.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = pages.schema[key].dataType.simpleString()
    return split.mapInPandas(look_up, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
