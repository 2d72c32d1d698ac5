"""URL allow and block lists as a trie (operator 9).

A rule is a host and a path prefix. Hosts are stored by reversed labels (``com``, ``example``, ...), so one
walk visits a host and all domains above it; at each host node hangs a second trie over path segments,
whose last edge may be the beginning of a segment. The trie is broadcast (rules are refused beyond
``MAX_RULES``, which bounds it) and walked once per url. The longest match wins, whether it allows or
blocks: first the longest host, then the longest path under it; where the deepest host has no fitting
path, the next one above decides. A rule given twice with both verdicts blocks.

Defined results: a null url or one without ``://`` has an empty host and path and gets the default
verdict; an empty host fits no rule; repeated rows are judged alike; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
#: The query's rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


class Trie:
    """Nested dictionaries: labels to nodes; a node's paths: segments to nodes and partial last segments."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {"next": {}, "path": None}
        count = 0
        for verdict, host, path in rules:
            count += 1
            if count > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node["next"].setdefault(label, {"next": {}, "path": None})
            *segments, rest = path.split("/")
            at = node["path"] = node["path"] or {"next": {}, "rest": {}}
            for s in segments:
                at = at["next"].setdefault(s, {"next": {}, "rest": {}})
            old = at["rest"].get(rest)
            at["rest"][rest] = (host.lower() + path, "block" if old and "block" in (old[1], verdict) else verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule text and verdict of the longest match."""
        if not host:
            return None
        node, nodes = self.root, []
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["path"]:
                nodes.append(node["path"])
        segments = path.split("/")
        for at in reversed(nodes):
            best = None
            for s in segments:
                fits = [r for r in at["rest"] if s.startswith(r)]
                best = at["rest"][max(fits, key=len)] if fits else best
                at = at["next"].get(s)
                if at is None:
                    break
            if best:
                return best
        return None


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(Trie(rules))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for batch in batches:
            found = [find(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            rule, verdict = [x and x[0] for x in found], [x[1] if x else default for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    split = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return split.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def oracle(rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> str:
    """The same in DuckDB SQL, every rule tested against every url."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH rules(kind, h, p) AS (VALUES {values}), parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ranked AS (
  SELECT page_id, host, path, h || p AS rule, kind,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC, kind DESC) AS r
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(kind, '{default}') AS verdict FROM ranked WHERE r = 1
"""
