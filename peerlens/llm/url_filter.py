"""URL filter: allow and block rules in a trie over reversed host labels and
path segments, broadcast to the tasks; the deepest matching entry decides.

A rule is ``host/path`` (``example.net/en/``).  It fits its host and every
subdomain when the path of the URL starts with the rule's path.  The longest
rule wins: more host labels first, then the longer path; of two equal rules
the blocking one.

Cases: a null URL or one without ``://`` has empty host and path and gets the
default verdict; empty labels and ports are part of the host as written;
repeated rows are judged one by one; an empty table gives an empty one; other
columns of the input are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRIE_BYTES = 64 << 20       # refuse to broadcast a larger rule set
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str        # allow or block
    host: str           # lower case, without scheme
    path: str           # starts with "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(rules: Iterable[tuple[str, str]]) -> list[Rule]:
    """``(verdict, "host/path")`` pairs as rules; the path may be empty."""
    out = []
    for verdict, text in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {verdict!r}")
        host, slash, path = text.partition("/")
        out.append(Rule(verdict, host.translate(str.maketrans(_UPPER, _LOWER)), slash + path))
    return out


def segments(path: str) -> list[str]:
    """``/en/a`` as ``['/', 'en/', 'a']``: every slash ends a segment."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]] + [parts[-1]] * bool(parts[-1])


class Trie:
    """Host nodes are ``[children, path node]``, path nodes ``[children,
    entries]``; an entry is (rest, verdict, rule text) where ``rest`` is the
    last, unfinished segment of the rule's path (a prefix of the next one)."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: list = [{}, None]
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, []]
            at, steps = node[1], segments(rule.path)
            rest = steps.pop() if steps and not steps[-1].endswith("/") else ""
            for step in steps:
                at = at[0].setdefault(step, [{}, []])
            at[1].append((rest, rule.verdict, rule.text))
            at[1].sort(key=lambda e: (-len(e[0]), e[1] != "block"))

    @staticmethod
    def _path_match(node: list, path: str, steps: list[str]) -> tuple[str, str] | None:
        best, used = None, 0
        for k in range(len(steps) + 1):
            for rest, verdict, text in node[1]:
                if path.startswith(rest, used):
                    best = (text, verdict)
                    break
            if k == len(steps) or steps[k] not in node[0]:
                return best
            node, used = node[0][steps[k]], used + len(steps[k])
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The (rule text, verdict) of the longest rule that fits, or None."""
        node, best, steps = self.root, None, None
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                steps = segments(path) if steps is None else steps
                best = self._path_match(node[1], path, steps) or best
        return best


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path) of a URL column; both empty when it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def url_filter(df: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge every URL: id, host, path, rule (null if none fits) and verdict."""
    trie = Trie(parse_rules(rules))
    if (size := len(pickle.dumps(trie.root))) > MAX_TRIE_BYTES:
        raise ValueError(f"the rule trie has {size} bytes; at most {MAX_TRIE_BYTES} are broadcast")
    shared = df.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = shared.value.match
        found = [match(h, p) or (None, default) for h, p in zip(host, path)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    host, path = url_parts(F.col(url_col))
    parts = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    judged = parts.withColumn("j", judge("host", "path"))
    return judged.select(id_col, "host", "path", F.col("j.rule").alias("rule"),
                         F.col("j.verdict").alias("verdict"))
