"""URL filtering by pattern rules indexed by their rarest literal token.

A rule is a host and path pair or a regular expression; both are compiled to
one expression over ``host + path`` with a set of *literal tokens* (runs of
letters and digits, case ignored) that every matching URL must contain.  Each
rule is filed under the one of its tokens that is rarest among the URLs at hand,
counted over all rows by a join with the table of the rules' tokens (so the
counts are as small as the rule list).  A URL's tokens fetch the candidate
rules, and only those run their expressions, which are compiled when first
needed.  Rules without a literal token are candidates for every URL.

Rules are a list or come from a table (``rules_from``), up to ``MAX_RULES``;
lists of that size are what a filter of the web's advert and scam hosts holds.

Verdict: the longest host and path rule that fits decides.  Without one, the
pattern rules do: any that matches blocks; otherwise the URL is allowed.

Defined results: host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z lower-cased; path is what follows up to ``?``, ``#`` or
the end.  A null URL or one without ``://`` has an empty host and path, fits no
host rule, and gets the method's verdict.  Of host rules of equal length, the
first in the list wins.  Repeated rows are judged alike; an empty table gives
no rows; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, named

TOKEN = r"[A-Za-z0-9]+"
_TOKEN = re.compile(TOKEN)
# Rules that the driver and each worker hold (about 0.5 KB each), and rule tokens up to which their table is broadcast.
MAX_RULES = 1_000_000
BROADCAST_TOKENS = 500_000


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` for a host rule, else a ``pattern`` and the tokens it cannot match without."""
    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    literals: tuple[str, ...] = ()

    @property
    def text(self) -> str:
        return self.host + self.path if self.host else self.pattern

    @property
    def expression(self) -> str:
        """For ``host + path``: host rules fit the host, its subdomains, and paths that start like theirs."""
        if not self.host:
            return self.pattern
        return rf"\A(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> tuple[str, ...]:
        """Whole tokens, lower-cased, of every URL that the rule matches (a path's last token may be cut short)."""
        if not self.host:
            return tuple(dict.fromkeys(t.lower() for t in self.literals))
        inner = [m.group() for m in _TOKEN.finditer(self.path) if m.end() < len(self.path)]
        return tuple(dict.fromkeys(t.lower() for t in [*_TOKEN.findall(self.host), *inner]))


def host_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host=host, path=slash + path)


def pattern_rule(*words: str) -> Rule:
    """Blocks URLs that hold these words, in order, as whole tokens next to each other, in any case."""
    inner = r"[^A-Za-z0-9]+".join(map(re.escape, words))
    return Rule("block", pattern=rf"(?ai)(?<![A-Za-z0-9]){inner}(?![A-Za-z0-9])", literals=words)


def rules_from(df: DataFrame, verdict_col: str = "verdict", rule_col: str = "rule") -> list[Rule]:
    """Rules of a table, in the order of their texts: ``host/path`` rules with their verdict, and words to block
    (rules without a ``/``, words apart by blanks).  NULL and empty rules are left out, repeated ones come once."""
    rows = (df.select(F.coalesce(named(verdict_col), F.lit("block")).alias("v"), F.trim(named(rule_col)).alias("r"))
            .filter("r <> ''").distinct().orderBy("r", "v").limit(MAX_RULES + 1).collect())
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [host_rule(x["v"], x["r"]) if "/" in x["r"] else pattern_rule(*x["r"].split()) for x in rows]


# What the method blocks by itself when no host rule decides.
PATTERNS = tuple(pattern_rule(*w) for w in (
    ("casino",), ("poker",), ("porn",), ("xxx",), ("viagra",), ("cheap", "pills"), ("free", "money"),
    ("click", "here"), ("affiliate",), ("adserver",), ("doubleclick",), ("phishing",), ("malware",)))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def token_counts(hosts_and_paths: DataFrame, column: str, tokens: Iterable[str]) -> dict[str, int]:
    """How many rows hold each of the given (lower-cased) tokens; as many counts as tokens."""
    tokens = sorted(set(tokens))
    if not tokens:
        return {}
    spark = hosts_and_paths.sparkSession
    known = spark.createDataFrame(pa.table({"token": pa.array(tokens, pa.string())}))
    words = F.array_distinct(F.regexp_extract_all(F.lower(named(column)), F.lit(f"({TOKEN})"), F.lit(1)))
    found = (hosts_and_paths.select(F.explode(words).alias("token"))
             .join(F.broadcast(known) if len(tokens) <= BROADCAST_TOKENS else known, "token", "left_semi")
             .groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect())
    return dict.fromkeys(tokens, 0) | {r["token"]: r["n"] for r in found}


class RuleIndex:
    """Rules by their rarest token; ``judge`` gives (text of the host rule or None, verdict)."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]) -> None:
        self.rules = list(rules)
        self.compiled: dict[int, re.Pattern] = {}
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        each = [r.tokens for r in self.rules]
        # of tokens as rare among the URLs, the one that fewer rules share
        shared_by = Counter(t for tokens in each for t in tokens)
        for i, tokens in enumerate(each):
            if tokens:
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), shared_by[t], t))
                self.by_token.setdefault(rarest, []).append(i)
            else:
                self.always.append(i)

    def candidates(self, target: str) -> list[int]:
        found = set(self.always)
        for token in set(_TOKEN.findall(target.lower())):
            found.update(self.by_token.get(token, ()))
        return sorted(found)

    def _matches(self, i: int, target: str) -> bool:
        expression = self.compiled.get(i)
        if expression is None:
            expression = self.compiled[i] = re.compile(self.rules[i].expression, re.S)
        return expression.search(target) is not None

    def judge(self, target: str) -> tuple[str | None, str]:
        hits = [i for i in self.candidates(target) if self._matches(i, target)]
        own = [i for i in hits if self.rules[i].host]
        if own:
            best = self.rules[max(own, key=lambda i: (len(self.rules[i].text), -i))]
            return best.text, best.verdict
        return None, "block" if hits else "allow"


def judge(df: DataFrame, rules: Iterable[Rule], url_col: str = "url") -> tuple[DataFrame, str]:
    """``df`` with a struct column (host, path, rule, verdict), and that column's name."""
    rules = list(rules)
    target, name = fresh(df.columns, "uf_target", "url_verdict")
    parted = df.withColumn(target, F.struct(host_of(named(url_col)).alias("host"),
                                            path_of(named(url_col)).alias("path")))
    whole = F.concat(named(target).getField("host"), named(target).getField("path"))
    counts = token_counts(parted.select(whole.alias("t")), "t", (t for r in rules for t in r.tokens))
    index = RuleIndex(rules, counts)

    @F.arrow_udf("rule string, verdict string")
    def verdicts(targets: pa.Array) -> pa.Array:
        out = [index.judge(t) for t in targets.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r for r, _ in out], pa.string()),
                                           pa.array([v for _, v in out], pa.string())], names=["rule", "verdict"])

    found = named(target)
    judged = parted.withColumn(name, verdicts(whole))
    return (judged.withColumn(name, F.struct(
        found.getField("host").alias("host"), found.getField("path").alias("path"),
        named(name).getField("rule").alias("rule"), named(name).getField("verdict").alias("verdict"))).drop(target),
            name)
