"""URL filtering by given rules and by association rules.

Given rules name a host and a path: a rule fits its host and all subdomains if the url's path starts with the rule's;
the longest that fits decides. The urls that the given rules decide are the labelled ones; a url's tokens and its label are
a transaction. Spark's FP-growth mines the frequent token combinations of three quarters of the hosts; those with a label
at their end, enough support and confidence, and more confidence than the label has anyway, are association rules. Rules
that a shorter one matches with no less confidence are pruned, and so are those which, on the hosts held out, are right
less often than the least confidence, or which fewer than `MIN_HOSTS` groups of hosts bear out.

As all labels come from a few given rules, a mined rule may but repeat what one of them says of its own hosts and paths. So it must have evidence
from two given rules at least, and stand without any one of them: left out in turn, the others still give it its support and
confidence, and it is right of the urls that the one left out decides. What only one given rule says is not carried over to other urls.

A url that no given rule fits gets the label of its best mined rule (most confident, then best supported, then shortest, then
first by name), found by an inverted index from each rule's first token; without one it gets `otherwise`. `leave_one_out`
measures what that is worth: each given rule's urls are judged by what the other given rules alone would have taught.

The number of mined rules does not grow with the pages: supports are shares of the transactions. Rules, and counts of a
mined rule by given rule, alone reach the driver. The labelled urls' tokens are written once and read from there.

Nulls: a null url, or one without `://`, has an empty host and path and no tokens. Repeated rows count as often as they
occur. Empty tables give no rows; without labelled urls nothing is mined. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import ascii_lower, durable, ship

ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the contract.
RULES = (
    Rule(BLOCK, "com", "/en/"),
    Rule(ALLOW, "example.com", "/en/7"),
    Rule(ALLOW, "net", "/de/"),
    Rule(BLOCK, "example.net", "/de/8"),
    Rule(BLOCK, "org", "/es/"),
)
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.01, 0.8, 1.1
#: Every so manieth host is held out; a rule must be borne out by so many of so many groups of hosts.
HELD, MIN_HOSTS, HOST_GROUPS = 4, 8, 64
_LABEL = "label="


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(size, rule, verdict) of the longest given rule that fits; null if none does."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The different tokens of a url: its host's endings and front, its path's first steps and kind, and its form."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    ends = F.when(host != "", F.transform(F.sequence(F.lit(1), F.least(n, F.lit(3))), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(parts, n - i + 1, i), "."))))
    last = F.get(steps, F.size(steps) - 1)
    kind = F.array(
        F.when(n > 2, F.concat(F.lit("front="), parts[0])),
        F.concat(F.lit("step1="), F.get(steps, F.lit(0))),
        F.concat(F.lit("step2="), F.get(steps, F.lit(1))),
        F.concat(F.lit("steps="), F.least(F.size(steps), F.lit(4)).cast("string")),
        F.when(last.rlike(r"^[0-9]+$"), F.lit("number")),
        F.concat(F.lit("ends="), F.nullif(F.regexp_extract(last, r"\.([A-Za-z0-9]+)$", 1), F.lit(""))),
        F.when(url.contains("?"), F.lit("query")),
    )
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(ends, F.array()), kind)))


class Mined(NamedTuple):
    tokens: frozenset[str]
    verdict: str
    confidence: float
    support: float

    def rank(self):
        return (-self.confidence, -self.support, len(self.tokens), sorted(self.tokens), self.verdict)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[Mined]:
    """Association rules from (tokens, verdict) rows, those without a verdict aside."""
    items = F.array_append("tokens", F.concat(F.lit(_LABEL), "verdict"))
    sets = labelled.filter("verdict is not null").select(items.alias("items"))
    if sets.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sets)
    ends = model.associationRules.filter(F.col("consequent")[0].startswith(_LABEL) & (F.col("lift") >= MIN_LIFT))
    ends = ends.filter(~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
    found = [Mined(frozenset(r.antecedent), r.consequent[0].removeprefix(_LABEL), r.confidence, r.support) for r in ends.collect()]
    kept: list[Mined] = []
    for rule in sorted(found, key=lambda r: (len(r.tokens), r.rank())):
        if not any(k.tokens < rule.tokens and k.verdict == rule.verdict and k.confidence >= rule.confidence for k in kept):
            kept.append(rule)
    return sorted(kept, key=Mined.rank)


def proven(rules: list[Mined], labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_hosts: int = MIN_HOSTS, min_support: float = MIN_SUPPORT) -> list[Mined]:
    """The rules that (tokens, verdict, given, hosts, held) rows bear out: right often enough where held, in enough groups of
    hosts, and without any one of the given rules."""
    if not rules:
        return []
    index = Index(rules)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Counter = Counter()
        for batch in batches:
            for own, verdict, given, hosts, held in zip(*[c.to_pylist() for c in batch.columns]):
                for i in index.fitting(own):
                    told[i, given, hosts, held, rules[i].verdict == verdict] += 1
        columns = [*zip(*told), tuple(told.values())] if told else [()] * 6
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["rule", "given", "hosts", "held", "right", "n"])

    told = durable(labelled.select("tokens", "verdict", "given", "hosts", "held").mapInArrow(tell, "rule int, given string, hosts int, held boolean, right boolean, n bigint"))
    right, held = F.col("right"), F.col("held")
    each = told.groupBy("rule").agg(F.count_distinct(F.when(right, F.col("hosts"))).alias("hosts"), F.sum(F.when(held & right, F.col("n")).otherwise(0)).alias("right"), F.sum(F.when(held, F.col("n")).otherwise(0)).alias("held"))
    good = {r.rule for r in each.collect() if r.hosts >= min_hosts and r.held and r.right >= min_confidence * r.held}
    size = {r.given: r["count"] for r in labelled.groupBy("given").count().collect()}
    whole = sum(size.values())
    by_given: dict[int, dict[str, tuple[int, int]]] = defaultdict(dict)
    for r in told.groupBy("rule", "given").agg(F.sum(F.when(right, F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("n")).collect():
        by_given[r.rule][r.given] = (r.right, r.n)

    def stands(own: dict[str, tuple[int, int]]) -> bool:
        all_right, all_n = (sum(x[k] for x in own.values()) for k in (0, 1))
        for given, (yes, n) in own.items():
            rest = all_right - yes
            if rest < min_confidence * (all_n - n) or rest <= 0 or rest < min_support * (whole - size[given]) or yes < min_confidence * n:
                return False
        return len(own) >= 2

    return [rule for i, rule in enumerate(rules) if i in good and stands(by_given[i])]


class Index:
    """Mined rules by their first token."""

    def __init__(self, rules: list[Mined]):
        self.rules = rules
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for i, rule in enumerate(rules):
            self.by_token[min(rule.tokens)].append(i)

    def fitting(self, tokens: list[str]) -> list[int]:
        have = set(tokens)
        return [i for t in have for i in self.by_token.get(t, ()) if self.rules[i].tokens <= have]

    def best(self, tokens: list[str]) -> Mined | None:
        fits = self.fitting(tokens)
        return self.rules[min(fits)] if fits else None


def _parts(pages: DataFrame, page_id: str, url: str, rules: tuple[Rule, ...]) -> DataFrame:
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    cut = F.when(F.col("url").contains("://"), tokens(F.col("url"), F.col("host"), F.col("path")))
    return rows.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.col("given.verdict").alias("verdict"), F.coalesce(cut, F.array().cast("array<string>")).alias("tokens"))


def _labelled(rows: DataFrame) -> DataFrame:
    hosts = F.pmod(F.xxhash64("host"), F.lit(HELD * HOST_GROUPS))
    return rows.filter("verdict is not null").select("tokens", "verdict", F.col("rule").alias("given"), (hosts / HELD).cast("int").alias("hosts"), (hosts % HELD == 0).alias("held"))


def learn(known: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_hosts: int = MIN_HOSTS) -> list[Mined]:
    """The mined rules of labelled rows (tokens, verdict, given, hosts, held), best first."""
    return proven(mine(known.filter("not held"), min_support, min_confidence), known, min_confidence, min_hosts, min_support)


def leave_one_out(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, otherwise: str = ALLOW, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """(rule, n, right, plain): for each given rule the urls that it decides, how many of them get its verdict from what the
    other given rules' urls alone teach, and how many from `otherwise` alone."""
    rows = durable(_parts(pages, page_id, url, rules).filter("rule is not null"))
    out = []
    for r in rules:
        name = r.host + r.path
        index = Index(learn(durable(_labelled(rows.filter(F.col("rule") != name))), min_support, min_confidence, min_hosts))

        def count(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [index.best(own) for own in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x.verdict if x else otherwise for x in found], pa.string())], ["verdict"])

        own = rows.filter(F.col("rule") == name)
        told = own.select("tokens").mapInArrow(count, "verdict string").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == r.verdict).alias("right")).first()
        out.append((name, told["n"], told["right"], told["n"] if r.verdict == otherwise else 0))
    return pages.sparkSession.createDataFrame(out, "rule string, n long, right long, plain long")


def judge(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: tuple[Rule, ...] = RULES,
    otherwise: str = ALLOW,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_hosts: int = MIN_HOSTS,
) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, mined_rule, confidence (the last two where a mined rule decides)."""
    kind = pages.schema[page_id].dataType.simpleString()
    rows = _parts(pages, page_id, url, rules)
    known = durable(_labelled(rows))
    index = Index(learn(known, min_support, min_confidence, min_hosts))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, names, sure = [], [], []
            for verdict, own in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                best = index.best(own) if verdict is None else None
                verdicts.append(verdict or (best.verdict if best else otherwise))
                names.append(" & ".join(sorted(best.tokens)) if best else None)
                sure.append(best.confidence if best else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(names, pa.string()), pa.array(sure, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence"],
            )

    return rows.mapInArrow(scan, f"page_id {kind}, host string, path string, rule string, verdict string, mined_rule string, confidence double")


ship(__name__)
