"""URL filter: fixed rules, and an empirical-Bayes reputation of hosts where no rule fits.

A rule is a host and a path. It fits the host and all its subdomains where the url's path starts with the rule's; the
longest rule that fits decides. Elsewhere the host's share of bad pages decides. Labelled page outcomes (bad or not)
are counted by host, registered domain and suffix. From the root down, each level's share is a beta-binomial posterior
mean with the level above as prior; a prior's weight is fitted to the spread of the shares below it (method of moments).
A host is blocked if the lower bound of its posterior, BOUND standard deviations below the mean, is over LIMIT. A host
without outcomes has the posterior of an unseen host of its registered domain, else of its suffix, else of the root.

Only counts by host are joined to the pages; a host of any number of pages is summed up before it is shuffled.

Defined cases: a null url, or one without `://`, has the empty host and path, which no rule fits; null outcomes are left
out; without any outcome the root's share is one half, over which no bound lies, so every such page is allowed; repeated
rows are judged alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, tidy
from .exact_dedup import digests
from .html_text import blocks, host_of, main_text, path_of

LIMIT = 0.5
BOUND = 1.645
#: A prior weighs as much as so many pages, at least and at most.
LEAST, MOST = 2.0, 1000.0
#: Second-level names under which two-letter suffixes register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


class Rule(NamedTuple):
    name: str  # host/path
    verdict: str

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, or three under a second-level name."""
    labels = F.split(host, r"\.")
    deep = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVEL)
    return F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.expr("substring(domain, instr(domain, '.') + 1)")).otherwise(domain)


def _weight(groups: DataFrame) -> Column:
    """A prior's weight in pages, from the spread of the shares k / n around the prior's share m."""
    m, share = F.col("m"), F.col("k") / F.col("n")
    spread = F.sum(F.col("n") * (share - m) * (share - m)) / F.sum("n")
    within = F.sum(m * (1 - m)) / F.sum("n")  # binomial noise: n * m (1 - m) / n, summed over groups
    level = F.sum(F.col("n") * m * (1 - m)) / F.sum("n")
    between = spread - within
    raw = F.when(between > 0, level / between - 1).otherwise(MOST)
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce(raw, F.lit(MOST))))


def _posterior(a: Column, b: Column) -> tuple[Column, Column]:
    """share and bound of a beta posterior."""
    share, deviation = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return share.alias("share"), (share - BOUND * deviation).alias("bound")


def levels(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors by host, domain and suffix, and the root's one row. outcomes: host, bad (0 or 1).

    Hosts: host, n, k, share, bound, of the host itself. Domains, suffixes, root: key (but for the root), share, bound,
    of a host below them that has no outcomes and no known level nearer to it. Its share varies by what is unknown of the
    level and by each step from there down; with a weight w for each, the steps' w / (w + 1) multiply.
    """
    known = outcomes.where("bad is not null").groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
    known = known.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    known = Workspace(outcomes.sparkSession, "outcomes").cut(known)  # one row a host, read for every level
    n, k = F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))
    root = known.agg(((k + 1) / (n + 2)).alias("m"), (n + 2).alias("size"))

    def level(groups: DataFrame, prior: DataFrame, key: str | None) -> tuple[DataFrame, DataFrame]:
        """groups with m (the prior's share) and w (its weight), one weight for a level; and that weight."""
        above = prior.select(*([key] if key else []), "m")
        joined = groups.join(above, key) if key else groups.join(F.broadcast(above), F.lit(True))
        weight = joined.agg(_weight(joined).alias("w"))  # one row
        return joined.join(F.broadcast(weight), F.lit(True)), weight

    def shrunk(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(key, ((F.col("k") + F.col("w") * F.col("m")) / (F.col("n") + F.col("w"))).alias("m"), (F.col("n") + F.col("w")).alias("size"))

    by_suffix, w_suffix = level(known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), root, None)
    suffixes = shrunk(by_suffix, "suffix")
    by_domain, w_domain = level(known.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), suffixes, "suffix")
    domains = shrunk(by_domain, "domain")
    by_host, w_host = level(known, domains, "domain")
    hosts = by_host.select("host", "n", "k", *_posterior(F.col("k") + F.col("w") * F.col("m"), F.col("n") - F.col("k") + F.col("w") * (1 - F.col("m"))))

    def below(prior: DataFrame, key: str | None, weights: list[DataFrame]) -> DataFrame:
        """The posterior of a host without outcomes, the weights being those of the steps down to it."""
        kept = F.col("size") / (F.col("size") + 1)
        for i, weight in enumerate(weights):
            prior = prior.join(F.broadcast(weight.select(F.col("w").alias(f"w{i}"))), F.lit(True))
            kept = kept * F.col(f"w{i}") / (F.col(f"w{i}") + 1)
        size = kept / (1 - kept)
        return prior.select(*([key] if key else []), *_posterior(size * F.col("m"), size * (1 - F.col("m"))))

    return hosts, below(domains, "domain", [w_host]), below(suffixes, "suffix", [w_domain, w_host]), below(root, None, [w_suffix, w_domain, w_host])


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, k, share, bound for every host with outcomes. outcomes: host, bad (0 or 1)."""
    return levels(outcomes)[0]


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, share, bound: one row per row of pages. A host without outcomes of its own
    is judged by its domain's, else by its suffix's, else by the root's."""
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    told = placed.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    hosts, domains, suffixes, root = levels(outcomes)
    for i, (found, key) in enumerate(((hosts, "host"), (domains, "domain"), (suffixes, "suffix"))):
        told = told.join(found.select(key, F.struct("share", "bound").alias(f"p{i}")), key, "left")
    told = told.join(F.broadcast(root.select(F.struct("share", "bound").alias("p3"))), F.lit(True))
    told = told.select(F.col("host").alias("_rs_host"), F.coalesce("p0", "p1", "p2", "p3").alias("p")).select("_rs_host", "p.share", "p.bound")
    joined = placed.join(told, F.col("host") == F.col("_rs_host"), "left")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "share", "bound")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blanks = str.maketrans("", "", "\x20\x09\x0a\x0b\x0c\x0d")
    for batch in batches:
        found = []
        for html in batch.column(1).to_pylist():
            text = "".join(b.text for b in main_text(blocks(html), []) if b.tag not in ("h1", "h2", "title")).translate(blanks)
            found.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["url", "text_sha256"])


def labelled(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """host, bad: the outcome of every page whose main text, but for headings and white space, is a labelled
    document's; bad if that is marked toxic or of low quality."""
    bad = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0))
    marks = labels.groupBy("doc_id").agg(bad.alias("bad")).where("bad is not null")
    texts = digests(docs).select("doc_id", "text_sha256").join(marks, "doc_id").groupBy("text_sha256").agg(F.max("bad").alias("bad"))
    seen = pages.select("url", "html").mapInArrow(tidy(_digested), "url string, text_sha256 string")
    return seen.join(texts, "text_sha256").select(host_of(F.col("url")).alias("host"), "bad")
