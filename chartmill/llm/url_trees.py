"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

A rule (a host, and a path it may narrow down to) fits a host and its subdomains. URLs that
a rule fits get the longest one's verdict; they are also the labelled URLs from which the trees learn to judge
all others. Features are lengths, depth, shares of digits, entropy, counts of parameters
and labels, and statistics of the host's suffix: how often its last one and two labels are
blocked among the labelled URLs.

Everything runs on DataFrame functions and Spark's own boosted trees. The trees
are fitted on a bounded sample of the labelled URLs; features and verdicts cover all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import col, written

#: Labelled URLs the trees are fitted on, about; chosen by a hash of the URL.
SAMPLE_ROWS = 20_000
TREES = 20
DEPTH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_digit_ratio", "f_entropy", "f_params", "f_labels",
    "f_hyphens", "f_escapes", "f_fragment", "f_extension", "f_https", "f_suffix", "f_domain",
)


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with its subdomains, for paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, NULL if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule.text)):  # the last that fits is the longest
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def entropy(text: Column) -> Column:
    """Bits per character of a text's own characters; 0 for an empty one."""
    size = F.length(text).cast("double")
    share = F.transform(
        F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    )
    bits = F.aggregate(share, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(size > 0, bits).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical_features(urls: DataFrame) -> DataFrame:
    """Adds the features of columns url (not NULL), host and path; all but the suffix statistics."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    length = F.length(url).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, "\\.")
    return urls.select(
        "*",
        length.alias("f_length"),
        F.length(host).cast("double").alias("f_host_length"),
        F.length(path).cast("double").alias("f_path_length"),
        _count(path, "/").alias("f_depth"),
        F.when(length > 0, _count(url, "[0-9]") / length).otherwise(0.0).alias("f_digit_ratio"),
        entropy(url).alias("f_entropy"),
        F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0.0).alias("f_params"),
        F.size(labels).cast("double").alias("f_labels"),
        _count(url, "-").alias("f_hyphens"),
        _count(url, "%").alias("f_escapes"),
        F.contains(url, F.lit("#")).cast("double").alias("f_fragment"),
        path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double").alias("f_extension"),
        F.startswith(F.lower(url), F.lit("https:")).cast("double").alias("f_https"),
        F.element_at(labels, -1).alias("suffix"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
    )


def suffix_statistics(sample: DataFrame, key: str, name: str) -> DataFrame:
    """Per suffix of the labelled sample: the share that is blocked, drawn towards the whole sample's by five rows."""
    overall = sample.agg(F.avg("label")).first()[0]
    rate = (F.sum("label") + F.lit(5.0 * overall)) / (F.count("*") + F.lit(5.0))
    return sample.groupBy(key).agg(rate.alias(name))


def with_statistics(rows: DataFrame, statistics: list[tuple[DataFrame, str, str]], default: float) -> DataFrame:
    """Add the suffix statistics; a suffix the sample lacks has the whole sample's share.

    A statistic has no more rows than the bounded sample, so it can be broadcast.
    """
    for table, key, name in statistics:
        rows = rows.join(F.broadcast(table), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))
    return rows


@dataclass
class UrlModel:
    """Trees with the statistics their features need; ``trees`` is None where one verdict covers all labels."""

    trees: GBTClassificationModel | None
    statistics: list[tuple[DataFrame, str, str]]
    default: float

    def judge(self, rows: DataFrame) -> DataFrame:
        """Adds ``score`` (the probability of being blocked) to rows with the lexical features."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.default))
        from pyspark.ml.functions import vector_to_array

        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
            with_statistics(rows, self.statistics, self.default)
        )
        return self.trees.transform(ready).withColumn("score", vector_to_array("probability")[1])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Learn from rows with the lexical features and ``label`` (1.0: block).

    About ``sample_rows`` different URLs are used, chosen by hash; one that many rows repeat counts once. Without any
    labelled row nothing is blocked.
    """
    count = labelled.agg(F.approx_count_distinct("url")).first()[0]
    slots = 1 << 30
    share = min(slots, slots * sample_rows // max(count, 1))
    chosen = labelled.drop("page_id").filter(F.pmod(F.xxhash64("url"), F.lit(slots)) < share)
    sample = written(chosen.dropDuplicates(["url"]), "labelled_urls")
    bounds = sample.agg(F.min("label"), F.max("label"), F.avg("label")).first()
    if bounds[0] is None or bounds[0] == bounds[1]:
        return UrlModel(None, [], float(bounds[0] or 0.0))
    statistics = [(suffix_statistics(sample, "suffix", "f_suffix"), "suffix", "f_suffix")]
    statistics.append((suffix_statistics(sample, "domain", "f_domain"), "domain", "f_domain"))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        with_statistics(sample, statistics, bounds[2])
    )
    boosted = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=17)
    return UrlModel(boosted.fit(ready.select("label", "features")), statistics, bounds[2])


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    verdict is the rule's (``block`` or ``allow``) if one fits, else block where the trees give a probability over
    one half; score is that probability, for all rows. Host and path are empty for a NULL url or one without ``://``; such
    rows are judged by the trees like others, as empty text or as it stands. Repeated rows get equal results; other columns are
    not read; an empty table gives no rows.
    """
    url = F.coalesce(col(url_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).cast("long").alias("page_id"), url.alias("url"))
    rows = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(tuple(rules), F.col("host"), F.col("path"))
    rows = lexical_features(rows.select("*", rule.alias("rule"), verdict.alias("by_rule")))
    labelled = rows.filter("by_rule IS NOT NULL").withColumn("label", (F.col("by_rule") == "block").cast("double"))
    judged = fit(labelled, sample_rows).judge(rows)
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
