"""URL filters: rules by host and path, and where none fits the host's reputation by empirical Bayes; in DataFrame functions only.

Labelled pages are counted by host, registered domain and suffix. The rate of bad pages of all is the mean of a beta prior for each
suffix, a suffix's posterior mean that of its domains, a domain's that of its hosts. How far a level
keeps to the one above (the prior's weight in pages) follows from the data by moments: the spread of the groups' counts beyond what
a binomial has. A host is blocked where the lower bound of its posterior rate of bad pages is above ``MAX_BAD``, so that a host of
few labels goes by its domain and suffix and isn't blocked without evidence.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to ``?``, ``#`` or the end. A rule
(``org/``, ``example.org/en/1``) fits its host and all below, where the path starts with the rule's; the longest rule wins.
For domain and suffix a user name, port and closing dots are left off; an address of digits is its own suffix.

Nulls and edges: a null url, or one without ``://``, has an empty host and path, and that host is judged like others. A null label
says nothing; a page whose id has several labels is bad if one says so; a null page_id has none. Repeated rows are
judged, and count, each on its own. Without labels the rate of bad pages is taken for a half, with a wide
posterior, and nothing is blocked. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fetched, written

#: (verdict, host and path)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels under which names are registered; others have one label.
SUFFIXES = tuple("ac.uk co.uk gov.uk org.uk com.au net.au org.au co.jp ne.jp or.jp co.kr or.kr co.nz co.za co.in com.br com.cn com.mx com.tr com.tw".split())
#: Blocked where the rate of bad pages is above this with the probability that Z standard deviations stand for.
MAX_BAD, Z = 0.5, 1.645
#: Bounds of a prior's weight in pages, and the weight where the data say nothing.
LEAST, MOST, UNKNOWN = 1.0, 1000.0, 10.0
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    cut = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(cut(1), *LOWER), cut(2)


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", "")
    last = lambda n: F.substring_index(bare, ".", -n)
    two, digits = last(2).isin(*SUFFIXES), bare.rlike(r"^[0-9.]+\z")
    return F.when(digits, bare).when(two, last(3)).otherwise(last(2)), F.when(digits, bare).when(two, last(2)).otherwise(last(1))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict), or null."""
    found = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.greatest(none, none, *found)


def shrunk(groups: DataFrame, mean: str, name: str) -> DataFrame:
    """Adds ``name``, the posterior mean of each group's rate of bad pages, and ``name_weight``, its prior's weight, to groups with n, bad and the prior's mean."""
    m, n = F.col(mean), F.col("n")
    spread = F.sum((F.col("bad") - n * m) ** 2 - n * m * (1 - m))
    share = spread / F.nullif(F.sum(n * (n - 1) * m * (1 - m)), F.lit(0.0))
    weight = F.when(share.isNull(), UNKNOWN).when(share <= 1 / (1 + MOST), MOST).otherwise(F.greatest(F.lit(LEAST), 1 / share - 1))
    fitted = groups.agg(F.round(F.coalesce(weight, F.lit(UNKNOWN)), 6).alias(f"{name}_weight"))  # one row
    x = groups.crossJoin(F.broadcast(fitted))
    return x.withColumn(name, F.round((F.col("bad") + F.col(f"{name}_weight") * m) / (n + F.col(f"{name}_weight")), 9))


def reputation(counts: DataFrame) -> DataFrame:
    """host, n_labelled, n_bad, bad_rate, bound (posterior mean and lower bound) from one row a host: host, n, bad."""
    domain, suffix = levels(F.col("host"))
    hosts = written(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = written(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = written(domains.groupBy("suffix").agg(*sums))
    every = suffixes.agg(F.round((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2), 9).alias("all_rate"))  # one row
    suffixes = written(shrunk(suffixes.crossJoin(F.broadcast(every)), "all_rate", "suffix_rate").select("suffix", "suffix_rate"))
    domains = written(shrunk(fetched(domains, suffixes, "suffix"), "suffix_rate", "domain_rate").select("domain", "domain_rate"))
    x = shrunk(fetched(hosts, domains, "domain"), "domain_rate", "bad_rate")
    spread = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + F.col("bad_rate_weight") + 1))
    return x.select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), F.round("bad_rate", 6).alias("bad_rate"), F.round(F.col("bad_rate") - Z * spread, 6).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), n_labelled, n_bad, bad_rate and bound of the host, for each of pages (page_id, url).

    labels: page_id, bad (boolean).
    """
    host, path = parts(pages["url"].cast("string"))
    urls = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    marks = labels.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("__bad"))
    x = written(fetched(urls, written(marks), "page_id", "left"))
    counts = x.groupBy("host").agg(F.count("__bad").alias("n"), F.sum(F.col("__bad").cast("long")).alias("bad")).withColumn("bad", F.coalesce("bad", F.lit(0)))
    x = fetched(x, written(reputation(counts)), "host").withColumn("__rule", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("bound") > max_bad, "block").otherwise("allow"))
    return x.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "n_labelled", "n_bad", "bad_rate", "bound")


def outcomes(labels: DataFrame) -> DataFrame:
    """Labels of documents (doc_id, quality, toxic) as those of the pages with their ids: bad is what has a quality of 0 or is toxic."""
    return labels.select(labels["doc_id"].cast("long").alias("page_id"), ((labels["quality"] == 0) | (labels["toxic"] == 1)).alias("bad"))
