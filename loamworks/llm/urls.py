"""URL filters: rules by host and path, and the reputation of hosts by empirical Bayes.

A host's rate of bad pages is shrunk towards that of its registered domain,
which is shrunk towards that of its suffix, and that towards the rate of all
labelled pages. Each level is beta-binomial: n pages of which k are bad, with
a Beta prior whose mean is the parent's posterior mean. One correlation for
each level says how alike the pages of a member are, and so how much the prior
counts (1 / correlation - 1 pages); it is estimated from all members of the
level by moments: the members' squared residuals beyond the binomial part.
A page is blocked if its host is bad beyond doubt: if the mean of the
posterior less ``z`` of its standard deviations is above ``bad_rate``. A host
without labels has its domain's or suffix's, by which it is then judged.

Hosts are counted before a shuffle, so that a host with a third of the pages
is one row for each task. Only blocked hosts go back to the pages: they are
sent to all tasks up to ``common.BROADCAST_IDS`` of them, else joined. All
expressions are native.

Null urls, and those without ``://``, have an empty host and path, no rule and
the verdict of the empty host, which is judged like any other. Null page_ids
and repeated rows stay, each with its verdict. Outcomes of a null url or a
null ``bad`` count nothing; repeated ones count each time. Empty tables give
empty ones; without outcomes every page is allowed that no rule blocks. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, kept, only

#: (verdict, host, path): a rule holds for the host and its subdomains and for paths that begin with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of several labels under which domains are registered; any other suffix is the last label.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")
BAD_RATE, Z = 0.5, 1.645

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of their url."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    after = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    rest = F.regexp_extract(after, r"^([^/?#]*)([^?#]*)", 2)
    return pages.withColumns({"host": F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER), "path": rest})


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (host, path) with the longest rule that fits, as host and path joined, and its verdict; null where none does. Rules are tried longest first, of equals the ASCII-least first."""
    name = said = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name, said = F.when(fits, host + path).otherwise(name), F.when(fits, verdict).otherwise(said)
    return pages.withColumns({"rule": name, "said": said})


def suffix(host: Column, suffixes=SUFFIXES) -> Column:
    """The public suffix of a host, by its last label or a listed suffix of several."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1)) if suffixes else F.substring_index(host, ".", -1)


def registered(host: Column, suffixes=SUFFIXES) -> Column:
    """The suffix and the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two) if suffixes else two


def _level(groups: DataFrame) -> DataFrame:
    """``groups`` (n, k, prior) with mean and weight of their Beta posteriors; the level's correlation, one number, is of all its groups."""
    noise = F.col("prior") * (1 - F.col("prior"))
    room = F.sum(F.col("n") * (F.col("n") - 1) * noise)
    alike = F.least(F.greatest(F.sum((F.col("k") - F.col("n") * F.col("prior")) ** 2 - F.col("n") * noise) / room, F.lit(0.001)), F.lit(0.999))
    prior_weight = 1 / groups.agg(F.when(room > 0, alike).otherwise(0.5)).first()[0] - 1
    mean = (F.col("prior") * prior_weight + F.col("k")) / (prior_weight + F.col("n"))
    return groups.withColumns({"mean": mean, "weight": prior_weight + F.col("n")})


def reputation(spark: SparkSession, outcomes: DataFrame, suffixes=SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posteriors (n, k, mean, weight) by host, by registered domain (name) and by suffix (name), of labelled outcomes (url, bad)."""
    d = only(outcomes, url="string", bad="int").filter("url is not null and bad is not null")
    hosts = with_parts(d).groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("bad") != 0).cast("long")).alias("k"))
    hosts = kept(spark, hosts.withColumns({"domain": registered(F.col("host"), suffixes), "suffix": suffix(F.col("host"), suffixes)}))
    domains = kept(spark, hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    ends = kept(spark, domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    n, k = ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    ends = _level(ends.withColumn("prior", F.lit((k + 1) / (n + 2))))
    domains = _level(domains.join(ends.select("suffix", F.col("mean").alias("prior")), "suffix"))
    hosts = _level(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"))
    return hosts, domains.withColumnRenamed("domain", "name"), ends.withColumnRenamed("suffix", "name")


def _sure(bad_rate: float, z: float) -> Column:
    """Whether the posterior's lower bound is above the rate."""
    return F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1)) > bad_rate


def blocked_hosts(spark: SparkSession, pages: DataFrame, outcomes: DataFrame, bad_rate: float = BAD_RATE, z: float = Z, suffixes=SUFFIXES) -> DataFrame:
    """host: those of ``pages`` (host) that the method blocks; a host without labels by its domain, then by its suffix."""
    hosts, domains, ends = reputation(spark, outcomes, suffixes)
    every = pages.select("host").distinct().withColumns({"domain": registered(F.col("host"), suffixes), "suffix": suffix(F.col("host"), suffixes)})
    verdict = lambda d, key, name: d.select(F.col(key), _sure(bad_rate, z).alias(name))
    d = every.join(verdict(hosts, "host", "_h"), "host", "left").join(verdict(domains.withColumnRenamed("name", "domain"), "domain", "_d"), "domain", "left")
    d = d.join(verdict(ends.withColumnRenamed("name", "suffix"), "suffix", "_s"), "suffix", "left")
    return d.filter(F.coalesce("_h", "_d", "_s", F.lit(False))).select("host")


def judged(spark: SparkSession, pages: DataFrame, outcomes: DataFrame, rules=RULES, bad_rate: float = BAD_RATE, z: float = Z, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url); ``outcomes``: url and bad (not 0) of labelled pages."""
    d = with_rule(with_parts(only(pages, page_id="long", url="string")), rules)
    blocked = kept(spark, blocked_hosts(spark, d, outcomes, bad_rate, z, suffixes)).withColumn("bad", F.lit(True))
    d = d.join(F.broadcast(blocked) if blocked.count() <= BROADCAST_IDS else blocked, "host", "left")
    verdict = F.coalesce("said", F.when(F.col("bad"), "block").otherwise("allow"))
    return d.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def allowed(spark: SparkSession, pages: DataFrame, outcomes: DataFrame, **options) -> DataFrame:
    """Rows of ``pages`` (url, ...) that are allowed, with all their columns."""
    d = with_rule(with_parts(pages.select(F.col("url"), F.struct(*pages.columns).alias("_row"))), options.pop("rules", RULES))
    blocked = kept(spark, blocked_hosts(spark, d, outcomes, **options)).withColumn("bad", F.lit(True))
    d = d.join(F.broadcast(blocked) if blocked.count() <= BROADCAST_IDS else blocked, "host", "left")
    return d.filter(F.coalesce(F.col("said") == "allow", F.col("bad").isNull())).select("_row.*")


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad of pages whose path ends in the number of a labelled document; bad is a document of low quality or toxic."""
    d = with_parts(only(pages, url="string")).select("url", F.regexp_extract("path", r"/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("long").alias("doc_id"))
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) != 0)).cast("int")
    marks = only(labels, doc_id="long", quality="int", toxic="int").filter("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return d.join(marks, "doc_id").select("url", "bad")
