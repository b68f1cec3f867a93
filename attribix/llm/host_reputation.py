"""URL filters: explicit host and path rules, and a reputation of hosts where no rule fits.

The reputation is the rate of good outcomes among the labelled pages of a host, whatever its port and user name, shrunk
along host, registered domain, suffix and the whole table. The suffix is the last label, or the last two where these are
listed or at least ``SUFFIX_NAMES`` distinct names stand directly below them in the table; an address of numbers is its
own domain and suffix. In the chain each level's posterior mean is the centre of the beta prior of the level below, and the
prior's weight comes from the spread of the rates at that level. A page is blocked if the upper posterior bound of its
host is below ``MIN_GOOD``. Hosts without labelled pages have the prior of their domain, domains that of their suffix.

Everything is DataFrame operations. Outcomes are summed per page id, then per host, before any join; a busy host is one
row on the side it is joined from, and the page side can be split.

Defined results: a null url, or one without ``://``, has empty host and path; no rule fits it, and it is judged like
the pages of any host. Pages with a null id, or without outcomes, add nothing to the counts. Outcomes that are null are
none; several of one page count one by one. Repeated pages each get a row, and each counts. With no outcomes at all
every page without a rule is allowed. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: (verdict, host and path a rule fits).
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
)
MIN_GOOD = 0.5
Z = 2.0
WEIGHT_MIN, WEIGHT_MAX = 2.0, 1_000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered; more can be given, and others are learned.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au",
    "org.au", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "com.br", "gov.br", "net.br",
    "org.br", "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.za", "co.za", "gov.za", "org.za", "com.cn", "gov.cn", "net.cn", "org.cn",
    "com.mx", "gob.mx", "com.tr", "gov.tr", "com.ar", "gob.ar", "co.kr", "or.kr", "com.tw", "com.hk", "com.sg", "co.il", "com.pl", "com.ua",
)
#: Distinct names directly below two labels from which these count as a suffix.
SUFFIX_NAMES = 20
ADDRESS = r"\A[0-9]+(\.[0-9]+){3}\z"


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.regexp_extract(url, r"(?s)://(.*)$", 1), "/", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1)
    return rest


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Longest rule that fits, as a struct of verdict and rule; of equal length the one with the longer host."""
    order = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/")))
    found = None
    for verdict, rule in order:
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def name_of(host: Column) -> Column:
    """The host without user name, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.?(:[0-9]*)?\z", "")


def with_domains(hosts: DataFrame, suffixes=TWO_LABEL_SUFFIXES, names: int = SUFFIX_NAMES) -> DataFrame:
    """``hosts`` (one row per name) with the registered domain and the suffix of each name."""
    two, three = F.substring_index("name", ".", -2), F.substring_index("name", ".", -3)
    below = F.substring_index(three, ".", 1)
    learned = hosts.where((three != two) & ~F.col("name").rlike(ADDRESS)).groupBy(two.alias("__two")).agg(
        F.countDistinct(below).alias("c")).where(F.col("c") >= names).select("__two")
    wide = F.col("__two").isNotNull() | two.isin(*suffixes)
    marked = hosts.join(checkpointed(learned), two == F.col("__two"), "left").withColumn("__wide", wide)
    number = F.col("name").rlike(ADDRESS)
    return marked.withColumn("domain", F.when(number, F.col("name")).when(F.col("__wide"), three).otherwise(two)).withColumn(
        "suffix", F.when(number, F.col("name")).when(F.col("__wide"), two).otherwise(F.substring_index("name", ".", -1))).drop("__two", "__wide")


def located(pages: DataFrame) -> DataFrame:
    """page_id, host, path, and name (host without port and user name) of every page."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("name", name_of(F.col("host")))


def _level(rows: DataFrame, key: str) -> DataFrame:
    """Counts of one level and the centre above it to posterior mean, weight and upper bound.

    rows: key, n, good, centre. The weight is that of a beta distribution with the mean and variance of the rates of
    all keys with outcomes, each key counted once.
    """
    rate = F.when(F.col("n") > 0, F.col("good") / F.col("n"))
    m, v = "__mv.m", "__mv.v"
    moments = rows.agg(F.struct(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).alias("mv")).scalar()
    weight = (
        F.when(F.col(v).isNull(), F.lit(WEIGHT_MIN)).when(F.col(v) <= 0, F.lit(WEIGHT_MAX))
        .otherwise(F.least(F.greatest(F.col(m) * (1 - F.col(m)) / F.col(v) - 1, F.lit(WEIGHT_MIN)), F.lit(WEIGHT_MAX)))
    )
    return (
        rows.withColumn("__mv", moments).withColumn("weight", weight)
        .withColumn("mean", (F.col("good") + F.col("weight") * F.col("centre")) / (F.col("n") + F.col("weight")))
        .withColumn("upper", F.col("mean") + Z * F.sqrt(
            F.greatest(F.col("mean") * (1 - F.col("mean")), F.lit(0.0)) / (F.col("n") + F.col("weight") + 1)))
        .select(key, "n", "good", "mean", "upper")
    )


def reputation(found: DataFrame, outcomes: DataFrame, page: str, good: str, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """name, n, good, mean, upper of every name of ``found`` (page_id, name), from outcomes (page, good 0 or 1)."""
    label = outcomes.where(F.col(good).isNotNull()).groupBy(F.col(page).cast("long").alias("__page")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(good).cast("long")).alias("__good"))
    hosts = found.join(label, F.col("page_id") == F.col("__page"), "left").groupBy("name").agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.coalesce(F.sum("__good"), F.lit(0)).alias("good"))
    hosts = checkpointed(with_domains(checkpointed(hosts), suffixes))
    domains = checkpointed(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = suffixes.agg(F.coalesce(F.sum("good") / F.when(F.sum("n") > 0, F.sum("n")), F.lit(1.0)).alias("c")).scalar()
    suffixes = checkpointed(_level(suffixes.withColumn("centre", overall), "suffix").select(
        F.col("suffix").alias("__s"), F.col("mean").alias("centre")))
    domains = checkpointed(_level(
        domains.join(suffixes, F.col("suffix") == F.col("__s")), "domain").select(
        F.col("domain").alias("__d"), F.col("mean").alias("centre")))
    return _level(hosts.join(domains, F.col("domain") == F.col("__d")), "name")


def judged(
    pages: DataFrame, outcomes: DataFrame, page: str = "doc_id", good: str = "quality", rules=RULES, min_good: float = MIN_GOOD,
    suffixes=TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and mean and upper bound of the host, for every page."""
    found = located(pages)
    hosts = checkpointed(reputation(found, outcomes, page, good, suffixes).select(
        F.col("name").alias("__name"), F.col("mean").alias("host_mean"), F.col("upper").alias("host_upper")))
    hit = found.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("host_upper") < min_good, "block").otherwise("allow")
    return hit.join(hosts, F.col("name") == F.col("__name")).select(
        "page_id", "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "host_mean", "host_upper")
