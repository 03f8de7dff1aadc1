"""URL verdicts: stated rules first, else an empirical-Bayes reputation of the host. DataFrame functions only.

Labelled pages give each host good and all outcomes. Their rate is shrunk through beta-binomial priors, from
the host to its registered domain, to its public suffix, to all pages: at each level the prior's mean is the
posterior mean one level up, and its strength comes from how much the children's rates vary beyond chance
(moments over all children). A host is blocked if its posterior rate is below the least rate with the chosen chance, which is
to say that the beta posterior's upper quantile is below it. A host's name for the hierarchy is its authority without user,
port and final dots; an address is its own domain, and all addresses have one suffix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.shared import materialise, shared_folder

#: Rule to verdict. Fixed values of the registered query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A public suffix: a last label, or a country's second level below which names are registered.
SUFFIX = "(?:(?:ac|co|com|edu|gov|net|ne|or|org)[.][a-z][a-z]|[^.]+)$"
DOMAIN = "(?:[^.]+[.])?" + SUFFIX
ADDRESS = "^([0-9]+[.]){3}[0-9]+$|^\\[.*\\]$"


@dataclass(frozen=True)
class Reputation:
    #: Hosts whose posterior rate of good pages is surely below this are blocked.
    least_rate: float = 0.5
    #: The chance with which a rate must be below it, and the normal quantile of that.
    chance: float = 0.95
    z: float = 1.6448536269514722
    #: A posterior of more outcomes than this is taken as normal; at a rate of a half that moves the chance by less than 1e-4.
    normal_from: float = 10_000.0
    #: Steps of the continued fraction, which needs about the root of the outcomes.
    steps: int = 200
    #: The share of variance between children that a level may have, which bounds its prior's strength.
    least_share: float = 0.001
    most_share: float = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits; a rule is a host, a slash and the beginning of a path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def _share(children: DataFrame, conf: Reputation) -> float:
    """The share of variance between children of a level: moments of n, k around the parent's rate p, over all children."""
    even = F.col("p") * (1 - F.col("p"))
    r = children.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("p"), 2)).alias("q"),
        F.sum(F.col("n") * even).alias("a"),
        F.sum(F.col("n") * (F.col("n") - 1) * even).alias("b"),
    ).first()
    return min(conf.most_share, max(conf.least_share, (r.q - r.a) / r.b)) if r.b else conf.least_share


def name_of(host: Column) -> Column:
    """A host without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")


def _log_gamma(z: Column) -> Column:
    """Stirling's series at z + 7, and back by the recurrence; right to 1e-10 for z > 0."""
    y = z + 7
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    below = z
    for k in range(1, 7):
        below = below * (z + k)
    return series - F.log(below)


def beta_below(a: Column, b: Column, x: float, steps: int) -> Column:
    """P(rate < x) for a rate of Beta(a, b): the regularised incomplete beta function by its continued fraction, in column functions."""
    far = F.lit(x) >= (a + 1) / (a + b + 2)  # there the fraction of the other tail converges sooner
    p, q, y = F.when(far, b).otherwise(a), F.when(far, a).otherwise(b), F.when(far, 1 - x).otherwise(F.lit(x))
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    # p, q and y ride along, so that each is worked out once.
    begin = F.struct(p.alias("p"), q.alias("q"), y.alias("y"), F.lit(1.0).alias("c"), (1 / tiny(1 - (p + q) * y / (p + 1))).alias("d"), (1 / tiny(1 - (p + q) * y / (p + 1))).alias("h"))

    def step(s: Column, m: Column) -> Column:
        p, q, y, c, d, h = (s[n] for n in "pqycdh")
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d1, c1 = 1 / tiny(1 + even * d), tiny(1 + even / c)
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d2, c2 = 1 / tiny(1 + odd * d1), tiny(1 + odd / c1)
        return F.struct(p.alias("p"), q.alias("q"), y.alias("y"), c2.alias("c"), d2.alias("d"), (h * d1 * c1 * d2 * c2).alias("h"))

    whole = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda m: m.cast("double")), begin, step)["h"]
    front = F.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * F.log(y) + q * F.log(1 - y))
    tail = front * whole / p
    return F.when(far, 1 - tail).otherwise(tail)


def host_reputation(pages: DataFrame, outcomes: DataFrame, conf: Reputation, folder: str) -> DataFrame:
    """name, n, k, mean, blocked for each name of pages (page_id, name). outcomes: page_id, good (0 or 1), a row a page."""
    hosts = pages.join(outcomes, "page_id", "left").groupBy("name").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k"))
    address = F.col("name").rlike(ADDRESS)
    hosts = hosts.withColumns({"domain": F.when(address, F.col("name")).otherwise(F.regexp_extract("name", DOMAIN, 0)), "suffix": F.when(address, "[]").otherwise(F.regexp_extract("name", SUFFIX, 0))})
    hosts = materialise(hosts, f"{folder}/hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), f"{folder}/domains")
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), f"{folder}/suffixes")
    every = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    mean = (every.k + 1) / (every.n + 2)

    def up(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        return children.join(parents.select(key, F.col("n").alias("pn"), F.col("k").alias("pk")), key).filter("n > 0").withColumn("p", F.col("pk") / F.col("pn"))

    strength = [(1 - s) / s for s in (_share(suffixes.filter("n > 0").withColumn("p", F.lit(every.k / max(1, every.n))), conf), _share(up(domains, suffixes, "suffix"), conf), _share(up(hosts, domains, "domain"), conf))]

    def below(s: float, prior: Column) -> Column:
        return (F.lit(s) * prior + F.col("k")) / (F.lit(s) + F.col("n"))

    suffixes = suffixes.select("suffix", below(strength[0], F.lit(mean)).alias("above"))
    domains = materialise(domains.join(suffixes, "suffix").select("domain", below(strength[1], F.col("above")).alias("above")), f"{folder}/domain-means")
    own = below(strength[2], F.col("above"))
    size = F.lit(strength[2]) + F.col("n")
    known = hosts.join(domains, "domain").select("name", "n", "k", own.alias("mean"), size.alias("size"))
    normal = F.col("mean") + conf.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1)) < conf.least_rate
    exact = beta_below(F.col("mean") * F.col("size"), (1 - F.col("mean")) * F.col("size"), conf.least_rate, conf.steps) > conf.chance
    return known.select("name", "n", "k", "mean", F.when(F.col("size") > conf.normal_from, normal).otherwise(exact).alias("blocked"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str] = RULES, conf: Reputation = Reputation()) -> DataFrame:  # noqa: B006, B008
    """page_id, host, path, rule, verdict for each row of pages (page_id, url).

    A null url, or one without ://, has an empty host and path and is judged as the host ''. Hosts that differ by user, port or final dots are judged as one. Repeated rows are each
    judged. A page with several outcomes counts once, as good if any is; null outcomes and pages don't count.
    Without outcomes every host has the prior's mean of a half and is allowed. Other columns don't matter.
    """
    spark: SparkSession = pages.sparkSession
    folder = shared_folder(spark)
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("name", name_of(F.col("host")))
    outcomes = outcomes.filter("page_id is not null and good in (0, 1)").groupBy("page_id").agg(F.max("good").cast("long").alias("good"))
    hosts = host_reputation(pages.select("page_id", "name"), outcomes, conf, folder)
    hosts = hosts.select("name", F.when(F.col("blocked"), "block").otherwise("allow").alias("by_host"))
    rule = rule_of(F.col("host"), F.col("path"), list(rules))
    verdict = F.col("by_host")
    for r, v in rules.items():
        verdict = F.when(F.col("rule") == r, v).otherwise(verdict)
    return pages.join(hosts, "name", "left").select("page_id", "host", "path", rule.alias("rule"), "by_host").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels.quality of the document with the page's number is the page's outcome."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), labels)


OP2_SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_CAPITALS}', '{_SMALL}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS name
  FROM pages),
o AS (SELECT doc_id AS page_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
h AS (SELECT name, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name ELSE regexp_extract(name, '{DOMAIN}', 0) END AS domain,
             CASE WHEN regexp_matches(name, '{ADDRESS}') THEN '[]' ELSE regexp_extract(name, '{SUFFIX}', 0) END AS suffix,
             count(good) AS n, coalesce(sum(good), 0)::BIGINT AS k FROM p LEFT JOIN o USING (page_id) GROUP BY name),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
a AS (SELECT sum(n) AS n, sum(k) AS k FROM s),
m AS (
  SELECT 1 AS level, s.n, s.k, a.k / a.n AS p FROM s, a WHERE s.n > 0
  UNION ALL SELECT 2, d.n, d.k, s.k / s.n FROM d JOIN s USING (suffix) WHERE d.n > 0
  UNION ALL SELECT 3, h.n, h.k, d.k / d.n FROM h JOIN d USING (domain) WHERE h.n > 0),
r AS (SELECT level, least(0.5, greatest(0.001, coalesce((sum(pow(k - n * p, 2)) - sum(n * p * (1 - p))) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.001))) AS share FROM m GROUP BY level),
t AS (SELECT coalesce(max(CASE WHEN level = 1 THEN (1 - share) / share END), 999.0) AS s1, coalesce(max(CASE WHEN level = 2 THEN (1 - share) / share END), 999.0) AS s2,
             coalesce(max(CASE WHEN level = 3 THEN (1 - share) / share END), 999.0) AS s3 FROM r),
sm AS (SELECT suffix, (s1 * (a.k + 1) / (a.n + 2) + s.k) / (s1 + s.n) AS above FROM s, a, t),
dm AS (SELECT domain, (s2 * above + d.k) / (s2 + d.n) AS above FROM d JOIN sm USING (suffix), t),
hm AS (SELECT name, s3 + h.n AS size, (s3 * above + h.k) / (s3 + h.n) AS mean FROM h JOIN dm USING (domain), t),
ab AS (SELECT name, mean, size, mean * size AS a, (1 - mean) * size AS b, 0.5 >= (mean * size + 1) / (size + 2) AS far FROM hm),
pq AS (SELECT name, mean, size, far, CASE WHEN far THEN b ELSE a END AS p, CASE WHEN far THEN a ELSE b END AS q FROM ab),
f AS (  -- the continued fraction of the incomplete beta function at a half
  SELECT name, 0 AS m, p, q, 1.0::DOUBLE AS c, 1 / (1 - (p + q) * 0.5 / (p + 1)) AS d, 1 / (1 - (p + q) * 0.5 / (p + 1)) AS h FROM pq
  UNION ALL
  SELECT name, m + 1, p, q, 1 + odd / (1 + even / c), 1 / (1 + odd / (1 + even * d)), h * (1 + even / c) / (1 + even * d) * (1 + odd / (1 + even / c)) / (1 + odd / (1 + even * d))
  FROM (SELECT *, (m + 1) * (q - m - 1) * 0.5 / ((p + 2 * m + 1) * (p + 2 * m + 2)) AS even, -(p + m + 1) * (p + q + m + 1) * 0.5 / ((p + 2 * m + 2) * (p + 2 * m + 3)) AS odd FROM f WHERE m < 200)),
w AS (SELECT pq.name, mean, size, far, exp(lgamma(pq.p + pq.q) - lgamma(pq.p) - lgamma(pq.q) + (pq.p + pq.q) * ln(0.5::DOUBLE)) * h / pq.p AS tail FROM pq JOIN f ON f.name = pq.name AND m = 200),
v AS (SELECT name, CASE WHEN CASE WHEN size > 10000 THEN mean + {Reputation.z} * sqrt(mean * (1 - mean) / (size + 1)) < 0.5
                                  ELSE CASE WHEN far THEN 1 - tail ELSE tail END > 0.95 END THEN 'block' ELSE 'allow' END AS by_host FROM w),
u AS (
  SELECT page_id, host, path, name,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' ELSE by_host END AS verdict
FROM u LEFT JOIN v USING (name)
"""
