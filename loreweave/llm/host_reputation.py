"""URL filtering: explicit rules first, else empirical-Bayes reputations of hosts.

Labelled outcomes of pages are counted by host. A public suffix's rate is shrunk to the overall
rate, a registered domain's to its suffix's, a host's to its domain's, each through a beta prior
whose strength is fitted to the spread at that level by the method of moments. A page is blocked
when the upper posterior bound of its host's rate of good pages lies below the floor, so a host
needs evidence to be blocked; a host without labels has its domain's rate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS, Workspace, read_table

#: Second labels that make a suffix of two labels with a country's label of two letters (fixed values): public registries' usual branches.
BRANCHES = "ac co com edu gob gov go gv mil ne net nom or org".split()
FLOOR = 0.5
BOUND_Z = 1.6448536269514722
WEAKEST, STRONGEST = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(rest, F.lit(""))


def site_of(host: Column) -> Column:
    """A host without user, port and closing dots: what a reputation belongs to."""
    return F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), r"\.*(?::[0-9]*)?$", "")


def _labels(site: Column, suffixes: tuple[str, ...]) -> Column:
    """Labels of a site's suffix: two for a branch of a country or a suffix that is given, else one; a number or literal address is one label."""
    two = F.substring_index(site, ".", -2)
    wide = two.rlike(rf"^(?:{'|'.join(BRANCHES)})\.[a-z][a-z]$")
    return F.when(wide | two.isin(*suffixes) if suffixes else wide, 2).otherwise(1)


def _is_address(site: Column) -> Column:
    return site.rlike(r"^[0-9.]+$|^\[")


def domain_of(site: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The registered domain: a label more than the suffix; a site without dots, and an address, is its own."""
    return F.when(_is_address(site), site).when(_labels(site, suffixes) == 2, F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def suffix_of(site: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The public suffix; addresses have one in common, which is empty."""
    return F.when(_is_address(site), F.lit("")).when(_labels(site, suffixes) == 2, F.substring_index(site, ".", -2)).otherwise(F.substring_index(site, ".", -1))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. Rules are parameters, tried longest first."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _level(counts: DataFrame, key: str, parents: DataFrame | None, up: str | None) -> DataFrame:
    """Posterior of each group: key, a, b, with the prior's mean from its parent and a strength fitted to all groups."""
    spark_mean = F.coalesce(F.expr("sum(k) / nullif(sum(n), 0)"), F.lit(0.5))
    if parents is None:
        overall = counts.agg(F.least(F.greatest(spark_mean, F.lit(0.001)), F.lit(0.999)).alias("m"))  # one row
        base = counts.join(F.broadcast(overall))
    else:
        base = counts.join(parents.select(F.col(up).alias("_up"), (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), F.col(up) == F.col("_up"))
    v = F.col("m") * (1 - F.col("m"))
    spread = F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("m")) * (F.col("k") / F.col("n") - F.col("m"))) - F.sum(v)
    rho = spread / F.nullif(F.sum(v * (F.col("n") - 1)), F.lit(0.0))
    fit = base.agg(rho.alias("rho")).select(F.when(F.col("rho") > 0, F.least(F.greatest(1 / F.col("rho") - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST)).alias("s"))  # one row
    return base.join(F.broadcast(fit)).select(*counts.columns, (F.col("k") + F.col("s") * F.col("m")).alias("a"), (F.col("n") - F.col("k") + F.col("s") * (1 - F.col("m"))).alias("b"), "s")


def reputations(outcomes: DataFrame, ws: Workspace, suffixes: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Beta posteriors (a, b) by host, domain and suffix of outcomes(host, good 0/1); null outcomes are no evidence.

    Each level is written before the next one reads it: it is read for its own strength and for the level below.
    """
    hosts = outcomes.filter("good is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("k"))
    hosts = ws.write(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)), "hosts")
    domains = ws.write(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = ws.write(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    s = ws.write(_level(suffixes, "suffix", None, None), "suffix-posteriors")
    d = ws.write(_level(domains, "domain", s, "suffix"), "domain-posteriors")
    return {"suffix": s, "domain": d, "host": ws.write(_level(hosts, "host", d, "domain"), "host-posteriors")}


def upper_bound(a: Column, b: Column, z: float = BOUND_Z) -> Column:
    mean = a / (a + b)
    return mean + z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, floor: float = FLOOR, broadcast_rows: int = BROADCAST_ROWS, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Adds host, path, rule, bound and verdict to pages(url, ...); clashing columns are replaced.

    A host's user, port and closing dots stay in host and path and have no bearing on its reputation. suffixes are
    public suffixes of two labels besides the branches of countries, as a user's own list has them.
    outcomes(url, good): 1 for a good page, 0 for a bad one, null for none. A url that is null or has no
    `://` has an empty host and path and is judged like any host. Unknown hosts fall back to their domain,
    then their suffix, and are allowed when nothing is known of either; a bound at the floor is allowed.
    Every row is judged for itself, so repeated rows stay as often as they occur; an empty table gives no
    rows. Judged hosts are broadcast if they are at most broadcast_rows. Beyond that only the hosts of at
    least a thousandth of all pages are, of which there are at most a thousand, and the pages of the others,
    none of them hot, meet theirs by a shuffle.
    """
    spark, ws = pages.sparkSession, Workspace(pages.sparkSession)
    known = reputations(outcomes.select(site_of(host_of(F.col("url"))).alias("host"), F.col("good")), ws, suffixes)
    hosts = pages.select(site_of(host_of(F.col("url"))).alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    hosts = ws.write(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)), "page-hosts")
    judged = hosts
    for level, post in known.items():
        prior = post.select(F.col(level).alias("_k"), F.col("a").alias(f"a_{level}"), F.col("b").alias(f"b_{level}"), F.col("s").alias(f"s_{level}"))
        judged = judged.join(prior, F.col(level) == F.col("_k"), "left").drop("_k")

    def shrunk(level: str) -> Column:  # a child without labels: its parent's mean at the strength of that parent's own prior
        mean = F.col(f"a_{level}") / (F.col(f"a_{level}") + F.col(f"b_{level}"))
        return upper_bound(mean * F.col(f"s_{level}"), (1 - mean) * F.col(f"s_{level}"))

    bound = F.coalesce(upper_bound(F.col("a_host"), F.col("b_host")), shrunk("domain"), shrunk("suffix"), F.lit(1.0))
    judged = ws.write(judged.select(F.col("host").alias("_h"), bound.alias("bound"), "pages"), "judged")
    base = pages.drop("bound").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("_site", site_of(F.col("host")))
    n, total = judged.agg(F.count("*"), F.sum("pages")).first()
    narrow = judged.drop("pages")
    if n <= broadcast_rows:
        out = base.join(F.broadcast(narrow), F.col("_site") == F.col("_h"))
    else:
        hot = F.broadcast(judged.filter(F.col("pages") * 1000 >= total).drop("pages"))
        out = base.join(hot, F.col("_site") == F.col("_h"))
        cold = base.join(hot, F.col("_site") == F.col("_h"), "left_anti").join(narrow.hint("merge"), F.col("_site") == F.col("_h"))
        out = out.unionByName(cold)
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return out.drop("_h", "_site").withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, F.when(F.col("bound") < floor, "block").otherwise("allow")))


def op9_host_reputation(spark, sf_dir: str) -> DataFrame:
    """Every page; its labelled outcome is the quality and toxicity that labels holds under its page_id.

    bound is the posterior bound of the page's host, which decides where no rule does, to six digits. A
    null page_id has no label; a page_id in several rows, of pages or of labels, counts each pair as an
    outcome. Null urls, ties and an empty table are as filter_urls has them.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("good"))
    outcomes = pages.join(labels, F.col("page_id") == F.col("_id")).select("url", "good")
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict", F.round("bound", 6).alias("bound"))


OP9_SQL = """
WITH q AS (
  SELECT page_id,
    coalesce(CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
    coalesce(CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
p AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\\.*(?::[0-9]*)?$', '') AS site FROM q),
l AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS good FROM labels),
h0 AS (SELECT site AS host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS k FROM p JOIN l ON page_id = doc_id WHERE good IS NOT NULL GROUP BY site),
names AS (SELECT host, string_split(host, '.') AS parts FROM (SELECT DISTINCT site AS host FROM p)),
wide AS (SELECT host, parts, regexp_matches(host, '^[0-9.]+$|^\\[') AS ip, regexp_matches(array_to_string(parts[-2:], '.'), '^(?:ac|co|com|edu|gob|gov|go|gv|mil|ne|net|nom|or|org)\\.[a-z][a-z]$') AS w FROM names),
named AS (SELECT host, CASE WHEN ip THEN host ELSE array_to_string(CASE WHEN w THEN parts[-3:] ELSE parts[-2:] END, '.') END AS domain, CASE WHEN ip THEN '' ELSE array_to_string(CASE WHEN w THEN parts[-2:] ELSE parts[-1:] END, '.') END AS suffix FROM wide),
h AS (SELECT h0.*, domain, suffix FROM h0 JOIN named USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
sm AS (SELECT s.*, (SELECT least(greatest(coalesce(sum(k) / nullif(sum(n), 0), 0.5), 0.001), 0.999) FROM s) AS m FROM s),
sf AS (SELECT (sum(n * (k / n - m) * (k / n - m)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0) AS rho FROM sm),
sp AS (SELECT suffix, st, k + st * m AS a, n - k + st * (1 - m) AS b FROM sm, (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1000.0) ELSE 1000.0 END AS st FROM sf)),
dm AS (SELECT d.*, a / (a + b) AS m FROM d JOIN sp USING (suffix)),
df AS (SELECT (sum(n * (k / n - m) * (k / n - m)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0) AS rho FROM dm),
dp AS (SELECT domain, st, k + st * m AS a, n - k + st * (1 - m) AS b FROM dm, (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1000.0) ELSE 1000.0 END AS st FROM df)),
hm AS (SELECT h.*, a / (a + b) AS m FROM h JOIN dp USING (domain)),
hf AS (SELECT (sum(n * (k / n - m) * (k / n - m)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0) AS rho FROM hm),
hp AS (SELECT host, k + st * m AS a, n - k + st * (1 - m) AS b FROM hm, (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1000.0) ELSE 1000.0 END AS st FROM hf)),
j AS (
  SELECT named.host, coalesce(
    hp.a / (hp.a + hp.b) + 1.6448536269514722 * sqrt(hp.a / (hp.a + hp.b) * (1 - hp.a / (hp.a + hp.b)) / (hp.a + hp.b + 1)),
    dp.a / (dp.a + dp.b) + 1.6448536269514722 * sqrt(dp.a / (dp.a + dp.b) * (1 - dp.a / (dp.a + dp.b)) / (dp.st + 1)),
    sp.a / (sp.a + sp.b) + 1.6448536269514722 * sqrt(sp.a / (sp.a + sp.b) * (1 - sp.a / (sp.a + sp.b)) / (sp.st + 1)), 1.0) AS bound
  FROM named LEFT JOIN hp USING (host) LEFT JOIN dp USING (domain) LEFT JOIN sp USING (suffix)),
r AS (
  SELECT page_id, host, path, site, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p)
SELECT page_id, r.host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound < 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(bound, 6) AS bound
FROM r JOIN j ON j.host = r.site
"""
