"""URL filters: rules, then the reputation of the host by empirical Bayes. DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.common import cut, new_name

LIMIT = 0.5
Z = 1.645
WEAKEST, DEFAULT, STRONGEST = 1.0, 10.0, 1000.0
SCALE = 1_000_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both are empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The last two labels and the last one; an address in numbers is its own domain and suffix."""
    number = host.rlike(r"^[0-9.]+(:[0-9]*)?$|^\[")
    return F.when(number, host).otherwise(F.substring_index(host, ".", -2)), F.when(number, host).otherwise(F.substring_index(host, ".", -1))


def _first_fit(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of its text and its verdict; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(children: DataFrame) -> Column:
    """What a parent's rate weighs beside a child's own outcomes, in outcomes, by the method of moments.

    ``children`` has n, bad of every child and p_n, p_bad of its parent. Outcomes of one child are correlated by rho if
    children differ; the squared deviations of their rates exceed what single outcomes give by rho. Sums are of whole
    numbers, so their order doesn't matter.
    """
    rate, parent = F.col("bad") / F.col("n"), F.col("p_bad") / F.col("p_n")
    noise = parent * (1 - parent)
    whole = lambda c: F.coalesce(F.sum(F.round(c * SCALE).cast("decimal(28,0)")).cast("double"), F.lit(0.0))
    over, room = whole(F.col("n") * (rate - parent) * (rate - parent) - noise), whole(noise * (F.col("n") - 1))
    rho = F.when(room > 0, over / room)
    strength = F.when(rho.isNull(), DEFAULT).when(rho <= 1 / (STRONGEST + 1), STRONGEST).otherwise(F.greatest(F.lit(WEAKEST), 1 / rho - 1))
    return children.filter("n > 0").agg(strength.alias("strength")).scalar()


def reputations(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """Of labelled outcomes (host, bad: 1, 0 or null for none): host, n, bad, ``mean`` and ``bound`` of its bad share.

    Shares are shrunk from the top down: a suffix towards all outcomes, a registered domain towards its suffix, a host
    towards its domain; how strongly, each level tells by itself (:func:`_strength`). A host's share then has a beta
    distribution, and ``bound`` lies ``z`` of its standard deviations under its mean. A host without outcomes has its
    domain's mean with the spread of the prior alone. Hosts are added up before anything is joined; every level is
    the sum of the one below. Each level's sums are checkpointed, as several later steps read them.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    hosts = cut(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = cut(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = cut(domains.groupBy("suffix").agg(*sums))
    above = lambda df, key: df.select(*key, F.col("n").alias("p_n"), F.col("bad").alias("p_bad"))
    whole = suffixes.agg(*sums)
    suffixes = suffixes.withColumns({"p_n": whole.select("n").scalar(), "p_bad": whole.select("bad").scalar()})
    m_host = _strength(hosts.join(above(domains, ["domain", "suffix"]), ["domain", "suffix"]))
    m_domain = _strength(domains.join(above(suffixes, ["suffix"]), "suffix"))
    m_suffix = _strength(suffixes)

    def shrunk(prior: Column, strength: str) -> Column:
        return (F.col("bad") + F.col(strength) * prior) / (F.col("n") + F.col(strength))

    everywhere = F.when(F.col("p_n") > 0, F.col("p_bad") / F.col("p_n")).otherwise(0.5)
    suffixes = suffixes.withColumn("m", m_suffix).select("suffix", shrunk(everywhere, "m").alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").withColumn("m", m_domain).select("domain", "suffix", shrunk(F.col("suffix_mean"), "m").alias("domain_mean"))
    judged = hosts.join(domains, ["domain", "suffix"]).withColumn("m", m_host).withColumn("mean", shrunk(F.col("domain_mean"), "m"))
    spread = F.sqrt(F.greatest(F.col("mean") * (1 - F.col("mean")), F.lit(0.0)) / (F.col("n") + F.col("m") + 1))
    return judged.select("host", "n", "bad", "mean", (F.col("mean") - z * spread).alias("bound"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, bad: Column | None = None, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Allow or block every page: by the longest rule that fits its url, else by its host's reputation.

    A page is labelled where ``bad`` (1 or 0; a column over ``pages``) isn't null; by default the labels are what the
    rules say of the pages that they judge. A page that no rule judges is blocked if its host's ``bound`` is above
    ``limit``: nearly surely more than that share of its pages is bad. Registered domains are the last two labels of a
    host, suffixes the last one. Rules become one expression; give hundreds of them, not a list of millions.

    Returns id, ``host``, ``path``, ``rule`` (host and path of the rule, or null), ``verdict``, ``n_labelled``,
    ``mean``, ``bound``. Null urls and urls without ``://`` have an empty host and path, which is a host like any other.
    Null and repeated ids keep all their rows. Without labels all shares are 0.5 and nothing is blocked by them. An empty
    table gives an empty result; other columns are ignored. A host with very many pages is added up before its rows are
    moved, and the join that brings its reputation back is one that Spark splits.
    """
    label = new_name(pages, "label")
    rows = pages.withColumn(label, F.lit(None).cast("int") if bad is None else bad.cast("int"))
    host, path = host_and_path(F.col(url_col))
    rows = rows.select(F.col(id_col).alias("id"), F.col(label).alias("bad"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", _first_fit(rules, F.col("host"), F.col("path")))
    if bad is None:
        rows = rows.withColumn("bad", (F.col("found.verdict") == "block").cast("int"))
    known = reputations(rows.select("host", "bad")).select("host", F.col("n").alias("n_labelled"), "mean", "bound")
    verdict = F.coalesce("found.verdict", F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return rows.join(known, "host").select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "n_labelled", "mean", "bound")
