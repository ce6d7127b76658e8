"""Scraping rule sets and per-page rule resolution.

Rules are configuration (one entry per site plus one generic entry), so they
are a small driver-side object; the per-page assignment is a broadcast join
of the pages with a (domain -> rule_id) table whose size is checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENERIC_KEY = "generic_list_rule"
SLOTS = ["article_list_css", "title_css", "link_css", "date_css", "content_css"]
# Built-in selector defaults when neither rule sets a slot.
SLOT_DEFAULTS = {
    "article_list_css": "article",
    "title_css": "h2 a, h3 a",
    "link_css": "a",
    "date_css": ".date, time",
    "content_css": ".content, .body",
}
RULE_COLUMNS = ["domain", "base_url", "news_index"] + SLOTS + ["date_format"]
RULES_SCHEMA = T.StructType([T.StructField(c, T.StringType(), c != "domain") for c in RULE_COLUMNS])
# Largest rule table we broadcast; rule tables are configuration, far smaller.
MAX_BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class ResolvedRule:
    rule_id: int
    domain: str | None
    base_url: str
    date_format: str | None
    article_list_css: str
    title_css: str
    link_css: str
    date_css: str
    content_css: str

    def slot(self, name: str) -> str:
        return getattr(self, name)


class RuleSet:
    """A rule configuration: ``{"generic_list_rule": {...}, "<domain>": {...}}``."""

    def __init__(self, rules: dict | None):
        self.raw = dict(rules or {})
        self.generic = dict(self.raw.get(GENERIC_KEY) or {})
        # a site rule is used for extraction only when it names a base_url
        self.sites = {d: dict(r) for d, r in self.raw.items()
                      if d != GENERIC_KEY and isinstance(r, dict) and "base_url" in r}

    @classmethod
    def from_rows(cls, rows: DataFrame) -> "RuleSet":
        """Rules from a table with ``RULES_SCHEMA``'s columns, one row per domain (a null is an absent key).  Later rows of a domain
        (in the order of their columns) win.  Rules are configuration: more than ``MAX_BROADCAST_RULES`` rows are an error."""
        found = rows.select(*[F.col(c).cast("string") for c in RULE_COLUMNS]).orderBy(*RULE_COLUMNS).limit(MAX_BROADCAST_RULES + 1).collect()
        if len(found) > MAX_BROADCAST_RULES:
            raise ValueError(f"more than {MAX_BROADCAST_RULES} rules")
        return cls({r["domain"]: {c: r[c] for c in RULE_COLUMNS[1:] if r[c] is not None} for r in found})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "RuleSet":
        """Rules from files that Spark reads: ``.yaml`` / ``.yml`` (a map from domains to rules), else JSON rows with ``RULES_SCHEMA``."""
        if not path.endswith((".yaml", ".yml")):
            return cls.from_rows(spark.read.schema(RULES_SCHEMA).json(path))
        try:
            import yaml  # optional dependency
        except ImportError as e:  # pragma: no cover
            raise ImportError("reading YAML rules needs PyYAML; use JSON rows instead") from e
        merged: dict = {}
        for row in spark.read.text(path, wholetext=True).collect():        # configuration files
            merged |= yaml.safe_load(row["value"]) or {}
        return cls(merged)

    def _generic_slot(self, name: str) -> str:
        return self.generic.get(name, SLOT_DEFAULTS[name])

    def resolved(self) -> list[ResolvedRule]:
        """rule 0 = generic only; rules 1.. = site rules with a base_url.
        Each slot: site value if non-empty, else generic value (even empty),
        else the default."""
        out = [ResolvedRule(0, None, "", None, *[self._generic_slot(s) for s in SLOTS])]
        for i, (dom, r) in enumerate(sorted(self.sites.items()), 1):
            slots = [(r.get(s) or self._generic_slot(s)) for s in SLOTS]
            out.append(ResolvedRule(i, dom, r.get("base_url", "") or "", r.get("date_format"), *slots))
        return out

    def coverage_slots(self, domain: str) -> list[tuple[str, str, str]]:
        """(rule set, slot, selector) for the site rule (no base_url
        needed; present keys win even when empty) and the generic rule."""
        out = []
        site = self.raw.get(domain) if domain != GENERIC_KEY else None
        if isinstance(site, dict) and site:
            for s in SLOTS:
                out.append(("site", s, site.get(s, self._generic_slot(s)) or ""))
        for s in SLOTS:
            out.append(("generic", s, self._generic_slot(s) or ""))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = []
        for dom, r in self.raw.items():
            if not isinstance(r, dict):
                continue
            rows.append(tuple([dom] + [None if r.get(c) is None else str(r.get(c)) for c in RULE_COLUMNS[1:]]))
        return spark.createDataFrame(rows, RULES_SCHEMA)

    def domain_map(self, spark: SparkSession) -> DataFrame:
        rows = [(r.domain, r.rule_id) for r in self.resolved() if r.domain is not None]
        schema = "domain string, rule_id int"
        return spark.createDataFrame(rows, schema)

    def resolved_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.rule_id, r.domain, r.base_url, r.date_format, *[r.slot(s) for s in SLOTS])
                for r in self.resolved()]
        schema = ("rule_id int, domain string, base_url string, date_format string, "
                  + ", ".join(f"{s} string" for s in SLOTS))
        return spark.createDataFrame(rows, schema)

    def date_formats(self) -> list[str]:
        return sorted({r.date_format for r in self.resolved() if r.date_format})


def broadcast_if_small(df: DataFrame, n_rows: int, limit: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Broadcast a configuration table only under a checked row bound."""
    return F.broadcast(df) if n_rows <= limit else df


def assign_rules(pages: DataFrame, rules: RuleSet, domain_col: str = "domain") -> DataFrame:
    """Pages with a ``domain`` column -> plus ``rule_id`` (0 = generic)."""
    spark = pages.sparkSession
    dm = rules.domain_map(spark)
    n = len(rules.sites)
    joined = pages.join(broadcast_if_small(dm, n), pages[domain_col] == dm["domain"], "left") \
        .drop(dm["domain"])
    return joined.withColumn("rule_id", F.coalesce(F.col("rule_id"), F.lit(0)))


def resolve_rules_for_domains(domains: DataFrame, rules: RuleSet) -> DataFrame:
    """S2 as a table: one row per input domain with every resolved slot."""
    spark = domains.sparkSession
    res = rules.resolved_frame(spark)
    with_id = assign_rules(domains, rules)
    return with_id.join(broadcast_if_small(res.drop("domain"), len(rules.sites) + 1), "rule_id", "left")
