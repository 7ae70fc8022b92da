"""URL filter: rules of hosts and paths, and gradient-boosted trees on lexical features for the URLs no rule fits.

DataFrame operations alone: features are column expressions, each level of a tree is one aggregation into histograms of
gradients, and the trees are applied as CASE expressions."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgeo.llm.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "suffix_rate", "suffix_count", "domain_rate", "domain_count")


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path: after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; then up to ``?`` or ``#``. Both empty if there is no ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule (ties: the name that sorts first); nulls if none fits."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def with_features(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the features that need the URL alone, and suffix (last label of the host) and domain (last two)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    size = F.length(url)
    kinds = F.array_distinct(F.split(url, ""))
    share = lambda ch: (size - F.length(F.replace(url, ch, F.lit("")))) / size
    entropy = F.aggregate(F.filter(kinds, lambda ch: ch != ""), F.lit(0.0), lambda sum_, ch: sum_ - share(ch) * F.log2(share(ch)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return pages.withColumns({
        "length": size.cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/[^/]"), "digit_ratio": F.when(size > 0, count(url, "[0-9]") / size).otherwise(0.0), "entropy": F.when(size > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "host_labels": F.when(F.col("host") == "", 0.0).otherwise(count(F.col("host"), r"\.") + 1), "hyphens": count(url, "[-_]"),
        "suffix": F.regexp_extract("host", r"[^.]*$", 0), "domain": F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0),
    })


def with_suffix_statistics(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds how many of all ``labelled`` rows share the suffix and the domain, and the share of blocked ones (pulled to 0.5 by two)."""
    out = pages
    for key in ("suffix", "domain"):
        known = labelled.groupBy(key).agg(F.count("*").alias("_n"), F.sum("label").alias("_blocked"))
        out = out.join(known, key, "left").withColumns({f"{key}_rate": (F.coalesce("_blocked", F.lit(0)) + 1.0) / (F.coalesce("_n", F.lit(0)) + 2.0), f"{key}_count": F.log1p(F.coalesce("_n", F.lit(0)).cast("double"))}).drop("_n", "_blocked")
    return out


@dataclass
class Node:
    """A leaf's ``value``, or a split: rows whose ``feature`` is over ``edge`` go to ``over``, others to ``under``."""

    value: float = 0.0
    feature: str = ""
    edge: float = 0.0
    bin: int = 0
    under: "Node | None" = None
    over: "Node | None" = None

    def column(self) -> Column:
        return F.when(F.col(self.feature) > self.edge, self.over.column()).otherwise(self.under.column()) if self.under else F.lit(self.value)

    def leaf_of_bins(self, leaves: list["Node"]) -> Column:
        """The place in ``leaves`` of the leaf that a row of binned features reaches; -1 for other leaves."""
        if self.under:
            return F.when(F.element_at("bins", FEATURES.index(self.feature) + 1) > self.bin, self.over.leaf_of_bins(leaves)).otherwise(self.under.leaf_of_bins(leaves))
        return F.lit(next((i for i, x in enumerate(leaves) if x is self), -1))

    def value_of_bins(self) -> Column:
        return F.when(F.element_at("bins", FEATURES.index(self.feature) + 1) > self.bin, self.over.value_of_bins()).otherwise(self.under.value_of_bins()) if self.under else F.lit(self.value)


@dataclass
class BoostedTrees:
    prior: float
    trees: list[Node]

    def margin(self) -> Column:
        """Log-odds of blocking, over the columns FEATURES."""
        return sum((t.column() for t in self.trees), F.lit(self.prior))


def fit(labelled: DataFrame, trees: int = 10, depth: int = 3, bins: int = 16, rate: float = 0.3, ridge: float = 1.0, sample_rows: int = 20_000, seed: int = 3) -> BoostedTrees:
    """Boosted regression trees on the logistic loss, from ``labelled`` (FEATURES and label 0 or 1).

    The trees are fitted on a random sample of about ``sample_rows`` rows; what comes to the driver is a histogram with a
    row per leaf, feature and bin. With one class or no rows the trees are empty and the prior decides; no rows: 0."""
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = math.log((ones + 0.5) / (n - ones + 0.5)) if n else 0.0
    if not 0 < ones < n:
        return BoostedTrees(prior, [])
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(n)) < sample_rows
    sample = materialize(labelled.filter(drawn).select("label", *FEATURES), "url-sample")
    steps = [(i + 1) / bins for i in range(bins - 1)]
    edges = {f: sorted(set(e or ())) for f, e in sample.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).first().asDict().items()}
    binned = materialize(sample.select(F.col("label").cast("double").alias("label"), F.array(*[sum(((F.col(f) > e).cast("int") for e in edges[f]), F.lit(0)) for f in FEATURES]).alias("bins")), "url-bins")
    model = BoostedTrees(prior, [])
    for _ in range(trees):
        chance = 1 / (1 + F.exp(-sum((t.value_of_bins() for t in model.trees), F.lit(prior))))
        graded = binned.select("bins", (F.col("label") - chance).alias("g"), (chance * (1 - chance)).alias("h"))
        root = Node()
        leaves = [root]
        for level in range(depth):
            sums = graded.select(root.leaf_of_bins(leaves).alias("leaf"), "g", "h", F.posexplode("bins").alias("f", "bin")).filter("leaf >= 0").groupBy("leaf", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            grown = []
            for k, leaf in enumerate(leaves):
                split_leaf(leaf, [r for r in sums if r.leaf == k], edges, rate, ridge)
                grown += [leaf.under, leaf.over] if leaf.under else []
            leaves = grown
            if not leaves:
                break
        model.trees.append(root)
    return model


def split_leaf(leaf: Node, sums: list, edges: dict[str, list[float]], rate: float, ridge: float) -> None:
    """Give ``leaf`` its best split by the gain in loss, with the values of both sides, or its own value if none gains."""
    gain_of = lambda g, h: g * g / (h + ridge)
    by = {}
    for r in sums:
        by.setdefault(r.f, {})[r.bin] = (r.g, r.h)
    if not by:
        return
    g_all, h_all = (sum(x[i] for x in next(iter(by.values())).values()) for i in (0, 1))
    leaf.value = rate * g_all / (h_all + ridge)
    best = (1e-6, 0, 0, 0.0, 0.0)
    for f, hist in sorted(by.items()):
        g = h = 0.0
        for b in range(len(edges[FEATURES[f]])):
            g, h = g + hist.get(b, (0, 0))[0], h + hist.get(b, (0, 0))[1]
            gain = gain_of(g, h) + gain_of(g_all - g, h_all - h) - gain_of(g_all, h_all)
            if 0 < h < h_all and gain > best[0] + 1e-9:
                best = (gain, f, b, g, h)
    if best[0] > 1e-6:
        _, f, b, g, h = best
        leaf.feature, leaf.bin, leaf.edge = FEATURES[f], b, edges[FEATURES[f]][b]
        leaf.under, leaf.over = Node(rate * g / (h + ridge)), Node(rate * (g_all - g) / (h_all - h + ridge))


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", **settings) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and margin (the trees' log-odds of blocking).

    The labelled URLs are those a rule fits; the verdict is the rule's where one fits, else block where the margin is over
    0. Null or empty URLs and URLs without ``://`` have an empty host and path and get the trees' verdict. Rows and other
    columns stay; columns named like an added one are replaced. An empty table stays empty."""
    added = {"host", "path", "rule", "verdict", "margin", "suffix", "domain", "label", "_n", "_blocked", *FEATURES}
    name, verdict = rule_columns(rules)
    own = pages.select(F.struct(*pages.columns).alias("_row"), F.col(url_col).cast("string").alias("_url"))
    judged = with_features(with_parts(own, "_url").withColumns({"rule": name, "_by_rule": verdict}), "_url").withColumn("label", (F.col("_by_rule") == "block").cast("int"))
    known = judged.filter(F.col("rule").isNotNull())
    full = with_suffix_statistics(judged, known)
    model = fit(full.filter(F.col("rule").isNotNull()), **settings)
    out = full.withColumn("margin", model.margin())
    return out.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c not in added], "host", "path", "rule", F.coalesce("_by_rule", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"), "margin")


#: The rules of the query.
RULES = [parse_rule(*x) for x in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of the pages table."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "margin")
