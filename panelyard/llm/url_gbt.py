"""URL verdicts: rules first, gradient-boosted trees on lexical features for the rest, in DataFrame and Spark ML functions only.

The trees learn from URLs that carry a label; where no other labels are given, the URLs that the rules decide are the
labelled ones, and the trees carry those decisions over to URLs that no rule names.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm._common import ascii_lower, cut_lineage, let

LEXICAL = ["n_url", "n_host", "n_path", "n_query", "depth", "host_labels", "digit_ratio", "host_digit_ratio", "entropy", "n_params", "n_hyphens", "n_escapes"]
SUFFIX = ["top_rate", "top_log_count", "domain_rate", "domain_log_count"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null; of equally long ones the first of the list.

    A rule is ``host/path``; it fits its host and all subdomains, if the path starts with the rule's.
    """
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, path_start = rule.partition("/")
        own = own.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + path_start))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if out is None else out


def _entropy(text: Column) -> Column:
    """Bits a character of the text's character distribution; 0 for the empty text. Counts runs of the sorted characters."""
    n = F.length(text)
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    bits = lambda run: run * F.log2(F.greatest(run, F.lit(1.0)))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def step(acc: Column, c: Column) -> Column:
        same = acc["c"] == c
        return F.struct(c.alias("c"), F.when(same, acc["run"] + 1).otherwise(1.0).alias("run"), F.when(same, acc["total"]).otherwise(acc["total"] + bits(acc["run"])).alias("total"))

    return F.when(n > 0, F.log2(n) - F.aggregate(chars, start, step, lambda acc: acc["total"] + bits(acc["run"])) / n).otherwise(0.0)


def features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with host, path, top (last label of the host), domain (last two) and the LEXICAL features.

    A null url counts as empty. Null and malformed urls (no ``://``) have an empty host and path.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    df = urls.withColumns({"host": host_of(url), "path": path_of(url)})
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    count = lambda c, x: F.length(c) - F.length(F.translate(c, x, ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    made = {
        "n_url": F.length(url),
        "n_host": F.length("host"),
        "n_path": F.length("path"),
        "n_query": F.length(query),
        "depth": count(F.col("path"), "/"),
        "host_labels": count(F.col("host"), ".") + 1,
        "digit_ratio": digits(url) / F.greatest(F.length(url), F.lit(1)),
        "host_digit_ratio": digits(F.col("host")) / F.greatest(F.length("host"), F.lit(1)),
        "entropy": _entropy(url),
        "n_params": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "n_hyphens": count(F.col("host"), "-"),
        "n_escapes": count(url, "%"),
    }
    return df.withColumns({k: v.cast("double") for k, v in made.items()} | {"top": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})


class UrlModel:
    """Trees and the suffix statistics of the labelled URLs; ``trees`` is None if not both labels were there."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: dict[str, DataFrame], prior: float):
        """suffixes: for top and domain key (hash of the suffix), rate and log_count, a row of 24 bytes for each suffix of the sample."""
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    def with_suffixes(self, df: DataFrame) -> DataFrame:
        for name, stats in self.suffixes.items():
            renamed = stats.select(F.col("key").alias(f"{name}_key"), F.col("rate").alias(f"{name}_rate"), F.col("log_count").alias(f"{name}_log_count"))
            df = df.withColumn(f"{name}_key", F.xxhash64(name)).join(F.broadcast(renamed), f"{name}_key", "left").drop(f"{name}_key")
        return df.fillna({f"{name}_rate": self.prior for name in self.suffixes} | {f"{name}_log_count": 0.0 for name in self.suffixes})

    def block_score(self, df: DataFrame) -> DataFrame:
        """df (with features()) with block_score, the trees' probability of a block."""
        if self.trees is None:
            return df.withColumn("block_score", F.lit(0.0))
        ready = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="__x").transform(self.with_suffixes(df))
        return self.trees.transform(ready).withColumn("block_score", vector_to_array("__p")[1]).drop("__x", "__r", "__p", "__y", *SUFFIX)


def bounded_sample(labelled: DataFrame, most_rows: int) -> DataFrame:
    """labelled with a column ``place`` (a hash of url and row, so rows with one url are apart), most_rows rows at most.

    Of more rows those with the least places are taken: first about 1.2 times as many by a threshold, then exactly.
    """
    placed = labelled.withColumn("place", F.xxhash64("host", "path", F.monotonically_increasing_id()))
    n = labelled.count()
    if n <= most_rows:
        return placed
    share = min(1.0, 1.2 * most_rows / n)
    return placed.filter(F.col("place") <= int(-(2**63) + share * (2**64 - 1025))).orderBy("place").limit(most_rows)


def train(labelled: DataFrame, most_rows: int = 20_000, trees: int = 15, depth: int = 4, smoothing: float = 20.0, folds: int = 4) -> UrlModel:
    """Fit trees on labelled (features() and label: 1 block, 0 allow).

    most_rows: documented bound of the sample that is learned from, see bounded_sample(). Suffix rates are pulled to
    the overall rate as by ``smoothing`` more rows. The trees see out-of-fold rates: those of the other folds' rows, so
    no row sees its own label. The two suffix tables have at most most_rows rows each, and only they are broadcast.
    """
    sample = bounded_sample(labelled, most_rows).select("place", "top", "domain", "label", *LEXICAL)
    sample = cut_lineage(sample.repartition(8, "place")).withColumn("fold", F.pmod("place", F.lit(folds)))
    total, blocked = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = float(blocked) / total if total else 0.0
    rate = lambda label, rows: (label + smoothing * prior) / (rows + smoothing)
    suffixes, inner = {}, sample
    for name in ("top", "domain"):
        by_fold = cut_lineage(sample.groupBy(F.xxhash64(name).alias("key"), "fold").agg(F.sum("label").alias("label"), F.count(F.lit(1)).alias("rows")))
        whole = by_fold.groupBy("key").agg(F.sum("label").alias("all_label"), F.sum("rows").alias("all_rows"))
        suffixes[name] = cut_lineage(whole.select("key", rate(F.col("all_label"), F.col("all_rows")).alias("rate"), F.log1p(F.col("all_rows") * (folds - 1) / folds).alias("log_count")))
        label, rows = F.col("all_label") - F.col("label"), F.col("all_rows") - F.col("rows")
        others = by_fold.join(whole, "key").select(F.col("key").alias(f"{name}_key"), "fold", rate(label, rows).alias(f"{name}_rate"), F.log1p(rows).alias(f"{name}_log_count"))
        inner = inner.withColumn(f"{name}_key", F.xxhash64(name)).join(F.broadcast(others), [f"{name}_key", "fold"])
    model = UrlModel(None, suffixes, prior)
    if 0 < blocked < total:
        ready = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="__x").transform(inner)
        boosting = GBTClassifier(featuresCol="__x", labelCol="label", predictionCol="__y", maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=17)
        model.trees = boosting.setRawPredictionCol("__r").setProbabilityCol("__p").fit(ready)
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None, **options: float) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule (null if none fits), verdict, block_score of the trees.

    verdict is the longest fitting rule's; else ``block`` if block_score is 0.5 or more, else ``allow``. labelled:
    url and label (1 block, 0 allow) to learn from; by default the pages that rules decide. Without both labels the
    trees allow everything. Null urls are judged as empty ones, very long ones whole. Repeated rows and null ids are
    judged like others. Other columns are not read. An empty table gives an empty result.
    """
    df = features(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    df = df.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = df.filter("m is not null").withColumn("label", F.when(F.col("m.verdict") == "block", 1.0).otherwise(0.0))
    else:
        known = features(labelled.select("url", F.col("label").cast("double").alias("label"))).filter("label is not null")
    scored = train(known, **options).block_score(df)
    verdict = F.coalesce("m.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), "block_score")
