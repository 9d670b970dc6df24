"""Scans: typed CSV, Parquet files and datasets by requested columns, JDBC, predictions, samples, schema checks."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions.dates import to_date


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def typed_csv(spark: SparkSession, path: str, text_columns: list[str], date_columns: list[str] = (), number_columns: list[str] = ()) -> DataFrame:
    """A CSV read as text, so ids keep their zeros; named dates and numbers are coerced, what is none becomes null."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = {c.lower(): c for c in df.columns}
    dates = {names[c.lower()]: to_date(F.col(names[c.lower()])) for c in date_columns if c.lower() in names}
    numbers = {names[c.lower()]: F.col(names[c.lower()]).try_cast("double") for c in number_columns if c.lower() in names}
    texts = {names[c.lower()]: F.trim(names[c.lower()]) for c in text_columns if c.lower() in names}
    return df.withColumns(texts | dates | numbers)


def dataset(spark: SparkSession, path: str, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns of a Parquet file or directory by name in any case, lower-cased; also the names that it lacks."""
    df = spark.read.parquet(path)
    names = {c.lower(): c for c in df.columns}
    found = [w.lower() for w in wanted if w.lower() in names]
    return df.select(*[F.col(names[w]).alias(w) for w in found]), [w for w in wanted if w.lower() not in names]


def directory(spark: SparkSession, path: str, suffix: str = "*.parquet") -> DataFrame:
    """All files below path with the suffix, hidden ones left out, with their path."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).parquet(path).withColumn("source_file", F.input_file_name())


def sql_text(value: str) -> str:
    """value as a text literal of SQL."""
    return "'" + value.replace("'", "''") + "'"


def jdbc(spark: SparkSession, url: str, source: str, columns: dict[str, str], positive: str, kinds: tuple[str, list[str]] | None = None, **options: str) -> DataFrame:
    """A database scan whose projection, renaming and predicates run in the database."""
    fields = ", ".join(f"{old} AS {new}" for old, new in columns.items())
    query = f"SELECT {fields} FROM {source} WHERE {positive} > 0" + (f" AND {kinds[0]} IN ({', '.join(map(sql_text, kinds[1]))})" if kinds else "")
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def best_candidate(schemas: dict[str, list[str]], required: list[str], tokens: dict[str, int]) -> str | None:
    """The path whose schema has all required columns and whose name scores highest by tokens; equal scores go by path."""
    fit = [p for p, cols in schemas.items() if set(required) <= {c.lower() for c in cols}]
    score = {p: sum(v for t, v in tokens.items() if t in p.lower()) for p in fit}
    return min(fit, key=lambda p: (-score[p], p)) if fit else None


def prediction_names(names: list[str], expected: list[str], skip: tuple[str, ...] = ("debug", "tmp")) -> tuple[list[str], list[str]]:
    """Prediction files to read, in order, and warnings on expected ones that are not there."""
    found = sorted(n for n in names if re.search(r"predictions?.*\.parquet$", n) and not any(s in n for s in skip))
    return found, [f"missing: {e}" for e in expected if e not in found]


def predictions(df: DataFrame, rename: dict[str, str], keys: list[str], numbers: list[str]) -> DataFrame:
    """Prediction rows with one naming, typed keys and numbers; rows without a key are left out."""
    df = df.withColumnsRenamed({old: new for old, new in rename.items() if old in df.columns})
    return df.withColumns({n: F.col(n).cast("string").try_cast("double") for n in numbers if n in df.columns}).dropna(subset=keys)


def stable_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows by the md5 of seed and keys (as text, joined by ``|``): the same rows on every run and any cluster."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


def json_groups(text: str) -> dict[str, list[str]]:
    """A catalogue of feature groups from JSON text; every group must be a list of names."""
    groups = json.loads(text)
    if not all(isinstance(v, list) for v in groups.values()):
        raise ValueError("a feature group is not a list")
    return groups


def feature_list(groups: dict[str, list[str]], order: list[str], columns: list[str], forbidden: tuple[str, ...] = ("target", "label", "split")) -> list[str]:
    """Features in group order, each once; a missing or forbidden one raises."""
    out = list(dict.fromkeys(f for g in order for f in groups[g]))
    bad = [f for f in out if f not in columns or any(x in f for x in forbidden)]
    if bad:
        raise ValueError(f"missing or forbidden features: {bad}")
    return out


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns, so that counts and comparisons skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def schema_table(df: DataFrame, shown: int = 5) -> DataFrame:
    """column, kind, nonmissing, n_unique, and the ``shown`` smallest values as text, of every column.

    Values are counted as rows of (column, text), so a table of any width needs one exchange of its distinct values,
    and no task holds those of a column.
    """
    names = df.dtypes
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).cast("string").alias("value")) for i, (c, _) in enumerate(names)])).alias("c")
    counts = df.select(cells).select("c.*").groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("place").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("nonmissing"), F.count("value").alias("n_unique"))
    first = counts.filter("value is not null").withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy("value"))).filter(F.col("r") <= shown)
    examples = first.groupBy("place").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    about = df.sparkSession.createDataFrame([(i, c, kind) for i, (c, kind) in enumerate(names)], "place int, column string, kind string")
    made = about.join(totals, "place", "left").join(examples, "place", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return made.select("column", "kind", zero("nonmissing"), zero("n_unique"), F.array_join(F.coalesce("examples", F.array().cast("array<string>")), ", ").alias("examples"))


def files_below(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Full names of all files below path with the suffix, in order; names that begin with ``.`` or ``_`` are hidden. Nothing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("path")
    return sorted(r["path"] for r in found.collect())


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def convert_folder(spark: SparkSession, source: str, target: str, suffix: str = ".csv", overwrite: bool = False, skip: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Every CSV below source as Parquet at the same place below target: (name below source, written, kept or skipped).

    A target that is there is kept unless overwrite; names with one of the parts in skip are left out.
    """
    done = []
    for path in files_below(spark, source, suffix):
        name = path[path.index(source.rstrip("/")) + len(source.rstrip("/")) + 1 :]
        out = f"{target}/{name.removesuffix(suffix)}.parquet"
        if any(s in name for s in skip):
            done.append((name, "skipped"))
        elif exists(spark, out) and not overwrite:
            done.append((name, "kept"))
        else:
            spark.read.option("header", True).csv(path).write.mode("overwrite").parquet(out)
            done.append((name, "written"))
    return done


def locate(spark: SparkSession, folder: str, required: list[str], tokens: dict[str, int]) -> str:
    """best_candidate() of the Parquet files below folder, by their schemas; raises if none has the columns."""
    found = best_candidate({p: spark.read.parquet(p).columns for p in files_below(spark, folder, ".parquet")}, required, tokens)
    if found is None:
        raise ValueError(f"no file below {folder} has {required}")
    return found


def first_path(spark: SparkSession, preferred: str, *fallbacks: str) -> str:
    """The first of the paths that is there; raises if none is."""
    for path in (preferred, *fallbacks):
        if exists(spark, path):
            return path
    raise ValueError(f"none of {(preferred, *fallbacks)} is there")


def footer_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, n_rows of Parquet files or folders, from their footers: no column is read.

    Spark pushes count(*) down to its second Parquet source only, so a session of its own is set to use that one.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    counts = [own.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, path in paths.items()]
    return reduce(DataFrame.unionByName, counts)


def results(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV results of several runs, of one schema, as one table."""
    return spark.read.schema(schema).option("header", True).csv(list(paths))


def first_column(df: DataFrame, names: list[str]) -> str:
    """The first of names that df has, in any case, as df writes it; raises if it has none."""
    own = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in own:
            return own[name.lower()]
    raise ValueError(f"none of {names} is a column")
