"""Coverage: report parsing, coverage means, diff coverage, target classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.schemas import COVERAGE_XML


def coverage_lines_from_xml(df: DataFrame, xml: str = "xml", keep: list[str] | None = None) -> DataFrame:
    """Explode a coverage report column into (class, file, number, hit) rows.

    Every line element below a class counts, both the method-level and the
    class-level lists, so duplicates are normal (consumers use set
    semantics).  ``number`` stays a string; ``hit`` is ``hits > 0``.
    Parsing is the built-in ``from_xml`` with a declared schema; a malformed
    report fails the job.
    """
    keep = keep or []
    rep = df.select(*keep, F.from_xml(F.col(xml), COVERAGE_XML, {"mode": "FAILFAST"}).alias("__r"))
    pkgs = rep.select(*keep, F.explode_outer("__r.packages.package").alias("__p"))
    classes = pkgs.select(*keep, F.explode("__p.classes.class").alias("__c"))
    method_lines = F.flatten(F.transform(F.coalesce(F.col("__c.methods.method"), F.array()),
                                         lambda m: F.coalesce(m["lines"]["line"], F.array())))
    class_lines = F.coalesce(F.col("__c.lines.line"), F.array())
    lines = classes.select(*keep, F.col("__c._name").alias("class"), F.col("__c._filename").alias("file"),
                           F.explode(F.concat(method_lines, class_lines)).alias("__l"))
    return lines.select(*keep, "class", "file", F.col("__l._number").alias("number"),
                        (F.col("__l._hits").try_cast("long") > 0).alias("hit"))


def load_coverage_xml_files(spark, path: str) -> DataFrame:
    """File form: Cobertura reports read with the XML data source, one row per
    ``class`` element (``input_file_name`` identifies the report), exploded
    like :func:`coverage_lines_from_xml`."""
    cls_schema = COVERAGE_XML["packages"].dataType["package"].dataType.elementType["classes"].dataType["class"] \
        .dataType.elementType
    classes = (spark.read.format("xml").option("rowTag", "class").option("mode", "FAILFAST").schema(cls_schema).load(path)
               .select(F.input_file_name().alias("report"), F.struct("*").alias("__c")))
    method_lines = F.flatten(F.transform(F.coalesce(F.col("__c.methods.method"), F.array()),
                                         lambda m: F.coalesce(m["lines"]["line"], F.array())))
    class_lines = F.coalesce(F.col("__c.lines.line"), F.array())
    lines = classes.select("report", F.col("__c._name").alias("class"), F.col("__c._filename").alias("file"),
                           F.explode(F.concat(method_lines, class_lines)).alias("__l"))
    return lines.select("report", "class", "file", F.col("__l._number").alias("number"),
                        (F.col("__l._hits").try_cast("long") > 0).alias("hit"))


def coverage_means(per_sample: DataFrame, task_key: str = "task_idx",
                   values: tuple[str, ...] = ("line_coverage", "condition_coverage")) -> tuple[DataFrame, DataFrame]:
    """Mean over all samples of a task (failed samples carry 0), then macro mean."""
    per_task = per_sample.groupBy(task_key).agg(*[F.avg(v).alias(v) for v in values])
    suite = per_task.agg(F.count(F.lit(1)).alias("n_tasks"), *[F.avg(v).alias(v) for v in values])
    return per_task, suite


def sample_line_coverage(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per-sample line and condition coverage as hit fractions of its lines."""
    return lines.groupBy(*keys).agg(F.avg(F.col("hit").cast("double")).alias("line_coverage"),
                                    F.avg(F.col("cond_hit").cast("double")).alias("condition_coverage"))


def diff_coverage(lines: DataFrame, tasks: DataFrame, task_key: str | list[str] = "task_idx") -> DataFrame:
    """Per task: hit tuples / distinct (class, file, number, hit) tuples over all samples.

    A line hit by one sample and missed by another yields two tuples.  Tasks
    without lines get 0.  The distinct step is an aggregate on the line key
    (map-side combine, so only distinct lines are shuffled); the task level
    follows on the already reduced rows.
    """
    keys = [task_key] if isinstance(task_key, str) else list(task_key)
    per_line = (lines.groupBy(*keys, "class", "file", "number")
                .agg(F.max(F.col("hit").cast("int")).alias("any_hit"),
                     F.min(F.col("hit").cast("int")).alias("all_hit")))
    per_task = per_line.groupBy(*keys).agg(
        F.sum("any_hit").alias("hit_tuples"),
        F.sum(F.lit(1) + F.col("any_hit") - F.col("all_hit")).alias("tuples"))
    out = tasks.select(*keys).join(per_task, keys, "left")
    ratio = F.coalesce(F.try_divide(F.col("hit_tuples").cast("double"), F.col("tuples")), F.lit(0.0))
    return out.select(*keys, ratio.alias("diff_coverage"))


_BITS = ["hit_bits", "miss_bits"]


def coverage_bits(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct (class, file, number, hit) tuples of each key as bits: one row per 64 line numbers, with a
    word of hit and a word of missed lines.  Parts of any split of the lines are put together by
    :func:`merge_coverage_bits`; a number that is no plain integer has a row of its own (``odd``); lines
    without ``hit`` count nowhere."""
    number = F.col("number").cast("string")
    n = number.try_cast("long")
    plain = n.cast("string").eqNullSafe(number) & number.isNotNull()
    bit = F.when(plain, F.expr("shiftleft(1L, CAST(try_cast(CAST(number AS STRING) AS BIGINT) & 63 AS INT))")).otherwise(F.lit(1).cast("long"))
    none = F.lit(0).cast("long")
    cells = lines.filter("hit is not null").select(
        *keys, "class", "file", F.when(plain, F.shiftright(n, 6)).alias("word"), F.when(~plain, number).alias("odd"),
        F.when(F.col("hit"), bit).otherwise(none).alias("hit_bits"), F.when(~F.col("hit"), bit).otherwise(none).alias("miss_bits"))
    return merge_coverage_bits([cells], keys)


def merge_coverage_bits(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(*keys, "class", "file", "word", "odd").agg(*[F.bit_or(c).alias(c) for c in _BITS])


def diff_coverage_of_bits(bits: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`diff_coverage` from merged bits."""
    hits, misses = (F.sum(F.bit_count(c)) for c in _BITS)
    per_task = bits.groupBy(*keys).agg(hits.alias("hit_tuples"), (hits + misses).alias("tuples"))
    ratio = F.coalesce(F.try_divide(F.col("hit_tuples").cast("double"), F.col("tuples")), F.lit(0.0))
    return tasks.select(*keys).join(per_task, keys, "left").select(*keys, ratio.alias("diff_coverage"))


class CoverageStore:
    """Coverage bits of batches of samples in a shared folder: new samples add a batch, old lines are not read again.

    A batch that is written again takes the place of its first writing, so that a job can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def add(self, batch: str, lines: DataFrame) -> None:
        bits = coverage_bits(lines, self.keys)
        bits.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def bits(self) -> DataFrame:
        stored = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").drop("batch")
        return merge_coverage_bits([stored], self.keys)

    def diff_coverage(self, tasks: DataFrame) -> DataFrame:
        return diff_coverage_of_bits(self.bits(), tasks, self.keys)


def target_classes(names: Column) -> Column:
    """Sorted distinct class names (the reference's set has no order)."""
    return F.array_sort(F.array_distinct(names))


def classes_under_test(classmethods: Column) -> Column:
    return target_classes(F.transform(classmethods, lambda x: x["be_test_class_name"]))
