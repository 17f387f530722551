"""Reading requests, keys and rule files."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.rules import Rule
from ..schemas import API_KEYS, INJECTION_RULES, REQUEST_LOG

CORRUPT, MISTYPED = "_corrupt", "_mistyped"
#: Rules that a file may hold to become literals of the plan.
MAX_RULES = 10_000


#: JSON kinds, as VARIANT names them.
_TEXT, _WHOLE, _FLAG, _NULL = "STRING", "BIGINT", "BOOLEAN", "VOID"
# Texts that stand for a flag, in any case.
_YES, _NO = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")


def typed_requests(lines: DataFrame, line: str = "value") -> DataFrame:
    """Requests from lines of JSON, each field by itself; the columns of a request log, `_corrupt` and `_mistyped`.

    A line that is no JSON object is kept whole in `_corrupt`. In an object each field of a wrong type gives an entry
    (field, message) in `_mistyped` and a null value, and the other fields are read all the same. Texts have to be
    texts: numbers are not turned into them. Flags may also be 0, 1 or the usual words for them, ids may be whole
    numbers as text. A null is one that is missing for keys, headers and addresses; in all other fields it is mistyped.
    Fields that are not known are ignored, and blank lines are no records.
    """
    rows = lines.where(F.regexp_like(F.col(line), F.lit("[^ \\t\\r]"))).select(F.col(line).alias("line"), F.try_parse_json(F.col(line)).alias("v"))
    names = [f.name for f in REQUEST_LOG.fields]
    # What a field holds, and of which kind it is: null where it is not there.
    held = [F.try_variant_get("v", f"$.{n}", "variant").alias(n) for n in names]
    rows = rows.select("line", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("object"), *held)
    kinds = {n: F.regexp_extract(F.schema_of_variant(F.col(n)), "^[A-Z]+", 0) for n in names}

    def text(n: str) -> Column:
        return F.when(kinds[n] == _TEXT, F.try_variant_get(n, "$", "string"))

    def flag(n: str) -> Column:
        number = F.when(kinds[n].isin(_WHOLE, "DECIMAL", "DOUBLE"), F.try_variant_get(n, "$", "double"))
        word = F.lower(text(n))
        return F.when(kinds[n] == _FLAG, F.try_variant_get(n, "$", "boolean")).when(word.isin(*_YES) | (number == 1), True) \
            .when(word.isin(*_NO) | (number == 0), False)

    whole = F.when(kinds["request_id"] == _WHOLE, F.try_variant_get("request_id", "$", "bigint")).otherwise(
        F.when(F.regexp_like(text("request_id"), F.lit(r"^-?[0-9]{1,19}$")), text("request_id").try_cast("bigint")))
    values = {"request_id": whole, "ts": text("ts").try_cast("timestamp_ntz"), "enable_pii": flag("enable_pii"), "enable_injection": flag("enable_injection")}
    values |= {n: text(n) for n in names if n not in values}
    optional = {"api_key", "header_api_key", "client_ip"}
    says = {"request_id": "must be a whole number", "ts": "must be a time", "target_model": "unsupported",
            "enable_pii": "must be true or false", "enable_injection": "must be true or false"}
    read = rows.select("line", "object", *[F.struct(kinds[n].alias("kind"), values[n].alias("value")).alias(n) for n in names])
    wrong = [F.when(F.col(n)["kind"].isNotNull() & F.col(n)["value"].isNull() & ((F.col(n)["kind"] != _NULL) if n in optional else F.lit(True)),
                    F.struct(F.lit(n).alias("field"), F.lit(says.get(n, "must be text")).alias("message"))) for n in names]
    return read.select(*[F.col(n)["value"].alias(n) for n in names], F.when(~F.col("object"), F.col("line")).alias(CORRUPT),
                       F.array_compact(F.array(*wrong)).alias(MISTYPED))


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A request log. In JSON, one record a line, see `typed_requests` for records and fields that are not right."""
    if fmt == "json":
        return typed_requests(spark.read.text(path))
    return spark.read.schema(REQUEST_LOG).format(fmt).load(path)


def stream_requests(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    """The same log as a stream of files, at most `max_files` of them in a micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    return typed_requests(reader.text(path)) if fmt == "json" else reader.schema(REQUEST_LOG).format(fmt).load(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows of a table of a few large row groups out to `partitions` tasks, for work that costs much more than
    a shuffle of the rows. Without a number a table that is read in as many tasks as the cluster has slots stays as it is."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if partitions is None and df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(partitions or slots)


def read_keys(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(API_KEYS).format(fmt).load(path)


def load_rules(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[list[Rule], DataFrame]:
    """Rules from a JSON array, or with `multi_line` off from one record per line, and the skipped entries with the reason.

    A missing or unreadable file gives no rules. Rules are configuration: they are read on the driver, `MAX_RULES`
    at most, and become literals of the plan. For more, join them as a table: `operators.rule_table`.
    """
    schema = "name string, pattern string, threat_type string, risk_level string, weight double"
    try:
        raw = spark.read.schema(schema + f", {CORRUPT} string").option("multiLine", multi_line).option(
            "columnNameOfCorruptRecord", CORRUPT).json(path)
        entries = [r.asDict() for r in raw.limit(MAX_RULES + 1).collect()]
    except AnalysisException:
        entries = []
    if len(entries) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; join them as a table")
    good, bad = [], []
    for e in entries:
        broken = e.pop(CORRUPT, None)
        try:
            if broken is not None:
                raise ValueError("not a rule record")
            rule = Rule.from_dict(e)
            _check_java(spark, rule.pattern)
            good.append(rule)
        except KeyError as err:
            bad.append((*e.values(), f"missing {err.args[0]}"))
        except (ValueError, re.error) as err:
            bad.append((*e.values(), str(err).splitlines()[0]))
    rejected = T.StructType(INJECTION_RULES.fields + [T.StructField("reason", T.StringType())])
    return good, spark.createDataFrame(bad, rejected)


def _check_java(spark: SparkSession, pattern: str) -> None:
    """Raise ValueError for a pattern that Spark's regex engine does not take."""
    try:
        spark._jvm.java.util.regex.Pattern.compile("(?iU)" + pattern)
    except (Py4JJavaError, PySparkException) as err:
        raise ValueError(f"bad pattern: {str(err).splitlines()[0]}") from None
