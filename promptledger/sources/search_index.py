"""Searching and paging a stored audit log without reading all of it.

Beside the store lies a posting table of trigrams: for each file of the store the three-character pieces that its
searched columns hold. A search reads the postings of its own pieces, then only the files that hold all of them, and
there the condition itself decides. Files written since the last update of the table are read as well.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.audit_log import MAX_PAGE, SEARCHED, audit_filter

#: Stands in the posting table for a file as such.
_FILE = ""


def _index(store: str) -> str:
    return f"{store.rstrip('/')}_search"


def pieces_of(search: str) -> list[str]:
    """The trigrams that every text a search matches holds: of the stretches between its wildcards, in lower case.

    Only those of ASCII, whose lower case is the same everywhere.
    """
    runs = re.split("[%_]", search.strip())
    return sorted({run[i:i + 3].lower() for run in runs for i in range(len(run) - 2) if run[i:i + 3].isascii()})


def _trigrams(df: DataFrame) -> Column:
    """The distinct trigrams of a row's searched columns, in lower case."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def pieces(text: Column) -> Column:
        return F.when(F.length(text) > 2, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))

    texts = [F.lower(F.array_join(n, ",") if kinds[n] == "array" else F.col(n).cast("string")) for n in SEARCHED if n in kinds]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[pieces(t) for t in texts]))))


def _name(path: Column) -> Column:
    """A file's path without its scheme, the same from the reader and from a listing."""
    return F.regexp_replace(path, "^[a-z]+:/*", "/")


def _indexed(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(_index(store))
    except AnalysisException:
        return None


def _plain(path: str) -> str:
    return re.sub("^[a-z]+:/*", "/", path)


def _missing(spark: SparkSession, store: str, index: DataFrame | None) -> list[str]:
    """Files of the store that the posting table does not know. A listing, as Spark makes it for any scan."""
    files = spark.read.parquet(store).inputFiles()
    known = set() if index is None else {r["file"] for r in index.where(F.col("trigram") == _FILE).select("file").collect()}
    return [f for f in files if _plain(f) not in known]


def update_search_index(spark: SparkSession, store: str) -> int:
    """Add the files of the store that are new to its posting table; returns how many.

    Each row's pieces are made where it is read; a file's distinct ones are few however many rows it has. They are
    written in order of the trigram, so a search reads a few row groups of them.
    """
    new = _missing(spark, store, _indexed(spark, store))
    if not new:
        return 0
    rows = spark.read.option("basePath", store).parquet(*new)
    held = rows.select(_name(F.col("_metadata.file_path")).alias("file"), F.explode(F.array_append(_trigrams(rows), F.lit(_FILE))).alias("trigram")).distinct()
    # A file without rows has no pieces, but it is known.
    names = spark.createDataFrame([(_plain(f), _FILE) for f in new], "file string, trigram string")
    held.unionByName(names).distinct().repartitionByRange("trigram", "file").sortWithinPartitions("trigram", "file").write.mode("append").parquet(_index(store))
    return len(new)


def search_files(spark: SparkSession, store: str, search: str) -> list[str] | None:
    """The files that may hold a match, or None where the search has no three characters in a row and all may."""
    pieces = pieces_of(search)
    index = _indexed(spark, store)
    if not pieces or index is None:
        return None
    hits = index.where(F.col("trigram").isin(pieces)).groupBy("file").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(pieces))
    return [r["file"] for r in hits.select("file").collect()] + _missing(spark, store, index)


def search_store(spark: SparkSession, store: str, search: str, **conditions) -> DataFrame:
    """The stored rows that `audit_filter` finds with this search and the other conditions, from as few files as may hold them.

    Wildcards and case are those of `audit_filter`, which decides on the rows; the postings only choose files.
    """
    whole = spark.read.parquet(store)
    files = search_files(spark, store, search)
    if files is None:
        rows = whole
    elif not files:
        rows = whole.limit(0)
    else:
        by_name = {_plain(f): f for f in whole.inputFiles()}
        rows = spark.read.schema(whole.schema).option("basePath", store).parquet(*sorted({by_name[_plain(f)] for f in files if _plain(f) in by_name}))
    return audit_filter(rows, search=search, **conditions)


def deep_page(matches: DataFrame, page: int, page_size: int = 20) -> DataFrame:
    """A page, newest first, as `audit_page` gives it, for any page number.

    Matches are counted by the hour in one pass over narrow columns, a row for each hour of the log; a running sum says in
    which hours the page lies, and only those are read, from their day folders if `matches` has `event_date`, and
    sorted. Pages beyond the last are empty. Runs a job when called. Rows without a time come last.
    """
    if page < 1 or not 1 <= page_size <= MAX_PAGE:
        raise ValueError(f"page starts at 1, page_size is 1..{MAX_PAGE}")
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    counts = matches.groupBy(hour.alias("hour")).count().orderBy(F.desc_nulls_last("hour")).collect()
    skip, take, first = (page - 1) * page_size, page_size, None
    at, hours = 0, []
    for r in counts:
        if at < skip + take and at + r["count"] > skip:
            first = at if first is None else first
            hours.append(r["hour"])
        at += r["count"]
    if not hours:
        return matches.limit(0)
    known: list[datetime] = [h for h in hours if h is not None]
    inside = F.lit(False)
    if known:
        low, high = min(known), max(known) + timedelta(hours=1)
        inside = (F.col("timestamp") >= F.lit(low).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(high).cast("timestamp_ntz"))
        if "event_date" in matches.columns:
            inside = inside & F.col("event_date").between(F.lit(low.date()), F.lit(max(known).date()))
    if None in hours:
        inside = inside | F.col("timestamp").isNull()
    ordered = matches.where(inside).orderBy(F.desc("timestamp"), F.desc("id"))
    return (ordered.offset(skip - first) if skip > first else ordered).limit(take)
