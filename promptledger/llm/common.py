"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An array with `body(value)` as its one element; the value is computed once, however often the body names it."""
    return F.transform(F.array(value), body)


def words(text: Column) -> Column:
    """The runs of characters other than space, tab and the line ends."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def text_rows(docs: DataFrame, *others: str | Column) -> DataFrame:
    """`doc_id`, the named columns and `text` (null: empty); other columns of the table, whatever their names, are left out."""
    return docs.select("doc_id", *others, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def split_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text; bytes split at exactly the white space of `SPACE`."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple[list, ...]]:
    """Arrow batches as tuples of Python lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
