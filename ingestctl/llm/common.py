"""What several operators share: reading a table, texts as bytes, keys of rows, hashing in tasks."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestctl.session import configure

#: Every operator that splits words takes runs of other characters than these.
WORD_GAP = r"[\x20\x09-\x0D]+"
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for these operators: as elsewhere, and few texts at a time for a Python worker, as they may be long."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes with A-Z in lower case and all other characters as they are."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def ascii_words(text: str) -> list[bytes]:
    """Lower-cased words; bytes split on exactly the characters of ``WORD_GAP``."""
    return ascii_lower(text).split()


def code_points(text: Column) -> Column:
    return F.length(text).cast("long")


def text_key(column: str = "text") -> Column:
    """128 bits that stand for a whole text; null and empty texts have the same."""
    return F.md5(whole_text(column).cast("binary"))


def crc_remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    id_text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(id_text.cast("binary")) % F.lit(modulus)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where it is used within a lambda function."""
    return F.transform(F.array(value), use)[0]


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


class Recent(dict):
    """A cache of bounded size for values that are never None: when full, the older half is forgotten."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
