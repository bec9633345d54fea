"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.session import durable, ship

__all__ = ["ascii_lower", "durable", "free", "read", "ship", "small", "text_key", "utf8", "words_of"]

#: The contracts' words as regular expressions, in text and in lower-cased text: ASCII that is no letter or digit parts them.
#: The JVM looks up characters that are listed one by one in a bit set, where it tries ranges in turn: an eighth of the time.
WORD_ANY_CASE = "[^" + "".join(f"\\x{b:02X}" for b in range(128) if not chr(b).isalnum()) + "]+"
WORD = "[^" + "".join(f"\\x{b:02X}" for b in range(128) if not chr(b).isdigit() and not chr(b).islower()) + "]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Rows (of an id and a key) that may be broadcast: about 10 MB.
FEW_ROWS = 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For UTF-8 bytes: A-Z become a-z, other ASCII that is no letter or digit becomes a blank, the rest stays.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return utf8(text).translate(WORD_BYTES).split() if text else []


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def text_key(text: Column) -> Column:
    """Stands for a text in join keys; with the row's id beside it, equal keys mean equal rows."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.octet_length(F.coalesce(text, F.lit(""))))


def small(df: DataFrame) -> DataFrame:
    """Marks a table of a few numbers a row for broadcast if it has been counted to be small; what joins it is shuffled
    otherwise."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def free(columns: list[str], name: str) -> str:
    """The name, or the first of name_2, name_3, ... that no column has."""
    taken, out, k = {c.lower() for c in columns}, name, 1
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


ship(__name__)
