"""Vector expressions over array columns. They stay in the JVM and add up from left to right in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What 1 is for a unit vector of each element type (fixed values: the largest integer of the type, 1 for floats).
BASE = {"float": 1, "byte": 127, "ubyte": 255, "short": 32767}
#: A vector shorter than this has no direction.
TINY_NORM = 1e-6
#: Two vectors closer than this are the same.
SAME = 1e-6


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _double(x: Column) -> Column:
    return x.cast("double")


def l2(x: Column | str, y: Column | str) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(x, y, lambda a, b: (_double(a) - _double(b)) * (_double(a) - _double(b))))


def dot(x: Column | str, y: Column | str) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: _double(a) * _double(b)))


def cosine(x: Column | str, y: Column | str, base: int = 1) -> Column:
    """base^2 - x.y: one minus the cosine only where both sides are of unit length. Queries are not normalised."""
    return F.lit(float(base * base)) - dot(x, y)


#: Metrics by name. The inner product uses the same formula; only the stored vectors are not normalised for it.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2, "cosine": cosine, "ip": cosine}


def norm(x: Column | str) -> Column:
    return F.sqrt(dot(x, x))


def normalized(x: Column | str, base: int = 1) -> Column:
    """Unit length times base; a vector without direction becomes the constant base / sqrt(d)."""
    x = F.col(x) if isinstance(x, str) else x
    constant = F.array_repeat(F.lit(float(base)) / F.sqrt(F.size(x)), F.size(x))
    # the length is bound to a variable, so that it is computed once and not for each component
    by = lambda n: F.when(n < TINY_NORM, constant).otherwise(F.transform(x, lambda v: _double(v) / n * base))
    return F.element_at(F.transform(F.array(norm(x)), by), 1)


def seeded(seed: int | str, *columns: str) -> Column:
    """A hash for seeded orders that other engines have too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def similarity_of(distance: Column | str, base: int = 1) -> Column:
    distance = F.col(distance) if isinstance(distance, str) else distance
    return 1.0 - distance / float(base * base)


def distance_of(similarity: Column | str, base: int = 1) -> Column:
    similarity = F.col(similarity) if isinstance(similarity, str) else similarity
    return (1.0 - similarity) * float(base * base)


def plus(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(x, y, lambda a, b: _double(a) + _double(b))


def minus(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(x, y, lambda a, b: _double(a) - _double(b))


def parsed(text: Column | str, delimiter: str = "|") -> Column:
    """'1|2.5|3' to an array; empty items are skipped, anything that is not a number is null."""
    items = F.filter(F.split(text, f"\\{delimiter}"), lambda s: F.trim(s) != "")
    return F.transform(items, lambda s: F.trim(s).try_cast("float"))


def formatted(x: Column | str, delimiter: str = "|") -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), delimiter)


def hamming(x: Column | str, y: Column | str) -> Column:
    """In how many components two vectors differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.when(a != b, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)


def jaccard(x: Column | str, y: Column | str) -> Column:
    """1 - |x & y| / |x | y| of two sets given as arrays."""
    return 1.0 - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def offsets(rows: DataFrame, key: str, text: str, delimiter: str = "\n") -> DataFrame:
    """key, line, offset, length (bytes) of the parts of a text between delimiters."""
    parts = F.transform(F.split(text, f"\\Q{delimiter}\\E", -1), F.octet_length)
    before = lambda i: F.aggregate(F.slice("parts_", 1, i), F.lit(0).cast("long"), lambda s, n: s + n + len(delimiter.encode()))
    split = rows.select(key, parts.alias("parts_")).filter("parts_ IS NOT NULL")
    found = split.select(key, "parts_", F.posexplode("parts_").alias("line", "length"))
    return found.select(key, F.col("line").cast("long").alias("line"), before(F.col("line")).alias("offset"), F.col("length").cast("long").alias("length"))


def checksum(data: Column | str) -> Column:
    """XOR of the bytes of a binary column."""
    data = F.col(data) if isinstance(data, str) else data
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1)
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s.bitwiseXOR(F.conv(p, 16, 10).cast("long"))).cast("int")


def row_bytes(dimension: int, element_bytes: int = 4, metadata_bytes: int = 0, neighbours: int = 32, trees: int = 1) -> int:
    """Memory of one row in an index: vector, metadata, neighbour list and tree nodes of 12 bytes."""
    return dimension * element_bytes + metadata_bytes + 8 + 4 * neighbours + 12 * trees


def rows_in(memory: int, **layout: int) -> int:
    return memory // row_bytes(**layout)
