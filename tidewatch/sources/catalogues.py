"""Catalogues from CSV files, and back: columns under any of their names, target lists, blanks as unknown values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headers of a column of star numbers, in lower case.
STAR_NAMES = ("tic", "tic_id", "ticid", "tic id", "target_id", "target")


def star_name(text: Column) -> Column:
    """'TIC 12', '12' or ' tic12 ' as 'TIC 12'; null for anything else. Leading zeros go."""
    number = F.regexp_extract(F.trim(text), r"(?i)^(?:TIC)?\s*0*([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("TIC "), number))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("header", True).option("enforceSchema", False).csv(path)


def _cell(name: str) -> Column:
    return F.nullif(F.trim(F.col("`" + name.replace("`", "``") + "`")), F.lit(""))


def read_catalogue(spark: SparkSession, path: str, columns: dict[str, tuple[str, list[str]]], unknown_zero: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a CSV with a header, by name: (type, other names it goes by). Names are compared without case; of
    several present, the first with a value counts; an absent column is null. Lines that begin with # are left out. Blank
    cells, cells not of the type and NaN are null, and so is 0 or less in the columns of `unknown_zero`. Files read together
    must have one header."""
    raw = _lines(spark, path)
    have = {c.strip().lower(): c for c in raw.columns}

    def column(name: str) -> Column:
        kind, others = columns[name]
        cells = [_cell(have[n.lower()]).try_cast(kind) for n in [name, *others] if n.lower() in have]
        if kind in ("double", "float"):
            cells = [F.when(~F.isnan(c), c) for c in cells]
        value = F.coalesce(*cells) if cells else F.lit(None).cast(kind)
        return F.when(value > 0, value) if name in unknown_zero else value

    return raw.select(*[column(n).alias(n) for n in columns])


def read_targets(spark: SparkSession, path: str, names: tuple[str, ...] = STAR_NAMES) -> DataFrame:
    """(target_id, place): star names of a list, one a line, or of a CSV with a column under one of `names`; each once, where
    it first stands. Lines that begin with #, and those without a star name, are left out."""
    first = spark.read.option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    head = first.first()
    if head is None:
        return spark.createDataFrame([], "target_id string, place bigint")
    headed = [i for i, c in enumerate(head) if c is not None and c.strip().lower() in names]
    found = first.select(star_name(F.col(first.columns[headed[0] if headed else 0])).alias("target_id"), F.monotonically_increasing_id().alias("place"))
    return found.filter("target_id IS NOT NULL").groupBy("target_id").agg(F.min("place").alias("place"))


def kept_and_dropped(targets: DataFrame, excluded: DataFrame, key: str = "target_id") -> tuple[DataFrame, DataFrame]:
    """Targets that are not excluded, and those that are."""
    known = excluded.select(key).distinct()
    return targets.join(known, key, "left_anti"), targets.join(known, key, "left_semi")


def write_catalogue(rows: DataFrame, path: str, order: list[str], digits: int = 10) -> None:
    """A folder of CSV files with headers, in order: numbers with `digits` significant digits, unknown values blank.
    Columns of decisions that no row has (all null) should be dropped by columns_with_values() before."""
    kinds = dict(rows.dtypes)

    def cell(name: str) -> Column:
        c = F.col("`" + name.replace("`", "``") + "`")
        if kinds[name] not in ("double", "float"):
            return c.cast("string").alias(name)
        return F.when(~F.isnan(c), F.format_string(f"%.{digits}g", c.cast("double"))).alias(name)

    rows.orderBy(*order).select(*[cell(n) for n in rows.columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def columns_with_values(rows: DataFrame, optional: list[str]) -> list[str]:
    """rows' columns but for those of `optional` that are null in every row: one aggregation."""
    counts = rows.agg(*[F.count(c).alias(c) for c in optional]).first() if optional else None
    return [c for c in rows.columns if c not in optional or counts[c] > 0]


def missing(ids: DataFrame, known: DataFrame, key: str = "target_id") -> DataFrame:
    """Ids that a catalogue does not hold yet, each once. A looked-up id is known even where its row is blank."""
    return ids.select(key).distinct().join(known.select(key), key, "left_anti")
