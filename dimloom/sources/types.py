"""From source column types to Spark types, and typed ingest with counted rejects."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TypeMappingError(ValueError):
    """The source type has no Spark counterpart."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type_name: str
    max_length: int = 0
    precision: int = 0
    scale: int = 0
    nullable: bool = True


# Source types that map to one Spark type whatever their size.
SQL_SERVER_TYPES: dict[str, T.DataType] = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "SMALLINT": T.ShortType(),
    "TINYINT": T.ShortType(),  # 0 to 255, so a signed byte is too small
    "BIT": T.BooleanType(),
    "FLOAT": T.DoubleType(),
    "REAL": T.DoubleType(),
    "MONEY": T.DecimalType(19, 4),
    "SMALLMONEY": T.DecimalType(19, 4),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
    "DATETIME2": T.TimestampNTZType(),
    "SMALLDATETIME": T.TimestampNTZType(),
    "DATETIMEOFFSET": T.TimestampType(),
    "TIME": T.StringType(),
    "UNIQUEIDENTIFIER": T.StringType(),
    "VARCHAR": T.StringType(),
    "NVARCHAR": T.StringType(),
    "CHAR": T.StringType(),
    "NCHAR": T.StringType(),
    "BINARY": T.BinaryType(),
    "VARBINARY": T.BinaryType(),
}
ORACLE_TYPES: dict[str, T.DataType] = {
    "VARCHAR2": T.StringType(),
    "NVARCHAR2": T.StringType(),
    "CHAR": T.StringType(),
    "NCHAR": T.StringType(),
    "RAW": T.BinaryType(),
    "DATE": T.TimestampNTZType(),  # carries a time of day
    "FLOAT": T.DoubleType(),
    "BINARY_FLOAT": T.DoubleType(),
    "BINARY_DOUBLE": T.DoubleType(),
}


def spark_type(technology: str, type_name: str, precision: int = 0, scale: int = 0) -> T.DataType:
    name = type_name.upper().strip()
    if technology == "sql_server":
        if name in ("DECIMAL", "NUMERIC"):
            return T.DecimalType(precision or 18, scale)
        if name in SQL_SERVER_TYPES:
            return SQL_SERVER_TYPES[name]
    elif technology == "oracle":
        if name == "NUMBER":
            if not precision:
                return T.DecimalType(38, 10)
            if scale == 0 and precision <= 18:
                return T.ShortType() if precision <= 4 else T.IntegerType() if precision <= 9 else T.LongType()
            return T.DecimalType(precision, scale)
        if name.startswith("TIMESTAMP"):
            return T.TimestampNTZType()
        if name in ORACLE_TYPES:
            return ORACLE_TYPES[name]
    else:
        raise TypeMappingError(f"unsupported source technology: {technology}")
    raise TypeMappingError(f"unsupported source type for {technology}: {type_name}")


def text_length(technology: str, spec: ColumnSpec) -> int | None:
    """Declared length in characters: N-types of SQL Server are measured in bytes, -1 is unbounded."""
    if spec.max_length <= 0:
        return None
    halve = technology == "sql_server" and spec.type_name.upper() in ("NVARCHAR", "NCHAR")
    return spec.max_length // 2 if halve else spec.max_length


def struct_from_specs(technology: str, specs: Sequence[ColumnSpec]) -> T.StructType:
    fields = []
    for spec in specs:
        kind = spark_type(technology, spec.type_name, spec.precision, spec.scale)
        meta = {"source_type": spec.type_name.upper()}
        length = text_length(technology, spec)
        if length is not None and isinstance(kind, (T.StringType, T.BinaryType)):
            meta["max_length"] = length
        fields.append(T.StructField(spec.name, kind, spec.nullable, meta))
    return T.StructType(fields)


def typed_ingest(df: DataFrame, technology: str, specs: Sequence[ColumnSpec], *,
                 empty_as_null: bool = False) -> DataFrame:
    """Cast text columns to their declared types.

    A value that does not fit becomes NULL and is counted in ``_rejected``; a blank-padded
    CHAR loses its padding.
    """
    out, rejected = [], F.lit(0)
    for field in struct_from_specs(technology, specs):
        raw = F.col(f"`{field.name}`")
        if field.metadata["source_type"] in ("CHAR", "NCHAR"):
            raw = F.rtrim(raw)
        if empty_as_null:
            raw = F.nullif(raw, F.lit(""))
        typed = raw if isinstance(field.dataType, T.StringType) else raw.try_cast(field.dataType)
        lost = raw.isNotNull() & typed.isNull()
        if "max_length" in field.metadata and isinstance(field.dataType, T.StringType):
            too_long = F.length(raw) > field.metadata["max_length"]
            lost = F.coalesce(too_long, F.lit(False))
            typed = F.when(~lost, raw)
        out.append(typed.alias(field.name))
        rejected = rejected + lost.cast("int")
    return df.select(*out, rejected.alias("_rejected"))


def reject_counts(df: DataFrame) -> DataFrame:
    """Rows read and values rejected, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum("_rejected"), F.lit(0)).alias("rejected_values"),
                  F.count_if(F.col("_rejected") > 0).alias("rows_with_rejects"))
