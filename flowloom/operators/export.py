"""Rows as JSON lines that are the same for the same content: keys in order at every level, nulls written, rows in order of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def ordered(value: Column, kind: DataType) -> Column:
    """The value with the fields of all structs and the keys of all maps in order."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[ordered(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("key"), ordered(value[k], kind.valueType).alias("value"))))
    return value


def json_lines(rows: DataFrame, key: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """(key..., json) of every row; columns in `drop` (a store's vectors, say) stay out."""
    kinds = {f.name: f.dataType for f in rows.schema.fields if f.name not in drop}
    line = F.to_json(F.struct(*[ordered(F.col(c), kinds[c]).alias(c) for c in sorted(kinds)]), {"ignoreNullFields": "false"})
    return rows.select(*key, line.alias("json"))


def write_json(rows: DataFrame, path: str, key: list[str], drop: tuple[str, ...] = ()) -> None:
    """Writes the lines as text files in the order of the key, range by range."""
    lines = json_lines(rows, key, drop)
    lines.repartitionByRange(*key).sortWithinPartitions(*key).select("json").write.mode("overwrite").text(path)
