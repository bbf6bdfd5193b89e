"""JSON helpers on Column expressions (no row-level Python).

Malformed input never raises: ``from_json`` runs in PERMISSIVE mode (fields
become NULL) and the VARIANT path uses ``try_parse_json``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUTRITION = T.StructType([
    T.StructField("calories", T.DoubleType()),
    T.StructField("protein_g", T.DoubleType()),
    T.StructField("carbohydrates_g", T.DoubleType()),
    T.StructField("fat_g", T.DoubleType()),
    T.StructField("fiber_g", T.DoubleType()),
])

INGREDIENT = T.StructType([
    T.StructField("ingredient", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("from_inventory", T.BooleanType()),
])
INGREDIENTS = T.ArrayType(INGREDIENT)

NUTRITION_FIELDS = ["calories", "protein_g", "carbohydrates_g", "fat_g", "fiber_g"]


def parse(c: Column | str, schema: T.DataType) -> Column:
    """Typed parse; bad text yields NULL fields instead of an error."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def nutrition(c: Column | str) -> Column:
    return parse(c, NUTRITION)


def path(c: Column | str, json_path: str, type_name: str) -> Column:
    """``PARSE_JSON(x):field::TYPE`` without raising on malformed input."""
    return F.try_variant_get(F.try_parse_json(c if isinstance(c, Column) else F.col(c)),
                             json_path, type_name)
