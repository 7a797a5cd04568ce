"""Typed reads of dynamic attributes.

A reader answers only when the JSON value has the asked type: the text "5" is
not a number and a number is not a text. On VARIANT attributes the type is
checked per value; on STRUCT attributes it is known from the schema, so the
read is a plain column that Spark prunes into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


class Readers:
    """Attribute and envelope readers bound to the schema of one DataFrame."""

    def __init__(self, df: DataFrame, alias: str | None = None):
        self.columns = {f.name: f.dataType for f in df.schema.fields}
        self.prefix = f"{alias}." if alias else ""
        self.attributes = self.columns.get("attributes")

    def col(self, name: str) -> Column:
        """Envelope column, null where the table does not carry it."""
        if name in self.columns:
            return F.col(self.prefix + name)
        return _null("string")

    # -- one value -----------------------------------------------------------

    def _lookup(self, key: str, where: str = "attributes") -> tuple[Column, T.DataType | None]:
        """(value, type); type None means a VARIANT value."""
        kind = self.columns.get(where)
        if isinstance(kind, T.VariantType):
            return F.try_variant_get(F.col(self.prefix + where), f"$.{key}", "variant"), None
        if isinstance(kind, T.StructType) and key in kind.fieldNames():
            return F.col(f"{self.prefix}{where}.{key}"), kind[key].dataType
        return _null("string"), T.NullType()

    def _num(self, key: str) -> Column:
        value, kind = self._lookup(key)
        if kind is None:
            shape = F.schema_of_variant(value)
            read = F.try_variant_get(value, "$", "double")
            return F.when(shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL"), read)
        if isinstance(kind, T.NumericType):
            read = value.cast("double")
            finite = ~F.isnan(read) & (F.abs(read) != float("inf"))
            return F.when(finite, read) if isinstance(kind, (T.DoubleType, T.FloatType)) else read
        return _null("double")

    def _int(self, key: str) -> Column:
        value, kind = self._lookup(key)
        if kind is None:
            shape = F.schema_of_variant(value)
            number = F.try_variant_get(value, "$", "double")
            whole = F.when(number == F.floor(number), F.try_variant_get(value, "$", "bigint"))
            return F.when(shape == "BIGINT", F.try_variant_get(value, "$", "bigint")).when(
                shape.startswith("DECIMAL") | (shape == "DOUBLE"), whole
            )
        if isinstance(kind, T.IntegralType):
            return value.cast("bigint")
        if isinstance(kind, T.NumericType):
            number = value.cast("double")
            return F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number).try_cast("bigint")
        return _null("bigint")

    def _text(self, key: str, where: str = "attributes") -> Column:
        value, kind = self._lookup(key, where)
        if kind is None:
            return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        return value if isinstance(kind, T.StringType) else _null("string")

    # -- public readers: the first spelling that answers wins ----------------

    def num(self, *keys: str) -> Column:
        """Finite number as DOUBLE."""
        return F.coalesce(*[self._num(k) for k in keys])

    def whole(self, *keys: str) -> Column:
        """Integral number as BIGINT (5.0 counts)."""
        return F.coalesce(*[self._int(k) for k in keys])

    def count(self, key: str) -> Column:
        """Integral number >= 0."""
        value = self._int(key)
        return F.when(value >= 0, value)

    def text(self, *keys: str) -> Column:
        """Any string, the empty one included."""
        return F.coalesce(*[self._text(k) for k in keys])

    def name(self, *keys: str) -> Column:
        """Non-empty string."""
        return F.coalesce(*[F.nullif(self._text(k), F.lit("")) for k in keys])

    def flag(self, key: str) -> Column:
        value, kind = self._lookup(key)
        if kind is None:
            return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        return value if isinstance(kind, T.BooleanType) else _null("boolean")

    def has(self, key: str) -> Column:
        """The key is there, JSON null included (a struct column cannot tell null from absent)."""
        value, kind = self._lookup(key)
        if isinstance(kind, T.NullType):
            return F.lit(False)
        return value.isNotNull()

    def is_null_value(self, key: str) -> Column:
        """The key is there and holds JSON null."""
        value, kind = self._lookup(key)
        if kind is None:
            return F.coalesce(F.schema_of_variant(value) == "VOID", F.lit(False))
        return F.lit(False)

    def is_set(self, key: str) -> Column:
        """The key holds something other than null, "" or a redaction marker."""
        value, kind = self._lookup(key)
        if isinstance(kind, T.NullType):
            return F.lit(False)
        text = self._text(key)
        blank = F.coalesce((text == "") | text.rlike(r"(?i)^\s*\[redacted") | text.rlike("(?i)^sha256:"), F.lit(False))
        if kind is None:
            return value.isNotNull() & ~self.is_null_value(key) & ~blank
        return value.isNotNull() & ~blank

    def extra_text(self, key: str) -> Column:
        """Non-empty top-level text outside the fixed envelope."""
        if isinstance(self.columns.get(key), T.StringType):
            return F.nullif(F.col(self.prefix + key), F.lit(""))
        return F.nullif(self._text(key, "extra"), F.lit(""))

    def loose_id(self, key: str, where: str = "attributes") -> Column:
        """Non-empty text, or an integral number as text."""
        if where == "envelope":
            if isinstance(self.columns.get(key), (T.StringType, T.IntegralType)):
                return F.nullif(F.col(self.prefix + key).cast("string"), F.lit(""))
            where = "extra"
        value, kind = self._lookup(key, where)
        if kind is None:
            shape = F.schema_of_variant(value)
            number = F.try_variant_get(value, "$", "double")
            return F.when(shape == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit(""))).when(
                (shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL")) & (number == F.floor(number)),
                F.try_variant_get(value, "$", "bigint").cast("string"),
            )
        if isinstance(kind, T.StringType):
            return F.nullif(value, F.lit(""))
        if isinstance(kind, T.IntegralType):
            return value.cast("string")
        return _null("string")
