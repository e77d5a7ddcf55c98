"""External keyed collections: DataFrames by name, or read from what a source contract's config says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ast import Node
from ..errors import SourceFault
from ..types import declared, spark_type

ORDER = "__order"


class Catalog:
    """Registered collections win over config; config types are any DataFrameReader format, `file` being JSON."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: dict[str, tuple[DataFrame, str | None]] = {}

    def register(self, name: str, df: DataFrame, order: str | None = None) -> Catalog:
        """order: the column that says which of several rows with one key comes first; without one, rows have no order and
        the record that is smallest as JSON text does."""
        self.frames[name] = (df, order)
        return self

    def rows(self, contract: Node) -> DataFrame:
        """Keys, returned fields and an order column of a source contract."""
        for name in (contract.name, contract.source):
            if name in self.frames:
                df, order = self.frames[name]
                return self._bound(df, contract, F.col(f"`{order}`") if order else None)
        return self._read(contract)

    def _read(self, contract: Node) -> DataFrame:
        config = {k: v.value for k, v in contract.config}
        kind = config.pop("type", None)
        if kind in (None, "http", "https"):
            raise SourceFault(f"source {contract.name} has no reader for type {kind}", contract.pos)
        path, collection = config.pop("path", None), config.pop("collection", None)
        wanted = self._schema(contract)
        if kind in ("file", "json"):
            from pyspark.sql import types as T

            reader = self.spark.read.option("multiLine", True).options(**{k: str(v) for k, v in config.items()})
            if collection:
                whole = reader.schema(T.StructType([T.StructField(collection, T.ArrayType(wanted))])).json(path)
                df = whole.select(F.posexplode(f"`{collection}`").alias(ORDER, "r")).select(ORDER, "r.*")
                return self._bound(df, contract, F.col(ORDER))
            # The records of a file have its order, files that of their names.
            df = reader.schema(wanted).json(path)
            return self._bound(df, contract, F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place")))
        elif kind == "table":
            df = self.spark.table(path)
        else:
            reader = self.spark.read.format(kind).options(**{k: str(v) for k, v in config.items()})
            df = reader.load(path) if path else reader.load()
        return self._bound(df, contract, None)

    @staticmethod
    def _schema(contract: Node):
        from pyspark.sql import types as T

        named = {f.name: spark_type(declared(f.type)) for f in [*contract.keys, *contract.returns.fields]}
        return T.StructType([T.StructField(n, t) for n, t in named.items()])

    @staticmethod
    def _bound(df: DataFrame, contract: Node, order) -> DataFrame:
        have = {c.replace("_", "-"): c for c in df.columns}
        cols = []
        for f in {f.name: f for f in [*contract.keys, *contract.returns.fields]}.values():
            if f.name not in have:
                if f.type.name != "maybe":
                    raise SourceFault(f"source {contract.name} has no column {f.name}", f.pos)
                cols.append(F.lit(None).cast(spark_type(declared(f.type))).alias(f.name))
            else:
                cols.append(F.col(f"`{have[f.name]}`").cast(spark_type(declared(f.type))).alias(f.name))
        if order is None:
            order = F.to_json(F.struct(*cols))
        return df.select(*cols, order.alias(ORDER))
