"""A stored client 360 that is looked up by any identifier of a client.

An agent types a client code (CU), a CJ code or a document number and sees the
client and its products at once. The store holds three tables: an identifier
map (kind, value, client), the client rows and the product lines. Each is
range-partitioned and sorted on what it is looked up by, so a file and each
row group in it cover a narrow range; values also have Parquet bloom filters.
A look-up of a few identifiers is a pushed filter on the map, then one on the
clients found: files and row groups outside are skipped, not read. Many
identifiers, or one that very many clients share, go through a join instead.

A kind may give a client several values, a value may stand for several
clients; each such pair is a row of the map and of the result. Identifiers
that nobody has find nothing. Values compare as text. Null values and clients
are left out of the map.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables of the store, by what they are sorted on.
IDENTIFIERS, CLIENTS, PRODUCTS = "identificadores", "clientes", "productos"
# Clients (and identifiers) up to which a look-up filters by literals.
MOST_LITERALS = 1000


def identifiers_of(clients: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """The identifier map from columns of a client table: (tipo, valor, key); ``kinds`` maps a kind to its column."""
    pairs = [F.struct(F.lit(kind).alias("tipo"), F.col(column).cast("string").alias("valor")) for kind, column in kinds.items()]
    rows = clients.where(F.col(key).isNotNull()).select(F.inline(F.array(*pairs)), F.col(key))
    return rows.where(F.col("valor").isNotNull()).distinct()


def write_lookup_store(
    identifiers: DataFrame, clients: DataFrame, products: DataFrame, path: str, key: str,
    files: int | None = None, row_group_bytes: int = 8 << 20,
) -> None:
    """Write the three tables below ``path``, each in ``files`` sorted ranges (default: the session's shuffle partitions).

    A client with very many products fills several files: product lines are
    ranged by the client and all their other columns.
    """
    options = {"parquet.block.size": str(row_group_bytes), "parquet.bloom.filter.enabled#valor": "true"}
    tables = {
        IDENTIFIERS: (identifiers, ["tipo", "valor", key]),
        CLIENTS: (clients, [key]),
        PRODUCTS: (products, [key, *[c for c in products.columns if c != key]]),
    }
    for name, (df, order) in tables.items():
        ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
        ranged.sortWithinPartitions(*order).write.mode("overwrite").options(**options).parquet(f"{path}/{name}")


class LookupStore:
    """A written store: ``clients`` and ``products`` of the clients that have any of the given identifiers."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def found(self, wanted: DataFrame | Iterable[tuple[str, str]]) -> DataFrame:
        """The rows of the identifier map for (tipo, valor) pairs, given as a list or as a table."""
        ids = self._table(IDENTIFIERS)
        if not isinstance(wanted, DataFrame):
            pairs = sorted({(k, str(v)) for k, v in wanted})
            asked = self.spark.createDataFrame(pairs, "tipo string, valor string")
            if len(pairs) <= MOST_LITERALS:
                ids = ids.where(F.col("tipo").isin([k for k, _ in pairs]) & F.col("valor").isin([v for _, v in pairs]))
            return ids.join(asked, ["tipo", "valor"], "left_semi")
        return ids.join(wanted.select("tipo", F.col("valor").cast("string").alias("valor")), ["tipo", "valor"], "left_semi")

    def _of(self, name: str, found: DataFrame, by_table: bool) -> DataFrame:
        table = self._table(name)
        if not by_table:
            keys = [r[0] for r in found.select(self.key).distinct().limit(MOST_LITERALS + 1).collect()]
            if len(keys) <= MOST_LITERALS:
                table = table.where(F.col(self.key).isin(keys))
        return found.join(table, self.key).select("tipo", "valor", *table.columns)

    def clients(self, wanted: DataFrame | Iterable[tuple[str, str]]) -> DataFrame:
        """The client row behind each identifier found: tipo, valor and the client's columns."""
        return self._of(CLIENTS, self.found(wanted), isinstance(wanted, DataFrame))

    def products(self, wanted: DataFrame | Iterable[tuple[str, str]]) -> DataFrame:
        """The product lines behind each identifier found."""
        return self._of(PRODUCTS, self.found(wanted), isinstance(wanted, DataFrame))
