"""The star store: transactions -> companies, goods -> categories.

A ``Store`` hands out DataFrames; operators ask for the fact columns they
need (``store.facts([...])``) so a store may build only the joins those
columns require.  Two stores exist: ``ParquetStore`` over a materialised
star (the production layout, fact partitioned by ``year, month``) and
``TestbedStore`` (``sources.testbed``) over the driver's tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.sources.commits import LOG, Commit, CommitLog, hadoop_path, read_dimension, read_table

FACT_PARTITIONS = ("year", "month")


class Store:
    """Interface: fact columns on request, three dimension tables."""

    spark: SparkSession

    def facts(self, columns: Sequence[str] | None = None, dates: tuple | None = None) -> DataFrame:  # pragma: no cover - interface
        """Fact columns.  ``dates`` = (from, to) tells a store laid out by date
        which part the caller will keep; the caller still filters exactly."""
        raise NotImplementedError

    def companies(self) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def goods(self) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def categories(self) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def attach_goods(self, df: DataFrame, goods_cols: dict[str, str] | None = None, category_col: str | None = "category") -> DataFrame:
        """``df`` ⟕ goods ⟕ categories on ``goods_id``, adding the goods
        columns ``{dim_column: output_name}`` and the category name.

        Two joins against the base dimensions, not one join against a
        pre-joined goods+category frame: Spark estimates a join's size as
        the product of its inputs, so a pre-joined dimension never looks
        small enough to broadcast and the fact side would be shuffled."""
        cols = goods_cols or {}
        g = self.goods().select("goods_id", "category_id", *[F.col(k).alias(v) for k, v in cols.items()])
        out = df.join(g, "goods_id", "left")
        if category_col:
            cats = self.categories().select("category_id", F.col("name").alias(category_col))
            out = out.join(cats, "category_id", "left")
        return out.drop("category_id")

    def goods_facts(self, columns: Sequence[str], goods_cols: dict[str, str], category_col: str | None = "category") -> DataFrame:
        """``facts(columns)`` with goods columns ``{dim_column: output_name}``
        and the category name, these joined to the lines before anything else
        is.  Spark takes a later filter on them into the goods, so only the
        lines it keeps are shuffled for the other joins."""
        lines = self.facts(list(dict.fromkeys([*columns, "goods_id"])))
        names = [*goods_cols.values(), *([category_col] if category_col else [])]
        return self.attach_goods(lines, goods_cols, category_col).select(*columns, *names)

    def import_facts(self, columns: Sequence[str]) -> DataFrame:
        """``facts(columns)`` for a job that moves every line: a store may join
        its tables in an order that shuffles the lines less."""
        return self.facts(columns)

    def goods_with_category(self) -> DataFrame:
        """goods ⟕ categories: goods_id, raw_name, short_name, hs_code,
        classified_by, category_id, category (name; NULL when unmatched)."""
        cats = self.categories().select("category_id", F.col("name").alias("category"))
        return self.goods().join(cats, "category_id", "left")


@dataclass
class FrameStore(Store):
    """A store over caller-supplied DataFrames (any source)."""

    spark: SparkSession
    transactions: DataFrame
    companies_df: DataFrame
    goods_df: DataFrame
    categories_df: DataFrame

    def facts(self, columns: Sequence[str] | None = None, dates: tuple | None = None) -> DataFrame:
        return self.transactions if columns is None else self.transactions.select(*columns)

    def companies(self) -> DataFrame:
        return self.companies_df

    def goods(self) -> DataFrame:
        return self.goods_df

    def categories(self) -> DataFrame:
        return self.categories_df


# table -> id column of each dimension
DIMENSIONS = {"companies": "company_id", "goods": "goods_id", "categories": "category_id"}


def read_store(spark: SparkSession, root: str, entries: Sequence[Commit]) -> dict[str, DataFrame | None]:
    """The tables of a store as of the given commits, None for those without rows."""
    root = root.rstrip("/")
    found = {"transactions": read_table(spark, root, "transactions", entries)}
    for name, key in DIMENSIONS.items():
        found[name] = read_dimension(spark, root, name, key, entries)
    return found


class ParquetStore(FrameStore):
    """Materialised star under ``root`` (S4 scans), as of the commits made
    when it was opened; what other jobs write meanwhile does not show."""

    def __init__(self, spark: SparkSession, root: str):
        root = root.rstrip("/")
        self.commits = CommitLog(spark, root).entries()
        found = read_store(spark, root, self.commits)
        missing = [n for n, df in found.items() if df is None]
        if missing:
            raise FileNotFoundError(f"no {', '.join(missing)} under {root}")
        super().__init__(spark, found["transactions"], found["companies"], found["goods"], found["categories"])
        self.root = root

    def facts(self, columns: Sequence[str] | None = None, dates: tuple | None = None) -> DataFrame:
        tx = self.transactions
        bounds = month_bounds(*dates) if dates else None
        if bounds is not None:
            tx = tx.filter(bounds)  # partition columns only: whole folders are skipped
        return tx if columns is None else tx.select(*columns)


def month_bounds(date_from=None, date_to=None) -> Column | None:
    """Condition on the partition columns ``year, month`` that holds for every
    date of an inclusive range (ISO dates; either bound optional)."""
    cond = None
    if date_from is not None:
        y, m = int(str(date_from)[:4]), int(str(date_from)[5:7] or 1)
        cond = (F.col("year") > y) | ((F.col("year") == y) & (F.col("month") >= m))
    if date_to is not None:
        y, m = int(str(date_to)[:4]), int(str(date_to)[5:7] or 12)
        upper = (F.col("year") < y) | ((F.col("year") == y) & (F.col("month") <= m))
        cond = upper if cond is None else cond & upper
    return cond


def write_store(store: Store, root: str, mode: str = "overwrite", partitions: int | None = None) -> ParquetStore:
    """Write the star as Parquet.

    The fact table is partitioned by ``year, month``; roll-ups with a date
    range pass it to ``facts``, which turns it into month bounds that skip
    whole folders.  Rows are range-partitioned on ``(year, month,
    company_id)`` first: each write task owns a contiguous slice of months
    and companies, so a folder gets few, large files sorted by company
    (Parquet min/max statistics then skip row groups for importer filters),
    and a month that holds a third of the data is still split across many
    tasks by company.  ``partitions`` defaults to the shuffle partitions;
    size it to about one task per 128-512 MB of facts."""
    spark = store.spark
    root = root.rstrip("/")
    if mode == "overwrite":  # the commits of a store that is replaced go first
        path, fs = hadoop_path(spark, f"{root}/{LOG}")
        fs.delete(path, True)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = store.facts()
    (
        facts.repartitionByRange(n, *FACT_PARTITIONS, "company_id")
        .sortWithinPartitions(*FACT_PARTITIONS, "company_id", "date")
        .write.mode(mode)
        .partitionBy(*FACT_PARTITIONS)
        .parquet(f"{root}/transactions")
    )
    store.companies().write.mode(mode).parquet(f"{root}/companies")
    store.goods().write.mode(mode).parquet(f"{root}/goods")
    store.categories().write.mode(mode).parquet(f"{root}/categories")
    if mode == "overwrite":  # what an import adds for its lines: keys for the next import, states for the roll-up cache
        from tradelens.operators.dedup import write_line_keys
        from tradelens.operators.rollup_states import STATE_FACTS, TABLE, fact_states

        written = spark.read.parquet(f"{root}/transactions")
        fact_states(written.select(*STATE_FACTS)).write.mode(mode).partitionBy("dim").parquet(f"{root}/{TABLE}")
        write_line_keys(written, written.count(), f"{root}/line_keys")
    return ParquetStore(spark, root)
