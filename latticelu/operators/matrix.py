"""Element-level sparse matrices as DataFrames (i, j, v)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import exclusive_scan, norm2

#: Fixed value: what a missing diagonal entry is given.
DIAGONAL_FILL = 1e-8


@dataclass(frozen=True)
class SparseMatrix:
    """Entries (i bigint, j bigint, v double), each position once, of an n x n matrix."""

    entries: DataFrame
    n: int

    @staticmethod
    def of(entries: DataFrame, n: int | None = None, check: bool = True) -> SparseMatrix:
        """Take entries in: duplicates are summed; nulls and indices outside 0..n-1 are errors.

        `n` defaults to the largest index plus one.  An empty matrix is an error.
        """
        rows = entries.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
        if check or n is None:
            bad = F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull()
            seen = rows.agg(F.count("*").alias("rows"), F.count_if(bad).alias("nulls"), F.min(F.least("i", "j")).alias("least"), F.max(F.greatest("i", "j")).alias("most")).first()
            if not seen["rows"] and n is None:
                raise ValueError("the matrix is empty")
            if seen["nulls"]:
                raise ValueError(f"{seen['nulls']} entries have a null index or value")
            if seen["rows"] and (seen["least"] < 0 or n is not None and seen["most"] >= n):
                raise ValueError(f"indices from {seen['least']} to {seen['most']} don't fit n = {n}")
            n = seen["most"] + 1 if n is None else n
        if n < 1:
            raise ValueError("n must be positive")
        return SparseMatrix(rows.groupBy("i", "j").agg(F.sum("v").alias("v")), n)

    def transpose(self) -> SparseMatrix:
        return SparseMatrix(self.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.n)

    def pattern(self) -> DataFrame:
        """(i, j) of A + A^T."""
        e = self.entries
        return e.select("i", "j").union(e.select("j", "i")).distinct()

    def adjacency(self) -> DataFrame:
        """Edges (i, j) of A + A^T without the diagonal."""
        e = self.entries.filter("i <> j")
        return e.select("i", "j").union(e.select("j", "i")).distinct()

    def lower(self) -> SparseMatrix:
        return SparseMatrix(self.entries.filter("i >= j"), self.n)

    def upper(self) -> SparseMatrix:
        return SparseMatrix(self.entries.filter("i <= j"), self.n)

    def indices(self) -> DataFrame:
        """(i) from 0 to n-1."""
        return self.entries.sparkSession.range(self.n).select(F.col("id").alias("i"))

    def missing_diagonal(self) -> DataFrame:
        have = self.entries.filter("i = j").select("i")
        return self.indices().join(have, "i", "left_anti")

    def ensure_diagonal(self, value: float = DIAGONAL_FILL) -> SparseMatrix:
        added = self.missing_diagonal().select("i", F.col("i").alias("j"), F.lit(float(value)).alias("v"))
        return SparseMatrix(self.entries.unionByName(added), self.n)

    def row_sums(self) -> DataFrame:
        """(i, v): rows without entries are absent."""
        return self.entries.groupBy("i").agg(F.sum("v").alias("v"))

    def column_maxima(self) -> DataFrame:
        """(j, m): largest modulus in each column that has entries."""
        return self.entries.groupBy("j").agg(F.max(F.abs("v")).alias("m"))

    def multiply(self, vec: DataFrame) -> DataFrame:
        """(i, v) of A x for x = (i, v)."""
        x = vec.select(F.col("i").alias("j"), F.col("v").alias("x"))
        return self.entries.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))

    def scale(self, rows: DataFrame | None = None, columns: DataFrame | None = None) -> SparseMatrix:
        """diag(rows) A diag(columns), each (i, s); an index without a scale keeps 1."""
        e = self.entries
        if rows is not None:
            e = e.join(rows.select("i", "s"), "i", "left").select("i", "j", (F.col("v") * F.coalesce("s", F.lit(1.0))).alias("v"))
        if columns is not None:
            e = e.join(columns.select(F.col("i").alias("j"), "s"), "j", "left").select("i", "j", (F.col("v") * F.coalesce("s", F.lit(1.0))).alias("v"))
        return SparseMatrix(e, self.n)

    def permute(self, rows: DataFrame | None = None, columns: DataFrame | None = None) -> SparseMatrix:
        """Move row old to row new and column old to column new, for perms (old, new)."""
        e = self.entries
        if rows is not None:
            e = e.join(rows.select(F.col("old").alias("i"), "new"), "i").select(F.col("new").alias("i"), "j", "v")
        if columns is not None:
            e = e.join(columns.select(F.col("old").alias("j"), "new"), "j").select("i", F.col("new").alias("j"), "v")
        return SparseMatrix(e, self.n)

    def column_pointers(self) -> DataFrame:
        """(j, cnt, ptr): entries of each column from 0 to n-1 and of all before it."""
        count = self.entries.groupBy("j").agg(F.count("*").alias("cnt"))
        full = self.indices().select(F.col("i").alias("j")).join(count, "j", "left").select("j", F.coalesce("cnt", F.lit(0)).alias("cnt"))
        return exclusive_scan(full, "j", "cnt", "ptr")

    def compressed_rows(self) -> DataFrame:
        """(i, columns, values): each row's entries by column."""
        rows = self.entries.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
        return rows.select("i", F.col("r.j").alias("columns"), F.col("r.v").alias("values"))

    def scatter_into(self, pattern: DataFrame) -> SparseMatrix:
        """Values on a larger pattern (i, j), zero where the matrix has none."""
        e = pattern.join(self.entries, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
        return SparseMatrix(e, self.n)

    def residual(self, x: DataFrame, b: DataFrame) -> DataFrame:
        """One row, residual: |Ax - b| / |b|, with compensated norms."""
        ax = self.multiply(x).select("i", F.col("v").alias("ax"))
        joined = ax.join(b.select("i", F.col("v").alias("bv")), "i", "full_outer")
        diff = joined.select("i", (F.coalesce("ax", F.lit(0.0)) - F.coalesce("bv", F.lit(0.0))).alias("v"))
        return norm2(diff).select(F.col("norm").alias("r")).crossJoin(norm2(b)).select((F.col("r") / F.col("norm")).alias("residual"))


def full_from_half(lower: DataFrame) -> DataFrame:
    """A symmetric pattern (i, j) from its lower half."""
    return lower.select("i", "j").union(lower.filter("i <> j").select("j", "i"))


def permute_vector(vec: DataFrame, perm: DataFrame) -> DataFrame:
    """b'[new] = b[old]."""
    return vec.withColumnRenamed("i", "old").join(perm, "old").select(*[c for c in vec.columns if c not in ("i", "v")], F.col("new").alias("i"), "v")


def scale_vector(vec: DataFrame, scale: DataFrame) -> DataFrame:
    return vec.join(scale, "i", "left").select(*[c for c in vec.columns if c != "v"], (F.col("v") * F.coalesce("s", F.lit(1.0))).alias("v"))


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("new").alias("old"), F.col("old").alias("new"))
