"""Registered queries of the solver's operators, each with its DuckDB SQL where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import complexes as cx
from .functions import scans
from .operators import blocks, factor, ordering, solve, symbolic
from .operators.matrix import SparseMatrix, full_from_half, inverse, permute_vector, scale_vector
from .plans.solver import Solver, ones_rhs
from .sources import matrix_market as mm
from .storage import new_path

NB = 32
PROCESSES = 6
P, Q = scans.process_grid(PROCESSES)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def _r(name: str, places: int = 6, alias: str | None = None):
    """Rounded, without a negative zero."""
    return (F.round(F.col(name), places) + 0.0).alias(alias or name)


# ---------------------------------------------------------------- elements


@query(f"WITH {fx.HIERARCHY_SQL} SELECT i, j, v FROM m")
def mat_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return fx.hierarchy(spark, d).entries


@query(f"WITH {fx.RATINGS_SQL} SELECT j AS i, i AS j, v FROM m")
def mat_transpose(spark: SparkSession, d: str) -> DataFrame:
    return SparseMatrix(fx.ratings(spark, d), 1).transpose().entries


@query(f"WITH {fx.TRANSITIONS_SQL} SELECT i, j FROM t UNION SELECT j, i FROM t")
def mat_sym_pattern(spark: SparkSession, d: str) -> DataFrame:
    return SparseMatrix(fx.transitions(spark, d), 1).pattern()


@query(f"WITH {fx.TRANSITION_MATRIX_SQL} SELECT i, j FROM m WHERE i <> j UNION SELECT j, i FROM m WHERE i <> j")
def mat_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return fx.transition_matrix(spark, d).adjacency()


@query(f"WITH {fx.TRANSITIONS_SQL} SELECT i, j, v FROM t UNION ALL SELECT r.i, r.i, 1e-8 FROM range((SELECT max(user_id) + 1 FROM events)) AS r(i)")
def mat_add_diag(spark: SparkSession, d: str) -> DataFrame:
    n = fx.transition_matrix(spark, d).n
    return SparseMatrix(fx.transitions(spark, d), n).ensure_diagonal().entries


@query(f"WITH {fx.TRANSITIONS_SQL} SELECT r.i FROM range((SELECT max(user_id) + 1 FROM events)) AS r(i) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.i = r.i AND t.j = r.i)")
def mat_missing_diag(spark: SparkSession, d: str) -> DataFrame:
    return SparseMatrix(fx.transitions(spark, d), fx.transition_matrix(spark, d).n).missing_diagonal()


@query("SELECT l_partkey::BIGINT AS i, l_suppkey::BIGINT AS j, sum(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY 1, 2")
def mat_sum_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    return SparseMatrix.of(rows).entries


@query(f"WITH {fx.RATINGS_SQL} SELECT i, sum(v) AS v FROM m GROUP BY i")
def mat_rowsum(spark: SparkSession, d: str) -> DataFrame:
    return SparseMatrix(fx.ratings(spark, d), 1).row_sums()


@query(f"WITH {fx.RATINGS_SQL} SELECT j, max(abs(v)) AS m FROM m GROUP BY j")
def mat_colmax(spark: SparkSession, d: str) -> DataFrame:
    return SparseMatrix(fx.ratings(spark, d), 1).column_maxima()


@query(f"WITH {fx.RATINGS_SQL} SELECT m.i, round(sum(m.v * s.s_acctbal), 4) + 0.0 AS v FROM m JOIN supplier s ON s.s_suppkey = m.j GROUP BY m.i")
def mat_spmv(spark: SparkSession, d: str) -> DataFrame:
    x = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return SparseMatrix(fx.ratings(spark, d), 1).multiply(x).select("i", _r("v", 4))


@query(f"WITH {fx.RATINGS_SQL}, c AS (SELECT j, max(abs(v)) AS s FROM m GROUP BY j), r AS (SELECT i, sum(v) AS s FROM m GROUP BY i) SELECT m.i, m.j, round(m.v / r.s / c.s, 9) + 0.0 AS v FROM m JOIN r USING (i) JOIN c USING (j)")
def mat_scale(spark: SparkSession, d: str) -> DataFrame:
    m = SparseMatrix(fx.ratings(spark, d), 1)
    rows = m.row_sums().select("i", (1 / F.col("v")).alias("s"))
    cols = m.column_maxima().select(F.col("j").alias("i"), (1 / F.col("m")).alias("s"))
    return m.scale(rows, cols).entries.select("i", "j", _r("v", 9))


@query(f"WITH {fx.HIERARCHY_SQL} SELECT {fx.HIERARCHY_N} - 1 - i AS i, {fx.HIERARCHY_N} - 1 - j AS j, v FROM m")
def mat_permute(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    perm = m.indices().select(F.col("i").alias("old"), (F.lit(m.n - 1) - F.col("i")).alias("new"))
    return m.permute(perm, perm).entries


@query(f"WITH {fx.HIERARCHY_SQL} SELECT {fx.HIERARCHY_N} - 1 - (30 + s_suppkey) AS i, round(s_acctbal * 2, 6) + 0.0 AS v FROM supplier")
def vec_permute_scale(spark: SparkSession, d: str) -> DataFrame:
    m, b = fx.hierarchy(spark, d), fx.account_rhs(spark, d)
    perm = m.indices().select(F.col("i").alias("old"), (F.lit(m.n - 1) - F.col("i")).alias("new"))
    back = permute_vector(permute_vector(b, perm), inverse(perm))
    return permute_vector(scale_vector(back, m.indices().select("i", F.lit(2.0).alias("s"))), perm).select("i", _r("v"))


@query(f"WITH {fx.RATINGS_SQL}, c AS (SELECT r.j, count(m.j) AS cnt FROM range((SELECT max(j) + 1 FROM m)) AS r(j) LEFT JOIN m ON m.j = r.j GROUP BY r.j) SELECT j, cnt, (coalesce(sum(cnt) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS ptr FROM c")
def mat_nnz_hist_scan(spark: SparkSession, d: str) -> DataFrame:
    e = fx.ratings(spark, d)
    return SparseMatrix(e, e.agg(F.max("j")).first()[0] + 1).column_pointers()


@query(f"WITH {fx.RATINGS_SQL}, c AS (SELECT i, count(*) AS cnt FROM m GROUP BY i), s AS (SELECT i, cnt, coalesce(sum(cnt) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) SELECT i, cnt, least(floor(b * 8 / (SELECT sum(cnt) FROM c)), 7)::INTEGER AS part FROM s")
def mat_balanced_ranges(spark: SparkSession, d: str) -> DataFrame:
    counts = fx.ratings(spark, d).groupBy("i").agg(F.count("*").alias("cnt"))
    return scans.balanced_ranges(counts, "i", "cnt", 8)


@query(f"WITH {fx.RATINGS_SQL} SELECT i, count(*) AS cnt, min(j) AS first_column, sum(j) AS columns, sum(v) AS total FROM m GROUP BY i")
def mat_compressed_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = SparseMatrix(fx.ratings(spark, d), 1).compressed_rows()
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return rows.select("i", F.size("columns").cast("bigint").alias("cnt"), F.get("columns", F.lit(0)).alias("first_column"), F.aggregate("columns", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("columns"), total.alias("total"))


@query("SELECT round(sqrt(sum(s_acctbal * s_acctbal)), 4) AS norm FROM supplier")
def mat_norm2(spark: SparkSession, d: str) -> DataFrame:
    return scans.norm2(fx.account_rhs(spark, d)).select(_r("norm", 4))


@query(f"WITH {fx.HIERARCHY_SQL} SELECT i, j, v FROM m WHERE i >= j")
def mat_lower(spark: SparkSession, d: str) -> DataFrame:
    return fx.hierarchy(spark, d).lower().entries


@query(f"WITH {fx.HIERARCHY_SQL} SELECT i, j, v FROM m WHERE i <= j")
def mat_upper(spark: SparkSession, d: str) -> DataFrame:
    return fx.hierarchy(spark, d).upper().entries


@query(f"WITH {fx.HIERARCHY_SQL} SELECT i, j FROM m")
def mat_half_to_full(spark: SparkSession, d: str) -> DataFrame:
    return full_from_half(fx.hierarchy(spark, d).lower().entries)


@query(f"WITH {fx.HIERARCHY_SQL}, ax AS (SELECT m.i, sum(m.v * (1 + m.j % 7)) AS v FROM m GROUP BY m.i), b AS (SELECT i, sum(v) AS v FROM m GROUP BY i) SELECT round(sqrt(sum((ax.v - b.v) * (ax.v - b.v))) / sqrt(sum(b.v * b.v)), 6) AS residual FROM ax JOIN b USING (i)")
def mat_residual(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    return m.residual(m.indices().select("i", (1.0 + F.col("i") % 7).alias("v")), m.row_sums()).select(_r("residual"))


_COMPLEX_PARTS = {
    "product": ("a * c - b * d", "a * d + b * c"),
    "quotient": ("(a * c + b * d) / (c * c + d * d)", "(b * c - a * d) / (c * c + d * d)"),
    "total": ("a + c", "b + d"),
    "conjugate": ("a", "-b"),
    "root": ("abs(a)", "CASE WHEN a < 0 THEN -b ELSE b END"),  # of the square of a + bi
}


@query(
    "WITH s AS (SELECT s_suppkey::BIGINT AS i, s_acctbal::DOUBLE AS a, s_suppkey + 1.0 AS b, s_nationkey - 7.0 AS c, s_suppkey % 5 + 0.5 AS d FROM supplier) SELECT i, "
    + ", ".join(f"round(({re})::DOUBLE, 4) + 0.0 AS {name}_re, round(({im})::DOUBLE, 4) + 0.0 AS {name}_im" for name, (re, im) in _COMPLEX_PARTS.items())
    + ", round(sqrt(a * a + b * b), 4) AS size FROM s"
)
def fun_complex(spark: SparkSession, d: str) -> DataFrame:
    """(a + bi) with (c + di): every function on its own."""
    key = F.col("s_suppkey")
    s = fx.table(spark, d, "supplier").select(key.cast("bigint").alias("i"), cx.complex_of(F.col("s_acctbal"), key + 1.0).alias("x"), cx.complex_of(F.col("s_nationkey") - 7.0, key % 5 + 0.5).alias("y"))
    x, y = F.col("x"), F.col("y")
    made = {"product": cx.multiply(x, y), "quotient": cx.divide(x, y), "total": cx.add(x, y), "conjugate": cx.conjugate(x), "root": cx.square_root(cx.multiply(x, x))}
    parts = [(F.round(c[part], 4) + 0.0).alias(f"{name}_{part}") for name, c in made.items() for part in ("re", "im")]
    return s.select("i", *parts, F.round(cx.modulus(x), 4).alias("size"))


# ---------------------------------------------------------------- blocks

_BLOCKED = f"{fx.TRANSITION_MATRIX_SQL}, b AS (SELECT (i // {NB})::INTEGER AS bi, (j // {NB})::INTEGER AS bj, count(*) AS nnz FROM m GROUP BY 1, 2)"
_SPARSE_BLOCKS = f"{fx.HIERARCHY_SQL}, b AS (SELECT (i // {NB // 4})::INTEGER AS bi, (j // {NB // 4})::INTEGER AS bj, count(*) AS nnz FROM m GROUP BY 1, 2)"
_UPDATES = ", u AS (SELECT l.bj AS level, l.bi, r.bj FROM b l JOIN b r ON l.bj = r.bi AND l.bi > l.bj AND r.bi < r.bj JOIN b t ON t.bi = l.bi AND t.bj = r.bj)"


def _sparse_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.digest(fx.hierarchy(spark, d).entries, NB // 4)


@query(f"WITH {_BLOCKED} SELECT bi, bj, nnz FROM b")
def blk_nnz(spark: SparkSession, d: str) -> DataFrame:
    return blocks.digest(fx.transition_matrix(spark, d).entries, NB)


@query(f"WITH {_SPARSE_BLOCKS} SELECT bi, bj, nnz, ((bi % {P}) * {Q} + bj % {Q})::INTEGER AS rank FROM b")
def blk_owner(spark: SparkSession, d: str) -> DataFrame:
    return blocks.owners(_sparse_blocks(spark, d), PROCESSES)


@query(f"WITH {_SPARSE_BLOCKS} SELECT ((bi % {P}) * {Q} + bj % {Q})::INTEGER AS rank, count(*) AS blocks, sum(nnz)::BIGINT AS nnz FROM b GROUP BY 1")
def blk_rank_load(spark: SparkSession, d: str) -> DataFrame:
    return blocks.rank_load(_sparse_blocks(spark, d), PROCESSES)


@query("WITH n AS (SELECT unnest(range(1, 65)) AS processes), g AS (SELECT processes, max(d) AS p FROM n, range(1, 9) AS r(d) WHERE processes % d = 0 AND d * d <= processes GROUP BY processes) SELECT processes, p::INTEGER AS p, (processes // p)::INTEGER AS q FROM g")
def blk_process_grid(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, *scans.process_grid(k)) for k in range(1, 65)], "processes bigint, p int, q int")


@query(f"WITH {_SPARSE_BLOCKS}{_UPDATES}, c AS (SELECT bi, bj, count(*) AS n FROM u GROUP BY 1, 2) SELECT b.bi, b.bj, 1 + coalesce(c.n, 0) AS tasks FROM b LEFT JOIN c USING (bi, bj)")
def blk_dep_counts(spark: SparkSession, d: str) -> DataFrame:
    return blocks.dependency_counts(_sparse_blocks(spark, d))


@query(f"WITH {_SPARSE_BLOCKS}{_UPDATES}, w AS (SELECT *, ((bi % {P}) * {Q} + bj % {Q})::INTEGER AS rank FROM u), x AS (SELECT rank, bi, level AS bj FROM w UNION ALL SELECT rank, level, bj FROM w) SELECT bi, bj, rank, count(*) AS uses FROM x WHERE rank <> (bi % {P}) * {Q} + bj % {Q} GROUP BY ALL")
def blk_remote_uses(spark: SparkSession, d: str) -> DataFrame:
    return blocks.remote_uses(_sparse_blocks(spark, d), PROCESSES)


@query(
    f"WITH {_SPARSE_BLOCKS}{_UPDATES}, w AS (SELECT *, ((bi % {P}) * {Q} + bj % {Q})::INTEGER AS rank FROM u), x AS (SELECT rank, bi, level AS bj, 'N' AS half FROM w UNION SELECT rank, level, bj, 'N' FROM w), "
    f"o AS (SELECT ((bi % {P}) * {Q} + bj % {Q})::INTEGER AS rank, least(bi, bj) AS d, CASE WHEN bi > bj THEN 'U' ELSE 'L' END AS half FROM b WHERE bi <> bj), "
    f"y AS (SELECT rank, bi, bj, half FROM x WHERE rank <> (bi % {P}) * {Q} + bj % {Q} UNION SELECT rank, d, d, half FROM o WHERE rank <> (d % {P}) * {Q} + d % {Q}) SELECT rank, count(*) AS receives FROM y GROUP BY rank"
)
def blk_expected_receives(spark: SparkSession, d: str) -> DataFrame:
    return blocks.expected_receives(_sparse_blocks(spark, d), PROCESSES)


@query(
    f"WITH {_SPARSE_BLOCKS}{_UPDATES}, t AS (SELECT least(bi, bj) AS level, CASE WHEN bi = bj THEN 'GETRF' WHEN bi > bj THEN 'TSTRF' ELSE 'GESSM' END AS kernel, bi, bj FROM b UNION ALL SELECT level, 'SSSSM', bi, bj FROM u), "
    "k AS (SELECT *, CASE kernel WHEN 'GETRF' THEN 1 WHEN 'TSTRF' THEN 2 WHEN 'GESSM' THEN 3 ELSE 4 END::INTEGER AS kernel_id FROM t) SELECT level, kernel, kernel_id, bi, bj FROM k"
)
def blk_tasks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.by_priority(blocks.tasks(_sparse_blocks(spark, d)))


@query(f"WITH {_SPARSE_BLOCKS}, x AS (SELECT bj AS b, min(bi) AS below FROM b WHERE bi > bj GROUP BY 1), y AS (SELECT bi AS b, min(bj) AS \"right\" FROM b WHERE bi < bj GROUP BY 1) SELECT b, below, \"right\" FROM x FULL JOIN y USING (b)")
def blk_first_offdiag(spark: SparkSession, d: str) -> DataFrame:
    return blocks.first_after_diagonal(_sparse_blocks(spark, d))


_CHUNK = f"(SELECT ((n + {NB // 4 * Q} - 1) // {NB // 4 * Q} + {PROCESSES} - 1) // {PROCESSES} * {NB // 4 * Q} AS w, n FROM (SELECT {fx.HIERARCHY_N} AS n))"


@query(
    f"WITH {fx.HIERARCHY_SQL}, c AS {_CHUNK} SELECT r.k::INTEGER AS rank, least(r.k * w, n)::BIGINT AS first_column, (least((r.k + 1) * w, n) - least(r.k * w, n))::BIGINT AS columns, "
    f"(SELECT count(*) FROM m WHERE m.j >= r.k * w AND m.j < (r.k + 1) * w) AS nnz FROM c, range({PROCESSES}) AS r(k)"
)
def mat_column_distribution(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    return blocks.column_distribution(m.entries, m.n, NB // 4, PROCESSES)


# ---------------------------------------------------------------- symbolic

# columns are eliminated one at a time: pairs of a column's rows below it become entries
_FILL = f"""WITH RECURSIVE {fx.HIERARCHY_SQL},
low AS (SELECT DISTINCT greatest(i, j) AS i, least(i, j) AS j FROM m),
f AS (SELECT -1::BIGINT AS k, i, j FROM low
      UNION ALL (WITH cur AS (SELECT * FROM f), nxt AS (SELECT max(k) + 1 AS k FROM cur),
        col AS (SELECT i FROM cur, nxt WHERE cur.j = nxt.k AND cur.i > nxt.k)
        SELECT (SELECT k FROM nxt), i, j FROM (SELECT i, j FROM cur UNION SELECT a.i, b.i FROM col a, col b WHERE a.i >= b.i) WHERE (SELECT k FROM nxt) < {fx.HIERARCHY_N})),
filled AS (SELECT i, j FROM f WHERE k = {fx.HIERARCHY_N} - 1)"""


def _filled(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    return symbolic.fill(m.pattern(), m.n)


def _panels(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    return symbolic.panels(m.pattern(), m.n)


@query(f"{_FILL} SELECT i, j FROM filled")
def sym_fill(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d)


@query(f"{_FILL} SELECT j, min(i) AS parent FROM filled WHERE i > j GROUP BY j")
def sym_etree(spark: SparkSession, d: str) -> DataFrame:
    return symbolic.panel_columns(_panels(spark, d)).filter("parent is not null").select("j", "parent")


@query(f"{_FILL} SELECT j, count(*) AS cnt FROM filled GROUP BY j")
def sym_colcounts(spark: SparkSession, d: str) -> DataFrame:
    return symbolic.panel_columns(_panels(spark, d)).select("j", "cnt")


@query(f"{_FILL} SELECT 2 * count(*) - {fx.HIERARCHY_N} AS nnz FROM filled")
def sym_nnz(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    return symbolic.panel_columns(symbolic.panels(m.pattern(), m.n)).agg((2 * F.sum("cnt") - F.lit(m.n)).alias("nnz"))


@query(f"{_FILL}, whole AS (SELECT i, j FROM filled UNION SELECT j, i FROM filled) SELECT (i // {NB})::INTEGER AS bi, (j // {NB})::INTEGER AS bj, count(*) AS nnz FROM whole GROUP BY 1, 2")
def sym_block_nnz(spark: SparkSession, d: str) -> DataFrame:
    return symbolic.panel_blocks(_panels(spark, d), NB)


@query(f"{_FILL}, whole AS (SELECT i, j FROM filled UNION SELECT j, i FROM filled) SELECT w.i, w.j, coalesce(m.v, 0) AS v FROM whole w LEFT JOIN m ON m.i = w.i AND m.j = w.j")
def sym_scatter(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    return symbolic.scatter(m.entries, symbolic.panels(m.pattern(), m.n))


_FLOPS = f"""{_FILL}, c AS (SELECT j, j // {NB} AS k, i // {NB} AS b FROM filled WHERE i > j),
work AS (SELECT CASE WHEN b = k THEN 'GETRF' ELSE 'TSTRF' END AS kernel, 1 AS n FROM c
         UNION ALL SELECT CASE WHEN x.b = x.k AND y.b = x.k THEN 'GETRF' WHEN y.b = x.k THEN 'TSTRF' WHEN x.b = x.k THEN 'GESSM' ELSE 'SSSSM' END, 2 FROM c x JOIN c y USING (j))
SELECT kernel, sum(n)::BIGINT AS flops FROM work"""


@query(f"SELECT {fx.HIERARCHY_N} AS n, (WITH {fx.HIERARCHY_SQL} SELECT count(*) FROM m) AS nnz, ({_FILL} SELECT 2 * count(*) - {fx.HIERARCHY_N} FROM filled) AS nnz_factors, ({_FLOPS.replace('SELECT kernel, sum(n)', 'SELECT sum(n)')})::BIGINT AS flops")
def sym_summary(spark: SparkSession, d: str) -> DataFrame:
    return _solver(fx.hierarchy(spark, d)).summary()


def _flop_query(kernel: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return symbolic.panel_flops(_panels(spark, d), NB).filter(F.col("kernel") == kernel)

    run.__name__ = f"flop_{kernel.lower()}"
    query(f"{_FLOPS} WHERE kernel = '{kernel}' GROUP BY kernel")(run)


for _kernel in blocks.KERNELS:
    _flop_query(_kernel)

# ---------------------------------------------------------------- numbers

# one step: the pivot's column is divided, the rest of the matrix loses column times row
_LU = """WITH RECURSIVE {matrix},
dense AS (SELECT r.i, c.j, coalesce(m.v, 0)::DOUBLE AS v FROM range({n}) AS r(i), range({n}) AS c(j) LEFT JOIN m ON m.i = r.i AND m.j = c.j),
f AS (SELECT 0::BIGINT AS k, i, j, v FROM dense
      UNION ALL SELECT x.k + 1, x.i, x.j, CASE WHEN x.i > x.k AND x.j = x.k THEN x.v / p.v WHEN x.i > x.k AND x.j > x.k THEN x.v - c.v / p.v * r.v ELSE x.v END
      FROM f x JOIN (SELECT v FROM f WHERE i = k AND j = k) p ON true JOIN (SELECT i, v FROM f WHERE j = k) c ON c.i = x.i JOIN (SELECT j, v FROM f WHERE i = k) r ON r.j = x.j WHERE x.k < {n} - 1),
lu AS (SELECT i, j, v FROM f WHERE k = {n} - 1)"""
_LU_HIERARCHY = _LU.format(matrix=fx.HIERARCHY_SQL, n=fx.HIERARCHY_N)
_LU_SUPPLY = _LU.format(matrix=fx.CO_SUPPLY_SQL, n="(SELECT count(*) FROM supplier)")

# Gauss-Jordan on [A | b]; column n is b
_GJ = """WITH RECURSIVE {matrix}, rhs AS ({rhs}),
aug AS (SELECT r.i, c.j, coalesce(CASE WHEN c.j = {n} THEN b.v ELSE m.v END, 0)::DOUBLE AS v FROM range({n}) AS r(i), range({n} + 1) AS c(j) LEFT JOIN m ON m.i = r.i AND m.j = c.j LEFT JOIN rhs b ON b.i = r.i),
g AS (SELECT 0::BIGINT AS k, i, j, v FROM aug
      UNION ALL SELECT x.k + 1, x.i, x.j, CASE WHEN x.i = x.k THEN x.v / p.v ELSE x.v - c.v / p.v * r.v END
      FROM g x JOIN (SELECT v FROM g WHERE i = k AND j = k) p ON true JOIN (SELECT i, v FROM g WHERE j = k) c ON c.i = x.i JOIN (SELECT j, v FROM g WHERE i = k) r ON r.j = x.j WHERE x.k < {n})
SELECT i, round(v, 6) + 0.0 AS v FROM g WHERE k = {n} AND j = {n}"""


def _gauss_jordan(matrix: str, n: str, rhs: str) -> str:
    return _GJ.format(matrix=matrix, n=n, rhs=rhs)


def _solver(m: SparseMatrix, nb: int = NB, **options) -> Solver:
    return Solver.analyze(m.entries, n=m.n, nb=nb, **options)


@query(f"{_LU_HIERARCHY} SELECT CASE WHEN i > j THEN 'L' ELSE 'U' END AS part, i, j, round(v, 6) + 0.0 AS v FROM lu WHERE abs(v) > 1e-12")
def lu_entries(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    f = factor.factor(m.entries, factor.Grid(m.n, NB))
    return factor.factor_entries(f, factor.Grid(m.n, NB), drop=1e-12).select("part", "i", "j", _r("v"))


@query(f"{_LU_SUPPLY} SELECT CASE WHEN i > j THEN 'L' ELSE 'U' END AS part, i, j, round(v, 6) + 0.0 AS v FROM lu WHERE abs(v) > 1e-9")
def lu_entries_by_levels(spark: SparkSession, d: str) -> DataFrame:
    m = fx.co_supply(spark, d)
    grid = factor.Grid(m.n, max(NB, m.n // 3))
    return factor.factor_entries(factor.factor(m.entries, grid, strategy="levels"), grid, drop=1e-9).select("part", "i", "j", _r("v"))


@query(f"{_LU_HIERARCHY} SELECT round(sum(ln(abs(v))), 6) AS logdet, CASE WHEN count(*) FILTER (v < 0) % 2 = 1 THEN -1 ELSE 1 END::INTEGER AS sign FROM lu WHERE i = j")
def lu_logdet(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    grid = factor.Grid(m.n, NB)
    return factor.log_determinant(factor.factor(m.entries, grid), grid).select(_r("logdet"), "sign")


@query(
    f"{_LU_HIERARCHY}, ue AS (SELECT i, sum(v) AS v FROM lu WHERE i <= j GROUP BY i), le AS (SELECT l.i, sum(l.v * ue.v) AS v FROM lu l JOIN ue ON ue.i = l.j WHERE l.i > l.j GROUP BY l.i), ae AS (SELECT i, sum(v) AS v FROM m GROUP BY i), "
    "e AS (SELECT sqrt(sum(power(ue.v + coalesce(le.v, 0) - ae.v, 2))) / sqrt(sum(ae.v * ae.v)) AS error FROM ae JOIN ue USING (i) LEFT JOIN le USING (i)) SELECT error < 1e-12 AS small, round(error, 9) + 0.0 AS error FROM e"
)
def lu_check(spark: SparkSession, d: str) -> DataFrame:
    checked = _solver(fx.hierarchy(spark, d)).factor().check()
    return checked.select((F.col("error") < 1e-12).alias("small"), (F.round("error", 9) + 0.0).alias("error"))


# b rides along as column n: what elimination leaves there is L^-1 b
_FORWARD = _LU.replace("FROM range({n}) AS r(i), range({n}) AS c(j) LEFT JOIN m ON m.i = r.i AND m.j = c.j", "FROM range({n}) AS r(i), range({n} + 1) AS c(j) LEFT JOIN m ON m.i = r.i AND m.j = c.j").replace(
    "coalesce(m.v, 0)::DOUBLE AS v", "coalesce(CASE WHEN c.j = {n} THEN (SELECT s_acctbal FROM supplier WHERE 30 + s_suppkey = r.i) ELSE m.v END, 0)::DOUBLE AS v"
)


@query(f"{_FORWARD.format(matrix=fx.HIERARCHY_SQL, n=fx.HIERARCHY_N)} SELECT i, round(v, 6) + 0.0 AS v FROM lu WHERE j = {fx.HIERARCHY_N}")
def solve_forward(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    grid = factor.Grid(m.n, NB)
    return solve.solve(factor.factor(m.entries, grid), fx.account_rhs(spark, d), grid, parts="L").select("i", _r("v"))


# U^-1 b is A^-1 (L b)
@query(
    _gauss_jordan(
        f"{_LU_HIERARCHY.removeprefix('WITH RECURSIVE ')}",
        fx.HIERARCHY_N,
        "SELECT l.i, sum(CASE WHEN l.i = l.j THEN 1 ELSE l.v END * s.s_acctbal) AS v FROM lu l JOIN supplier s ON 30 + s.s_suppkey = l.j WHERE l.i >= l.j GROUP BY l.i",
    )
)
def solve_backward(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    grid = factor.Grid(m.n, NB)
    return solve.solve(factor.factor(m.entries, grid), fx.account_rhs(spark, d), grid, parts="U").select("i", _r("v"))


@query(_gauss_jordan(fx.HIERARCHY_SQL, fx.HIERARCHY_N, "SELECT 30 + s_suppkey AS i, s_acctbal AS v FROM supplier"))
def solve_full(spark: SparkSession, d: str) -> DataFrame:
    return _solver(fx.hierarchy(spark, d)).factor().solve(fx.account_rhs(spark, d)).select("i", _r("v"))


@query(_gauss_jordan(fx.HIERARCHY_SQL, fx.HIERARCHY_N, "SELECT i, sum(v) AS v FROM m GROUP BY i"))
def solve_row_sums(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    return _solver(m).factor_solve(ones_rhs(m.entries)).select("i", _r("v"))


@query(_gauss_jordan(fx.TRANSITION_MATRIX_SQL, "(SELECT max(user_id) + 1 FROM events)", "SELECT user_id AS i, count(*)::DOUBLE AS v FROM events GROUP BY 1"))
def solve_unsymmetric(spark: SparkSession, d: str) -> DataFrame:
    rhs = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("i")).agg(F.count("*").cast("double").alias("v"))
    return _solver(fx.transition_matrix(spark, d), nb=64, ordering_method="mindegree").factor_solve(rhs).select("i", _r("v"))


@query(_gauss_jordan(fx.CO_SUPPLY_SQL, "(SELECT count(*) FROM supplier)", "SELECT s_suppkey AS i, s_acctbal AS v FROM supplier"))
def solve_reordered_scaled(spark: SparkSession, d: str) -> DataFrame:
    rhs = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return _solver(fx.co_supply(spark, d), ordering_method="nd", scaling=True).factor_solve(rhs).select("i", _r("v"))


@query(
    f"WITH one AS ({_gauss_jordan(fx.HIERARCHY_SQL, fx.HIERARCHY_N, 'SELECT 30 + s_suppkey AS i, s_acctbal AS v FROM supplier').replace('round(v, 6) + 0.0 AS v', 'v')}) "
    "SELECT k AS rhs_id, i, round(v * k, 4) + 0.0 AS v FROM one, range(1, 5) AS r(k)"
)
def solve_multi_rhs(spark: SparkSession, d: str) -> DataFrame:
    many = fx.account_rhs(spark, d).crossJoin(spark.range(1, 5).withColumnRenamed("id", "rhs_id")).select("rhs_id", "i", (F.col("v") * F.col("rhs_id")).alias("v"))
    return _solver(fx.hierarchy(spark, d)).factor().solve(many).select("rhs_id", "i", _r("v", 4))


@query(_gauss_jordan(fx.HIERARCHY_SQL, fx.HIERARCHY_N, "SELECT 30 + s_suppkey AS i, s_acctbal AS v FROM supplier"))
def solve_by_levels(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    s = _solver(m, nb=max(NB, m.n // 4), ordering_method="degree")
    return s.factor(strategy="levels").solve(fx.account_rhs(spark, d), strategy="levels").select("i", _r("v"))


@query(f"SELECT r.i, 1.0::DOUBLE AS re, -1.0::DOUBLE AS im FROM range({fx.HIERARCHY_N}) AS r(i)")
def solve_complex(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    entries = m.entries.select("i", "j", cx.complex_of(F.col("v"), F.when(F.col("i") == F.col("j"), 0.5).otherwise(0.25)).alias("v"))
    rhs = entries.select("i", cx.multiply(F.col("v"), cx.complex_of(F.lit(1.0), F.lit(-1.0))).alias("v")).groupBy("i").agg(F.struct(F.sum("v.re").alias("re"), F.sum("v.im").alias("im")).alias("v"))
    x = Solver.analyze(entries, n=m.n, nb=NB).factor_solve(rhs)
    return x.select("i", (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"))


# ---------------------------------------------------------------- orderings


@query(f"WITH {fx.HIERARCHY_SQL}, d AS (SELECT r.i, count(o.i) AS d FROM range({fx.HIERARCHY_N}) AS r(i) LEFT JOIN off o ON o.i = r.i GROUP BY r.i) SELECT i AS old, row_number() OVER (ORDER BY d, i) - 1 AS new FROM d")
def ord_degree(spark: SparkSession, d: str) -> DataFrame:
    return ordering.order(fx.hierarchy(spark, d), "degree")


def _ordering_query(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """The fill under the ordering: of this tree-like matrix, none."""
        m = fx.hierarchy(spark, d)
        perm = ordering.order(m, method)
        moved = m.permute(perm, perm)
        return symbolic.fill(moved.pattern(), m.n).agg(F.count("*").alias("nnz_l"), F.count_distinct("j").alias("columns"))

    run.__name__ = f"ord_{method}_fill"
    # the trees of regions, nations and suppliers fill not at all when children go before parents
    query(f"WITH {fx.HIERARCHY_SQL} SELECT count(*) FILTER (i >= j) AS nnz_l, {fx.HIERARCHY_N} AS columns FROM m")(run)


for _method in ("rcm", "mindegree", "nd"):
    _ordering_query(_method)


# a dominant matrix has the largest product on its diagonal, which is moved two columns on
@query(f"WITH {fx.CO_SUPPLY_SQL}, n AS (SELECT count(*) AS n FROM supplier) SELECT r.i, (r.i + 2) % n AS \"column\", (SELECT count(*) FROM m WHERE m.i = r.i) AS entries, 1.0::DOUBLE AS most, 1.0::DOUBLE AS own FROM n, range((SELECT count(*) FROM supplier)) AS r(i)")
def ord_matching(spark: SparkSession, d: str) -> DataFrame:
    """Each row's column, and of its scaled entries the largest modulus and that of the match."""
    m = fx.co_supply(spark, d)
    moved = SparseMatrix(m.entries.select("i", ((F.col("j") + 2) % m.n).alias("j"), "v"), m.n)
    match = ordering.matching(moved)
    rows, cols = match.select("i", F.col("row_scale").alias("s")), match.select("i", F.col("column_scale").alias("s"))
    scaled = moved.scale(rows, cols).entries.join(match.select("i", "column"), "i")
    size = F.abs("v")
    return scaled.groupBy("i", "column").agg(F.count("*").alias("entries"), F.round(F.max(size), 9).alias("most"), F.round(F.max(F.when(F.col("j") == F.col("column"), size)), 9).alias("own"))


# ---------------------------------------------------------------- files


@query(f"WITH {fx.HIERARCHY_SQL} SELECT i, j, v FROM m")
def io_mtx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    path = f"{new_path(spark, 'mtx')}/m.mtx"
    mm.write_mtx(m.entries, path, m.n, m.n)
    return mm.read_matrix(spark, path)


def _written(spark: SparkSession, entries: DataFrame, n: int, **options) -> str:
    path = f"{new_path(spark, 'mtx')}/m.mtx"
    mm.write_mtx(entries, path, n, n, **options)
    return path


@query(f"WITH {fx.HIERARCHY_SQL} SELECT i, j, v FROM m")
def io_mtx_symmetric(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    return mm.read_matrix(spark, _written(spark, m.entries, m.n, symmetry="symmetric"))


@query(f"WITH {fx.TRANSITIONS_SQL}, s AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM t UNION ALL SELECT j, i, -v FROM t) GROUP BY i, j) SELECT i, j, v FROM s WHERE v <> 0")
def io_mtx_skew(spark: SparkSession, d: str) -> DataFrame:
    t = fx.transitions(spark, d)
    skew = t.union(t.select("j", "i", -F.col("v"))).groupBy("i", "j").agg(F.sum("v").alias("v")).filter("v <> 0")
    return mm.read_matrix(spark, _written(spark, skew, fx.transition_matrix(spark, d).n, symmetry="skew-symmetric"))


@query(f"WITH {fx.HIERARCHY_SQL} SELECT i, j, v AS re, sign(i - j) * 0.25::DOUBLE + 0.0 AS im FROM m")
def io_mtx_hermitian(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    im = F.signum(F.col("i") - F.col("j")) * 0.25
    path = _written(spark, m.entries.select("i", "j", cx.complex_of(F.col("v"), im).alias("v")), m.n, symmetry="hermitian")
    return mm.read_matrix(spark, path).select("i", "j", F.col("v.re").alias("re"), (F.col("v.im") + 0.0).alias("im"))


@query(f"WITH {fx.TRANSITIONS_SQL} SELECT i, j, 1.0::DOUBLE AS v FROM t")
def io_mtx_pattern(spark: SparkSession, d: str) -> DataFrame:
    return mm.read_matrix(spark, _written(spark, fx.transitions(spark, d), fx.transition_matrix(spark, d).n, pattern=True))


@query(f"WITH {fx.HIERARCHY_SQL} SELECT a.i, b.j, coalesce(m.v, 0)::DOUBLE AS v FROM range({fx.HIERARCHY_N}) AS a(i), range({fx.HIERARCHY_N}) AS b(j) LEFT JOIN m ON m.i = a.i AND m.j = b.j")
def io_mtx_dense(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    path = f"{new_path(spark, 'mtx')}/m.mtx"
    mm.write_dense(m.entries, path, m.n, m.n)
    return mm.read_matrix(spark, path)


@query(f"WITH {fx.HIERARCHY_SQL} SELECT {fx.HIERARCHY_N} AS \"rows\", {fx.HIERARCHY_N} AS columns, count(*) FILTER (i >= j) AS stored, count(*) AS expanded, 'coordinate' AS format, 'real' AS field, 'symmetric' AS symmetry FROM m")
def io_mtx_info(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    info = mm.matrix_info(spark, _written(spark, m.entries, m.n, symmetry="symmetric"))
    return spark.createDataFrame([tuple(info.values())], "rows bigint, columns bigint, stored bigint, expanded bigint, format string, field string, symmetry string")


@query("SELECT 30 + s_suppkey::BIGINT AS row, s_acctbal AS v FROM supplier")
def io_rhs_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = fx.hierarchy(spark, d)
    b = m.indices().join(fx.account_rhs(spark, d), "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))
    path = f"{new_path(spark, 'rhs')}/b.txt"
    mm.write_rhs(b, path, m.n)
    return mm.read_rhs(spark, path, m.n).filter(F.col("i") >= fx.REGIONS + fx.NATIONS).select(F.col("i").alias("row"), "v")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
