"""Block-level structure: digests, owners, dependencies, tasks, operation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import block_of, in_block, owner, process_grid
from ..storage import materialize

#: Kernel numbers.
KERNELS = {"GETRF": 1, "TSTRF": 2, "GESSM": 3, "SSSSM": 4}
MAX_NB = 65535


def check_nb(nb: int) -> int:
    if not 1 <= nb <= MAX_NB:
        raise ValueError(f"nb must be from 1 to {MAX_NB}, not {nb}")
    return nb


def blocked(entries: DataFrame, nb: int) -> DataFrame:
    """`entries` plus block coordinates bi, bj and places r, c in the block."""
    check_nb(nb)
    i, j = F.col("i"), F.col("j")
    return entries.withColumns({"bi": block_of(i, nb), "bj": block_of(j, nb), "r": in_block(i, nb), "c": in_block(j, nb)})


def digest(pattern: DataFrame, nb: int) -> DataFrame:
    """(bi, bj, nnz) of the blocks that have entries."""
    return blocked(pattern, nb).groupBy("bi", "bj").agg(F.count("*").alias("nnz"))


def owners(blocks: DataFrame, processes: int) -> DataFrame:
    p, q = process_grid(processes)
    return blocks.withColumn("rank", owner(F.col("bi"), F.col("bj"), p, q).cast("int"))


def rank_load(blocks: DataFrame, processes: int) -> DataFrame:
    """(rank, blocks, nnz) of a digest."""
    return owners(blocks, processes).groupBy("rank").agg(F.count("*").alias("blocks"), F.sum("nnz").alias("nnz"))


def column_ranks(entries: DataFrame, n: int, nb: int, processes: int) -> DataFrame:
    """`entries` plus the rank that has their column: contiguous chunks of whole rounds of the process grid's columns.

    All ranks get equally many columns, but the last ones with columns may get fewer and those after them none.
    """
    width = _chunk(n, nb, processes)
    return entries.withColumn("rank", F.floor(F.col("j") / width).cast("int"))


def column_distribution(entries: DataFrame, n: int, nb: int, processes: int) -> DataFrame:
    """(rank, first_column, columns, nnz) of `column_ranks`, for every rank."""
    width = _chunk(n, nb, processes)
    first, stop = (F.least(F.col("id") * width, F.lit(n)), F.least((F.col("id") + 1) * width, F.lit(n)))
    ranks = entries.sparkSession.range(processes).select(F.col("id").cast("int").alias("rank"), first.alias("first_column"), (stop - first).alias("columns"))
    nnz = column_ranks(entries, n, nb, processes).groupBy("rank").agg(F.count("*").alias("nnz"))
    return ranks.join(nnz, "rank", "left").select("rank", "first_column", "columns", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def _chunk(n: int, nb: int, processes: int) -> int:
    round_ = check_nb(nb) * process_grid(processes)[1]
    rounds = -(-n // round_)
    return -(-rounds // processes) * round_


def updates(blocks: DataFrame) -> DataFrame:
    """(level, bi, bj): every Schur update that the block pattern has, of present destinations.

    A destination looks through the levels of its row or of its column, whichever has fewer,
    so that the work is at most the pattern's size to the power of 1.5; a level with many
    blocks never pairs them all.
    """
    pattern = materialize(blocks.select("bi", "bj"), "pattern")
    left = pattern.filter("bi > bj").select("bi", F.col("bj").alias("level"))
    right = pattern.filter("bi < bj").select(F.col("bi").alias("level"), "bj")
    rows, columns = left.groupBy("bi").agg(F.count("*").alias("x")), right.groupBy("bj").agg(F.count("*").alias("y"))
    to = pattern.join(rows, "bi").join(columns, "bj")
    by_row = to.filter("x <= y").join(left, "bi").join(right, ["level", "bj"], "left_semi")
    by_column = to.filter("x > y").join(right, "bj").join(left, ["level", "bi"], "left_semi")
    return by_row.select("level", "bi", "bj").union(by_column.select("level", "bi", "bj"))


def dependency_counts(blocks: DataFrame) -> DataFrame:
    """(bi, bj, tasks): one factor or solve task plus the block's Schur updates."""
    count = updates(blocks).groupBy("bi", "bj").agg(F.count("*").alias("u"))
    return blocks.select("bi", "bj").join(count, ["bi", "bj"], "left").select("bi", "bj", (1 + F.coalesce("u", F.lit(0))).alias("tasks"))


def remote_uses(blocks: DataFrame, processes: int) -> DataFrame:
    """(bi, bj, rank, uses): Schur updates of other ranks that read an off-diagonal block."""
    p, q = process_grid(processes)
    u = updates(blocks).withColumn("rank", owner(F.col("bi"), F.col("bj"), p, q).cast("int"))
    reads = u.select("rank", "bi", F.col("level").alias("bj")).union(u.select("rank", F.col("level").alias("bi"), "bj"))
    own = owner(F.col("bi"), F.col("bj"), p, q)
    return reads.filter(F.col("rank") != own).groupBy("bi", "bj", "rank").agg(F.count("*").alias("uses"))


def expected_receives(blocks: DataFrame, processes: int) -> DataFrame:
    """(rank, receives): blocks that a rank needs and doesn't own.

    It needs both operands of its updates, and the factored diagonal block of the levels
    where it owns a block below or right of it (lower and upper part are one each).
    """
    p, q = process_grid(processes)
    own = owners(blocks.select("bi", "bj"), processes)
    panels = own.filter("bi <> bj").select("rank", F.least("bi", "bj").alias("d"), F.when(F.col("bi") > F.col("bj"), "U").otherwise("L").alias("half")).distinct()
    diag = panels.filter(F.col("rank") != owner(F.col("d"), F.col("d"), p, q)).select("rank", F.col("d").alias("bi"), F.col("d").alias("bj"), "half")
    used = remote_uses(blocks, processes).select("rank", "bi", "bj", F.lit("N").alias("half"))
    return diag.union(used).groupBy("rank").agg(F.count("*").alias("receives"))


def tasks(blocks: DataFrame) -> DataFrame:
    """The task table (level, kernel, kernel_id, bi, bj), a function of the block pattern alone."""
    own = blocks.select(F.least("bi", "bj").alias("level"), F.when(F.col("bi") == F.col("bj"), "GETRF").when(F.col("bi") > F.col("bj"), "TSTRF").otherwise("GESSM").alias("kernel"), "bi", "bj")
    all_tasks = own.unionByName(updates(blocks).withColumn("kernel", F.lit("SSSSM")))
    number = F.coalesce(*[F.when(F.col("kernel") == k, v) for k, v in KERNELS.items()])
    return all_tasks.withColumn("kernel_id", number)


def by_priority(table: DataFrame, strategy: int = 0) -> DataFrame:
    """`tasks` sorted as one of the five strategies runs them; ties go by block."""
    spread = F.col("bi") + F.col("bj") - F.col("level")
    orders = [
        [F.asc("level"), spread.asc()],
        [F.asc("kernel_id"), spread.asc(), F.asc("level")],
        [F.asc("kernel_id"), F.asc("level"), spread.asc()],
        [spread.asc()],
        [F.desc("level"), spread.desc()],
    ]
    if not 0 <= strategy < len(orders):
        raise ValueError(f"strategy must be from 0 to {len(orders) - 1}")
    return table.orderBy(*orders[strategy], "kernel_id", "bi", "bj", "level")


def first_after_diagonal(blocks: DataFrame) -> DataFrame:
    """(b, below, right): the first block below and right of each diagonal block, if any."""
    below = blocks.filter("bi > bj").groupBy(F.col("bj").alias("b")).agg(F.min("bi").alias("below"))
    right = blocks.filter("bi < bj").groupBy(F.col("bi").alias("b")).agg(F.min("bj").alias("right"))
    return below.join(right, "b", "full_outer")


def flops(fill: DataFrame, nb: int) -> DataFrame:
    """(kernel, flops): exact counts over the filled lower pattern (i >= j).

    With the symmetric pattern, eliminating column k costs one division per entry below
    the diagonal and two operations per pair of such entries in its row and column; the
    blocks of the three indices say which kernel does them.  Divisions of a panel right
    of the diagonal are none, since L has a unit diagonal.
    """
    low = blocked(fill.filter("i > j"), nb).select("i", "j", "bi", "bj")
    one = F.when(F.col("bi") == F.col("bj"), "GETRF").otherwise("TSTRF")
    divides = low.groupBy(one.alias("kernel")).agg(F.count("*").alias("flops"))
    # pairs meet as counts by block: |rows of block x in column k| * |rows of block y in column k|
    count = low.groupBy("j", "bj", "bi").agg(F.count("*").alias("n"))
    a, b = count.select("j", F.col("bj").alias("k"), F.col("bi").alias("x"), F.col("n").alias("m")), count.select("j", F.col("bi").alias("y"), "n")
    kernel = F.when((F.col("x") == F.col("k")) & (F.col("y") == F.col("k")), "GETRF").when(F.col("y") == F.col("k"), "TSTRF").when(F.col("x") == F.col("k"), "GESSM").otherwise("SSSSM")
    pairs = a.join(b, "j").groupBy(kernel.alias("kernel")).agg(F.sum(2 * F.col("m") * F.col("n")).alias("flops"))
    return divides.union(pairs).groupBy("kernel").agg(F.sum("flops").alias("flops"))
