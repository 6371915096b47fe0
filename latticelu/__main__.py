"""python -m latticelu -nb NB -f MATRIX [-r RHS] [-o OUT]: solve a system and print its residual."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators.matrix import SparseMatrix
from .plans.solver import DEFAULT_NB, Solver, ones_rhs
from .shipping import ship
from .sources import matrix_market as mm


def main(arguments: Sequence[str] | None = None) -> float:
    parser = argparse.ArgumentParser(prog="latticelu", description=__doc__)
    parser.add_argument("-nb", type=int, default=DEFAULT_NB, help="rows of a block")
    parser.add_argument("-f", required=True, metavar="MATRIX", help="a Matrix Market (.mtx) or binary CSR (.lid) file")
    parser.add_argument("-r", metavar="RHS", help="a right-hand-side file; without one, row sums")
    parser.add_argument("-o", metavar="OUT", help="where to write the solution")
    parser.add_argument("--ordering", default="natural")
    parser.add_argument("--scaling", action="store_true")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("latticelu").getOrCreate()
    ship(spark)
    began = time.perf_counter()
    phases = {}

    def phase(name: str) -> None:
        nonlocal began
        phases[name], began = time.perf_counter() - began, time.perf_counter()

    entries = mm.read_matrix(spark, args.f)
    rhs = mm.read_rhs(spark, args.r) if args.r else ones_rhs(entries)
    phase("read")
    solver = Solver.analyze(entries, nb=args.nb, ordering_method=args.ordering, scaling=args.scaling)
    phase("analyse")
    factors = solver.factor()
    phase("factor")
    x = factors.solve(rhs)
    n = entries.selectExpr("greatest(max(i), max(j)) + 1 AS n").first()[0]
    residual = SparseMatrix(entries, n).residual(x, rhs).first()[0]
    phase("solve and check")
    if args.o:
        mm.write_rhs(x, args.o, n)
    print(f"n {n}, entries {entries.count()}, " + ", ".join(f"{k} {v:.2f} s" for k, v in phases.items()) + f", residual {residual:.3e}")
    return residual


if __name__ == "__main__":
    main()
