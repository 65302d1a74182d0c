"""python -m featlab MATRIX: run selectors on one Parquet matrix with columns X and Y and keep the results table."""

from __future__ import annotations

import argparse
from pathlib import PurePath

from featlab.plans import pipeline
from featlab.plans.registry import GROUPS
from featlab.session import session
from featlab.sources.matrices import load_matrix, rebase_labels


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="featlab", description=__doc__)
    parser.add_argument("matrix")
    parser.add_argument("--group", choices=[*GROUPS], default="All")
    parser.add_argument("--experiment", default="custom_experiment")
    parser.add_argument("--algorithms", default="", help="names, separated by commas, instead of the whole group")
    parser.add_argument("--results", default="results")
    o = parser.parse_args(args)
    only = [a.strip() for a in o.algorithms.split(",") if a.strip()] or None
    spark = session()
    path = PurePath(o.matrix.rstrip("/"))
    wide = rebase_labels(load_matrix(spark, o.matrix))
    table = pipeline.benchmark(wide, path.stem, f"{o.results}/{o.experiment}", "All" if only else o.group, only, path.parent.name)
    table.where("dataset = '" + path.stem.replace("'", "") + "'").select("algorithm", "fs", "k", "evaluator", "avg_accuracy", "avg_auc").orderBy("algorithm", "k", "evaluator").show(1000, False)


if __name__ == "__main__":
    main()
