"""What an analysis demands of its samples, decided in one pass over the labels before anything is fitted.

A rule is a row of DEMANDS. decision() counts classes, holds them against the rule and returns one row: whether the analysis runs, why not, how many folds it takes and whether it sets a test part aside. demanded() raises what that row refuses, so every fit asks it first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PolicyError(ValueError):
    """Data that an analysis can't use, with the reason."""


@dataclass(frozen=True)
class Demand:
    """Least samples of the smallest class: in full, exploratory, and to set a test part aside; least and usual folds."""

    full: int
    exploratory: int
    held_out: int
    folds: int
    usual: int = 5


#: Fixed values of the documented rules. A sparse regression needs four folds inside each training part (sparse_inner), so five samples at least.
DEMANDS = {"forest": Demand(6, 2, 8, 2), "sparse": Demand(6, 5, 8, 4), "sparse_inner": Demand(4, 4, 8, 4)}
MODES = ("auto", "cross_validation_only", "train_test_split")


def decision(labels: DataFrame, analysis: str, mode: str = "auto", exploratory: bool = False, folds: object = "Auto", column: str = "y") -> DataFrame:
    """(analysis, classes, smallest, smallest_n, folds, grouped, holds_out, accepted, reason), one row. labels: a row a sample; samples without a label don't count."""
    d, asked = DEMANDS[analysis], setting(folds, DEMANDS[analysis].usual)
    if (mode := re.sub(r"[\s_-]+", "_", (mode or MODES[0]).strip()).lower()) not in MODES:
        raise PolicyError(f"mode is one of {', '.join(MODES)}")
    least = d.exploratory if exploratory else d.full
    n = labels.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    short = F.concat("y", F.lit(" has "), F.col("n").cast("string"))
    one = n.agg(F.count(F.lit(1)).alias("classes"), F.min(F.struct("n", "y")).alias("m"), F.sum("n").alias("all_"), F.array_sort(F.collect_list(F.when(F.col("n") < least, short))).alias("short"), F.array_sort(F.collect_list(F.when(F.col("n") < d.held_out, short))).alias("unsplit"))  # a row a class before
    k = F.least(F.lit(asked), F.greatest(F.col("m.n"), F.lit(d.folds if analysis == "forest" else 0))).cast("int")
    one = one.withColumn("folds", k).withColumn("can_hold", F.size("unsplit") == 0)
    listed = {c: F.array_join(c, ", ") for c in ("short", "unsplit")}
    refused = (
        F.when(F.col("classes") < 2, F.lit(f"{analysis}: there must be two groups"))
        .when(F.size("short") > 0, F.concat(F.lit(f"{analysis}: every group must have {least} samples; "), listed["short"]))
        .when(F.col("folds") < d.folds, F.lit(f"{analysis}: {d.folds} folds are needed"))
    )
    if mode == "train_test_split" and not exploratory:
        refused = F.coalesce(refused, F.when(~F.col("can_hold"), F.concat(F.lit(f"{analysis}: a test part needs {d.held_out} samples of every group; "), listed["unsplit"])))
    aside = F.lit(False) if exploratory or mode == "cross_validation_only" else F.col("can_hold")
    note = F.lit("exploratory: no test part") if exploratory else F.when((F.lit(mode) == "auto") & ~F.col("can_hold"), F.concat(F.lit(f"no test part: it needs {d.held_out} samples of every group; "), listed["unsplit"]))
    one = one.withColumn("refused", refused)
    return one.select(
        F.lit(analysis).alias("analysis"), "classes", F.col("m.y").alias("smallest"), F.col("m.n").alias("smallest_n"), "folds",
        (F.lit(not exploratory) & (F.expr("all_ div folds") >= 3)).alias("grouped"), (aside & F.col("refused").isNull()).alias("holds_out"), F.col("refused").isNull().alias("accepted"), F.coalesce("refused", note).alias("reason"),
    )


def demanded(labels: DataFrame, analysis: str, **how):
    """The row of decision(); what it refuses is raised."""
    row = decision(labels, analysis, **how).first()
    if not row.accepted:
        raise PolicyError(row.reason)
    return row


def inner_folds(smallest: int, folds: object = "Auto") -> int:
    """Folds of a sparse regression whose smallest class has so many training samples."""
    d = DEMANDS["sparse_inner"]
    k = min(setting(folds, d.usual), smallest)
    if k < d.folds:
        raise PolicyError(f"sparse: {d.folds} folds are needed; the smallest group has {smallest} training samples")
    return k


def setting(value: object, default: int | None = None) -> int | None:
    """A whole number from 1 on that a user typed; the default for nothing and for Auto."""
    typed = str(value if value is not None else "").strip()
    if typed.casefold() in ("", "auto", "nan"):
        return default
    try:
        number = int(float(typed))
    except (ValueError, OverflowError):
        number = 0
    if number < 1:
        raise PolicyError(f"{typed} is neither Auto nor a whole number from 1 on")
    return number


def clusters(k: object, most: int) -> int:
    """As many clusters as asked, and as there are things to cluster."""
    if (n := setting(k)) is None:
        raise PolicyError("a number of clusters is needed")
    return min(n, most)


def display_names(samples: DataFrame, column: str = "display_name") -> DataFrame:
    """samples, whose names must be there and differ."""
    bad = samples.groupBy(F.coalesce(F.trim(column), F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or name = ''").orderBy("name").limit(5).collect()
    if bad:
        raise PolicyError("; ".join(f"{r.n} samples are named {r.name}" if r.name else f"{r.n} samples have no name" for r in bad))
    return samples


#: Proteins, groups and samples that a trajectory demands, and samples that must have a pseudotime.
TRAJECTORY = {"proteins": 3, "groups": 2, "samples": 4, "ordered": 3}


def trajectory(rows: list, proteins: int, start: str, end: str | None = None) -> None:
    """Samples (with grp) and proteins that a trajectory from start to end can use, or PolicyError."""
    groups = {r.grp for r in rows}
    have = {"proteins": proteins, "groups": len(groups - {None}), "samples": len(rows)}
    if None in groups:
        raise PolicyError("trajectory: a sample has no group")
    for what, n in have.items():
        if n < TRAJECTORY[what]:
            raise PolicyError(f"trajectory: {TRAJECTORY[what]} {what} are needed, there are {n}")
    for g in filter(None, (start, end)):
        if g not in groups:
            raise PolicyError(f"trajectory: no sample is in the group {g}")


def slug(analysis: str) -> str:
    """A name for files: words of letters and digits joined by underscores."""
    return "_".join(re.findall("[a-z0-9]+", (analysis or "ml").lower()))
