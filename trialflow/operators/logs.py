"""Solver logs: line patterns to events, events to one result row per log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.functions.derive import initialization_time, repair_density
from trialflow.functions.stats import finite
from trialflow.operators.rules import reasons, rule

# fixed values: line patterns of the solver output
FLOAT = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
ITERATION = rf"^\s*Davidson iteration\s+(\d+)\.(\d+)\s+\(tol=({FLOAT})\):"
ENERGY = rf"^\s*Sample-based diagonalization: Energy =\s*({FLOAT})\s*$"
DENSITY = r"^\s*Sample-based diagonalization: density =\s*(\[.*)\s*$"
DEVICE = r"^\s*rank\s+\d+\s+has device\s+\d+\s*$"
TIMINGS = {
    "helper_construction_time_s": "helper construction",
    "initial_state_time_s": "init",
    "solver_time_s": "davidson",
    "diagonalization_time_s": "diagonalization",
    "post_solver_matvec_time_s": "mult",
    "measurement_time_s": "measurement",
}


def _timing(label: str) -> str:
    return rf"^\s*Elapsed time for {label}\s+({FLOAT})\s+\(sec\)\s*$"


def parse_logs(lines: DataFrame) -> DataFrame:
    """``file, pos, kind, value, restart, subspace, text`` for lines that match a pattern.

    Narrow: every line is judged on its own.
    """
    line = F.col("line")
    # a literal that each pattern contains spares most lines the pattern itself
    literals = {
        "iteration": ("Davidson iteration", ITERATION, 3),
        "energy": ("diagonalization: Energy", ENERGY, 1),
        "density": ("diagonalization: density", DENSITY, None),
        "device": ("has device", DEVICE, None),
        **{n: (f"Elapsed time for {label}", _timing(label), 1) for n, label in TIMINGS.items()},
    }
    kind, number = None, None
    for name, (literal, pattern, group) in literals.items():
        test = line.contains(literal) & line.rlike(pattern)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        if group is not None:
            found, is_kind = F.regexp_extract(line, pattern, group), F.col("kind") == name
            number = F.when(is_kind, found) if number is None else number.when(is_kind, found)
    is_iteration = F.col("kind") == "iteration"
    return lines.withColumn("kind", kind).where("kind IS NOT NULL").select(
        "file", "pos", "kind", number.try_cast("double").alias("value"),
        F.when(is_iteration, F.regexp_extract(line, ITERATION, 1).try_cast("bigint")).alias("restart"),
        F.when(is_iteration, F.regexp_extract(line, ITERATION, 2).try_cast("bigint")).alias("subspace"),
        F.when(F.col("kind") == "density", F.regexp_extract(line, DENSITY, 1)).alias("text"),
    )


def reduce_logs(
    events: DataFrame, tolerance: float, logs: DataFrame | None = None,
    require_device: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One row per log and the violations: the last iteration wins, energy and density
    must occur once, each timing at most once.

    Every aggregate combines map-side. ``logs`` (a ``file`` column, optionally
    ``expected_orbitals``) adds logs without any matching line.
    """
    def only(kind: str, column: str):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    iteration = F.col("kind") == "iteration"
    grouped = events.groupBy("file").agg(
        F.count_if(iteration).alias("iteration_records"),
        F.max(F.when(iteration, F.struct("pos", "restart", "subspace", "value"))).alias("_last"),
        F.count_if(F.col("kind") == "energy").alias("_energies"), only("energy", "value").alias("energy"),
        F.count_if(F.col("kind") == "density").alias("_densities"), only("density", "text").alias("_density"),
        (F.count_if(F.col("kind") == "device") > 0).alias("device_assignment_seen"),
        *[only(t, "value").alias(t) for t in TIMINGS],
        *[F.count_if(F.col("kind") == t).alias(f"_n_{t}") for t in TIMINGS],
    )
    if logs is not None:
        grouped = logs.join(grouped, "file", "left")
    density, repaired = repair_density(F.col("_density"))
    rows = grouped.select(
        "*", density.alias("density"), repaired.alias("density_bracket_repaired"),
        F.col("_last.restart").alias("final_restart_index"),
        F.col("_last.subspace").alias("final_subspace_index"),
        F.col("_last.value").alias("final_residual"),
        (F.col("_last.value") <= tolerance).alias("converged"),
        initialization_time(F.col("helper_construction_time_s"), F.col("initial_state_time_s"))
        .alias("initialization_time_s"),
    )
    zero = F.lit(0)
    checks = [
        rule("no_iteration", F.coalesce("iteration_records", zero) == 0),
        rule("energy_count", F.coalesce("_energies", zero) != 1),
        rule("density_count", F.coalesce("_densities", zero) != 1),
        rule("density_malformed",
             (F.coalesce("_densities", zero) == 1) & F.col("density").isNull()),
        rule("number_not_finite",
             F.coalesce((F.col("_energies") == 1) & ~finite(F.col("energy")), F.lit(False))),
        *[rule(f"{t}_repeated", F.coalesce(f"_n_{t}", zero) > 1) for t in TIMINGS],
    ]
    if require_device:
        checks.append(rule("device_line_missing", ~F.coalesce("device_assignment_seen", F.lit(False))))
    if logs is not None and "expected_orbitals" in logs.columns:
        checks.append(rule("density_length",
                           F.coalesce(F.size("density") != F.col("expected_orbitals"), F.lit(False))))
    marked = rows.withColumn("_bad", reasons(checks))
    good = marked.where(F.size("_bad") == 0).select(
        "file", "final_residual", "converged", "iteration_records", "final_restart_index",
        "final_subspace_index", "energy", "density", "density_bracket_repaired",
        "device_assignment_seen", *TIMINGS, "initialization_time_s",
    )
    return good, marked.select("file", F.explode("_bad").alias("rule"))
