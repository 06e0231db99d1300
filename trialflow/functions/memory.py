"""Work and memory estimates from input counts; all integers are bigint.

Spark's ANSI mode raises on overflow, so a wrong estimate never wraps silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.functions.stats import MIB

# fixed values of the memory policy
WORD = 8
ALIGN = 64 * MIB
GUARD_BASE = 512 * MIB
DEVICE_CAP = 20 * 1024 * MIB


def big(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, big(b))


def ceil_div(a: Column, b: Column | int) -> Column:
    return div(a + big(b) - big(1), b)


def work_proxy(
    n_alpha: Column, n_beta: Column, alpha_single: Column, alpha_double: Column,
    beta_single: Column, beta_double: Column,
) -> Column:
    """``A*B + B*E_alpha + A*E_beta + S_alpha*S_beta`` with ``E = S + D`` directed edges."""
    a, b = big(n_alpha), big(n_beta)
    return (
        a * b + b * (alpha_single + alpha_double) + a * (beta_single + beta_double)
        + big(alpha_single) * big(beta_single)
    )


def word_counts(n_orbitals: Column, bit_length: Column) -> tuple[Column, Column]:
    """Words of one string and of one interleaved pair; NULL above 64 bits per word."""
    valid = (bit_length > 0) & (bit_length <= 64) & (n_orbitals > 0)
    n = big(n_orbitals)
    return (
        F.when(valid, ceil_div(n, bit_length)),
        F.when(valid, ceil_div(n * 2, bit_length)),
    )


def integral_scalars(n_orbitals: Column) -> dict[str, Column]:
    """Pair slots and stored doubles that follow from the orbital count."""
    n = big(n_orbitals)
    pairs = div(n * (n + 1), 2)
    compact = div(pairs * (pairs + 1), 2)
    return {
        "compact_two_electron_slots": compact,
        "source_integral_doubles": big(6) * n * n + compact,
    }


def safe_edges(edges: Column, count: Column) -> Column:
    """Known edges, or the full directed graph as an upper bound."""
    n = big(count)
    return F.coalesce(edges, n * (n - 1))


def guard(known_bytes: Column) -> Column:
    """Padded guard: twice the known bytes plus a base, rounded up to 64 MiB."""
    return ceil_div(big(GUARD_BASE) + big(2) * known_bytes, ALIGN) * big(ALIGN)


def host_cap(free_bytes: Column) -> Column:
    return div(big(free_bytes) * 4, 5)


def gpu_cap(free_bytes: Column) -> Column:
    return F.least(big(DEVICE_CAP), div(big(free_bytes) * 4, 5))


def memory_estimate(
    df: DataFrame,
    *,
    bit_length: Column | int,
    max_block: Column | int,
    iterations: Column | int,
    method: int = 0,
    rdm: int = 0,
    alpha_comm_size: Column | int = 1,
    beta_comm_size: Column | int = 1,
    task_comm_size: Column | int = 1,
) -> DataFrame:
    """Append the 17 estimate columns.

    Needs ``n_orbitals, n_alpha, n_beta, integral_records, file_bytes`` and the edge
    counts ``alpha_single, alpha_double, beta_single, beta_double`` (all NULL when the
    pair budget was exceeded). One ``select``: no shuffle, whole-stage codegen.
    """
    if method != 0 or rdm != 0:
        raise ValueError("the estimate covers method 0 without density matrices only")
    c = F.col
    w, b, i = big(bit_length), big(max_block), big(iterations)
    pa, pb, pt = big(alpha_comm_size), big(beta_comm_size), big(task_comm_size)
    a, bt = big(c("n_alpha")), big(c("n_beta"))
    exact = c("alpha_single").isNotNull()
    word = big(WORD)
    staged = df.select(
        "*",
        ceil_div(big(c("n_orbitals")), w).alias("_h"),
        ceil_div(big(c("n_orbitals")) * 2, w).alias("_d"),
        ceil_div(a, pa).alias("_la"), ceil_div(bt, pb).alias("_lb"),
        safe_edges(c("alpha_single"), a).alias("_as"), F.coalesce("alpha_double", big(0)).alias("_ad"),
        safe_edges(c("beta_single"), bt).alias("_bs"), F.coalesce("beta_double", big(0)).alias("_bd"),
        integral_scalars(c("n_orbitals"))["source_integral_doubles"].alias("_doubles"),
        ceil_div(pa * pb + pa + pb, pt).alias("_tasks"),
    )
    la, lb, h, d = c("_la"), c("_lb"), c("_h"), c("_d")
    sa, da, sb, db = c("_as"), c("_ad"), c("_bs"), c("_bd")
    m = la * lb
    both = a + bt
    largest_map = F.greatest(sa + da + la * 4, sb + db + lb * 4, sa + sb + la * 2 + lb * 2) + 2
    first = staged.select(
        *df.columns,
        (c("integral_records") * 32 + c("file_bytes") * 2 + word * h * both + both * 24)
        .alias("input_envelope_bytes"),
        (word * c("_doubles")).alias("integral_bytes"),
        (word * a * bt * d).alias("determinant_cache_bytes"),
        (word * h * both).alias("determinant_cache_temporary_bytes"),
        (word * c("_tasks") * ((sa + da + sb + db) * 2 + la * 6 + lb * 6 + 4)).alias("helper_host_bytes"),
        (word * ((b * 2 + 7) * m + b * b * 2 + b + b * i)).alias("davidson_bytes"),
        (word * largest_map).alias("gpu_helper_max_bytes"),
        m.alias("local_configurations"),
        (~(exact & (pa == 1) & (pb == 1) & (pt == 1))).alias("helper_is_upper_bound"),
    )
    second = first.select(
        "*",
        c("integral_bytes").alias("gpu_flat_integral_host_bytes"),
        (word * 2 * c("local_configurations") + c("gpu_helper_max_bytes")).alias("gpu_task_temporary_bytes"),
        (
            c("input_envelope_bytes") + c("integral_bytes") + c("determinant_cache_bytes")
            + c("determinant_cache_temporary_bytes") + c("helper_host_bytes") + c("davidson_bytes")
        ).alias("host_known_bytes"),
    )
    third = second.select(
        "*",
        (c("host_known_bytes") + c("integral_bytes")).alias("gpu_host_known_bytes"),
        (
            c("integral_bytes") + c("determinant_cache_bytes")
            + F.greatest("determinant_cache_temporary_bytes", "gpu_task_temporary_bytes")
        ).alias("gpu_known_bytes"),
    )
    return third.select(
        "*",
        guard(c("host_known_bytes")).alias("host_guard_bytes"),
        guard(c("gpu_host_known_bytes")).alias("gpu_host_guard_bytes"),
        guard(c("gpu_known_bytes")).alias("gpu_guard_bytes"),
    )


def feasible(
    backend: Column, host_guard: Column, gpu_host_guard: Column, gpu_guard: Column,
    host_cap_bytes: Column, gpu_cap_bytes: Column,
) -> Column:
    """Guard within cap: host for CPU, host and device for GPU; NULL for other backends."""
    return F.when(backend == "cpu", host_guard <= host_cap_bytes).when(
        backend == "gpu", (gpu_host_guard <= host_cap_bytes) & (gpu_guard <= gpu_cap_bytes)
    )
