"""Column functions: transforms, normalisation, direct physics, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: constants of the formulas below
VACUUM_PERMITTIVITY = 8.8541878128e-12
SIO2_PERMITTIVITY = 3.9
ELECTRON_RADIUS_ANG = 2.8179403262e-5
AVOGADRO_PER_ANG3 = 0.602214076


def log10_or_null(x: Column) -> Column:
    """log10, null for what has none."""
    return F.when(x > 0, F.log10(x))


def log10_derivative(x: Column) -> Column:
    return F.when(x > 0, 1 / (x * F.ln(F.lit(10.0))))


def normalised(x: Column, lo: float, hi: float, *, log10: bool = False, cost: bool = False, floor: float = 1e-3) -> dict[str, Column]:
    """Min-max normalisation of a value: z (floored, not clipped above), and flags floored, out_of_bounds, domain_error."""
    t = log10_or_null(x) if log10 else x
    raw = (t - lo) / (hi - lo)
    raw = 1 - raw if cost else raw
    return {"z": F.greatest(raw, F.when(raw.isNotNull(), F.lit(floor))), "floored": raw < floor, "out_of_bounds": (raw < 0) | (raw > 1), "domain_error": x.isNotNull() & t.isNull()}


def dlnz(x: Column, lo: float, hi: float, *, log10: bool = False, cost: bool = False, floor: float = 1e-3) -> Column:
    """d ln z / dx: zero where z is floored."""
    n = normalised(x, lo, hi, log10=log10, cost=cost, floor=floor)
    slope = (log10_derivative(x) if log10 else F.lit(1.0)) / (hi - lo)
    return F.when(n["floored"], 0.0).otherwise((-slope if cost else slope) / n["z"])


def capacitance_density(k: Column, thickness_nm: Column) -> Column:
    """F/m2 of a plate capacitor; null for a thickness or permittivity that isn't positive."""
    return F.when((k > 0) & (thickness_nm > 0), F.lit(VACUUM_PERMITTIVITY) * k / (thickness_nm * 1e-9))


def equivalent_oxide_thickness(k: Column, thickness_nm: Column) -> Column:
    return F.when((k > 0) & (thickness_nm >= 0), thickness_nm * SIO2_PERMITTIVITY / k)


def series_effective_k(k1: Column, t1: Column, k2: Column, t2: Column) -> Column:
    """Effective permittivity of two layers in series."""
    return F.when((k1 > 0) & (k2 > 0) & (t1 + t2 > 0), (t1 + t2) / (t1 / k1 + t2 / k2))


def tensor_average(t: str) -> Column:
    """Isotropic average of a 3x3 tensor in an array of rows."""
    at = lambda i: F.element_at(F.element_at(t, i), i)
    return (at(1) + at(2) + at(3)) / 3


def tensor_along(t: str, n: list[float]) -> Column:
    """The component along a direction, which is normalised first."""
    size = sum(x * x for x in n) ** 0.5
    u = [x / size for x in n]
    terms = [F.element_at(F.element_at(t, i + 1), j + 1) * F.lit(u[i] * u[j]) for i in range(3) for j in range(3)]
    return sum(terms[1:], terms[0])


def canonical_number(x: Column) -> Column:
    """A number's text with twelve significant digits, so that rounding noise doesn't split a group; NaN is null."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.format_string("%.11e", x.cast("double")))


def context_digest(fields: dict[str, Column]) -> Column:
    """32 hex digits over a context's fields in name order: null and '' are both not recorded, text is trimmed."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("~"))) for k, c in sorted(fields.items())]
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 32)


def xray_sld(electron_fraction: Column, density_g_cm3: Column) -> Column:
    """Real X-ray scattering length density in 1e-6 per square angstrom from density and electrons per atomic mass."""
    return F.when(density_g_cm3 > 0, density_g_cm3 * AVOGADRO_PER_ANG3 * electron_fraction * ELECTRON_RADIUS_ANG * 1e6)
