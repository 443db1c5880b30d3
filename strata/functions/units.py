"""Units of claims: spelling, dimension, conversion to the unit that a field declares, and reconciliation with quotes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: unit spellings by dimension; compound ones (with a slash) come first and match inside a unit
DIMENSIONS = [
    ("growth_per_cycle", ["/cycle", "percycle", "/cy", "/pulse"]),
    ("rate", ["/s", "/sec", "/min", "/hour", "/h"]),
    ("density", ["g/cm3", "g/cc", "kg/m3", "gcm-3"]),
    ("sld", ["a-2", "a^-2", "1/a2", "a**-2"]),
    ("energy", ["ev", "mev", "kev", "joule", "kj/mol"]),
    ("field", ["mv/cm", "kv/cm", "v/nm", "kv/mm", "v/m"]),
    ("thermal_conductivity", ["w/mk", "w/m-k", "w/(mk)", "w/cmk"]),
    ("time", ["s", "sec", "secs", "second", "seconds", "ms", "min", "minute", "minutes", "h", "hr", "hour", "hours", "cycle", "cycles"]),
    ("temperature", ["degc", "c", "k", "degk", "celsius", "kelvin", "degf"]),
    ("pressure", ["torr", "mtorr", "pa", "kpa", "mbar", "bar", "atm", "psi"]),
    ("length", ["a", "angstrom", "angstroms", "nm", "um", "micron", "mm", "cm", "m"]),
]
# fixed values: the dimension and the unit that a field's name declares, and factors to that unit
FIELD_DIMENSION = {"growth_per_cycle_ang": "growth_per_cycle", "growth_rate_nm_min": "rate", "rho": "density", "sld_xray": "sld", "sld_neutron": "sld", "Eg": "energy", "dEc": "energy", "Ebd": "field", "kappa_th": "thermal_conductivity", "thickness_nm": "length", "roughness_ang": "length", "temperature_c": "temperature"}
FIELD_UNIT = {"growth_per_cycle_ang": "a/cycle", "growth_rate_nm_min": "nm/min", "thickness_nm": "nm", "roughness_ang": "a", "pressure_torr": "torr", "temperature_c": "degc"}
FACTORS = {
    "a/cycle": {"a/cycle": 1.0, "nm/cycle": 10.0, "pm/cycle": 0.01},
    "nm/min": {"nm/min": 1.0, "nm/s": 60.0, "a/s": 6.0, "a/min": 0.1, "um/min": 1000.0},
    "nm": {"nm": 1.0, "a": 0.1, "um": 1000.0, "mm": 1e6, "cm": 1e7, "m": 1e9, "pm": 0.001},
    "a": {"a": 1.0, "nm": 10.0, "pm": 0.01, "um": 10000.0},
    "torr": {"torr": 1.0, "mtorr": 0.001, "pa": 760.0 / 101325.0, "kpa": 760000.0 / 101325.0, "mbar": 76.0 / 101.325, "bar": 76000.0 / 101.325, "atm": 760.0, "psi": 760.0 / 14.6959487755},
    "degc": {"degc": 1.0},
}
KELVIN = 273.15


def plain(units: Column) -> Column:
    """A unit without case, spaces and a leading magnitude, 'per' written as a slash."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(units, F.lit("")))), " per ", "/"), r"[\s·]+", "")
    return F.regexp_replace(low, r"^[0-9.,+\-±]+", "")


def normalised(units: Column) -> Column:
    """The spelling that the factor table knows."""
    u = plain(units)
    for pattern, to in (("ångström|å|Å|angstroms?", "a"), ("°c|celsius|degreec|degc\\.", "degc"), ("micron|µm", "um"), ("/cy(?!cle)", "/cycle"), ("/sec(?:onds?)?$", "/s"), ("/minutes?$", "/min"), ("/hours?$", "/h")):
        u = F.regexp_replace(u, pattern, to)
    return u


def dimension(units: Column) -> Column:
    """The dimension of a unit, null where none is known."""
    def known(u: Column) -> Column:
        out = F.when(u == "", None)
        for name, marks in DIMENSIONS:
            inside, whole = [m for m in marks if "/" in m], [m for m in marks if "/" not in m]
            out = out.when(reduce(or_, [F.contains(u, F.lit(m)) for m in inside], u.isin(*whole)), name)
        return out

    return F.element_at(F.transform(F.array(plain(units)), known), 1)  # so that a unit is made plain once


def factor_rows() -> list[tuple[str, str, float]]:
    """(field, unit, factor) of every conversion that a field's declared unit allows."""
    return [(f, u, x) for f, to in FIELD_UNIT.items() for u, x in FACTORS[to].items()]


def to_declared(claims: DataFrame, field: str = "field", value: str = "value", units: str = "units") -> DataFrame:
    """Claims with canonical value and units and `converted`; what can't be converted stays as it is."""
    factors = claims.sparkSession.createDataFrame(factor_rows(), "_f string, _u string, _x double")
    declared = F.create_map(*[F.lit(x) for pair in FIELD_UNIT.items() for x in pair])
    rows = claims.withColumns({"_stated": normalised(F.col(units)), "_to": F.element_at(declared, F.col(field))})
    rows = rows.join(F.broadcast(factors), (F.col(field) == F.col("_f")) & (F.col("_stated") == F.col("_u")), "left")  # a fixed table
    kelvin = (F.col("_to") == "degc") & F.col("_stated").isin("k", "degk", "kelvin")
    other = F.col("_stated").isNotNull() & (F.col("_stated") != "") & (F.col("_stated") != F.col("_to")) & F.col(value).isNotNull()
    done = F.coalesce(other & (kelvin | F.col("_x").isNotNull()), F.lit(False))
    new = F.when(kelvin, F.round(F.col(value) - KELVIN, 4)).otherwise(F.col(value) * F.col("_x"))
    return rows.withColumns({"canonical": F.when(done, new).otherwise(F.col(value)), "canonical_units": F.when(done, F.col("_to")).otherwise(F.col(units)), "converted": done}).drop("_stated", "_to", "_f", "_u", "_x")
