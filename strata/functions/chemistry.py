"""Formulas, labels and physics that need the atomic table, as jobs over tables of formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: atomic number and mass of the elements that are known here
ATOMS = {
    "H": (1, 1.008), "Li": (3, 6.94), "Be": (4, 9.012), "B": (5, 10.81), "C": (6, 12.011), "N": (7, 14.007), "O": (8, 15.999), "F": (9, 18.998), "Na": (11, 22.990), "Mg": (12, 24.305),
    "Al": (13, 26.982), "Si": (14, 28.085), "P": (15, 30.974), "S": (16, 32.06), "Cl": (17, 35.45), "K": (19, 39.098), "Ca": (20, 40.078), "Sc": (21, 44.956), "Ti": (22, 47.867), "V": (23, 50.942),
    "Cr": (24, 51.996), "Mn": (25, 54.938), "Fe": (26, 55.845), "Co": (27, 58.933), "Ni": (28, 58.693), "Cu": (29, 63.546), "Zn": (30, 65.38), "Ga": (31, 69.723), "Ge": (32, 72.63), "As": (33, 74.922),
    "Se": (34, 78.971), "Sr": (38, 87.62), "Y": (39, 88.906), "Zr": (40, 91.224), "Nb": (41, 92.906), "Mo": (42, 95.95), "Ru": (44, 101.07), "Rh": (45, 102.906), "Pd": (46, 106.42), "Ag": (47, 107.868),
    "Cd": (48, 112.414), "In": (49, 114.818), "Sn": (50, 118.71), "Sb": (51, 121.760), "Te": (52, 127.60), "Ba": (56, 137.327), "La": (57, 138.905), "Ce": (58, 140.116), "Nd": (60, 144.242), "Sm": (62, 150.36),
    "Eu": (63, 151.964), "Gd": (64, 157.25), "Dy": (66, 162.500), "Er": (68, 167.259), "Yb": (70, 173.045), "Lu": (71, 174.967), "Hf": (72, 178.486), "Ta": (73, 180.948), "W": (74, 183.84), "Re": (75, 186.207),
    "Os": (76, 190.23), "Ir": (77, 192.217), "Pt": (78, 195.084), "Au": (79, 196.967), "Hg": (80, 200.592), "Tl": (81, 204.38), "Pb": (82, 207.2), "Bi": (83, 208.980),
}
# fixed values: the axes of a label and the tensor components they stand for
AXES = {"o": "xx", "e": "zz", "alpha": "xx", "beta": "yy", "gamma": "zz", "x": "xx", "y": "yy", "z": "zz", "iso": "iso"}

ELEMENT = r"([A-Z][a-z]?)(\d+(?:\.\d+)?)?"


def element_counts(formula: Column) -> Column:
    """map<element, count> of a formula without brackets; null where anything doesn't read or an element is unknown."""
    reads = formula.rlike(f"^(?:{ELEMENT})+$")
    names = F.regexp_extract_all(formula, F.lit(ELEMENT), 1)
    counts = F.transform(F.regexp_extract_all(formula, F.lit(ELEMENT), 2), lambda c: F.when(c == "", 1.0).otherwise(c.try_cast("double")))
    known = F.size(F.array_except(names, F.array(*map(F.lit, ATOMS)))) == 0
    total = lambda n: F.aggregate(F.zip_with(names, counts, lambda a, c: F.when(a == n, c).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when(reads & known, F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, total(n)))))


def divisor(counts: Column) -> Column:
    """The greatest common divisor of whole counts, by trial from the smallest count down; null for fractions."""
    values = F.map_values(counts)
    whole = F.forall(values, lambda v: v == F.floor(v))
    by = F.filter(F.sequence(F.lit(1), F.array_min(values).cast("int")), lambda g: F.forall(values, lambda v: v % g == 0))
    return F.when(whole & (F.array_min(values) >= 1), F.array_max(by))


def electron_fractions(formulas: DataFrame, column: str = "formula") -> DataFrame:
    """(formula, z_over_a): electrons per atomic mass; null for formulas that don't read."""
    atoms = formulas.sparkSession.createDataFrame([(k, float(z), a) for k, (z, a) in ATOMS.items()], "element string, z double, a double")
    read = formulas.select(column).distinct().withColumn("c", element_counts(F.col(column)))
    parts = read.select(column, F.explode_outer("c").alias("element", "n")).join(F.broadcast(atoms), "element", "left")  # a fixed table
    return parts.groupBy(column).agg((F.sum(F.col("n") * F.col("z")) / F.sum(F.col("n") * F.col("a"))).alias("z_over_a"))


def label_parts(label: Column) -> dict[str, Column]:
    """A packed dataset label's phase, source, axis, quantity and method by the kind of each pipe-separated token; the rest in `left`."""
    tokens = F.filter(F.transform(F.split(label, r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    kind = lambda t: (
        F.when(t.rlike(r"(?i)^axis[ =:]"), "axis").when(t.rlike(r"(?i)^(n|k|n,k|density|sld_real|sld_imag|xray_sld_real|xray_sld_imag)$"), "quantity").when(t.rlike(r"(?i)^(DFT|DFPT|ellipsometry|XRR|literature|calc.*)$"), "method")
        .when(t.rlike(r"^[A-Z][A-Za-z\-]+ (19|20)\d\d"), "source").when(t.rlike(r"(?i)^(amorphous|monoclinic|tetragonal|cubic|hexagonal|orthorhombic|rutile|anatase|alpha|beta|gamma|.*-[A-Z][a-z]?[A-Za-z0-9]*)$"), "phase").otherwise("left")
    )
    kinds = F.transform(tokens, lambda t: F.struct(kind(t).alias("kind"), t.alias("t")))
    first = lambda k: F.try_element_at(F.transform(F.filter(kinds, lambda x: x["kind"] == k), lambda x: x["t"]), F.lit(1))
    return {k: first(k) for k in ("phase", "source", "axis", "quantity", "method")} | {"left": F.transform(F.filter(kinds, lambda x: x["kind"] == "left"), lambda x: x["t"])}


def tensor_component(axis: Column) -> Column:
    """The component of an axis name, null for one that isn't known."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in AXES.items() for x in pair]), F.lower(F.trim(axis)))


def tag_temperature_c(tag: Column) -> Column:
    """The temperature that a tag ends in, in degrees Celsius: 300K or 25C."""
    number = F.regexp_extract(tag, r"(-?\d+(?:\.\d+)?)\s*(?:K|C)$", 1).try_cast("double")
    return F.when(tag.rlike(r"\d\s*K$"), number - 273.15).when(tag.rlike(r"\d\s*C$"), number)


def is_ambient(t: Column) -> Column:
    return t.isNull() | t.between(15, 30)
