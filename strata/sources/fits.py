"""Refinement records: slab models in one length unit, metadata by aliases, layers as rows; instrument states and axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: angstroms a unit, names of one parameter, the blocks of a layer in the order that wins
TO_ANGSTROM = {"angstrom": 1.0, "a": 1.0, "nm": 10.0, "um": 10_000.0, "m": 1e10}
ALIASES = {"thickness_nm": "thickness", "d": "thickness", "t": "thickness", "sigma": "roughness", "rough": "roughness"}
BLOCKS = ["structural", "optical", "xray", "neutron", "viscoelastic", "molecular"]
LENGTHS = ["thickness", "roughness"]
PLACEHOLDERS = [0.0, 1.0, 100.0, 1000.0]
LENS_SOURCES = ["recorded", "twin", "user-entered", "nominal"]
PARAMETER = "struct<value:double,min:double,max:double,vary:boolean,uncertainty:double>"
LAYER = "struct<label:string,role:string,material:string," + ",".join(f"{b}:map<string,{PARAMETER}>" for b in BLOCKS) + ">"
MODEL = f"struct<stack_id:string,sample_id:string,length_units:string,stack:array<{LAYER}>>"


def layers(records: DataFrame, column: str = "payload") -> DataFrame:
    """(record, layer, label, role, material, parameter, value, lo, hi, vary, uncertainty, swapped) of JSON slab models.

    Lengths, their bounds and uncertainties go to angstroms together; of a parameter that two blocks hold the first
    block wins, of names of one parameter within a block the first; bounds the wrong way round are turned and flagged; an
    unknown unit leaves the value null. Each record is read for itself, in one pass: rows that repeat one give rows each.
    """
    rows = records.withColumn("m", F.from_json(column, MODEL)).select("record", F.col("m.length_units").alias("unit"), F.posexplode("m.stack").alias("layer", "l"))
    none = F.array().cast(f"array<struct<key:string,value:{PARAMETER}>>")

    def named(block: str) -> Column:
        return F.transform(F.coalesce(F.map_entries(f"l.{block}"), none), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("p")))

    entries = F.flatten(F.array(*[named(b) for b in BLOCKS]))
    alias = F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p])
    rows = rows.select("record", "unit", "layer", "l.label", "l.role", "l.material", entries.alias("e"))
    rows = rows.withColumn("names", F.transform("e", lambda e: F.coalesce(F.element_at(alias, e["name"]), e["name"])))
    first = rows.select("record", "unit", "layer", "label", "role", "material", F.explode(F.filter(F.arrays_zip("names", "e"), lambda z, i: F.array_position("names", z["names"]) == i + 1)).alias("z"))
    first = first.select("record", "unit", "layer", "label", "role", "material", F.col("z.names").alias("parameter"), F.col("z.e.p").alias("p"))
    scale = F.when(F.col("parameter").isin(LENGTHS), F.element_at(F.create_map(*[F.lit(x) for p in TO_ANGSTROM.items() for x in p]), F.lower(F.coalesce("unit", F.lit("angstrom"))))).otherwise(1.0)
    lo, hi = F.col("p.min") * scale, F.col("p.max") * scale
    swapped = F.coalesce(lo > hi, F.lit(False))
    return first.select(
        "record", "layer", "label", "role", "material", "parameter", (F.col("p.value") * scale).alias("value"), F.when(swapped, hi).otherwise(lo).alias("lo"), F.when(swapped, lo).otherwise(hi).alias("hi"),
        F.coalesce("p.vary", F.lit(False)).alias("vary"), (F.col("p.uncertainty") * scale).alias("uncertainty"), swapped.alias("swapped"),
    )


def first_of(payload: Column, paths: list[str]) -> Column:
    """The first path of JSON that holds something."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths])


def caveats(value: str = "value", lo: str = "lo", hi: str = "hi", vary: str = "vary", *, tolerance: float = 1e-6) -> Column:
    """What to know of a fitted parameter: fixed, on a bound, or a placeholder constant."""
    slack = tolerance * (F.col(hi) - F.col(lo))
    on = (F.col(value) <= F.col(lo) + slack) | (F.col(value) >= F.col(hi) - slack)
    return F.array_compact(F.array(F.when(~F.col(vary), F.lit("fixed")), F.when(on, F.lit("on a bound")), F.when(~F.col(vary) & F.col(value).isin(PLACEHOLDERS), F.lit("placeholder constant"))))


def instrument_state(raw: Column) -> dict[str, Column]:
    """Typed state of an envelope's JSON: only a JSON true is reconstructed, unknown lens sources are null."""
    get = lambda p: F.get_json_object(raw, p)
    source = F.lower(F.trim(get("$.lens_strength_source")))
    return {"reconstructed": F.coalesce(get("$.twin_reconstructed") == "true", F.lit(False)), "angle": get("$.collection_semi_angle_mrad").try_cast("double"), "dispersion": get("$.dispersion_ev_per_channel").try_cast("double"), "lens_source": F.when(source.isin(LENS_SOURCES), source)}


def timestamp(text: Column) -> Column:
    """A time in any of several spellings, UTC where none is given; null where none reads."""
    formats = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
