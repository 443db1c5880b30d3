"""The rules that an instrument envelope must keep, as issues (code, severity, path): for records, their signals, axes and scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"
# fixed values: what a record, a scalar and an axis may call themselves, and the axes that need units
RECORD_KINDS = ["experimental", "simulation", "hybrid"]
DERIVATIONS = ["measured", "fitted", "calculated", "simulated"]
AXIS_KINDS = ["spatial", "energy", "momentum", "time", "other"]
UNIT_KINDS = ["spatial", "energy", "momentum", "time"]
STATE = ["beam_energy_kev", "convergence_semi_angle_mrad", "collection_semi_angle_mrad", "camera_length_mm", "aperture_um", "dispersion_ev_per_channel"]

#: Of the versions of the contract, those with this major number are read.
READABLE = r"^[A-Za-z-]+/0(\.|$)"

SCHEMA = (
    "contract_version string, record_id string, record_kind string, acquired_at string, sample struct<sample_id:string,material_id:string>, instrument struct<instrument_id:string,technique:string>, "
    f"instrument_state struct<{','.join(f'{c}:double' for c in STATE)},calibration_validity_window:array<string>>, calibrations map<string,struct<dispersion_ev_per_channel:double>>, "
    "signals array<struct<signal_id:string,shape:array<int>,axes:array<struct<name:string,kind:string,units:string,size:int,units_source:string>>,data_ref:struct<scheme:string,record_id:string,uri:string>>>, "
    "simulation struct<code:string>, derived_scalars array<struct<name:string,value:double,uncertainty:double,units:string,derivation:string,source_signal_ids:array<string>,method:string>>, datafed struct<record_id:string>"
)

Rule = tuple[str, str, str, Column]


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def _record_rules() -> list[Rule]:
    kind, window = F.lower(F.trim(F.coalesce("record_kind", F.lit("")))), F.col("instrument_state.calibration_validity_window")
    state = {c: F.col(f"instrument_state.{c}") for c in STATE}
    state["dispersion_ev_per_channel"] = F.coalesce(state["dispersion_ev_per_channel"], F.get(F.map_values("calibrations"), F.lit(0))["dispersion_ev_per_channel"])
    at = F.col("acquired_at").try_cast("timestamp")
    expired = (F.size(window) == 2) & ((at < F.get(window, F.lit(0)).try_cast("timestamp")) | (at > F.get(window, F.lit(1)).try_cast("timestamp")))
    return [
        ("record.id_missing", ERROR, "record_id", _blank("record_id")), ("record.kind_invalid", ERROR, "record_kind", ~kind.isin(RECORD_KINDS)), ("sample.id_missing", ERROR, "sample.sample_id", _blank("sample.sample_id")),
        ("sample.material_id_present", WARNING, "sample.material_id", ~_blank("sample.material_id")), ("record.acquired_at_missing", WARNING, "acquired_at", _blank("acquired_at")),
        ("instrument.id_missing", ERROR, "instrument.instrument_id", _blank("instrument.instrument_id")), ("instrument.technique_missing", WARNING, "instrument.technique", _blank("instrument.technique")),
        *[("state.negative_quantity", ERROR, f"instrument_state.{c}", x < 0) for c, x in state.items()],
        ("state.convergence_exceeds_collection", WARNING, "instrument_state.convergence_semi_angle_mrad", state["convergence_semi_angle_mrad"] > state["collection_semi_angle_mrad"]),
        ("state.quality", WARNING, "instrument_state", state["dispersion_ev_per_channel"].isNull() | state["collection_semi_angle_mrad"].isNull() | expired),
        ("signals.none", ERROR, "signals", F.coalesce(F.size("signals"), F.lit(0)) < 1), ("simulation.metadata_missing", ERROR, "simulation", (kind == "simulation") & F.col("simulation").isNull()),
        ("simulation.on_experimental_record", WARNING, "simulation", (kind == "experimental") & F.col("simulation").isNotNull()), ("simulation.code_missing", WARNING, "simulation.code", F.col("simulation").isNotNull() & _blank("simulation.code")),
        ("datafed.record_id_missing", WARNING, "datafed.record_id", _blank("datafed.record_id")),
    ]


def _signal_rules() -> list[Rule]:
    same, shape, axes, ref = F.exists(F.slice("ids", F.lit(1), F.col("i")), lambda x: x == F.col("s.signal_id")), F.col("s.shape"), F.col("s.axes"), F.col("s.data_ref")
    empty = F.coalesce(F.size(shape), F.lit(0)) < 1
    return [
        ("signal.id_missing", ERROR, ".signal_id", _blank("s.signal_id")), ("signal.id_duplicate", ERROR, ".signal_id", ~_blank("s.signal_id") & (F.col("i") > 0) & same), ("signal.shape_missing", ERROR, ".shape", empty),
        ("signal.axis_count_mismatch", ERROR, ".axes", ~empty & (F.greatest(F.lit(0), F.coalesce(F.size(axes), F.lit(0))) != F.size(shape))), ("signal.data_ref_missing", WARNING, ".data_ref", ref.isNull()),
        ("signal.data_ref_scheme_missing", WARNING, ".data_ref.scheme", ref.isNotNull() & _blank("s.data_ref.scheme")), ("signal.data_ref_target_missing", WARNING, ".data_ref", ref.isNotNull() & _blank("s.data_ref.record_id") & _blank("s.data_ref.uri")),
    ]


def _axis_rules() -> list[Rule]:
    kind, name = F.lower(F.coalesce("x.kind", F.lit("other"))), F.lower(F.coalesce("x.name", F.lit("")))
    read = F.when(kind.isin(AXIS_KINDS), kind).otherwise("other")
    needs = read.isin(UNIT_KINDS) & _blank("x.units")
    return [
        ("signal.axis_size_mismatch", ERROR, ".size", (F.size("shape") == F.col("n_axes")) & (F.col("x.size") != F.get("shape", F.col("j")))), ("signal.axis_kind_unrecognised", WARNING, ".kind", (read == "other") & ~name.isin(AXIS_KINDS)),
        ("signal.axis_units_missing", ERROR, ".units", needs), ("signal.axis_units_from_caller", WARNING, ".units", ~needs & (F.col("x.units_source") == "caller")),
    ]


def _scalar_rules() -> list[Rule]:
    sources, value = F.coalesce("v.source_signal_ids", F.array().cast("array<string>")), F.col("v.value").isNotNull()
    return [
        ("scalar.malformed", ERROR, "", F.col("v").isNull()), ("scalar.name_missing", ERROR, ".name", F.col("v").isNotNull() & _blank("v.name")),
        ("scalar.derivation_invalid", ERROR, ".derivation", F.col("v").isNotNull() & ~F.lower(F.trim(F.coalesce("v.derivation", F.lit("")))).isin(DERIVATIONS)), ("scalar.no_source_signal", ERROR, ".source_signal_ids", F.col("v").isNotNull() & (F.size(sources) == 0)),
        ("scalar.source_signal_unknown", ERROR, ".source_signal_ids", F.size(F.array_except(sources, F.col("ids"))) > 0), ("scalar.units_missing", ERROR, ".units", value & _blank("v.units")),
        ("scalar.uncertainty_missing", WARNING, ".uncertainty", value & F.col("v.uncertainty").isNull()), ("scalar.method_missing", WARNING, ".method", F.col("v").isNotNull() & _blank("v.method")),
    ]


def _found(rows: DataFrame, key: str, rules: list[Rule], under: Column) -> DataFrame:
    each = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"), F.concat(under, F.lit(path)).alias("path"))) for code, level, path, broken in rules]))
    return rows.select(key, F.explode(each).alias("_i")).select(key, "_i.*")


def issues(envelopes: DataFrame, key: str) -> DataFrame:
    """(key, code, severity, path) of what envelopes of SCHEMA break, a row a broken rule; of one in a version that can't be read, only that.

    Nulls and missing parts break the rules that ask for them, and no others; an unknown source is one issue a scalar.
    """
    unread = ~F.coalesce(F.col("contract_version").rlike(READABLE), F.lit(False))
    rows = envelopes.where(~unread).withColumn("ids", F.transform(F.coalesce("signals", F.array()), lambda s: s["signal_id"]))
    at = lambda name, i: F.concat(F.lit(f"{name}["), F.col(i).cast("string"), F.lit("]"))
    signals = rows.select(key, "ids", F.posexplode("signals").alias("i", "s"))
    axes = signals.select(key, "i", F.col("s.shape").alias("shape"), F.size("s.axes").alias("n_axes"), F.posexplode("s.axes").alias("j", "x"))
    scalars = rows.select(key, "ids", F.posexplode("derived_scalars").alias("i", "v"))
    found = _found(rows, key, _record_rules(), F.lit("")).union(_found(signals, key, _signal_rules(), at("signals", "i")))
    found = found.union(_found(axes, key, _axis_rules(), F.concat(at("signals", "i"), F.lit("."), at("axes", "j")))).union(_found(scalars, key, _scalar_rules(), at("derived_scalars", "i")))
    return found.union(_found(envelopes.where(unread), key, [("contract.version_unsupported", ERROR, "contract_version", F.lit(True))], F.lit("")))
