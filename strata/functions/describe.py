"""Texts, ids and fingerprints made of recorded fields; what isn't recorded is named."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what a quantity is called, by its key
SYNONYMS = {"n": ["n", "refractive index", "index of refraction"], "k": ["k", "extinction coefficient"], "rho": ["rho", "density", "mass density"], "Eg": ["eg", "band gap", "bandgap"], "kappa_th": ["kappa", "thermal conductivity"]}


def quantity_of(text: Column) -> Column:
    """The key of a quantity's name, null for one that isn't known."""
    names = {s: k for k, ss in SYNONYMS.items() for s in ss}
    return F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


def asked_wavelength_nm(text: Column) -> Column:
    """The wavelength of a question such as "n at 1550 nm"."""
    return F.nullif(F.regexp_extract(text, r"(?i)\bat\s+(\d+(?:\.\d+)?)\s*nm\b", 1), F.lit("")).cast("double")


def method_text(fields: dict[str, Column]) -> Column:
    """The recorded settings in order, and those that were not recorded by name."""
    said = F.concat_ws("; ", *[F.when(c.isNotNull(), F.concat(F.lit(f"{k} "), c.cast("string"))) for k, c in fields.items()])
    lacks = F.concat_ws(", ", *[F.when(c.isNull(), F.lit(k)) for k, c in fields.items()])
    return F.when(lacks != "", F.concat(F.when(said != "", F.concat(said, F.lit("; "))).otherwise(""), F.lit("not recorded: "), lacks)).otherwise(said)


def citation(author: Column, year: Column, title: Column, doi: Column) -> Column:
    return F.concat_ws(". ", F.concat_ws(" ", author, F.when(year.isNotNull(), F.concat(F.lit("("), year.cast("string"), F.lit(")")))), title, F.when(doi.isNotNull(), F.concat(F.lit("doi:"), doi)))


def agreement(n: Column, spread: Column) -> Column:
    return F.when(n == 0, "Nothing measured.").when(n == 1, "Measured once; nothing checks it.").otherwise(F.format_string("%d measurements within %.1f%%.", n, spread * 100))


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of named fields in name order."""
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("~"))) for k, c in sorted(fields.items())]).cast("binary"), 256)


def stable_id(owner: Column, label: Column) -> Column:
    """An id of an owner and a label that doesn't depend on the order of rows."""
    return F.concat(owner.cast("string"), F.lit("-"), F.substring(F.sha2(label.cast("binary"), 256), 1, 8))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def eigenvalues(tensor: pd.Series) -> pd.Series:
    """Eigenvalues, ascending, of the symmetrised 3x3 tensors; null for anything else."""

    def one(t):
        try:
            m = np.array([list(r) for r in t], float)
        except (TypeError, ValueError):
            return None
        return np.linalg.eigvalsh((m + m.T) / 2).tolist() if m.shape == (3, 3) and np.isfinite(m).all() else None

    return tensor.map(one)


def label_rows():
    """A table function: label -> (position, token), for lateral joins."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="position: int, token: string")
    class Tokens:
        def eval(self, label: str):
            for i, x in enumerate(x.strip() for x in (label or "").split("|")):
                if x:
                    yield i, x

    return Tokens
