"""Author strings to people, as an Arrow function over the sources table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PEOPLE = T.ArrayType(T.StructType([T.StructField("surname", T.StringType()), T.StructField("initial", T.StringType())]))
_ORGANISATION = re.compile(r"(?i)\b(inc|ltd|gmbh|corp|university|institute|laborator(?:y|ies)|company|database|consortium|group|nist)\b")


def people_of(authors: str | None) -> list[dict] | None:
    """Surname and initial of each author; an empty list for an organisation, null where nothing is given."""
    if not authors or not authors.strip():
        return None
    if _ORGANISATION.search(authors):
        return []
    out = []
    for part in re.split(r"\s*(?:;|\band\b|&)\s*", re.sub(r"(?i)\bet al\.?", "", authors)):
        names = [x.strip() for x in part.split(",") if x.strip()]
        pairs = [" ".join(names)] if len(names) == 2 and re.fullmatch(r"(?:[A-Z]\.?[\s\-]*)+", names[1]) else names
        for name in pairs:
            words = name.split()
            initials = [w for w in words if re.fullmatch(r"(?:[A-Z]\.?-?)+", w) and len(w.replace(".", "")) <= 3]
            full = [w for w in words if w not in initials]
            if not full:
                continue
            surname = full[-1] if not initials or words[-1] not in initials else full[0]
            given = initials[0] if initials else (full[0] if len(full) > 1 else None)
            out.append({"surname": surname.lower(), "initial": given[0].upper() if given else None})
    return out


def organisation(authors: Column) -> Column:
    """The name of an organisation without case, punctuation and legal form; null for people and for nothing."""
    name = F.regexp_replace(F.lower(F.regexp_replace(authors, r"[^\p{L}\p{N}]+", " ")), r"\b(inc|ltd|gmbh|corp|the)\b", " ")
    return F.when(authors.rlike(_ORGANISATION.pattern), F.nullif(F.trim(F.regexp_replace(name, r"\s+", " ")), F.lit("")))


@F.pandas_udf(PEOPLE)
def parse_authors(authors: pd.Series) -> pd.Series:
    return authors.map(people_of)
