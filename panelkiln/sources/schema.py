"""Column roles of a panel. Everything is read off the schema; no check runs a job except `require_unique`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIERS = ("permno", "yyyymm", "month", "date")
DUMMY_PREFIX, MACRO_PREFIX, INTERACTION_MARK = "sic2_", "macro_", "__x__"
MACROS = ("dp", "ep", "bm", "ntis", "tbl", "tms", "dfy", "svar")


#: What the special columns are for, and their usual names. The first three must exist.
USUAL = {"date": "month", "asset": "permno", "target": "ret_excess_lead1", "weight": "market_equity", "industry": "sic2"}
NEEDED = ("date", "asset", "target")
#: Columns of a panel that are neither features nor special.
CARRIED = frozenset("yyyymm ret ret_excess next_month me rf rf_welch_goyal rf_ff mktrf smb hml rmw cma umd split forecast".split())


def named(names: dict[str, str] | None = None) -> dict[str, str]:
    """The usual names, some of them replaced: {"date": "period"} renames one purpose. Unknown purposes are an error."""
    unknown = sorted(set(names or ()) - set(USUAL))
    if unknown:
        raise ValueError(f"no special columns: {', '.join(unknown)}")
    return USUAL | (names or {})


def raw_schemas(characteristics: list[str], codes: list[int] = ()) -> dict[str, T.StructType]:  # type: ignore[assignment]
    """The types of the five raw tables: for given characteristics, and for the codes that have a dummy column in the industry table."""
    def table(*columns: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField(n, kind) for n, kind in columns])

    asset, month, period = ("permno", T.LongType()), ("month", T.DateType()), ("yyyymm", T.IntegerType())
    def doubles(names: list[str]) -> list[tuple[str, T.DataType]]:
        return [(n, T.DoubleType()) for n in names]

    return {
        "stock_returns": table(asset, month, *doubles(["me", "ret"])),
        "stock_characteristics": table(asset, period, *doubles(characteristics)),
        "industry_dummies": table(asset, month, ("sic2", T.IntegerType()), *doubles([f"{DUMMY_PREFIX}{k}" for k in codes])),
        "welch_goyal_macros": table(period, *doubles([*MACROS, "rf_welch_goyal"])),
        "fama_french_factors": table(period, *doubles("rf mktrf smb hml rmw cma umd".split())),
    }


def validate(panel: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The panel itself; ValueError naming the required columns that are missing."""
    own = named(names)
    missing = sorted({own[k] for k in NEEDED} - set(panel.columns))
    if missing:
        raise ValueError(f"panel lacks {', '.join(missing)}")
    return panel


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def raw_characteristics(df: DataFrame) -> list[str]:
    """Columns of a characteristics table: all but its identifiers."""
    return [c for c in df.columns if c not in IDENTIFIERS]


def choose_columns(df: DataFrame, columns: list[str] | None = None, identifiers: tuple[str, ...] = IDENTIFIERS) -> list[str]:
    """The columns to rank: those listed (which must exist and be numeric), else every numeric one that is no identifier."""
    if columns:
        absent = sorted(set(columns) - set(df.columns))
        odd = sorted(set(columns) & set(df.columns) - set(numeric(df)))
        if absent or odd:
            raise ValueError(f"missing columns {absent}, columns that are not numeric {odd}")
        return list(columns)
    names = {x.lower() for x in identifiers}
    return [c for c in numeric(df) if c.lower() not in names]


def roles(panel: DataFrame, names: dict[str, str] | None = None) -> dict[str, list[str]]:
    """characteristics, dummies, macros and interactions of a panel, in column order."""
    special = {*named(names).values(), *CARRIED}
    found: dict[str, list[str]] = {"characteristics": [], "dummies": [], "macros": [], "interactions": []}
    for c in numeric(panel):
        if INTERACTION_MARK in c:
            found["interactions"].append(c)
        elif c.startswith(DUMMY_PREFIX):
            found["dummies"].append(c)
        elif c.startswith(MACRO_PREFIX):
            found["macros"].append(c)
        elif c not in special:
            found["characteristics"].append(c)
    return found


def select_features(panel: DataFrame, listed: list[str] | None = None, manifest: dict[str, list[str]] | None = None, names: dict[str, str] | None = None) -> list[str]:
    """Features in order of preference: a list (missing ones are an error), a manifest's, or all by role."""
    if listed:
        absent = sorted(set(listed) - set(panel.columns))
        if absent:
            raise ValueError(f"features not in the panel: {', '.join(absent)}")
        return list(listed)
    own = manifest or roles(panel, names)
    return [c for k in ("characteristics", "macros", "dummies", "interactions") for c in own.get(k, []) if c in panel.columns]


def duplicate_keys(panel: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return panel.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(panel: DataFrame, *keys: str) -> DataFrame:
    if duplicate_keys(panel, *keys).limit(1).count():
        raise ValueError(f"{', '.join(keys)} is no key")
    return panel
