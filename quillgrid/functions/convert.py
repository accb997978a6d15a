"""CONVERT: units as a rule of base factors and prefixes, looked up when the plan is made or joined as a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.core import finite, function, guarded, num

#: Metric and binary prefixes (fixed values).
METRIC = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "e": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24}
BINARY = {"Yi": 2.0**80, "Zi": 2.0**70, "Ei": 2.0**60, "Pi": 2.0**50, "Ti": 2.0**40, "Gi": 2.0**30, "Mi": 2.0**20, "ki": 2.0**10}
#: system -> unit -> size in the system's base unit (fixed values).
UNITS = {
    "mass": {"g": 1.0, "sg": 14593.902937206364, "lbm": 453.59237, "u": 1.66053906660e-24, "ozm": 28.349523125, "grain": 0.06479891, "cwt": 45359.237, "shweight": 45359.237, "uk_cwt": 50802.34544, "lcwt": 50802.34544, "hweight": 50802.34544, "stone": 6350.29318, "ton": 907184.74, "uk_ton": 1016046.9088, "LTON": 1016046.9088, "brton": 1016046.9088},
    "distance": {"m": 1.0, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9460730472580800.0, "parsec": 3.0856775814913673e16, "pc": 3.0856775814913673e16, "Pica": 0.0254 / 72, "Picapt": 0.0254 / 72, "pica": 0.0254 / 6, "survey_mi": 6336000 / 3937},
    "time": {"yr": 31557600.0, "day": 86400.0, "d": 86400.0, "hr": 3600.0, "mn": 60.0, "min": 60.0, "sec": 1.0, "s": 1.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.757293168361, "Torr": 101325 / 760},
    "force": {"N": 1.0, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176634e-19, "ev": 1.602176634e-19, "HPh": 2684519.5376961729, "hh": 2684519.5376961729, "Wh": 3600.0, "wh": 3600.0, "flb": 1.3558179483314004, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"HP": 745.69987158227022, "h": 745.69987158227022, "PS": 735.49875, "W": 1.0, "w": 1.0},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"tsp": 4.92892159375e-6, "tspm": 5e-6, "tbs": 1.478676478125e-5, "oz": 2.95735295625e-5, "cup": 2.365882365e-4, "pt": 4.73176473e-4, "us_pt": 4.73176473e-4, "uk_pt": 5.6826125e-4, "qt": 9.46352946e-4, "uk_qt": 1.1365225e-3, "gal": 3.785411784e-3, "uk_gal": 4.54609e-3, "l": 1e-3, "L": 1e-3, "lt": 1e-3, "ang3": 1e-30, "barrel": 0.158987294928, "bushel": 0.03523907016688, "ft3": 0.3048**3, "in3": 0.0254**3, "m3": 1.0, "mi3": 1609.344**3, "yd3": 0.9144**3, "Nmi3": 1852.0**3, "GRT": 2.8316846592, "regton": 2.8316846592, "MTON": 1.13267386368},
    "area": {"uk_acre": 4046.8564224, "us_acre": 4046.872609874252, "ang2": 1e-20, "ar": 100.0, "ft2": 0.3048**2, "ha": 10000.0, "in2": 0.0254**2, "m2": 1.0, "Morgen": 2500.0, "mi2": 1609.344**2, "Nmi2": 1852.0**2, "yd2": 0.9144**2},
    "information": {"bit": 1.0, "byte": 8.0},
    "speed": {"admkn": 0.514773333333333, "kn": 1852 / 3600, "m/h": 1 / 3600, "m/hr": 1 / 3600, "m/s": 1.0, "m/sec": 1.0, "mph": 0.44704},
}
TEMPERATURES = {"C": "C", "cel": "C", "F": "F", "fah": "F", "K": "K", "kel": "K", "Rank": "R", "Reau": "Re"}
#: Units that take prefixes (fixed values).
PREFIXED = {"g", "u", "m", "ang", "ly", "parsec", "pc", "sec", "s", "Pa", "p", "atm", "at", "mmHg", "N", "dyn", "dy", "pond", "J", "e", "c", "cal", "eV", "ev", "Wh", "wh", "W", "w", "T", "ga", "l", "L", "lt", "ang3", "m3", "ang2", "ar", "m2", "bit", "byte", "m/h", "m/hr", "m/s", "m/sec"}
_POWER = {"ang3": 3, "m3": 3, "ang2": 2, "m2": 2}


def unit(name: str) -> tuple[str, float] | None:
    """(system, size) of a unit with its prefix, if any."""
    for system, table in UNITS.items():
        if name in table:
            return system, table[name]
    for prefixes in (METRIC, BINARY):
        for prefix in sorted(prefixes, key=len, reverse=True):
            rest = name[len(prefix) :]
            if name.startswith(prefix) and rest in PREFIXED and (prefixes is METRIC or rest in UNITS["information"]):
                return next((s, t[rest] * prefixes[prefix] ** _POWER.get(rest, 1)) for s, t in UNITS.items() if rest in t)
    return None


def _kelvin(x: Column, kind: str) -> Column:
    return {"K": x, "C": x + 273.15, "F": (x + 459.67) * 5 / 9, "R": x * 5 / 9, "Re": x * 1.25 + 273.15}[kind]


def _from_kelvin(k: Column, kind: str) -> Column:
    return {"K": k, "C": k - 273.15, "F": k * 9 / 5 - 459.67, "R": k * 9 / 5, "Re": (k - 273.15) * 0.8}[kind]


@function("CONVERT", 3)
def CONVERT(x, from_unit: str, to_unit: str):
    """Units known when the plan is made; unknown units or different systems are #N/A."""
    if from_unit in TEMPERATURES and to_unit in TEMPERATURES:
        a, b = TEMPERATURES[from_unit], TEMPERATURES[to_unit]
        return finite(num(x) if a == b else _from_kelvin(_kelvin(num(x), a), b), args=(x,))
    a, b = unit(from_unit), unit(to_unit)
    if a is None or b is None or a[0] != b[0]:
        return guarded(F.lit(None).cast("double"), (F.lit(True), "#N/A"), args=(x,))
    return finite(num(x) * a[1] / b[1], args=(x,))


def unit_table(spark: SparkSession) -> DataFrame:
    """(name, system, size) of all units without prefix: a fixed small table to join on when units are data."""
    return spark.createDataFrame([(n, s, v) for s, t in UNITS.items() for n, v in t.items()], "name string, system string, size double")


def convert_rows(df: DataFrame, value: str, from_col: str, to_col: str, out: str = "converted") -> DataFrame:
    """CONVERT with units in columns: two joins with the fixed unit table; no match gives null (#N/A)."""
    a = F.broadcast(unit_table(df.sparkSession).select(F.col("name").alias("__fn"), F.col("system").alias("__fs"), F.col("size").alias("__fz")))
    b = F.broadcast(unit_table(df.sparkSession).select(F.col("name").alias("__tn"), F.col("system").alias("__ts"), F.col("size").alias("__tz")))
    joined = df.join(a, F.col(from_col) == F.col("__fn"), "left").join(b, F.col(to_col) == F.col("__tn"), "left")
    value_ = F.when(F.col("__fs") == F.col("__ts"), F.col(value) * F.col("__fz") / F.col("__tz"))
    return joined.withColumn(out, value_).drop("__fn", "__fs", "__fz", "__tn", "__ts", "__tz")
