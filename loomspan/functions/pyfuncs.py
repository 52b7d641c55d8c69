"""The functions that need Python, as Arrow-batched pandas functions."""

from __future__ import annotations

import base64
import binascii
import json
import math
import statistics
import struct
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + step * d or tiny)
        c = 1.0 + step / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front / a * (f - 1.0)


def inverse_beta_inc(a: float, b: float, p: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if beta_inc(a, b, mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def t_cdf(x: float, df: float) -> float:
    tail = beta_inc(df / 2, 0.5, df / (df + x * x)) / 2
    return 1.0 - tail if x > 0 else tail


def t_pdf(x: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * math.log1p(x * x / df))


def guarded(valid, f):
    """Row-wise over a batch: null where an argument is null or not valid."""

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns):
            ok = all(v is not None and not (isinstance(v, float) and math.isnan(v)) for v in row)
            out.append(f(*row) if ok and valid(*row) else None)
        return pd.Series(out, dtype=object)

    return run


def _unhex32(s: str) -> bytes | None:
    try:
        return base64.b32decode(s, casefold=True)
    except (binascii.Error, ValueError):
        return None


def _pretty(j: str) -> str | None:
    try:
        return json.dumps(json.loads(j), indent=2, ensure_ascii=False)
    except ValueError:
        return None


def _size_is(fmt: str, b: bytes) -> bool:
    return len(b) >= struct.calcsize(fmt)


_any = lambda *_: True
#: name: (arguments, result type, function)
FUNCTIONS = {
    "beta_cdf": (3, "double", guarded(lambda a, b, x: a > 0 and b > 0, beta_inc)),
    "inverse_beta_cdf": (3, "double", guarded(lambda a, b, p: a > 0 and b > 0 and 0 <= p <= 1, inverse_beta_inc)),
    "normal_cdf": (3, "double", guarded(lambda m, s, x: s > 0, lambda m, s, x: 0.5 * math.erfc((m - x) / (s * math.sqrt(2))))),
    "inverse_normal_cdf": (3, "double", guarded(lambda m, s, p: s > 0 and 0 < p < 1, lambda m, s, p: statistics.NormalDist(float(m), float(s)).inv_cdf(float(p)))),
    "t_cdf": (2, "double", guarded(lambda x, df: df > 0, t_cdf)),
    "t_pdf": (2, "double", guarded(lambda x, df: df > 0, t_pdf)),
    "normalize": (2, "string", guarded(lambda s, f: f in ("NFC", "NFD", "NFKC", "NFKD"), lambda s, f: unicodedata.normalize(f, s))),
    "to_base32": (1, "string", guarded(_any, lambda b: base64.b32encode(b).decode())),
    "from_base32": (1, "binary", guarded(_any, _unhex32)),
    "xxhash64": (1, "bigint", guarded(_any, lambda b: struct.unpack(">q", xxhash.xxh64_digest(b))[0])),
    "unpack_double": (2, "double", guarded(_size_is, lambda f, b: struct.unpack(f, b[: struct.calcsize(f)])[0])),
    "pack": (2, "binary", guarded(_any, lambda f, x: struct.pack(f, x))),
    "json_format": (1, "string", guarded(_any, _pretty)),
}


def _typed(n: int, f):
    """``f`` with the type hints that tell Spark it works on batches."""

    def one(a: pd.Series) -> pd.Series:
        return f(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return f(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return f(a, b, c)

    for g in (one, two, three):
        g.__annotations__ = {k: pd.Series for k in g.__annotations__}
    return {1: one, 2: two, 3: three}[n]


def register(spark: SparkSession, names: set[str]) -> None:
    """Register those of ``names`` (without their prefix ``loom_``) that this module has."""
    for name in names:
        if name in FUNCTIONS:
            n, kind, f = FUNCTIONS[name]
            chosen = _typed(n, f)
            spark.udf.register(f"loom_{name}", pandas_udf(chosen, kind))
