"""Scalar helpers: typed casts, nested parameters, colors."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_type(c: Column) -> Column:
    """The narrowest reading of a text: bigint, then double, as text; else the text itself."""
    return F.coalesce(c.try_cast("bigint").cast("string"), c.try_cast("double").cast("string"), c)


def ensure(c: Column, dtype: str) -> Column:
    return c.try_cast(dtype)


def title_to_snake(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


def hex_to_rgb(c: Column) -> list[Column]:
    """Three whole numbers of '#rrggbb'."""
    return [F.conv(F.substring(c, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b)]))


def rgb_to_lut(r: Column, g: Column, b: Column) -> Column:
    return r * 65536 + g * 256 + b


def lighter(c: Column, fraction: float = 0.3) -> Column:
    """A channel (0..1) blended to white."""
    return c + (1 - c) * fraction


def darker(c: Column, fraction: float = 0.3) -> Column:
    return c * (1 - fraction)


def orientation_to_rgb(x: Column, y: Column, z: Column) -> list[Column]:
    """Absolute direction cosines."""
    n = F.sqrt(x * x + y * y + z * z)
    return [F.when(n > 0, F.abs(a) / n).otherwise(F.lit(0.0)) for a in (x, y, z)]


# nested parameters (driver side)
def get(parameter: dict, key: str | list[str], default: Any = None) -> Any:
    """Nested value of a dotted key."""
    for k in key.split(".") if isinstance(key, str) else key:
        if not isinstance(parameter, dict) or k not in parameter:
            return default
        parameter = parameter[k]
    return parameter


def put(parameter: dict, key: str | list[str], value: Any) -> dict:
    """A copy with the nested value set."""
    out = copy.deepcopy(parameter)
    at = out
    keys = key.split(".") if isinstance(key, str) else list(key)
    for k in keys[:-1]:
        at = at.setdefault(k, {})
    at[keys[-1]] = value
    return out


def join(*parameters: dict) -> dict:
    """Later values win."""
    out: dict = {}
    for p in parameters:
        out |= p
    return out


def prepend(parameter: dict, key: str) -> dict:
    return {f"{key}.{k}": v for k, v in parameter.items()}


def deep_merge(a: dict, b: dict) -> dict:
    """Nested union in which values of ``a`` win; only missing keys come from ``b``."""
    out = copy.deepcopy(a)
    for k, v in b.items():
        if k not in out:
            out[k] = copy.deepcopy(v)
        elif isinstance(out[k], dict) and isinstance(v, dict):
            out[k] = deep_merge(out[k], v)
    return out


def remove_extra_keys(a: dict, reference: dict) -> dict:
    """``a`` without keys that the reference lacks."""
    return {k: remove_extra_keys(v, reference[k]) if isinstance(v, dict) and isinstance(reference[k], dict) else v for k, v in a.items() if k in reference}
