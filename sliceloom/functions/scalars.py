"""Scalar functions that built-in expressions cannot state, as plain functions and Arrow-batched UDFs."""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import MARKER

_EXPR = re.compile(r"\$\{([^}]*)\}")
_LOW = np.uint64(0xFFFFFFFF)


def _byte_columns(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(position, text) of the bytes, padded, and each text's length."""
    n = np.array([len(t) for t in texts], np.int64)
    grid = np.zeros((len(texts), int(n.max()) if len(n) else 0), np.uint8)
    grid[np.arange(grid.shape[1]) < n[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return grid.T, n


def fnv128_many(texts: list[bytes]) -> list[str]:
    """FNV-1a over 128 bits, in hex, of a batch: as two 64-bit halves, all texts a byte at a time.

    The prime is 2^88 + 0x13b, so a product is a shift into the upper half and a short multiplication.
    """
    out = [""] * len(texts)
    order = np.argsort([len(t) for t in texts], kind="stable")
    for part in np.array_split(order, max(1, len(texts) // 1024)):
        grid, n = _byte_columns([texts[i] for i in part])
        hi, lo = np.full(len(part), 0x6C62272E07BB0142, np.uint64), np.full(len(part), 0x62B821756295C58D, np.uint64)
        k = np.uint64(0x13B)
        for at, column in enumerate(grid):
            x = lo ^ column
            low, mid = (x & _LOW) * k, (x >> np.uint64(32)) * k
            mid += low >> np.uint64(32)
            up = hi * k + (mid >> np.uint64(32)) + (x << np.uint64(24))
            live = at < n
            lo, hi = np.where(live, (mid << np.uint64(32)) | (low & _LOW), lo), np.where(live, up, hi)
        for i, a, b in zip(part, hi.tolist(), lo.tolist(), strict=True):
            out[i] = f"{a:016x}{b:016x}"
    return out


def fnv128(text: str) -> str:
    return fnv128_many([text.encode()])[0]


def utf8_cut(text: str | None, most: int, marker: str = MARKER) -> str | None:
    """At most ``most`` bytes, never half a character, with a marker where something was cut."""
    if text is None or len(raw := text.encode()) <= most:
        return text
    return raw[: max(0, most - len(marker.encode()))].decode("utf-8", "ignore") + marker


def one_line(reason: str, most: int = 160) -> str:
    return utf8_cut("".join(" " if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in reason), most)


def retry_delays_ms(keys: list[bytes], attempt: np.ndarray, base_ms: float, cap_ms: float) -> np.ndarray:
    """base * 2^attempt (at most 2^16) up to the cap, times a factor of 0.8 to 1.2 that key and attempt decide, up to the cap again."""
    grid, n = _byte_columns(keys)
    state = attempt.astype(np.uint64) + np.uint64(0x9E3779B9)
    for at, column in enumerate(grid):
        state = np.where(at < n, state * np.uint64(1_099_511_628_211) + column, state)
    delay = np.minimum(base_ms * 2.0 ** np.minimum(attempt, 16), cap_ms)
    nanos = np.floor(delay * 1e6 * (8000 + (state % np.uint64(4001)).astype(np.float64)) / 10_000)
    return np.minimum(nanos / 1e6, cap_ms)


def retry_delay_ms(key: str, attempt: int, base_ms: float, cap_ms: float) -> float:
    return float(retry_delays_ms([key.encode()], np.array([attempt]), base_ms, cap_ms)[0])


class TemplateError(ValueError):
    pass


def _value(expr: str, context: dict[str, str]) -> str:
    if expr.startswith("ctx."):
        if expr[4:] not in context:
            raise TemplateError(f"missing context variable {expr[4:]}")
        return context[expr[4:]]
    if expr == "gen.uuid":
        return str(uuid.uuid4())
    if m := re.fullmatch(r"gen\.int:(-?\d+):(-?\d+)", expr):
        import random

        if int(m[1]) > int(m[2]):
            raise TemplateError("empty range")
        return str(random.randint(int(m[1]), int(m[2])))
    if expr == "gen.phone":
        import random

        return f"+1{random.randrange(200, 999)}{random.randrange(100, 999)}{random.randrange(1000, 9999)}"
    raise TemplateError(f"unknown expression {expr}")


def render(template: str, context: dict[str, str]) -> str:
    if "${" in _EXPR.sub("", template):
        raise TemplateError("unterminated expression")
    return _EXPR.sub(lambda m: _value(m[1].strip(), context), template)


def render_json(value, context: dict[str, str]):
    if isinstance(value, str):
        return render(value, context)
    if isinstance(value, list):
        return [render_json(v, context) for v in value]
    return {k: render_json(v, context) for k, v in value.items()} if isinstance(value, dict) else value


def extract_path(value, path: str):
    """Dotted object keys; (found, value). A blank path is the whole value."""
    for key in [k for k in path.strip().split(".")] if path.strip() else []:
        if not isinstance(value, dict) or key not in value:
            return False, None
        value = value[key]
    return True, value


def context_string(value) -> str:
    if value is None:
        raise TemplateError("null has no text")
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def fnv128_udf(text: pd.Series) -> pd.Series:
    some = text.notna().to_numpy()
    out = np.full(len(text), None, object)
    out[some] = fnv128_many([t if isinstance(t, bytes) else t.encode() for t in text[some]])
    return pd.Series(out)


@F.pandas_udf(T.LongType())
def double_bits_udf(x: pd.Series) -> pd.Series:
    """The bit pattern of a double."""
    return pd.Series(x.to_numpy(np.float64).view(np.int64))


@F.pandas_udf(T.DoubleType())
def retry_delay_udf(key: pd.Series, attempt: pd.Series, base_ms: pd.Series, cap_ms: pd.Series) -> pd.Series:
    """Milliseconds; base and cap are the same for all rows."""
    if not len(key):
        return pd.Series([], dtype=float)
    return pd.Series(retry_delays_ms([k.encode() for k in key.fillna("")], attempt.to_numpy(), float(base_ms.iloc[0]), float(cap_ms.iloc[0])))


@F.pandas_udf(T.StringType())
def render_udf(template: pd.Series, context: pd.Series) -> pd.Series:
    def one(t, c):
        try:
            return json.dumps(render_json(json.loads(t), json.loads(c)), ensure_ascii=False, sort_keys=True)
        except TemplateError as e:
            return f"error: {e}"

    return pd.Series([one(t, c) for t, c in zip(template, context, strict=True)])


@F.pandas_udf(T.StringType())
def extract_udf(value: pd.Series, path: pd.Series) -> pd.Series:
    def one(v, p):
        found, got = extract_path(json.loads(v), p)
        return context_string(got) if found and got is not None else None

    return pd.Series([one(v, p) for v, p in zip(value, path, strict=True)])
