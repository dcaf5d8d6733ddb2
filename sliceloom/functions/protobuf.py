"""Protobuf wire format driven by a field table, JSON objects in and out."""

from __future__ import annotations

import base64
import struct

_VARINT = {"int32", "int64", "uint32", "uint64", "sint32", "sint64", "bool", "enum"}
_FIXED = {"fixed32": "<I", "sfixed32": "<i", "float": "<f", "fixed64": "<Q", "sfixed64": "<q", "double": "<d"}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        n |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return n & ((1 << 64) - 1), at
        shift += 7


def _scalar(kind: str, v) -> tuple[int, bytes]:
    if kind in _VARINT:
        n = int(v in (True, "true")) if kind == "bool" else int(v)
        return 0, _varint((n << 1) ^ (n >> 63) if kind.startswith("sint") else n)
    if kind in _FIXED:
        raw = struct.pack(_FIXED[kind], float(v) if kind in ("float", "double") else int(v))
        return 5 if len(raw) == 4 else 1, raw
    raw = base64.b64decode(v.removeprefix("base64:")) if kind == "bytes" else str(v).encode()
    return 2, _varint(len(raw)) + raw


def encode(message: dict, fields: dict[str, dict]) -> bytes:
    """``fields``: name -> {number, kind, repeated, fields}. Fields go out by number, repeated scalars packed."""
    if unknown := set(message) - set(fields):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    out = b""
    for name in sorted(message, key=lambda n: fields[n]["number"]):
        f, value = fields[name], message[name]
        number, kind, many = f["number"] << 3, f["kind"], f.get("repeated", False)
        if value is None or many and not value:
            continue
        if many and kind not in ("string", "bytes", "message"):
            body = b"".join(_scalar(kind, v)[1] for v in value)
            out += _varint(number | 2) + _varint(len(body)) + body
            continue
        for v in value if many else [value]:
            if kind == "message":
                body = encode(v, f["fields"])
                out += _varint(number | 2) + _varint(len(body)) + body
            else:
                wire, body = _scalar(kind, v)
                out += _varint(number | wire) + body
    return out


def _one(kind: str, wire: int, data: bytes, at: int):
    if wire == 0:
        n, at = _read_varint(data, at)
        if kind == "bool":
            return bool(n), at
        if kind.startswith("sint"):
            return (n >> 1) ^ -(n & 1), at
        return n - (1 << 64) if kind in ("int32", "int64", "enum") and n >> 63 else n, at
    size = 8 if wire == 1 else 4
    if at + size > len(data):
        raise ValueError("truncated")
    return struct.unpack(_FIXED[kind], data[at : at + size])[0], at + size


def decode(data: bytes, fields: dict[str, dict]) -> dict:
    """Unknown fields are skipped, absent ones left out, bytes given as base64."""
    by, out, at = {f["number"]: (n, f) for n, f in fields.items()}, {}, 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        wire, (name, f) = tag & 7, by.get(tag >> 3, (None, {"kind": "uint64"}))
        kind, values = f["kind"], []
        if wire == 2:
            n, at = _read_varint(data, at)
            body, at = data[at : at + n], at + n
            if len(body) < n:
                raise ValueError("truncated")
            if name is None:
                continue
            if kind == "message":
                values = [decode(body, f["fields"])]
            elif kind in ("string", "bytes"):
                values = [body.decode() if kind == "string" else base64.b64encode(body).decode()]
            else:
                p = 0
                while p < len(body):
                    v, p = _one(kind, 0 if kind in _VARINT else 1 if _FIXED[kind][1] in "Qqd" else 5, body, p)
                    values.append(v)
        elif wire in (0, 1, 5):
            v, at = _one(kind if name else {0: "uint64", 1: "fixed64", 5: "fixed32"}[wire], wire, data, at)
            values = [v]
        else:
            raise ValueError("groups are not supported")
        if name is not None:
            out[name] = [*out.get(name, []), *values] if f.get("repeated") else values[-1]
    return out
