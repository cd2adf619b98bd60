"""A registry of formats and readers beside the built-in ones, which data sources resolve on executors.

A hook names its functions as "module:function", so that executors import them; what is registered first
for an extension or comes first in the list of signatures wins, and hooks go before built-in formats.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_decoders: dict[str, str] = {}
_headers: dict[str, str] = {}
_signatures: list[tuple[str, str, str]] = []  # extension, signature and mask in hexadecimal


def register_decoder(extension: str, function: str, header: str | None = None) -> bool:
    """A decoder of files of an extension; false, and no change, where there is one already.

    function: "module:function" of (bytes, most bytes to allocate) to (w, h, layout, kind, samples); header: of
    ranged reads to (w, h, layout, kind).
    """
    if decoder_registered(extension):
        return False
    _decoders[extension.lower()] = function
    if header is not None:
        _headers[extension.lower()] = header
    return True


def decoder_registered(extension: str) -> bool:
    return extension.lower() in _decoders


def register_signature(extension: str, signature: bytes, mask: bytes | None = None) -> None:
    """First bytes of files of a format; bits that the mask does not have are not compared (a short mask leaves the rest whole)."""
    mask = (mask or b"")[: len(signature)] + b"\xff" * max(0, len(signature) - len(mask or b""))
    _signatures.append((extension.lower(), signature.hex(), mask.hex()))


def clear() -> None:
    _decoders.clear()
    _headers.clear()
    _signatures.clear()


def as_option() -> str:
    """The registry as text, for the option `hooks` of a data source."""
    return json.dumps({"decoders": _decoders, "headers": _headers, "signatures": _signatures})


def from_option(text: str | None) -> tuple[dict[str, str], dict[str, str], list[tuple[str, bytes, bytes]]]:
    """Decoders, readers of headers, and signatures."""
    given = json.loads(text) if text else {}
    return dict(given.get("decoders", {})), dict(given.get("headers", {})), [(e, bytes.fromhex(s), bytes.fromhex(m)) for e, s, m in given.get("signatures", [])]


def decoders() -> dict[str, str]:
    return dict(_decoders)


def guessed(content: Column) -> Column:
    """Extension of the first registered signature that the content begins with, else null; compared in the JVM."""
    out = F.lit(None).cast("string")
    for extension, signature, mask in reversed(_signatures):
        same = F.octet_length(content) >= len(signature) // 2
        for i in range(0, len(signature), 2):
            kept = int(mask[i : i + 2], 16)
            if kept:
                byte = F.conv(F.hex(F.substring(content, i // 2 + 1, 1)), 16, 10).cast("int")
                same = same & (byte.bitwiseAND(kept) == int(signature[i : i + 2], 16) & kept)
        out = F.when(same, extension).otherwise(out)
    return out


def resolve(function: str) -> Callable:
    module, name = function.split(":", 1)
    return getattr(importlib.import_module(module), name)


def guess(head: bytes, signatures: list[tuple[str, bytes, bytes]]) -> str | None:
    """Extension of the first signature that the bytes begin with."""
    for extension, signature, mask in signatures:
        if len(head) >= len(signature) and all(b & m == s & m for b, s, m in zip(head, signature, mask, strict=False)):
            return extension
    return None


def table(spark: SparkSession) -> DataFrame:
    """place, extension, signature, mask and decoder: what is registered, in the order in which it is tried."""
    rows = [(i, e, s, m, _decoders.get(e)) for i, (e, s, m) in enumerate(_signatures)]
    rows += [(None, e, None, None, f) for e, f in _decoders.items() if e not in {x[0] for x in _signatures}]
    return spark.createDataFrame(rows, "place int, extension string, signature string, mask string, decoder string")
