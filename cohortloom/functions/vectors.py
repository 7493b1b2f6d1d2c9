"""Bipolar codebooks. A sign is one bit of an MD5 digest, so SQL and numpy derive the same vector.

Coordinate j of vector (seed, role, id) reads bit j % 4 of hex digit (j % 128) / 4 of
md5("seed|role|id|j/128"); a shorter vector is therefore a prefix of a longer one.
"""
from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
HEX = "0123456789abcdef"


def bipolar(seed: int, role: str, ident: str, dim: int) -> np.ndarray:
    digits = "".join(hashlib.md5(f"{seed}|{role}|{ident}|{b}".encode()).hexdigest() for b in range(-(-dim // BLOCK)))
    nibbles = np.array([int(d, 16) for d in digits], dtype=np.uint8)
    bits = (nibbles[:, None] >> np.arange(4)) & 1
    return (bits.ravel()[:dim].astype(np.int8) * 2 - 1).astype(np.int8)


def bipolar_column(seed: Column, role: str, ident: Column, dim: int) -> Column:
    """The same vector as an ARRAY<TINYINT> expression."""
    blocks = F.sequence(F.lit(0), F.lit(-(-dim // BLOCK) - 1))
    prefix = F.concat(seed.cast("string"), F.lit(f"|{role}|"), ident.cast("string"), F.lit("|"))
    digits = F.array_join(F.transform(blocks, lambda b: F.md5(F.concat(prefix, b.cast("string")))), "")

    # the digit's four signs come from a table, so that a row costs one step per digit and not per coordinate
    signs = F.array(*[F.array(*[F.lit(2 * (d >> j & 1) - 1).cast("tinyint") for j in range(4)]) for d in range(len(HEX))])

    def expand(text: Column) -> Column:
        def four(i: Column) -> Column:
            return F.get(signs, F.instr(F.lit(HEX), F.substr(text, i, F.lit(1))) - 1)

        return F.slice(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(-(-dim // 4))), four)), 1, dim)

    return F.get(F.transform(F.array(digits), expand), F.lit(0))


def published_bipolar(seed: int, role: str, ident: str, dim: int, contract: str) -> np.ndarray:
    """The published codebook form: a PCG64 stream seeded by the SHA-256 of a canonical JSON key."""
    key = {"contract_version": contract, "experiment_seed": seed, "identifier": ident, "vector_role": role}
    digest = hashlib.sha256(json.dumps(key, sort_keys=True, separators=(",", ":")).encode()).digest()
    stream = np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "big")))
    return (2 * stream.integers(0, 2, size=dim, dtype=np.int8) - 1).astype(np.int8)


def level_codebook(seed: int, levels: int, dim: int) -> np.ndarray:
    """levels x dim: neighbours differ in one of levels - 1 equal groups of half the coordinates."""
    base = bipolar(seed, "level_base", str(levels), dim)
    order = sorted(range(dim), key=lambda j: (hashlib.md5(f"{seed}|level_permutation|{levels}|{j}".encode()).hexdigest(), j))
    flips_at = np.full(dim, levels)  # first level at which a coordinate is flipped
    for g, members in enumerate(np.array_split(order[: dim // 2], levels - 1), start=1):
        flips_at[members] = g
    return np.where(np.arange(levels)[:, None] >= flips_at, -base, base).astype(np.int8)


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x * y).cast("tinyint"))


def sign_with_tie(bundle: Column, tie: Column) -> Column:
    return F.zip_with(bundle, tie, lambda s, t: F.when(s > 0, 1).when(s < 0, -1).otherwise(t).cast("tinyint"))
