"""Deterministic ids and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex width of a path hash inside a chunk id. The reference uses 6 hex digits
# (24 bits), which collide at a few thousand files; 16 is the default here.
CHUNK_HASH_WIDTH = 16
# Width of a generic (non-Java) file chunk id and of a pair id.
GENERIC_ID_WIDTH = 16
PAIR_ID_WIDTH = 16


def path_hash(rel_path: Column, width: int = CHUNK_HASH_WIDTH) -> Column:
    return F.substring(F.md5(rel_path), 1, width)


def chunk_id(rel_path: Column, chunk_type: Column, line: Column,
             width: int = CHUNK_HASH_WIDTH) -> Column:
    """``{md5(path)[:w]}_{type}_{line}``; the file chunk uses line 0."""
    return member_id(path_hash(rel_path, width), chunk_type, line)


def member_id(hashed: Column, chunk_type: Column, line: Column) -> Column:
    """X1 from a path's hash, where one serves many chunks."""
    return F.concat_ws("_", hashed, chunk_type, line.cast("string"))


def generic_chunk_id(rel_path: Column, width: int = GENERIC_ID_WIDTH) -> Column:
    return path_hash(rel_path, width)


def checksum(text: Column) -> Column:
    """sha256 hex of the UTF-8 text (or of raw bytes)."""
    return F.sha2(text, 256)


def pair_id(chunk: Column, pair_type: Column, ordinal: Column,
            width: int = PAIR_ID_WIDTH) -> Column:
    """Deterministic replacement of the reference's random pair id."""
    return F.substring(F.md5(F.concat_ws("|", chunk, pair_type, ordinal.cast("string"))), 1, width)
