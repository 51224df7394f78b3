"""Block kernels in numpy: six streams from a block's records and back, each a zstd frame with a checksum."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

from ..schema import FLAG_PHRED64, MAGIC, MOST_AMBIGUOUS, PHRED33, PHRED64, VERSIONS

_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_CLEAR = np.zeros(256, bool)
_CLEAR[list(b"ACGTacgt")] = True
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
FILE_HEAD = struct.Struct("<4sBIB")
BLOCK_HEAD = {1: struct.Struct("<8I"), 2: struct.Struct("<9I")}


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.fromiter(map(len, values), np.int64, len(values))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def pack(values: list[bytes]) -> bytes:
    """2-bit bases, each record from a byte of its own."""
    return packed(*_flat(values))[0].tobytes()


def packed(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed bytes of values of these sizes that stand one after another, and how many bytes each takes."""
    room = (sizes + 3) // 4
    out = np.zeros(4 * int(room.sum()), np.uint8)
    out[np.arange(len(flat)) + np.repeat(4 * _starts(room) - _starts(sizes), sizes)] = _CODE[flat]
    four = out.reshape(-1, 4)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6, room


def unclear(flat: np.ndarray) -> np.ndarray:
    """Which bytes are not ACGTacgt."""
    return ~_CLEAR[flat]


def unpack(data: bytes, sizes: np.ndarray) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8)
    room = (sizes + 3) // 4
    if len(packed) < room.sum():
        raise ValueError("truncated sequence data")
    four = _LETTERS[(packed[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3].reshape(-1)
    return four[np.arange(int(sizes.sum())) + np.repeat(_starts(room * 4) - _starts(sizes), sizes)]


def ambiguous(values: list[bytes], names: list[bytes]) -> bytes:
    """For each record a 16-bit count and 16-bit places."""
    flat, sizes = _flat(values)
    at = np.flatnonzero(unclear(flat))
    record = np.repeat(np.arange(len(sizes)), sizes)[at]
    place = at - _starts(sizes)[record]
    if len(place) and place.max() >= MOST_AMBIGUOUS:
        worst = int(record[place >= MOST_AMBIGUOUS][0])
        raise ValueError(f"record {names[worst].decode(errors='replace')!r}: sequence length {sizes[worst]} has ambiguous bases beyond position {MOST_AMBIGUOUS}")
    counts = np.bincount(record, minlength=len(sizes))
    if len(counts) and counts.max() >= 1 << 16:
        raise ValueError("too many ambiguous bases in a record for a 16-bit count")
    out = np.zeros(len(sizes) + len(at), "<u2")
    head = np.arange(len(sizes)) + _starts(counts)
    out[head] = counts
    out[head[record] + 1 + np.arange(len(at)) - _starts(counts)[record]] = place
    return out.tobytes()


def delta(values: list[bytes], offset: int) -> bytes:
    flat, sizes = _flat(values)
    q = flat - np.uint8(offset)
    d = q.copy()
    d[1:] -= q[:-1]
    first = _starts(sizes)[sizes > 0]
    d[first] = q[first]
    return d.tobytes()


def undelta(data: bytes, sizes: np.ndarray, offset: int) -> np.ndarray:
    d = np.frombuffer(data, np.uint8)
    total = int(sizes.sum())
    if len(d) < total:
        raise ValueError("truncated quality data")
    run = np.cumsum(d[:total], dtype=np.int64)
    starts = _starts(sizes)
    before = np.where(starts > 0, run[np.maximum(starts - 1, 0)], 0) if total else starts * 0
    return ((run - np.repeat(before, sizes) + offset) & 255).astype(np.uint8)


def prefixed(values: list[bytes], what: str) -> bytes:
    if any(len(v) >= 1 << 16 for v in values):
        raise ValueError(f"{what} longer than 65535 bytes")
    return b"".join(x for v in values for x in (struct.pack("<H", len(v)), v))


def unprefixed(data: bytes, n: int, what: str) -> list[bytes]:
    out, at = [], 0
    for _ in range(n):
        if at + 2 > len(data) or at + 2 + (size := data[at] | data[at + 1] << 8) > len(data):
            raise ValueError(f"truncated {what} data")
        out.append(data[at + 2 : at + 2 + size])
        at += 2 + size
    return out


def streams(headers: list[bytes], sequences: list[bytes], pluses: list[bytes], qualities: list[bytes], offset: int) -> dict[str, bytes]:
    """The six uncompressed streams of a block."""
    return {
        "sequence": pack(sequences),
        "quality": delta(qualities, offset),
        "header": prefixed(headers, "header"),
        "plus": prefixed(pluses, "plus-line payload"),
        "npos": ambiguous(sequences, headers),
        "lengths": np.fromiter(map(len, sequences), "<u4", len(sequences)).tobytes(),
    }


def compressed(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level, write_checksum=True).compress(data)


def decompressed(data: bytes, what: str, most: int | None = None) -> bytes:
    """The content of one zstd frame, which its checksum covers; a frame of more than ``most`` bytes is refused before it is unpacked whole."""
    try:
        if most is not None:
            with zstandard.ZstdDecompressor().stream_reader(data) as reader:
                if len(reader.read(most + 1)) > most:
                    raise ValueError(f"decompressing {NAMES[what]}: larger than {most} bytes")
        d = zstandard.ZstdDecompressor().decompressobj()
        out = d.decompress(data)
    except zstandard.ZstdError as e:
        raise ValueError(f"decompressing {NAMES[what]}: {e}") from e
    if not d.eof:
        raise ValueError(f"decompressing {NAMES[what]}: truncated frame")
    return out


#: The streams as messages name them, in frames and in what follows them.
NAMES = {"sequence": "sequences", "quality": "quality", "header": "headers", "plus": "plus-line payload", "npos": "N positions", "lengths": "lengths"}
CUT = {"sequence": "sequence", "quality": "quality", "header": "header", "plus": "plus-line payload", "npos": "N position", "lengths": "length"}


def most_bytes(what: str, n: int, bases: int, qualities: int) -> int:
    """The most bytes that a stream of n records with so many bases and qualities can have."""
    return {"sequence": bases // 4 + n, "quality": qualities, "header": 65_537 * n, "plus": 65_537 * n, "npos": 2 * n + 2 * bases, "lengths": 4 * n}[what]


def block_records(data: dict[str, bytes], n: int, offset: int) -> tuple[list[bytes], list[bytes], list[bytes], list[bytes]]:
    """Headers, sequences, plus lines and qualities from a block's uncompressed streams."""
    if len(data["lengths"]) < 4 * n:
        raise ValueError("truncated length data")
    sizes = np.frombuffer(data["lengths"], "<u4", n).astype(np.int64)
    bases, quality = unpack(data["sequence"], sizes), undelta(data["quality"], sizes, offset)
    starts = _starts(sizes)
    marks, at = np.frombuffer(data["npos"][: len(data["npos"]) // 2 * 2], "<u2"), 0
    if len(marks) < n:
        raise ValueError("truncated N position data")
    if len(marks) > n:
        for i in range(n):
            if at >= len(marks) or at + 1 + int(marks[at]) > len(marks):
                raise ValueError("truncated N position data")
            if count := int(marks[at]):
                place = marks[at + 1 : at + 1 + count].astype(np.int64)
                if place.max() >= sizes[i]:
                    raise ValueError("N position beyond the sequence")
                bases[starts[i] + place] = ord("N")
            at += 1 + count
    s, q = bases.tobytes(), quality.tobytes()
    ends = starts + sizes
    cut = list(zip(starts.tolist(), ends.tolist(), strict=True))
    pluses = unprefixed(data["plus"], n, "plus-line payload") if "plus" in data else [b""] * n
    return unprefixed(data["header"], n, "header"), [s[a:b] for a, b in cut], pluses, [q[a:b] for a, b in cut]


def file_header(offset: int, block_records_: int, version: int = 2, flags: int = 0) -> bytes:
    return FILE_HEAD.pack(MAGIC, version, block_records_, flags | (FLAG_PHRED64 if offset == PHRED64 else 0))


def parse_file_header(data: bytes) -> tuple[int, int, int, int]:
    """Version, block size, flags, quality offset."""
    if len(data) < FILE_HEAD.size or data[:4] != MAGIC:
        raise ValueError("invalid magic bytes: not an FQZ file")
    _, version, size, flags = FILE_HEAD.unpack_from(data)
    if version not in VERSIONS:
        raise ValueError(f"unsupported file version: {version}")
    return version, size, flags, PHRED64 if flags & FLAG_PHRED64 else PHRED33


ORDER = {2: ("sequence", "quality", "header", "plus", "npos", "lengths"), 1: ("sequence", "quality", "header", "npos", "lengths")}


def encode_block(headers, sequences, pluses, qualities, offset: int, version: int = 2, level: int = 1) -> bytes:
    """A block of the container: its header, then its streams."""
    raw = streams(headers, sequences, pluses, qualities, offset)
    parts = {k: compressed(raw[k], level) for k in ORDER[version]}
    sizes = [len(parts[k]) for k in ORDER[version]]
    return BLOCK_HEAD[version].pack(len(headers), *sizes, sum(map(len, sequences)), sum(map(len, qualities))) + b"".join(parts[k] for k in ORDER[version])


def parse_block_header(data: bytes, version: int) -> dict[str, int]:
    if len(data) < BLOCK_HEAD[version].size:
        raise ValueError("truncated block header")
    n, *sizes, seq, qual = BLOCK_HEAD[version].unpack_from(data)
    return {"num_records": n, **dict(zip(ORDER[version], sizes, strict=True)), "orig_seq_size": seq, "orig_qual_size": qual, "payload": sum(sizes)}


def _block(data: bytes, version: int, wanted: set[str]) -> tuple[dict[str, int], dict[str, bytes]]:
    """The header of a block and its wanted streams, unpacked."""
    head = parse_block_header(data, version)
    at, raw = BLOCK_HEAD[version].size, {}
    for k in ORDER[version]:
        if at + head[k] > len(data):
            raise ValueError(f"truncated {CUT[k]} data")
        if k in wanted:
            raw[k] = decompressed(data[at : at + head[k]], k, most_bytes(k, head["num_records"], head["orig_seq_size"], head["orig_qual_size"]))
        at += head[k]
    return head, raw


def decode_block(data: bytes, version: int, offset: int):
    """Records of one block from its bytes (header and streams); checks the sizes that the header notes."""
    head, raw = _block(data, version, set(ORDER[version]))
    out = block_records(raw, head["num_records"], offset)
    if sum(map(len, out[1])) != head["orig_seq_size"] or sum(map(len, out[3])) != head["orig_qual_size"]:
        raise ValueError("block sizes differ from the header's")
    return out


#: The streams that a column needs.
NEEDS = {"header": {"header"}, "sequence": {"sequence", "npos", "lengths"}, "plus": {"plus"}, "quality": {"quality", "lengths"}}


def decode_columns(data: bytes, version: int, offset: int, columns: list[str]) -> tuple[int, dict[str, list[bytes]]]:
    """How many records a block has, and its asked columns; other streams are not unpacked. All four columns are checked like decode_block."""
    if set(columns) >= set(NEEDS):
        out = dict(zip(("header", "sequence", "plus", "quality"), decode_block(data, version, offset), strict=True))
        return len(out["header"]), out
    head, raw = _block(data, version, set().union(*(NEEDS[c] for c in columns if c in NEEDS)))
    n, out = head["num_records"], {}
    for name in ("header", "plus"):
        if name in columns:
            out[name] = unprefixed(raw[name], n, CUT[name]) if name in raw else [b""] * n
    if "lengths" in raw:
        nothing = {"sequence": b"\0" * (head["orig_seq_size"] // 4 + n), "quality": b"\0" * head["orig_qual_size"], "npos": b"\0" * (2 * n), "header": b"\0" * (2 * n)}
        _, sequences, _, qualities = block_records({k: raw.get(k, v) for k, v in nothing.items()} | {"lengths": raw["lengths"]}, n, offset)
        out |= {k: v for k, v in (("sequence", sequences), ("quality", qualities)) if k in columns}
    return n, out
