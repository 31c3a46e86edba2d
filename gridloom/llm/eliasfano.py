"""Elias-Fano coded monotone sequences in flat buffers that can be memory-mapped."""

from __future__ import annotations

import json
import mmap

import numpy as np

MAGIC = b"\x00EF\x01gram\xffseq\x02\x00\x07\x11"


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of every value, one after the other, as 64-bit words."""
    if not width or not len(low):
        return np.zeros(2, np.uint64)
    parts, step = [], 1 << 15
    shifts = np.arange(width, dtype=np.uint64)
    for at in range(0, len(low), step):
        bits = (low[at : at + step, None] >> shifts) & np.uint64(1)
        parts.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    data = np.concatenate(parts)
    return np.concatenate([data, np.zeros(16 + -len(data) % 8, np.uint8)]).view(np.uint64)


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """A non-decreasing sequence of unsigned integers: packed low bits, high bits in unary."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // max(1, n)).bit_length() - 1)
    high = values >> np.uint64(width)
    bits = np.zeros(n + (top >> width) + 2, np.uint8)
    bits[high.astype(np.int64) + np.arange(n)] = 1
    unary = np.packbits(bits, bitorder="little")
    unary = np.concatenate([unary, np.zeros(-len(unary) % 8, np.uint8)]).view(np.uint64)
    return {
        "shape": np.array([n, width, len(bits)], np.uint64),
        "low": _pack(values, width),
        "high": unary,
    }


_IN_BYTE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _rank, _place in enumerate(k for k in range(8) if _byte >> k & 1):
        _IN_BYTE[_byte, _rank] = _place
_IN_BYTE = _IN_BYTE.ravel()
_ONES, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_BYTE, _SEVEN = np.uint64(0xFF), np.uint64(3)


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the ``rank``-th one (from 0) of every word.

    One multiplication adds up the ones of a word's bytes, one subtraction compares all eight
    sums with the rank, and a table gives the place within the byte.
    """
    rank = rank.astype(np.uint64)
    ends = np.bitwise_count(words.view(np.uint8)).view(np.uint64) * _ONES
    below = ((rank * _ONES | _HIGH) - ends) & _HIGH
    shift = np.bitwise_count(below).astype(np.uint64) << _SEVEN
    before = (ends << np.uint64(8)) >> shift & _BYTE
    octet = words >> shift & _BYTE
    return (shift + _IN_BYTE[octet << _SEVEN | (rank - before)]).astype(np.int64)


class _Directory:
    """Finds the word that holds a bit by its rank: counts before every word, and the word of
    every 64th bit, from which it is a few words on; where it is farther, by halving."""

    def __init__(self, ends: np.ndarray) -> None:
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        self.before = np.concatenate([[0], ends]).astype(kind)
        sampled = np.arange(0, int(ends[-1]) + 1, 64).astype(kind)
        self.near = np.searchsorted(self.before, sampled, side="right").astype(kind) - kind(1)

    def word(self, rank: np.ndarray) -> np.ndarray:
        rank = rank.astype(self.before.dtype)
        word = self.near[rank >> 6]
        for _ in range(3):
            beyond = self.before[np.minimum(word + 1, len(self.before) - 1)] <= rank
            if not beyond.any():
                return word
            word += beyond
        far = np.flatnonzero(self.before[np.minimum(word + 1, len(self.before) - 1)] <= rank)
        if len(far):
            word[far] = np.searchsorted(self.before, rank[far], side="right") - 1
        return word


class Sequence:
    """Reads an encoded sequence in place; keeps only directories of the high bits in memory."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.n, self.width, self.bits = (int(x) for x in parts["shape"])
        self.low, self.high = parts["low"], parts["high"]
        # Eight bytes from any byte on, which hold every value of up to 57 bits whole.
        self.eight = np.ndarray((8 * len(self.low) - 7,), "<u8", self.low.view(np.uint8).data, strides=(1,))
        ends = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        self.ones = _Directory(ends)
        self.zeros = _Directory(64 * np.arange(1, len(ends) + 1) - ends)

    def __len__(self) -> int:
        return self.n

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at * self.width
        if self.width <= 57:
            value = self.eight[bit >> 3] >> (bit & 7).astype(np.uint64)
            return value & np.uint64((1 << self.width) - 1)
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = (np.uint64(64) - shift) & np.uint64(63)
        value |= np.where(shift > 0, self.low[word + 1] << over, np.uint64(0))
        return value & np.uint64((1 << self.width) - 1)

    def _one(self, rank: np.ndarray) -> np.ndarray:
        word = self.ones.word(rank)
        place = _select_in_word(self.high[word], rank - self.ones.before[word])
        return 64 * word.astype(np.int64) + place

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        word = self.zeros.word(rank)
        place = _select_in_word(~self.high[word], rank - self.zeros.before[word])
        return 64 * word.astype(np.int64) + place

    def all(self) -> np.ndarray:
        """Every value, in order."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        at = np.arange(self.n)
        return (ones - at).astype(np.uint64) << np.uint64(self.width) | self._lows(at)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        at = np.asarray(at, np.int64)
        high = (self._one(at) - at).astype(np.uint64)
        return high << np.uint64(self.width) | self._lows(at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Place of the first value that is not less than the given one; n if there is none.

        Values with the same high bits lie between two zeros of the unary part; within them
        the low bits are searched by halving.
        """
        values = np.asarray(values, np.uint64)
        bucket = (values >> np.uint64(self.width)).astype(np.int64)
        last = self.bits - self.n - 1
        beyond = bucket >= last
        bucket = np.minimum(bucket, last - 1)
        first = np.zeros(len(values), np.int64)
        inner = np.flatnonzero(bucket > 0)
        first[inner] = self._zero(bucket[inner] - 1) - bucket[inner] + 1
        end = self._zero(bucket) - bucket
        wanted = values & np.uint64((1 << self.width) - 1)
        low, high = first, end.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = self._lows(middle) < wanted[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        return np.where(beyond, self.n, low)


def dump(parts: dict[str, np.ndarray], facts: dict) -> bytes:
    """Arrays and facts as one buffer, arrays at multiples of 8 from its start."""
    places, at, data = {}, 0, []
    for name, array in parts.items():
        raw = np.ascontiguousarray(array).tobytes()
        places[name] = (array.dtype.str, len(array), at)
        raw += bytes(-len(raw) % 8)
        data.append(raw)
        at += len(raw)
    head = json.dumps({"places": places, "facts": facts}).encode()
    head += b" " * (-len(head) % 8)
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(data)


def load(path: str) -> list[tuple[dict[str, np.ndarray], dict]]:
    """Maps a file and finds the buffers in it, in order; nothing is read until it is used."""
    with open(path, "rb") as file:
        view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    return parse(view)


def parse(view: mmap.mmap | bytes) -> list[tuple[dict[str, np.ndarray], dict]]:
    """All buffers within a file or text of bytes; cut copies, as in page statistics, are left."""
    out, at = [], view.find(MAGIC)
    while at >= 0:
        start = at + len(MAGIC) + 8
        size = int.from_bytes(view[start - 8 : start], "little")
        try:
            head = json.loads(bytes(view[start : start + size]))
        except ValueError:
            at = view.find(MAGIC, start)
            continue
        start += size
        parts = {
            name: np.frombuffer(view, kind, count, offset=start + place)
            for name, (kind, count, place) in head["places"].items()
        }
        out.append((parts, head["facts"]))
        end = max((p + np.dtype(k).itemsize * c for k, c, p in head["places"].values()), default=0)
        at = view.find(MAGIC, start + end)
    return out


def encoded(prefix: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in encode(values).items()}


def sequence(parts: dict[str, np.ndarray], prefix: str) -> Sequence:
    return Sequence({k: parts[f"{prefix}.{k}"] for k in ("shape", "low", "high")})
