"""A wavelet matrix over token ids, and its file format."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WVM2"
#: Bits of a block: between two entries of a plane's rank directory.
BLOCK = 512


class BitPlane:
    """Bits with rank and select. The directory has the ones before each block;
    blocks of zeros alone or ones alone are told by it and aren't held, so a plane
    is compressed and read in place, without being expanded."""

    def __init__(self, n: int, directory: np.ndarray, blocks: np.ndarray):
        self.n, self.directory, self.blocks = n, directory, blocks
        ones = np.diff(directory)
        self.held = (ones > 0) & (ones < BLOCK)
        self.full = ones == BLOCK
        #: For each block, how many blocks before it are held.
        self.slots = np.cumsum(self.held) - self.held

    @classmethod
    def of(cls, bits: np.ndarray) -> BitPlane:
        n = len(bits)
        packed = np.zeros(-(-max(n, 1) // BLOCK) * (BLOCK // 8), np.uint8)
        packed[: -(-n // 8)] = np.packbits(bits)
        packed = packed.reshape(-1, BLOCK // 8)
        ones = np.bitwise_count(packed.view(np.uint64)).sum(axis=1, dtype=np.uint32)
        return cls(n, np.concatenate(([0], np.cumsum(ones))).astype(np.uint32), packed[(ones > 0) & (ones < BLOCK)])

    def bits(self) -> np.ndarray:
        packed = np.zeros((len(self.held), BLOCK // 8), np.uint8)
        packed[self.full] = 255
        packed[self.held] = self.blocks
        return np.unpackbits(packed.ravel(), count=self.n).view(bool)

    def get(self, i: int) -> int:
        block, at = divmod(i, BLOCK)
        if not self.held[block]:
            return int(self.full[block])
        return int(self.blocks[self.slots[block], at >> 3] >> (7 - (at & 7)) & 1)

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        block, at = divmod(i, BLOCK)
        before = int(self.directory[block])
        if not at:
            return before
        if not self.held[block]:
            return before + at * int(self.full[block])
        part = self.blocks[self.slots[block], : (at + 7) >> 3]
        ones = int(np.bitwise_count(part).sum())
        if at & 7:
            ones -= int(part[-1] & (0xFF >> (at & 7))).bit_count()
        return before + ones

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th such bit, from 0."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if self.rank(bit, mid + 1) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo


class WaveletMatrix:
    """n ids in bit-planes, highest bit first; each plane's order is the one
    before's, stably parted by its bit (zeros first)."""

    def __init__(self, planes: list[BitPlane], n: int):
        self.planes, self.n = planes, n
        self.zeros = [p.n - p.rank1(p.n) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        kind = np.uint16 if width <= 16 else np.uint32
        order, planes = np.asarray(ids, kind), []
        for k in range(width - 1, -1, -1):
            bit = order & kind(1 << k) != 0
            planes.append(BitPlane.of(bit))
            order = np.concatenate((np.compress(~bit, order), np.compress(bit, order)))
        return cls(planes, len(order))

    def to_array(self) -> np.ndarray:
        """All ids, from the lowest plane up: what follows a plane is dealt back
        to the places of its zeros and ones."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        low = np.zeros(self.n, kind)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit, up = plane.bits(), np.empty_like(low)
            up[~bit] = low[:zeros]
            up[bit] = low[zeros:] | kind(1 << k)
            low = up
        return low.astype(np.uint32)

    def access(self, i: int) -> int:
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit = plane.get(i)
            value = value << 1 | bit
            i = zeros + plane.rank1(i) if bit else plane.rank(0, i)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        start, width = 0, len(self.planes)
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            bit = token >> (width - 1 - k) & 1
            start, end = (zeros + plane.rank1(start), zeros + plane.rank1(end)) if bit else (plane.rank(0, start), plane.rank(0, end))
        return start, end

    def rank(self, token: int, i: int) -> int:
        """How often token is among the first i ids."""
        start, end = self._range(token, i)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n) if token >> len(self.planes) == 0 else 0

    def select(self, token: int, k: int) -> int:
        """Place of token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for j, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            i = plane.select(1, i - zeros) if token >> j & 1 else plane.select(0, i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def dump(matrix: WaveletMatrix, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """One shard as a file: header, documents (a null mask, ids, ends), and for
    each plane its rank directory, then the number of its held blocks and these.
    All numbers are little-endian."""
    ids = np.array([0 if x is None else x for x in doc_ids], "<i8")
    null = np.packbits([x is None for x in doc_ids]) if doc_ids else np.zeros(0, np.uint8)
    out = [MAGIC, struct.pack("<BQQ", len(matrix.planes), matrix.n, len(ids)), null.tobytes(), ids.tobytes(), np.asarray(ends, "<i8").tobytes()]
    for plane in matrix.planes:
        out += [plane.directory.astype("<u4").tobytes(), struct.pack("<Q", len(plane.blocks)), plane.blocks.tobytes()]
    return b"".join(out)


def load(blob: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """What dump wrote; planes are views of blob, so nothing is expanded."""
    if blob[:4] != MAGIC:
        raise ValueError("not a wavelet-matrix shard")
    width, n, docs = struct.unpack_from("<BQQ", blob, 4)
    at = 4 + struct.calcsize("<BQQ")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    null = np.unpackbits(take("u1", -(-docs // 8)), count=docs)
    ids, ends = take("<i8", docs), take("<i8", docs)
    planes = []
    for _ in range(width):
        directory = take("<u4", -(-max(n, 1) // BLOCK) + 1)
        (held,) = take("<u8", 1)
        planes.append(BitPlane(n, directory, take("u1", int(held) * (BLOCK // 8)).reshape(-1, BLOCK // 8)))
    return WaveletMatrix(planes, n), [None if z else int(i) for i, z in zip(ids, null, strict=True)], ends
