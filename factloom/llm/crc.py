"""CRC-32 of strings that are put together from parts, from the parts' checksums: a checksum is linear, so no byte is read again."""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = 0xEDB88320
NEAR = 64  # lengths with a table of their own


def _zero_byte() -> np.ndarray:
    """What a byte of zeros makes of the lowest byte of the register."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), x >> np.uint32(1)).astype(np.uint32)
    return x


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map, given by its values at each byte of each place."""
    return table[0, x & 255] ^ table[1, x >> np.uint32(8) & 255] ^ table[2, x >> np.uint32(16) & 255] ^ table[3, x >> np.uint32(24)]


class Shift:
    """Checksums after further bytes of zeros."""

    def __init__(self):
        step, byte = _zero_byte(), np.arange(256, dtype=np.uint32)
        near = [np.stack([byte << np.uint32(8 * k) for k in range(4)])]
        for _ in range(NEAR):
            near.append((near[-1] >> np.uint32(8)) ^ step[near[-1] & 255])
        self.near = np.stack(near[:NEAR])
        self.far = [near[NEAR]]  # by NEAR * 2^i bytes

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        low = (n % NEAR).astype(np.intp)
        out = self.near[low, 0, crc & 255] ^ self.near[low, 1, crc >> np.uint32(8) & 255] ^ self.near[low, 2, crc >> np.uint32(16) & 255] ^ self.near[low, 3, crc >> np.uint32(24)]
        far, i = n // NEAR, 0
        while far.any():
            if i == len(self.far):
                self.far.append(_apply(self.far[-1], self.far[-1]))
            odd = np.flatnonzero(far & 1)
            out[odd] = _apply(self.far[i], out[odd])
            far, i = far >> 1, i + 1
        return out
