"""CRC-32C of many byte strings at once, in numpy, and the masked form that record files carry.

A CRC is linear, so zeros before a message do not change a CRC whose register starts at zero. Messages are
cut into blocks aligned at their ends, all blocks advance together eight bytes a step (by tables of two bytes
each), and the blocks of one message are joined by the operator that appends BLOCK zero bytes. The usual start
and end complements are put on afterwards as the CRC of a leading all-ones register.
"""

from __future__ import annotations

import numpy as np

POLY = 0x82F63B78
BLOCK = 512


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1).astype(np.uint32)
    return t


_T0 = _byte_table()
_LIST = _T0.tolist()


def _zeros(reg: np.ndarray, n: int) -> np.ndarray:
    """Registers after n zero bytes."""
    for _ in range(n):
        reg = _T0[reg & 0xFF] ^ (reg >> 8)
    return reg


#: _PAIR[k]: the register of each pair of bytes that 2k bytes follow.
_PAIR = [_zeros(np.arange(1 << 16, dtype=np.uint32), 2)]
for _ in range(3):
    _PAIR.append(_zeros(_PAIR[-1], 2))
#: _STEP[k][j][b]: the register b << 8j after BLOCK << k zero bytes.
_STEP: list[np.ndarray] = [np.stack([_zeros(np.arange(256, dtype=np.uint32) << (8 * j), BLOCK) for j in range(4)])]


def _apply(op: np.ndarray, reg: np.ndarray) -> np.ndarray:
    return op[0][reg & 0xFF] ^ op[1][(reg >> 8) & 0xFF] ^ op[2][(reg >> 16) & 0xFF] ^ op[3][reg >> 24]


def _blocks_op(k: int) -> np.ndarray:
    while len(_STEP) <= k:
        last = _STEP[-1]
        _STEP.append(np.stack([_apply(last, last[j]) for j in range(4)]))
    return _STEP[k]


def _shift(reg: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Registers after so many blocks of zero bytes, by the binary digits of the counts."""
    k, left = 0, blocks.copy()
    while left.any():
        on = (left & 1).astype(bool)
        if on.any():
            reg = reg.copy()
            reg[on] = _apply(_blocks_op(k), reg[on])
        left >>= 1
        k += 1
    return reg


def crc32c(messages: list[bytes]) -> np.ndarray:
    """The CRC-32C of each message (empty: 0)."""
    n = len(messages)
    lens = np.fromiter(map(len, messages), np.int64, n)
    if not n:
        return np.zeros(0, np.uint32)
    # The complement at the start equals XOR-ing ones into the first four bytes of a message that has so many.
    blocks = -(-np.maximum(lens, 4) // BLOCK)
    ends = np.cumsum(blocks)
    buf = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    view = memoryview(buf)
    for m, size, end in zip(messages, lens.tolist(), (ends * BLOCK).tolist(), strict=True):
        view[end - size : end] = m
    long = np.flatnonzero(lens >= 4)
    at = ends[long] * BLOCK - lens[long]
    for j in range(4):
        buf[at + j] ^= 0xFF
    words = buf.reshape(-1, BLOCK)
    columns = np.ascontiguousarray(words.view("<u4").T)
    reg = np.zeros(words.shape[0], np.uint32)
    for i in range(0, BLOCK // 4, 2):
        a, b = (columns[i] ^ reg).view("<u2"), columns[i + 1].view("<u2")
        reg = _PAIR[3].take(a[0::2]) ^ _PAIR[2].take(a[1::2]) ^ _PAIR[1].take(b[0::2]) ^ _PAIR[0].take(b[1::2])
    behind = np.repeat(ends, blocks) - 1 - np.arange(len(reg))
    reg = _shift(reg, behind)
    out = np.bitwise_xor.reduceat(reg, ends - blocks)
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lens < 4):
        out[i] = crc32c_one(messages[i])
    return out


def crc32c_one(message: bytes) -> int:
    """The CRC-32C of a short message."""
    reg = 0xFFFFFFFF
    for byte in message:
        reg = _LIST[(reg ^ byte) & 0xFF] ^ (reg >> 8)
    return reg ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    """A rotation by 15 bits and a fixed offset, so that a CRC of data that holds CRCs stays strong."""
    c = crc.astype(np.uint64)
    return ((((c >> np.uint64(15)) | (c << np.uint64(17))) + np.uint64(0xA282EAD8)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
