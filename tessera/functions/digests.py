"""MD5 of many short texts at once, as far as an order of digests asks for it."""

from __future__ import annotations

import hashlib

import numpy as np

_K = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_R = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_LEFT, _RIGHT, _ADD = ([np.array(x, np.uint32) for x in xs] for xs in (_R, [32 - r for r in _R], _K))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The longest text of a single block of MD5, and texts hashed at once: a few arrays of these fit a core's cache.
LONGEST, AT_ONCE = 55, 32768


class Endings:
    """Texts that follow many different beginnings."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.groups = texts, []
        lengths = np.array([len(t) for t in texts], np.int64)
        for n in np.unique(lengths).tolist():
            where = np.flatnonzero(lengths == n)
            for i in range(0, len(where), AT_ONCE):
                at = where[i : i + AT_ONCE]
                chars = np.frombuffer(b"".join(texts[j] for j in at.tolist()), np.uint8).reshape(len(at), n)
                self.groups.append((at, n, chars, {}))

    def heads(self, starts: list[bytes]) -> np.ndarray:
        """The first 32 bits of the MD5 of each start (all of one length) and each ending, as big-endian numbers."""
        out = np.empty((len(starts), len(self.texts)), np.uint32)
        size = len(starts[0])
        whole, shift = divmod(size, 4)
        padded = np.frombuffer(b"".join(s.ljust(4 * whole + 4, b"\0") for s in starts), "<u4").reshape(len(starts), whole + 1)
        for at, n, chars, packed in self.groups:
            if size + n > LONGEST:
                for i, s in enumerate(starts):
                    out[i, at] = [int.from_bytes(hashlib.md5(s + self.texts[j]).digest()[:4], "big") for j in at.tolist()]
                continue
            if shift not in packed:
                wide = np.zeros((len(at), (shift + n) // 4 * 4 + 4), np.uint8)
                wide[:, shift : shift + n] = chars
                wide[:, shift + n] = 0x80
                packed[shift] = np.ascontiguousarray(wide.view("<u4").T)
            step = max(AT_ONCE // len(at), 1)
            for lo in range(0, len(starts), step):
                head = padded[lo : lo + step]
                words: list = [0] * 16
                for i in range(whole):
                    words[i] = head[:, i : i + 1]
                for i, w in enumerate(packed[shift]):
                    words[whole + i] = w
                if shift:
                    words[whole] = words[whole] | head[:, whole:]
                words[14] = 8 * (size + n)
                out[lo : lo + step, at] = _first(words, (len(head), len(at)))
        return out


def _first(words: list, shape: tuple[int, int]) -> np.ndarray:
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps leave the first word as it is
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        w = words[g]
        np.add(a, f, out=a)
        if isinstance(w, int):
            np.add(a, np.uint32((_K[i] + w) & 0xFFFFFFFF), out=a)
        else:
            np.add(a, w, out=a)
            np.add(a, _ADD[i], out=a)
        np.left_shift(a, _LEFT[i], out=t)
        np.right_shift(a, _RIGHT[i], out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    # after step 60 the new word is in b, which three more steps would move to a
    return (b + np.uint32(_START[0])).byteswap()
