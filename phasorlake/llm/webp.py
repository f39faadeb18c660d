"""Lossless WebP: a decoder of the whole format and an encoder that can use each of its parts.

Pixels are uint32 arrays of shape (height, width), alpha in the top byte, then red, green, blue. A stream
is read least bit first; prefix codes are canonical. Where only the green channel takes bits and there is
no colour cache (most grey images), many images are read side by side, one or two symbols of each at a time; else a plain
loop reads symbol by symbol.

Grey images are written with subtract-green, literals and back references. A predictor by blocks, a palette
with its pixels bundled and a colour cache are tried where their estimates are shorter, and kept where their
files are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: the order of the code-length code, and the 120 short distances as columns
#: and rows back.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
LITERALS, LENGTHS, DISTANCES, MOST_COPY = 256, 24, 40, 4096
#: The farthest back reference of the format, the shortest that grey images take, and the longest code that they have.
MOST_BACK, LEAST_COPY, LONGEST = (1 << 20) - 120, 5, 11
#: Images that are read side by side at most, and those that no longer are, but one after the other. Samples of an image
#: from which repeats are found by all four.
LANES, FEW, LONG = 1024, 128, 1 << 15
#: Blocks of the predictor are 2^PREDICTED a side; colour caches that are tried; a file's bits that an estimate has to save.
PREDICTED, CACHES, WORTH = 5, (2,), 64
#: Samples that are split into tokens together: what they need has to stay near the core.
GROUPED = 1 << 17
#: Above any two literals of a table's entry.
COPIED = 1 << 23
_HASH, _NEAR = 0x1E35A7BD, np.array(NEAR)


# -- prefix codes ---------------------------------------------------------------------------------


def code_lengths(counts: list[int], limit: int = 15) -> list[int]:
    """Lengths of a prefix code for these counts, ``limit`` at most; counts are flattened until it holds."""
    lengths = [0] * len(counts)
    used = [s for s, c in enumerate(counts) if c]
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    used.sort(key=counts.__getitem__)
    weights, n = [counts[s] for s in used], len(used)
    while True:  # leaves and inner nodes ascend, each in a row of its own; of equal ones the leaf goes first
        leaves, inner = [*weights, math.inf], []
        i = j = 0
        of_leaf, of_inner = [0] * n, [0] * n
        for top in range(n - 1):
            a = leaves[i]
            if j == top or a <= inner[j]:
                of_leaf[i] = top
                i += 1
            else:
                a = inner[j]
                of_inner[j] = top
                j += 1
            b = leaves[i]
            if j == top or b <= inner[j]:
                of_leaf[i] = top
                i += 1
            else:
                b = inner[j]
                of_inner[j] = top
                j += 1
            inner.append(a + b)
        depth = [1] * (n - 1)
        for node in range(n - 3, -1, -1):
            depth[node] = depth[of_inner[node]] + 1
        if max(depth) <= limit:
            for s, top in zip(used, of_leaf, strict=True):
                lengths[s] = depth[top]
            return lengths
        weights = [(w >> 1) + 1 for w in weights]


def _reversed(bits: int) -> np.ndarray:
    """Each number of so many bits with its first bit lowest."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


_REVERSED, _REVERSED_LONGEST = _reversed(15), _reversed(LONGEST)
_REVERSED_LIST = _REVERSED.tolist()


def canonical(lengths: list[int] | np.ndarray) -> list[int]:
    """Each symbol's code with its first bit lowest."""
    codes, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        codes[s] = _REVERSED_LIST[code] >> (15 - n)
        code, last = code + 1, n
    return codes


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of lengths, the symbols in the order of their codes, and how much of 2^15 each takes; unused ones 0."""
    order = np.argsort(np.where(lengths > 0, lengths, 16), 1, kind="stable")
    n = np.take_along_axis(lengths, order, 1)
    return order, np.where(n > 0, 1 << (15 - n), 0)


def canonical_all(lengths: np.ndarray) -> np.ndarray:
    """``canonical`` of each row."""
    order, room = _order(lengths)
    codes, n = np.zeros_like(lengths), np.take_along_axis(lengths, order, 1)
    # reversed at 15 bits, a code is in the lowest ones
    np.put_along_axis(codes, order, np.where(n > 0, _REVERSED[np.minimum(np.cumsum(room, 1) - room, (1 << 15) - 1)], 0), 1)
    return codes


def _tables(lengths: np.ndarray) -> np.ndarray:
    """For rows of full codes of LONGEST bits at most, or of one symbol that takes none: symbol * 16 + length by the
    next LONGEST bits."""
    order, room = _order(lengths)
    entries = order * 16 + np.take_along_axis(lengths, order, 1)
    one = np.flatnonzero(np.count_nonzero(lengths, 1) == 1)
    room[one, 0], entries[one, 0] = 1 << 15, order[one, 0] * 16
    if (room.sum(1) != 1 << 15).any():
        raise ValueError("not a full prefix code")
    rows = np.repeat(entries.reshape(-1), (room >> (15 - LONGEST)).reshape(-1)).astype(np.int32).reshape(len(lengths), -1)
    return rows[:, _REVERSED_LONGEST]


class Table:
    """A code as a table over the next ``bits`` bits: symbol * 16 + length. A code of one symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else None
        if self.single is not None:
            self.bits, self.entries = 0, [self.single * 16]
            return
        if not len(used) or int((2 ** (15 - lengths[used])).sum()) != 1 << 15:
            raise ValueError("not a full prefix code")
        self.bits = int(lengths.max())
        self.entries = [0] * (1 << self.bits)
        for s, n, code in zip(used.tolist(), lengths[used].tolist(), [c for c, n in zip(canonical(lengths.tolist()), lengths.tolist(), strict=True) if n], strict=True):
            self.entries[code :: 1 << n] = [s * 16 + n] * (1 << (self.bits - n))


@lru_cache(maxsize=1024)
def _short(symbols: tuple[int, ...]) -> Table:
    """The table of a code in short form."""
    lengths = np.zeros(max(symbols) + 1, np.int64)
    lengths[list(symbols)] = 1
    return Table(lengths)


# -- reading --------------------------------------------------------------------------------------


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0

    def read(self, n: int) -> int:
        b = self.at >> 3
        value = int.from_bytes(self.data[b : b + 5], "little") >> (self.at & 7)
        self.at += n
        if self.at > (len(self.data) - 8) * 8:
            raise ValueError("the stream ends early")
        return value & ((1 << n) - 1)

    def symbol(self, table: Table) -> int:
        b = self.at >> 3
        entry = table.entries[(int.from_bytes(self.data[b : b + 3], "little") >> (self.at & 7)) & ((1 << table.bits) - 1)]
        self.at += entry & 15
        return entry >> 4

    def table(self, symbols: int) -> Table:
        """A code over so many symbols."""
        got = self.lengths(symbols)
        return _short(got) if isinstance(got, tuple) else Table(np.array(got, np.int64))

    def lengths(self, symbols: int) -> tuple[int, ...] | list[int]:
        """The lengths of a code over so many symbols, or the one or two of a code in short form."""
        if self.read(1):
            two = self.read(1)
            first = self.read(8 if self.read(1) else 1)
            chosen = (first, self.read(8)) if two else (first,)
            if max(chosen) >= symbols:
                raise ValueError("a symbol outside the alphabet")
            return chosen
        order = [0] * 19
        shown = 4 + self.read(4)
        for k in range(0, shown, 8):
            few = min(8, shown - k)
            bits = self.read(3 * few)
            for s in LENGTH_ORDER[k : k + few]:
                order[s] = bits & 7
                bits >>= 3
        left = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else symbols
        table = _inner(tuple(order))
        entries, mask, data = table.entries, (1 << table.bits) - 1, self.data
        at, place, last, got, held, window = self.at, 0, 8, [], 0, 0
        while place < symbols and left:
            left -= 1
            if held < 14:  # as many bits as one step takes
                window = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)
                held = 56
            entry = entries[window & mask]
            n, s = entry & 15, entry >> 4
            if s < 16:
                got.append(s)
                place += 1
                last = s or last
            else:
                extra, base = ((2, 3), (3, 3), (7, 11))[s - 16]
                run = base + ((window >> n) & ((1 << extra) - 1))
                n += extra
                got += [last if s == 16 else 0] * run
                place += run
            at += n
            window >>= n
            held -= n
        if place > symbols:
            raise ValueError("too many code lengths")
        self.at = at
        return got + [0] * (symbols - place)


@lru_cache(maxsize=4096)
def _inner(lengths: tuple[int, ...]) -> Table:
    return Table(np.array(lengths, np.int64))


def _extra(symbol: int) -> tuple[int, int]:
    """Extra bits of a length or distance symbol and the value that they add to."""
    if symbol < 4:
        return 0, symbol + 1
    n = (symbol - 2) >> 1
    return n, ((2 + (symbol & 1)) << n) + 1


_EXTRA = [_extra(s) for s in range(DISTANCES)]


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _image(r: Reader, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image; the topmost can have several groups of codes, dealt by blocks."""
    cache_bits = r.read(4) if r.read(1) else 0
    groups, block, shift = 1, None, 0
    if top and r.read(1):
        shift = r.read(3) + 2
        block = (_image(r, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False) >> 8) & 0xFFFF
        groups = int(block.max()) + 1
    cache = 1 << cache_bits if cache_bits else 0
    tables = [[r.table(n) for n in (LITERALS + LENGTHS + cache, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    return _pixels(r, tables, width, height, cache_bits, block, shift)


def _pixels(r: Reader, tables: list[list[Table]], width: int, height: int, cache_bits: int, block: np.ndarray | None, shift: int) -> np.ndarray:
    out, n = [], width * height
    cache = [0] * (1 << cache_bits)
    kept = 0  # pixels that are in the cache already
    while len(out) < n:
        y, x = divmod(len(out), width)
        codes = tables[int(block[y >> shift, x >> shift])] if block is not None else tables[0]
        s = r.symbol(codes[0])
        if s < LITERALS:
            red, blue, alpha = r.symbol(codes[1]), r.symbol(codes[2]), r.symbol(codes[3])
            out.append((alpha << 24) | (red << 16) | (s << 8) | blue)
        elif s < LITERALS + LENGTHS:
            bits, base = _extra(s - LITERALS)
            length = base + r.read(bits)
            bits, base = _extra(r.symbol(codes[4]))
            back = _distance(base + r.read(bits), width)
            if back > len(out) or len(out) + length > n:
                raise ValueError("a copy reaches outside the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            for p in out[kept:]:
                cache[((_HASH * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            kept = len(out)
            out.append(cache[s - LITERALS - LENGTHS])
    return np.array(out, np.uint32).reshape(height, width)


def _greens(files: list[_Open]) -> list[np.ndarray]:
    """The green channels of topmost images, which end their streams, where no other channel takes bits. LANES images are
    read side by side, a step of each at a time, the longest first, and others take the places of those that end; the last
    FEW are read one after the other. Images lie one sample apart: the second of two literals may be outside."""
    if not files:
        return []
    data = [f.reader.data for f in files]
    sizes = np.array([f.width * f.height for f in files])
    raw = b"".join(data)
    words = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,)).copy()
    byte = np.cumsum([0, *map(len, data)])
    firsts, streams = byte[:-1] * 8 + [f.reader.at for f in files], byte[1:] * 8 - 64
    ends, widths = np.cumsum(sizes + 1) - 1, np.array([f.width for f in files])
    out = np.zeros(int(ends[-1]) + 2, np.uint8)
    waiting, mask = np.argsort(-sizes, kind="stable"), (1 << LONGEST) - 1
    bits_of, base_of = np.array(_EXTRA).T
    read, most = lambda at: words[at >> 3].astype(np.int64) >> (at & 7), len(words) * 8 - 1
    many = min(len(files), LANES)
    idle, running = many << LONGEST, 0
    tables, fars = np.zeros((many + 1, 1 << LONGEST), np.int32), np.zeros((many, 1 << LONGEST), np.int16)
    entries, far_entries = tables.reshape(-1), fars.reshape(-1)
    lanes, place = np.zeros(many, np.int64), np.arange(many) << LONGEST
    green, far = np.full(many, idle), place.copy()
    p, o, begin, stop, width, stream = (np.zeros(many, np.int64) for _ in range(6))
    while True:
        free = np.flatnonzero(green == idle)
        if len(waiting) and len(free) * 8 >= many:
            new, waiting = waiting[: len(free)], waiting[len(free) :]
            free = free[: len(new)]
            tables[free] = _paired(_tables(np.array([files[k].lengths[0] for k in new.tolist()])))
            fars[free] = _tables(np.array([files[k].lengths[1] for k in new.tolist()]))
            lanes[free], green[free], p[free], o[free], begin[free] = new, place[free], firsts[new], ends[new] - sizes[new], ends[new] - sizes[new]
            stop[free], width[free], stream[free] = ends[new], widths[new], streams[new]
            running += len(new)
        if not len(waiting):
            left = np.flatnonzero(green < idle)
            lanes, p, o, green, far, begin, stop, width, stream = (v[left] for v in (lanes, p, o, green, far, begin, stop, width, stream))
        if running < FEW and not len(waiting):
            break
        enough = max(FEW - 1, running - len(green) // 8 if not len(waiting) else many - -(-many // 8))
        while running > enough:
            entry = entries[green + (read(p) & mask)]
            p += entry & 15
            out[o] = entry >> 6
            out[o + 1] = entry >> 15
            copy = np.flatnonzero(entry >= COPIED)
            if len(copy):
                size, here, q = (entry[copy] >> 6 & 511) - LITERALS, o[copy], p[copy]
                length = base_of[size] + (read(q) & ((1 << bits_of[size]) - 1))
                q += bits_of[size]
                code = far_entries[far[copy] + (read(np.minimum(q, most)) & mask)]
                q += code & 15
                code >>= 4
                d = base_of[code] + (read(np.minimum(q, most)) & ((1 << bits_of[code]) - 1))
                p[copy] = q + bits_of[code]
                near = np.flatnonzero(d <= len(NEAR))
                d -= len(NEAR)
                if len(near):
                    x, y = _NEAR[d[near] - 1].T  # from the end
                    d[near] = np.maximum(1, x + y * width[copy[near]])
                if (d > here - begin[copy]).any() or (here + length > stop[copy]).any():
                    raise ValueError("a copy reaches outside the image")
                total = np.cumsum(length)
                k = np.arange(int(total[-1]))
                k -= np.repeat(total - length, length)
                to = np.repeat(here, length)
                to += k
                if (length > d).any():
                    k %= np.repeat(d, length)
                k += np.repeat(here - d, length)
                out[to] = out[k]
                o[copy] += length
            o += entry >> 4 & 3
            over = np.flatnonzero(o >= stop)
            if len(over):  # they stay where they are until the places of many are free
                if (p[over] > stream[over] + LONGEST * (o[over] > stop[over])).any():
                    raise ValueError("the stream ends early")
                running -= len(over)
                green[over], stop[over], o[over], stream[over] = idle, len(out), len(out) - 2, len(raw) * 8
            if (p >= stream).any():
                raise ValueError("the stream ends early")
    for i, lane in enumerate(lanes.tolist() if running else []):
        f = files[lane]
        f.reader.at = int(p[i] - byte[lane] * 8)
        _rest(f, *(t[at[i] : at[i] + mask + 1].tolist() for t, at in ((entries, green), (far_entries, far))), out[begin[i] : stop[i]], int(o[i] - begin[i]))
    return [out[b - n : b].reshape(f.height, f.width) for f, n, b in zip(files, sizes.tolist(), ends.tolist(), strict=True)]


def _paired(tables: np.ndarray) -> np.ndarray:
    """Tables of LONGEST bits with a second literal where both codes are within them: the length of both, 16 times how many
    literals, the symbol * 64 and the second * 32768; COPIED more for symbols that are no literals."""
    size, symbol = tables & 15, tables >> 4
    then = np.take_along_axis(tables, np.arange(1 << LONGEST) >> size, 1)
    literal = symbol < LITERALS
    both = size + (then & 15)
    two = literal & (then < LITERALS << 4) & (both <= LONGEST)
    return np.where(two, both + 32 + (then >> 4 << 15), size + np.where(literal, 16, COPIED)).astype(np.int32) + (symbol << 6)


def _rest(f: _Open, entries: list[int], near: list[int], out: np.ndarray, done: int) -> None:
    """What is left of a green channel after its first ``done`` pixels."""
    skipped = f.reader.at >> 3
    data, p, n, mask = f.reader.data[skipped:], f.reader.at & 7, len(out), (1 << LONGEST) - 1
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    words = (raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))).tolist()
    held, end = bytearray(out[:done]), (len(data) - 8) * 8
    add = held.append
    while done < n:
        if p >= end:
            raise ValueError("the stream ends early")
        e = entries[words[p >> 3] >> (p & 7) & mask]
        p += e & 15
        if e < COPIED:
            add(e >> 6 & 511)
            if e & 32:
                add(e >> 15)
                done += 2
            else:
                done += 1
            continue
        s = (e >> 6) & 511
        bits, base = _EXTRA[s - LITERALS]
        length = base + (words[p >> 3] >> (p & 7) & ((1 << bits) - 1))
        p += bits
        if p > end:
            raise ValueError("the stream ends early")
        e = near[words[p >> 3] >> (p & 7) & mask]
        p += e & 15
        bits, base = _EXTRA[e >> 4]
        if p + bits > end:
            raise ValueError("the stream ends early")
        b = p >> 3
        d = _distance(base + ((words[b] | words[b + 3] << 24) >> (p & 7) & ((1 << bits) - 1)), f.width)
        p += bits
        if d > done or done + length > n:
            raise ValueError("a copy reaches outside the image")
        held += held[done - d : done - d + length] if d >= length else (held[done - d :] * (length // d + 1))[:length]
        done += length
    if p > end + LONGEST:
        raise ValueError("the stream ends early")
    out[:] = held[:n]  # the second of the last two may lie outside


# -- transforms -----------------------------------------------------------------------------------


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Channel by channel, modulo 256."""
    low = np.uint32(0x00FF00FF)
    return ((a & low) + (b & low)) & low | (((a >> np.uint32(8)) & low) + ((b >> np.uint32(8)) & low) & low) << np.uint32(8)


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Channel by channel, modulo 256."""
    low, one = np.uint32(0x00FF00FF), np.uint32(0x01000100)
    return ((a & low) + one - (b & low)) & low | (((a >> np.uint32(8)) & low) + one - ((b >> np.uint32(8)) & low) & low) << np.uint32(8)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _join(c) -> int:
    a, r, g, b = c
    return (a << 24) | (r << 16) | (g << 8) | b


def _mean(a: int, b: int) -> int:
    return ((a ^ b) >> 1 & 0x7F7F7F7F) + (a & b)


def predicted(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode == 6:
        return _mean(left, top_left)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(top_left, top)
    if mode == 9:
        return _mean(top, top_right)
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    sides = tuple(zip(_channels(left), _channels(top), _channels(top_left), strict=True))
    if mode == 11:
        to_left = sum(abs(t - c) for _, t, c in sides)
        to_top = sum(abs(a - c) for a, _, c in sides)
        return left if to_left < to_top else top
    clamp = lambda v: min(max(v, 0), 255)
    if mode == 12:
        return _join(clamp(a + t - c) for a, t, c in sides)
    if mode == 13:
        return _join(clamp(m + int((m - c) / 2)) for m, c in zip(_channels(_mean(left, top)), _channels(top_left), strict=True))
    return 0xFF000000


def _guess(out: list[list[int]], modes: np.ndarray, shift: int, y: int, x: int) -> int:
    """The prediction at a place from the pixels before it."""
    if y == 0:
        return out[0][x - 1] if x else 0xFF000000
    if x == 0:
        return out[y - 1][0]
    width = len(out[y - 1])
    corner = out[y - 1][x + 1] if x + 1 < width else out[y][0]
    return predicted(int(modes[y >> shift, x >> shift] >> 8) & 15, out[y][x - 1], out[y - 1][x], out[y - 1][x - 1], corner)


def _unpredict_by_runs(p: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """``_unpredict`` where all modes are left, top and top left: a block's row at a time."""
    height, width = p.shape
    q = np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(height, width, 4).copy()
    q[0, 0, 3:] += np.uint8(255)
    q[0] = np.cumsum(q[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, up = q[y], q[y - 1]
        row[0] += up[0]
        for b, mode in enumerate(modes[y >> shift].tolist()):
            lo, hi = max(b << shift, 1), min((b + 1) << shift, width)
            if mode == 2:
                row[lo:hi] += up[lo:hi]
            elif mode == 4:
                row[lo:hi] += up[lo - 1 : hi - 1]
            else:
                row[lo:hi] = np.cumsum(row[lo - 1 : hi], axis=0, dtype=np.uint8)[1:]
    return q.reshape(height, -1).view("<u4").astype(np.uint32)


def _unpredict(p: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    kinds = (modes >> np.uint32(8)) & np.uint32(15)
    if np.isin(kinds, (1, 2, 4)).all():
        return _unpredict_by_runs(p, kinds, shift)
    out: list[list[int]] = []
    for y, row in enumerate(p.tolist()):
        out.append([])
        for x, v in enumerate(row):
            g = _guess(out, modes, shift, y, x)
            out[y].append(_join((a + b) & 255 for a, b in zip(_channels(v), _channels(g), strict=True)))
    return np.array(out, np.uint32)


def _spread(blocks: np.ndarray, shift: int, shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << shift, 0), 1 << shift, 1)[: shape[0], : shape[1]]


def _cross(p: np.ndarray, blocks: np.ndarray, shift: int, sign: int) -> np.ndarray:
    """Add (1) or take away (-1) what green says of red and blue, and red of blue."""
    byte = lambda v, n: ((v >> np.uint32(n)) & np.uint32(255)).astype(np.uint8)
    e = _spread(blocks, shift, p.shape)
    delta = lambda t, c: (t.view(np.int8).astype(np.int32) * c.view(np.int8)) >> 5
    green, red, blue = byte(p, 8), byte(p, 16).astype(np.int32), byte(p, 0).astype(np.int32)
    new_red = (red + sign * delta(byte(e, 0), green)) & 255
    seen = (new_red if sign > 0 else red).astype(np.uint8)
    new_blue = (blue + sign * (delta(byte(e, 8), green) + delta(byte(e, 16), seen))) & 255
    return (p & np.uint32(0xFF00FF00)) | (new_red.astype(np.uint32) << np.uint32(16)) | new_blue.astype(np.uint32)


def _bundle(size: int) -> int:
    """Bits by which the width shrinks with a palette of this size."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _unbundle(p: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    index = (p >> np.uint32(8)) & np.uint32(255)
    bits = _bundle(len(palette))
    if bits:
        each = 8 >> bits
        index = ((index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)).reshape(len(p), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


@dataclass
class _Open:
    """A file of which all is read but its topmost image's pixels. ``lengths`` of the codes of green and of distances, where
    ``_greens`` can read it, and the other channels' values."""

    reader: Reader
    width: int
    height: int
    undo: list[tuple]
    lengths: tuple[list[int], list[int]] | None = None
    others: tuple[int, ...] = ()
    pixels: np.ndarray | None = None

    def finished(self) -> np.ndarray:
        p = self.pixels.astype(np.uint32)
        for kind, blocks, shift in reversed(self.undo):
            if kind == PREDICTOR:
                p = _unpredict(p, blocks, shift)
            elif kind == CROSS_COLOUR:
                p = _cross(p, blocks, shift, 1)
            elif kind == PALETTE:
                p = _unbundle(p, blocks, shift)
            else:
                green = (p >> np.uint32(8)) & np.uint32(255)
                p = _add(p, (green << np.uint32(16)) | green)
        return p


def _written(chosen: tuple[int, ...] | list[int], symbols: int) -> list[int]:
    """A code in short form by its lengths."""
    return [int(s in chosen) for s in range(symbols)] if isinstance(chosen, tuple) else chosen


def _opened(data: bytes) -> _Open:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25 or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    r = Reader(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = r.read(3) + 2
            side = (1 << shift) - 1
            undo.append((kind, _image(r, (inner + side) >> shift, (height + side) >> shift, False), shift))
        elif kind == PALETTE:
            size = r.read(8) + 1
            table = _image(r, size, 1, False)[0]
            palette = np.stack([np.cumsum((table >> np.uint32(n)) & np.uint32(255)) & 255 for n in (24, 16, 8, 0)]).astype(np.uint32)
            undo.append((kind, (palette[0] << np.uint32(24)) | (palette[1] << np.uint32(16)) | (palette[2] << np.uint32(8)) | palette[3], inner))
            inner = -(-inner // (1 << _bundle(size)))
        else:
            undo.append((kind, None, 0))
    file = _Open(r, inner, height, undo)
    begin = r.at
    if not r.read(2):  # no colour cache, one group of codes
        green, *others, far = (r.lengths(n) for n in (LITERALS + LENGTHS, 256, 256, 256, DISTANCES))
        far = _written(far, DISTANCES)
        if all(isinstance(c, tuple) and len(c) == 1 for c in others) and isinstance(green, list) and sum(map(bool, green)) > 1 and max(max(green), max(far)) <= LONGEST:
            file.lengths, file.others = (green, far), tuple(c[0] for c in others)
            return file
    r.at = begin
    file.pixels = _image(r, inner, height, True)
    return file


def decode_all(files: list[bytes], grey: bool = False) -> list[np.ndarray]:
    """The pixels of lossless WebP files, or as 8-bit samples those of opaque grey images."""
    opened = [_opened(f) for f in files]
    several = [f for f in opened if f.lengths is not None]
    for f, green in zip(several, _greens(several), strict=True):
        red, blue, alpha = f.others
        if grey and (red, blue, alpha) == (0, 0, 255) and [kind for kind, *_ in f.undo] == [SUBTRACT_GREEN]:
            f.pixels, f.undo = green, []  # red and blue are green
            continue
        f.pixels = (green.astype(np.uint32) << np.uint32(8)) | np.uint32((alpha << 24) | (red << 16) | blue)
    return [f.pixels if f.pixels.dtype == np.uint8 else _samples(f.finished()) if grey else f.finished() for f in opened]


def _samples(p: np.ndarray) -> np.ndarray:
    grey = p & np.uint32(255)
    if (p != grey * np.uint32(0x010101) + np.uint32(0xFF000000)).any():
        raise ValueError("not an opaque grey image")
    return grey.astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    return decode_all([data])[0]


# -- writing --------------------------------------------------------------------------------------


def _words(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``n`` 32-bit words of values at ascending bits."""
    word = at >> 5
    shifted = values.astype(np.uint64) << (at & 31).astype(np.uint64)
    total = np.zeros(n + 1, np.uint64)
    if len(values):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        total[word[first]] = np.add.reduceat(shifted, first)
    out = (total & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out[1:] |= (total[:-1] >> np.uint64(32)).astype(np.uint32)
    return out[:n]


class Writer:
    def __init__(self):
        self.values, self.sizes = [], []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        """All values, least bit first: sums over 32-bit words, whose upper halves carry into the next."""
        values, sizes = (np.concatenate([np.atleast_1d(np.asarray(x, np.int64)) for x in xs]) for xs in (_grouped(self.values), _grouped(self.sizes)))
        some = sizes > 0
        values, sizes = values[some], sizes[some]
        end = np.cumsum(sizes)
        return _words(values, end - sizes, (int(end[-1]) >> 5) + 1).tobytes()[: (int(end[-1]) + 7) >> 3]

    def number(self) -> tuple[int, int]:
        """All values as one number, and its bits; for few."""
        total = at = 0
        for value, n in zip(self.values, self.sizes, strict=True):
            total |= value << at
            at += n
        return total, at

    def short(self, first: int, *second: int) -> None:
        self.put(1 | len(second) << 1 | (first > 1) << 2, 3)
        self.put(first, 8 if first > 1 else 1)
        for s in second:
            self.put(s, 8)

    def code(self, lengths: list[int]) -> None:
        """A prefix code: two symbols or fewer in short form where they fit."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) <= 2 and all(s < 256 for s in used):
            self.short(*(used or [0]))
            return
        runs: list[int] = []  # symbol, and 32 times the extra value
        i = 0
        for s in used:
            if s > i:
                runs += _zeros(s - i)
            runs.append(lengths[s])
            i = s + 1
        runs += _zeros(len(lengths) - i)
        counts = [0] * 19
        for s in runs:
            counts[s & 31] += 1
        inner = code_lengths(counts, 7)
        codes = canonical(inner)
        shown = max(k for k, s in enumerate(LENGTH_ORDER) if inner[s]) + 1
        self.put(0, 1)
        self.put(max(shown, 4) - 4, 4)
        for s in LENGTH_ORDER[: max(shown, 4)]:
            self.put(inner[s], 3)
        self.put(0, 1)
        if sum(c > 0 for c in counts) == 1:
            codes = inner = [0] * 19
        bits = [*inner[:17], inner[17] + 3, inner[18] + 7]
        value = held = 0
        for run in runs:
            s = run & 31
            value |= (codes[s] | run >> 5 << inner[s]) << held
            held += bits[s]
            if held > 18:  # another one would reach beyond 32 bits
                self.put(value, held)
                value = held = 0
        self.put(value, held)


@lru_cache(maxsize=512)
def _zeros(k: int) -> tuple[int, ...]:
    """Symbols of the code-length code, with 32 times their extra values, for so many zeros."""
    runs = []
    while k >= 11:
        m = min(k, 138)
        runs.append(18 | m - 11 << 5)
        k -= m
    return (*runs, 17 | k - 3 << 5) if k >= 3 else (*runs, *[0] * k)


def _grouped(xs: list) -> list:
    """Neighbouring numbers as one array each."""
    out, held = [], []
    for x in xs:
        if isinstance(x, np.ndarray):
            if held:
                out.append(np.array(held, np.int64))
                held = []
            out.append(x)
        else:
            held.append(x)
    return [*out, np.array(held, np.int64)] if held else out


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra value and extra bits of a length or distance code of at least 1."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * n + 2 + ((v >> n) & 1), v & ((1 << n) - 1), n


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefix`` of many."""
    v = values - 1
    n = np.maximum(np.frexp(v.astype(float))[1] - 2, 0).astype(np.int64)
    return np.where(v < 2, v, 2 * n + 2 + ((v >> n) & 1)), v & ((1 << n) - 1), n


@lru_cache(maxsize=64)
def _codes_back(width: int) -> np.ndarray:
    """The distance code of each distance that is not too far for a short one."""
    codes = np.arange(9 + 7 * width) + len(NEAR)
    for code, (x, y) in reversed(list(enumerate(NEAR, 1))):
        if x + y * width >= 1:
            codes[x + y * width] = code
    return codes


def _repeats(g: np.ndarray, starts: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each place of images one after the other the distance to the last one of the same image from which four samples
    or more are equal, and how many are (MOST_COPY at most, and no more than lie at the same distance); 0 where there is
    none. Unless ``exact``, only the last place whose four samples have the same digest is looked at."""
    n = len(g)
    back, size, stops = np.zeros(n, np.int64), np.zeros(n, np.int64), np.append(starts[1:], n)
    if n < 5:
        return back, size
    four = np.ndarray((n - 3,), "<u4", g.tobytes(), strides=(1,)).copy()
    order = np.argsort(four if exact else ((four * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16), kind="stable")
    late, early = order[1:], order[:-1]
    same = np.flatnonzero((four[late] == four[early]) & (early >= np.repeat(starts, stops - starts)[late]) & (late - early <= MOST_BACK))
    back[late[same]] = (late - early)[same]
    for k in (1, 2, 3):
        back[np.maximum(stops - k, 0)] = 0  # four samples from here reach the next image
    ends = np.flatnonzero(np.append(back[1:] != back[:-1], True))
    last = np.repeat(ends, np.diff(ends, prepend=-1))
    return back, np.where(back > 0, np.minimum(last - np.arange(n) + 4, MOST_COPY), 0)


def _bits(counts: np.ndarray) -> np.ndarray:
    """About how many bits symbols take that are as frequent; in rows."""
    total = counts.sum(-1, keepdims=True)
    return np.where(counts > 0, counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1)) + 5, 0.0).sum(-1)


@dataclass
class _Grey:
    """A topmost image of samples in the green channel, the other channels constant, and the bits before it."""

    head: Writer
    samples: np.ndarray
    alpha: int = 255
    cache_bits: int = 0


class _Tokens:
    """Images' samples as literals and back references, all images' one after the other."""

    def __init__(self, images: list[_Grey]):
        self.images = images
        sizes = np.array([i.samples.size for i in images])
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        self.flat = g = np.concatenate([i.samples.reshape(-1) for i in images])
        long = sizes >= LONG
        if not long.any():
            back, size = _repeats(g, self.starts, False)
        else:
            back, size = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
            for a, b in zip(self.starts[long].tolist(), self.stops[long].tolist(), strict=True):
                back[a:b], size[a:b] = _repeats(g[a:b], np.array([0]), True)
            if not long.all():
                short = np.repeat(~long, sizes)
                back[short], size[short] = _repeats(g[short], np.cumsum(sizes[~long]) - sizes[~long], False)
        places = np.flatnonzero(size >= LEAST_COPY)
        ends = places + size[places]
        following, taken, k = np.searchsorted(places, ends).tolist(), [], 0  # none reaches the next image
        most, add = len(places), taken.append
        while k < most:
            add(k)
            k = following[k]
        covered = np.zeros(len(g) + 1, np.int8)
        covered[places[taken] + 1] += 1
        covered[ends[taken]] -= 1
        is_copy = np.zeros(len(g), bool)
        is_copy[places[taken]] = True
        self.at = np.flatnonzero(np.cumsum(covered[:-1], dtype=np.int8) == 0)
        self.each = np.diff(np.searchsorted(self.at, self.stops), prepend=0)
        self.of = np.repeat(np.arange(len(images)), self.each)
        self.copy = np.flatnonzero(is_copy[self.at])
        there = self.at[self.copy]
        self.size, self.extra, self.size_bits = _prefixes(size[there])
        self.symbol = g[self.at].astype(np.int64)
        self.symbol[self.copy] = LITERALS + self.size
        d, code = back[there], back[there] + len(NEAR)
        widths = np.array([i.samples.shape[1] for i in images])[self.of[self.copy]]
        for width in np.unique(widths).tolist():
            codes = _codes_back(width)
            near = np.flatnonzero((widths == width) & (d < len(codes)))
            code[near] = codes[d[near]]
        self.far, self.far_extra, self.far_bits = _prefixes(code)

    def cached(self, bits: int) -> np.ndarray:
        """The symbols with colour caches of that size (images with the same alpha)."""
        argb = np.uint32(self.images[0].alpha << 24) | (np.arange(256, dtype=np.uint32) << np.uint32(8))
        keys = ((argb * np.uint32(_HASH)) >> np.uint32(32 - bits)).astype(np.uint16)[self.flat]
        order = np.argsort(keys, kind="stable")
        late, early = order[1:], order[:-1]
        hit = np.zeros(len(keys), bool)
        hit[late] = (self.flat[late] == self.flat[early]) & (early >= np.repeat(self.starts, self.stops - self.starts)[late])  # of other keys other colours
        return np.where((self.symbol < LITERALS) & hit[self.at], LITERALS + LENGTHS + keys[self.at], self.symbol)

    def counted(self, symbol: np.ndarray, n: int) -> np.ndarray:
        """By image how often each symbol occurs."""
        return np.bincount(self.of * n + symbol, minlength=len(self.images) * n).reshape(-1, n)

    def files(self) -> list[bytes]:
        """The images' files; they have caches of one size, or none."""
        cache_bits, count = self.images[0].cache_bits, len(self.images)
        symbol = self.cached(cache_bits) if cache_bits else self.symbol
        n = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
        counts = self.counted(symbol, n)
        single = np.flatnonzero(np.count_nonzero(counts, 1) == 1)
        counts[single, (counts[single, 0] > 0).astype(int)] += 1  # so that every pixel takes a bit
        far_counts = np.bincount(self.of[self.copy] * DISTANCES + self.far, minlength=count * DISTANCES).reshape(-1, DISTANCES)
        sizes, far_sizes = np.zeros((count, n), np.int64), np.zeros((count, DISTANCES), np.int64)
        heads = []
        for k, image in enumerate(self.images):
            w = image.head
            w.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
            w.put(0, 1)
            lengths = code_lengths(counts[k].tolist(), LONGEST)
            w.code(lengths)
            sizes[k] = lengths
            for s in (0, 0, image.alpha):
                w.short(s)
            lengths = code_lengths(far_counts[k].tolist(), LONGEST)
            w.code(lengths)
            if sum(x > 0 for x in lengths) > 1:
                far_sizes[k] = lengths
            heads.append(w.number())
        codes, far_codes = canonical_all(sizes), canonical_all(far_sizes)
        values, bits = np.zeros((len(symbol), 2), np.int64), np.zeros((len(symbol), 2), np.int64)
        chosen = (codes << 4 | sizes).reshape(-1)[self.of * n + symbol]
        values[:, 0], bits[:, 0] = chosen >> 4, chosen & 15
        values[self.copy, 0] |= self.extra << bits[self.copy, 0]
        bits[self.copy, 0] += self.size_bits
        of = self.of[self.copy]
        values[self.copy, 1] = far_codes[of, self.far] | self.far_extra << far_sizes[of, self.far]
        bits[self.copy, 1] = far_sizes[of, self.far] + self.far_bits
        each = bits.sum(1)
        ends = np.cumsum(each)
        before = np.append(0, ends)[np.cumsum([0, *self.each])]
        head_bits = np.array([size for _, size in heads])
        words = (head_bits + np.diff(before)) // 32 + 1
        first = np.cumsum(words) - words
        at = np.repeat(first * 32 + head_bits - before[:-1], self.each) + ends - each
        places = np.stack([at, at + bits[:, 0]], 1).reshape(-1)
        values, bits = values.reshape(-1), bits.reshape(-1)
        some = np.flatnonzero(bits)
        packed = _words(values[some], places[some], int(words.sum())).tobytes()
        out = []
        for (head, size), a, m in zip(heads, (first * 4).tolist(), (head_bits + np.diff(before)).tolist(), strict=True):
            body = bytearray(packed[a : a + (m + 7) // 8])
            start = head.to_bytes((size + 7) // 8, "little")
            last = body[len(start) - 1] | start[-1]
            body[: len(start)] = start[:-1] + bytes([last])
            out.append(_riff(bytes(body)))
        return out


def _put_image(w: Writer, p: np.ndarray, top: bool, cache_bits: int = 0) -> None:
    """Pixels with all channels coded, runs as copies, and a colour cache where asked for."""
    flat, n = p.reshape(-1).tolist(), p.size
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(0, 1)
    cache, tokens, i = [0] * (1 << cache_bits), [], 0
    key = lambda v: ((_HASH * v) & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < n:
        v, k = flat[i], 0
        while i and i + k < n and k < MOST_COPY and flat[i + k] == flat[i - 1]:
            k += 1
        if k >= 3:
            tokens.append((LITERALS + _prefix(k)[0], k))
            i += k
            continue
        if cache_bits and i and cache[key(v)] == v:
            tokens.append((LITERALS + LENGTHS + key(v), 0))
        else:
            tokens.append((v >> 8 & 255, v))
        if cache_bits:
            cache[key(v)] = v
        i += 1
    sizes = [LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256]
    counts = [[0] * s for s in sizes]
    for s, v in tokens:
        counts[0][s] += 1
        if s < LITERALS:
            a, red, _, blue = _channels(v)
            for c, x in zip(counts[1:], (red, blue, a), strict=True):
                c[x] += 1
    lengths = [code_lengths(c) for c in counts]
    for x in lengths:
        w.code(x)
    w.code([0, 1])
    codes = [canonical(x) for x in lengths]

    several = [sum(x > 0 for x in one) > 1 for one in lengths]

    def put(channel: int, s: int) -> None:
        if several[channel]:
            w.put(int(codes[channel][s]), lengths[channel][s])

    for s, v in tokens:
        put(0, s)
        if s < LITERALS:
            a, red, _, blue = _channels(v)
            for channel, x in ((1, red), (2, blue), (3, a)):
                put(channel, x)
        elif s < LITERALS + LENGTHS:
            _, extra, bits = _prefix(v)
            w.put(extra, bits)


def _file(w: Writer) -> bytes:
    return _riff(w.bytes())


def _riff(stream: bytes) -> bytes:
    body = b"\x2f" + stream
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _head(width: int, height: int, alpha: bool) -> Writer:
    if not (1 <= width <= 1 << 14 and 1 <= height <= 1 << 14):
        raise ValueError("a side is 1 to 16384 pixels")
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(alpha), 1)
    w.put(0, 3)
    return w


def _plain(samples: np.ndarray, cache_bits: int = 0) -> _Grey:
    w = _head(samples.shape[1], samples.shape[0], False)
    w.put(1 | SUBTRACT_GREEN << 1, 3)
    w.put(0, 1)
    return _Grey(w, samples, 255, cache_bits)


def _predicted(samples: np.ndarray) -> _Grey:
    """With the left, the top or the top left pixel as prediction, whichever leaves least in a block."""
    height, width = samples.shape
    side, rows, columns = 1 << PREDICTED, range(0, height, 1 << PREDICTED), range(0, width, 1 << PREDICTED)
    left, top, corner = (np.zeros_like(samples) for _ in range(3))
    left[:, 1:], top[1:], corner[1:, 1:] = samples[:, :-1], samples[:-1], samples[:-1, :-1]
    top[0], corner[0], left[1:, 0], corner[:, 0] = left[0], left[0], samples[:-1, 0], top[:, 0]
    rest = np.stack([samples - g for g in (left, top, corner)])
    off = np.abs(rest.view(np.int8).astype(np.int32))
    best = np.add.reduceat(np.add.reduceat(off, rows, 1), columns, 2).argmin(0)
    modes = np.uint32(0xFF000000) | (np.array([1, 2, 4], np.uint32)[best] << np.uint32(8))
    w = _head(width, height, False)
    w.put(1 | PREDICTOR << 1 | (PREDICTED - 2) << 3, 6)
    _put_image(w, modes, False)
    w.put(1 | SUBTRACT_GREEN << 1, 3)
    w.put(0, 1)
    chosen = np.repeat(np.repeat(best, side, 0), side, 1)[:height, :width]
    return _Grey(w, np.take_along_axis(rest, chosen[None], 0)[0], 0)


def _bundled(samples: np.ndarray) -> _Grey:
    """With a palette of 16 colours at most, several pixels in one."""
    grey, index = np.unique(samples, return_inverse=True)
    w = _head(samples.shape[1], samples.shape[0], False)
    _put_palette(w, grey.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000))
    w.put(0, 1)
    return _Grey(w, _packed(index.reshape(samples.shape).astype(np.uint32), len(grey)).astype(np.uint8))


def _tried(images: list[np.ndarray], plain: _Tokens) -> list[tuple[int, _Grey]]:
    """Other forms of images whose estimates are shorter."""
    literal = np.flatnonzero(plain.symbol < LITERALS)  # repeats are found whatever the form
    at, of, g = plain.at[literal], plain.of[literal], plain.flat
    counted = lambda values, of: np.bincount(of * 256 + values, minlength=len(images) * 256).reshape(-1, 256)
    counts = counted(g[at], of)
    distinct, least = np.count_nonzero(counts, 1), _bits(counts) - WORTH
    out = [(k, _bundled(images[k])) for k in np.flatnonzero((distinct > 1) & (distinct <= 16)).tolist()]
    widths = np.array([i.shape[1] for i in images])[of]
    shorter = np.zeros(len(images), bool)
    for far in (np.ones_like(widths), widths):
        back = np.where(at - far >= plain.starts[of], at - far, plain.starts[of])
        shorter |= _bits(counted(g[at] - g[back], of)) < least
    out += [(k, _predicted(images[k])) for k in np.flatnonzero(shorter).tolist()]
    least = _bits(plain.counted(plain.symbol, LITERALS + LENGTHS)) - WORTH
    for bits in CACHES:
        n = LITERALS + LENGTHS + (1 << bits)
        out += [(k, _plain(images[k], bits)) for k in np.flatnonzero(_bits(plain.counted(plain.cached(bits), n)) < least).tolist()]
    return out


def encode_greys(images: list[np.ndarray]) -> list[bytes]:
    """8-bit samples of shapes (height, width) as opaque grey images: red and blue less green are 0 and take no bits. Of each
    the shortest of the plain file and those whose estimates were shorter; it doesn't depend on the other images."""
    ends = np.cumsum([i.size for i in images])
    out = []
    for group in np.split(np.arange(len(images)), np.flatnonzero(np.diff(ends // GROUPED)) + 1) if images else []:
        out += _encoded([images[k] for k in group.tolist()])
    return out


def _encoded(images: list[np.ndarray]) -> list[bytes]:
    plain = _Tokens([_plain(i) for i in images])
    files = plain.files()
    others = _tried(images, plain)
    for bits in (0, *CACHES):
        for alpha in (0, 255):
            some = [(k, i) for k, i in others if i.cache_bits == bits and i.alpha == alpha]
            for (k, _), f in zip(some, _Tokens([i for _, i in some]).files() if some else [], strict=True):
                files[k] = min(files[k], f, key=len)
    return files


def encode_grey(samples: np.ndarray) -> bytes:
    return encode_greys([samples])[0]


def _put_palette(w: Writer, colours: np.ndarray) -> None:
    w.put(1 | PALETTE << 1, 3)
    w.put(len(colours) - 1, 8)
    _put_image(w, _minus(colours, np.concatenate(([0], colours[:-1])).astype(np.uint32))[None], False)


def _packed(index: np.ndarray, size: int) -> np.ndarray:
    """Indexes of a palette of that size, as many in one pixel as it allows."""
    bits = _bundle(size)
    if not bits:
        return index
    index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << bits)))).reshape(len(index), -1, 1 << bits)
    return (index << (np.arange(1 << bits, dtype=np.uint32) * np.uint32(8 >> bits))).sum(2, dtype=np.uint32)


def encode(p: np.ndarray, modes: np.ndarray | None = None, cross: np.ndarray | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, shift: int = 2) -> bytes:
    """Pixels with any of the transforms: ``modes`` and ``cross`` hold an element for each block of
    2^shift pixels a side; with a palette the others aren't used."""
    height, width = p.shape
    w = _head(width, height, bool((p >> np.uint32(24) != 255).any()))
    if palette:
        colours, index = np.unique(p, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        _put_palette(w, colours)
        index = _packed(index.reshape(p.shape).astype(np.uint32), len(colours))
        p = (index << np.uint32(8)) | np.uint32(0xFF000000)
    else:
        if modes is not None:
            w.put(1 | PREDICTOR << 1 | (shift - 2) << 3, 6)
            _put_image(w, modes, False)
            rows = p.tolist()
            guess = np.array([[_guess(rows, modes, shift, y, x) for x in range(width)] for y in range(height)], np.uint32)
            p = _minus(p, guess)
        if cross is not None:
            w.put(1 | CROSS_COLOUR << 1 | (shift - 2) << 3, 6)
            _put_image(w, cross, False)
            p = _cross(p, cross, shift, -1)
        if green:
            w.put(1 | SUBTRACT_GREEN << 1, 3)
            g = (p >> np.uint32(8)) & np.uint32(255)
            p = _minus(p, (g << np.uint32(16)) | g)
    w.put(0, 1)
    _put_image(w, p, True, cache_bits)
    return _file(w)
