"""Adaptive context-mixing range coder for token ids, many blocks side by side in numpy.

A block is coded on its own: all tables and the coder start anew, so blocks can be read in
any order and a damaged one costs nothing but itself. Within a block every id is coded under
three predictions:

* order 2 and order 1: the id that last followed the two ids (the one id) before, each with
  a confidence that grows with hits and shrinks with misses;
* order 0: how often the ids' four hexadecimal digits came up so far, as adaptive distributions
  over 16 digits under the digits before, and for each upper byte the lower byte that it last
  stood with, with a confidence.

First a three-way choice - the order-2 id, the order-1 id, or another one - is coded with
probabilities mixed from two adaptive models (one sees both confidences and whether the
predictions agree, one sees the id before); then, for another id, its four digits, the first one
mixed with a model that sees the id before. The third digit is coded by its difference from
that of the predicted lower byte, and so is the fourth if the third agreed; both
distributions depend on the confidence, and where nothing is predicted on the digit before.

All blocks of a group take a step together: one numpy operation serves one step of thousands
of blocks, both when writing and when reading. Blocks whose id was predicted go through the
digits' operations, too, as if by a digit of probability one: that takes less time than picking
the others. Tables and words lie block beside block, so that blocks at like places share cache lines.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK_IDS = 1024
#: blocks that step together
LANES = 8192
ID_LIMIT = 1 << 16

BITS = 14
TOTAL = 1 << BITS
SLOTS = 1 << 9
CONTEXTS = 8
#: distributions over 16 digits: first digit by the id before, second digit by the first, third and fourth
#: by the digit before or by the confidence in what is predicted
SECOND, THIRD, FOURTH, ROWS = CONTEXTS, 16 + CONTEXTS, 36 + CONTEXTS, 56 + CONTEXTS
LOW_MASK = np.uint64((1 << 32) - 1)
UNIT, WORD, WORD_LOG, FULL = np.uint64(BITS), np.uint64(16), np.uint64(4), np.uint64(1 << 48)
RENORM = np.uint64(1 << 32)
#: one step of a confidence, which is kept above the predicted id or byte, and the highest
STEP, SURE, BYTE_STEP, BYTE_SURE = np.uint32(1 << 16), np.uint32(3 << 16), np.uint16(1 << 8), np.uint16(3 << 8)
#: least share of anything: no symbol takes more than 8 bits, so three fit between two shifts
LEAST = TOTAL >> 8
FLAG_RATE, DIGIT_RATE = 4, 4
#: most words that one id can take, and steps between two looks at the room for them
ID_WORDS, LOOK = 4, 16


def _rows(row: np.ndarray, n: int) -> np.ndarray:
    """``n`` equal rows, each one item: moved as a whole when taken or put back."""
    return np.tile(row, (n, 1)).view(f"V{row.nbytes}").ravel()


def _numbers(items: np.ndarray) -> np.ndarray:
    return items.view(np.int16).reshape(len(items), -1)


def _digit_targets() -> np.ndarray:
    """Where the 16 lower bounds of a digit distribution move to when a digit comes up."""
    j = np.arange(16)
    rows = np.array([np.where(j <= s, j * LEAST, TOTAL - (16 - j) * LEAST) for s in range(16)], np.int16)
    return rows.view("V32").ravel()


EVEN = (np.arange(16) * (TOTAL // 16)).astype(np.int16)
TARGETS = _digit_targets()
#: the two inner bounds of the choice are one number of 32 bits
FLAG_TARGETS = np.array([[TOTAL - 2 * LEAST, TOTAL - LEAST], [LEAST, TOTAL - LEAST], [LEAST, 2 * LEAST]], np.int16).view(np.uint32).ravel()
FLAG_START = np.array([TOTAL // 8, TOTAL // 4], np.int16).view(np.uint32)[0]


def _moved(rows: np.ndarray, targets: np.ndarray, came: np.ndarray, rate: int) -> np.ndarray:
    """Items of bounds moved a part of the way to where they would be for what came."""
    out = targets.take(came)
    numbers = _numbers(out)
    numbers -= rows
    numbers >>= rate
    numbers += rows
    return out


class _Model:
    """The tables of all blocks of a group, and the step that both directions share."""

    def __init__(self, lanes: int):
        self.lanes, self.lane = lanes, np.arange(lanes)
        #: what last followed one id and two ids: the id, and the confidence above it
        self.last = [np.zeros(SLOTS * lanes, np.uint32) for _ in range(2)]
        self.flags, self.flags_by_id = np.full(32 * lanes, FLAG_START), np.full(CONTEXTS * lanes, FLAG_START)
        self.first, self.digits = np.tile(EVEN, (lanes, 1)), _rows(EVEN, ROWS * lanes)
        #: the lower byte last seen under an upper one, and the confidence above it (0: none was seen)
        self.low = np.zeros(256 * lanes, np.uint16)
        self.edges = np.tile(np.array([0, 0, 0, TOTAL], np.int16), (lanes, 1))
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def _digit(self, coder, row: np.ndarray, digit: np.ndarray, coded: np.ndarray) -> np.ndarray:
        at = row * self.lanes + self.lane[:len(row)]
        rows = _numbers(self.digits.take(at))
        digit = coder.digit(rows, digit, coded)
        self.digits.put(at, _moved(rows, TARGETS, digit, DIGIT_RATE))
        return digit

    def step(self, coder, n: int, x: np.ndarray | None) -> np.ndarray:
        """The next id of the first ``n`` blocks: ``x``, or what ``coder`` reads."""
        one, two, lane, lanes = self.one[:n], self.two[:n], self.lane[:n], self.lanes
        at = [((one * 40503 >> 5) & (SLOTS - 1)) * lanes + lane, ((one * 31153 + two * 54773 >> 6) & (SLOTS - 1)) * lanes + lane]
        last = [table.take(a) for table, a in zip(self.last, at)]
        id1, id2 = (entry & np.uint32(0xFFFF) for entry in last)
        sure1, sure2 = (entry >> np.uint32(16) for entry in last)
        context = one & (CONTEXTS - 1)

        by_sure_at = (sure2 * np.uint32(8) + sure1 * np.uint32(2) + (id1 == id2)) * lanes + lane
        by_id_at = context * lanes + lane
        by_sure, by_id = _numbers(self.flags.take(by_sure_at)), _numbers(self.flags_by_id.take(by_id_at))
        edges = self.edges[:n]
        edges[:, 1:3] = (by_sure + by_id) >> 1
        if x is None:
            choice = coder.choice(edges, None)
            known = np.where(choice == 0, id2, id1).astype(np.int64)
        else:
            choice = coder.choice(edges, np.where(x == id2, 0, 2 - (x == id1)))
            known = x
        self.flags[by_sure_at] = _moved(by_sure, FLAG_TARGETS, choice, FLAG_RATE)
        self.flags_by_id[by_id_at] = _moved(by_id, FLAG_TARGETS, choice, FLAG_RATE)

        # the digits of a predicted id are learned as well, but not coded
        coded = -(choice == 2).astype(np.int16)
        first, first_by_id = self.first[:n], _numbers(self.digits.take(by_id_at))
        d1 = coder.digit((first + first_by_id) >> 1, known >> 12, coded)
        first[:] = _numbers(_moved(first, TARGETS, d1, DIGIT_RATE))
        self.digits.put(by_id_at, _moved(first_by_id, TARGETS, d1, DIGIT_RATE))
        d2 = self._digit(coder, SECOND + d1, known >> 8 & 15, coded)
        coder.shift()

        low_at = (d1 * 16 + d2) * lanes + lane
        low = self.low.take(low_at)
        sure, guess = (low >> np.uint16(8)).astype(np.int64), (low & np.uint16(255)).astype(np.int64)
        off = self._digit(coder, THIRD + np.where(sure > 0, sure + 15, d2), (known ^ guess) >> 4 & 15, coded)
        agrees = (off == 0) & (sure > 0)
        d3 = off ^ guess >> 4
        guess = np.where(agrees, guess & 15, 0)
        d4 = self._digit(coder, FOURTH + np.where(agrees, sure + 15, d3), (known & 15) ^ guess, coded) ^ guess
        coder.shift()

        x = d1 << 12 | d2 << 8 | d3 << 4 | d4
        short = x.astype(np.uint32)
        byte = short.astype(np.uint16) & np.uint16(255)
        hit = agrees & (d4 == guess)
        self.low[low_at] = np.where(hit, np.minimum(low + BYTE_STEP, byte | BYTE_SURE), np.where(low >= 2 * BYTE_STEP, low - BYTE_STEP, byte | BYTE_STEP))
        for table, a, entry, guess in zip(self.last, at, last, (id1, id2)):
            table[a] = np.where(guess == short, np.minimum(entry + STEP, short | SURE), np.where(entry >= STEP, entry - STEP, short))
        self.two[:n] = one
        self.one[:n] = x
        return x


class _Coder:
    """What writing and reading share: the widths, and the shares of digits."""

    def __init__(self, lanes: int):
        self.lanes, self.width = lanes, np.full(lanes, FULL)
        self.narrow(lanes)

    def narrow(self, n: int) -> None:
        """Only the first ``n`` blocks take part from now on."""
        self.n, self.row, self.quad = n, np.arange(0, 16 * n, 16), np.arange(0, 4 * n, 4)

    def _choice_share(self, edges: np.ndarray, choice: np.ndarray) -> tuple:
        flat, at = edges.ravel(), self.quad + choice
        start = flat.take(at)
        return start, flat.take(at + 1) - start

    def _digit_share(self, rows: np.ndarray, digit: np.ndarray, coded: np.ndarray) -> tuple:
        """Where the digits' shares start, and their sizes: all where nothing is ``coded``."""
        flat = rows.ravel()
        start = flat.take(self.row + digit)
        size = flat.take(self.row + (digit + 1 & 15)) - start & np.int16(TOTAL - 1)  # the last one's end is as good as 0
        return start & coded, (size - np.int16(TOTAL) & coded) + np.int16(TOTAL)


class _Writer(_Coder):
    def __init__(self, lanes: int, expected: int):
        super().__init__(lanes)
        self.low = np.zeros(lanes, np.uint64)
        self.out = np.zeros((expected + ID_WORDS * LOOK, lanes), np.uint32)
        #: places of the next words in ``out``
        self.at = np.arange(lanes)

    def room(self, words: int) -> None:
        size = len(self.out)
        if int(self.at.max(initial=0)) // max(self.lanes, 1) + words > size:
            self.out = np.concatenate([self.out, np.zeros((max(words, size // 2), self.lanes), np.uint32)])

    def _put(self, start: np.ndarray, size: np.ndarray) -> None:
        low, width = self.low[:self.n], self.width[:self.n]
        width >>= UNIT
        low += start.astype(np.uint64) * width
        width *= size.astype(np.uint64)

    def choice(self, edges: np.ndarray, choice: np.ndarray) -> np.ndarray:
        self._put(*self._choice_share(edges, choice))
        return choice

    def digit(self, rows: np.ndarray, digit: np.ndarray, coded: np.ndarray) -> np.ndarray:
        self._put(*self._digit_share(rows, digit, coded))
        return digit

    def shift(self) -> None:
        """Finished words go out."""
        low, width, at = self.low[:self.n], self.width[:self.n], self.at[:self.n]
        out = self.out.ravel()
        while (short := width < RENORM).any():
            # a word that is not finished is written again later
            out[at] = (low >> np.uint64(32)).astype(np.uint32)
            at += short.astype(np.int64) * self.lanes
            low[:] = np.where(short, (low & LOW_MASK) << WORD, low)
            width <<= short.astype(np.uint64) << WORD_LOG

    def finish(self) -> list:
        lane = np.arange(self.lanes)
        self.room(4)
        n = self.at // max(self.lanes, 1)
        for _ in range(3):
            self.out[n, lane] = self.low >> np.uint64(32)
            n += 1
            self.low = (self.low & LOW_MASK) << WORD
        for k in range(int(n.max(initial=1)) - 1, 0, -1):  # carries go to the words before
            self.out[k - 1] += self.out[k] >> 16
        words = np.ascontiguousarray(self.out.T.astype("<u2"))
        return [words[i, :k].tobytes() for i, k in enumerate(n.tolist())]


class _Reader(_Coder):
    def __init__(self, coded: list):
        super().__init__(len(coded))
        words = np.zeros((self.lanes, max((len(c) // 2 for c in coded), default=0) + 8), np.uint16)
        for lane, c in enumerate(coded):
            w = np.frombuffer(c, "<u2")
            words[lane, :len(w)] = w
        first = words[:, :3].astype(np.uint64)
        self.code = first[:, 0] << np.uint64(32) | first[:, 1] << WORD | first[:, 2]
        self.words, self.at = np.ascontiguousarray(words.T).ravel(), np.arange(self.lanes) + 3 * self.lanes

    def _place(self) -> np.ndarray:
        """Where the codes stand among the shares; widths become those of a share of one."""
        width = self.width[:self.n]
        width >>= UNIT
        return (self.code[:self.n].astype(np.float64) / width.astype(np.float64)).astype(np.int16)

    def _take(self, start: np.ndarray, size: np.ndarray) -> None:
        code, width = self.code[:self.n], self.width[:self.n]
        code -= start.astype(np.uint64) * width
        width *= size.astype(np.uint64)

    def choice(self, edges: np.ndarray, _) -> np.ndarray:
        place = self._place()
        choice = (place >= edges[:, 1]).astype(np.int64) + (place >= edges[:, 2])
        self._take(*self._choice_share(edges, choice))
        return choice

    def digit(self, rows: np.ndarray, digit: np.ndarray, coded: np.ndarray) -> np.ndarray:
        """The next digit where it is ``coded``, elsewhere ``digit``."""
        below = np.bitwise_count((rows <= self._place()[:, None]).ravel().view(np.uint64)).view(np.uint16)
        digit = np.where(coded, (below >> np.uint16(8)) + (below & np.uint16(255)) - np.uint16(1), digit)
        self._take(*self._digit_share(rows, digit, coded))
        return digit

    def shift(self) -> None:
        code, width, at = self.code[:self.n], self.width[:self.n], self.at[:self.n]
        while (short := width < RENORM).any():
            code[:] = np.where(short, code << WORD | self.words.take(at, mode="clip"), code)
            at += short.astype(np.int64) * self.lanes
            width <<= short.astype(np.uint64) << WORD_LOG


def _by_length(sizes: list) -> tuple:
    """Blocks, longest first, and how many of them still take part in each step."""
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    sizes = np.asarray(sizes, np.int64)[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
    return order, sizes, active


def encode_blocks(blocks: list) -> list:
    """The coded bytes of some blocks of ids (arrays of numbers below ``ID_LIMIT``)."""
    out: list = [b""] * len(blocks)
    for lo in range(0, len(blocks), LANES):
        group = blocks[lo:lo + LANES]
        order, sizes, active = _by_length([len(b) for b in group])
        if any(int(b.max()) >= ID_LIMIT for b in group if len(b)):
            raise ValueError(f"ids must be below {ID_LIMIT}")
        ids = np.zeros((len(group), int(sizes[0])), np.uint16)
        for lane, i in enumerate(order):
            ids[lane, :sizes[lane]] = group[i]
        ids = np.ascontiguousarray(ids.T)
        model, writer = _Model(len(group)), _Writer(len(group), len(ids))
        for t, n in enumerate(active.tolist()):
            if n != writer.n:
                writer.narrow(n)
            if t % LOOK == 0:
                writer.room(ID_WORDS * LOOK)
            model.step(writer, n, ids[t, :n].astype(np.int64))
        for lane, data in enumerate(writer.finish()):
            out[lo + order[lane]] = data
    return out


def decode_blocks(coded: list, sizes: list) -> list:
    """The ids of some coded blocks, given how many ids each holds."""
    out: list = [None] * len(coded)
    for lo in range(0, len(coded), LANES):
        group = coded[lo:lo + LANES]
        order, counts, active = _by_length(sizes[lo:lo + LANES])
        model, reader = _Model(len(group)), _Reader([group[i] for i in order])
        ids = np.zeros((len(active), len(group)), np.uint16)
        for t, n in enumerate(active.tolist()):
            if n != reader.n:
                reader.narrow(n)
            ids[t, :n] = model.step(reader, n, None)
        ids = np.ascontiguousarray(ids.T)
        for lane, i in enumerate(order):
            out[lo + i] = ids[lane, :counts[lane]].astype(np.int64)
    return out


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
