"""Adaptive arithmetic coding over contexts of byte-like symbols.

Integer coding with 32-bit bounds and delayed carry bits. Each context counts its own symbols in a
prefix-sum tree, so a symbol costs O(log n); encoder and decoder update counts alike.
"""

from __future__ import annotations

from collections.abc import Sequence

TOP = (1 << 32) - 1
HALF, QUARTER = 1 << 31, 1 << 30
MOST = 1 << 24
# Bits that an encoder holds one by one before it packs them.
LOOSE = 1 << 13


class Context:
    """Counts of ``n`` symbols, each at least 1, as a binary indexed tree.

    ``likely`` are (first symbol, last symbol, count) to start with; later ones take precedence.
    """

    def __init__(self, n: int, likely: Sequence[tuple[int, int, int]] = ()):
        counts = [1] * n
        for first, last, count in likely:
            counts[first : last + 1] = [count] * (last + 1 - first)
        self.n, self.total = n, sum(counts)
        self.size = 1 << (n - 1).bit_length()
        self.tree = [0] * (self.size + 1)
        for symbol, count in enumerate(counts):
            self._add(symbol, count)

    def _add(self, symbol: int, amount: int) -> None:
        at = symbol + 1
        while at <= self.size:
            self.tree[at] += amount
            at += at & -at

    def below(self, symbol: int) -> int:
        total = 0
        while symbol:
            total += self.tree[symbol]
            symbol &= symbol - 1
        return total

    def at(self, count: int) -> int:
        """The symbol whose range holds a count."""
        place, step = 0, self.size
        while step:
            if place + step <= self.size and self.tree[place + step] <= count:
                place += step
                count -= self.tree[place]
            step >>= 1
        return place

    def seen(self, symbol: int) -> None:
        self._add(symbol, 1)
        self.total += 1
        if self.total >= MOST:
            counts = [max(1, (self.below(s + 1) - self.below(s)) // 2) for s in range(self.n)]
            self.tree, self.total = [0] * (self.size + 1), sum(counts)
            for s, c in enumerate(counts):
                self._add(s, c)


class Encoder:
    def __init__(self) -> None:
        self.low, self.high, self.waiting = 0, TOP, 0
        self.bits: list[int] = []
        self.packed = bytearray()

    def _bit(self, bit: int) -> None:
        self.bits.append(bit)
        self.bits += [1 - bit] * self.waiting
        self.waiting = 0
        if len(self.bits) >= LOOSE:
            self._pack()

    def _pack(self) -> None:
        """Turns whole bytes of the loose bits into bytes."""
        if n := len(self.bits) // 8:
            self.packed += int("".join(map(str, self.bits[: 8 * n])), 2).to_bytes(n, "big")
            del self.bits[: 8 * n]

    def put(self, context: Context, symbol: int) -> None:
        span, below = self.high - self.low + 1, context.below(symbol)
        self.high = self.low + span * context.below(symbol + 1) // context.total - 1
        self.low += span * below // context.total
        context.seen(symbol)
        while True:
            if self.high < HALF:
                self._bit(0)
            elif self.low >= HALF:
                self._bit(1)
                self.low -= HALF
                self.high -= HALF
            elif self.low >= QUARTER and self.high < HALF + QUARTER:
                self.waiting += 1
                self.low -= QUARTER
                self.high -= QUARTER
            else:
                return
            self.low, self.high = self.low * 2, self.high * 2 + 1

    def done(self) -> bytes:
        self.waiting += 1
        self._bit(int(self.low >= QUARTER))
        self.bits += [0] * (-len(self.bits) % 8)
        self._pack()
        return bytes(self.packed)


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.place = data, 0
        self.low, self.high, self.value = 0, TOP, 0
        for _ in range(32):
            self.value = self.value * 2 + self._bit()

    def _bit(self) -> int:
        byte, self.place = self.place >> 3, self.place + 1
        return self.data[byte] >> (7 - (self.place - 1 & 7)) & 1 if byte < len(self.data) else 0

    def take(self, context: Context) -> int:
        span = self.high - self.low + 1
        symbol = context.at(((self.value - self.low + 1) * context.total - 1) // span)
        below = context.below(symbol)
        self.high = self.low + span * context.below(symbol + 1) // context.total - 1
        self.low += span * below // context.total
        context.seen(symbol)
        while True:
            if self.high < HALF:
                cut = 0
            elif self.low >= HALF:
                cut = HALF
            elif self.low >= QUARTER and self.high < HALF + QUARTER:
                cut = QUARTER
            else:
                return symbol
            self.low, self.high = (self.low - cut) * 2, (self.high - cut) * 2 + 1
            self.value = (self.value - cut) * 2 + self._bit()


class FixedLength:
    """Messages of exactly ``length`` symbols, which need no end."""

    def __init__(self, symbols: int, length: int):
        self.context, self.length = Context(symbols), length

    def encode(self, message: list[int]) -> bytes:
        if len(message) != self.length:
            raise ValueError(f"{len(message)} symbols where {self.length} are due")
        out = Encoder()
        for symbol in message:
            out.put(self.context, symbol)
        return out.done()

    def decode(self, data: bytes) -> list[int]:
        source = Decoder(data)
        return [source.take(self.context) for _ in range(self.length)]


class MaxLength:
    """Messages of up to ``length`` symbols: a further symbol ends them, unless they are of full length."""

    def __init__(self, symbols: int, length: int):
        self.context, self.end, self.length = Context(symbols + 1), symbols, length

    def encode(self, message: list[int]) -> bytes:
        if len(message) > self.length:
            raise ValueError(f"{len(message)} symbols where at most {self.length} may be")
        out = Encoder()
        for symbol in message:
            out.put(self.context, symbol)
        if len(message) < self.length:
            out.put(self.context, self.end)
        return out.done()

    def decode(self, data: bytes) -> list[int]:
        source, message = Decoder(data), []
        while len(message) < self.length and (symbol := source.take(self.context)) != self.end:
            message.append(symbol)
        return message


class OneShot(FixedLength):
    """Messages of a single symbol."""

    def __init__(self, symbols: int):
        super().__init__(symbols, 1)
