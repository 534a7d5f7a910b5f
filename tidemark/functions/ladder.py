"""One side of an order book, as tasks keep it while they fold updates."""

from __future__ import annotations

from bisect import bisect_left, insort


class Ladder:
    """Sizes by price, and the prices in order from the best one."""

    def __init__(self, side: str):
        self.sign, self.sizes, self.order = -1 if side == "bid" else 1, {}, []

    def put(self, price: float, size: float) -> None:
        """A level's new size; 0 removes it."""
        if size == 0:
            if self.sizes.pop(price, None) is not None:
                del self.order[bisect_left(self.order, self.sign * price)]
        else:
            if price not in self.sizes:
                insort(self.order, self.sign * price)
            self.sizes[price] = size

    def top(self, levels: int) -> list[tuple[float, float]]:
        return [(p := self.sign * x, self.sizes[p]) for x in self.order[:levels]]


def ladders() -> dict[str, Ladder]:
    return {s: Ladder(s) for s in ("bid", "ask")}
