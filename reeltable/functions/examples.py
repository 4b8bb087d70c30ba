"""User code of the kind that `apply_python` runs."""

from __future__ import annotations


class ShiftAndThin:
    """Drops each n-th frame and moves the others' time."""

    def __init__(self, n: int, shift_ns: int = 0):
        self.n, self.shift_ns = n, shift_ns

    def process(self, frame: dict) -> bool:
        frame["pts"] += self.shift_ns
        return frame["frame_num"] % self.n != 0
