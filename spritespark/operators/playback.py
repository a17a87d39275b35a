"""The order in which a player shows frames: tags inside tags, overlapping tags in cascade, repeats, all directions.

A tag is walked in laps. At each frame of a lap, the first tag (by first frame, then the longest) that holds it and isn't being played yet is
either inside the current tag, and played there and then in its own direction times that of the current one, the lap going on behind
it; or it overlaps, and is played from its beginning after the current one. Ping-pong tags turn at each lap's end without showing the
turning frame again. A repeat of 0 is one lap, or two for ping-pong.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORWARD, REVERSE, PING_PONG, PING_PONG_REVERSE = range(4)


class _Walk:
    def __init__(self, tags: list[tuple[int, int, int, int]]):
        """tags: (from, to, direction, repeat)."""
        self.tags = sorted(tags, key=lambda t: (t[0], -t[1]))
        self.playing: set[int] = set()

    def _next_tag(self, frame: int) -> int | None:
        return next((i for i, t in enumerate(self.tags) if t[0] <= frame <= t[1] and i not in self.playing), None)

    def whole(self, frames: int, start: int, first: bool) -> Iterator[int]:
        """From ``start`` to the last frame; ``first``: tags that hold the start are entered there and not at their beginning."""
        at = start
        while 0 <= at < frames:
            tag = self._next_tag(at)
            if tag is None:
                yield at
                at += 1
            else:
                last = yield from self.tag(tag, 1, at if first else None)
                at = self.tags[last][1] + 1
            first = False

    def tag(self, i: int, forward: int, start: int | None = None) -> Iterator[int]:
        """The frames of a tag; gives the number of the tag that ended last, itself or one in cascade."""
        low, high, way, repeat = self.tags[i]
        self.playing.add(i)
        step = forward * (1 if way in (FORWARD, PING_PONG) else -1)
        turns = way in (PING_PONG, PING_PONG_REVERSE)
        after: list[int] = []
        behind = None  # where a turned lap goes on, if a tag inside ended the one before it
        for lap in range(repeat or (2 if turns else 1)):
            at = low if step > 0 else high
            if lap == 0 and start is not None:
                at = start
            elif lap and turns:
                at = behind if behind is not None else at + step if high > low else at
            behind = None
            while low <= at <= high:
                inner = self._next_tag(at)
                if inner is None:
                    yield at
                    at += step
                    start = None
                elif low <= self.tags[inner][0] and self.tags[inner][1] <= high:
                    yield from self.tag(inner, step, start)
                    start = None
                    at = self.tags[inner][1] + 1 if step > 0 else self.tags[inner][0] - 1
                    if not low <= at <= high:
                        behind = self.tags[inner][0] - 1 if step > 0 else self.tags[inner][1] + 1
                else:
                    self.playing.add(inner)
                    after.append(inner)
            if turns:
                step = -step
        last = i
        for other in after:
            last = yield from self.tag(other, 1)
        self.playing -= {i, *after}
        return last


def shown(frames: int, tags: list[tuple[int, int, int, int]], mode: str = "all", start: int = 0) -> Iterator[int]:
    """mode: all (every tag with its repeats, to the end), loop (the same again and again from frame 0), once (all frames, no tags) or plain (no tags, in a loop)."""
    if mode in ("once", "plain"):
        yield from range(0 if mode == "once" else start, frames)
        while mode == "plain":
            yield from range(frames)
        return
    walk, first = _Walk(tags), True
    while True:
        yield from walk.whole(frames, start, first)
        if mode == "all" or frames < 1:
            return
        start, first = 0, False


def playback(sprites: DataFrame, tags: DataFrame, mode: str = "all", steps: int = 1000, key: str = "sprite_id") -> DataFrame:
    """(key, step, frame): at most ``steps`` frames of each sprite. sprites: key, n (frames); tags: key, from_frame, to_frame, dir, rep.

    A group is one sprite's tags.
    """
    listed = tags.groupBy(key).agg(F.collect_list(F.struct("from_frame", "to_frame", "dir", "rep")).alias("tags"))

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                own = [] if r.tags is None else [(int(t["from_frame"]), int(t["to_frame"]), int(t["dir"]), int(t["rep"])) for t in r.tags]
                order = list(islice(shown(int(r.n), own, mode), steps))
                yield pd.DataFrame({key: getattr(r, key), "step": range(len(order)), "frame": order})

    return sprites.select(key, "n").join(listed, key, "left").mapInPandas(play, f"{key} long, step int, frame int")
