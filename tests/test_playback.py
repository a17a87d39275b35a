"""The order of frames in small cases; tags are (from, to, direction, repeat)."""

from itertools import islice

import pytest

from spritespark.operators.playback import FORWARD, PING_PONG, PING_PONG_REVERSE, REVERSE, playback, shown

CASES = {
    "no tags, once": (5, [], "once", 2, "01234"), "no tags, all": (4, [], "all", 0, "0123"), "no tags, loop": (4, [], "loop", 2, "23012301230"),
    "plain": (5, [(1, 3, REVERSE, 0)], "plain", 2, "23401234012340"),
    "repeats": (4, [(1, 2, FORWARD, 2)], "loop", 0, "0121230121230"), "repeats from inside": (4, [(1, 2, FORWARD, 2)], "loop", 2, "21230121230"),
    "ping-pong over all": (4, [(0, 3, PING_PONG, 2)], "loop", 0, "012321001232100123210"), "ping-pong reverse over all": (4, [(0, 3, PING_PONG_REVERSE, 2)], "loop", 0, "012332101233210123"),
    "ping-pong reverse from 1": (4, [(0, 3, PING_PONG_REVERSE, 2)], "loop", 1, "1012332101233210123"), "one lap back": (4, [(0, 3, PING_PONG_REVERSE, 1)], "loop", 0, "0321032103210"),
    "reverse twice": (4, [(0, 3, REVERSE, 2)], "loop", 0, "032103210321032103210"), "one frame": (2, [(0, 0, FORWARD, 2)], "loop", 1, "1001001001"), "ping-pong of one frame": (1, [(0, 0, PING_PONG, 3)], "all", 0, "000"),
    "two of one range": (2, [(0, 1, FORWARD, 2), (0, 1, FORWARD, 2)], "loop", 0, "0101010101"), "three laps": (3, [(0, 2, PING_PONG, 3)], "loop", 0, "01210120121012"), "infinite is once": (4, [(1, 2, FORWARD, 0)], "loop", 0, "012301230"),
    "four in a row": (14, [(1, 2, FORWARD, 1), (3, 5, REVERSE, 2), (6, 8, PING_PONG, 3), (10, 12, PING_PONG_REVERSE, 2)], "all", 0, "0125435436787678" + "9cbabcd"),
    "ping-pong inside": (7, [(1, 5, FORWARD, 2), (2, 4, PING_PONG, 3)], "loop", 0, "0123432345123432345601234323451234323456"),
    "the same end": (5, [(1, 4, FORWARD, 2), (2, 4, FORWARD, 2)], "loop", 0, "0123423412342340123423412342340"), "ping-pong of the same range": (4, [(1, 3, FORWARD, 2), (1, 3, PING_PONG, 4)], "loop", 0, "012321232112321232101232123211232123210"),
    "reverse inside": (5, [(1, 4, FORWARD, 2), (1, 3, REVERSE, 2)], "loop", 0, "0321321432132140321321432132140"), "reverse inside ping-pong": (5, [(0, 4, PING_PONG, 2), (1, 3, REVERSE, 3)], "all", 0, "032132132141231231230"),
    "ping-pong at the far end": (5, [(0, 4, PING_PONG, 2), (2, 4, PING_PONG, 2)], "all", 0, "012343210"), "ping-pong in the middle": (5, [(0, 4, PING_PONG, 2), (1, 3, PING_PONG, 2)], "all", 0, "0123214321230"),
    "ping-pong reverse at the start": (5, [(0, 4, PING_PONG, 2), (0, 2, PING_PONG_REVERSE, 2)], "all", 0, "012343" + "01210"[:0] + "01210"),
    "overlap": (5, [(0, 2, FORWARD, 2), (1, 3, FORWARD, 1)], "all", 0, "0120121234"), "overlap back": (6, [(1, 3, FORWARD, 1), (2, 4, REVERSE, 2)], "all", 0, "01234324325"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_order(name):
    frames, tags, mode, start, want = CASES[name]
    got = list(islice(shown(frames, tags, mode, start), len(want) if mode in ("loop", "plain") else 200))
    assert got == [int(c, 16) for c in want]


def test_sprites_at_once(spark):
    sprites = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES.values()) if c[2] == "all" and not c[3]], "sprite_id long, n int")
    tags = spark.createDataFrame([(i, *t) for i, c in enumerate(CASES.values()) for t in c[1]], "sprite_id long, from_frame int, to_frame int, dir int, rep int")
    got = {}
    for r in playback(sprites, tags).orderBy("sprite_id", "step").collect():
        got.setdefault(r.sprite_id, []).append(r.frame)
    assert got == {i: [int(x, 16) for x in c[4]] for i, c in enumerate(CASES.values()) if c[2] == "all" and not c[3]}
