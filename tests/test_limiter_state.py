"""How often the streamed limiter asks for its state, and how much it writes."""

import random

from tidemark.operators import limits
from tidemark.streaming.limiter import Limiter


class Handle:
    """State of one key in memory; counts calls and the requests that are written."""

    def __init__(self):
        self.calls, self.written, self.timers = 0, 0, set()

    def _state(self):
        outer, held = self, {}

        class State:
            def __getattr__(self, name):
                def call(*args):
                    outer.calls += 1
                    key = args[0] if args else None
                    if name in ("update", "updateValue"):
                        held[key if name == "updateValue" else 0] = args[-1]
                        outer.written += sum(len(x) for x in args[-1] if isinstance(x, list))
                    elif name == "put":
                        held[0] = args[0]
                    elif name in ("removeKey", "clear"):
                        held.pop(key if name == "removeKey" else 0, None)
                    elif name == "containsKey":
                        return key in held
                    elif name == "exists":
                        return 0 in held
                    elif name == "keys":
                        return iter(list(held))
                    else:
                        return held.get(key if name == "getValue" else 0)

                return call

        return State()

    def getValueState(self, *_):
        return self._state()

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getExpiryTimeInMs


def run(chunks, watermark):
    handle = Handle()
    limiter = Limiter(3, 3600 * limits.SECOND, 60 * limits.SECOND, "key", "id", "long")
    limiter.init(handle)
    for chunk in chunks:
        list(limiter.handleInputRows(("k",), ({"_at": at, "id": i} for at, i in chunk), None))
    out, done = [], set()
    while early := sorted(t for t in handle.timers - done if t <= watermark):
        done.add(early[0])
        timer = At(early[0])
        timer.getCurrentWatermarkInMs = lambda: watermark
        out += limiter.handleExpiredTimer(("k",), timer, timer)
    return handle, [tuple(r)[1:4] for r in out]


def expected(requests):
    hits, out = [], []
    for at, i in sorted(requests):
        hits = [h for h in hits if h > at - 3600 * limits.SECOND]
        if yes := len(hits) < 3:
            hits.append(at)
        out.append((i, at, yes))
    return out


def test_a_key_with_requests_in_many_slots_is_read_once():
    asked = [(k * 120 * limits.SECOND, k) for k in range(100)]
    handle, out = run([asked], 10**9)
    assert out == expected(asked) and handle.calls < 20


def test_waiting_requests_are_written_in_proportion():
    draw = random.Random(1)
    asked = [(draw.randrange(300) * limits.SECOND + k, k) for k in range(30_000)]
    handle, out = run([asked[k : k + 1000] for k in range(0, len(asked), 1000)], 10**9)
    assert out == expected(asked) and handle.written < 4 * len(asked)
