"""The state behind answer streams: what it gives back, what stays in it, and how many calls it takes."""

import itertools
import json
import random
from collections import defaultdict

import pytest

from inkstone.streaming import answers


class State:
    """A value, list and map state of every key in one, which counts its calls."""

    def __init__(self):
        self.key, self.calls, self.items, self.entries = None, 0, defaultdict(list), defaultdict(dict)

    def _held(self):
        self.calls += 1
        return self.items[self.key]

    def exists(self):
        return bool(self._held())

    def get(self):
        return list(self._held())

    def appendValue(self, value):
        self._held().append(value)

    def put(self, values):
        self._held()[:] = values

    def clear(self):
        self._held().clear()

    def _map(self):
        self.calls += 1
        return self.entries[self.key]

    def getValue(self, key):
        return self._map()[key]

    def updateValue(self, key, value):
        self._map()[key] = value

    def removeKey(self, key):
        del self._map()[key]

    def iterator(self):
        return iter(list(self._map().items()))


class Value(State):
    def get(self):
        return (self._held() or [None])[0]

    def update(self, value):
        self._held()[:] = [value]


class Handle:
    def __init__(self):
        self.states = []

    def _new(self, state):
        self.states.append(state)
        return state

    def getValueState(self, *_):
        return self._new(Value())

    def getListState(self, *_):
        return self._new(State())

    def getMapState(self, *_):
        return self._new(State())


def run(batches, tokens):
    """Events of rows (stream, seq, data), and the handle; every batch has a reader of its own, as after a restart."""
    handle, events = Handle(), []
    kept = None
    for batch in batches:
        reader = answers.AnswerReader(tokens)
        reader.init(handle)
        if kept is not None:
            for old, new in zip(kept, handle.states[len(kept) :], strict=True):
                new.calls, new.items, new.entries = old.calls, old.items, old.entries
            del handle.states[: len(kept)]
        kept = list(handle.states)
        for key, rows in itertools.groupby(sorted(batch, key=lambda r: r[0] >> answers.BUCKET_BITS), key=lambda r: r[0] >> answers.BUCKET_BITS):
            for state in handle.states:
                state.key = key
            events += reader.handleInputRows((key,), ((key, *r) for r in rows), None)
    return events, handle


@pytest.mark.parametrize("n_batches", [1, 4, 40])
def test_streams_share_calls_and_keep_nothing_when_done(n_batches):
    rng = random.Random(n_batches)
    texts = {s: "".join(rng.choice("aé𝔘 ") for _ in range(rng.choice([0, 10, 400, 30_000, 90_000]))) for s in range(-20, 44)}
    rows = []
    for s, text in texts.items():
        lines = ["data: " + json.dumps({"choices": [{"delta": {"content": text[k : k + 150]}}]}) for k in range(0, len(text), 150)]
        body = ("\n".join([*lines, "data: [DONE]" if s % 7 else ": no end"]) + "\n").encode()
        pieces = [body[k : k + 500] for k in range(0, len(body), 500)]
        rows += [(s, k, p) for k, p in enumerate([*pieces, None])]
    rows += rng.sample(rows, 300)  # some come again
    rng.shuffle(rows)
    batches = [rows[k::n_batches] for k in range(n_batches)]
    events, handle = run(batches, tokens=True)
    for s, text in texts.items():
        mine = [e for e in events if e.stream_id == s]
        told = [e for e in mine if e.kind == answers.TOKEN]
        assert "".join(e.text for e in told) == text and [e.n for e in told] == list(range(len(told))) and len(mine) == len(told) + 1
        assert (mine[-1].kind, mine[-1].n, mine[-1].text) == ((answers.FINISHED, len(told), text) if s % 7 else (answers.FAILED, len(told), answers.INCOMPLETE))
    quiet, other = run(batches, tokens=False)
    assert sorted(quiet) == sorted(e for e in events if e.kind != answers.TOKEN) and sum(s.calls for s in other.states) == sum(s.calls for s in handle.states)
    heads, parts, early = handle.states
    assert not any(parts.entries.values()) and not any(early.entries.values()) and all(sum(len(x[0]) for x in h) < 10_000 for h in heads.items.values())
    buckets = len({s >> answers.BUCKET_BITS for s in texts})
    assert heads.calls <= 2 * n_batches * buckets  # one reads, one writes
    assert parts.calls + early.calls <= n_batches * sum(len(p or b"") for _, _, p in rows) // answers.SMALL  # and one more for some SMALL bytes
