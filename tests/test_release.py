import random
from types import SimpleNamespace
from zlib import crc32

import pandas as pd

from turnout.streaming import release as R

MINUTE = 60_000
WAIT = 10 * MINUTE


class Store:
    """A part's map state and timers, with the number of calls."""

    def __init__(self):
        self.map, self.timers, self.calls = {}, set(), 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.map.pop(key, None)

    def iterator(self):
        return iter(self.map.items())

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Part:
    def __init__(self, processor):
        self.store, self.processor = Store(), processor
        processor.init(self.store)

    def feed(self, rows, columns, now):
        frames = [pd.DataFrame(rows, columns=columns)] if rows else []
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
        out = list(self.processor.handleInputRows((0,), iter(frames), times)) if rows else []
        for at in sorted(t for t in self.store.timers if t <= now):
            self.store.timers.discard(at)
            out += self.processor.handleExpiredTimer((0,), times, SimpleNamespace(getExpiryTimeInMs=lambda: at))
        return pd.concat(out) if out else pd.DataFrame()


SENT = ["cell", "run_id", "company_id", "at", "n_asked", "ask"]


def sent(run, company, at, n, ask):
    return crc32((run + company).encode()) % 3, run, company, pd.Timestamp(at, unit="ms"), n, ask


def test_a_batch_calls_the_store_for_cells_not_for_companies():
    part = Part(R.Companies(WAIT))
    rows = [(n % 4, f"r{n % 200}", f"c{n}", pd.Timestamp(MINUTE, unit="ms"), 10, True) for n in range(2000)]
    out = part.feed(rows, SENT, 0)
    assert part.store.calls <= 2 * 4 + 1 and len(out) == 200 and set(out["n_asked"]) == {10}
    part.feed([], SENT, WAIT + 2 * MINUTE)
    assert part.store.map == {} and not part.store.timers


def test_shared_cells_release_what_companies_alone_would():
    own = random.Random(3)
    companies, runs, batches, plain = Part(R.Companies(WAIT)), Part(R.Runs(WAIT)), [[], [], []], {}
    for run in range(60):
        n, asked = own.randint(1, 4), own.randint(20, 60) * MINUTE
        firsts = []
        for company in range(n):
            at = own.randrange(3)
            batches[at].append(sent(f"r{run}", f"c{company}", asked, n, True))
            heard = {}  # by the batch that knows of them both
            for _ in range(own.randint(0, 4)):
                said, when = asked + own.randint(-3, 12) * MINUTE, own.randrange(3)
                batches[when].append(sent(f"r{run}", f"c{company}", said, 0, False))
                if asked <= said <= asked + WAIT:
                    heard.setdefault(max(when, at), []).append(said)
            if heard:
                firsts.append(min(heard[min(heard)]))
        full = len(firsts) == n
        plain[f"r{run}"] = (n, len(firsts), full, max(firsts) if full else asked + WAIT)
    got = {}
    for now, batch in zip([0, 0, 0, 45 * MINUTE, 200 * MINUTE], [*batches, [], []]):
        counts = companies.feed(batch, SENT, now)
        rows = [(crc32(c.run_id.encode()) % 2, *c) for c in counts.itertuples(index=False)] if len(counts) else []
        released = runs.feed(rows, ["cell", "run_id", "n_asked", "hits", "started", "last", "at"], now)
        for x in released.itertuples(index=False):
            assert x.run_id not in got
            at = int(x.released_at.timestamp() * 1000)
            assert x.complete or at < now  # as soon as its time is up
            got[x.run_id] = (x.n_asked, x.answered, x.complete, at)
        assert now or all(v[2] for v in got.values())
        assert now != 45 * MINUTE or {k for k, v in plain.items() if v[3] < now} <= got.keys()
    assert got == plain and not companies.store.map and not runs.store.map


ANSWER = ["cell", "run_id", "company_id", "at", "payload", "ask"]


def test_answers_in_cells_meet_what_an_outer_join_would():
    """Requests asked twice, early, late and repeated answers, in any order of batches; the store is called for cells."""
    own = random.Random(8)
    part, batches, asks, says = Part(R.Answers(WAIT * 1000)), [[], [], []], [], []
    for company in range(300):
        who, cell = (f"r{company % 7}", f"c{company}"), company % 5
        asked = [own.randint(20, 60) * MINUTE * 1000 + own.randint(0, 999_999) for _ in range(own.choice([0, 1, 1, 1, 2]))]
        said = [(own.choice(asked or [40 * MINUTE * 1000]) + own.randint(-2, 12) * MINUTE * 1000, f"p{n}") for n in range(own.randint(0, 3))]
        asks += [(*who, at) for at in asked]
        says += [(*who, at, payload) for at, payload in said]
        for at, payload, ask in [(at, None, True) for at in asked] + [(at, payload, False) for at, payload in said]:
            own.choice(batches).append((cell, *who, pd.Timestamp(at, unit="us"), payload, ask))
    want = [(r, c, at, said, payload) for r, c, at in asks for x, y, said, payload in says if (x, y) == (r, c) and at <= said <= at + WAIT * 1000]
    held = {x[:3] for x in want}
    alone = [(*x, None, None) for x in asks if x not in held]
    tuples = lambda out: [(x.run_id, x.company_id, x.asked_at, None if pd.isna(x.answered_at) else x.answered_at, x.payload) for x in out.itertuples(index=False)]
    got = [x for batch in batches for x in tuples(part.feed(batch, ANSWER, 0))]
    assert sorted(got) == sorted(want) and part.store.calls <= 3 * (2 * 5 + 1)
    first = tuples(part.feed([], ANSWER, 45 * MINUTE))
    assert sorted(first) == sorted(x for x in alone if x[2] + WAIT * 1000 < 45 * MINUTE * 1000)
    assert sorted(first + tuples(part.feed([], ANSWER, 200 * MINUTE))) == sorted(alone)
    assert part.store.map == {}
