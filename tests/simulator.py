"""Record-by-record replay of the window rules: an independent, deliberately naive check for tests."""

MIN, MAX = -(2**63), 2**63 - 1


def tumbling(size, off=0):
    return lambda t: [((t - off) // size * size + off, (t - off) // size * size + off + size)]


def sliding(size, slide):
    def f(t):
        newest = t // slide * slide
        out, s = [], newest
        while s > t - size:
            out.append((s, s + size))
            s -= slide
        return out

    return f


def replay(rows, assign, propose, lateness=0, scope="key", tick=None):
    """rows: (key, ts, arrival, id). Returns (firings, late ids); a firing is (key, start, end, no, n, wm, at)."""
    rows = sorted(rows, key=lambda r: (r[2], r[3]))
    clock, pending, live, fired_no = {}, {}, {}, {}
    firings, late = [], []

    def wm_of(k):
        return clock.get(k if scope == "key" else "*", MIN)

    def fire(k, w, wm, at):
        fired_no[k, w] = fired_no.get((k, w), 0) + 1
        firings.append((k, w[0], w[1], fired_no[k, w], live[k, w], wm, at))

    def advance(c, wm, at):
        if wm is None or wm <= clock.get(c, MIN):
            return
        old = clock.get(c, MIN)
        clock[c] = wm
        for k, w in sorted(live, key=lambda x: (x[1][1], repr(x[0]))):
            if scope == "key" and k != c:
                continue
            if old < w[1] - 1 <= wm:
                fire(k, w, wm, at)
        for k, w in list(live):
            if (scope == "stream" or k == c) and w[1] - 1 + lateness <= wm:
                del live[k, w]

    def flush_tick(t):
        for c, wm in list(pending.items()):
            advance(c, wm, (t + 1) * tick)
        pending.clear()

    now = None
    for k, ts, arrival, rid in rows:
        if tick is not None:
            t = arrival // tick
            if now is not None and t != now:
                flush_tick(now)
            now = t
        skipped = True
        for w in assign(ts):
            if w[1] - 1 + lateness <= wm_of(k):
                continue
            skipped = False
            live[k, w] = live.get((k, w), 0) + 1
            if w[1] - 1 <= wm_of(k):
                fire(k, w, wm_of(k), arrival)
        if skipped and ts + lateness <= wm_of(k):
            late.append(rid)
        c, wm = (k if scope == "key" else "*"), propose(ts)
        if tick is None:
            advance(c, wm, arrival)
        elif wm is not None:
            pending[c] = max(pending.get(c, MIN), wm)
    if tick is not None and now is not None:
        flush_tick(now)
    for k, w in list(live):
        if w[1] - 1 > wm_of(k):
            fire(k, w, MAX, None)
    return firings, late


def replay_sessions(rows, gap, bound, lateness=0):
    """Keyed session windows, record by record. Returns (first firings, refirings, late ids)."""
    clock, live = {}, {}
    first, again, late = [], [], []
    for k, ts, _, rid in sorted(rows, key=lambda r: (r[2], r[3])):
        wm = clock.get(k, MIN)
        mine = live.setdefault(k, [])
        new, rest = [ts, ts + gap, 1, False], []
        touched = [s for s in mine if s[0] <= new[1] and s[1] >= new[0]]
        for s in touched:
            kept_shape = s[0] <= ts and s[1] >= ts + gap
            new = [min(new[0], s[0]), max(new[1], s[1]), new[2] + s[2], s[3] and kept_shape]
        rest = [s for s in mine if s not in touched]
        if new[1] - 1 + lateness <= wm:
            late.append(rid)
        else:
            if new[1] - 1 <= wm:
                again.append((k, new[0], new[1], new[2], wm))
                new[3] = True
            live[k] = rest + [new]
        cand = ts - bound - 1
        if cand > wm:
            clock[k] = cand
            for s in live[k]:
                if not s[3] and s[1] - 1 <= cand:
                    s[3] = True
                    first.append((k, s[0], s[1], s[2], cand))
            live[k] = [s for s in live[k] if s[1] - 1 + lateness > cand]
    for k, sessions in live.items():
        first += [(k, s[0], s[1], s[2], MAX) for s in sessions if not s[3]]
    return first, again, late
