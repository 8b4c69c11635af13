"""Windows and sessions with a trigger of one's own, as process functions: same class for batch replay and streams.

Use it where the declared triggers (event time with refirings, purging, counts, arrival time) do not say what is wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from keyclock.streaming.process import Context, KeyedProcessFunction

CONTINUE, FIRE, PURGE, FIRE_AND_PURGE = "continue", "fire", "purge", "fire_and_purge"


class WindowContext:
    """What a trigger and a result function see: window, key, clock, state per window and per key, timers."""

    def __init__(self, ctx: Context, window: tuple[int, int], pane: dict):
        self.key, self.window, self.current_watermark = ctx.key, window, ctx.current_watermark
        self.window_state: dict = pane["state"]
        self.global_state: dict = ctx.state.setdefault("global", {})
        self.processing_time = ctx.processing_time
        self._ctx, self._name = ctx, _name(window)

    def register_event_timer(self, timestamp: int) -> None:
        names = self._ctx.state.setdefault("due", {}).setdefault(str(timestamp), [])
        if self._name not in names:
            names.append(self._name)
        self._ctx.register_event_timer(timestamp)

    def delete_event_timer(self, timestamp: int) -> None:
        due = self._ctx.state.setdefault("due", {})
        names = [n for n in due.get(str(timestamp), []) if n != self._name]
        if names:
            due[str(timestamp)] = names
        else:
            due.pop(str(timestamp), None)
            self._ctx.delete_event_timer(timestamp)

    def register_processing_timer(self, timestamp: int) -> None:
        """A timer on the clock of the machine, for this window (streams only)."""
        names = self._ctx.state.setdefault("due_at", {}).setdefault(str(timestamp), [])
        if self._name not in names:
            names.append(self._name)
        _next_processing_timer(self._ctx)

    def delete_processing_timer(self, timestamp: int) -> None:
        due = self._ctx.state.setdefault("due_at", {})
        names = [n for n in due.pop(str(timestamp), []) if n != self._name]
        if names:
            due[str(timestamp)] = names
        _next_processing_timer(self._ctx)

    def forget(self) -> None:
        """No timer fires for this window any more."""
        for what in ("due", "due_at"):
            due = self._ctx.state.setdefault(what, {})
            for t in [t for t, names in due.items() if self._name in names]:
                if what == "due":
                    self.delete_event_timer(int(t))
                else:
                    self.delete_processing_timer(int(t))

    def side_output(self, tag: str, **fields) -> None:
        self._ctx.side_output(tag, **fields)


def _next_processing_timer(ctx: Context) -> None:
    """One timer of the stream stands for all windows of the key: the earliest."""
    due = ctx.state.get("due_at", {})
    wanted = [min(map(int, due))] if due else []
    standing = ctx.processing_timers()
    for t in standing:
        if t not in wanted:
            ctx.delete_processing_timer(t)
    for t in wanted:
        if t not in standing:
            ctx.register_processing_timer(t)


class Trigger:
    """Decide on every element and timer; results are the constants of this module."""

    def on_element(self, row: dict, ctx: WindowContext) -> str:
        return CONTINUE

    def on_event_time(self, timestamp: int, ctx: WindowContext) -> str:
        return CONTINUE

    def on_processing_time(self, timestamp: int, ctx: WindowContext) -> str:
        return CONTINUE

    def on_merge(self, states: list[dict], ctx: WindowContext) -> None:
        """Windows have become one: their states, to be put together in ``ctx.window_state``, which is empty."""
        raise ValueError("this trigger cannot merge windows")

    def clear(self, ctx: WindowContext) -> None:
        """The window is dropped: the last chance to clean up what the trigger keeps beyond it."""


class EventTimeTrigger(Trigger):
    """Fire when the clock reaches the window's last instant, and again for every accepted row after that."""

    def on_element(self, row, ctx):
        last = ctx.window[1] - 1
        if last <= ctx.current_watermark:
            return FIRE
        ctx.register_event_timer(last)
        return CONTINUE

    def on_event_time(self, timestamp, ctx):
        return FIRE if timestamp == ctx.window[1] - 1 else CONTINUE

    def on_merge(self, states, ctx):
        if ctx.window[1] - 1 > ctx.current_watermark:
            ctx.register_event_timer(ctx.window[1] - 1)


class ProcessingTimeTrigger(Trigger):
    """Fire when the clock of the machine is ``after_ms`` past the first row since the last firing (streams only)."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def on_element(self, row, ctx):
        if "at" not in ctx.window_state:
            ctx.window_state["at"] = ctx.processing_time + self.after_ms
            ctx.register_processing_timer(ctx.window_state["at"])
        return CONTINUE

    def on_processing_time(self, timestamp, ctx):
        ctx.window_state.pop("at", None)
        return FIRE

    def on_merge(self, states, ctx):
        standing = [s["at"] for s in states if "at" in s]
        if standing:
            ctx.window_state["at"] = min(standing)
            ctx.register_processing_timer(min(standing))


class CountTrigger(Trigger):
    def __init__(self, every: int):
        self.every = every

    def on_element(self, row, ctx):
        ctx.window_state["count"] = ctx.window_state.get("count", 0) + 1
        if ctx.window_state["count"] < self.every:
            return CONTINUE
        ctx.window_state["count"] = 0
        return FIRE

    def on_merge(self, states, ctx):
        ctx.window_state["count"] = sum(s.get("count", 0) for s in states)


class PurgingTrigger(Trigger):
    """Whatever fires also empties the window."""

    def __init__(self, inner: Trigger):
        self.inner = inner

    def on_element(self, row, ctx):
        return _purging(self.inner.on_element(row, ctx))

    def on_event_time(self, timestamp, ctx):
        return _purging(self.inner.on_event_time(timestamp, ctx))

    def on_processing_time(self, timestamp, ctx):
        return _purging(self.inner.on_processing_time(timestamp, ctx))

    def on_merge(self, states, ctx):
        self.inner.on_merge(states, ctx)

    def clear(self, ctx):
        self.inner.clear(ctx)


def _purging(decision: str) -> str:
    return FIRE_AND_PURGE if decision == FIRE else decision


def _name(window: tuple[int, int]) -> str:
    return f"{window[0]},{window[1]}"


class TriggeredWindows(KeyedProcessFunction):
    """``assign(ts) -> [(start, end)]``, ``add(acc, row) -> acc`` (acc starts as None), ``result(acc, ctx) -> dict``.

    Accumulators and both kinds of state are JSON values. Rows no window takes leave as side output ``late`` with
    ``late(row)`` as their fields.
    """

    def __init__(self, assign: Callable, trigger: Trigger, add: Callable, result: Callable, ts: str, lateness_ms: int = 0, late: Callable | None = None):
        self.assign, self.trigger, self.add, self.result = assign, trigger, add, result
        self.ts, self.lateness_ms, self.late = ts, lateness_ms, late

    def process(self, row, ctx):
        panes, skipped = ctx.state.setdefault("panes", {}), True
        for window in self.assign(row[self.ts]):
            gone = window[1] - 1 + self.lateness_ms
            if gone <= ctx.current_watermark:
                continue
            skipped = False
            pane = panes.setdefault(_name(window), {"acc": None, "state": {}})
            pane["acc"] = self.add(pane["acc"], row)
            about = WindowContext(ctx, window, pane)
            self._act(self.trigger.on_element(row, about), pane, about, ctx)
            about.register_event_timer(gone)
        if skipped and self.late is not None and row[self.ts] + self.lateness_ms <= ctx.current_watermark:
            ctx.side_output("late", **self.late(row))

    def on_timer(self, timestamp, ctx):
        for name, pane, about in self._waiting("due", timestamp, ctx):
            self._act(self.trigger.on_event_time(timestamp, about), pane, about, ctx)
            if timestamp == about.window[1] - 1 + self.lateness_ms:
                self.trigger.clear(about)
                about.forget()
                del ctx.state["panes"][name]

    def on_processing_timer(self, timestamp, ctx):
        due = ctx.state.setdefault("due_at", {})
        for t in sorted(int(t) for t in due if int(t) <= timestamp):
            for _, pane, about in self._waiting("due_at", t, ctx):
                self._act(self.trigger.on_processing_time(t, about), pane, about, ctx)
        _next_processing_timer(ctx)

    def _waiting(self, what: str, timestamp: int, ctx):
        """The windows that asked for a timer."""
        for name in ctx.state.setdefault(what, {}).pop(str(timestamp), []):
            pane = ctx.state["panes"].get(name)
            if pane is not None:
                yield name, pane, WindowContext(ctx, tuple(map(int, name.split(","))), pane)

    def _act(self, decision, pane, about, ctx):
        if decision in (FIRE, FIRE_AND_PURGE) and pane["acc"] is not None:
            ctx.output(**self.result(pane["acc"], about))
        if decision in (PURGE, FIRE_AND_PURGE):
            pane["acc"] = None


class TriggeredSessions(TriggeredWindows):
    """Sessions: every row opens a window of ``gap_ms``, and windows that touch become one, with their accumulators (``merge(a, b)``) and what
    the trigger keeps for them. A row is late if the session it would be in is."""

    def __init__(self, gap_ms: int, trigger: Trigger, add: Callable, merge: Callable, result: Callable, ts: str, lateness_ms: int = 0, late: Callable | None = None):
        if gap_ms <= 0:
            raise ValueError("the session gap must be positive")
        super().__init__(lambda t: [(t, t + gap_ms)], trigger, add, result, ts, lateness_ms, late)
        self.merge = merge

    def process(self, row, ctx):
        panes, window = ctx.state.setdefault("panes", {}), self.assign(row[self.ts])[0]
        spans = [(tuple(map(int, name.split(","))), name) for name in panes]
        touched = sorted((w, name) for w, name in spans if w[0] <= window[1] and w[1] >= window[0])
        window = (min([window[0], *(w[0] for w, _ in touched)]), max([window[1], *(w[1] for w, _ in touched)]))
        gone = window[1] - 1 + self.lateness_ms
        if gone <= ctx.current_watermark:
            if self.late is not None:
                ctx.side_output("late", **self.late(row))
            return
        if [w for w, _ in touched] != [window]:
            pane, states = {"acc": None, "state": {}}, []
            for w, name in touched:
                old = panes.pop(name)
                WindowContext(ctx, w, old).forget()
                states.append(old["state"])
                if old["acc"] is not None:
                    pane["acc"] = old["acc"] if pane["acc"] is None else self.merge(pane["acc"], old["acc"])
            panes[_name(window)] = pane
            if states:
                self.trigger.on_merge(states, WindowContext(ctx, window, pane))
        pane = panes[_name(window)]
        pane["acc"] = self.add(pane["acc"], row)
        about = WindowContext(ctx, window, pane)
        self._act(self.trigger.on_element(row, about), pane, about, ctx)
        about.register_event_timer(gone)
