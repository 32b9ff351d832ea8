"""The propagation stream event by event, written independently of the operators: for tests only."""

from dataclasses import dataclass, field


@dataclass
class Win:
    qid: str
    o: int
    warm: bool
    humans: dict = field(default_factory=dict)
    every: set = field(default_factory=set)
    n_human: int = 0
    n_bot: int = 0
    late: int = 0
    closed: int | None = None


def simulate(edits, W, R, U, H, ranks):
    """edits: (qid, wiki, title, ts, bot, user, seq) in any order; arrival is by seq. Returns records, windows, out-of-order count, peaks."""
    stream = sorted((e for e in edits if e[0] is not None), key=lambda e: e[6])
    if not stream:
        return [], [], 0, (0, 0, 0)
    queue, clock, done, start = [], None, None, None
    open_, memory, wins, records = [], [], [], []
    state = {"ooo": 0, "peaks": [0, 0, 0]}

    def handle(e):
        nonlocal done
        q, wiki, title, t, bot, user, _ = e
        if done is not None and t < done:
            state["ooo"] += 1
        else:
            done = t
        while open_ and open_[0].o <= done - W:
            w = open_.pop(0)
            w.closed = done
            memory.append(w)
            state["peaks"][1] = max(state["peaks"][1], len(memory))
        while memory and memory[0].closed <= done - H:
            memory.pop(0)
        past = next((w for w in memory if w.qid == q), None)
        if past is not None:
            if not bot and wiki not in past.humans:
                past.late += 1
            return
        w = next((w for w in open_ if w.qid == q), None)
        if w is None:
            w = Win(q, t, t < start + U)
            open_.append(w)
            wins.append(w)
            state["peaks"][0] = max(state["peaks"][0], len(open_))
        w.every.add(wiki)
        if bot:
            w.n_bot += 1
            return
        w.n_human += 1
        if wiki in w.humans:
            return
        w.humans[wiki] = (t, title, user)
        if len(w.humans) in ranks and not w.warm:
            lead, (lt, ltitle, _) = next(iter(w.humans.items()))
            records.append((q, len(w.humans), lead, ltitle, lt, wiki, title, t, user, t - lt))

    for e in stream:
        start = e[3] if start is None else min(start, e[3])
        clock = e[3] if clock is None else max(clock, e[3])
        queue.append(e)
        state["peaks"][2] = max(state["peaks"][2], len(queue))
        ready = sorted((x for x in queue if x[3] <= clock - R), key=lambda x: (x[3], x[6]))
        queue = [x for x in queue if x[3] > clock - R]
        for x in ready:
            handle(x)
    for x in sorted(queue, key=lambda x: (x[3], x[6])):
        handle(x)
    return records, wins, state["ooo"], tuple(state["peaks"])
