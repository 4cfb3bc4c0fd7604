import random

import pytest

from colloquy.operators.events import onset_bin_counts, onsets, remove_short, turn_events
from colloquy.operators.interleave import emission_stats, schedule
from colloquy.streaming.clock import EmissionQueue

P, W, BC, OT, RS = 10, 150, 50, 25, 50
CASES = {
    "shift": ([(0, 100)], [(120, 220)], [(100, 0, "SHIFT"), (220, 1, "HOLD")]),
    "hold": ([(0, 100), (130, 200)], [], [(100, 0, "HOLD"), (200, 0, "HOLD")]),
    "short pause": ([(0, 100), (109, 200)], [], [(200, 0, "HOLD")]),
    "terminal overlap": ([(0, 100)], [(90, 200)], [(100, 0, "SHIFT"), (200, 1, "HOLD")]),
    "interruption": ([(0, 100)], [(50, 200)], [(50, 1, "INTERRUPT"), (200, 1, "HOLD")]),
    "backchannel": ([(0, 300)], [(100, 130)], [(100, 1, "BACKCHANNEL"), (300, 0, "HOLD")]),
    "tie": ([(0, 100), (150, 200)], [(150, 180)], [(100, 0, "HOLD"), (150, 0, "INTERRUPT"), (150, 1, "BACKCHANNEL"), (200, 0, "HOLD")]),
    "end of recording": ([(0, 995)], [], []),
}


def frames(seg, t):
    v = [[0] * (t + 1) for _ in range(2)]
    for s in range(2):
        for i, j in seg[s]:
            for f in range(i, j):
                v[s][f] = 1
    return v


def by_frames(seg, t):
    """The rules, read frame by frame."""
    v, out = frames(seg, t), []
    starts = [[f for f in range(t) if v[s][f] and (f == 0 or not v[s][f - 1])] for s in range(2)]
    nxt = lambda s, f: next((x for x in starts[s] if x >= f), None)
    for s in range(2):
        o = 1 - s
        for i in starts[s]:
            j = i
            while v[s][j]:
                j += 1
            ns = nxt(s, j)
            if j + P <= t and not any(v[s][j : j + P]) and not v[o][j - 1]:
                no = nxt(o, j)
                soon = no is not None and no < j + W
                out.append((j, s, "SHIFT" if soon and (ns is None or ns >= j + W or no < ns) else "HOLD"))
            if i > 0 and v[o][i]:
                oe = i
                while v[o][oe]:
                    oe += 1
                again = nxt(o, oe)
                resumes = again is not None and again < oe + RS
                if j > oe and not resumes:
                    out.append((oe, o, "SHIFT") if oe - i <= OT else (i, s, "INTERRUPT"))
                elif j - i <= BC:
                    out.append((i, s, "BACKCHANNEL"))
    return sorted(out)


def run(spark, timelines):
    seg = spark.createDataFrame([(c, s, i, j) for c, (a, b, _) in timelines.items() for s, x in enumerate((a, b)) for i, j in x], "conv_id string, speaker int, i bigint, j bigint")
    length = spark.createDataFrame([(c, t) for c, (_, _, t) in timelines.items()], "conv_id string, t bigint")
    got = {c: [] for c in timelines}
    for r in turn_events(seg, length).collect():
        got[r.conv_id].append((r.f, r.speaker, r.kind))
    return seg, length, {c: sorted(x) for c, x in got.items()}


def timeline(r):
    out = []
    for _ in range(2):
        f, x = 0, []
        while True:
            i = f + r.choice([1, 3, 9, 10, 11, 40, 60, 170])
            j = i + r.choice([1, 5, 30, 50, 51, 120])
            if j > 900:
                break
            x.append((i, j))
            f = j
        out.append(x)
    return out[0], out[1], 910


@pytest.fixture(scope="module")
def random_timelines():
    r = random.Random(5)
    return {f"c{i}": timeline(r) for i in range(60)}


def test_cases(spark):
    got = run(spark, {c: (a, b, 1000) for c, (a, b, _) in CASES.items()})[2]
    assert got == {c: sorted(w) for c, (_, _, w) in CASES.items()}


def test_random_timelines(spark, random_timelines):
    got = run(spark, random_timelines)[2]
    assert got == {c: by_frames((a, b), t) for c, (a, b, t) in random_timelines.items()}


def test_channel_swap_symmetry(spark, random_timelines):
    plain = run(spark, random_timelines)[2]
    swapped = run(spark, {c: (b, a, t) for c, (a, b, t) in random_timelines.items()})[2]
    assert swapped == {c: sorted((f, 1 - s, k) for f, s, k in x) for c, x in plain.items()}


def test_onset_bins_and_short_runs(spark, random_timelines):
    seg, length, _ = run(spark, random_timelines)
    ons = onsets(seg, P)
    got = {}
    for r in onset_bin_counts(ons, length, [8, 16, 32, 64, 128], 128).collect():
        got[r.conv_id, r.speaker, r.bin, r.censored] = r.n
    want = {}
    for c, (a, b, t) in random_timelines.items():
        for s, x in enumerate((a, b)):
            on = [i for k, (i, _) in enumerate(x) if k == 0 or i - x[k - 1][1] >= P]
            for f in range(t):
                d = next((o - f for o in on if o > f), None)
                cens = d is None or d > 128
                key = c, s, 5 if cens else sum(d >= e for e in (8, 16, 32, 64, 128)), cens
                want[key] = want.get(key, 0) + 1
    assert got == want
    short = {}
    for r in remove_short(seg, length, 10, 5).collect():
        short.setdefault((r.conv_id, r.speaker), []).append((r.i, r.j))
    for c, (a, b, t) in random_timelines.items():
        for s, x in enumerate((a, b)):
            v = frames((x, []), t)[0][:t]
            for value, least in ((0, 10), (1, 5)):
                f = 0
                while f < t:
                    g = f
                    while g < t and v[g] == v[f]:
                        g += 1
                    if v[f] == value and g - f < least:
                        v[f:g] = [1 - value] * (g - f)
                        g = f  # look at the joined run from its beginning
                        while g > 0 and v[g - 1] == v[f]:
                            g -= 1
                        if value == 1:
                            g = f + 1
                            while g < t and v[g] == v[f]:
                                g += 1
                        else:
                            g = f + 1
                    f = g
            runs, f = [], 0
            while f < t:
                g = f
                while g < t and v[g] == v[f]:
                    g += 1
                if v[f]:
                    runs.append((f, g))
                f = g
            if x:
                assert sorted(short.get((c, s), [])) == runs


def test_schedule_is_the_queue(spark):
    r = random.Random(3)
    toks, lens = [], []
    for c in range(25):
        n = r.randrange(1, 80)
        lens.append((f"c{c}", r.randrange(800, 4000)))
        toks += [(f"c{c}", r.randrange(2), k, r.randrange(0, 4000)) for k in range(n)]
    t = spark.createDataFrame(toks, "conv_id string, speaker int, tid bigint, end_ms bigint")
    n = spark.createDataFrame(lens, "conv_id string, ms bigint")
    s = schedule(t, n, 3, 2)
    got = {(x.conv_id, x.tid): x.e for x in s.collect()}
    stats = {x.conv_id: x for x in emission_stats(s, n).collect()}
    for c, ms in lens:
        chunks = -(-ms // 80)
        mine = sorted((x for x in toks if x[0] == c), key=lambda x: (x[3], x[1], x[2]))
        queue, backlog, most, free = [x for x in mine if min(chunks, x[3] // 80 + 2) < chunks], [], 0, EmissionQueue(3, 2, 80)
        for x in queue:
            assert got[c, x[2]] == free.push(x[3], x[1])[0]
        out = {}
        for k in range(chunks):
            backlog += [x for x in queue if x[3] // 80 + 2 == k]
            backlog.sort(key=lambda x: (x[3], x[1], x[2]))
            for x in backlog[:3]:
                out[x[2]] = k
            backlog = backlog[3:]
            most = max(most, len(backlog))
        assert all(got[c, tid] == k for tid, k in out.items())
        assert all(got[c, x[2]] >= chunks for x in backlog)
        if queue:
            assert stats[c].max_backlog == most and stats[c].tokens == len(out)


def test_future_labels_over_stretches(spark, monkeypatch):
    from colloquy.operators import frames as ops

    monkeypatch.setattr(ops, "SHARD", 40)
    r = random.Random(9)
    active, lengths, want = [], [], {}
    for c in range(6):
        n = [30, 25, 26, 200, 333, 120][c]
        on = [[int(r.random() < 0.4) for _ in range(n)] for _ in range(2)]
        on = [[0] * n, [0] * n] if c == 5 else on
        lengths.append((f"c{c}", n))
        active += [(f"c{c}", s, f) for s in range(2) for f in range(n) if on[s][f]]
        for f in range(n - 25):
            at, label = f + 1, 0
            for k, w in enumerate((2, 5, 8, 10)):
                for s in range(2):
                    label |= (2 * sum(on[s][at : at + w]) >= w) << (4 * s + k)
                at += w
            want[f"c{c}", f] = label
    a = spark.createDataFrame(active, "conv_id string, speaker int, chunk bigint")
    length = spark.createDataFrame(lengths, "conv_id string, n bigint")
    assert {(x.conv_id, x.f): x.label for x in ops.future_labels(a, length, 12.5).collect()} == want
    seg = a.select("conv_id", "speaker", (a["chunk"] * 4).alias("i"), (a["chunk"] * 4 + 1).alias("j"))
    counted = {(x.conv_id, x.label): x.n for x in ops.future_label_counts(seg, length, 12.5, 4).collect()}
    assert counted == {k: sum(1 for (c, _), v in want.items() if (c, v) == k) for k in {(c, v) for (c, _), v in want.items()}}


def test_model_sequence_is_its_definition(spark):
    from colloquy.operators.interleave import model_sequence

    r = random.Random(5)
    lens = [(f"c{c}", [0, 1, 79, 80, 81, 700, 2000, 4000, 4001, 5000][c]) for c in range(10)]
    toks = [(c, r.randrange(2), 100 * int(c[1:]) + k, r.randrange(-300, max(ms, 1))) for c, ms in lens for k in range(r.choice([1, 5, 60])) if c not in ("c5", "c2")]
    t = spark.createDataFrame(toks, "conv_id string, speaker int, tid bigint, end_ms bigint")
    n = spark.createDataFrame(lens, "conv_id string, ms bigint")
    s = schedule(t, n, 2, 2)
    sent = sorted(((x.conv_id, x.i, x.e, x.n_chunks, x.tid, x.speaker) for x in s.collect()), key=lambda x: x[:2])
    for slots in (1, 2):
        want = []
        for c, ms in lens:
            items = [(k, 0, s, "audio", None, -100) for k in range(-(-ms // 80)) for s in range(slots)] + [(k, 2, 0, "next", None, -10) for k in range(-(-ms // 80))]
            last = None
            for _, i, e, chunks, tid, speaker in (x for x in sent if x[0] == c):
                if e < chunks:
                    items += [(e, 1, 2 * i, "tag", None, -1 - speaker)] * (speaker != last) + [(e, 1, 2 * i + 1, "token", tid, tid)]
                last = speaker
            want += [(c, pos, kind, chunk, tid, label) for pos, (chunk, _, _, kind, tid, label) in enumerate(sorted(items, key=lambda x: x[:3]))]
        q = model_sequence(s, n, slots=slots)
        assert sorted((tuple(x) for x in q.collect()), key=lambda x: x[:2]) == want
    plan = q._jdf.queryExecution().optimizedPlan().toString()  # the sorts come before the slots are made
    assert plan.index("Generate") < plan.index("Window")


def test_sums_of_the_model_sequence_are_exact(spark, tmp_path):
    from collections import defaultdict

    from pyspark.sql import functions as F

    from colloquy.operators.interleave import model_sequence
    from colloquy.plans import interleave as plans

    r = random.Random(9)
    for shift, kind in ((0, "bigint"), (9 * 10**15, "decimal(38,0)")):  # tids of 9 * 10^18: a place above 1 leaves a bigint, and the SQL fails
        utts = [(shift + 1 + k, f"c{k % 5}", r.randrange(2), at, at + r.choice([0.05, 1.0, 4.0]), " ".join("w" * r.choice([0, 1, 9, 39]))) for k in range(100) for at in (r.uniform(-1, 20),)]
        utts += [(shift + 200, "silent", 0, 1.0, 2.0, None), (shift + 201, "blank", 1, 0.0, 0.3, "  "), (shift + 202, "before", 0, -1.0, -0.8, "a b"), (shift + 203, "before", 1, -0.5, -0.1, "c"), (None, "no id", 0, 0.0, 1.0, "a b c")]
        d = f"{tmp_path}/{shift}"
        spark.createDataFrame(utts + utts[:10], "utt_id bigint, conv_id string, speaker int, start_s double, end_s double, text string").write.parquet(f"{d}/utterance.parquet")
        t, n = plans.streams(spark, d)
        s = schedule(t, n, 4, 2)
        want = defaultdict(lambda: [0, 0, 0])
        for x in model_sequence(s, n).collect():
            for k, v in enumerate((1, x.pos, x.pos * (x.label or 0))):
                want[x.conv_id, x.kind][k] += v
        q = plans.model_sequence(spark, d)
        got = {(x.conv_id, x.kind): [x.n, x.pos_sum, int(x.check_sum or 0)] for x in q.collect()}
        assert dict(q.dtypes)["check_sum"] == kind
        assert got == dict(want) and len(got) > 20
        assert (max(abs(x[2]) for x in got.values()) >= 2**63) == (shift > 0)
        slow = schedule(t.withColumn("m", F.lit(4)), n, None, 2)  # the way of queues with an m of their own
        assert sorted((x.conv_id, x.tid, x.i, x.e) for x in slow.collect()) == sorted((x.conv_id, x.tid, x.i, x.e) for x in s.collect())
