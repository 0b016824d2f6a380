"""Lease, redelivery and dead-letter scenarios as commands, and the fold against an independent model."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import groups
from millrace.operators.groups import GroupFold


def run(fold, *commands):
    return [fold.apply(at, consumer, op, n, offset) for at, consumer, op, n, offset in commands]


def got(out):
    return (out["delivered_from"], out["delivered_to"])


def test_expired_lease_goes_to_another_consumer():
    f = GroupFold(list(range(10)), lease_ms=50)
    out = run(f, (0, "A", "acquire", 5, None), (60, None, "expire", None, None), (61, "B", "acquire", 5, None))
    assert got(out[0]) == (0, 5) and got(out[2]) == (0, 5)


def test_committed_messages_are_not_delivered_again():
    f = GroupFold(list(range(5)), lease_ms=50)
    out = run(f, (0, "A", "acquire", 5, None), (1, "A", "commit", None, 5), (60, None, "expire", None, None), (61, "A", "acquire", 5, None))
    assert out[3]["delivered_n"] == 0 and out[1]["committed"] == 5


def test_commits_out_of_order_coalesce():
    f = GroupFold(list(range(10)))
    out = run(f, (0, "A", "acquire", 5, None), (0, "B", "acquire", 5, None), (1, "B", "commit", None, 10), (2, "A", "commit", None, 5))
    assert [o["committed"] for o in out] == [-1, -1, -1, 10]


def test_only_late_leases_expire():
    f = GroupFold(list(range(20)), lease_ms=50)
    run(f, (0, "A", "acquire", 5, None), (40, "B", "acquire", 5, None), (60, None, "expire", None, None))
    assert list(f.leases) == ["B"]
    assert got(f.apply(61, "C", "acquire", 5, None)) == (0, 5)


def test_two_consumers_get_disjoint_chunks():
    f = GroupFold(list(range(20)))
    out = run(f, (0, "A", "acquire", 10, None), (0, "B", "acquire", 10, None))
    assert [got(o) for o in out] == [(0, 10), (10, 20)]


def test_stored_offset_is_where_a_group_begins():
    assert got(GroupFold(list(range(10)), committed=5).apply(0, "A", "acquire", 10, None)) == (5, 10)


def test_three_expiries_make_a_dead_letter():
    f = GroupFold([0], lease_ms=10, most=3)
    routed = []
    for k in range(3):
        out = run(f, (100 * k, "A", "acquire", 1, None), (100 * k + 50, None, "expire", None, None))
        routed += out[1]["routed_to_dlq"]
    assert routed == [0]
    assert f.apply(900, "A", "acquire", 1, None)["delivered_n"] == 0 and f.committed == 1


def test_nack_and_expiry_share_the_count():
    f = GroupFold([0, 1], lease_ms=10, most=3)
    run(f, (0, "A", "acquire", 1, None), (1, "A", "nack", None, 0), (2, "A", "acquire", 1, None), (50, None, "expire", None, None), (51, "A", "acquire", 1, None))
    assert f.apply(52, "A", "nack", None, 0)["routed_to_dlq"] == [0]


def test_dead_letters_and_commits_advance_together():
    f = GroupFold(list(range(5)), most=1)
    run(f, (0, "A", "acquire", 1, None), (1, "A", "nack", None, 0), (2, "A", "acquire", 1, None), (3, "A", "commit", None, 2), (4, "A", "acquire", 1, None), (5, "A", "nack", None, 2))
    assert got(f.apply(6, "A", "acquire", 5, None)) == (3, 5) and f.committed == 3


def test_dead_letter_behind_a_commit_by_another():
    f = GroupFold(list(range(6)), most=1)
    run(f, (0, "A", "acquire", 3, None), (0, "B", "acquire", 3, None), (1, "B", "commit", None, 6), (2, "A", "nack", None, 0))
    assert f.apply(3, "C", "acquire", 1, None)["delivered_from"] == 1


def test_sparse_offsets_follow_messages():
    f = GroupFold([3, 10, 11, 40])
    out = run(f, (0, "A", "acquire", 2, None), (0, "B", "acquire", 5, None))
    assert got(out[0]) == (3, 11) and got(out[1]) == (11, 41)


def test_commit_without_group_overwrites():
    f = GroupFold(list(range(10)))
    assert [o["committed"] for o in run(f, (0, "A", "commit", None, 7), (1, "A", "commit", None, 2))] == [7, 2]
    assert f.apply(2, "A", "acquire", 1, None)["delivered_from"] == 2


def test_late_commit_changes_nothing():
    """As long as another consumer keeps the group active: without one the commit overwrites what is stored."""
    f = GroupFold(list(range(9)), lease_ms=10)
    out = run(f, (0, "A", "acquire", 5, None), (15, "B", "acquire", 2, None), (20, None, "expire", None, None), (21, "A", "commit", None, 5))
    assert out[3]["committed"] == -1 and out[3]["dispatch"] == 0


def test_unknown_commands_fail():
    with pytest.raises(ValueError, match="unknown command"):
        GroupFold([]).apply(0, "A", "seek", None, None)


COMMANDS = st.lists(st.tuples(st.sampled_from(["acquire", "commit"]), st.sampled_from("ABC"), st.integers(1, 4)), max_size=40)


@settings(max_examples=60, deadline=None)
@given(COMMANDS)
def test_without_rewinds_delivery_is_disjoint_and_commits_only_advance(steps):
    f, seen, committed, leased = GroupFold(list(range(0, 90, 3))), [], -1, {}
    for k, (op, who, n) in enumerate(steps):
        if op == "commit" and who not in leased:
            continue
        out = f.apply(k, who, op, n, leased.pop(who, None) if op == "commit" else None)
        if op == "acquire" and out["delivered_n"]:
            seen += range(out["delivered_from"], out["delivered_to"])
            leased[who] = out["delivered_to"]
        assert out["committed"] >= committed
        committed = out["committed"]
    assert len(seen) == len(set(seen))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=20))
def test_coalescing_equals_marking_offsets(ranges):
    f = GroupFold([])
    f.ranges = [(a, a + n) for a, n in ranges]
    f._advance()
    marked = {o for a, n in ranges for o in range(a, a + n)}
    at = 0
    while at in marked:
        at += 1
    assert max(0, f.committed) == at


def test_replay_is_the_fold(spark):
    commands = [(k, k * 10, "g", "t", "AB"[k % 2], ["acquire", "commit", "nack", "expire"][k % 4], 3, k) for k in range(40)]
    df = spark.createDataFrame(commands, "seq long, at_ms long, group string, topic string, consumer string, op string, n int, offset long")
    messages = spark.createDataFrame([("t", o) for o in range(0, 60, 2)], "topic string, offset long")
    found = groups.replay(df, messages, lease_ms=100, most=2).orderBy("seq").collect()
    fold = GroupFold(list(range(0, 60, 2)), 100, 2)
    for row, (_, at, _, _, who, op, n, offset) in zip(found, commands, strict=True):
        want = fold.apply(at, who, op, n, offset)
        assert {k: row[k] for k in want} == want


def test_replay_of_nothing(spark):
    empty = spark.createDataFrame([], "seq long, at_ms long, group string, topic string, consumer string, op string, n int, offset long")
    assert groups.replay(empty, spark.createDataFrame([], "topic string, offset long")).count() == 0


def test_replay_jumps_as_a_fold_over_all_offsets(spark):
    """Commits before the first acquire and rejected offsets far ahead: the offsets within reach are enough."""
    import random

    r = random.Random(4)
    offsets = sorted(r.sample(range(5000), 900))
    commands = [(0, 0, "g", "t", "A", "commit", None, 1700)]
    for k in range(1, 120):
        op = r.choice(["acquire", "acquire", "commit", "nack", "expire"])
        commands.append((k, k * 7, "g", "t", r.choice("AB"), op, r.randint(1, 4), r.randint(0, 4900)))
    df = spark.createDataFrame(commands, "seq long, at_ms long, group string, topic string, consumer string, op string, n int, offset long")
    messages = spark.createDataFrame([("t", o) for o in offsets], "topic string, offset long")
    found = groups.replay(df, messages, lease_ms=30, most=2).orderBy("seq").collect()
    fold = GroupFold(offsets, 30, 2)
    for row, (_, at, _, _, who, op, n, offset) in zip(found, commands, strict=True):
        want = fold.apply(at, who, op, n, offset)
        assert {k: row[k] for k in want} == want


def test_commits_without_members_overwrite_what_is_stored():
    """A group is active while a consumer holds a lease; otherwise commits go to the offset store alone."""
    g = GroupFold([1, 2, 7, 9, 12])
    assert g.apply(0, "a", "acquire", 3, None)["delivered_to"] == 8
    assert g.apply(1, "a", "commit", None, 5)["committed"] == 5
    assert g.apply(2, "a", "commit", None, 2)["committed"] == 2 and g.dispatch == 8
    g.apply(3, "b", "acquire", 1, None)
    assert g.apply(4, "b", "commit", None, 10)["committed"] == 2  # offsets 5 to 7 are still open
    empty = GroupFold([])
    assert empty.apply(0, "a", "acquire", 3, None)["committed"] == -1
    assert empty.apply(1, "a", "commit", None, 7)["committed"] == 7 and empty.dispatch == 0
    late = GroupFold([1, 5, 9])
    late.apply(0, "a", "commit", None, 5)
    assert late.apply(1, "a", "acquire", 1, None)["delivered_from"] == 5  # the first acquire starts from what is stored
    expired = GroupFold([1, 5, 9], lease_ms=10)
    expired.apply(0, "a", "acquire", 2, None)
    expired.apply(50, None, "expire", None, None)
    assert expired.apply(51, "a", "commit", None, 4)["committed"] == 4 and expired.dispatch == 0


class PlainFold(GroupFold):
    """Goes through all ranges and attempts at each command."""

    def _advance(self):
        at, left = self.committed, []
        for low, high in sorted(self.ranges):
            if not left and low <= at:
                at = max(at, high)
            else:
                left.append((low, high))
        if at > self.committed:
            self.committed = self.stored = at
        self.ranges = left

    def _forget(self, low, high):
        self.attempts = {o: n for o, n in self.attempts.items() if not low <= o < high}

    def _failed(self, offset):
        self.attempts = self.attempts | {offset: self.attempts.get(offset, 0) + 1}
        return self.attempts[offset] >= self.most


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from("ABC"), st.sampled_from(["acquire", "commit", "nack", "expire"]), st.integers(1, 4), st.integers(0, 60)), max_size=80), st.integers(1, 4))
def test_waiting_ranges_and_attempts_as_if_all_were_gone_through(steps, most):
    f, plain, at = GroupFold(list(range(0, 60, 3)), 5, most), PlainFold(list(range(0, 60, 3)), 5, most), 0
    for later, who, op, n, offset in steps:
        at += later
        assert f.apply(at, who, op, n, offset) == plain.apply(at, who, op, n, offset)
        f = GroupFold(f.offsets).restore(f.state())
        assert sorted(f.ranges) == sorted(plain.ranges) and f.attempts == plain.attempts


def test_a_command_costs_the_same_however_much_waits():
    import time

    f, began = GroupFold([0, *range(10, 200_000)], lease_ms=10**9, most=5), time.process_time()
    f.apply(0, "first", "acquire", 1, None)
    for k in range(40_000):
        to = f.apply(k, "A", "acquire", 2, None)["delivered_to"]
        f.apply(k, "A", "commit", None, to - 1)
        f.apply(k, "B", "nack", None, 200_000 + k)
    assert len(f.ranges) == 40_000 == len(f.attempts) and f.committed == 0
    assert time.process_time() - began < 10


def test_reach_of_great_acquires_ends_with_the_topic(spark):
    """An acquire may ask for any number, from many places: the spans are as long as the topic, and each chunk comes once."""
    commands = [(k, k, "g", "t", "A", "nack" if k % 2 else "acquire", None if k % 2 else 2**31 - 1, k if k % 2 else None) for k in range(2000)]
    df = spark.createDataFrame(commands, "seq long, at_ms long, group string, topic string, consumer string, op string, n int, offset long")
    found = groups.reachable_offsets(df, spark.createDataFrame([("t", o) for o in range(3000)], "topic string, offset long")).collect()
    assert sorted(o for r in found for o in r.offsets) == list(range(3000))


def test_reachable_chunks_hold_what_a_group_can_reach_once(spark):
    import random

    r = random.Random(6)
    offsets = {t: sorted(r.sample(range(4000), 700)) for t in "tu"}
    commands = [(k, k, g, t, "A", op, n, o) for k, (g, t, op, n, o) in enumerate([
        ("g", "t", "commit", None, 900), ("g", "t", "acquire", 20, None), ("g", "t", "commit", None, 2000), ("g", "t", "nack", None, 2500), ("g", "t", "nack", None, 2503), ("g", "t", "nack", None, 3999),
        ("h", "t", "commit", None, 3000), ("h", "u", "acquire", 7, None), ("h", "u", "nack", None, -5), ("h", "u", "acquire", -3, None), ("h", "v", "acquire", 5, None),
    ])]
    df = spark.createDataFrame(commands, "seq long, at_ms long, group string, topic string, consumer string, op string, n int, offset long")
    messages = spark.createDataFrame([(t, o) for t in offsets for o in offsets[t]], "topic string, offset long")
    found = {}
    for row in groups.reachable_offsets(df, messages, width=16).collect():
        found.setdefault((row.group, row.topic), []).extend(row.offsets)
    wanted = {("g", "t"): ([0, 900, 2500, 2503, 3999], 20), ("h", "t"): ([0, 3000], 0), ("h", "u"): ([0], 7)}
    assert found.keys() == wanted.keys()
    for key, (starts, takes) in wanted.items():
        reached = {o for s in starts for o in [o for o in offsets[key[1]] if o >= s][:takes]}
        assert reached <= set(found[key]) <= set(offsets[key[1]]) and len(found[key]) == len(set(found[key])) < 300


def test_stream_keeps_its_state_from_batch_to_batch(spark, tmp_path):
    from millrace.streaming import streams

    commands = [(k, k * 10, "g", "t", "AB"[k % 2], ["acquire", "commit", "nack", "expire", "acquire"][k % 5], 3, k) for k in range(60)]
    df = spark.createDataFrame(commands, "seq long, at_ms long, group string, topic string, consumer string, op string, n int, offset long")
    rows = groups.with_reachable(df, spark.createDataFrame([("t", o) for o in range(0, 90, 2)], "topic string, offset long")).cache()
    for part in ("offsets is not null", "seq < 25 and offsets is null", "seq >= 25 and offsets is null"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streams.replay_stream(stream, lease_ms=100, most=2, batch=7)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    fold = GroupFold(list(range(0, 90, 2)), 100, 2)
    found = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    for row, (_, at, _, _, who, op, n, offset) in zip(found, commands, strict=True):
        want = fold.apply(at, who, op, n, offset)
        assert {k: row[k] for k in want} == want
