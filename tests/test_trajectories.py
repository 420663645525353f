"""A literal bad row for each rule."""

import copy

import pytest

from scholia.operators import trajectories as T


def state(step, position=0, completed=False):
    return {"mastery": [0.5] * 6, "engagement": 0.5, "fatigue": 0.5, "misconception": [0.5] * 6, "position": position, "profile": 1, "assessment": 0.5, "step": step, "completed": completed}


def move(step, index, position, after, ended=False):
    return {
        "state": state(step, position), "next_state": state(step + 1, after, ended), "action": {"index": index, "macro": T.MACROS[index // 9], "difficulty": T.DIFFICULTIES[index % 9 // 3], "style": T.STYLES[index % 3]},
        "reward": 0.5, "terminated": ended, "truncated": False, "done": ended, "successful": True, "valid_actions": [0, 4, 10, 20, 26], "next_valid_actions": [] if ended else [1], "target_course": T.COURSES[after],
    }


def good(name):
    return {"trajectory_id": name, "profile": 1, "transitions": [move(0, 0, 4, 5), move(1, 10, 5, 5), move(2, 20, 5, 5), move(3, 4, 5, 5, True)]}


def changed(name, edit):
    row = copy.deepcopy(good(name))
    edit(row, row["transitions"])
    return row


def at(i, **new):
    return lambda row, ts: ts[i].update(new)


def inside(i, part, **new):
    return lambda row, ts: ts[i][part].update(new)


BAD = [
    ("empty", lambda r, t: t.clear()), ("empty", lambda r, t: r.update(transitions=None)), ("state", inside(0, "state", fatigue=1.5)), ("state", inside(0, "state", mastery=[0.5])), ("state", inside(1, "next_state", engagement=None)), ("state", inside(0, "state", completed=True)), ("state", inside(0, "state", position=6)),
    ("action", inside(0, "action", index=27)), ("action", inside(0, "action", style="strict")), ("flags", at(0, successful=None)), ("flags", at(3, truncated=True)), ("flags", at(0, done=True)), ("step", inside(0, "next_state", step=3)), ("step", inside(2, "next_state", profile=2)),
    ("progress", inside(0, "next_state", position=4)), ("progress", lambda r, t: (t[3].update(terminated=False, done=False), t[3]["next_state"].update(completed=False))), ("progress", lambda r, t: t[0].update(truncated=True, done=True, next_valid_actions=[])), ("target", at(0, target_course="concepts")), ("target", at(2, target_course="nowhere")), ("masks", at(0, valid_actions=[4, 0])), ("masks", at(3, next_valid_actions=[1])), ("masks", at(0, valid_actions=None)),
    ("reward", at(0, valid_actions=[1])), ("reward", at(0, reward=1.5)), ("reward", at(0, reward=float("nan"))), ("joined", inside(1, "state", engagement=0.25)), ("start", lambda r, t: t.pop(0)), ("end", lambda r, t: t.pop()), ("profile", lambda r, t: r.update(profile=0)), ("state", lambda r, t: t.__setitem__(1, None)),
]


def test_every_rule(spark, tmp_path):
    rows = [changed(f"{i:02d}", edit) for i, (_, edit) in enumerate(BAD)]
    rows += [good("twice"), good("twice"), good(None), good("a"), changed("b", lambda r, t: t[1].update(target_course="concepts")), changed("c", lambda r, t: r.update(transitions=t))]
    df = spark.createDataFrame(rows, T.TRAJECTORY).repartition(3)
    found = {}
    for r in T.checked(df).collect():
        found.setdefault(r.trajectory_id, []).append(r.problem)
    assert found == {f"{i:02d}": [name] for i, (name, _) in enumerate(BAD)} | {"twice": ["id", "id"], None: ["id"], "a": [None], "b": [None], "c": [None]}
    kept = T.accepted(df, str(tmp_path / "out"), {"num_trajectories": 3, "num_transitions": 12})
    assert kept.columns == df.columns and sorted(r.trajectory_id for r in kept.collect()) == ["a", "b", "c"]
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'refused'").count() == len(BAD) + 3
    with pytest.raises(ValueError, match="manifest"):
        T.accepted(df, str(tmp_path / "other"), {"num_trajectories": 4, "num_transitions": 12})
    assert T.checked(df.limit(0)).count() == 0
