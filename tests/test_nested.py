import json
import random

from gaugeframe.operators.nested import nested_differences


def walk(a, b, path=""):
    """Brute force on parsed records."""
    absent = object()
    if type(a) is type(b) and isinstance(a, (dict, list)):
        names = sorted({*a, *b}) if isinstance(a, dict) else range(max(len(a), len(b)))
        get = (lambda x, n: x.get(n, absent)) if isinstance(a, dict) else (lambda x, n: x[n] if n < len(x) else absent)
        for n in names:
            x, y, at = get(a, n), get(b, n), path + "/" + str(n).replace("~", "~0").replace("/", "~1")
            if x is absent or y is absent:
                yield at, "added" if x is absent else "removed"
            else:
                yield from walk(x, y, at)
    elif type(a) is not type(b):
        yield path, "type"
    elif a != b:
        yield path, "changed"


def record(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < .45:
        return {rng.choice(["a", "b", "c/d", "e~f", "0"]): record(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if depth < 4 and kind < .6:
        return [record(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 2, "x", "1", True, None])


def test_differences_equal_brute_force(spark):
    rng = random.Random(5)
    left = {i: {"top": record(rng), "rest": record(rng)} for i in range(120)}
    right = {i: ({**r, "rest": record(rng)} if i % 3 else r) for i, r in left.items() if i % 10}
    right[500] = {"top": 1}
    frames = [spark.createDataFrame([(i, json.dumps(r), "extra") for i, r in side.items()], "id int, body string, declared string") for side in (left, right)]
    got = sorted((r["id"], r["path"], r["reason"]) for r in nested_differences(*frames, "id", "body").collect())
    want = [(i, "", "removed") for i in left if i not in right] + [(500, "", "added")]
    want += [(i, *d) for i in left if i in right for d in walk(left[i], right[i])]
    assert got == sorted(want) and {r for *_, r in got} == {"added", "removed", "changed", "type"}


def test_empty_and_null_records(spark):
    schema = "id int, body string"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, None), (2, "null"), (3, "{}")], schema)
    assert nested_differences(none, none, "id", "body").count() == 0
    assert [(r["id"], r["reason"]) for r in nested_differences(none, one, "id", "body").orderBy("id").collect()] == [(2, "added"), (3, "added")]
    other = spark.createDataFrame([(1, None), (2, "null"), (3, "[]")], schema)
    assert [tuple(r) for r in nested_differences(one, other, "id", "body").collect()] == [(3, "", "{}", "[]", "type")]
