"""Entries of JSON objects whose borders fall anywhere, against one pass of the standard reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.sources import json_objects


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, False, 0, -1.5, 12345, 1e-7])
    if kind in (1, 2, 3):
        return "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "日", " ", "\n", "\\\\", '\\"', "embedding_dict"], k=rng.randint(0, 12)))
    if kind == 4:
        return [rng.random() for _ in range(rng.randint(0, 30))]
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{i}{rng.choice(['', chr(34), chr(92), ',', '{'])}": value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(old, (str(n), "1"))]
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(found):
    return sorted((r["key"], json.dumps(json.loads(r["value"]), sort_keys=True)) for r in found.collect())


@pytest.mark.parametrize("size", [61, 500])
def test_entries_of_objects(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    small_splits(size)
    for k in range(2):
        inner = {f"id{i}{rng.choice(['', chr(34), ' é'])}": value(rng) for i in range(12)}
        whole = {"first": value(rng), "note": "embedding_dict", "embedding_dict": inner, "other": {"embedding_dict": {"no": 1}, "x": [1, 2]}, "last": value(rng)}
        text = json.dumps(whole, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        path = tmp_path / f"{k}.json"
        path.write_text(text, encoding="utf-8")
        want = lambda d: sorted((key, json.dumps(v, sort_keys=True)) for key, v in d.items())
        assert rows(json_objects.entries(spark, str(path))) == want(whole)
        assert rows(json_objects.entries(spark, str(path), "embedding_dict")) == want(inner)
        assert rows(json_objects.entries(spark, str(path), "nowhere")) == []


def test_several_files_and_empty_objects(spark, tmp_path, small_splits):
    small_splits(20)
    for name, text in (("a", "{}"), ("b", ' { "x" : 1 , "y":"" }\n'), ("c", '{"x":{}}'), ("d", '{"x":[{"q":"}"}],"x":2}')):
        (tmp_path / f"{name}.json").write_text(text)
    found = json_objects.entries(spark, str(tmp_path)).withColumn("f", F.regexp_extract("file", r"([a-d])\.json$", 1))
    assert sorted((r["f"], r["key"], r["value"]) for r in found.collect()) == [("b", "x", "1"), ("b", "y", '""'), ("c", "x", "{}"), ("d", "x", "2"), ("d", "x", '[{"q":"}"}]')]


def test_many_tasks_read_one_large_object(spark, tmp_path, small_splits):
    small_splits(1 << 20)
    path = tmp_path / "large.json"
    with path.open("w") as f:
        f.write('{"embedding_dict": {')
        for i in range(4000):
            f.write(("," if i else "") + json.dumps(f"id {i}") + ":" + json.dumps([i, *([0.5] * 300)]))
        f.write("}}")
    found = json_objects.entries(spark, str(path), "embedding_dict")
    assert json_objects._fragments(spark, str(path)).select("split").distinct().count() >= 5
    got = found.select("key", F.from_json("value", "array<double>").alias("v")).select("key", F.size("v").alias("n"), F.get("v", 0).alias("first")).collect()
    assert sorted((r["key"], r["n"], r["first"]) for r in got) == sorted((f"id {i}", 301, float(i)) for i in range(4000))
