"""Snapshot tables (concurrent and killed writes), JSONL files with rejects, prompt joins with
hot keys, line bitmaps."""

import json
import os
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from testsieve.operators import filters as FL
from testsieve.operators import joins as J
from testsieve.operators import outcomes as O
from testsieve.sources import readers as R
from testsieve.sources import sinks as K


def table(spark, rows):
    return spark.createDataFrame(rows, "dataset string, llm string, v int")


def content(spark, path, **only):
    return sorted(tuple(r) for r in K.read_snapshot(spark, path, **only).collect())


def test_a_rerun_replaces_its_partitions_and_older_plans_keep_theirs(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert K.read_snapshot(spark, path, StructType.fromDDL("v int")).count() == 0
    K.write_snapshot(table(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, "x", 4)]), path)
    before = K.read_snapshot(spark, path)
    K.write_snapshot(table(spark, [("a", "x", 10), ("c", "z z/=", 11)]), path)
    assert content(spark, path, dataset="a") == [("a", "x", 10), ("a", "y", 2)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in K.read_snapshot(spark, path).collect()), key=key) == sorted(
        [("a", "x", 10), ("a", "y", 2), ("b", "x", 3), ("c", "z z/=", 11), (None, "x", 4)], key=key)
    assert before.where("dataset = 'a' and llm = 'x'").collect()[0].v == 1  # made before the rerun
    assert K.read_snapshot(spark, path).dtypes == [("dataset", "string"), ("llm", "string"), ("v", "int")]
    assert K.vacuum(spark, path) == 0  # both writes still hold a partition
    K.write_snapshot(table(spark, [("a", "x", 20), ("c", "z z/=", 21)]), path)
    assert K.vacuum(spark, path) == 1 and content(spark, path, dataset="a") == [("a", "x", 20), ("a", "y", 2)]


def test_killed_writes_leave_a_readable_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    K.write_snapshot(table(spark, [("a", "x", 1)]), path)
    table(spark, [("a", "x", 2)]).write.partitionBy("dataset", "llm").parquet(f"{path}/data/killed-before-its-commit")
    (tmp_path / "t" / "_manifests" / "000000000002.json").write_text('{"partition_by": ["dataset"')  # killed in its commit
    assert content(spark, path) == [("a", "x", 1)]
    K.write_snapshot(table(spark, [("b", "x", 3)]), path)
    assert content(spark, path) == [("a", "x", 1), ("b", "x", 3)]


def test_concurrent_writes_are_all_there(spark, tmp_path):
    path = f"{tmp_path}/t"
    threads = [threading.Thread(target=K.write_snapshot, args=(table(spark, [(f"d{i}", "x", i), ("same", "x", i)]), path)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = content(spark, path)
    assert [r for r in got if r[0] != "same"] == [(f"d{i}", "x", i) for i in range(6)]
    assert len([r for r in got if r[0] == "same"]) == 1


def test_jsonl_files_in_order_with_rejects(spark, tmp_path):
    folder = tmp_path / "tasks"
    folder.mkdir()
    records, bad = [], []
    rng = random.Random(2)
    for name, n in (("a.jsonl", 1), ("b.jsonl", 700), ("c.jsonl", 40), ("d.jsonl", 0)):
        lines = []
        for i in range(n):
            r = {"task_id": f"t{rng.randint(0, 60)}", "v": len(records)}
            records.append(r)
            lines.append(json.dumps(r))
            if rng.random() < 0.1:
                bad.append(rng.choice(['{"task_id": "t1", "v"', "no json", '{"task_id": "t2", "v": "x"}', "[1"]))
                lines.append(bad[-1])
            if rng.random() < 0.1:
                lines.append("  ")
        (folder / name).write_text("\n".join(lines))
    good, rejects = R.scan_jsonl_tasks(spark, str(folder), StructType.fromDDL("task_id string, v int"))
    assert {r.task_id: r.v for r in good.collect()} == {r["task_id"]: r["v"] for r in records}
    assert Counter(r.value for r in rejects.collect()) == Counter(bad)


def test_problems_and_generated_code_from_files(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    one = {"id": "7", "function_name": "f", "public_test_cases": [{"input": " 1 ", "output": "2"}, {"input": "3"}]}
    p.write_text("\n".join([json.dumps({**one, "function_name": "old"}), "{broken", json.dumps(one)]))
    assert [tuple(r) for r in R.scan_problems(spark, str(p)).collect()] == [("7", "f", 0, "1", "2")]
    g = tmp_path / "g.jsonl"
    g.write_text("\n".join([json.dumps({"task_id": "1", "response_code": "a"}), "?", json.dumps({"task_id": "1", "response": "x ```python\nb\n``` y"})]))
    assert [tuple(r) for r in R.scan_generated_code(spark, str(g)).collect()] == [("1", "b")]


@pytest.mark.parametrize("apart", [1, 10**12])
def test_written_lines_are_in_files_of_bounded_size(spark, tmp_path, monkeypatch, apart):
    from testsieve.plans import q_sources as Q

    monkeypatch.setattr(Q, "FILE_BYTES", 20_000, raising=False)
    ids = [None, None, *(10**15 + i * apart for i in range(4000))]
    rows = [(i, json.dumps({"task_id": f"t{k % 7}", "v": k, "text": "x" * (k % 90)})) for k, i in enumerate(ids)]
    random.Random(4).shuffle(rows)
    path = Q._jsonl(spark, "lines", spark.createDataFrame(rows, "doc_id long, value string").repartition(5), "doc_id")
    files = sorted(os.listdir(path.removeprefix("file:")))
    files = [f"{path.removeprefix('file:')}/{f}" for f in files if f.startswith("part-")]
    sizes = [os.path.getsize(f) for f in files]
    assert max(sizes) < 30_000 and len(set(sizes)) > 5
    read = [json.loads(x)["v"] for f in files for x in open(f) if x.endswith("}\n")]
    assert sorted(read[:2]) == [0, 1] and read[2:] == list(range(2, len(ids)))  # rows without id come first
    good, bad = R.scan_jsonl_tasks(spark, path, StructType.fromDDL("task_id string, v int"))
    assert {r.task_id: r.v for r in good.collect()} == {f"t{k % 7}": k for k in range(len(ids))}
    assert bad.count() == sum(i % 50 == 7 for i in ids if i is not None)


def test_generated_code_is_read_from_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from testsieve import session
    from testsieve.plans import q_sources as Q

    monkeypatch.setattr(Q, "FILE_BYTES", 20_000, raising=False)
    ids = [None, *range(1000, 1600)]
    docs = [(i, f"w{k} text" if k % 5 else f"w{k} ```\nfenced {k}\n```") for k, i in enumerate(ids)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = session.mark()
    got = {r.task_id: r.code for r in Q.q_scan_generated_code(spark, str(tmp_path)).collect()}
    (path,) = session.made(before)
    sizes = [os.path.getsize(f"{path.removeprefix('file:')}/{f}") for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
    assert max(sizes) < 30_000 and sum(sizes) > 150_000
    want = {}
    for k, i in enumerate(ids):
        if i is not None and (i % 3 or i % 4 == 1 or k % 5 == 0):
            want[f"t{i % 40}"] = f"fenced {k}" if i % 3 == 0 and i % 4 != 1 else "class Helper"
    assert set(got) == set(want) and all(got[t].startswith(want[t]) for t in want)


@pytest.mark.parametrize("table", ["long texts last", "one id", "no id", "neighbours of one double"])
def test_generated_code_files_are_bounded_in_bytes(spark, tmp_path, monkeypatch, table):
    from testsieve import session
    from testsieve.plans import q_sources as Q

    monkeypatch.setattr(Q, "FILE_BYTES", 20_000, raising=False)
    n = 1200
    ids = {"long texts last": range(n), "one id": [601 if 300 <= k < 900 else k for k in range(n)],
           "no id": [None if k < 500 else k for k in range(n)], "neighbours of one double": [2**60 + k for k in range(n)]}[table]
    # the text of an id depends on the id alone, so whichever of its rows comes last
    word = lambda i: "w" + "".join(chr(97 + int(x)) for x in str(i or 0))
    docs = [(i, word(i) + " text" * (1000 if table == "long texts last" and i >= 1140 else 0)) for i in ids]
    spark.createDataFrame(random.Random(3).sample(docs, n), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    before = session.mark()
    got = {r.task_id: r.code for r in Q.q_scan_generated_code(spark, str(tmp_path)).collect()}
    folder = session.made(before)[0].removeprefix("file:")
    files = [f"{folder}/{f}" for f in sorted(os.listdir(folder)) if f.startswith("part-")]
    if table != "neighbours of one double":  # those may share a file, and keep their order
        assert max(map(os.path.getsize, files)) < 50_000
    lines = [json.loads(x) for f in files for x in open(f) if x.endswith("}\n")]
    assert Counter(r.get("task_id") for r in lines) == Counter(None if i is None else f"t{i % 40}" for i in ids)
    tasks = [r["task_id"] for r in lines if "task_id" in r]
    assert tasks == [f"t{i % 40}" for i in sorted(i for i in ids if i is not None)]
    want = {f"t{i % 40}": i for i in sorted(i for i in ids if i is not None) if i % 3 or i % 4 == 1}
    assert set(got) == set(want) and all(f'"""{word(want[t])} docs' in c for t, c in got.items())


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_few_lines_are_written_and_read(spark, rows):
    from testsieve.plans import q_sources as Q

    path = Q._jsonl(spark, "lines", spark.createDataFrame([(None if i == 2 else i, json.dumps({"task_id": str(i)})) for i in range(rows)],
                                                         "doc_id long, value string"), "doc_id")
    assert sorted(r.task_id for r in R.scan_jsonl_tasks(spark, path, StructType.fromDDL("task_id string"))[0].collect()) == [str(i) for i in range(rows)]


@pytest.fixture
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_hot_prompt_spreads(spark, many_partitions):
    prompt = F.when(F.col("id") % 3 == 0, F.lit("hot " * 50)).otherwise(F.concat(F.lit("prompt "), (F.col("id") % 500).cast("string")))
    sols = spark.range(6000).select("id", prompt.alias("prompt"))
    bench = sols.select(F.col("id").alias("task_id"), "prompt", F.col("id").alias("line_no"))
    got = J.spread_join(sols.withColumn("_key", J.text_key("prompt")), J.last_per_prompt(bench, "prompt", "task_id", "line_no"), "_key", hot_rows=100)
    sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 6000 and max(r["count"] for r in sizes) < 1200  # 2000 rows have one prompt
    want = {r.prompt: r.m for r in bench.groupBy("prompt").agg(F.max("task_id").alias("m")).collect()}
    assert all(r.task_id == want[r.prompt] for r in got.collect())
    plan = J.join_prompt_last(sols, bench)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(prompt" not in plan and "hashpartitioning(_key" in plan


def test_prompt_joins(spark):
    functions = spark.createDataFrame([(1, "p"), (2, "q"), (3, None), (4, "z")], "id int, prompt string")
    scored = spark.createDataFrame([(10, "p"), (11, "p"), (12, "q"), (13, None)], "function_id int, prompt string")
    tests = spark.createDataFrame([(10, "old"), (11, "a"), (11, "b"), (13, "n")], "function_id int, test string")
    got = sorted((r.id, r.last_function_id, r.test) for r in J.join_scores_last(functions, scored, tests).collect())
    assert sorted(got, key=str) == sorted([(1, 11, "a"), (1, 11, "b"), (2, 12, None), (3, None, None), (4, None, None)], key=str)
    with pytest.raises(Exception, match="prompt not found"):
        J.join_prompt_last(functions, scored.select(F.col("function_id").alias("task_id"), "prompt", F.col("function_id").alias("line_no"))).collect()
    valid = spark.createDataFrame([(10, 0, "t0", 1), (10, 1, "t1", 0), (12, 0, "u", 0)], "function_id int, test_idx int, text string, prediction_is_valid int")
    rows = FL.validity_filter_by_prediction(functions.select("prompt"), scored, valid).collect()
    assert sorted(((r.prompt, r.test) for r in rows), key=str) == sorted([("p", "t0"), ("q", None), (None, "No Tests"), ("z", "No Tests")], key=str)


def test_line_coverage_by_bitmaps(spark):
    rng = random.Random(5)
    hits = [(rng.randint(0, 3), rng.randint(0, 4), rng.choice([rng.randint(0, 5), rng.randint(0, 5000), -7, 63, 64])) for _ in range(5000)]
    hits += [(9, 0, i % 700) for i in range(5000)]  # one function of many hits
    tests = [(f, t, int((f + t) % 3 == 0)) for f in [*range(5), 9] for t in range(5)]
    got = O.line_coverage(spark.createDataFrame(hits, "function_id int, test_idx int, line_no int"), spark.createDataFrame(tests, "function_id int, test_idx int, is_valid int"),
                          spark.createDataFrame([(f, 6000) for f in [*range(6), 9]], "function_id int, total_lines int"))
    ok = {(f, t) for f, t, v in tests if v}
    want = {f: len({n for a, t, n in hits if a == f and (a, t) in ok}) for f in [*range(6), 9]}
    assert {r.function_id: r.covered for r in got.collect()} == want


def test_release_deletes_stage_tables_but_those_to_keep(spark, tmp_path):
    from testsieve import session

    at = session.mark()
    first = session.stored(spark.range(5), "first")
    kept = session.stored(first, "kept")
    path = kept.inputFiles()[0].split("/part-")[0].removeprefix("file://").removeprefix("file:")
    name = next(p for p in session._made[at:] if p.endswith(path.rsplit("/", 1)[1]))
    assert session.release(spark, at, keep=(name,)) == 1
    assert kept.count() == 5 and session._made[at:] == [name]
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        first.count()
    assert session.release(spark, at) == 1
