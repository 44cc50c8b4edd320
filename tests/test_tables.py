"""Sources, sinks, CRUD, scalars, streaming and the driver contract."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from weft.functions import scalars
from weft.operators import crud
from weft.plans import tables
from weft.plans.row_index import ordered_index
from weft.sources import files
from weft.streaming import log_tail


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


def test_learn_sets(spark, tmp_path):
    write(tmp_path / "b.csv", "﻿sequence,fitness\r\nACD,1.5\r\nEFG,2\r\n\r\n")
    write(tmp_path / "a.csv", "sequence,fitness\nAAA\t3\nCCC,4.25\n")
    write(tmp_path / "none.csv", "sequence,fitness\n")
    d = files.learn_set(spark, str(tmp_path))
    got = sorted(tuple(r) for r in d.collect())
    assert got == [("a", 0, "AAA\t3", None), ("a", 1, "CCC", 4.25), ("b", 0, "ACD", 1.5), ("b", 1, "EFG", 2.0)]
    assert files.malformed(d).count() == 1
    assert files.files(spark, str(tmp_path), "*.csv") == ["a.csv", "b.csv", "none.csv"]


def test_models(spark, tmp_path):
    write(tmp_path / "m.csv", ",pattern,weight,status\n0,ACD,1.5,1\n1,NA,2,0\n2,,3,1\n3,K,4,0\n")
    write(tmp_path / "n.csv", ",pattern,weight\n0,W,1\n1,Y,2\n")
    d = files.models(spark, str(tmp_path)).orderBy("file", "rule_idx").collect()
    assert [(r.model_id, r.rule_idx, r.pattern, r.weight, r.status) for r in d] == [
        ("m", 0, "ACD", 1.5, 1), ("m", 1, None, 2.0, 0), ("m", 2, None, 3.0, 1), ("n", 0, "W", 1.0, 0)]
    whole = files.models(spark, str(tmp_path), drop_last=False, na_is_null=False)
    assert whole.count() == 6 and whole.where("pattern = 'NA'").count() == 1


def test_log_and_lines(spark, tmp_path):
    head = "generation, best fitness, best test, a, b, c, d, e\n"
    write(tmp_path / "run.csv", head + "0,1.5,2.5,10,4,3.5,4.5,11,5\n1,1.0,2.0,10,4,3.0,4.0,11,5\n")
    r = files.evolution_log(spark, str(tmp_path)).orderBy("generation").first()
    assert (r.generation, r.best_fitness, r.best_rule_count, r.avg_used_rule_count) == (0, 1.5, 10, 5.0)
    assert [x.line_no for x in files.lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [0, 1, 2]
    write(tmp_path / "dim.txt", "key,code\nA,1.8\nC,x\n")
    assert [tuple(x) for x in files.pairs(spark, str(tmp_path / "dim.txt"), "double").orderBy("key").collect()] == [("A", 1.8), ("C", None)]


def test_lines_over_splits(spark, tmp_path):
    """A file that is read in many splits keeps its line numbers; quoted cells keep commas and quotes."""
    write(tmp_path / "long.txt", "﻿" + "".join(f"line {k} {'x' * (k % 37)}\r\n" for k in range(4000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = files.lines(spark, str(tmp_path / "long.txt"))
        assert {r.line_no: r.line for r in got.collect()} == {k: f"line {k} {'x' * (k % 37)}" for k in range(4000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    write(tmp_path / "q.csv", 'weight,note,"pattern"\n1.5,"a, ""b""",ACD\n2,,"E"\n')
    got = files.models(spark, str(tmp_path), "q.csv", drop_last=False).orderBy("rule_idx").collect()
    assert [(r.pattern, r.weight, r.status) for r in got] == [("ACD", 1.5, 0), ("E", 2.0, 0)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "b", 2.0), (0, "a", 1.0)], "row_idx int, sequence string, fitness double")
    files.result_table(d, str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "t"), header=True).collect()] == [("a", "1.0"), ("b", "2.0")]
    files.append(d, str(tmp_path / "log"))
    files.append(d, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 4
    files.truncate(spark, str(tmp_path / "log"), "a int")
    assert spark.read.schema("a int").csv(str(tmp_path / "log"), header=True).count() == 0
    assert set(files.setup(str(tmp_path / "o"))) == {"output", "archive"}


def test_config():
    c = files.parse_config("a = 1 # one\n\n;b = x=y\n# all\nseed = 110\n")
    assert c == {"a": "1", ";b": "x=y", "seed": "110"}
    with pytest.raises(ValueError, match="line 2"):
        files.parse_config("a = 1\nnothing\n")
    assert files.options(["-seed", "7", "-r", "3"], c)["seed"] == "7"


def test_crud(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "id long, name string, v double")
    more = spark.createDataFrame([("2", "x"), ("3", "y")], "id string, name string")
    assert crud.insert(d, more).count() == 4
    assert {r.id for r in crud.insert_unique_by(d, more.withColumn("id", F.col("id").cast("long")), "id").collect()} == {1, 2, 3}
    assert crud.insert_unique(d, more).count() == 2 and crud.insert_unique(d.limit(0), more).count() == 2
    assert crud.insert_unique(d, more, F.col("name") == "z").count() == 4
    up = {r.id: r.name for r in crud.update(d, {"name": F.lit("z")}, F.col("v") > 0).collect()}
    assert up == {1: "z", 2: "b"}
    assert [r.id for r in crud.delete(d, F.col("v") > 0).collect()] == [2]
    assert crud.row_exists(d, F.col("id") == 1) and not crud.row_exists(d, F.col("id") == 9)
    assert crud.select_one(d, F.col("id") > 0).count() == 1 and crud.select_all(d).count() == 2
    assert crud.table_info(d)[0] == ("id", "bigint")


def test_migration_and_catalog(spark):
    name, spec = crud.blueprint(json.dumps({"name": "db", "things": {"name": "TEXT", "size": "REAL"}}))
    assert name == "db" and spec == {"things": {"id": "bigint", "name": "string", "size": "double"}}
    d = spark.createDataFrame([("a", 1)], "name string, extra int")
    m = crud.migrate(d, spec["things"])
    assert m.columns == ["id", "name", "size"] and tuple(m.first()) == (None, "a", None)
    crud.create_table(spark, "things_test", spec["things"])
    crud.create_table(spark, "things_test", spec["things"])
    assert crud.table_exists(spark, "things_test") and "things_test" in crud.tables(spark)
    spark.sql("DROP TABLE things_test")


def test_scalars(spark):
    d = spark.createDataFrame([("March", "abc", "10:00:00", "10:01:30")], "m string, t string, a string, b string")
    one = lambda c: d.select(c).first()[0]
    assert one(scalars.month_number("m")) == "03"
    with pytest.raises(Exception, match="not a month"):
        one(scalars.month_number("t"))
    assert one(scalars.time_between("a", "b")) == datetime.timedelta(seconds=90)
    assert one(scalars.insert_at("t", F.lit(1), F.lit("X"))) == "aXbc"
    assert one(scalars.delete_at("t", F.lit(1))) == "ac"
    assert one(scalars.replace_at("t", F.lit(2), F.lit("X"))) == "abX"
    assert one(scalars.strip(F.lit("  x \n"))) == "x"
    assert [one(scalars.round_even(F.lit(x), 0)) for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]
    assert one(scalars.is_date(F.lit("2020-02-30"), "yyyy-MM-dd")) is False and one(scalars.is_date(F.lit("2020-02-29"), "yyyy-MM-dd"))
    assert [one(scalars.is_yes_no(F.lit(v), r)) for v, r in (("y", True), ("q", True), ("", False), ("y", False))] == [True, False, True, False]
    assert [one(scalars.is_number(F.lit(v), r)) for v, r in (("12", True), ("1.2", True), ("12", False))] == [True, False, False]
    assert [one(scalars.is_text(F.lit(v), r)) for v, r in (("ab", True), ("a", True), ("", False))] == [True, None, True]
    assert one(scalars.is_numeric(F.lit("0a"))) is False and len(one(scalars.time_of_day())) == 8
    assert one(scalars.date_label(F.lit("2022-05-22").cast("timestamp"))) == "May-22-2022"


def test_ordered_index(spark):
    d = spark.createDataFrame([(w,) for w in "pear apple fig plum peach apricot date".split()], "w string")
    got = {r.w: r.row_idx for r in ordered_index(d, "w").collect()}
    assert [w for w, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got) and sorted(got.values()) == list(range(7))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "{}: -b {} -bt 1.0 -rc 3 -urc 2 ||| -a 1.0 -at 1.0 -arc 3.0 -aurc 2.0\n"
    write(tmp_path / "in" / "run1", "".join(line.format(g, 9.0 - g) for g in range(3)) + "noise\n")
    q = log_tail.start(spark, str(tmp_path / "in"), "progress_test", str(tmp_path / "cp"))
    q.processAllAvailable()
    write(tmp_path / "in" / "run2", line.format(0, 4.0))
    q.processAllAvailable()
    q.stop()
    got = {(r.file, r.generation, r.best_fitness) for r in spark.table("progress_test").collect()}
    assert got == {("run1", 2, 7.0), ("run2", 0, 4.0)}


def test_contract(spark, monkeypatch):
    import builtins

    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and "score_models" in q
    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("weft.llm") or (name == "weft" and "llm" in (fromlist or ())):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", without)
    assert "score_models" in e.queries() and not any(k.startswith("op") for k in e.queries())


def test_write_back_touches_only_changed_partitions(spark, tmp_path):
    at = tmp_path / "t"
    rows = [(k, "abc"[k % 3] if k % 7 else None, float(k)) for k in range(60)]
    spark.createDataFrame(rows, "k int, p string, v double").repartition(2).write.partitionBy("p").parquet(str(at))
    names = lambda: {p: sorted(x.name for x in (at / p).glob("*.parquet")) for p in sorted(x.name for x in at.glob("p=*"))}
    back = lambda: sorted((r.k, r.p, r.v) for r in spark.read.parquet(str(at)).collect())
    before = names()
    crud.update_files(spark, str(at), {"v": F.col("v") + 100}, (F.col("p") == "a") & (F.col("k") > 30), ("p",))
    rows = [(k, p, v + 100 if p == "a" and k > 30 else v) for k, p, v in rows]
    assert sorted(back(), key=str) == sorted(rows, key=str)
    after = names()
    assert {p for p in before if before[p] != after[p]} == {"p=a"}
    crud.delete_files(spark, str(at), F.col("p").isNull() | ((F.col("p") == "b") & (F.col("k") < 9)), ("p",))
    rows = [r for r in rows if not (r[1] is None or (r[1] == "b" and r[0] < 9))]
    assert sorted(back(), key=str) == sorted(rows, key=str)
    last = names()
    assert sorted(last) == ["p=a", "p=b", "p=c"] and last["p=a"] == after["p=a"] and last["p=c"] == before["p=c"]
    crud.delete_files(spark, str(at), F.col("v") < 0, ("p",))
    assert names() == last
    with pytest.raises(ValueError):
        crud.update_files(spark, str(at), {"p": F.lit("z")}, F.lit(True), ("p",))


def test_cells_of_any_number_and_length(spark):
    lines = {
        "a,b": ["a", "b"], "": [""], ",": ["", ""], '"a,b", "c ""d"" e" ,f': ["a,b", 'c "d" e', "f"], 'x"y,z': ['x"y', "z"],
        ",".join(['"q,r"'] * 16_000): ["q,r"] * 16_000, '"' + 'w""' * 50_000 + '",z': ['w"' * 50_000, "z"], "p," + "v" * 200_000: ["p", "v" * 200_000],
    }
    d = spark.createDataFrame([(k,) for k in lines], "line string")
    for r in d.select("line", files._cells("line").alias("c")).collect():
        assert r.c == lines[r.line], r.line[:40]


@pytest.mark.parametrize("most", [1, 40, 32 << 20])
def test_sequences_are_counted_in_tasks(spark, tmp_path, monkeypatch, most):
    """No word of a text becomes a row of Spark's; partial counts of any number of bytes add up to those of all texts."""
    monkeypatch.setattr(tables, "COUNTED_BYTES", most, raising=False)
    texts = [
        None, "", " ", "box", "OX jub zoo", "Straße naïve ſK Kelvin ı İ", "acd,ACD\tacd\n\x00acd\u2028Acd", "a1c_d@e[f`g{h", "ABJOUXZC aBc", "é", "𝒜cd", "acd " * 500,
    ]
    spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = tables.sequences(spark, str(tmp_path))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    n = {}
    for t in texts:
        for w in re.split("[^A-Za-z]+", t or ""):
            w = re.sub("[BJOUXZ]", "", w.upper())
            if w:
                n[w] = n.get(w, 0) + 1
    assert sorted(tuple(r) for r in got.collect()) == sorted((w, w, (k * 7 + len(w)) % 400 / 16) for w, k in n.items())


def test_rows_of_counts_grow_with_different_words_only(spark):
    """What a learn set's tasks pass on: ten times the copies of a text make no more rows."""
    def rows(copies):
        texts = spark.createDataFrame([(f"acd efg {k % 7 * 'a'}c",) for k in range(7 * copies)], "text string").coalesce(1)
        return sorted(tuple(r) for r in texts.select(F.col("text").cast("binary")).mapInArrow(tables._counter(1 << 20), "w string, n long").collect())

    few, many = rows(10), rows(100)
    assert len(few) == len(many) == 9 and [(w, 10 * n) for w, n in few] == many


@pytest.mark.parametrize("piece", [1, 100, 128 << 10])
def test_words_are_told_apart_beyond_eight_letters(spark, monkeypatch, piece):
    """Words that share their first eight letters, at the ends of texts too; what blanks enclose is no row of the counts."""
    monkeypatch.setattr(tables, "SPLIT_BYTES", piece, raising=False)
    words = [("acdefghiklmnpqrstvwy" * 2)[:n] for n in range(1, 40)]
    texts = spark.createDataFrame([(f"{w}, {w}x.",) for w in words] + [(w,) for w in words] + [("",), (" ",), ("x",), (None,)], "text string").coalesce(1)
    got = texts.select(F.col("text").cast("binary")).mapInArrow(tables._counter(32 << 20), "w string, n long").collect()
    assert sorted(tuple(r) for r in got) == sorted((w.upper(), 3) for w in words)
