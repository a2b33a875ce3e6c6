"""The settings data source equals the operator over files; keys and files are selected in the reader; streams take each file once."""

import os

import pytest

from basin.plans.io_queries import _run_available
from basin.sources.config import read_properties_files
from basin.sources.settings import register_settings

FILES = {"a/env.sh": 'A="1 2"\n# B=2\n\n C = \'x\' \nD==e=\nnothing\nA=again\n =empty\nE=', "a/b/other": "\t# no\nA='\"\nÜ=ö\n", "c": "",
         "_SUCCESS": "X=1", ".hidden": "Y=1"}


def key(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture()
def folder(spark, tmp):
    register_settings(spark)
    for name, text in FILES.items():
        os.makedirs(os.path.dirname(f"{tmp}/in/{name}"), exist_ok=True)
        with open(f"{tmp}/in/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    return f"{tmp}/in"


def test_equals_the_operator_over_files(spark, folder):
    got = spark.read.format("settings").load(folder)
    want = read_properties_files(spark, folder)
    tidy = lambda rows: key((r.file.replace("file:///", "file:/"), r.line_no, r.key, r.value) for r in rows)
    assert got.columns == want.columns and tidy(got.collect()) == tidy(want.collect()) and got.count() == 8
    assert spark.read.format("settings").option("bytesPerTask", 1).load(folder).rdd.getNumPartitions() >= 2
    assert spark.read.format("settings").load(f"{folder}/a/env.sh").count() == 6
    assert spark.read.format("settings").load(f"{folder}/none").count() == 0
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("settings").load().count()


def test_keys_and_files_are_selected_in_the_reader(spark, folder):
    load = lambda **o: spark.read.format("settings").options(bytesPerTask=1, **o).load(folder)
    whole = load()
    assert key(load(keys='["A", "C"]').collect()) == key(whole.where("key IN ('A', 'C')").collect())
    some = load(keys='["A"]', files="a/b/*")
    assert key(some.collect()) == key(whole.where("key = 'A' AND file LIKE '%/a/b/%'").collect()) and some.rdd.getNumPartitions() == 1
    assert load(keys="[]").count() == load(files="none").count() == 0
    assert whole.where("key = 'C'").count() == 1 and whole.count() == 8  # a filter does not stay with the frame


def test_stream_takes_each_file_once_over_restarts(spark, folder, tmp):
    def drain():
        s = spark.readStream.format("settings").option("settleSeconds", "0").load(folder)
        _run_available(s.writeStream.format("parquet").option("checkpointLocation", f"{tmp}/ckpt").trigger(availableNow=True).start(f"{tmp}/out"))

    drain()
    with open(f"{folder}/a/late", "w") as f:
        f.write("Z=26\n")
    drain()
    drain()
    assert key(spark.read.parquet(f"{tmp}/out").collect()) == key(spark.read.format("settings").load(folder).collect())
