"""CSV by header and in parallel, arrivals, and reloads that fail midway."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rolescope import schemas
from rolescope.sources import files, headers, records, reload
from rolescope.streaming import arrivals
from rolescope.streaming.load import load_new_files, stream_raw_csv

SETTINGS = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def counts(load):
    return {r.outcome: r.n_records for r in load.counts().collect()}


@pytest.fixture
def small_splits(spark):
    before = {name: spark.conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def random_csv(seed, n, line_end="\n"):
    pick = random.Random(seed)

    def field():
        text = "".join(pick.choice(["a", "b", '"', ",", "\n", "é", " ", "\n\n"]) for _ in range(pick.randrange(14)))
        plain = not any(c in text for c in '",\n')
        return text if plain and pick.random() < 0.5 else '"' + text.replace('"', '""') + '"'

    return line_end.join(["job_link,job_skills", *(f"k{i},{field()}" for i in range(n))]) + line_end


@pytest.mark.parametrize("seed", range(3))
def test_split_files_give_the_rows_of_whole_ones(small_splits, tmp_path, seed):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text(random_csv(10 * seed + i, 250), encoding="utf-8", newline="")
    load = headers.read_by_header(small_splits, str(tmp_path), schemas.SKILLS)
    whole = rows(files.read_raw_csv(small_splits, str(tmp_path), schemas.SKILLS))
    assert len(whole) == 500 and rows(load.rows) == whole
    assert counts(load) == {"loaded": 500, "short": 0, "long": 0, "unclosed": 0}
    tasks = records._lines(small_splits, str(tmp_path)).rdd.getNumPartitions()
    assert tasks > 8  # of two files


def test_a_record_longer_than_many_blocks(small_splits, tmp_path):
    text = "\n".join(f"line {i}, with a comma" for i in range(400))
    (tmp_path / "long.csv").write_text(f'job_link,job_summary\na,"{text}"\nb,"x\ny"\nc,\n')
    load = headers.read_by_header(small_splits, str(tmp_path), schemas.SUMMARIES)
    assert rows(load.rows) == sorted([("a", text), ("b", "x\ny"), ("c", None)], key=repr)


def test_records_keep_their_order_and_place(small_splits, tmp_path):
    (tmp_path / "r.csv").write_text("\n" + "\n".join(f'{i},"a\nb"' for i in range(200)) + "\n\n")
    got = records.csv_records(small_splits, str(tmp_path)).orderBy("file", "block", "record").collect()
    assert [r.text for r in got] == [f'{i},"a\nb"' for i in range(200)]


@pytest.mark.parametrize("bits", [0, 2])
def test_chunks_of_one_block_give_the_rows_of_whole_files(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(records, "CHUNK_BITS", bits)
    monkeypatch.setattr(records, "TASK_BYTES", 500)
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text(random_csv(40 + i, 150), encoding="utf-8", newline="")
    lines = records._lines(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() == 2
    assert lines.groupBy("file", "block", "chunk").count().agg(F.max("count")).first()[0] <= 1 << bits
    whole = rows(files.read_raw_csv(spark, str(tmp_path), schemas.SKILLS))
    load = headers.read_by_header(spark, str(tmp_path), schemas.SKILLS)
    assert len(whole) == 300 and rows(load.rows) == whole
    got = records.csv_records(spark, str(tmp_path)).orderBy("file", "block", "record").collect()
    assert len({(r.file, r.block, r.record) for r in got}) == 302
    keys = [r.text.split(",")[0] for r in got]
    assert keys == ["job_link", *(f"k{i}" for i in range(150))] * 2


def test_lines_of_a_large_block_make_chunks(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("job_link,job_skills\n" + "".join(f"k{i},some skills\n" for i in range(60_000)))
    monkeypatch.setattr(records, "TASK_BYTES", 100_000)
    lines = records._lines(spark, str(tmp_path)).groupBy("file", "block", "chunk").count()
    assert lines.agg(F.max("count")).first()[0] <= 1 << 13
    load = headers.read_by_header(spark, str(tmp_path), schemas.SKILLS)
    assert load.rows.count() == 60_000 and load.rejects.isEmpty()


def test_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("job_link,job_skills\n1,x\n")
    (tmp_path / "b.csv").write_text("job_skills,job_link\ny,2\n")
    (tmp_path / "c.csv").write_text("﻿other,job_skills,job_link\r\nz,\"p\nq\",3\r\n", encoding="utf-8", newline="")
    (tmp_path / "d.csv").write_text('"job_link",job_skills\n')  # nothing but a header
    (tmp_path / "e.csv").write_text("")
    load = headers.read_by_header(spark, str(tmp_path), schemas.SKILLS)
    assert rows(load.rows) == [("1", "x"), ("2", "y"), ("3", "p\nq")] and load.rows.columns == schemas.SKILLS.names
    assert counts(load)["loaded"] == 3
    part = headers.read_by_header(spark, str(tmp_path), schemas.SKILLS, columns=["job_skills"])
    assert rows(part.rows) == [("p\nq",), ("x",), ("y",)] and part.rows.columns == ["job_skills"]


def test_records_that_do_not_fit_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('job_link,job_skills\n1,x\n2\n3,"a,b",c\n"4","q""r"\n,\n5,s,,\n')
    (tmp_path / "b.csv").write_text('job_skills,job_link\ny,6\nz,7,"never closed\n8,w\n')
    load = headers.read_by_header(spark, str(tmp_path), schemas.SKILLS)
    assert rows(load.rows) == sorted([("1", "x"), ("4", 'q"r'), (None, None), ("6", "y")], key=repr)
    bad = [(r.reason, r.text) for r in load.rejects.collect()]
    assert sorted(bad) == [
        ("long", '3,"a,b",c'), ("long", "5,s,,"), ("short", "2"), ("unclosed", 'z,7,"never closed\n8,w'),
    ]
    assert counts(load) == {"loaded": 4, "short": 1, "long": 2, "unclosed": 1}
    target, quarantine = str(tmp_path / "rows"), str(tmp_path / "rejects")
    assert headers.save_load(load, target, quarantine) == (4, 4)
    assert spark.read.parquet(target).count() == 4 and spark.read.parquet(quarantine).count() == 4


def test_headers_that_cannot_be_bound(spark, tmp_path):
    (tmp_path / "a.csv").write_text("job_link,skills\n1,x\n")
    with pytest.raises(headers.HeaderError, match="lacks"):
        headers.read_by_header(spark, str(tmp_path), schemas.SKILLS)
    load = headers.read_by_header(spark, str(tmp_path), schemas.SKILLS, missing="null")
    assert rows(load.rows) == [("1", None)]
    (tmp_path / "a.csv").write_text("job_link,job_skills,job_link\n1,x,2\n")
    with pytest.raises(headers.HeaderError, match="repeats"):
        headers.read_by_header(spark, str(tmp_path), schemas.SKILLS)
    with pytest.raises(headers.HeaderError, match="schema"):
        headers.read_by_header(spark, str(tmp_path), schemas.SKILLS, columns=["nothing"])


def test_files_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    load = headers.read_by_header(spark, str(tmp_path), schemas.SKILLS)
    assert rows(load.rows) == [] and counts(load) == {"loaded": 0, "short": 0, "long": 0, "unclosed": 0}


def test_a_stream_stops_at_a_swapped_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("job_skills,job_link\ny,2\n")
    stream = load_new_files(
        stream_raw_csv(spark, str(tmp_path / "in"), schemas.SKILLS), str(tmp_path / "out"), str(tmp_path / "progress")
    )
    with pytest.raises(PySparkException):
        stream.awaitTermination()


def test_arrivals_are_loaded_once(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.csv").write_text("job_link,job_skills\n1,x\n2\n")
    (source / "b.csv").write_text("job_skills,job_link\ny,3\n")
    load = lambda n: arrivals.load_arrivals(spark, str(source), folder, schemas.SKILLS, files_per_batch=n)
    assert rows(arrivals.loaded(spark, folder, schemas.SKILLS)) == [] and load(1) == 2 and load(1) == 0
    (source / "c.csv").write_text("job_link,job_skills\n4,z\n5,a,b\n")
    assert load(5) == 1
    assert rows(arrivals.loaded(spark, folder, schemas.SKILLS).drop("batch")) == [("1", "x"), ("3", "y"), ("4", "z")]
    assert sorted((r.reason, r.text) for r in arrivals.rejected(spark, folder).collect()) == [("long", "5,a,b"), ("short", "2")]
    assert sum(r.n_rows for r in arrivals.batches(spark, folder).collect()) == 3


def test_a_batch_cut_short_is_done_again(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.csv").write_text("job_link,job_skills\n1,x\n")
    # rows of a batch that never got into the ledger
    spark.createDataFrame([("9", "old")], schemas.SKILLS).write.parquet(f"{folder}/rows/batch=1")
    assert rows(arrivals.loaded(spark, folder, schemas.SKILLS)) == []
    assert arrivals.load_arrivals(spark, str(source), folder, schemas.SKILLS) == 1
    assert rows(arrivals.loaded(spark, folder, schemas.SKILLS)) == [("1", "x", 1)]


def failing(df):
    """Raises after some of the rows are written."""
    stop = F.when(F.col("job_link") == "k90", F.raise_error(F.lit("midway")).cast("string"))
    return df.withColumn("job_skills", F.coalesce(stop, F.col("job_skills")))


def test_a_reload_that_fails_leaves_the_old_rows(spark, tmp_path):
    folder = str(tmp_path / "table")
    old = spark.createDataFrame([("a", "x"), ("b", "y")], schemas.SKILLS)
    new = spark.range(100).select(F.format_string("k%d", "id").alias("job_link"), F.lit("z").alias("job_skills"))
    with pytest.raises(reload.ReloadError):
        reload.current(spark, folder)
    assert reload.reload(old, folder) == 2
    with pytest.raises(Exception, match="midway"):
        reload.reload(failing(new), folder)
    with pytest.raises(reload.ReloadError, match="99 expected"):
        reload.reload(new, folder, expect=99)
    with pytest.raises(reload.ReloadError, match="test"):
        reload.reload(new, folder, test=lambda df: df.where("job_skills is null").count() > 0)
    assert rows(reload.current(spark, folder)) == [("a", "x"), ("b", "y")]
    assert reload.reload(new, folder, expect=100) == 100
    assert reload.current(spark, folder).count() == 100 and reload.current(spark, folder, 1).count() == 2
    assert [(r.number, r.n_rows) for r in reload.history(spark, folder).orderBy("number").collect()] == [(1, 2), (2, 100)]


def test_a_catalog_table_is_switched_last(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], schemas.SKILLS)
    new = spark.range(100).select(F.format_string("k%d", "id").alias("job_link"), F.lit("z").alias("job_skills"))
    assert reload.reload_table(old, "t_reloaded") == 2
    with pytest.raises(Exception, match="midway"):
        reload.reload_table(failing(new), "t_reloaded")
    with pytest.raises(reload.ReloadError):
        reload.reload_table(new, "t_reloaded", expect=7)
    assert rows(spark.table("t_reloaded")) == [("a", "x"), ("b", "y")]
    for _ in range(3):
        assert reload.reload_table(new, "t_reloaded", expect=100, buckets=2) == 100
    assert spark.table("t_reloaded").count() == 100
    kept = [t.name for t in spark.catalog.listTables() if t.name.startswith("t_reloaded__v")]
    assert len(kept) == 2
