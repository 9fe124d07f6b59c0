import pytest
from pyspark.sql import functions as F

from rolescope import schemas
from rolescope.operators.keys import enrich
from rolescope.sources import files, tables
from rolescope.streaming.load import load_new_files, stream_raw_csv

AWKWARD = [
    ("l1", 'a "quoted" x\nline2, z'), ("l2", "plain"), ("l3", "  padded  "), ("l4", None), ("l5", "back\\slash \\\" end"),
    ("l6", "nbsp\u00a0é–"),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quoted_csv(spark, tmp_path):
    path = tmp_path / "skills.csv"
    path.write_text('job_link,job_skills\nl1,"a ""quoted"" x\nline2, z"\nl2,plain\nl3,\n', encoding="utf-8")
    df = files.read_raw_csv(spark, str(path), schemas.SKILLS)
    assert rows(df) == [("l1", 'a "quoted" x\nline2, z'), ("l2", "plain"), ("l3", None)]
    assert files.loaded_rows(df).first()[0] == 3


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, schemas.SKILLS)
    files.write_csv(df, str(tmp_path / "out"))
    files.write_csv(df, str(tmp_path / "out"))  # a reload replaces
    assert rows(files.read_raw_csv(spark, str(tmp_path / "out"), schemas.SKILLS)) == sorted(AWKWARD, key=repr)


def test_clean_files_are_typed(spark, tmp_path):
    text = ",".join(schemas.POSTINGS_FINAL.names) + "\nl,T,t,R,C,L,TX,2024-01-12,Mid,Onsite,True\n"
    (tmp_path / "p.csv").write_text(text)
    row = files.read_clean_postings(spark, str(tmp_path / "p.csv")).first()
    assert str(row.first_seen) == "2024-01-12" and row.is_likely_repost is True
    skills = spark.createDataFrame([("l", "SQL", "sql")], schemas.SKILLS_FINAL)
    files.write_csv(skills, str(tmp_path / "s"))
    assert rows(files.read_clean_skills(spark, str(tmp_path / "s"))) == [("l", "SQL", "sql")]


def test_preview(spark):
    df = spark.createDataFrame([("b", "x" * 9), ("a", "yy")], schemas.SUMMARIES)
    got = files.preview(df, ["job_link", "job_summary"], 1, {"job_summary": 3}, ["job_link"])
    assert got.columns == ["job_link", "job_summary_preview"] and rows(got) == [("a", "yy")]


def test_written_rows_are_counted(spark, tmp_path):
    assert tables.write_parquet(spark.range(7), str(tmp_path / "t")) == 7
    assert tables.write_parquet(spark.range(3), str(tmp_path / "t")) == 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_tables_bucketed_alike_join_without_a_shuffle(spark):
    left = spark.createDataFrame([(f"l{i}", str(i)) for i in range(200)], schemas.SKILLS)
    right = left.select("job_link", F.col("job_skills").alias("job_summary"))
    assert tables.write_table(left, "t_skills", buckets=4) == 200
    tables.write_table(right, "t_summary", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = enrich(spark.table("t_skills"), spark.table("t_summary"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tables.export_columns(spark, "t_skills", ["job_link"]).columns == ["job_link"]
    spark.sql("DROP TABLE t_skills")
    spark.sql("DROP TABLE t_summary")


def test_session_table(spark):
    stored = tables.session_table(spark.range(5).withColumnRenamed("id", "n"), "five")
    assert stored.count() == spark.table("five").count() == 5
    assert tables.shared_folder(spark) in stored.inputFiles()[0]
    again = tables.session_table(spark.range(2).withColumnRenamed("id", "n"), "five")
    assert (stored.count(), again.count()) == (5, 2)


def test_stream_loads_new_files_once(spark, tmp_path):
    source, target, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()

    def load():
        query = load_new_files(stream_raw_csv(spark, source, schemas.SKILLS, 1), target, progress)
        query.awaitTermination(120)
        return spark.read.parquet(target).count()

    for i in range(3):
        (tmp_path / "in" / f"{i}.csv").write_text(f'job_link,job_skills\nl{i},"a\nb"\n')
    assert load() == 3
    (tmp_path / "in" / "3.csv").write_text("job_link,job_skills\nl9,x\n")
    assert load() == 4


def test_a_cluster_must_name_the_shared_folder(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "yarn"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        tables.shared_folder(Fake())
