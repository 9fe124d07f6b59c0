from rolescope.session import SETTINGS, prepare


def test_prepare_keeps_what_the_session_sets(spark):
    name = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"
    for n in SETTINGS:
        spark.conf.unset(n)
    spark.conf.set(name, "1g")
    prepare(spark)
    assert spark.conf.get(name) == "1g"
    spark.conf.unset(name)
    prepare(spark)
    assert {n: spark.conf.get(n) for n in SETTINGS} == SETTINGS
