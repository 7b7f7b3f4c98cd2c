"""What the driver's JVM gives back between steps."""

from __future__ import annotations

import corpus_pipeline

from parcella import session


def test_the_jvm_gives_back_what_it_freed(spark):
    of = spark.sparkContext._jvm.java.lang.Class.forName("javax.management.MBeanServer")
    given = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.Object, 1)
    given[0] = spark.sparkContext._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    info = next(m for m in of.getMethods() if m.getName() == "getMBeanInfo")
    known = [o.getName() for o in info.invoke(spark.sparkContext._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given).getOperations()]
    said = session.give_back(spark)
    assert "Trim native heap" in said if "systemTrimNativeHeap" in known else said is None


def test_every_stage_of_the_pipeline_gives_back(spark, monkeypatch):
    called = []
    for place in (session, corpus_pipeline):
        monkeypatch.setattr(place, "give_back", lambda spark: called.append(1))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    for name, stage in corpus_pipeline.STAGES:
        if name == "toxicity":  # it takes labelled rows of all documents
            continue
        called.clear()
        stage(spark, docs, "/root/testdata/sf0.001")
        assert called, name
