"""R8: settings files to (file, name, value), secrets masked."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from stevedore.sources import compare_settings, extract_settings, malformed_settings

XML = """<?xml version="1.0" encoding="UTF-8" standalone="no"?>
<configuration>
    <!-- metastore -->
    <property>
        <name>javax.jdo.option.ConnectionURL</name>
        <value>jdbc:postgresql://db.example.test:5432/metastore</value>
        <description>Where the table names live</description>
    </property>
    <property>
        <name>javax.jdo.option.ConnectionPassword</name>
        <value>not-a-real-password</value>
    </property>
    <property>
        <name>hive.exec.dynamic.partition.mode</name>
        <value>nonstrict</value>
        <description>A note that goes on
            over a second line</description>
    </property>
    <property>
        <name>hive.empty</name>
        <value></value>
    </property>
</configuration>
"""

KV = """# what runs here
SPARK_VERSION=9.9.9

export EXTRA_OPTS="-Da=b -Dc=d"
AWS_SECRET_ACCESS_KEY=invented-secret
NO_SEPARATOR_LINE
"""

CONF = """spark.driver.extraClassPath /opt/x/jars/*
spark.sql.extensions   org.example.Ext   with spaces
# comment
spark.hadoop.fs.s3a.access.key invented-key
"""


def _write(root: str, name: str, text: str) -> str:
    path = os.path.join(root.removeprefix("file:"), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def settings(df):
    return {r.name: r.value for r in df.collect()}


def test_xml_properties(spark, scratch):
    _write(scratch, "xml/hive-site.xml", XML)
    got = settings(extract_settings(spark, f"{scratch}/xml", "xml"))
    assert got == {
        "javax.jdo.option.ConnectionURL": "jdbc:postgresql://db.example.test:5432/metastore",
        "javax.jdo.option.ConnectionPassword": "[HIDDEN]",
        "hive.exec.dynamic.partition.mode": "nonstrict",
        "hive.empty": "",
    }


def test_kv_lines(spark, scratch):
    _write(scratch, "kv/versions.env", KV)
    got = settings(extract_settings(spark, f"{scratch}/kv", "kv"))
    assert got == {
        "SPARK_VERSION": "9.9.9",
        "EXTRA_OPTS": "-Da=b -Dc=d",
        "AWS_SECRET_ACCESS_KEY": "[HIDDEN]",
        "NO_SEPARATOR_LINE": None,
    }


def test_conf_lines(spark, scratch):
    _write(scratch, "conf/spark-defaults.conf", CONF)
    got = settings(extract_settings(spark, f"{scratch}/conf", "conf"))
    assert got == {
        "spark.driver.extraClassPath": "/opt/x/jars/*",
        "spark.sql.extensions": "org.example.Ext   with spaces",
        "spark.hadoop.fs.s3a.access.key": "[HIDDEN]",
    }


def test_many_files_carry_their_path(spark, scratch):
    for host in ("a", "b", "c"):
        _write(scratch, f"fleet/{host}/hive-site.xml", XML)
    df = extract_settings(spark, f"{scratch}/fleet", "xml", group="host")
    assert {(r.host, r.file.rsplit("/", 2)[-2]) for r in df.collect()} == {(h, h) for h in "abc"} and df.count() == 12
    for kind, name, text in (("kv", "a.env", KV), ("conf", "a.conf", CONF)):
        _write(scratch, f"{kind}-fleet/a/deep/{name}", text)
        assert {r.host for r in extract_settings(spark, f"{scratch}/{kind}-fleet", kind, group="host").collect()} == {"a"}


def test_a_damaged_property_costs_no_other(spark, scratch):
    good = lambda n: f"<property><name>{n}</name><value>{n} &amp; &lt;x&gt;</value></property>"
    damaged = "<property><name>b</nme><value>2</value></property>"
    hidden = "<!-- <property><name>z</name><value>1</value></property> -->"
    _write(scratch, "bad/one.xml", f"<configuration>{good('a')}{hidden}{damaged}{good('c')}</configuration>")
    _write(scratch, "bad/two.xml", f"<configuration>{good('d')}</configuration>")
    assert settings(extract_settings(spark, f"{scratch}/bad", "xml")) == {n: f"{n} & <x>" for n in "acd"}
    (row,) = malformed_settings(spark, f"{scratch}/bad").collect()
    assert row.file.endswith("one.xml") and (row.n_properties, row.n_read) == (3, 2)
    assert [tuple(x) for x in row.lost] == [(2, "b")]


def test_attributes_entities_and_sections(spark, scratch):
    """Each of these was lost, or kept its markup, when properties were cut out by expressions."""
    text = """<configuration xmlns="x">
      <property final="true"><name lang="en">a</name><value>1</value><final>true</final></property>
      <property note="x > y / z"><name>b</name><value>&#x41;&#66;&amp;&#x1F600;</value></property>
      <property><name>c</name><value><![CDATA[<x> & ]]>&lt;y&gt;</value></property>
      <property name="d" value="by &quot;attribute&quot;"/>
      <property><name>e</name><value/></property>
      <property><name>f</name></property>
      <property><name>g</name><value>two
        lines</value></property>
      <property><name>h</name><value>&unknown;</value></property>
      <property/><properties><name>not one</name></properties>
      <property><name>i</name><value>never closed"""
    _write(scratch, "odd/one.xml", text)
    got = settings(extract_settings(spark, f"{scratch}/odd", "xml"))
    assert got == {"a": "1", "b": "AB&\U0001f600", "c": "<x> & <y>", "d": 'by "attribute"', "e": "", "f": None, "g": "two\n        lines"}
    (row,) = malformed_settings(spark, f"{scratch}/odd").collect()
    assert (row.n_properties, row.n_read) == (10, 7)
    assert [(x.place, x.name) for x in row.lost] == [(8, "h"), (9, None), (10, "i")]


def test_changed_secrets_are_found_and_not_shown(spark, scratch):
    for side, password in (("want", "one"), ("have", "two")):
        _write(scratch, f"{side}/h1/a.env", f"DB_PASSWORD={password}\nPLAIN={password}\nSAME=1\n")
    found = compare_settings(spark, f"{scratch}/want", "kv", f"{scratch}/have", "kv", group="host")
    assert sorted(tuple(r) for r in found.collect()) == [
        ("h1", "DB_PASSWORD", "changed", "[HIDDEN]", "[HIDDEN]"),
        ("h1", "PLAIN", "changed", "one", "two"),
    ]


def test_secret_names(spark):
    from stevedore.functions import mask_secret

    names = ["api_key", "private.key", "db.pwd", "account.key", "db_pass", "compass", "monkey", "primary.keys.count"]
    rows = spark.createDataFrame([(n, "v") for n in names], "n STRING, v STRING").select("n", mask_secret(F.col("n"), F.col("v")).alias("m"))
    assert [r.n for r in rows.collect() if r.m == "[HIDDEN]"] == names[:5]


def test_unknown_kind(spark, scratch):
    with pytest.raises(ValueError):
        extract_settings(spark, scratch, "yaml")
