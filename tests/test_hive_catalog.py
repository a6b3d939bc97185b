"""The documented round trip (table names, columns and rows are fixed values) with the Hive catalog (embedded Derby metastore, no server).

A Hive-enabled session needs its own JVM, so it runs in a subprocess.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
import textwrap

from conftest import ROOT

SCRIPT = textwrap.dedent(
    """
    import json, sys
    sys.path.insert(0, {root!r})
    from stevedore.session import get_session
    from stevedore.operators import publish_table, publish_external, append_rows
    work = {work!r}
    spark = get_session("local[2]", "hive-round-trip", {{
        "spark.sql.warehouse.dir": work + "/warehouse",
        "spark.hadoop.javax.jdo.option.ConnectionURL": "jdbc:derby:;databaseName=" + work + "/metastore_db;create=true",
        "spark.driver.extraJavaOptions": "-Dderby.system.home=" + work,
    }}, hive_metastore="embedded")
    spark.sparkContext.setLogLevel("ERROR")
    out = {{"catalog": spark.conf.get("spark.sql.catalogImplementation")}}
    out["databases"] = [r[0] for r in spark.sql("SHOW DATABASES").collect()]
    spark.sql("CREATE DATABASE IF NOT EXISTS test_db")
    spark.sql("USE test_db")
    spark.sql("CREATE TABLE IF NOT EXISTS test_table (id INT, name STRING, value DOUBLE) USING parquet")
    spark.sql("INSERT INTO test_table VALUES (1, 'test1', 1.1), (2, 'test2', 2.2)")
    out["test_table"] = sorted(tuple(r) for r in spark.sql("SELECT * FROM test_table").collect())
    out["ddl_parquet"] = "parquet" in spark.sql("SHOW CREATE TABLE test_table").first()[0].lower()
    spark.sql("CREATE TABLE IF NOT EXISTS s3_test (id INT, data STRING) USING parquet LOCATION '" + work + "/s3_test'")
    spark.sql("INSERT INTO s3_test VALUES (1, 's3_test1'), (2, 's3_test2')")
    out["s3_test"] = sorted(tuple(r) for r in spark.sql("SELECT * FROM s3_test").collect())
    df = spark.createDataFrame([(3, "test3", 3.3)], "id INT, name STRING, value DOUBLE")
    out["appended"] = append_rows(df.select("value", "name", "id"), "test_db.test_table").count()
    out["published"] = publish_table(df, "test_db.published").count()
    print("RESULT " + json.dumps(out))
    spark.stop()
    """
)


def test_documented_round_trip_with_hive_catalog():
    work = tempfile.mkdtemp(prefix="stevedore-hive-")
    script = SCRIPT.format(root=ROOT, work=work)
    proc = subprocess.run(
        [sys.executable, "-c", script], capture_output=True, text=True, timeout=600, cwd=work, env=dict(os.environ)
    )
    lines = [ln for ln in proc.stdout.splitlines() if ln.startswith("RESULT ")]
    assert proc.returncode == 0 and lines, proc.stderr[-3000:]
    out = json.loads(lines[-1].removeprefix("RESULT "))
    assert out["catalog"] == "hive"
    assert "default" in out["databases"]
    assert out["test_table"] == [[1, "test1", 1.1], [2, "test2", 2.2]]
    assert out["ddl_parquet"] is True
    assert out["s3_test"] == [[1, "s3_test1"], [2, "s3_test2"]]
    assert out["appended"] == 3 and out["published"] == 1
