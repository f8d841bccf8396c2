import json
import os
import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROSE = """
import json, os, sys, threading, time
sys.path.insert(0, sys.argv[2])
from pyspark.sql import functions as F
from braidlog.operators.clustering import cluster
from braidlog.session import session

top, n, words = sys.argv[1], 60_000, 40
spark = session("local[4]", spark__local__dir=top + "/local", spark__checkpoint__dir=top + "/shared", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
spark.sparkContext.setLogLevel("ERROR")
most, over = 0, False

def watch():
    global most
    while not over:
        size = 0
        for d, _, names in os.walk(top):
            for x in names:
                try:
                    size += os.path.getsize(os.path.join(d, x))
                except OSError:
                    pass
        most = max(most, size)
        time.sleep(0.1)

slots = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("0"), F.substring(F.md5(((F.col("id") * 1000 + i) * 7919 % 100_003).cast("string")), 1, 7)))
null = F.lit(None).cast("string")
lines = spark.range(0, n, 1, 32).select(null.alias("node"), null.alias("category"), F.col("id").alias("seq"), null.alias("timestamp"), slots.alias("slots"))
watching = threading.Thread(target=watch)
watching.start()
found = cluster(lines).select(F.col("count"), F.size("template").alias("n")).agg(F.sum("count"), F.count("*"), F.min("n"), F.max("n")).first()
over = True
watching.join()
print(json.dumps({"text": n * words * 8, "most": most, "lines": int(found[0]), "clusters": found[1], "width": [found[2], found[3]]}))
"""


def test_disk_of_clustering_is_a_few_times_the_text(tmp_path):
    for x in ("local", "shared"):
        (tmp_path / x).mkdir()
    run = subprocess.run([sys.executable, "-c", PROSE, str(tmp_path), ROOT], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    got = json.loads(run.stdout.splitlines()[-1])
    assert (got["lines"], got["width"]) == (60_000, [40, 40]) and got["clusters"] > 50_000
    assert got["most"] < 4 * got["text"]


ODD = [[], [""], ["", ""], ["0a", "0b"], ["0a\n", "\n0b"], ["\x01", "\x01a", "\x01b\n"], ["\x01\n\x01", "0é\U0001f600"], ["2", "102"]]


def test_packed_slots_come_back(spark):
    from braidlog.functions.tokens import n_packed, packed, unpacked
    from braidlog.operators.clustering import _joined

    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*ODD, None])], "i int, slots array<string>")
    out = rows.withColumn("text", packed(F.col("slots"))).select("i", "text", n_packed(F.col("text")).alias("n"), unpacked(F.col("text")).alias("back")).orderBy("i").collect()
    assert [r["back"] for r in out] == [*ODD, None]
    assert [r["n"] for r in out] == [*map(len, ODD), None] and len({r["text"] for r in out}) == len(out)
    batch = pa.RecordBatch.from_pydict({"slots": pa.array([*ODD, None], pa.list_(pa.string()))})
    assert _joined(batch).column("slots").to_pylist() == [r["text"] for r in out]


def test_zipped_rows_come_back(spark, monkeypatch):
    from braidlog import session as S

    rows = spark.range(0, 5000, 1, 3).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"), F.array(F.col("id").cast("string")).alias("list"))
    wanted = sorted(map(tuple, rows.collect()), key=repr)
    for shared in (False, True):
        kept = S.Zipped(rows, shared=shared)
        assert sorted(map(tuple, kept.frame().collect()), key=repr) == wanted
        assert sorted(r["text"] or "" for r in kept.frame("text").collect()) == sorted(r[1] or "" for r in wanted)
        kept.drop()
    monkeypatch.setattr(S, "ZIPPED", 100)
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["x" * 30] * 50})
    parts = list(S.zipped([batch, batch.slice(0, 0)]))
    assert len(parts) > 10 and pa.Table.from_batches(S._unzipped(parts, ["text", "id"])).to_pydict() == {"text": ["x" * 30] * 50, "id": list(range(50))}
