import os

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_take_effect(spark):
    import corpus_pipeline as c
    from braidlog.llm.decontaminate import contamination
    from braidlog.llm.near_dedup import near_duplicates

    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in c.STAGES:
        before, docs = docs, stage(spark, docs, DATA).persist()
        seen[name] = (before, docs)
        if name != "pack":
            assert docs.columns == columns and docs.count() <= before.count()
    assert seen["near_dedup"][1].count() < seen["near_dedup"][0].count()
    assert near_duplicates(seen["near_dedup"][1], shingle=5).where("not kept").count() == 0
    assert contamination(seen["decontaminate"][1], spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").count() == 0
    assert docs.select("doc_id").distinct().count() == seen["pack"][0].count()
    assert seen["line_dedup"][1].where(F.length("text") != F.col("n_chars")).count() == 0
    assert c.run(spark, DATA).count() == docs.count()


CLASHING = ["score", "predicted", "n_lines", "n_dropped", "marks", "hit_id", "hit_hash", "gone_id", "row_hash", "text_", "column_1", "n_chars", "a.b c"]


def test_awkward_rows_and_columns(spark, tmp_path):
    """Every stage against plain Python, over nulls, repeated ids, copies and columns named as the operators' own."""
    import corpus_pipeline as c
    from cases import texts

    stages = dict(c.STAGES)
    rows = [*texts(), (30, "w1 " * 3 + " ".join(f"u{i}" for i in range(60))), (31, "w1 " * 3 + " ".join(f"u{i}" for i in range(60))), (31, "only this id has another text")]
    rows += [(40 + i, f"Own {i}\n  Shared LINE \nown{i}") for i in range(10)] + [(60, "so " + " ".join(f"b{i}" for i in range(10)))]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{x}` double" for x in CLASHING)
    docs = spark.createDataFrame([(i, t, *(float(n * 100 + k) for k in range(len(CLASHING)))) for n, (i, t) in enumerate(rows)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12)), 5.0), (2, None, 5.0)], "item_id bigint, text string, n_hit double").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    others = [x for x in CLASHING if x != "n_chars"]
    values = lambda df: sorted((tuple(r[x] for x in ("doc_id", "text", *others)) for r in df.collect()), key=repr)
    before = values(docs)

    assert values(stages["toxicity"](spark, docs, str(tmp_path))) == before  # nothing labelled toxic
    lines = stages["line_dedup"](spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and lines.where(F.length("text") != F.col("n_chars")).count() == 0
    drop = lambda t: "\n".join(x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r").lower() != "shared line")
    assert values(lines) == sorted(((i, drop(t), *rest) for i, t, *rest in before), key=repr)
    kept = values(stages["near_dedup"](spark, docs, str(tmp_path)))
    # of the copies 1, 2, 3 and 30, 31 the least ids stay, with every row of theirs; so do an id's other texts
    gone = lambda i, t: (i in (2, 3) or i == 31) and t not in ("other text of a repeated id", "only this id has another text") or i == 8
    assert kept == [r for r in before if not gone(r[0], r[1])]
    assert values(stages["decontaminate"](spark, docs, str(tmp_path))) == [r for r in before if r[0] != 60]
    assert stages["pack"](spark, docs, str(tmp_path)).where("piece = 0").count() == len(rows)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
