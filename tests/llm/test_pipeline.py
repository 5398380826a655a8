"""The pipeline, its registration, and the library without it."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def tables(spark, tmp_path):
    """A small corpus with planted cases: toxic documents, copies, near copies, a leak."""
    import random

    chosen = random.Random(8)
    word = lambda: f"w{int(3_000 ** chosen.random())}"
    line = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = ". ".join(line(12) + (" vile" if bad and k == 3 else "") for k in range(8))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(bad)))
    item = line(40)
    clean = rows[1][1]
    near = clean.replace(clean.split()[50], "changed", 1)
    rows += [(1_000, clean, "en", "s1", 1), (1_001, near, "en", None, 1), (1_002, f"{line(200)} {item} {line(200)}", "en", "s2", 1), (1_003, None, None, None, None), (None, line(60), "en", "s1", 1)]
    at = tmp_path / "sf"
    for name, data, schema in (("documents", rows, COLUMNS), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", [(7, item)], "item_id bigint, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_stages_take_effect(spark, tables, tmp_path):
    docs, seen = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == [x.split()[0] for x in COLUMNS.split(", ")]
    ids = {name: {r.doc_id for r in found} for name, found in seen.items()}
    toxic = set(range(0, 600, 5))
    assert len(ids["toxicity"] & toxic) <= 6 and len(ids["toxicity"]) >= 595 - 120
    assert 1 in ids["near-dedup"] and not {1_000, 1_001} & ids["near-dedup"]
    assert ids["near-dedup"] - ids["decontamination"] == {1_002}
    words = {r.doc_id: len((r.text or "").split()) for r in seen["decontamination"]}
    total, taken = sum(words.values()), sum(words[r.doc_id] for r in seen["mixing"])
    assert abs(taken - 1.5 * total) < 0.05 * total
    # the order of training lies in the order of the shards
    assert [r.doc_id for r in sorted(seen["sharding"], key=lambda r: (r.shard, r.place))] == [r.doc_id for r in spark.read.parquet(f"{tmp_path}/3").orderBy("_metadata.file_path", "_metadata.row_index").collect()]
    assert docs.columns[-2:] == ["shard", "place"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_and_registration(spark):
    found = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x[: x.index("_") + 1] for x in found if x.startswith("op")}
    assert found["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql_of_the_operators(spark):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    from tessera.llm import queries

    for name, sql in queries.oracle_sql().items():
        ours, theirs = queries.queries()[name](spark, SF).toArrow(), con.sql(sql).arrow().read_all()
        names = sorted(ours.column_names)
        assert names == sorted(theirs.column_names)
        a, b = (sorted(map(repr, zip(*(t.column(n).to_pylist() for n in names), strict=True))) for t in (ours, theirs))
        assert a == b, name


def test_the_rest_stands_alone(tmp_path):
    """Without this subpackage and the pipeline, the entry imports and has the other queries."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(os.path.join(root, "tessera"), tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not [x for x in q if x.startswith('op') or x == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
