"""The pipeline's stages on planted rows, and the entry with and without this part."""

import os
import random
import shutil
import subprocess
import sys

import corpus_pipeline

from .conftest import prose

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows, labels, junk, copies, near = [], [], set(), set(), set()
    for i in range(400):
        text = prose(rng, rng.randint(60, 200))
        if i % 5 == 0:
            text = " ".join(w + "$$$" for w in text.split())
            junk.add(i)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(i not in junk), 0))
    for i in range(1, 40, 5):
        copies.add(1000 + i)
        rows.append((1000 + i, rows[i][1], "en", "s0", 1))
        near.add(2000 + i)
        words = rows[i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((2000 + i, " ".join(words), "en", "s1", 1))
    rows += [(3000, None, None, None, None), (3001, "", None, "s2", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/stage{i}")
        docs = spark.read.parquet(f"{d}/stage{i}")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
        ids.append({r[0] for r in docs.select("doc_id").collect()})
    clean = set(range(400)) - junk
    assert not junk & ids[0] and clean | copies | near <= ids[0]
    assert ids[1] == ids[0] - copies - ({3001} if 3000 in ids[0] else set())
    assert clean <= ids[2] and not near & ids[2]
    assert ids[4] == ids[3] <= ids[2]
    assert docs.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"] and docs.filter("NOT round_trip OR n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_the_rest_works_without_this_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(tmp_path / "repo/ashlar/llm")
    shutil.rmtree(tmp_path / "repo/tests/llm")
    os.remove(tmp_path / "repo/corpus_pipeline.py")
    code = "import __spark_entry__ as e; assert 'q11' in e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)


def test_eleven_queries_are_registered():
    import __spark_entry__ as e

    names = [k for k in e.queries() if k.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
