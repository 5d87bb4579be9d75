"""The stages against brute force on a small folder of tables, and the registry."""

import random
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from stayscope.llm import prefix_bpe, quality_rules
from stayscope.llm.queries import ORACLE_SQL, QUERIES

import test_decontaminate
import test_jaccard_join
import test_quality_rules


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnrst"]
    item = " ".join(rng.choice(words) for _ in range(25))
    docs = []
    for i in range(260):
        text = [rng.choice(words) for _ in range(60 + i % 50)]
        if i % 5 == 0:
            text = [w + "###" for w in text]
        if i % 17 == 1:
            text[20:20] = item.split()[3:18]
        docs.append((i, " ".join(text), "en", "src", 0))
    for i in range(0, 60, 3):
        changed = docs[i][1].split()
        changed[5] = "other"
        docs.append((1000 + i, " ".join(changed), "en", "src", 0))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "few words", "en", "s", 0), docs[7]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 260)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), docs, item


def test_stages_against_brute_force(spark, folder):
    root, docs, item = folder
    df, rows = spark.read.parquet(f"{root}/documents.parquet"), docs
    columns = df.columns
    rules = quality_rules.fit_rules(df, spark.read.parquet(f"{root}/labels.parquet"))
    assert rules

    def good(row):
        n, _, symbols, _, repeated = test_quality_rules.brute(row[1])
        # The planted junk has a run of # on every word, and no good row has any.
        return n >= 50 and 100 * repeated <= 50 * n and not symbols

    def check(name, df, rows):
        assert df.columns == columns
        assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str), name

    steps = dict(corpus_pipeline.STAGES)
    df, rows = steps["quality_rules"](spark, df, root), [r for r in rows if good(r)]
    check("quality_rules", df, rows)
    found = test_jaccard_join.brute([(r[0], r[1]) for r in rows], 5, 80)
    df, rows = steps["near_duplicates"](spark, df, root), sorted({r for r, f in zip(rows, found) if r[0] == f[2]})
    check("near_duplicates", df, rows)
    assert len(rows) < len(docs) - 50
    df = steps["decontaminate"](spark, df, root)
    rows = [r for r in rows if test_decontaminate.brute(r[1], [(1, item)], 10)[1] == 0]
    check("decontaminate", df, rows)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = prefix_bpe.read_ranks(f.read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r[0]: own.encode_ordinary(r[1]) for r in rows}
    for done in (steps["encode"](spark, df, root), corpus_pipeline.run(spark, root)):
        got = done.collect()
        assert len(got) == len(rows) and all(r["decodes"] for r in got)
        for r in got:
            ids = [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)]
            assert ids == want[r["doc_id"]] and r["n_tokens"] == len(ids)


def test_empty_documents(spark, folder):
    root, _, _ = folder
    df = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, df, root).count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_the_rest_imports_without_this_part(tmp_path):
    """A copy without the subpackage and the pipeline still has the other queries."""
    root = Path(__file__).resolve().parents[2]
    for path in root.rglob("*.py"):
        inside = path.relative_to(root)
        if "llm" not in inside.parts and inside.name != "corpus_pipeline.py":
            (tmp_path / inside).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / inside).write_bytes(path.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kpis' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
