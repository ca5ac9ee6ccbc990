"""The pipeline's rows against plain Python, stage by stage, and registered queries' columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from graphproof.llm import mixing, registry, toxicity
from test_jaccard_join import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SAMPLE = "/root/testdata/sf0.001"


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def corpus():
    rng, rows, labels = random.Random(11), [], []
    vocabulary = [f"word{i}" for i in range(500)]
    for i in range(400):
        kind = i % 10
        if kind == 0:
            words = rng.choices(vocabulary, k=60)
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["nastybad", "foulmouth"]))
        elif kind == 1 and rows:
            words = rng.choice(rows)[1].split()
        elif kind == 2 and rows:
            words = rng.choice(rows)[1].split()
            words[rng.randrange(len(words))] = "changed"
        else:
            words = rng.choices(vocabulary, k=rng.choice([3, 40, 120]))
        rows.append((i, (" " if kind % 2 else "\n").join(words), "en", f"s{i % 4}" if i % 3 else None, 0))
        labels.append((i, 1, int(bool(set(words) & {"nastybad", "foulmouth"}))))
    return rows, labels


def plain(spark, folder, rows):
    """What the stages give, without Spark but for the model's training."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.train(documents, spark.read.parquet(f"{folder}/labels.parquet"), usable)
    scanner = toxicity.Scanner(list(model.terms))
    import numpy as np
    rows = [r for r in rows if model.probability(np.array([scanner.features(r[1])]))[0] < 0.5]
    seen, once = set(), []
    for r in sorted(rows):
        key = re.sub("[\x20\x09-\x0d]+", " ", r[1])
        if key not in seen:
            seen.add(key)
            once.append(r)
    groups = brute([r[1] for r in once], corpus_pipeline.NEAR)
    rows = [r for i, r in enumerate(once) if groups[i][1] == i]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(2 * sizes[s], level * weights[s]) for s in sizes) < 1.5 * sum(sizes.values()):
            low = level
        else:
            high = level
    out = Counter()
    for r in rows:
        rate = min(2 * sizes[r[3]], level * weights[r[3]]) / sizes[r[3]]
        u = int(hashlib.md5(f"{r[0]}:{mixing.SEED}".encode()).hexdigest()[:13], 16) / (1 << 52)
        n = math.floor(rate + 1e-9) + (u < rate - math.floor(rate + 1e-9))
        if n:
            out[r] += n
    return out


def test_rows_equal_plain_python(spark, tmp_path):
    rows, labels = corpus()
    write(spark, str(tmp_path), rows, labels)
    want = plain(spark, str(tmp_path), rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == want
    assert not any("nastybad" in r.text or "foulmouth" in r.text for r in got) and len(want) > 150
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in got:
        assert r.piece_ids == library.encode(r.text) and r.decoded == r.text


def test_awkward_and_empty_tables(spark, tmp_path):
    odd = [(1, None, None, None, None), (2, "", None, None, 0), (None, "a b", None, "x", 0), (4, "w " * 60_000, None, "x", 0), (4, "w " * 60_000, None, "x", 0)]
    write(spark, str(tmp_path / "odd"), odd, [(1, 0, 0)])
    for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect():
        assert r.decoded == (r.text or "")
    write(spark, str(tmp_path / "none"), odd[:0], [(1, 0, 0)][:0])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SAMPLE).columns == docs.columns


CONTRACT = {
    "op1_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op2_line_dedup": {"doc_id"},
    "op3_pivot_index": {"vec_id", "n_links", "component_id", "kept"},
    "op4_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op5_sentencepiece": {"doc_id"},
    "op6_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op7_quality": {"doc_id", "held_out", "score", "predicted"},
    "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op10_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
}


def test_all_operators_are_registered():
    assert set(registry.queries()) == set(CONTRACT)
    assert set(registry.oracle_sql()) <= set(CONTRACT)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_queries_return_a_row_per_input_row(spark, name):
    frame = registry.queries()[name](spark, SAMPLE)
    source = "embeddings" if name.startswith("op3") else "documents"
    assert set(frame.columns) >= CONTRACT[name]
    rows = frame.collect()
    assert len(rows) == spark.read.parquet(f"{SAMPLE}/{source}.parquet").count()
    if "held_out" in frame.columns:
        modulus, rest = {"op7_quality": (3, 1), "op8_toxicity": (5, 0)}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_statements(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for view in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SAMPLE}/{view}.parquet'")
    frame = registry.queries()[name](spark, SAMPLE)
    cursor = connection.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    want = Counter(tuple(repr(row[names.index(c)]) for c in frame.columns) for row in cursor.fetchall())
    assert Counter(tuple(repr(row[c]) for c in frame.columns) for row in frame.collect()) == want
