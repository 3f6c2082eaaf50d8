import hashlib
import json
from dataclasses import replace

from pyspark.sql import functions as F

from fathomline import settings as S
from fathomline.operators import maintenance as M


def test_fingerprint_follows_what_decides_passages():
    base = S.fingerprint(S.chunking(S.DEFAULT, "m"))
    assert base == hashlib.sha256(json.dumps({"chunker_version": 9, "chunk_size_tokens": 448, "chunk_overlap_tokens": 100, "min_section_words": 40, "csv_rows_per_section": 50, "dense_embedding_model": "m"}, sort_keys=True).encode()).hexdigest()[:12]
    others = [S.chunking(S.DEFAULT, "n")] + [S.chunking(replace(S.DEFAULT, **{f: 7}), "m") for f in S.CHUNKING.values()]
    assert len({base, *map(S.fingerprint, others)}) == 7
    assert S.fingerprint(S.chunking(replace(S.DEFAULT, rerank_top_k=99), "m")) == base
    run = S.measured_with(S.DEFAULT, "hybrid", reranker="r")
    assert run["arm"] == "hybrid" and run["reranker"] == "r" and run["rerank_top_k"] == 8


def test_fingerprints_of_columns_and_states(spark):
    current = S.fingerprint(S.chunking(S.DEFAULT, "m"))
    rows = spark.createDataFrame([("a", 448), ("a", 448), ("b", 448), ("b", 256), ("c", None), ("d", 448)], "filename string, size int")
    columns = {k: F.lit(v) for k, v in S.chunking(S.DEFAULT, "m").items()} | {"chunk_size_tokens": F.col("size")}
    made = rows.withColumn("fingerprint", F.when(F.col("size").isNotNull(), M.fingerprint_column(columns)))
    assert made.filter("filename = 'd'").first().fingerprint == current
    got = {r.filename: (r.passages, r.old, r.fingerprints, r.stale) for r in M.fingerprint_state(made, current).collect()}
    assert got == {"a": (2, 0, 1, False), "b": (2, 1, 2, True), "c": (1, 1, 0, True), "d": (1, 0, 1, False)}


def test_index_compatibility(spark):
    rows = [("a", 5, "m", 64, "en", ""), ("b", 5, "n", 32, "en", ""), ("c", 0, "n", 64, "de", "x"), ("d", 5, "m", 64, None, None), ("e", 5, None, 64, "en", ""), ("f", None, "m", None, "en", "")]
    df = spark.createDataFrame(rows, "index_id string, points long, model string, dimension int, language string, prefix string")
    got = {r.index_id: (r.verdict, r.differs) for r in M.index_compatibility(df, {"model": "m", "dimension": 64, "language": "en", "prefix": ""}).collect()}
    assert got == {"a": ("fits", ""), "b": ("refused", "model,dimension"), "c": ("rebuilt", "model,language,prefix"), "d": ("fits", ""), "e": ("refused", "model"), "f": ("rebuilt", "dimension")}
