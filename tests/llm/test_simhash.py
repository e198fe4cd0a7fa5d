"""SimHash groups against a plain all-pairs version."""

import re

import xxhash
from pyspark.sql import types as T

from marketml.llm import simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("row", T.DoubleType())])


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows, max_bits=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return [(d, format(fp, "016x"), min((x for x in low[find(i)] if x is not None), default=None)) for i, ((d, _), fp) in enumerate(zip(rows, fps, strict=True))]


def _rows():
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8
    rows = [(10, base), (3, base), (7, base + "lambda"), (8, base.upper()), (20, None), (21, ""), (22, " \n\t"), (1, "one"), (2, "ONE"), (5, "x\xa0y z"), (6, "é É"), (3, base), (None, "one"), (None, "lonely words here now"), (9, "w%d " * 5 % (1, 2, 3, 4, 5))]
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    rows += [(100 + i, " ".join([*words[:i * 3], f"new{i}", *words[i * 3 + 1 :]])) for i in range(60)]
    return rows


def test_matches_all_pairs(spark):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "clash", 1.0) for d, t in rows], SCHEMA)
    for cell_rows in (2048, 8):  # the second cuts buckets into chunks
        rows_df, groups = simhash.near_duplicate_groups(docs, max_bits=4)
        got = simhash.assign_components(docs, max_bits=4)
        out = sorted(((r.doc_id, format(r.fp % 2**64, "016x"), r.component_id) for r in got.collect()), key=str)
        assert out == sorted(plain_components(rows), key=str)
        fps = rows_df.select("fp").distinct()
        few = simhash.components(simhash.links(fps, 4, cell_rows=cell_rows)).collect()
        many = simhash.components(simhash.links(fps, 4)).collect()
        assert sorted(few) == sorted(many)


def test_keep_one(spark):
    docs = spark.createDataFrame([(d, t, "clash", 1.0) for d, t in _rows()], SCHEMA)
    kept = simhash.keep_one(docs, max_bits=4)
    assert kept.columns == docs.columns
    want = {c for *_, c in plain_components(_rows())}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.assign_components(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_clashing_names(spark):
    schema = T.StructType([*SCHEMA[:2], *(T.StructField(n, T.StringType()) for n in ("own_row", "OWN_ID", "kept_id", "kept_row"))])
    docs = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in _rows()], schema)
    kept = simhash.keep_one(docs, max_bits=4)
    assert kept.columns == docs.columns and {tuple(r[2:]) for r in kept.collect()} == {("a", "b", "c", "d")}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for *_, c in plain_components(_rows())}, key=str)
