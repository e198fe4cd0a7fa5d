"""Mixing: targets, permutations, draws and the whole mix."""

import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm import mixing, queries
from tests.conftest import SF_SMALL

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


def plain_targets(sizes, weights, limit=3):
    """The excess reshared by weight, round by round."""
    target, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > limit * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            return target
        for i in over:
            target[i] = Fraction(limit * sizes[i])
        left -= sum(target[i] for i in over)
        free -= over
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets():
    rng = np.random.default_rng(0)
    for n in range(1, 40):
        sizes = [int(s) for s in rng.choice([0, 1, 5, 70, 900, 10**6], n)]
        weights = [1 + i % 3 for i in range(n)]
        got = mixing.share_out(sizes, weights)
        assert got == plain_targets(sizes, weights) and sum(got) == sum(sizes)
    assert mixing.share_out([], []) == []


def test_permutations():
    for n in (1, 2, 3, 7, 64, 65, 1000, 4097):
        at = np.arange(n)
        seen = [mixing.permuted(at, np.full(n, n), np.full(n, key, np.uint64)) for key in (0, 1, 2**63 + 5)]
        assert all(sorted(s) == at.tolist() for s in seen)
    assert (seen[0] != seen[1]).any()
    mixed = mixing.permuted(np.array([0, 1, 0, 1, 2]), np.array([2, 2, 3, 3, 3]), np.array([4, 4, 9, 9, 9], np.uint64))
    assert sorted(mixed[:2]) == [0, 1] and sorted(mixed[2:]) == [0, 1, 2]


@pytest.mark.parametrize("shards,group", [(1, 4), (7, 4), (8, 4), (33, 8), (33, 64)])
def test_shard_draws(shards, group):
    slots = np.array([0, 5, 1000, 333, 2])
    drawn = list(mixing.shard_counts(0, shards, shards, slots, 3, group))
    assert [s for s, _, _ in drawn] == list(range(shards))
    counts = np.array([c for _, c, _ in drawn])
    assert (counts.sum(0) == slots).all() and (counts >= 0).all()
    assert (np.cumsum(counts, 0) - counts == [b for _, _, b in drawn]).all()
    # Any task finds its shards alone, as in the whole.
    for a in range(0, shards, 3):
        part = list(mixing.shard_counts(a, min(a + 3, shards), shards, slots, 3, group))
        assert all((c == counts[s]).all() for s, c, _ in part)
    assert counts.sum(1).max() - counts.sum(1).min() <= len(slots) + 1


def test_draws_vary_like_draws():
    counts = np.array([c for _, c, _ in mixing.shard_counts(0, 64, 64, np.array([64 * 50, 64 * 150]), 1)])
    assert 20 < counts[:, 0].var() < 60  # 37.5 by the binomial law


def rows():
    out = [(i, " ".join(f"w{i}.{k}" for k in range(i % 40)), f"s{i % 4}") for i in range(200)]
    out += [(1000 + i, "hot words of a copy " * 30, "hot") for i in range(150)]
    out += [(7, "same row twice", None), (7, "same row twice", None), (None, "no id\tat all", None), (8, None, "s1"), (9, "", "s1"), (10, " \n ", ""), (11, "one", ""), (12, "\U0001f600 astral first", "\U0001f600"), (13, "private use", "￿")]
    out += [(14, "long " * 150_000, "long"), (15, "tiny", "tiny")]
    return out


def mixed(spark, rows, parts=3, **params):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"row": F.lit(1), "size": F.lit("x"), "name": F.lit(None), "hash": F.lit(0), "target": F.lit(1), "n": F.lit(2)})
    return df, mixing.mix_sources(df, **params)


def test_whole_mix(spark):
    data = rows()
    df, mix = mixed(spark, data, block=16, shard=64)
    got = mix.taken().select("keep.doc_id", "name", "size", "source_size", "weight", "target", "taken").collect()
    names = sorted({s for _, _, s in data if s is not None}) + [None]
    sizes = {n: sum(size(t) for _, t, s in data if s == n) for n in names}
    target = dict(zip(names, plain_targets(list(sizes.values()), [1 + i % 3 for i in range(len(names))]), strict=True))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, size(t)) for d, t, _ in data)
    for r in got:
        assert (r.source_size, r.target) == (sizes[r.name], float(target[r.name])) and 0 <= r.taken <= 3 * r.size
    for n in names:
        taken = sum(r.taken for r in got if r.name == n)
        assert abs(taken - target[n]) <= 32, n
    # A source at its limit is taken whole three times.
    assert [r.taken for r in got if r.name == "tiny"] == [3]
    spans = mix.spans.collect()
    by_slot = {}
    for s in spans:
        by_slot.setdefault((s.shard, s.slot), []).append(s)
    assert all(len({(s.source, s.block) for s in v}) == 1 and sum(s.length for s in v) <= 16 for v in by_slot.values())
    shards = [[slot for shard, slot in by_slot if shard == k] for k in {shard for shard, _ in by_slot}]
    assert all(sorted(s) == list(range(len(s))) for s in shards)
    uses = {}
    for (_, _), v in by_slot.items():
        uses.setdefault(v[0].source, {}).setdefault(v[0].block, []).append(1)
    for blocks in uses.values():
        counts = [len(v) for v in blocks.values()]
        assert max(counts) <= 3


def test_same_mix_under_any_partitioning(spark):
    seen = []
    for parts in (1, 5):
        _, mix = mixed(spark, rows(), parts, block=16, shard=64)
        seen.append(sorted(map(str, mix.taken().select("keep.doc_id", "size", "taken").collect())))
    assert seen[0] == seen[1]


def test_render(spark):
    data = [(i, " ".join(f"{i}.{k}" for k in range(37)), "ab"[i % 2]) for i in range(20)]
    df, mix = mixed(spark, data, block=10, shard=8)
    texts = mixing.render(mix, df.select("doc_id", "text"), "doc_id").collect()
    words = [w for r in texts for w in r.text.split(" ")]
    assert len(words) == mix.spans.agg(F.sum("length")).first()[0] and set(words) <= {w for _, t, _ in data for w in t.split()}
    for r in texts:  # neighbours in a document stay neighbours
        parts = [tuple(map(int, w.split("."))) for w in r.text.split(" ")]
        assert all(b == (a[0], a[1] + 1) or (a[1], b[1]) == (36, 0) for a, b in zip(parts, parts[1:], strict=False))


def test_empty_tables(spark):
    for data in ([], [(1, None, "a"), (2, " ", None)]):
        _, mix = mixed(spark, data)
        assert sorted((r.size, r.source_size, r.target, r.taken) for r in mix.taken().collect()) == [(0, 0, 0.0, 0)] * len(data)
        assert mix.spans.count() == 0


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    with pytest.raises(ValueError, match="more than 3 sources: 4"):
        mixed(spark, [(i, "a", str(i)) for i in range(4)])


def test_query(spark):
    got = queries.op12_mixing(spark, SF_SMALL)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    total = got.agg(F.sum("size"), F.sum("taken"), F.count("*")).first()
    assert total[2] == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count() and abs(total[0] - total[1]) < 0.02 * total[0]
