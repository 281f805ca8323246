"""Prefix trie, SimHash and structure repair against direct Python versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortkit.llm import queries, repair, simhash, trie
from tests.llm import brute_turns as brute
from tests.llm.conftest import SF001, read
from tests.llm.test_first import rows_of

TURNS = "conv_id bigint, turn bigint, role string, text string"
AUDIT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def odd_turns(seed=5):
    """Nulls in every column, empty, blank and long texts, odd roles, ties, repeated rows, a long conversation, families."""
    r = random.Random(seed)
    rows = [(None, 1, "user", "Hi there."), (None, None, "assistant", None), (1, None, None, "x."), (1, None, "user", "x."),
            (2, 0, "", "empty role."), (2, 1, "tool", "a tool!"), (3, 5, "user", "z" * 300_000), (4, 0, "user", None),
            (5, 0, "system", " \t\n"), (5, 9, "user", "gap?"), (6, 0, "assistant", "first"), (-7, 2, "user", "negative?")]
    rows += [(8, 1, "user", "same.")] * 40 + [(9, 1, "user", "tie b."), (9, 1, "user", "tie a."), (9, 1, "assistant", "tie a.")]
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  ", "Été.\n", "Yes. "]
    rows += [(11, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(texts) + (str(t) + "." if t % 3 else "")) for t in range(700)]
    for c in range(100, 180):
        rows += [(c, t, ("system", "user", "assistant")[t % 3 if t < 3 else 1 + t % 2], r.choice(texts)) for t in range(r.randrange(1, 9))]
    rows += [(c, t, "user", f"shared {t}.") for c in range(200, 260) for t in range(6)]  # exact copies
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_turns(), TURNS)
    return df.selectExpr("*", "1 AS conv", "'x' AS at", "2 AS block", "3 AS rows", "'y' AS h", "4 AS n", "5 AS _rid", "6 AS gone", "7 AS depth")


def raw(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


@pytest.mark.parametrize("least_block", [1, 256])
def test_repair(spark, odd, least_block):
    for df in (odd, read(spark, SF001, "conversations"), odd.limit(0)):
        got = rows_of(repair.audit(df, least_block), *AUDIT)
        assert got == sorted(brute.structure(raw(df)), key=repr)


def test_repaired_turns_are_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Still me."), (2, 0, "system", "Rules."), (3, 0, "assistant", "")]
    figures, lines = repair.repair(repair.plain(spark.createDataFrame(rows, TURNS)))
    got = [(x.conv, x.role, x.text) for x in lines.orderBy("conv", "at", "no").collect()]
    assert got == [(1, "user", "Hello."), (1, "assistant", "Still me.")]
    assert {x.conv: (x.cost, x.audit) for x in figures.collect()} == {1: (3, "KR"), 2: (4, "D"), 3: (4, "D")}


def test_every_repair_is_legal(spark, odd):
    _, lines = repair.repair(repair.damage(odd))
    per = lines.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "no", "role"))),
                                                             lambda x: F.substring(x["role"], 1, 1)), "").alias("s"))
    assert per.where(~F.col("s").rlike("^(s?(ua)+)?$")).count() == 0


@pytest.mark.parametrize("least_block,shard", [(256, 1024), (2, 3)])
def test_trie(spark, odd, least_block, shard, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", shard)
    for df in (odd, read(spark, SF001, "conversations"), odd.limit(0)):
        got = rows_of(trie.rebuilt_trie(df, least_block), *NODE)
        assert got == sorted(brute.trie(raw(df)), key=repr)


def test_shard_nodes_are_intersections():
    turn = lambda x: {"t": bytes([x]) * 16, "chars": x}
    rows = [[turn(1), turn(2)], [turn(1), turn(3)], [turn(1)], [turn(4)]]
    nodes = trie.Shard([(0, bytes(16), 0)] * 4, rows).nodes
    assert sorted((n[0], n[6], n[7]) for n in nodes) == [(0, 0b1111, 0), (1, 0b0111, 0b0100), (1, 0b1000, 0b1000), (2, 1, 1), (2, 2, 2)]


def test_prefix_hash_of_blocks():
    turns = [bytes([i, 255 - i]) * 8 for i in range(10)]
    whole = tail = 0
    for t in turns:
        whole = trie.extend(whole, t)
    head = 0
    for t in turns[:4]:
        head = trie.extend(head, t)
    for t in turns[4:]:
        tail = trie.extend(tail, t)
    assert whole == (head * pow(trie.BASE, 6, trie.PRIME) + tail) % trie.PRIME


def test_xxh64_of_every_length():
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 20_000, dtype=np.uint8)
    ends = np.array([*range(0, 300), 4095, 4096, 4097, 9000]) + 7
    starts = np.full(len(ends), 7)
    got = simhash.xxh64(data, starts, ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends)]


def test_fingerprint_is_the_same_in_pieces(monkeypatch):
    texts = pa.array([" ".join(f"w{i % 91} É{i}" for i in range(3000)), None, "", "one", "A b", "x" * 9000 + " y z"])
    whole = simhash.fingerprints(texts).tolist()
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprints(texts).tolist() == whole
    assert [f"{f:016x}" for f in whole] == [f for _, f, _ in brute.simhash(list(enumerate(texts.to_pylist())))]


@pytest.mark.parametrize("largest", [simhash.LARGEST, 2])
def test_simhash(spark, odd_docs, largest):
    for docs in (read(spark, SF001, "documents"), odd_docs, odd_docs.limit(0)):
        got = simhash.near_duplicates(docs, largest=largest).collect()
        got = sorted(((r.doc_id, f"{r.fingerprint & (1 << 64) - 1:016x}", r.component_id) for r in got), key=repr)
        assert got == sorted(brute.simhash([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]), key=repr)


@pytest.mark.parametrize("largest", [simhash.LARGEST, 10])
def test_links_of_dense_fingerprints(spark, largest):
    r = random.Random(1)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(40):
            base ^= 1 << r.randrange(64)
            values.add(base ^ (1 << r.randrange(64)))
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint bigint"), largest=largest).collect()
    mask = (1 << 64) - 1
    assert all(((e.a ^ e.b) & mask).bit_count() <= 2 for e in edges)

    def classes(pairs):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v
        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for v in values:
            groups.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    assert classes((e.a & mask, e.b & mask) for e in edges) == classes(near)


def test_bk_tree_finds_what_a_scan_finds():
    r = random.Random(2)
    values = list({r.getrandbits(10) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        assert sorted(tree.values[i] for i in tree.near(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_columns_of_the_contracts(spark):
    assert set(NODE) <= set(queries.op11_prefix_trie(spark, SF001).columns)
    assert set(AUDIT) <= set(queries.op13_structure_repair(spark, SF001).columns)
    assert {"doc_id", "fingerprint", "component_id"} <= set(queries.op12_simhash(spark, SF001).columns)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_structure_repair"])
def test_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF001}/conversations.parquet'")
    res = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert rows_of(queries.queries()[name](spark, SF001), *cols) == sorted(res.fetchall(), key=repr)
