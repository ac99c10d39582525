"""The corpus operators against brute force and SQL, and their defined cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import runpy
import zlib

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from tilespark.llm import chat, common, embedding_dedup, exact_dedup, mixing, ngram_join, packing, quality, queries, sharding, token_files, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, kept string, row_id string, n string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *(1, 2, "a", "b", "c")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = " ".join(words[(i * i) % 12] + str(i) for i in range(6000))
    rows = [(None, "alpha beta", "a"), (1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, "alpha beta", "b"), (4, "alpha beta", "b"), (5, "alpha  beta ", None), (6, long, "c"), (7, long + " end", "c"), (8, "mu", "é"), (4, "gamma", "z"), (9, " ".join(words), "a"), (10, " ".join(words), "a")]
    return rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


# ---- exact dedup ----
def test_quotient_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 40, 5000).astype(np.uint64)
    keys = np.concatenate([keys, keys[:700], keys[:70]])
    parts = [exact_dedup.CountingQuotientFilter.build(p, bits=40) for p in np.array_split(rng.permutation(keys), 7)]
    merged = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.from_bytes(p.to_bytes()) for p in parts], bits=40)
    found, n = merged.items()
    expected = collections.Counter(keys.tolist())
    assert dict(zip(found.tolist(), n.tolist())) == expected
    assert all(merged.count(k) == expected[k] for k in keys[:200].tolist()) and merged.count(12345) == expected.get(12345, 0)
    empty = exact_dedup.CountingQuotientFilter.build(np.zeros(0, np.uint64))
    assert len(exact_dedup.CountingQuotientFilter.from_bytes(empty.to_bytes()).items()[0]) == 0


def bare(text):
    return re.sub(r"[ \t-\r]", "", text or "")


def test_exact_dedup_of_odd_rows(spark, odd):
    found = exact_dedup.exact_dedup(docs(spark, odd)).collect()
    assert len(found) == len(odd)
    groups = collections.defaultdict(list)
    for i, t, _ in odd:
        groups[hashlib.sha256(bare(t).encode()).hexdigest()].append((-len(t or ""), i is None, i if i is not None else 0))
    for r in found:
        group = groups[r.text_sha256]
        best = min(group)
        assert r.group_size == len(group) and r.keep_id == (None if best[1] else best[2])
    kept = collections.Counter(r.text_sha256 for r in found if r.kept)
    assert kept == dict.fromkeys(groups, 1)
    stay = exact_dedup.keep_one(docs(spark, odd))
    assert stay.columns == docs(spark, odd).columns
    assert sorted(bare(r.text) for r in stay.collect()) == sorted({bare(t) for _, t, _ in odd})


def test_repeated_fingerprint_of_different_texts_is_told_apart_by_bytes(spark, monkeypatch):
    rows = [(i, f"text {i // 2}", "a") for i in range(8)]
    monkeypatch.setattr(exact_dedup, "BROADCAST_FINGERPRINTS", -1)  # the shuffled way
    assert sum(r.kept for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()) == 4


# ---- n-gram join ----
def shingles(text, n=5):
    w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def links_of(rows, threshold=0.8):
    """Per row: number of links and the places of its class, by comparing all pairs."""
    sets = [shingles(t) for _, t, _ in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * len(sets[a] | sets[b]):
            n[a] += 1
            n[b] += 1
            parent[root(b)] = root(a)
    classes = collections.defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(i)
    return n, [classes[root(i)] for i in range(len(rows))]


def check_join(spark, rows):
    n, classes = links_of(rows)
    found = ngram_join.jaccard_join(docs(spark, rows)).collect()
    name = lambda c: min(((rows[i][0] is None, rows[i][0] or 0) for i in c))
    expected = collections.Counter((rows[i][0], None if name(c)[0] else name(c)[1], n[i]) for i, c in enumerate(classes))
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in found) == expected
    assert sum(r.kept for r in found) == len({tuple(c) for c in classes})


def test_join_of_odd_rows(spark, odd):
    check_join(spark, odd)
    stay = ngram_join.keep_one(docs(spark, odd))
    assert stay.columns == docs(spark, odd).columns and stay.count() == len({tuple(c) for c in links_of(odd)[1]})


def test_join_of_a_large_group_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = base[:]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(words), "a"))
    rows += [(1000 + i, " ".join(f"y{i}_{k}" for k in range(50)), "a") for i in range(20)]
    monkeypatch.setattr(ngram_join, "BROADCAST_CANDIDATES", -1)  # texts are shuffled to the candidates
    check_join(spark, rows)


def test_depth_keeps_the_recall():
    forest = ngram_join.Forest()
    d = forest.matched_depth()
    promise = lambda k: 1 - (1 - 0.8**k) ** forest.trees
    assert promise(d) >= forest.recall and (d == forest.depth or promise(d + 1) < forest.recall)


@pytest.mark.parametrize("values", [2, 30])
def test_tries_hold_the_nodes_of_every_depth(spark, monkeypatch, values):
    """Few digit values make large nodes, which reach over several tasks."""
    monkeypatch.setattr(ngram_join, "ROWS_PER_TASK", 20)
    rng = np.random.default_rng(values)
    forest = ngram_join.Forest(trees=2, depth=8)
    digits = rng.integers(0, values, (80, 16)).astype("<u2")
    digits[40:] = np.where(rng.random((40, 16)) < 0.1, digits[40:], digits[:40])
    digits[1:20] = digits[0]
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(digits)], "rep long, signature binary")
    rows = [r.asDict() for r in ngram_join._grow(frame, forest).collect()]
    for tree in range(2):
        for x in range(forest.shortest, 9):
            found = collections.defaultdict(set)
            for r in rows:
                if r["tree"] == tree:
                    found[r[f"d{x}"]].add(r["rep"])
            expected = collections.defaultdict(set)
            for i, d in enumerate(digits):
                expected[d[8 * tree : 8 * tree + x].tobytes()].add(i)
            several = lambda groups: {frozenset(g) for g in groups.values() if len(g) > 1}
            assert several(found) == several(expected)


def test_nodes_of_tasks_of_one_row_are_joined_without_joins(spark, monkeypatch):
    forest = ngram_join.Forest(trees=1, depth=8)
    label = bytes(range(16))
    # Each task holds one set of the same node, but for the last two: there the node ends at depth 5.
    rows = [(0, k, label if k < 6 else label[:10] + b"other.") for k in range(8)]
    frame = spark.createDataFrame([(t, k, bytearray(x)) for t, k, x in rows], "tree int, rep long, label binary").repartitionByRange(8, "rep")
    names = [f"d{x}" for x in range(forest.shortest, 9)]
    found = frame.mapInArrow(ngram_join._tries(forest), f"tree int, rep long, {', '.join(f'{x} long' for x in names)}, label binary, last boolean, part int")
    found = common.materialize(found, "test-tries")
    assert found.groupBy("part").count().where("count = 1").count() >= 6
    plans = []
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or common.materialize(df, name))
    out = ngram_join._across_tasks(found, forest)
    plans.append(out._jdf.queryExecution().toString())
    assert {r.rep: [r[x] for x in names] for r in out.collect()} == {k: [0] * 6 if k < 6 else [0] * 3 + [6] * 3 for k in range(8)}
    assert not [p for p in plans if "Join" in p]


def test_prefixes_are_shortened_until_the_recall(spark):
    """Six trees find most links of a group near the threshold only by shorter prefixes."""
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(100)]
        for k in range(12):
            words = base[:]
            for at in rng.sample(range(0, 100, 6), rng.randint(0, 2)):
                words[at] = f"x{rng.random()}"
            rows.append((100 * g + k, " ".join(words), "a"))
    expected, _ = links_of(rows)
    forest = ngram_join.Forest(trees=6, recall=0.8)
    assert forest.matched_depth() > forest.shortest
    found = {r.doc_id: r.n_links for r in ngram_join.jaccard_join(docs(spark, rows), forest).collect()}
    assert all(found[i] <= n for (i, _, _), n in zip(rows, expected))
    assert sum(found.values()) >= 0.98 * sum(expected) > 0


def test_join_of_the_table_finds_all_links(spark):
    """The query itself on 1,000 documents, against an inverted index over all shingles."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = [shingles(t) for _, t in rows]
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    both = collections.Counter(p for holders in where.values() for p in itertools.combinations(holders, 2))
    expected = collections.Counter({i: 0 for i, _ in rows})
    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            expected[rows[a][0]] += 1
            expected[rows[b][0]] += 1
    found = queries.QUERIES["op5_ngram_join"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.n_links for r in found} == dict(expected) and sum(expected.values()) > 100


def test_words_do_not_depend_on_segments(monkeypatch):
    text = (" ".join(f"wörd{i}" for i in range(500)) + "\n\n tail").encode()
    whole = ngram_join.shingle_set(text)
    monkeypatch.setattr(ngram_join, "SEGMENT", 37)
    assert (ngram_join.shingle_set(text) == whole).all() and len(whole) == 497


# ---- embeddings ----
def test_short_words_hash_alike_before_and_after_longer_ones():
    fresh = runpy.run_module("tilespark.llm.ngram_join")
    first = fresh["shingle_set"](b"a b c d e f").tolist()
    fresh["shingle_set"](b"a longer word")
    assert fresh["shingle_set"](b"a b c d e f").tolist() == first


def test_embeddings_of_the_table(spark):
    """The query itself, whose labels have several cells each, against brute force."""
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    vectors = spark.createDataFrame([(i, 0, len(e), np.array(e, "<f4").tobytes(), 1) for i, _, e in rows if e], "rep long, label long, dim int, vector binary, copies long")
    cells = embedding_dedup._members(vectors, 0.2).groupBy("label").agg(F.countDistinct("c").alias("cells")).collect()
    assert min(r.cells for r in cells) > 1
    unit = {i: (label, np.array(e, float) / np.linalg.norm(e)) for i, label, e in rows if e and label is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    for threshold, found in ((0.98, queries.QUERIES["op2_embedding_dedup"](spark, "/root/testdata/sf0.01")), (0.3, embedding_dedup.embedding_dedup(table, 0.3))):
        expected = {i: 0 for i, _, _ in rows}
        for (i, (a, x)), (j, (b, y)) in itertools.combinations(unit.items(), 2):
            if a == b and len(x) == len(y) and float(x @ y) >= threshold:
                expected[i] += 1
                expected[j] += 1
        assert {r.vec_id: r.n_links for r in found.collect()} == expected
    assert sum(expected.values()) > 20


@pytest.mark.parametrize("roots", [6, 1])
def test_embeddings(spark, monkeypatch, roots):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = []
    for k in range(160):
        v = base[k % 40] + rng.normal(size=8) * 0.12 * (k >= 40)
        rows.append((k, [float(x) for x in v], int(k % 2)))
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 8, 0), (205, [float("nan")] * 8, 0), (206, [None] * 8, 0), (207, [], 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0), (None, [1.0, 2.0], 0), (211, [1e200] * 8, 1), (212, [1e-200] * 8, 1)]
    monkeypatch.setattr(embedding_dedup, "ROOTS_PER_CELL", roots)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, component_id string")
    found = embedding_dedup.embedding_dedup(frame).collect()
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() if ok(v) else None for _, v, _ in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    near = [{j for j in range(len(rows)) if i != j and rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98} for i in range(len(rows))]
    expected = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        expected.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    assert sum(e[1] for e in expected) > 50
    assert collections.Counter(tuple(r) for r in found) == collections.Counter(expected)
    assert embedding_dedup.embedding_dedup(frame.limit(0)).count() == 0


# ---- sharding ----
@pytest.mark.parametrize("copies", [0, 300])
def test_sharding(spark, odd, copies):
    rows = odd + [(100 + i, f"single {i}", "a") for i in range(80)] + [(500 + i, "the same", "a") for i in range(copies)]
    found = sharding.shard_documents(docs(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32, r.size) for r in found) == sorted((i is None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t, _ in rows)
    shards = collections.defaultdict(list)
    for r in found:
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_small_groups_are_not_cut(spark):
    rows = [(i, f"text {i // 3}" if i < 300 else f"single {i}", "a") for i in range(2400)]
    (cut,) = sharding.cut_links(sharding.shard_documents(docs(spark, rows))).collect()
    assert cut.groups == 100 and cut.apart == 0


# ---- mixing ----
def test_copies_follow_their_group(spark):
    # Shards of 250: half a shard of copies, and a third of all rows, for which 9 shards do.
    rows = [(i, "half" if i < 125 else "third" if i < 2125 else f"text {i}", "a") for i in range(6000)]
    found = sharding.shard_documents(docs(spark, rows), shards=24)
    in_shards = collections.defaultdict(set)
    for r in found.where("doc_id < 2125").collect():
        in_shards[r.doc_id < 125].add(r.shard)
    assert len(in_shards[True]) == 1 and len(in_shards[False]) <= 9
    cut = sharding.cut_links(found).first()
    assert (cut.groups, cut.linked) == (2, 2125) and cut.apart <= 2000 - 240


def test_targets(spark):
    for sizes in ({"a": 100, "b": 1, "c": 7, None: 3}, {"a": 5}, {"a": 0, "b": 0}, {f"s{i:02}": i * i for i in range(30)}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: 1 + i % 3 for i, s in enumerate(order)}
        stopped, total = set(), sum(sizes.values())
        while True:
            rest = [s for s in order if s not in stopped]
            left = total - sum(3 * sizes[s] for s in stopped)
            target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
            over = {s for s in rest if target[s] > 3 * sizes[s]}
            if not over:
                break
            stopped |= over
        expected = target | {s: 3 * sizes[s] for s in stopped}
        assert found == pytest.approx(expected)


def test_mix(spark, odd):
    frame = docs(spark, odd)
    digest = mixing.mix_digest(frame).collect()
    assert len(digest) == len(odd) and digest and sorted(map(str, digest)) == sorted(map(str, mixing.mix_digest(frame).collect()))
    assert all(0 <= r.taken <= 3 * r.size for r in digest)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r.text) for r in mixed.collect()) == sum(r.taken for r in digest)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "word " * (1 + i % 7), f"s{i % 4}") for i in range(8000)]
    per = mixing.mix_digest(docs(spark, rows)).withColumn("s", F.col("doc_id") % 4).groupBy("s").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) < 0.03 * r.g for r in per)


# ---- tokens ----
def odd_texts():
    rng = random.Random(3)
    out = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a\n\n\nb", "x\t y", "<|endoftext|> a <|endoftext|>", "it's  don't", "a  b  c", "a \x1cb", "日本 語  x", "a . b ..  ...c", "🙂 🙂", "x²y ²"]
    for alphabet in (list(" \n\ta.,1é'sé \x1c　x"), ["thé", "ab", "ñ", "ing", "é", "ß", "ǅ", "日", "x.", " ", " ", ", ", "\n", "'s"]):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return out


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return [np.array(e.ids, "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("remembered", [1 << 20, 50])
def test_words_encode_like_whole_texts(remembered):
    texts = odd_texts()
    own = tokens.WordEncoder(tokens.default_tokenizer(), remembered)
    found = [x for i in range(0, len(texts), 500) for x in own.encode(texts[i : i + 500])]
    assert [np.frombuffer(f, own.dtype).tolist() for f in found] == [w.tolist() for w in whole_ids(texts)]


def test_texts_split_in_parts_encode_alike(monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    texts = odd_texts()
    own = tokens.WordEncoder(tokens.default_tokenizer())
    assert [np.frombuffer(f, own.dtype).tolist() for f in own.encode(texts)] == [w.tolist() for w in whole_ids(texts)]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 5], list(range(1000)), np.cumsum(rng.integers(0, 5000, 3000)).tolist(), [0, 2**62], [0] * 300 + [10**9]):
        ef, size = token_files.EliasFano.from_buffer(memoryview(token_files.EliasFano.build(np.array(values, np.uint64)).to_bytes() + b"rest"))
        assert ef.values().tolist() == values
        assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7]
    dense = token_files.EliasFano.build(np.cumsum(rng.integers(0, 600, 100_000)).astype(np.uint64))
    assert 8 * len(dense.to_bytes()) < 100_000 * (2 + math.log2(300) + 1)


def test_token_files(spark, odd):
    found = token_files.read_digests(token_files.write_token_files(docs(spark, odd), tokens.default_tokenizer())).collect()
    texts = sorted({r[1] for r in odd if r[1] is not None})
    tie = {r.t: r.h for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    start, expected = 0, []
    for (i, _, _), ids in zip(order, whole_ids([r[1] or "" for r in order])):
        ids = np.append(ids, 0).astype("<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected
    assert token_files.read_digests(token_files.write_token_files(docs(spark, odd).limit(0), tokens.default_tokenizer())).count() == 0


def test_token_files_of_few_ids(spark, odd, monkeypatch):
    rows = docs(spark, odd)
    whole = sorted(map(tuple, token_files.read_digests(token_files.write_token_files(rows, tokens.default_tokenizer())).collect()), key=str)
    monkeypatch.setattr(token_files, "FILES_PER_SUM", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        manifest = token_files.write_token_files(rows, tokens.default_tokenizer())
        assert manifest.count() == 3
        assert sorted(map(tuple, token_files.read_digests(manifest).collect()), key=str) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_writer_begins_new_files(spark, odd, monkeypatch):
    batch = spark.createDataFrame([(i, t) for i, t, _ in odd if i is not None], "doc_id long, text string").orderBy("doc_id").toArrow().to_batches()
    put = {}
    monkeypatch.setattr(token_files, "_put", put.__setitem__)
    monkeypatch.setattr(token_files, "DOCUMENTS_PER_FILE", 3)
    monkeypatch.setattr(token_files, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda s: 1, "taskAttemptId": lambda s: 2})())}))
    rows = [r for b in token_files._writer("x:", tokens.default_tokenizer())(iter(batch)) for r in b.to_pylist()]
    files = [token_files.TokenFile(put[r["path"]]) for r in rows]
    assert [len(f) for f in files] == [r["n_documents"] for r in rows] and max(map(len, files)) == 3 and len(files) == len(put) == 4
    assert [i for f in files for i in f.doc_ids] == [i for b in batch for i in b["doc_id"].to_pylist()]
    assert [d.tolist() for f in files for d in map(f.document, range(len(f)))] == [[*w.tolist(), 0] for w in whole_ids([t or "" for b in batch for t in b["text"].to_pylist()])]


def test_one_document_of_a_file():
    data = token_files.TokenFile.encode([None, -5, 7, 7], [np.arange(n, dtype="<u2").tobytes() for n in (3, 1, 0, 900)], np.dtype("<u2"))
    file = token_files.TokenFile(data)
    assert file.doc_ids == [None, -5, 7, 7] and [len(file.document(i)) for i in range(4)] == [3, 1, 0, 900]
    assert file.document(3).tolist() == list(range(900))


# ---- packing ----
def fewest(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + items[i] <= capacity:
                k = bins.index(room)
                go(i + 1, [*bins[:k], room + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_fewest():
    rng = random.Random(5)
    for _ in range(600):
        capacity = rng.randint(5, 30)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, left = packing.reduce_by_dominance(dict(collections.Counter(items)), capacity)
        assert all(sum(a * b for a, b in p.parts) <= capacity for p in fixed)
        used = collections.Counter(left)
        for p in fixed:
            for length, many in p.parts:
                used[length] += many * p.times
        assert used == collections.Counter(items)
        rest = sorted(collections.Counter(left).elements(), reverse=True)
        assert sum(p.times for p in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)


def test_plan_is_tight_and_bounded():
    lengths = np.clip(np.random.default_rng(1).lognormal(6.5, 1.1, 200_000), 1, 2048).astype(int)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    rows = packing.plan(counts)
    assert len(rows) < 12 * 2048 and rows[:, 3].max() + 1 <= 1.001 * math.ceil(lengths.sum() / 2048) + 1
    assert len(packing.plan({})) == 0


def test_pack(spark, odd):
    rows = odd + [(100 + i, "same length", "a") for i in range(300)]
    frame = docs(spark, rows)
    packed = packing.pack(frame, tokens.default_tokenizer(), with_ids=True)
    found = packed.collect()
    expected = collections.Counter()
    for (i, _, _), ids in zip(rows, whole_ids([r[1] or "" for r in rows])):
        ids = np.append(ids, 0).astype("<u4")
        bounds = packing.cut(len(ids))
        for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
            expected[i, k, a, z - a, zlib.crc32(ids[a:z])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r.length for r in found) / 2048) + 1
    seqs = packing.sequences(packed).collect()
    assert len(seqs) == len(by) and all(len(s.ids) == 4 * s.n_tokens for s in seqs)
    assert packing.pack(frame.limit(0), tokens.default_tokenizer()).count() == 0


# ---- chat ----
def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said + "\\b\\"), (2, 0, "system", None), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "assistant", "x"), (4, 0, None, "t"), (4, 1, "to<o>l", "\\<<ROLE:x>>"), (None, None, "user", "u"), (5, 0, "user", "a"), (5, 0, "user", "a")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    found = {r.conv_id: r for r in chat.chat_digest(frame).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in found.items()} == {1: True, 2: True, 3: False, 4: False, None: False, 5: False}
    assert chat.chat_digest(frame.limit(0)).count() == 0


# ---- toxicity, quality ----
def test_ordinal_regression_finds_grades():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    score = x @ np.array([3.0, -2.0, 0.0]) + rng.logistic(size=3000)
    grades = np.searchsorted([0, 2, 4], score)
    w, t = toxicity.fit_ordinal(toxicity.Sparse.of(x), grades)
    assert (np.diff(t) > 0).all() and abs(w[0] / w[1] + 1.5) < 0.25 and abs(w[2]) < 0.3


def test_toxicity(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "ka lo mi ne pu ra so ti".split() for b in "bar del fun gor".split()]
    text = lambda bad: " ".join([*(rng.choice(words) for _ in range(40)), *(rng.choice(["vileness", "vilest", "scorned"]) for _ in range(bad))])
    rows = [(i, text(3 * (i % 4 == 0)), "a") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5000, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs(spark, rows), labels)
    frame = docs(spark, [*rows, (900, None, "a"), (901, "", "a"), (902, "vilely vile. " * 3, "a"), (None, "kabar", "a")])
    found = toxicity.score_toxicity(frame, model).collect()
    wrong = [r for r in found if r.doc_id is not None and r.doc_id < 600 and r.rejected != (r.doc_id % 4 == 0)]
    assert not wrong and all(0 <= r.severity <= 3 for r in found)
    other = {r.doc_id: r.rejected for r in found if r.doc_id is None or r.doc_id >= 600}
    assert other == {900: False, 901: False, 902: True, None: False}
    stay = toxicity.reject_toxic(frame, model)
    assert stay.columns == frame.columns and stay.count() == len([r for r in found if not r.rejected])
    none = toxicity.fit_toxicity(docs(spark, rows), labels.where("toxic = 0"))
    assert {r.rejected for r in toxicity.score_toxicity(frame, none).collect()} == {False}
    assert toxicity.score_toxicity(frame.limit(0), model).count() == 0


def test_labels_without_documents_do_not_use_up_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 60)
    monkeypatch.setattr(toxicity, "OTHER_ROWS", 120)
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioklmnprst") for _ in range(8)) for _ in range(2000)]
    rows = [(i, " ".join([*(rng.choice(words) for _ in range(40)), *["vilest"] * 3 * (i % 3 == 0)]), "a") for i in range(180)]
    # A hundred labels for each one whose document is there.
    labels = spark.range(18000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit_toxicity(docs(spark, rows), labels)
    found = {r.doc_id: r.rejected for r in toxicity.score_toxicity(docs(spark, rows), model).collect()}
    assert found == {i: i % 3 == 0 for i in range(180)}


def test_toxic_words_that_clean_texts_hold_once(spark):
    rng = random.Random(4)
    # So many words that no text looks like a near copy of another.
    words = ["".join(rng.choice("aeioklmnprst") for _ in range(8)) for _ in range(2000)]

    def text(i):
        # One toxic text in ten is of a second language, whose word stands once in some clean texts.
        bad = ["bomente"] * rng.randint(3, 9) if i % 100 == 0 else ["vilest"] * 3 if i % 10 == 0 else ["bomente"] * (i % 67 == 1)
        said = [*(rng.choice(words) for _ in range(40)), *bad]
        rng.shuffle(said)
        return " ".join(said)

    rows = [(i, text(i), "a") for i in range(4000)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(3000)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs(spark, rows), labels)
    found = {r.doc_id: r.rejected for r in toxicity.score_toxicity(docs(spark, rows[3000:]), model).collect()}
    assert [i for i, rejected in found.items() if rejected != (i % 10 == 0)] == []


def test_isotonic():
    places, rates = quality.isotonic(np.arange(6.0), np.array([1, 0, 2, 1, 3, 4.0]), np.array([4, 4, 4, 4, 4, 4.0]))
    assert (np.diff(rates) > 0).all() and rates[0] == pytest.approx(1 / 8)


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(80)) + "."
    bad = lambda: " ".join(f"{rng.choice('ABCDEFGH') * 4}!!" for _ in range(80))
    rows = [(i, good() if i % 3 else bad(), "a") for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(500)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark, [*rows, (900, None, "a"), (901, "", "a"), (None, "x", "a")])
    found = quality.score_quality(frame, labels).collect()
    held = [r for r in found if r.held_out and r.doc_id < 500]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert len(held) > 100 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found) and len(found) == 503
    assert {r.score for r in quality.score_quality(frame, labels.limit(0)).collect()} == {0.5}


# ---- shared helpers, queries, pipeline ----
def test_ranks_and_components(spark):
    frame = spark.range(500).withColumn("g", (F.col("id") % 3).cast("int"))
    ranks = collections.defaultdict(list)
    for r in common.ranked(frame, ["g"], [F.col("id")], 16, ["id"]).collect():
        ranks[r.g].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    path = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (7, 7)]
    found = dict(tuple(r) for r in common.connected_components(spark.createDataFrame(path, "a long, b long"), "t").collect())
    assert found == dict.fromkeys(range(41), 0) | {50: 50, 60: 50, 100: 50}
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_empty_tables(spark):
    none = docs(spark, [(1, "x", "a")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for found in (exact_dedup.exact_dedup(none), exact_dedup.keep_one(none), ngram_join.jaccard_join(none), ngram_join.keep_one(none), sharding.shard_documents(none), mixing.mix_digest(none), mixing.mix(none), quality.score_quality(none, labels), toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels))):
        assert found.count() == 0


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = frame.collect()
        frame = common.materialize(stage(spark, frame, SF), "test-stage")
        after = frame.collect()
        if k < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:
            labelled = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
            clean = [r for r in before if labelled.get(r.doc_id) == 0]
            assert len({r.doc_id for r in clean} & {r.doc_id for r in after}) >= 0.97 * len(clean)
        elif k == 1:
            assert collections.Counter(bare(r.text) for r in after) == dict.fromkeys({bare(r.text) for r in before}, 1)
        elif k == 2:
            _, classes = links_of([(r.doc_id, r.text, r.source) for r in before])
            assert sorted(r.doc_id for r in after) == sorted({min(before[i].doc_id for i in c) for c in classes})
        elif k == 3:
            digest = mixing.mix_digest(spark.createDataFrame(before)).collect()
            assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in after) == sum(r.taken for r in digest)
        else:
            ids = whole_ids([r.text for r in before])
            assert sum(r.length for r in after) == sum(len(x) + 1 for x in ids)
