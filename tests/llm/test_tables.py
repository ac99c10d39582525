"""The registered queries on whole tables, against brute force; and the pipeline on odd documents."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilespark.llm import chat, quality, queries, sharding, tokens, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


@pytest.fixture(scope="module")
def whole(spark):
    """The ids of each document of the small table, the text encoded at once, with the end id."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in documents(spark, SMALL)}


def test_op6_on_the_table(spark, whole):
    expected, start = [], 0
    for doc_id in sorted(whole):
        ids = whole[doc_id]
        expected.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op6_token_files"](spark, SMALL).collect())) == expected


def test_op9_on_the_table(spark, whole):
    rows = queries.QUERIES["op9_best_fit_packing"](spark, SMALL).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        assert 0 < r.length <= 2048 and r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length])
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    assert set(pieces) == set(whole)
    for doc_id, found in pieces.items():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found))) and sum(n for _, _, n in found) == len(whole[doc_id])
        assert all(n == 2048 for _, _, n in found[1:]) and [s for _, s, _ in found] == np.cumsum([0, *(n for _, _, n in found[:-1])]).tolist()
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == np.cumsum([0, *(n for _, n in found[:-1])]).tolist() and sum(n for _, n in found) <= 2048
    # No packing has fewer than the tokens need, nor than the pieces do that fill more than half.
    lengths = [r.length for r in rows]
    least = max(-(-sum(lengths) // 2048), sum(n > 1024 for n in lengths))
    assert len(places) <= 1.03 * least + 1


@pytest.mark.parametrize("sf", [SMALL, MIDDLE])
def test_op3_cuts_no_group_that_fits(spark, sf):
    rows = sharding.shard_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in documents(spark, sf)}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id])) for r in rows) and len(rows) == len(texts)
    sizes = collections.Counter(r.shard for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    groups = collections.defaultdict(set)
    for r in rows:
        groups[texts[r.doc_id]].add(r.shard)
    several = collections.Counter(texts.values())
    # All groups of these tables fit a shard, so the least cut is none.
    assert max(several.values()) <= min(sizes.values()) and any(n > 1 for n in several.values())
    assert all(len(shards) == 1 for shards in groups.values())


def test_op3_reaches_the_least_cut_of_small_instances(spark):
    """Groups of at most a shard that can be placed whole, by brute force; shards of six documents."""
    for seed, groups in enumerate(([4, 3, 2, 2, 1, 1, 2, 3, 6], [5, 5, 5, 5, 1, 1, 1, 1], [3, 3, 3, 3, 3, 3, 3, 3])):
        rows = [(100 * g + k, f"text {seed} {g}") for g, n in enumerate(groups) for k in range(n)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        found = sharding.shard_documents(frame, shards=4)
        cut = sharding.cut_links(found).first()

        def fits(left, rooms):
            return not left or any(r >= left[0] and fits(left[1:], (*rooms[:i], r - left[0], *rooms[i + 1 :])) for i, r in enumerate(rooms))

        assert fits(sorted(groups, reverse=True), (6, 6, 6, 6)) and cut["apart"] <= 1


def test_op7_holds_out_and_learns(spark):
    found = {r.doc_id: r for r in queries.QUERIES["op7_quality"](spark, MIDDLE).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if r.quality is not None}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in found.items())
    held = [i for i in labels if i in found and found[i].held_out]
    assert len(held) > 50 and np.mean([found[i].predicted == labels[i] for i in held]) >= 0.95


def test_op1_on_the_table(spark):
    """No clean labelled text is rejected but few, and most toxic ones are."""
    found = {r.doc_id: r for r in queries.QUERIES["op1_toxicity"](spark, MIDDLE).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert len(found) == len(documents(spark, MIDDLE))
    toxic, clean = ([found[i].rejected for i, t in labels.items() if t == k and i in found] for k in (1, 0))
    assert np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.01


def test_long_and_repeated_texts(spark):
    """Very long texts, runs without a space and repeated rows, through scores and chat."""
    long = "fine words in a row " * 60_000
    rows = [(1, long), (1, long), (2, "x" * 3_000_000), (3, "字" * 5000), (4, None), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in scored) == sorted(str(i) for i, _ in rows) and all(r.severity >= 0 for r in scored)
    scored = quality.score_quality(docs, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", "[" * 100_000)], "conv_id long, turn int, role string, text string")
    (digest,) = chat.chat_digest(turns).collect()
    assert digest.n_turns == 3 and digest.loss_chars == 100_000


def test_features_of_unspaced_scripts_and_long_words():
    inside = lambda part, text: set(toxicity.features(part.encode()).tolist()) & set(toxicity.features(text.encode()).tolist())
    assert inside("他是一个恶毒的人吗真的", "开头的一些文字" * 5 + "他是一个恶毒的人吗真的" + "后面的一些文字" * 5)
    assert not inside("全然不同", "开头的一些文字" * 5)
    ends = [toxicity.features(("a" * 70 + x).encode())[0] for x in "bc"]
    assert ends[0] != ends[1]


def test_pipeline_on_odd_documents(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, _slice int, row_id string, kept boolean"
    same = "one text of more than five words that is there more than once"
    rows = [(None, same), (1, same), (1, same), (2, None), (3, ""), (4, " \n"), (5, same + " "), (6, "long " * 9000), (7, "other words that nobody else has here at all"), (7, "and a second row of the same number")]
    table = spark.createDataFrame([(i, t, "en", "ab"[k % 2], len(t or ""), 1, 1.0, 2, "r", True) for k, (i, t) in enumerate(rows)], kind)
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", table), ("empty", table.limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        packed = corpus_pipeline.run(spark, folder)
        kept = packed.select("doc_id").distinct().collect()
        if name == "empty":
            assert kept == []
        else:
            # One row of the copies (the longest text), one of the empty ones, and the others, as the mix takes them.
            assert {r.doc_id for r in kept} <= {5, 2, 3, 4, 6, 7} and packed.agg(F.max("length")).first()[0] <= 2048
