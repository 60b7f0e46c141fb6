"""The chat operator, the registered queries on held-out truth, and the pipeline, stage by stage."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from depscope.llm import chat, linededup, queries, quality, tokens
from tests.llm.test_similar import survivors

DATA = "/root/testdata/sf0.001"
SAID = "</s>[INST] ok [/INST]"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a\\n\n[]/INST<>s|im_endart", max_size=40), st.text(max_size=20))
def test_turn_round_trip(text, role):
    for body in (text, f"<|im_end|>\n<|im_start|>{text}", "\\" + SAID):
        formatted, start, end = chat.format_turn(role, body)
        assert chat.parse_turn(formatted) == (role, body)
        assert chat.unescape(formatted[start:end]) == body
        assert not any(c in formatted[start:end] for c in chat.CONTROL)
        assert formatted.count(chat.CLOSE) == 1


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (4, 1, "assistant", None), (4, None, None, "x"), (5, 0, "user", SAID), (5, 0, "user", SAID),
]


def sorted_turns(rows, conv):
    own = [r for r in rows if r[0] == conv]
    return [(r[2] or "", r[3] or "") for r in sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]


def check_tree(spark, rows, extra=()):
    frame = turns(spark, rows)
    for name in extra:
        frame = frame.withColumn(name, F.lit("old"))
    tree, members = chat.prefix_tree(frame, queries.TOKENIZER)
    runs, leaf = tree.collect(), {r["conv_id"]: bytes(r["leaf"]) for r in members.collect()}
    pages = chat.stream(tree, 7).orderBy("page").collect()
    assert all(len(r["learn"]) == 7 for r in pages[:-1]) and [r["page"] for r in pages] == list(range(len(pages)))
    ids, positions = ([int.from_bytes(x[k : k + 4], "little") for x in [b"".join(r[c] for r in pages)] for k in range(0, len(x), 4)] for c in ("ids", "positions"))
    learn = b"".join(r["learn"] for r in pages)
    decode = tokens.encoder(queries.TOKENIZER).tokenizer.decode
    prefixes = {tuple(sorted_turns(rows, conv)[: k + 1]) for conv in leaf for k in range(len(sorted_turns(rows, conv)))}
    once = sum(len(b"".join(chat.tokenised([{"role": p[-1][0], "text": p[-1][1]}], tokens.encoder(queries.TOKENIZER))[0])) // 4 for p in prefixes)
    assert len(ids) == once  # every node once
    at, seen = 0, []
    for r in sorted(runs, key=lambda r: r["start"]):
        assert r["start"] == at  # no gaps
        at += r["n_tokens"]
        if r["ancestors"]:  # depth first: it goes on from what the run before it went on from
            assert [tuple(a) for a in r["ancestors"]][-1][1] <= r["start"] and r["ancestors"][0]["start"] in seen
        seen.append(r["start"])
    by_leaf = {bytes(r["leaf"]): r for r in runs}
    for conv in leaf:
        run = by_leaf[leaf[conv]]
        spans = [(a["start"], a["end"]) for a in run["ancestors"]] + [(run["start"], run["start"] + run["n_tokens"])]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:-1], strict=False))  # neighbours are joined
        places = [k for a, b in spans for k in range(a, b)]
        own = sorted_turns(rows, conv)
        assert decode([ids[k] for k in places], skip_special_tokens=False) == "".join(chat.format_turn(*t)[0] for t in own)
        assert [positions[k] for k in places] == list(range(len(places)))
        said = decode([ids[k] for k in places if learn[k]], skip_special_tokens=False)
        assert chat.unescape(said) == "".join(t for r, t in own if r == "assistant")
    back = {r["conv_id"]: r for r in chat.read_back(tree, members, queries.TOKENIZER, 5).collect()}
    assert set(back) == {r[0] for r in rows}
    for conv, r in back.items():
        own = sorted_turns(rows, conv)
        assert r["positions_hold"] and r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        learned = "".join(t for role, t in own if role == "assistant")
        assert (r["loss_sha256"], r["loss_chars"]) == (hashlib.sha256(learned.encode()).hexdigest(), len(learned))
        assert r["formatted_chars"] == sum(len(chat.format_turn(*t)[0]) for t in own)
    return runs


def test_prefix_tree(spark):
    check_tree(spark, ROWS, ("path", "leaf", "part", "ids", "start", "turns"))
    same = [(None, 0, "user", "hi"), (9, 0, "user", "hi"), (10, 0, "user", "hi"), (10, 1, "user", "é" * 30), (11, 3, "", "")]
    check_tree(spark, [*ROWS, *same])


def test_prefix_tree_over_many_parts(spark):
    pick = random.Random(3)
    rows = []
    for conv in range(120):  # few words, so that conversations branch at all depths
        rows += [(conv, k, "assistant" if k % 2 else "user", pick.choice("ab")) for k in range(pick.randrange(1, 9))]
    rows += [(1000 + c, k, "user", f"long {min(k, 18 + c)}") for c in range(12) for k in range(20)]
    runs = check_tree(spark, rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(str, check_tree(spark, rows))) == sorted(map(str, runs))  # the same stream, however it is cut
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_conversation(spark):
    turns_ = [(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(5000)]
    turns_ += [(2, k, r, t) for _, k, r, t in turns_[:4000]] + [(2, 4000, "user", "else")]
    tree, members = chat.prefix_tree(turns(spark, turns_), queries.TOKENIZER)
    assert max(len(r["ancestors"]) for r in tree.collect()) == 1
    back = {r["conv_id"]: r for r in chat.read_back(tree, members, queries.TOKENIZER).collect()}
    assert back[1]["n_turns"] == 5000 and back[2]["n_turns"] == 4001 and back[1]["positions_hold"] and back[2]["positions_hold"]


def test_prefix_tree_empty(spark):
    tree, members = chat.prefix_tree(turns(spark, []), queries.TOKENIZER)
    assert tree.count() == 0 and chat.read_back(tree, members, queries.TOKENIZER).count() == 0


def test_names():
    assert [k for n in range(1, 11) for k in queries.queries() if k.startswith(f"op{n}_")] == [
        next(k for k in queries.queries() if k.startswith(f"op{n}_")) for n in range(1, 11)
    ]
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


def test_language_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op1_language_id(spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[k] for k in order) for r in want.fetchall())


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, DATA)
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in verdict.items() if v}
    left = stages["line dedup"](spark, kept, DATA)
    want = {r["doc_id"]: r for r in linededup.dedup_lines(kept).collect()}
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {
        k: r["text"] for k, r in want.items() if r["n_removed"] < r["n_lines"] or not r["n_lines"]
    }
    single = stages["SimHash near-dedup"](spark, left, DATA)
    assert {r["doc_id"] for r in single.collect()} == survivors([(r["doc_id"], r["text"]) for r in left.collect()])
    mixed = stages["mixing to target weights"](spark, single, DATA)
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, single.collect()))
    for frame in (kept, left, single, mixed):
        assert frame.columns == corpus_pipeline.COLUMNS
    packed = stages["best-fit packing"](spark, mixed, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in single.collect()}
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_stages_on_odd_rows(spark):
    words = " ".join(f"plain{k}" for k in range(30))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, None, None, None, None), (None, words + " x", "en", None, 2), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("kept", "n_lines", "slot", "place", "block", "fp", "piece", "offset"):
        docs = docs.withColumn(extra, F.lit("old"))
    for table in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, DATA)
            assert k == 4 or out.columns == corpus_pipeline.COLUMNS
            n = out.count()
            assert n >= 0 if table is docs else n == 0
    kept = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1]
    assert corpus_pipeline.near_dedup(spark, docs, DATA).count() < docs.count()
    assert corpus_pipeline.source_mixing(spark, docs, DATA).count() == docs.count()
