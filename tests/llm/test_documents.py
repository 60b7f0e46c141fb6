"""Document operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depscope.llm import langid, linededup, mixing, packing, private, quality, queries, similar, simhash, tokens, urls

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k}" for k in range(20000))
ROWS = [
    (1, "One line of words that two documents share here.\nown text a b c", "en", "s0", 1),
    (2, "One line of words that two documents share here.\nother text d e f", "en", "s0", 2),
    (2, "One line of words that two documents share here.\nother text d e f", "en", "s0", 2),
    (3, None, None, None, None),
    (None, "", "en", "s1", 0),
    (4, LONG, "fr", "s1", None),
    (None, "  \n\t ", None, None, 1),
    (5, "One line of words that two documents share here.\nother text d e f", "de", None, 2),
]


def docs(spark, rows=None, extra=()):
    frame = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    for name in extra:
        frame = frame.withColumn(name, frame["doc_id"] * 0)
    return frame


# --- quality rules


def counts_of(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            hit |= set(range(k, k + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b cc # *d \n é\t".split(" ")) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = ROWS + [(100 + k, t, "en", f"s{k % 3}", 0) for k, t in enumerate(texts)]
    got = quality.quality(docs(spark, rows, ["kept", "n_words", "n_lines"])).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in quality.COUNTS) == counts_of(r["text"])
        n, *_, repeat = counts_of(r["text"])
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_host_verdict(spark):
    clean = "plain words " + " ".join(f"word{k}" for k in range(20))
    doubtful = clean + " ### #"
    rows = [(k, doubtful, "en", "bad", 0) for k in range(40)] + [(100, clean, "en", "bad", 0)]
    rows += [(200 + k, clean, "en", "good", 0) for k in range(40)] + [(300, doubtful, "en", "good", 0)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs(spark, rows, ["above"])).collect()}
    assert not any(kept[k] for k in range(40)) and kept[100] and kept[300] and all(kept[200 + k] for k in range(40))


def verdicts_by_force(failed):
    """Strict hosts of {host: (documents, failures)}: moments of the hosts' rates, then each posterior."""
    n, k = (sum(v[x] for v in failed.values()) for x in (0, 1))
    mean = k / n
    between = sum(a * (b / a - mean) ** 2 for a, b in failed.values()) / n - mean * (1 - mean) * len(failed) / n
    strength = 1000 if between <= 0 else min(1000, max(1, mean * (1 - mean) / between - 1))
    out = set()
    for host, (a, b) in failed.items():
        alpha, beta = b + strength * mean, a - b + strength * (1 - mean)
        rate = alpha / (alpha + beta)
        deviation = (alpha * beta / (alpha + beta) ** 2 / (alpha + beta + 1)) ** 0.5
        if 0.5 * (1 + math.erf((rate - mean) / deviation / 2**0.5)) > 0.95:
            out.add(host)
    return out


@pytest.mark.parametrize("most", [8 << 20, -1])
def test_quality_verdicts_of_real_documents(spark, most, monkeypatch):
    """One source of the test table gets symbols into most of its texts: its verdict alone is strict."""
    monkeypatch.setattr(quality, "BROADCAST_BYTES", most)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    signs = F.when((F.col("source") == "src3") & (F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0), F.concat("text", F.repeat(F.lit(" | #"), (F.size(F.split("text", " ")) / 12).cast("int"))))
    got = quality.quality(table.withColumn("text", F.coalesce(signs, F.col("text")))).collect()
    failed = {}
    for r in got:
        n, k = failed.get(r["source"], (0, 0))
        failed[r["source"]] = (n + 1, k + bool(r["base_failed"] or r["n_soft"] or r["n_hard"]))
    strict = verdicts_by_force(failed)
    assert {r["source"] for r in got if r["host_verdict"] == "strict"} == strict and "src3" in strict and len(strict) < 5
    for r in got:
        assert r["kept"] == (not (r["base_failed"] or r["n_hard"] or (r["n_soft"] and r["source"] in strict)))
    assert any(r["n_soft"] and not r["n_hard"] and not r["base_failed"] and not r["kept"] for r in got)
    assert any(r["n_soft"] and r["kept"] for r in got)


def test_quality_empty(spark):
    assert quality.quality(docs(spark, [])).collect() == []


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(k, m[0])]
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.. -+@ab()_%é\n", max_size=60))
def test_base_kinds_as_their_grammars(text):
    assert [s for s in private.find(text) if s[1] < 4] == base_spans(text)


def test_method_kinds_and_columns(spark):
    text = 'token = "1eb9c654e721" and ftp://me:pw@host.org/x IBAN: GB82WEST12345698765432 IBAN: GB82WEST12345698765431'
    spans = [(text[a:b], k) for a, _, b, k in private.find(text) if k in ("login", "account")]
    assert spans == [("1eb9c654e721", "account"), ("ftp://me:pw@host.org", "login"), ("GB82WEST12345698765432", "account")]
    got = private.personal_data(docs(spark, extra=["n_email", "spans"])).collect()
    assert len(got) == len(ROWS)
    nothing = hashlib.sha256(b"").hexdigest()
    assert next(r for r in got if r["text"] is None)["base_sha256"] == nothing
    assert private.redact("a x@y.zz b", private.find("a x@y.zz b")) == "a [email] b"


# --- line dedup


def test_line_dedup_blocks():
    """One pair by hand; tests/llm/test_line_dedup_whole.py has the whole operator against its definition."""
    earlier = [f"line number {k} with enough words" for k in range(6)]
    later = ["head of the later one stays here", *earlier[1:4], "The.", *earlier[4:], "The."]
    page = {"n": False, "d": 1, "t": 0, "page": 0, "lines": linededup.line_hashes([x.encode() for x in earlier])}
    assert linededup.without("\n".join(later), [page], 5)[0] == "head of the later one stays here\nThe.\nThe."
    assert linededup.increasing([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]


def test_line_dedup_empty(spark):
    assert linededup.dedup_lines(docs(spark, [])).collect() == []


# --- fingerprints and near-duplicates


def fingerprint_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB ç\n\t xy", max_size=50))
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == fingerprint_by_force(text)


def linked_by_force(prints):
    parent = np.arange(len(prints))
    for k in range(len(prints)):
        near = np.nonzero(np.bitwise_count(prints ^ prints[k]) <= 3)[0]
        parent = simhash.join_links(parent, np.full(len(near), k), near)
    return simhash.find_roots(parent)


@pytest.mark.parametrize(("target", "leaves"), [(40, 16384), (40, 4), (400, 16384), (400, 1), (100_000, 16384)])
def test_links_lose_nothing(spark, target, leaves):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 800, dtype=np.uint64)
    near = base[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    dense = base[0] ^ (np.uint64(1) << rng.integers(0, 9, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 9, 200).astype(np.uint64))
    prints = np.unique(np.concatenate([base, near, dense]))
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    edges = simhash.links(frame, target=target, max_leaves=leaves).collect()
    at = {int(p): k for k, p in enumerate(prints.view(np.int64))}
    a, b = (np.array([at[e[k]] for e in edges]) for k in (0, 1))
    assert np.array_equal(simhash.find_roots(simhash.join_links(np.arange(len(prints)), a, b)), linked_by_force(prints))


def test_a_search_enters_few_shards():
    """What each fingerprint costs: a hundred leaves or thousands a tree, not the larger part of them."""
    rng = np.random.default_rng(1)
    sample, asked = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (65536, 2000))
    for leaves, most in ((100, 8), (16384, 16)):
        sent = 0
        for half in (0, 1):
            tree, _ = simhash.fit_tree(sample, len(sample) / leaves, half=half)
            homes = np.zeros(len(asked), int)
            for _, idx, home in simhash.visits(tree, asked, 1):
                sent += len(idx)
                homes[idx[home]] += 1
            assert (homes == 1).all()
        assert sent / len(asked) < most


def test_near_duplicates(spark):
    got = simhash.near_duplicates(docs(spark, extra=["fp", "component_id"])).collect()
    assert len(got) == len(ROWS)
    by_text = {r[1]: fingerprint_by_force(r[1]) for r in ROWS}
    assert Counter(r["fingerprint"] for r in got) == Counter(f"{by_text[r[1]]:016x}" for r in ROWS)
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 5)} == {2}
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {3}
    kept = simhash.one_of_each(docs(spark)).collect()
    assert sorted((r["doc_id"] for r in kept)) == [1, 2, 3, 4]
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


# --- packing


def test_ids_are_the_tokenizers():
    own, encoder = Tokenizer.from_file(PATH), tokens.encoder(PATH)
    rng = random.Random(2)
    odd = ["", " ", "  a", "a<|endoftext|> b", "don't x", "​ y", LONG, "é́ 中文 🙂"]
    odd += ["".join(chr(rng.choice([32, 10, rng.randrange(32, 127), rng.randrange(32, 0xD000)])) for _ in range(40)) for _ in range(400)]
    assert encoder.ranks is not None
    for text, got in zip(odd, encoder.ids(odd), strict=True):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == own.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    got = packing.packed_documents(docs(spark, extra=["piece", "offset"]), PATH, 64).collect()
    own = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, *_ in ROWS:
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        at, size = 0, len(ids) - 64 * max(0, -(-len(ids) // 64) - 1)
        piece = 0
        while at < len(ids):
            raw = struct.pack(f"<{size}I", *ids[at : at + size])
            want[doc_id, piece, at, size, zlib.crc32(raw)] += 1
            at, size, piece = at + size, 64, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 64)
    assert packing.packed_documents(docs(spark, []), PATH).collect() == []


def check_sequences(places, capacity):
    by = {}
    for sequence, offset, length in places:
        by.setdefault(sequence, []).append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_sum_of_squares_rule(sizes):
    rule, counts = packing.SumOfSquares(100), Counter()
    for size in sizes:
        def cost(gap):
            after = counts.copy()
            after[gap] -= gap < 100
            after[gap - size] += gap > size
            return sum(n * n for n in after.values())

        choices = [g for g in range(size, 101) if g == 100 or counts[g]]
        best = min(choices, key=lambda g: (cost(g), g))
        _, offset = rule.place(size)
        assert offset == 100 - best
        counts[best] -= best < 100
        counts[best - size] += best > size
    s, o = packing.assign(np.array(sizes, np.int64), 100)
    assert check_sequences(list(zip(s.tolist(), o.tolist(), sizes, strict=True)), 100) >= -(-sum(sizes) // 100)


# --- URLs


def test_urls(spark):
    rows = [
        ("http://a.net/x", "a.net", "/x", "net/", "block"),
        ("http://WWW.Example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
        ("http://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://spam-farm.example.org/fr/1", "spam-farm.example.org", "/fr/1", "org/fr/", "allow"),
        ("http://ads-track.example.org/en/1", "ads-track.example.org", "/en/1", None, "block"),
        ("http://loads-of-tracks.org/spammer", "loads-of-tracks.org", "/spammer", None, "allow"),
        ("http://spam-farm.example.org/en/1", "spam-farm.example.org", "/en/1", None, "block"),
        ("http://x.com/freedom/cheaper", "x.com", "/freedom/cheaper", None, "allow"),
        ("http://x.com/free/free", "x.com", "/free/free", None, "allow"),
        ("http://x.com/FREE?a=bonus", "x.com", "/FREE", None, "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    frame = spark.createDataFrame([(k, r[0], "old") for k, r in enumerate(rows)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(frame).collect()}
    for k, want in enumerate(rows):
        assert tuple(got[k][c] for c in ("url", "host", "path", "rule", "verdict")) == want
    assert urls.judge(frame.limit(0)).collect() == []
    words = spark.createDataFrame([("Example", "strict"), ("x", "soft"), (None, "soft"), ("", "soft"), ("com", "soft")], "term string, weight string")
    own = {r["page_id"]: (r["n_strict"], r["n_soft"], r["verdict"]) for r in urls.judge(frame, rules=(), vocabulary=words).collect()}
    assert own[1] == (1, 0, "block") and own[0] == (0, 1, "allow") and own[len(rows) - 4] == (0, 2, "block")
    assert {r["verdict"] for r in urls.judge(frame, rules=(), vocabulary=()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.judge(frame, vocabulary=(("x", "hard"),))


def test_soft_terms_decide_pages(spark):
    got = queries.op9_url_vocabulary(spark, "/root/testdata/sf0.01").where("rule IS NULL")
    assert got.where("verdict = 'block' AND n_strict = 0 AND n_soft >= 2").count() > 0
    assert got.where("verdict = 'block' AND n_strict > 0").count() > 0
    assert got.where("verdict = 'allow'").count() > 0


# --- mixing


def slots_by_force(weights, slots):
    """Which source has each slot: of the blocks whose window has begun the one that is due first. Slot by slot,
    over all sources, without cycles."""
    total, done, out = sum(weights), [0] * len(weights), []
    for now in range(slots):
        due = [
            (-(-(done[s] + 1) * total // w), s)
            for s, w in enumerate(weights)
            if done[s] * total // w <= now  # released
        ]
        _, s = min(due)
        done[s] += 1
        out.append(s)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=7))
def test_pfair_cycle(weights):
    total = sum(weights)
    order = mixing.cycle(weights)
    assert order * 3 == slots_by_force(weights, 3 * total)
    for now in range(1, total + 1):
        for s, w in enumerate(weights):
            assert abs(order[:now].count(s) - now * w / total) < 1


def mixed_by_force(rows, weights, default, block):
    """(slot, source) of all blocks: sources of a weight take turns with its slots."""
    sizes = Counter(r[3] for r in rows)
    names = {}
    for s in sorted(sizes, key=lambda s: (s is None, s or "")):
        names.setdefault(weights.get(s, default), []).append(s)
    kinds = sorted(names)
    left = {s: -(-n // block) for s, n in sizes.items()}
    out, turn = {}, Counter()
    cycles = max(-(-n // weights.get(s, default)) for s, n in left.items()) + 1
    for slot, g in enumerate(slots_by_force([w * len(names[w]) for w in kinds], cycles * sum(w * len(n) for w, n in names.items()))):
        s = names[kinds[g]][turn[g] % len(names[kinds[g]])]
        turn[g] += 1
        if left[s]:
            left[s] -= 1
            out[slot] = s
    return out


@pytest.mark.parametrize("weights", [{"s0": 3}, {"s0": 2, None: 4, "s9": 5}, {}])
def test_mix_as_by_force(spark, weights):
    rng = random.Random(6)
    rows = ROWS + [(50 + k, f"t{k}", "en", rng.choice(["s0", "s0", "s1", "s2", "s3", "s4", None]), k) for k in range(300)]
    frame = docs(spark, rows, ["slot", "h", "s", "row", "share", "__h", "__n", "__s"])
    got = mixing.mix(frame, weights, 2, block=4, per_share=10)
    assert got.columns == [c for c in frame.columns if c != "slot"] + ["block", "slot", "place"]
    got = got.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows)
    by_slot, full = {}, Counter()
    for r in got:
        assert by_slot.setdefault(r["slot"], r["source"]) == r["source"]
        full[r["slot"]] += 1
    assert by_slot == mixed_by_force(rows, weights, 2, 4)
    blocks = {}
    for r in got:
        assert blocks.setdefault((r["source"], r["block"]), r["slot"]) == r["slot"]
    laid = mixing.in_order(mixing.mix(frame, weights, 2, block=4), 3)
    parts = [[(r["slot"], r["place"]) for r in part] for part in laid.rdd.glom().collect()]
    assert sum(parts, []) == sorted(sum(parts, [])) and max(map(len, parts)) < len(rows) / 2


def test_mix_by_size_and_copies(spark):
    rows = [(1, "same", "en", "a", 5)] * 300 + [(2 + k, "x", "en", "b", 1 + k % 9) for k in range(60)] + [(99, "big", "en", "b", 200), (100, "n", "en", "b", None)]
    got = mixing.mix(docs(spark, rows), {"a": 2}, block=10, size="n_chars", per_share=16).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = sorted((r["block"] * 10 + r["place"], r["n_chars"] or 1) for r in got if r["source"] == s)
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]  # no gaps, none twice


def test_mix_odd_input(spark):
    assert mixing.mix(docs(spark, [])).collect() == [] and mixing.in_order(mixing.mix(docs(spark, []))).collect() == []
    for bad in ({"s0": 0}, {"s0": 1.5}):
        with pytest.raises(ValueError):
            mixing.mix(docs(spark), bad)


def test_mix_many_sources(spark):
    rows = spark.range(60_000).selectExpr("id AS doc_id", "'' AS text", "'' AS lang", "concat('s', id % 20000) AS source", "id AS n_chars")
    got = mixing.mix(rows, {"s7": 3}, block=1)
    assert got.count() == 60_000 and got.select("slot").distinct().count() == 60_000
    first = got.where("source = 's7'").orderBy("slot").limit(3).collect()
    # 20002 slots a cycle, three of them its own, each in its window
    assert all(k * 20002 // 3 <= r["slot"] < -(-(k + 1) * 20002 // 3) for k, r in enumerate(first))


# --- language


def test_languages(spark):
    rng = random.Random(7)
    vocabulary = {
        "en": "the and of to that with house thing water when",
        "de": "der und die nicht mit haus ding wasser wenn über",
        "fr": "le et des pas avec maison chose eau quand très",
        "es": "el y los no con casa cosa agua cuando más",
        "xx": "qoqo zuzu wawa kuku",
    }
    rows = [(k, " ".join(rng.choices(vocabulary[lang].split(), k=rng.randrange(4, 40))), lang, "s", 0) for k, lang in enumerate(list(vocabulary) * 60)]
    frame = docs(spark, rows + [(900, None, "en", "s", 0), (901, "12 --", "en", "s", 0), (902, "the house", None, "s", 0)], ["score"])
    got = {r["doc_id"]: r for r in langid.identify(frame, frame["doc_id"] % 2 == 0).collect()}
    tested = [(got[r[0]]["lang_pred"], r[2]) for r in rows if r[0] % 2]
    assert sum(a == b for a, b in tested) >= 0.95 * len(tested)
    assert (got[900]["lang_pred"], got[901]["lang_pred"], got[900]["score"]) == ("und", "und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    untaught = langid.identify(docs(spark), F.col("doc_id") < 0).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}
    assert langid.identify(docs(spark, []), F.lit(True)).collect() == []


def test_every_language_is_learned(spark):
    """A very frequent text and many languages: none is left out, and copies count once."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{k:03d}" for k in range(21)] + ["en", "de", "nl"]
    words = {n: ["".join(rng.choices(letters, k=6)) for _ in range(6)] for n in names}
    rows = [(k, " ".join(rng.choices(words[n], k=12)), n, "s", 0) for k, n in enumerate(names * 12)]
    rows += [(5, "the one text that is everywhere", "en", "s", 0)] * 3000
    frame = docs(spark, rows)
    chosen = langid.training_texts(frame.select("text", "lang"), 150, 4096).groupBy("lang").count().collect()
    assert {r["lang"] for r in chosen} == set(names) and max(r["count"] for r in chosen) <= 25
    few = langid.training_texts(frame.select("text", "lang"), 150, 24).groupBy("lang").count().collect()
    assert {r["count"] for r in few} == {4}
    got = langid.identify(frame, F.lit(True), per_language=10, bits=10).where("doc_id <> 5").collect()
    assert {r["lang_pred"] for r in got} == set(names)
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)


# --- empty tables and columns with clashing names


def test_empty_tables(spark):
    none = docs(spark, [])
    assert private.personal_data(none).collect() == [] and urls.judge(none.withColumnRenamed("text", "url")).collect() == []
    assert simhash.one_of_each(none).collect() == [] and packing.packed_documents(none, PATH).collect() == []


def test_clashing_names_give_way(spark):
    clash = ["__host", "__M", "__row", "__d", "__x", "__found", "lang_pred", "score", "n_email", "spans", "redacted", "n_lines", "n_removed", "kept", "host_rate", "__source", "fp", "host"]
    frame = docs(spark, extra=clash)
    first = langid.identify(frame, F.lit(True)).where("doc_id = 1").collect()[0]
    assert first["lang_pred"] in ("en", "fr", "de")
    assert private.personal_data(frame).where("doc_id = 1").first()["spans"] == ""
    assert quality.quality(frame).where("doc_id = 1").first()["kept"] in (True, False)
    assert linededup.dedup_lines(frame).where("doc_id = 5").first()["n_removed"] == 2
    for one in (simhash, similar):
        assert one.one_of_each(frame).columns == frame.columns
