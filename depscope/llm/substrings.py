"""Exact substring dedup with suffix automata of reference shards.

A window is ``least`` consecutive words of a document. A word goes if a window around it stands earlier, too: in a document of
smaller doc_id, or earlier in the same. Windows are judged on the input.

The reference are passages that occur again: a shard of them, of bounded size, is one suffix automaton whose states
know the earliest place of their words. Documents that can meet a shard are streamed through its automaton; matching statistics, cut at
``least``, give every window's earliest place, and windows that stand earlier join to the maximal spans that go. As the number of
shards grows with the corpus, an automaton isn't sent to every executor for all documents. It is sent to the tasks that have
text to stream through it, to several if that text is much, as for a passage that a third of all documents have.

Which text can meet which shard is known from anchors. A window's anchor is its first run of ``ANCHOR`` words with the least hash, so equal
windows have equal anchors at equal distance, and a document has one anchor for about eight words. The earliest
occurrence of an anchor that occurs again is reference; every other occurrence streams its windows, up to 15, through that
passage's shard. A window that isn't there may still equal one in a third document: the windows left open are
taken for anchors themselves, whole, and go through the same steps once more. After that, none is open.

Earliest occurrences come from one global sort by anchor and place, in ranges that split an anchor of any frequency; each task
scans its range, and the driver learns of the keys at the borders of ranges, two for each. Documents with the
same sequence of words are one for all these steps, and all but the first go whole, if they have a window.

Defined results: a null text stays null and has no words; a text of fewer words than a window stays. A null doc_id is
later than all others. Rows equal in doc_id and text are one document and fare alike; of rows equal in doc_id only, the one
with the greater text hash is later. An empty table gives an empty result. A text may have 2^27 words and a table 2^36
different texts; more raise an error. Input columns called like a result column give way.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depscope.functions.columns import unused
from depscope.llm.arrow import add_columns, pieces
from depscope.operators.ranking import with_rank
from depscope.scratch import materialise

#: Words of an anchor.
ANCHOR = 6
#: Bits of a word's place in its document; a place of all is the document's number, then these.
PLACE = 27
#: Reference anchors of a shard, words of one document that share a shard, and words that one task streams through it.
SHARD, NEAR, SLICE = 2000, 4096, 200_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    for w in words:
        if w not in known:
            known[w] = digest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def anchors(words: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first window) of each anchor; its windows end where the next one's begin."""
    if len(words) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = min(ANCHOR, least)
    own, mix = word_hashes(words), np.uint64(0x9E3779B97F4A7C15)
    runs = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        runs = (runs ^ (runs >> np.uint64(29))) * mix + own[k : k + len(runs)]
    runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    runs ^= runs >> np.uint64(32)
    inside = np.lib.stride_tricks.sliding_window_view(runs, least - width + 1)
    at = np.arange(len(inside)) + inside.argmin(axis=1)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    return runs[at[first]].view(np.int64), first


def keyed(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """(u, d, t, n, w, h, s) of each row: a number of its own, doc_id and text hash, its count of words, a hash of them all, and its anchors."""

    def compute(values: list[str | None]) -> list[list]:
        out = []
        for value in values:
            words = (value or "").encode("utf-8", "surrogatepass").split()
            if len(words) >> PLACE:
                raise ValueError(f"a text of {len(words)} words")
            out.append((len(words), xxhash.xxh3_128_digest(b" ".join(words)), *anchors(words, least)))
        return list(map(list, zip(*out, strict=True))) if out else [[]] * 4

    x = F.col(f"`{text}`")
    named = docs.select(F.monotonically_increasing_id().alias("u"), F.col(f"`{doc_id}`").alias("d"), F.xxhash64(x).alias("t"), x.alias("x"))
    return add_columns(named, "x", [("n", "long"), ("w", "binary"), ("h", "array<long>"), ("s", "array<long>")], compute, drop=True)


def first_places(rows: DataFrame) -> DataFrame:
    """(at, part, first) of the ``rows`` (key, at, part) whose key occurs more than once; first is the key's least ``at``."""
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in ("at", "part", "first"))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0 is a resolved row; 1 a row of a key that may go on in another range; 2 tells of rows of kind 0 of such a key."""
        key = begin = None  # the key of the last group so far, and whether it is the range's first
        count, first, edge = 0, 0, True
        held = None  # its only row, if there is one

        def made(rows: pa.RecordBatch, kinds: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
            key = rows.column(0).take(pa.array(np.arange(len(kinds)), mask=kinds == 0))
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), key, rows.column(1), rows.column(2), pa.array(firsts)], names=schema.names)

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys, at = batch.column(0), batch.column(1).to_numpy()
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            goes_on = begin is not None and keys[0].as_py() == key
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, n))
            firsts, totals = at[starts], sizes.copy()
            edges = np.zeros(len(starts), bool)
            edges[0] = begin is None or (goes_on and edge)
            if goes_on:
                firsts[0], totals[0] = first, totals[0] + count
            if held is not None and (goes_on or begin is not None):
                if goes_on:  # no longer alone
                    yield made(held, np.zeros(1, np.int32), np.array([first]))
                held = None
            begin = True
            shown = np.repeat((totals > 1) | edges, sizes)
            if shown.any():
                kinds = np.repeat(edges, sizes)[shown].astype(np.int32)
                yield made(batch.filter(pa.array(shown)), kinds, np.repeat(firsts, sizes)[shown])
            key, count, first, edge = keys[n - 1].as_py(), int(totals[-1]), int(firsts[-1]), bool(edges[-1])
            if count == 1 and not edge:
                held = batch.slice(n - 1, 1)
        if held is not None:
            yield made(held, np.ones(1, np.int32), np.array([first]))
        elif begin and not edge:
            tail = pa.RecordBatch.from_arrays([pa.array([key], keys.type), pa.array([first]), pa.array([first])], names=["key", "at", "part"])
            yield made(tail, np.full(1, 2, np.int32), np.array([first]))

    ranged = rows.select("key", "at", "part").repartitionByRange("key", "at").sortWithinPartitions("key", "at")
    found = materialise(ranged.mapInArrow(scan, schema), "substrings-places")
    # two keys of each range at most, so this is a small table whatever the rows
    edges = found.where("kind > 0").groupBy("key").agg(F.min("first").alias("first"), F.count("*").alias("c")).where("c > 1")
    known = {bytes(k) if isinstance(k := r["key"], bytearray) else k: r["first"] for r in edges.select("key", "first").collect()}

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, part, first = batch.columns
            if keys.null_count < batch.num_rows:
                own = zip(keys.to_pylist(), first.to_pylist(), strict=True)
                first = pa.array([f if k is None else known.get(k) for k, f in own], pa.int64())
            yield pa.RecordBatch.from_arrays([at, part, first], names=["at", "part", "first"]).filter(first.is_valid())

    return found.where("kind < 2").select("key", "at", "part", "first").mapInArrow(resolved, "at long, part long, first long")


class Automaton:
    """The suffix automaton of passages, added in the order of their places; its states know their earliest end."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.next: list[dict] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        self.last = self.read = 0
        self.begins: list[int] = []
        self.places: list[int] = []

    def add(self, words: list[bytes], at: int) -> None:
        self.begins.append(self.read)
        self.places.append(at)
        for word in words:
            self._extend(word)
        self._extend(self.read)  # a number equals no word

    def _extend(self, symbol) -> None:
        follow, link, size, end = self.next, self.link, self.size, self.end
        new, state = len(follow), self.last
        follow.append({})
        size.append(size[state] + 1)
        end.append(self.read)
        link.append(0)
        while state >= 0 and symbol not in follow[state]:
            follow[state][symbol] = new
            state = link[state]
        if state >= 0:
            to = follow[state][symbol]
            if size[to] > size[state] + 1:
                copy = len(follow)
                follow.append(dict(follow[to]))
                size.append(size[state] + 1)
                end.append(end[to])
                link.append(link[to])
                link[to] = copy
                while state >= 0 and follow[state].get(symbol) == to:
                    follow[state][symbol] = copy
                    state = link[state]
                to = copy
            link[new] = to
        self.last = new
        self.read += 1

    def earliest(self, words: list[bytes]) -> list[int]:
        """The earliest place of each window of ``words``, or -1."""
        follow, link, size, end, least = self.next, self.link, self.size, self.end, self.least
        out, state, length = [], 0, 0
        for k, word in enumerate(words):
            to = follow[state].get(word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = follow[state].get(word)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
                while size[link[state]] >= least:
                    state = link[state]
                    length = size[state]
            if k + 1 >= least:
                out.append(self.place(end[state] - least + 1) if length >= least else -1)
        return out

    def place(self, start: int) -> int:
        k = bisect_right(self.begins, start) - 1
        return self.places[k] + start - self.begins[k]


def joined_spans(windows: list[int], least: int) -> list[dict]:
    """The words that windows beginning at these places cover, as (start, end); ``windows`` rise."""
    out: list[dict] = []
    for x in windows:
        if out and x <= out[-1]["end"]:
            out[-1]["end"] = x + least
        else:
            out.append({"start": x, "end": x + least})
    return out


def shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    """Passages near each other in a document share a shard."""
    x = (first // NEAR).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)


PASSAGE = "shard long, n long, start long, reference boolean, size long, x string"


def passages(number: int, words: list[bytes], offset: int, begin: np.ndarray, end: np.ndarray, first: np.ndarray, least: int, shards: int) -> Iterator[tuple]:
    """Rows of PASSAGE: windows from ``begin`` to ``end`` that meet the shard of ``first``, those side by side together.
    ``words`` are the document's from ``offset`` on."""
    shard, own = shard_of(first, shards), first == (number << PLACE) + begin
    apart = (begin[1:] != end[:-1]) | (shard[1:] != shard[:-1]) | (own[1:] != own[:-1])
    for rows in np.split(np.arange(len(begin)), np.flatnonzero(apart) + 1):
        a, b = int(begin[rows[0]]), int(end[rows[-1]]) + least - 1
        text = b" ".join(words[a - offset : b - offset]).decode("utf-8", "surrogatepass")
        yield int(shard[rows[0]]), number, a, bool(own[rows[0]]), b - a, text


def tabled(rows: Iterator[tuple], schema: T.StructType, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a few MB from rows whose last value is a text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[-1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)


def cut_out(texts: DataFrame, least: int, shards: int, whole: bool) -> DataFrame:
    """Passages of ``texts`` (n, offset, x, m): m lists (s, first) of anchors or, if not ``whole``, of windows that are their own anchors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(PASSAGE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for piece in pieces(batches, 4 << 20):
            for r in piece.to_pylist():
                words = r["x"].encode("utf-8", "surrogatepass").split()
                met = np.array(sorted((m["s"], m["first"]) for m in r["m"]), np.int64).reshape(-1, 2)
                begin, ends = met[:, 0], met[:, 0] + 1
                if whole:
                    starts = anchors(words, least)[1]
                    ends = np.append(starts, len(words) - least + 1)[np.searchsorted(starts, begin) + 1]
                yield from passages(r["n"], words, r["offset"], begin, ends, met[:, 1], least, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tabled(rows(batches), schema, to_arrow_schema(schema))

    return texts.select("n", "offset", "x", "m").mapInArrow(run, schema)


def streamed(found: DataFrame, least: int) -> DataFrame:
    """(n, start, spans, open) of each streamed passage of ``found`` (PASSAGE): what stands earlier in its shard's
    automaton, and the (key, at) of the windows that don't."""
    load = found.where("NOT reference").groupBy("shard").agg(F.sum("size").alias("load"))
    load = load.select("shard", F.ceil(F.col("load") / SLICE).cast("int").alias("slices"))
    met = found.join(load, "shard")
    own = F.pmod(F.xxhash64("n", "start"), F.col("slices")).cast("int")
    apart = F.when(F.col("reference"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(own))
    dealt = met.withColumn("slice", F.explode(apart)).select("shard", "slice", "reference", "n", "start", "x")
    dealt = dealt.repartition("shard", "slice").sortWithinPartitions("shard", "slice", F.desc("reference"), "n", "start")
    schema = T.StructType.fromDDL("n long, start long, spans array<struct<start: long, end: long>>, open array<struct<key: binary, at: long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, now, automaton = to_arrow_schema(schema), None, Automaton(least)
        for piece in pieces(batches, 4 << 20):
            out = []
            for shard, part, reference, n, start, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if now != (shard, part):
                    now, automaton = (shard, part), Automaton(least)
                words, at = text.encode("utf-8", "surrogatepass").split(), (n << PLACE) + start
                if reference:
                    automaton.add(words, at)
                    continue
                places = automaton.earliest(words)
                known = [0 <= p < at + k for k, p in enumerate(places)]
                spans = joined_spans([start + k for k, yes in enumerate(known) if yes], least)
                rest = [{"key": xxhash.xxh3_128_digest(b" ".join(words[k : k + least])), "at": at + k} for k, yes in enumerate(known) if not yes]
                out.append((n, start, spans, rest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return materialise(dealt.mapInArrow(run, schema), "substrings-spans")


def by_document(places: DataFrame, *keys: str) -> DataFrame:
    """``places`` (at, part, first) listed for each document, and each of its parts if asked for."""
    n, s = F.shiftright("at", PLACE).alias("n"), F.col("at").bitwiseAND((1 << PLACE) - 1)
    return places.select(n, F.col("part").alias("start"), F.struct(s.alias("s"), "first").alias("m")).groupBy("n", *keys).agg(F.collect_list("m").alias("m"))


def shards_of(places: DataFrame, each: int) -> int:
    """How many shards hold the reference, at ``each`` anchors a shard."""
    return places.where("at = first").count() // each + 1


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 20) -> DataFrame:
    """(d, t, spans) of the documents that lose words: doc_id, text hash, and the spans that go as (start, end) in words."""
    keys = materialise(keyed(docs, text, doc_id, least), "substrings-keys")
    own = F.struct(F.col("d").isNull().alias("z"), "d", "t", "u")
    firsts = keys.where(F.col("n") >= least).groupBy("w").agg(F.min(own).alias("f"))
    ranked, count = with_rank(firsts.select("w", "f.z", "f.d", "f.t", "f.u"), ["z", "d", "t"], "n")
    if count >> (63 - PLACE):
        raise ValueError(f"{count} different texts")
    firsts = materialise(ranked.drop("z"), "substrings-firsts")

    anchored = keys.join(firsts.select("u", F.col("n").alias("number")), "u").select("number", F.explode(F.arrays_zip("h", "s")).alias("a"))
    at = F.shiftleft("number", PLACE) + F.col("a.s")
    places = first_places(anchored.select(F.col("a.h").alias("key"), at.alias("at"), F.lit(0).cast("long").alias("part")))
    # rows of one document are the same text; combined in their tasks
    texts = docs.select(F.col(f"`{doc_id}`").alias("d"), F.xxhash64(f"`{text}`").alias("t"), F.col(f"`{text}`").alias("x"))
    texts = texts.where("x IS NOT NULL").groupBy("d", "t").agg(F.first("x").alias("x"))
    wanted = by_document(places).join(firsts.select("n", "d", "t"), "n").withColumnsRenamed({"d": "d2", "t": "t2"})
    joined = texts.join(wanted, F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2"))).withColumn("offset", F.lit(0).cast("long"))
    found = materialise(cut_out(joined, least, shards_of(places, SHARD), True), "substrings-passages")
    one = streamed(found, least)

    left = one.select("start", F.explode("open").alias("o")).select(F.col("o.key").alias("key"), F.col("o.at").alias("at"), F.col("start").alias("part"))
    again = first_places(left)
    parts = found.where("NOT reference").select("n", F.col("start").alias("offset"), "x")
    listed = by_document(again, "start").withColumnRenamed("start", "offset")
    two = streamed(materialise(cut_out(parts.join(listed, ["n", "offset"]), least, shards_of(again, SHARD), False), "substrings-passages"), least)

    spans = one.select("n", "spans").unionByName(two.select("n", "spans")).where(F.size("spans") > 0)
    spans = spans.groupBy("n").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    some = spans.join(firsts.select("n", "d", "t"), "n").select("d", "t", "spans")
    # later texts with the same words; rows equal to the first's document are no later ones
    first = firsts.select("w", F.col("d").alias("d1"), F.col("t").alias("t1"))
    copies = keys.where(F.col("n") >= least).select("w", "d", "t", "n").join(first, "w").where(~(F.col("d").eqNullSafe(F.col("d1")) & (F.col("t") == F.col("t1"))))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    return some.unionByName(copies.select("d", "t", whole.alias("spans")).distinct())


FIELDS = [("n_words", "long"), ("n_removed", "long"), ("spans", "array<struct<start: long, end: long>>")]


def dedup_substrings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 20) -> DataFrame:
    """``docs`` with the words left in ``text``, joined by single spaces, and n_words (before), n_removed and the ``spans`` that went."""
    columns = [c for c in docs.columns if c not in [n for n, _ in FIELDS]]
    found = repeats(docs, text, doc_id, least)
    d, t, m, x = (unused(docs.columns, name) for name in ("__d", "__t", "__m", "__x"))
    found = found.withColumnsRenamed({"d": d, "t": t, "spans": m})
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(d)) & (F.xxhash64(f"`{text}`") == F.col(t))
    both = F.struct(F.col(f"`{text}`").alias("text"), F.col(m).alias("m"))
    joined = docs.join(found, same, "left").select(*[f"`{c}`" for c in columns if c != text], both.alias(x))

    def compute(values: list[dict]) -> list[list]:
        out = []
        for value in values:
            if value["text"] is None:
                out.append((None, 0, 0, []))
                continue
            words = value["text"].encode("utf-8", "surrogatepass").split()
            spans: list[list[int]] = []
            for s, e in sorted((m["start"], m["end"]) for m in value["m"] or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            kept, at = [], 0
            for s, e in spans:
                kept += words[at:s]
                at = e
            kept += words[at:]
            left = b" ".join(kept).decode("utf-8", "surrogatepass")
            out.append((left, len(words), len(words) - len(kept), [{"start": s, "end": e} for s, e in spans]))
        return list(map(list, zip(*out, strict=True))) if out else [[]] * 4

    return add_columns(joined, x, [(text, "string"), *FIELDS], compute, drop=True).select(*[f"`{c}`" for c in columns], *[n for n, _ in FIELDS])
