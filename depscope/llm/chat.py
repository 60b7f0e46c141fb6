"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share those turns: a node of the tree is a
distinct sequence of turns from the start, and is formatted and tokenised once. Nodes lie
depth first in one token stream, cut into pages, with position ids (a child's go on from its
parent's) and a loss mask by token.

A conversation's path is the chain of 16-byte digests of its turns so far. Different
conversations are sorted by path; of each, the turns that the one before it doesn't begin
with are its run, and runs one after the other are the depth-first order. So no task holds a
tree, and what is kept of a tree is one conversation at a time. The tokens of a run may
attend to its ancestors, which are a few intervals of the stream, and to what lies before
them in the run. Where a range of conversations begins in another one's turns, their places
are looked up by depth among the last conversations of the ranges before.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``; text and template are tokenised apart, so
the loss mask ends where texts do. Inside roles and texts a backslash is doubled, a control
string gets a backslash behind its first character, and a role's newline becomes ``\\n``, so no
text can end a turn and the way back is exact.

Defined results: a null role or text is empty; turns are ordered by turn (null first),
then role, then text, and repeated turns all count; rows with a null conv_id are one
conversation; an empty table gives an empty result; columns other than the four named are
ignored. Two conversations whose digests agree but whose turns don't raise an error.
A conversation is one row, so one task holds the longest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from depscope.llm.arrow import add_columns
from depscope.llm.tokens import Encoder, encoder
from depscope.scratch import materialise

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that some template or tokenizer reads as control; none stays whole inside a text.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BREAK = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_MEND = re.compile(r"\\(.)", re.DOTALL)
LEARNED = "assistant"


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _MEND.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text lies in it."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, rest = formatted[len(OPEN) :].partition("\n")
    role = _MEND.sub(lambda m: "\n" if m[1] == "n" else m[1], head)
    return role, unescape(rest[: -len(CLOSE) - 1])


DIGEST_BYTES = 16


def steps_of(path: bytes) -> list[bytes]:
    return [path[k : k + DIGEST_BYTES] for k in range(0, len(path), DIGEST_BYTES)]


def shared_steps(a: list[bytes], b: list[bytes]) -> int:
    """How many digests two paths begin with alike; each digest stands for all turns up to its own."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[middle - 1] == b[middle - 1] else (low, middle - 1)
    return low


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, path, leaf): one row a conversation, its turns (role, text) in order."""
    ordered = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
                )
            )
        ).alias("turns")
    )
    plain = ordered.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"], x["text"])).alias("turns"))

    def compute(values: list[list[dict]]) -> list[list]:
        out = []
        for value in values:
            at, path = b"", []
            for turn in value:
                role, text = turn["role"].encode(), turn["text"].encode()
                at = hashlib.blake2b(at + len(role).to_bytes(8, "big") + role + text, digest_size=DIGEST_BYTES).digest()
                path.append(at)
            out.append(b"".join(path))
        return [out]

    chained = add_columns(plain, "turns", [("path", T.BinaryType())], compute, drop=False)
    return chained.withColumn("leaf", F.expr(f"substring(path, -{DIGEST_BYTES}, {DIGEST_BYTES})"))


RUN = T.StructType(
    [
        T.StructField("leaf", T.BinaryType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("place", T.LongType()),  # first token, from 0 in the part
        T.StructField("n_tokens", T.LongType()),
        T.StructField("position", T.LongType()),  # position id of the first token
        T.StructField("head", T.IntegerType()),  # ancestors whose places earlier parts know
        T.StructField("near", T.ArrayType(T.ArrayType(T.LongType()))),  # start and end of the other ancestors
        T.StructField("ids", T.BinaryType()),
        T.StructField("learn", T.BinaryType()),
        T.StructField("tail", T.ArrayType(T.ArrayType(T.LongType()))),  # place or null, and tokens, of each turn of a part's last path
    ]
)


def tokenised(turns: list[dict], encode: Encoder) -> tuple[list[bytes], list[bytes]]:
    """Each turn's ids, and a byte for each id that says whether it is learned."""
    ids, learn = [], []
    for turn in turns:
        formatted, start, end = format_turn(turn["role"], turn["text"])
        pieces = encode.ids([formatted[:start], formatted[start:end], formatted[end:]])
        marks = [0, int(turn["role"] == LEARNED), 0]
        ids.append(b"".join(pieces))
        learn.append(b"".join(bytes([m]) * (len(p) // 4) for p, m in zip(pieces, marks, strict=True)))
    return ids, learn


class Walk:
    """One part's conversations in order: what each adds to the stream, and the intervals it goes on from."""

    def __init__(self, encode: Encoder) -> None:
        self.encode = encode
        self.steps: list[bytes] | None = None
        self.places: list[int | None] = []  # of each turn of the last path; None in an earlier part
        self.sizes: list[int] = []
        self.at = 0

    def run(self, row: dict) -> dict:
        steps, turns = steps_of(row["path"]), row["turns"]
        if self.steps is None:
            known = row["inherited"]
            self.places = [None] * known
            self.sizes = [len(i) // 4 for i in tokenised(turns[:known], self.encode)[0]]
        else:
            known = shared_steps(self.steps, steps)
            del self.places[known:], self.sizes[known:]
        head, near = 0, []
        for place, size in zip(self.places, self.sizes, strict=True):
            if place is None:
                head += 1
            elif near and near[-1][1] == place:
                near[-1][1] += size
            else:
                near.append([place, place + size])
        place, position = self.at, sum(self.sizes)
        ids, learn = tokenised(turns[known:], self.encode)
        for own in ids:
            self.places.append(self.at)
            self.sizes.append(len(own) // 4)
            self.at += len(own) // 4
        self.steps = steps
        return {
            "leaf": row["leaf"],
            "part": row["part"],
            "place": place,
            "n_tokens": self.at - place,
            "position": position,
            "head": head,
            "near": near,
            "ids": b"".join(ids),
            "learn": b"".join(learn),
        }


def runs_by_part(ranged: DataFrame, tokenizer_path: str, parts: int) -> DataFrame:
    """RUN rows of conversations (leaf, part, path, turns, inherited), places counted in each part."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, state, held, size, part = to_arrow_schema(RUN), None, [], 0, None

        def closed() -> dict:
            """A row without tokens that says where the part's last path lies."""
            tail = [[p, n] for p, n in zip(state.places, state.sizes, strict=True)]
            return {"part": part, "place": state.at, "n_tokens": 0, "tail": tail, "ids": b"", "learn": b""}

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["part"] != part:
                    if state is not None:
                        held.append(closed())
                    state, part = Walk(encoder(tokenizer_path)), row["part"]
                held.append(state.run(row))
                size += len(held[-1]["ids"])
                if size > 4 << 20 or len(held) > 1000:
                    yield pa.RecordBatch.from_pylist(held, schema=shape)
                    held, size = [], 0
        if state is not None:
            held.append(closed())
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=shape)

    dealt = ranged.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "path")
    return dealt.select("leaf", "part", "path", "turns", "inherited").mapInArrow(walk, RUN)


def bounds(ranged: DataFrame) -> DataFrame:
    """(part, before, inherited): the part before each, and how many turns its first path shares with that one's last."""
    ends = ranged.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("part")  # a row for each part
    lagged = ends.select("part", "first", F.lag("part").over(order).alias("before"), F.lag("last").over(order).alias("last"))

    def compute(values: list[dict]) -> list[list]:
        return [[shared_steps(steps_of(v["first"]), steps_of(v["last"] or b"")) for v in values]]

    both = F.struct("first", "last").alias("ends")
    return add_columns(lagged.select("part", "before", both), "ends", [("inherited", T.IntegerType())], compute, drop=True)


def prefix_tree(turns: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """The runs of the tree, and (conv_id, leaf) that says in which one a conversation ends.

    Runs: leaf, start (of the run in the stream), n_tokens, position (the first position id; the others
    follow by one), ancestors (start and end of the intervals of the stream before it, from the root down,
    neighbours joined), ids (little-endian unsigned 32-bit), learn (a byte for each id).
    """
    convs = materialise(conversations(turns.select("conv_id", "turn", "role", "text")), "chat-conversations")
    check = F.xxhash64("turns")
    first = F.struct(F.col("conv_id").isNull().alias("n"), F.col("conv_id").alias("c"))
    groups = convs.groupBy("leaf").agg(F.min(first).alias("k"), F.min(check).alias("x"), F.max(check).alias("y"))
    agreed = F.when(F.col("x") == F.col("y"), F.col("k.c")).otherwise(F.raise_error(F.lit("two conversations have one digest")))
    chosen = materialise(groups.select(agreed.alias("chosen")), "chat-chosen")
    distinct = convs.join(chosen, F.col("conv_id").eqNullSafe(F.col("chosen")), "left_semi")
    ranged = materialise(distinct.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "chat-ranged")
    edges = materialise(bounds(ranged), "chat-bounds")
    parts = (ranged.agg(F.max("part")).first()[0] or 0) + 1
    runs = materialise(runs_by_part(ranged.join(F.broadcast(edges), "part"), tokenizer_path, parts), "chat-runs")
    total = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = runs.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    firsts = materialise(firsts.select("part", F.coalesce(F.sum("n").over(total), F.lit(0)).alias("first")), "chat-firsts")
    # by depth: where the last path of each part lies, maybe as parts before it left it
    tails = runs.where("tail IS NOT NULL").join(F.broadcast(firsts), "part").select("part", "first", F.posexplode("tail").alias("k", "x"))
    sofar = Window.partitionBy("k").orderBy("part")
    known = tails.select("part", "k", F.last(F.col("first") + F.col("x")[0], True).over(sofar).alias("at"), F.col("x")[1].alias("n"))
    heads = edges.join(known.withColumnRenamed("part", "before"), "before").where("k < inherited").groupBy("part").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "at", "n"))), lambda x: F.array(x["at"], x["at"] + x["n"])).alias("heads")
    )
    heads = materialise(heads, "chat-heads")  # a row for each part that begins inside another's path
    placed = runs.where("leaf IS NOT NULL").join(F.broadcast(firsts), "part").join(heads, "part", "left")
    above = F.concat(
        F.coalesce(F.slice("heads", F.lit(1), F.col("head")), F.array().cast("array<array<bigint>>")),
        F.transform("near", lambda x: F.transform(x, lambda y: y + F.col("first"))),
    )
    tree = placed.select(
        "leaf", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "position", above.alias("above"), "ids", "learn"
    )

    def joined(values: list[list[list[int]]]) -> list[list]:
        out = []
        for value in values:
            made: list[dict] = []
            for start, end in value:
                if made and made[-1]["end"] == start:
                    made[-1]["end"] = end
                else:
                    made.append({"start": start, "end": end})
            out.append(made)
        return [out]

    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    tree = materialise(add_columns(tree, "above", [("ancestors", kind)], joined, drop=True), "chat-tree")
    return tree, convs.select("conv_id", "leaf")


def stream(tree: DataFrame, page: int = 1024) -> DataFrame:
    """(page, ids, positions, learn): the token stream in pages of ``page`` tokens; the last may be shorter.

    ids and positions are little-endian 32-bit integers, learn is a byte a token.
    """

    def compute(values: list[dict]) -> list[list]:
        return [[np.arange(v["position"], v["position"] + v["n_tokens"], dtype="<u4").tobytes() for v in values]]

    both = F.struct("position", "n_tokens").alias("x")
    counted = add_columns(tree.where("n_tokens > 0").select("start", "n_tokens", "ids", "learn", both), "x", [("positions", T.BinaryType())], compute, drop=True)
    pages = F.sequence(F.floor(F.col("start") / page), F.floor((F.col("start") + F.col("n_tokens") - 1) / page))
    cut = counted.withColumn("page", F.explode(pages)).withColumn("a", F.greatest(F.lit(0), F.col("page") * page - F.col("start")).cast("int"))
    cut = cut.withColumn("n", F.least("n_tokens", (F.col("page") + 1) * page - F.col("start")).cast("int") - F.col("a"))
    pieces = cut.select(
        "page",
        F.struct(
            (F.col("start") + F.col("a")).alias("at"),
            F.expr("substring(ids, 4 * a + 1, 4 * n)").alias("ids"),
            F.expr("substring(positions, 4 * a + 1, 4 * n)").alias("positions"),
            F.expr("substring(learn, a + 1, n)").alias("learn"),
        ).alias("x"),
    )
    whole = pieces.groupBy("page").agg(F.sort_array(F.collect_list("x")).alias("x"))  # a page of pieces at most
    return whole.select(
        "page", *[F.expr(f"aggregate(x, X'', (a, y) -> concat(a, y.{c}))").alias(c) for c in ("ids", "positions", "learn")]
    )


DIGEST = [
    ("n_turns", T.LongType()),
    ("turns_sha256", T.StringType()),
    ("loss_chars", T.LongType()),
    ("loss_sha256", T.StringType()),
    ("formatted_chars", T.LongType()),
    ("n_tokens", T.LongType()),
    ("positions_hold", T.BooleanType()),
]


def learned_texts(ids: np.ndarray, learn: np.ndarray, decode) -> list[str]:
    """The texts of the stretches of tokens that are learned."""
    turns = np.flatnonzero(np.diff(np.concatenate([[0], learn, [0]])))
    stretches = [ids[a:b].tolist() for a, b in turns.reshape(-1, 2).tolist()]
    return [unescape(t) for t in decode(stretches, skip_special_tokens=False)] if stretches else []


def read_back(tree: DataFrame, members: DataFrame, tokenizer_path: str, page: int = 1024) -> DataFrame:
    """Each conversation as the stream says: the tokens of its run and of its ancestors' intervals, decoded, parsed and
    digested, one row each; positions_hold if their position ids run from 0 by one."""
    pages = materialise(stream(tree, page), "chat-stream")
    own = F.array(F.struct("start", (F.col("start") + F.col("n_tokens")).alias("end")))
    spans = tree.select("leaf", F.posexplode(F.concat("ancestors", own)).alias("k", "x")).where("x.end > x.start")
    asked = spans.select(
        "leaf", F.col("x.start").alias("s"), F.col("x.end").alias("e"), "k",
        F.explode(F.sequence(F.floor(F.col("x.start") / page), F.floor((F.col("x.end") - 1) / page))).alias("page"),
    )
    asked = materialise(asked, "chat-asked")  # so that rows that ask for one page can be split
    a = F.greatest(F.lit(0), F.col("s") - F.col("page") * page).cast("int")
    n = F.least(F.lit(page), F.col("e") - F.col("page") * page).cast("int")
    met = asked.join(pages, "page").withColumn("a", a).withColumn("n", n - F.col("a"))
    got = met.select(
        "leaf",
        F.struct(
            "k",
            "page",
            F.expr("substring(ids, 4 * a + 1, 4 * n)").alias("ids"),
            F.expr("substring(positions, 4 * a + 1, 4 * n)").alias("positions"),
            F.expr("substring(learn, a + 1, n)").alias("learn"),
        ).alias("x"),
    )
    whole = got.groupBy("leaf").agg(F.sort_array(F.collect_list("x")).alias("pieces"))

    def compute(values: list[list[dict]]) -> list[list]:
        decode, out = encoder(tokenizer_path).tokenizer.decode_batch, []
        for value in values:
            ids, positions = (np.frombuffer(b"".join(p[c] for p in value), "<u4") for c in ("ids", "positions"))
            learn = np.frombuffer(b"".join(p["learn"] for p in value), np.uint8).astype(np.int8)
            said, learned = hashlib.sha256(), hashlib.sha256()
            formatted = decode([ids.tolist()], skip_special_tokens=False)[0]
            turns = formatted.split(f"{CLOSE}\n")[:-1]
            for turn in turns:
                said.update("{}\n{}\n".format(*parse_turn(f"{turn}{CLOSE}\n")).encode())
            texts = learned_texts(ids, learn, decode)
            for text in texts:
                learned.update(text.encode())
            hold = bool(np.array_equal(positions, np.arange(len(ids))))
            out.append([len(turns), said.hexdigest(), sum(map(len, texts)), learned.hexdigest(), len(formatted), len(ids), hold])
        return list(map(list, zip(*out, strict=True))) if out else [[]] * len(DIGEST)

    digests = materialise(add_columns(whole, "pieces", DIGEST, compute, drop=True, piece_bytes=2 << 20), "chat-digests")
    return members.join(digests, "leaf").drop("leaf")
