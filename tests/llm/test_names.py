"""Operators on tables whose columns are called like helpers and results."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from depscope.llm import importance, langid, linededup, mixing, packing, periodic, private, quality, queries, similar, simhash, substrings, urls

ROOT = Path(__file__).resolve().parents[2] / "depscope"
#: Every helper name in the code, and result columns.
HELPERS = sorted({n for p in [*ROOT.glob("llm/*.py"), *ROOT.glob("operators/*.py")] for n in re.findall(r"\"(__[a-zA-Z0-9]+)\"", p.read_text())})
RESULTS = ["piece", "start", "length", "ids", "sequence_id", "offset", "block", "slot", "place", "rank", "score", "spans", "kept", "host", "fp", "n", "d", "t", "x", "h", "u"]
OPERATORS = {
    "op1": lambda d: langid.identify(d, F.lit(True)),
    "op2": quality.quality,
    "op3": private.personal_data,
    "op4": linededup.dedup_lines,
    "op6": lambda d: packing.packed_documents(d, queries.TOKENIZER, 64),
    "op6 ordered": lambda d: packing.packed_documents(d, queries.TOKENIZER, 64, ordered=True),
    "op8": simhash.near_duplicates,
    "op9": lambda d: urls.judge(d.withColumnRenamed("text", "url")),
    "op10": lambda d: mixing.mix(d, {"s": 2}),
    "op10 in order": lambda d: mixing.in_order(mixing.mix(d, {"s": 2})),
    "op11": lambda d: importance.resample(d, d.select("text")),
    "op12": periodic.periodic_runs,
    "op13": substrings.dedup_substrings,
    "pipeline": similar.one_of_each,
}


@pytest.fixture(scope="module")
def frame(spark):
    docs = spark.createDataFrame([(k, f"the one line of document {k % 3} is here\nand more words {'w ' * 25}", "en", "s") for k in range(6)], "doc_id long, text string, lang string, source string")
    return docs.withColumns({c: F.lit(f"own {c}") for c in [*HELPERS, "__file", "__row", "__part", "__at", "__pieces", *RESULTS]})


def test_names_are_found():
    assert {"__o", "__own", "__start", "__part", "__file", "__row", "__pieces"} & set(HELPERS)


@pytest.mark.parametrize("name", OPERATORS)
def test_helpers_are_out_of_the_way(frame, name):
    rows = OPERATORS[name](frame).collect()
    assert len(rows) >= (2 if name == "pipeline" else 6)
    if name == "op8":  # three columns of its own
        return
    for c in ("__file", "__row", "__part", "__at", "__pieces", "__own", "__start"):
        assert {r[c] for r in rows} == {f"own {c}"}
