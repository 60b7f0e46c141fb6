"""Host-level quality rules, in DataFrame functions only.

Each document is measured by itself, rule failures are summed by host, every host's
failure rate is shrunk with a beta prior fitted to all hosts, and the host's verdict
is joined back to decide how its doubtful documents fare. A host is strict if by its
posterior the rate is over the prior's mean with probability ``tail``; so hosts that
differ by no more than chance are all open, and only a host that stands out takes its
doubtful documents with it.

Windows of words are compared by a 64-bit hash: in a text of n words two different ones
are taken for equal with a chance of about n * n / 2**65.

Defined results: a null or empty text has zero counts and fails the base rule; a null
host is a host of its own; repeated rows each count and each get a result; an empty
table gives an empty result; columns of the input keep their names, and an input
column that has the name of a result column gives way to the result.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import unused
from depscope.scratch import materialise

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULT = [*COUNTS, "base_failed", "n_soft", "n_hard", "host_rate", "host_verdict", "kept"]


def let(value: Column, body) -> Column:
    """``body`` over ``value``, evaluated once: a lambda variable can't be inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five that occur twice or more in the text.

    Windows are compared by a 64-bit hash chained over their words. Only a text that
    has a repeated window sorts its windows, so the usual cost is one hash set.
    """

    def covered(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(
            tagged,
            lambda s: F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        steps = let(
            starts,
            lambda p: F.transform(
                p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))
            ),
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    windows = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = let(
        F.transform(words, lambda w: F.xxhash64(w)),  # each word once, then five numbers a window
        lambda own: F.transform(windows, lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(WINDOW)])),
    )
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(count)


def measures(text: Column) -> Column:
    """A struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        *[
            c.cast("long").alias(n)
            for n, c in {
                "n_words": F.size(words),
                "word_chars": F.length(F.regexp_replace(text, SPACE, "")),
                "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
                "n_lines": F.size(lines),
                "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
                "n_repeat_words": let(words, _repeat_words),
            }.items()
        ]
    )


def rule_failures(soft_symbols: float, soft_dup: float, word_length: tuple[float, float]) -> dict[str, Column]:
    """Base rule, and how many soft and hard rules fail, from the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / words
    soft = [
        F.col("n_symbols") > soft_symbols * words,
        F.col("n_dup_lines") > soft_dup * lines,
        (mean < word_length[0]) | (mean > word_length[1]),
    ]
    hard = [F.col("n_symbols") > 3 * soft_symbols * words, F.col("n_dup_lines") > 2 * soft_dup * lines]
    return {
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "n_soft": sum(c.cast("int") for c in soft),
        "n_hard": sum(c.cast("int") for c in hard),
    }


#: Bytes of host names and rates up to which they are joined by broadcast.
BROADCAST_BYTES = 8 << 20


def host_rates(failures: DataFrame) -> tuple[DataFrame, int]:
    """(host, host_rate, above), the failure rate of each host, shrunk to the beta prior, and by how many
    of its posterior's deviations it is over the prior's mean; and about how many bytes that is.

    ``failures`` has host and failed (0 or 1). The prior's mean is the overall rate;
    its strength comes from the spread of the hosts' rates, by moments, kept in
    1 to 1000 documents. The driver gets one row.
    """
    hosts = failures.groupBy("host").agg(F.count("*").alias("n"), F.sum("failed").alias("k"))
    hosts = materialise(hosts, "quality-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("hosts"), F.coalesce(F.sum(F.octet_length(F.col("host").cast("string"))), F.lit(0)).alias("bytes")).first()
    if not total["n"]:
        return hosts.select("host", F.lit(0.0).alias("host_rate"), F.lit(0.0).alias("above")), 0
    mean = total["k"] / total["n"]
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2))).first()[0] / total["n"]
    noise = mean * (1 - mean) * total["hosts"] / total["n"]
    between = spread - noise
    strength = 1000.0 if between <= 0 else min(1000.0, max(1.0, mean * (1 - mean) / between - 1))
    rate = (F.col("k") + strength * mean) / (F.col("n") + strength)
    rated = hosts.select("host", "n", rate.alias("host_rate"))
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n") + strength + 1))
    above = F.when(deviation > 0, (F.col("host_rate") - mean) / deviation).otherwise(0.0)
    return rated.select("host", "host_rate", above.alias("above")), total["bytes"] + 40 * total["hosts"]


def quality(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    carry: list[str] | None = None,
    soft_symbols: float = 0.1,
    soft_dup: float = 0.3,
    word_length: tuple[float, float] = (2.5, 14.0),
    tail: float = 0.95,
) -> DataFrame:
    """``docs`` (its columns ``carry``, or all) with counts, host rate and verdict, and kept.

    A document goes if it fails the base rule or a hard rule, or if it fails a soft
    rule and its host is strict: the posterior, taken as normal, leaves less than 1 - ``tail``
    below the prior's mean. A document that fails no rule stays whatever its host.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c not in {*RESULT, "n_lines", "above"}]
    own, found, key = (unused(docs.columns, name) for name in ("__host", "__m", "__key"))
    measured = docs.select(
        *[F.col(f"`{c}`") for c in carried], F.col(f"`{host}`").alias(own), measures(F.col(f"`{text}`")).alias(found)
    )
    table = materialise(measured, "quality").select(*[f"`{c}`" for c in carried], own, f"{found}.*")
    table = table.withColumns(rule_failures(soft_symbols, soft_dup, word_length))
    failed = (F.col("base_failed") | (F.col("n_soft") > 0) | (F.col("n_hard") > 0)).cast("int")
    rates, size = host_rates(table.select(F.col(own).alias("host"), failed.alias("failed")))
    rates = rates.withColumnRenamed("host", key)
    rates = F.broadcast(rates) if size <= BROADCAST_BYTES else rates
    joined = table.join(rates, F.col(own).eqNullSafe(F.col(key)), "left")
    strict = F.coalesce(F.col("above") > NormalDist().inv_cdf(tail), F.lit(False))
    return joined.withColumns(
        {
            "host_verdict": F.when(strict, "strict").otherwise("open"),
            "kept": ~(F.col("base_failed") | (F.col("n_hard") > 0) | ((F.col("n_soft") > 0) & strict)),
        }
    ).drop(own, key, "n_lines", "above")
