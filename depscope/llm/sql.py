"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from depscope.llm.importance import POLYNOMIAL
from depscope.llm.urls import RULES, VOCABULARY

HOST_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tok AS (SELECT rid, unnest(range(len(words))) AS i, unnest(words) AS x FROM w WHERE len(words) >= 5),
win AS (SELECT rid, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o
               || ' ' || lead(x, 4) OVER o AS k FROM tok WINDOW o AS (PARTITION BY rid ORDER BY i)),
many AS (SELECT rid, k FROM win WHERE k IS NOT NULL GROUP BY rid, k HAVING count(*) > 1),
keyed AS (SELECT win.rid, i, 2 AS n FROM win JOIN many ON many.rid = win.rid AND many.k = win.k),
rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS c
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM keyed WHERE n > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.rid = w.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             CAST(n_symbols > 0.1 * greatest(n_words, 1) AS INT) + CAST(n_dup_lines > 0.3 * greatest(n_lines, 1) AS INT)
             + CAST(word_chars / greatest(n_words, 1) < 2.5 OR word_chars / greatest(n_words, 1) > 14 AS INT) AS n_soft,
             CAST(n_symbols > 0.3 * greatest(n_words, 1) AS INT)
             + CAST(n_dup_lines > 0.6 * greatest(n_lines, 1) AS INT) AS n_hard FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed OR n_soft > 0 OR n_hard > 0 AS INT)) AS k FROM f GROUP BY source),
a AS (SELECT sum(k) / sum(n) AS mean, sum(n) AS total, count(*) AS hosts FROM h),
b AS (SELECT mean, sum(n * pow(k / n - mean, 2)) / any_value(total)
             - mean * (1 - mean) * any_value(hosts) / any_value(total) AS rest FROM h, a GROUP BY mean),
p AS (SELECT mean, CASE WHEN rest <= 0 THEN 1000.0
             ELSE least(1000.0, greatest(1.0, mean * (1 - mean) / rest - 1)) END AS strength FROM b),
q AS (SELECT source, n, mean, strength, (k + strength * mean) / (n + strength) AS rate FROM h, p),
r AS (SELECT source, rate - mean > 1.6448536269514722 * sqrt(rate * (1 - rate) / (n + strength + 1)) AS strict FROM q)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_hard > 0 OR (n_soft > 0 AND strict)) AS kept,
       CASE WHEN strict THEN 'strict' ELSE 'open' END AS host_verdict
FROM f LEFT JOIN r ON r.source IS NOT DISTINCT FROM f.source
"""

BREAKS = r"\\\\|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|</?s>|\[/?INST\]|<</?SYS>>"

CHAT = rf"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(role, '{BREAKS}|\n')) + len(regexp_extract_all(text, '{BREAKS}')))
            AS BIGINT) AS formatted_chars, true AS positions_hold
FROM c GROUP BY conv_id
"""


def alone(term: str) -> str:
    return f"CAST(regexp_matches(translate(coalesce(url, ''), '{UPPER}', '{UPPER.lower()}'), '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS BIGINT)"


STRICT, SOFT = ([t for t, weight in VOCABULARY if weight == w] for w in ("strict", "soft"))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
    for h, _, p in sorted((r.partition("/") for r, _ in RULES), key=lambda x: -len("".join(x)))
)
URLS = rf"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
             regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
j AS (SELECT page_id, host, path, CASE {FITS} END AS rule, {' + '.join(map(alone, STRICT))} AS n_strict, {' + '.join(map(alone, SOFT))} AS n_soft FROM p)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)}
       WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM j
"""

def nibbles() -> list[int]:
    """The CRC-32 register after four bits, by the four lowest."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ POLYNOMIAL if value & 1 else value >> 1
        out.append(value)
    return out


def lower_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


IMPORTANCE = rf"""
WITH w AS (SELECT 0 AS part, doc_id AS id, {lower_words('text')} AS x FROM documents UNION ALL SELECT 1, item_id, {lower_words('text')} FROM benchmark),
f AS (SELECT part, id, unnest(list_concat(x, list_transform(range(1, len(x)), lambda k: x[k] || ' ' || x[k + 1]))) AS f FROM w),
n AS (SELECT part, id, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
c AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(2 * octet_length(encode(f))),
  lambda k: (strpos('0123456789ABCDEF', h[k + 2 - 2 * (k % 2)]) - 1)::BIGINT)), lambda a, b: xor(a >> 4, [{', '.join(f'{v}::BIGINT' for v in nibbles())}][(xor(a, b) & 15) + 1]))) % 10000 AS b FROM h),
k AS (SELECT part, id, b, n FROM n JOIN c USING (f)),
s AS (SELECT b, sum(CASE WHEN part = 0 THEN n ELSE 0 END)::DOUBLE AS s, sum(part * n)::DOUBLE AS t FROM k GROUP BY b),
z AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM s),
g AS (SELECT b, floor(1000 * ln(((t + 1) * (ss + 10000)) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM s, z),
d AS (SELECT id, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM k JOIN g USING (b) WHERE part = 0 GROUP BY id),
o AS (SELECT w.id AS doc_id, len(x) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || left(sha256('7:' || w.id), 8))::BIGINT AS h FROM w LEFT JOIN d ON d.id = w.id WHERE part = 0),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, 25 * count_if(words >= 20) OVER () // 100 AS drawn FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= drawn THEN place END AS rank FROM r
"""

ORACLES = {"op2_host_quality": HOST_QUALITY, "op5_chat_prefix_tree": CHAT, "op9_url_vocabulary": URLS, "op11_importance_resampling": IMPORTANCE}
