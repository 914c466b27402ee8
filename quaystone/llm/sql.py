"""DuckDB SQL for the corpus queries that SQL can express over whole tables.

Pseudonyms, near-duplicate lines, SimHash, the index, and the two learnt models are held against brute force in
``tests/llm`` instead.
"""

from __future__ import annotations

from quaystone.llm.queries import DOMAIN_SQL, MIX_WEIGHTS, URL_RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)

URLS = rf"""WITH rules(verdict, h, p) AS (VALUES {_RULES}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT page_id, max(struct_pack(n := length(h || p), rule := h || p, verdict := verdict)) AS best FROM u JOIN rules ON host <> '' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN fits USING (page_id)"""

EXACT = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM k"""


def _weight(level: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {w}" for name, w in MIX_WEIGHTS.get(level, {}).items())
    return f"CAST(CASE {level} {cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"


def _level(i: int) -> str:
    levels = ("domain", "lang", "source")
    path, parent, level = ", ".join(levels[: i + 1]), ", ".join(levels[:i]), levels[i]
    part = f"PARTITION BY {parent} " if parent else ""
    before = f"({part}ORDER BY r, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""n{i} AS (SELECT {path}, sum(cap)::BIGINT AS cap, any_value(given) AS pool FROM g{i} GROUP BY {path}),
o{i} AS (SELECT *, cap::DOUBLE / w AS r FROM (SELECT *, {_weight(level)} AS w FROM n{i})),
b{i} AS (SELECT *, coalesce(sum(cap) OVER {before}, 0) AS used, coalesce(sum(w) OVER {before}, 0) AS gone, sum(w) OVER ({part}) AS all_w FROM o{i}),
f{i} AS (SELECT *, cap * (all_w - gone) <= w * (pool - used) AS is_full FROM b{i}),
s{i} AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS full_cap, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS open_w FROM f{i}),
g{i + 1} AS (SELECT g.* EXCLUDE (given), CASE WHEN is_full THEN s.cap ELSE least(s.cap, (w * greatest(0, pool - full_cap)) // open_w) END AS given FROM g{i} g JOIN s{i} s USING ({path}))"""


MIX = f"""WITH d AS (SELECT doc_id, {DOMAIN_SQL} AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, CAST({TOKENS} AS BIGINT) AS n_tokens FROM documents),
g0 AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS leaf_tokens, sum(n_tokens)::BIGINT * 4 AS cap, (SELECT sum(n_tokens) FROM d)::BIGINT AS given FROM d GROUP BY 1, 2, 3),
{_level(0)},
{_level(1)},
{_level(2)},
plan AS (SELECT *, CASE WHEN leaf_tokens = 0 THEN 0 ELSE given // leaf_tokens END AS passes FROM g3),
r AS (SELECT d.*, p.leaf_tokens, p.given, p.passes, sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('mix:' || p.passes::BIGINT || ':' || d.doc_id), d.doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM d JOIN plan p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, given::BIGINT AS given, CAST(passes + CASE WHEN run <= given - passes * leaf_tokens THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r"""

#: The whole dynamic programme: layer by layer, then back from the last bucket.
PACK = f"""WITH RECURSIVE z AS (SELECT doc_id, CAST({TOKENS} AS BIGINT) AS n_tokens, n_tokens AS x, md5(doc_id || ':' || md5(coalesce(text, ''))) AS mark FROM documents),
h AS (SELECT x, row_number() OVER (ORDER BY x) AS j, sum(count(*)) OVER (ORDER BY x)::BIGINT AS c, sum(x * count(*)) OVER (ORDER BY x)::BIGINT AS t FROM z GROUP BY x),
p AS (SELECT 0::BIGINT AS j, 0::BIGINT AS x, 0::BIGINT AS c, 0::BIGINT AS t UNION ALL SELECT j, x, c, t FROM h),
dp AS (SELECT 0 AS k, 0::BIGINT AS j, 0::BIGINT AS cost, 0::BIGINT AS i UNION ALL
  SELECT k, j, b.cost, b.i FROM (SELECT dp.k + 1 AS k, h.j, min(struct_pack(cost := dp.cost + h.x * (h.c - p.c) - (h.t - p.t), i := dp.j)) AS b FROM dp JOIN p ON p.j = dp.j JOIN h ON h.j > dp.j WHERE dp.k < 16 GROUP BY dp.k, h.j)),
last AS (SELECT least(16, max(j)) AS k, max(j) AS j FROM h),
back AS (SELECT k, j FROM last UNION ALL SELECT back.k - 1, dp.i FROM back JOIN dp ON dp.k = back.k AND dp.j = back.j WHERE back.k > 1),
bounds AS (SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS bucket, x AS bucket_max FROM back JOIN h USING (j)),
a AS (SELECT doc_id, n_tokens, mark, (SELECT min(bucket) FROM bounds WHERE bucket_max >= z.x) AS bucket FROM z),
m AS (SELECT a.*, bucket_max, greatest(1, -(-(count(*) OVER (PARTITION BY bucket)) // 8192)) AS slices FROM a JOIN bounds USING (bucket)),
s AS (SELECT *, CAST(('0x' || substr(mark, 1, 8))::BIGINT % slices AS INTEGER) AS slice FROM m)
SELECT doc_id, n_tokens, bucket, bucket_max, bucket || '-' || slice || '-' || ((row_number() OVER (PARTITION BY bucket, slice ORDER BY doc_id, n_tokens) - 1) // greatest(1, 65536 // greatest(bucket_max, 1))) AS batch, bucket_max - n_tokens AS padding FROM s"""

SQL: dict[str, str] = {"op3_url_filter": URLS, "op6_packing": PACK, "op7_mixing": MIX, "op10_exact_dedup": EXACT}
