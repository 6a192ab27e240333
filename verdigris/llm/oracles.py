"""DuckDB SQL for the queries that SQL can express: op2, op4, op5, op6, op8, op11, op13."""

from __future__ import annotations

from . import centroids, decontaminate
from . import url_reputation as u

_REACH = """reach AS (SELECT a AS id, a AS to_id FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.to_id)"""

OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, n, unnest(s) AS g FROM s JOIN n USING (doc_id)),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, p.n AS pn, q.n AS qn, count(*) AS i FROM x p JOIN x q ON p.g = q.g AND p.doc_id < q.doc_id AND least(p.n, q.n) * 100 >= greatest(p.n, q.n) * 80 GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 80 * (pn + qn - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links), nodes AS (SELECT DISTINCT a FROM edges), """ + _REACH + """,
c AS (SELECT id, min(to_id) AS c FROM reach GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM n LEFT JOIN c ON c.id = doc_id
"""  # fmt: skip

OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.9), nodes AS (SELECT DISTINCT a FROM edges), """ + _REACH + """,
c AS (SELECT id, min(to_id) AS c FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM edges GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""  # fmt: skip

OP6 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\]|/?SYS\]|/?ROLE\])')) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5 ELSE 16 + length(role) END AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(size) AS BIGINT) AS formatted_chars FROM l GROUP BY conv_id
"""


def op5() -> str:
    """Rules and reputation, level by level, as url_reputation has them."""
    long = ", ".join(f"'{s}'" for s in u.LONG_SUFFIXES)
    last = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
    rules = sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[1] + r[2]}'" for r in rules) + " END"
    action = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in rules) + " END"

    def level(name: str, source: str) -> str:
        seen, chance = "sum(n * (bad / n - prior) ** 2)", "sum(prior * (1 - prior))"
        k = f"(SELECT CASE WHEN sum(n * prior * (1 - prior)) > 0 AND {seen} - {chance} > 0 THEN greatest({u.WEAKEST}, least({u.STRONGEST}, sum(n * prior * (1 - prior)) / ({seen} - {chance}) - 1)) ELSE {u.STRONGEST} END FROM {source})"
        return f"{name} AS (SELECT *, {k} AS k, (bad + {k} * prior) / (n + {k}) AS mean FROM {source})"

    return rf"""
    WITH p AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    h AS (SELECT host, count(*)::DOUBLE AS n, sum(CASE WHEN len(regexp_extract_all(html, '{u.JUNK}')) >= {u.JUNK_RUNS} THEN 1 ELSE 0 END)::DOUBLE AS bad,
      CASE WHEN {last(2)} IN ({long}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {last(2)} IN ({long}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM p WHERE html IS NOT NULL GROUP BY host),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM d) AS prior FROM d GROUP BY 1), {level("s1", "s0")},
    d0 AS (SELECT d.*, s1.mean AS prior FROM d JOIN s1 USING (suffix)), {level("d1", "d0")},
    h0 AS (SELECT h.*, d1.mean AS prior FROM h JOIN d1 USING (domain)), {level("h1", "h0")},
    b AS (SELECT host, mean - {u.Z} * sqrt(mean * (1 - mean) / (n + k + 1)) > {u.BAD_RATE} AS blocked FROM h1)
    SELECT page_id, p.host, path, {rule.replace('host', 'p.host')} AS rule, coalesce({action.replace('host', 'p.host')}, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict,
      CASE WHEN {rule.replace('host', 'p.host')} IS NOT NULL THEN 'rule' WHEN blocked IS NOT NULL THEN 'host' ELSE 'prior' END AS judged_by FROM p LEFT JOIN b USING (host)
    """

OP11 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""  # fmt: skip


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": OP2, "op4_decontamination": decontaminate.oracle(), "op5_url_filter": op5(), "op6_chat_format": OP6, "op8_embedding_dedup": OP8, "op11_threshold_topk": OP11, "op13_centroid_clusters": centroids.oracle()}
