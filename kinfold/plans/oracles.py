"""DuckDB SQL with the results of the registered queries, written independently as brute force."""

from __future__ import annotations

from kinfold.plans.queries import EMAIL, FAMILIES, FILE_PAGES, NEAR_BITS, NEAR_EDITS, NEAR_SETS, PARTS, RULES, K


def _l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))"


def _tanimoto(a: str, b: str) -> str:
    count = lambda op: f"(bit_count({a}[1] {op} {b}[1]) + bit_count({a}[2] {op} {b}[2]))"
    return f"(CASE WHEN {count('|')} = 0 THEN 0.0 ELSE 1 - {count('&')}::DOUBLE / {count('|')} END)"


VECTORS = "vectors AS (SELECT vec_id AS id, embedding AS obj FROM embeddings)"
POINTS = "points AS (SELECT p_partkey AS id, [p_size / 50::DOUBLE, p_retailprice / 1000] AS obj FROM part)"
URLS = "urls AS (SELECT page_id AS id, url AS obj FROM pages WHERE url IS NOT NULL)"
_WORD = "list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i + {o}] > 0 THEN 1::BIGINT << (i - 1)::INTEGER ELSE 0 END))::BIGINT"
BITS = f"bits AS (SELECT vec_id AS id, [{_WORD.format(o=0)}, {_WORD.format(o=32)}] AS obj FROM embeddings)"
DIST = {"vectors": _l2, "points": _l2, "urls": lambda a, b: f"levenshtein({a}, {b})::DOUBLE", "bits": _tanimoto}
TABLE = {"vectors": VECTORS, "points": POINTS, "urls": URLS, "bits": BITS}


def _next(name: str) -> str:
    d = DIST[name]("a.obj", "b.obj")
    return f"WITH {TABLE[name]} SELECT a.id, round({d}, 6) AS dist FROM {name} a JOIN {name} b ON b.id = a.id + 1"


def _knn(name: str, alive: str = "true", extra: str = "", queries: str = "q.id % 20 = 0", k: int = K, within: str = "true",
         exact: str = "true", self_out: str = "d.id <> q.id", source: str | None = None) -> str:
    """CTEs: the table, ``dist`` of every query to every object that is alive, and ``knn``."""
    d = DIST[name]("d.obj", "q.obj")
    return f"""WITH {TABLE[name]}{extra}, dist AS (
      SELECT q.id AS qid, d.id, {d} AS dist FROM {source or name} d, {name} q
      WHERE {queries} AND {self_out} AND {alive}
    ), knn AS (
      SELECT qid, rank, id, dist FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank FROM dist WHERE {within}
      ) WHERE rank <= {k}
    )"""


def _result(ctes: str, exact: str = "true") -> str:
    return f"{ctes} SELECT qid, rank, id, round(dist, 6) AS dist, {exact} AS exact FROM knn"


def _fft(name: str, m: int = 4, where: str = "true") -> str:
    """CTEs p0 .. p(m-1): pivots by farthest-first traversal from the smallest id."""
    out = [f"p0 AS (SELECT id, obj FROM {name} WHERE {where} ORDER BY id LIMIT 1)"]
    for k in range(1, m):
        near = ", ".join(DIST[name]("x.obj", f"(SELECT obj FROM p{j})") for j in range(k))
        out.append(f"p{k} AS (SELECT id, obj FROM (SELECT id, obj, least({near}) AS d FROM {name} x WHERE {where}) ORDER BY d DESC, id LIMIT 1)")
    return ", ".join(out)


def _cells(name: str, m: int = 4, where: str = "true") -> str:
    """CTEs of _fft(), then assigned (id, obj, cell, pdist, d0 ..) and rings."""
    ds = ", ".join(f"{DIST[name]('x.obj', f'(SELECT obj FROM p{k})')} AS d{k}" for k in range(m))
    low = "least(" + ", ".join(f"d{k}" for k in range(m)) + ")"
    cell = "CASE " + " ".join(f"WHEN d{k} = {low} THEN {k}" for k in range(m)) + " END"
    return f"""{_fft(name, m, where)}, table_ AS (SELECT id, obj, {ds} FROM {name} x),
    assigned AS (SELECT *, {cell} AS cell, {low} AS pdist FROM table_),
    rings AS (SELECT cell, min(pdist) AS lo, max(pdist) AS hi, count(*) AS cnt FROM assigned x WHERE {where} GROUP BY cell)"""


_CALIB = f"""{_cells('points')}, kdist AS (
  SELECT q.id AS qid, d.id, {_l2('d.obj', 'q.obj')} AS dist FROM points d, points q WHERE q.id % 20 = 10 AND d.id <> q.id
), calib AS (
  SELECT qid, pdist AS n, dist AS kth FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM kdist) JOIN assigned a ON a.id = qid
  WHERE rank = {K}
), line AS (SELECT regr_slope(kth, n) AS slope, regr_intercept(kth, n) AS intercept FROM calib
), model AS (
  SELECT slope, intercept, sqrt(avg((kth - (intercept + slope * n)) * (kth - (intercept + slope * n)))) AS scale,
         max(kth - (intercept + slope * n)) AS worst
  FROM calib, line GROUP BY ALL
)"""

_APPROX = _knn(
    "points", extra=f", {_CALIB}, radii AS (SELECT id AS rid, greatest(intercept + slope * pdist + scale, 0.0) AS radius FROM assigned, model WHERE id % 20 = 0)",
    within="dist <= (SELECT radius FROM radii WHERE rid = qid)",
)
_TRUE = f""", alldist AS (
  SELECT q.id AS qid, d.id, {_l2('d.obj', 'q.obj')} AS dist FROM points d, points q WHERE q.id % 20 = 0 AND d.id <> q.id
), truth AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank FROM alldist) WHERE rank <= {K}
)"""

_AS_OF = "(SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events)"
_ALIVE = f""", alive AS (
  SELECT v.id, v.obj FROM vectors v LEFT JOIN events e ON e.event_id = v.id
  WHERE (v.id % 10 >= 8 AND epoch_us(e.ts) <= {_AS_OF})
     OR (v.id % 10 < 8 AND NOT (v.id % 10 = 3 AND coalesce(epoch_us(e.ts) <= {_AS_OF}, false)))
)"""
_MOVED = f""", alive AS (
  SELECT p.id, CASE WHEN p.id % 10 = 4 AND coalesce(epoch_us(e.ts) <= {_AS_OF}, false) THEN [obj[1] + 0.5, obj[2]] ELSE obj END AS obj
  FROM points p LEFT JOIN events e ON e.event_id = p.id
  WHERE (p.id % 10 >= 8 AND epoch_us(e.ts) <= {_AS_OF})
     OR (p.id % 10 < 8 AND NOT (p.id % 10 = 3 AND coalesce(epoch_us(e.ts) <= {_AS_OF}, false)))
)"""
_DYNAMIC = _knn("vectors", extra=_ALIVE, source="alive")

_ID = """ident AS (
  SELECT doc_id, lang, sha256(coalesce(text, '')) AS s,
         sha256(concat_ws(chr(31), coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''))) AS p
  FROM documents
)"""

_family = " ".join(
    f"WHEN p_name LIKE '{p}' THEN '{f}'" for p, f in sorted(FAMILIES, key=lambda r: (-len(r[0]), r[0], r[1]))
)
_rule = {n: f"coalesce(regexp_matches(text, '{p}'), false)" for n, p in (RULES | {"mail": EMAIL}).items()}
_tokens = "list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')))"
_hash_order = "sha256(concat(CAST(id AS VARCHAR), ':7'))"
_grid = "(VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)) g(scales)"


def _ablation() -> str:
    parts = []
    pick = ", ".join(f"h{k} AS (SELECT id, obj FROM points ORDER BY {_hash_order} LIMIT 1 OFFSET {k})" for k in range(4))
    for name, p in (("fft", "p"), ("hash", "h")):
        gaps = " AND ".join(
            f"abs({_l2('d.obj', f'(SELECT obj FROM {p}{k})')} - {_l2('q.obj', f'(SELECT obj FROM {p}{k})')}) <= radius + 1e-9"
            for k in range(4)
        )
        parts.append(
            f"SELECT '{name}' AS choice, count(*) AS queries, round(avg(c), 6) AS mean_candidates, max(c) AS max_candidates FROM ("
            f"SELECT q.id, count(*) FILTER ({gaps}) AS c FROM points d, points q JOIN knn ON qid = q.id AND rank = {K} "
            f"CROSS JOIN LATERAL (SELECT knn.dist AS radius) WHERE q.id % 20 = 0 GROUP BY q.id)"
        )
    return _knn("points", extra=f", {_fft('points')}, {pick}") + " " + " UNION ALL ".join(parts)


_ADMITTED = f"""
  WITH {POINTS}, {_cells('points', where='id % 10 < 8')}
  SELECT id, CAST(a.cell AS BIGINT) AS cell, round(pdist, 6) AS pdist, coalesce(pdist BETWEEN lo AND hi, false) AS admitted
  FROM assigned a LEFT JOIN rings USING (cell) WHERE id % 10 >= 8"""


def _split() -> str:
    """Every cell of over 500 points in up to PARTS parts, whose pivots are its own and farthest-first ones inside."""
    near, ctes, spots = "pdist", [], []
    for k in range(1, PARTS):
        ctes.append(
            f"s{k} AS (SELECT cell, arg_max(obj, (n, -id)) AS obj FROM (SELECT id, obj, cell, parts, {near} AS n FROM t0 {' '.join(spots)}) "
            f"WHERE parts > {k} AND n > 0 GROUP BY cell)"
        )
        spots.append(f"LEFT JOIN (SELECT cell AS c{k}, obj AS o{k} FROM s{k}) ON c{k} = cell")
        dists = ", ".join(f"CASE WHEN o{j} IS NOT NULL THEN {_l2('obj', f'o{j}')} END" for j in range(1, k + 1))
        near = f"least(pdist, {dists})"
    subs = " ".join(f"WHEN {_l2('obj', f'o{k}')} = d THEN {k}" for k in range(1, PARTS))
    return f"""WITH {POINTS}, {_cells('points')}, t0 AS (
      SELECT id, obj, cell, pdist, CASE WHEN cnt > 500 THEN least(ceil(cnt / 500), {PARTS}) ELSE 1 END AS parts
      FROM assigned JOIN rings USING (cell)
    ), {', '.join(ctes)}, near AS (
      SELECT *, {near} AS d FROM t0 {' '.join(spots)}
    ), parted AS (
      SELECT cell AS root, d, CASE WHEN c1 IS NULL THEN cell ELSE (cell + 1) * 1024 + CASE WHEN pdist = d THEN 0 {subs} END END AS cell FROM near
    )
    SELECT CAST(root AS BIGINT) AS root, CAST(cell AS BIGINT) AS cell, round(min(d), 6) AS lo, round(max(d), 6) AS hi, count(*) AS cnt
    FROM parted GROUP BY ALL"""


_SET_DIST = "(CASE WHEN len(a.obj) + len(b.obj) = 0 THEN 0.0 ELSE 1 - len(list_intersect(a.obj, b.obj))::DOUBLE / (len(a.obj) + len(b.obj) - len(list_intersect(a.obj, b.obj))) END)"
_NEAR_SETS = f"""t AS MATERIALIZED (SELECT doc_id AS id, {_tokens} AS obj FROM documents
  ), sets AS (SELECT * FROM (SELECT b.id AS qid, a.id, {_SET_DIST} AS dist FROM t a, t b WHERE b.id % 20 = 0) WHERE dist <= {NEAR_SETS} + 1e-9)"""
_NEAR_EDITS = f"""{URLS}, d AS (SELECT min(id) AS id, obj FROM urls GROUP BY obj), q AS (SELECT min(id) AS qid, obj FROM urls WHERE id % 20 = 0 GROUP BY obj),
  near_urls AS (SELECT qid, id, levenshtein(d.obj, q.obj)::DOUBLE AS dist FROM d, q WHERE levenshtein(d.obj, q.obj) <= {NEAR_EDITS})"""
_NEAR_BITS = f"""{BITS}, near_bits AS (
    SELECT * FROM (SELECT b.id AS qid, a.id, {_tanimoto('a.obj', 'b.obj')} AS dist FROM bits a, bits b WHERE b.id % 20 = 0) WHERE dist <= {NEAR_BITS} + 1e-9)"""


def _recall_tuning() -> str:
    """Neighbours within the radius of each number of scales, over those wanted."""
    return f"""WITH {POINTS}, {_CALIB}, near AS (
        SELECT qid, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM kdist) WHERE rank <= {K}
      ), r AS (
        SELECT id AS qid, scales, greatest(intercept + slope * pdist + scales * scale, 0.0) AS radius FROM assigned, model, {_grid} WHERE id % 20 = 10
      ), q AS (SELECT scales, qid, count(*) FILTER (dist <= radius) / count(*) AS recall FROM near JOIN r USING (qid) GROUP BY ALL)
      SELECT scales, count(*) AS queries, round(avg(recall), 6) AS recall FROM q GROUP BY scales"""


ORACLES = {
    "vectors_text": """
      SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS n, round(embedding[1]::DOUBLE, 6) AS first,
             round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings""",
    "objects_dtype": """
      SELECT vec_id AS id, 'array<double>' AS kind, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm
      FROM embeddings""",
    "manifest_binaries": """
      WITH d AS (
        SELECT CAST(doc_id AS VARCHAR) AS item_id, lang, source,
               sha256(concat_ws(chr(31), coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''))) AS payload_sha256 FROM documents
      ), e AS (
        SELECT item_id, payload_sha256, 'lang' AS binary, sha256(lang) AS binary_sha256 FROM d WHERE lang IS NOT NULL
        UNION ALL SELECT item_id, payload_sha256, 'source', sha256(source) FROM d WHERE source IS NOT NULL
        UNION ALL SELECT item_id, payload_sha256, NULL, NULL FROM d WHERE lang IS NULL AND source IS NULL
      ) SELECT * FROM e""",
    "file_hashes": f"""
      SELECT page_id // {FILE_PAGES} AS file, CAST(sum(strlen(coalesce(html, '')) + 1) AS BIGINT) AS bytes,
             sha256(string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id)) AS sha256 FROM pages GROUP BY 1""",
    "index_table": f"""
      WITH {POINTS}, {_cells('points')} SELECT CAST(cell AS BIGINT) AS cell, count(*) AS cnt, min(id) AS first_id, max(id) AS last_id,
             round(max(pdist), 6) AS hi FROM assigned GROUP BY cell""",
    "recall_tuning": _recall_tuning(),
    "upd_insert_split": _result(_knn("points")),
    "upd_safe_admit_split": _result(_knn("points")),
    "stream_search": _result(_knn("points")),
    "stream_compacted": _result(_knn("points")),
    "knn_l2_tiled": _result(_knn("vectors")),
    "knn_dynamic_index": _result(_knn("points", extra=_MOVED, source="alive")),
    "stream_nearest_changes": _result(_knn("points", extra=_MOVED, source="alive")),
    "stream_nearest": _result(_knn("points", self_out="true")),
    "dist_l2": _next("vectors"),
    "dist_edit": _next("urls"),
    "dist_tanimoto_bits": _next("bits"),
    "dist_tanimoto_set": f"""
      WITH t AS (SELECT doc_id AS id, {_tokens} AS obj FROM documents)
      SELECT a.id, round(CASE WHEN len(a.obj) + len(b.obj) = 0 THEN 0.0 ELSE
        1 - len(list_intersect(a.obj, b.obj))::DOUBLE / (len(a.obj) + len(b.obj) - len(list_intersect(a.obj, b.obj))) END, 6) AS dist
      FROM t a JOIN t b ON b.id = a.id + 1""",
    "str_capacity": """
      SELECT count(*) FILTER (length(url) <= 40) AS kept, count(*) FILTER (url IS NULL OR length(url) > 40) AS dropped,
             CAST(max(length(url)) AS INTEGER) AS longest FROM pages""",
    "pivots_fft": f"WITH {POINTS}, {_fft('points')} " + " UNION ALL ".join(f"SELECT {k} AS pivot, id FROM p{k}" for k in range(4)),
    "pivots_coreset": "SELECT CAST(least(4, count(*)) AS INTEGER) AS pivots, true AS covered FROM part",
    "pivots_hash": f"WITH {POINTS} SELECT CAST(row_number() OVER (ORDER BY {_hash_order}) - 1 AS INTEGER) AS pivot, id FROM points ORDER BY {_hash_order} LIMIT 4",
    "pivot_table": f"WITH {POINTS}, {_cells('points')} SELECT id, round(d0, 6) AS d0, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3 FROM table_",
    "cells": f"WITH {POINTS}, {_cells('points')} SELECT CAST(cell AS BIGINT) AS cell, round(lo, 6) AS lo, round(hi, 6) AS hi, cnt FROM rings",
    "cell_split": _split(),
    "pivot_ablation": _ablation(),
    "knn_l2": _result(_knn("vectors")),
    "knn_edit": _result(_knn("urls")),
    "knn_edit_segments": _result(_knn("urls")),
    "range_edit": f"WITH {_NEAR_EDITS} SELECT qid, id, dist FROM near_urls",
    "edit_candidates": f"WITH {_NEAR_EDITS} SELECT count(*) AS within, true AS sound, true AS few FROM near_urls",
    "knn_tanimoto": _result(_knn("bits")),
    "knn_external": f"""
      WITH c AS (SELECT c_custkey AS id, [c_acctbal / 1000, c_nationkey::DOUBLE] AS obj FROM customer),
           s AS (SELECT s_suppkey AS id, [s_acctbal / 1000, s_nationkey::DOUBLE] AS obj FROM supplier),
           dist AS (SELECT s.id AS qid, c.id, {_l2('c.obj', 's.obj')} AS dist FROM c, s)
      SELECT qid, rank, id, round(dist, 6) AS dist, true AS exact FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank FROM dist) WHERE rank <= {K}""",
    "knn_pruned": _result(_knn("points")),
    "range_l2": _knn("vectors") + " SELECT qid, id, round(dist, 6) AS dist FROM dist WHERE dist <= 1.1",
    "range_pruned": _knn("points") + " SELECT qid, id, round(dist, 6) AS dist FROM dist WHERE dist <= 0.02",
    "range_tanimoto_set": f"WITH {_NEAR_SETS} SELECT qid, id, round(dist, 6) AS dist FROM sets WHERE id <> qid",
    "range_tanimoto_bits": f"WITH {_NEAR_BITS} SELECT qid, id, round(dist, 6) AS dist FROM near_bits",
    "overlap_candidates": f"""
      WITH {_NEAR_SETS}, {_NEAR_BITS} SELECT 'sets' AS kind, count(*) AS within, true AS sound, true AS few FROM sets
      UNION ALL SELECT 'bits', count(*), true, true FROM near_bits""",
    "topk_validity": f"SELECT vec_id AS qid, least({K}, (SELECT count(*) FROM embeddings)) AS rows, 0 AS bad_dists, 0 AS bad_ranks, true AS valid FROM embeddings WHERE vec_id % 20 = 0",
    "radius_fit": f"WITH {POINTS}, {_CALIB} SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(scale, 6) AS scale, round(worst, 6) AS worst FROM model",
    "radius_ml": f"""
      SELECT count(*) AS queries, CAST(count(*) * least({K}, (SELECT count(*) FROM part) - 1) AS BIGINT) AS wanted, true AS recall_reached, true AS promise_kept
      FROM part WHERE p_partkey % 20 = 0""",
    "radius_tuning": f"""
      WITH {POINTS}, {_CALIB}, tried AS (
        SELECT qid, scales, kth, greatest(intercept + slope * n + scales * scale, 0.0) AS radius FROM calib, model, {_grid}
      ), cand AS (
        SELECT scales, qid, max(CASE WHEN kth <= radius THEN 1 ELSE 0 END) AS covered, sum(CASE WHEN dq - radius <= hi + 1e-9 AND dq + radius >= lo - 1e-9 THEN cnt ELSE 0 END) AS candidates
        FROM tried JOIN (SELECT id, unnest([{{'c': 0, 'd': d0}}, {{'c': 1, 'd': d1}}, {{'c': 2, 'd': d2}}, {{'c': 3, 'd': d3}}]) AS u FROM table_) ON id = qid
        CROSS JOIN LATERAL (SELECT u.d AS dq) JOIN rings ON cell = u.c GROUP BY ALL
      )
      SELECT scales, count(*) AS queries, round(avg(covered), 6) AS coverage, round(avg(candidates), 6) AS mean_candidates FROM cand GROUP BY scales""",
    "knn_approx": _result(_APPROX, "false"),
    "recall_audit": f"""{_APPROX}{_TRUE} SELECT qid, count(*) AS wanted, count(k.id) AS found, round(count(k.id) / count(*), 6) AS recall
      FROM truth LEFT JOIN knn k USING (qid, id) GROUP BY qid""",
    "prune_soundness": f"""{_APPROX}{_TRUE} SELECT qid, id, t.rank, round(t.dist, 6) AS dist FROM truth t ANTI JOIN knn USING (qid, id)""",
    "upd_insert": _result(_knn("points")),
    "upd_delete": _result(_knn("points", alive="d.id % 10 <> 3")),
    "knn_buffer": _result(_knn("points")),
    "upd_rebuild": _result(_knn("points")),
    "knn_dynamic": _result(_DYNAMIC),
    "upd_safe_admit": _ADMITTED,
    "stream_arrivals": _ADMITTED,
    "upd_visibility": f"""{_DYNAMIC}, stale AS (
        SELECT qid, id FROM (SELECT q.id AS qid, d.id, row_number() OVER (PARTITION BY q.id ORDER BY {_l2('d.obj', 'q.obj')}, d.id) AS rank
          FROM vectors d, vectors q WHERE q.id % 20 = 0 AND d.id <> q.id AND d.id % 10 < 8) WHERE rank <= {K})
      SELECT qid, id, 'deleted' AS fault FROM stale ANTI JOIN alive USING (id)
      UNION ALL SELECT qid, id, 'missing' AS fault FROM knn ANTI JOIN stale USING (qid, id)""",
    "identity_two_level": f"WITH {_ID} SELECT doc_id, s AS source_sha256, p AS payload_sha256 FROM ident",
    "alias_groups": f"WITH {_ID} SELECT s AS source_sha256, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ident GROUP BY s HAVING count(*) > 1",
    "identity_counts": f"WITH {_ID} SELECT count(*) AS items, count(DISTINCT s) AS sources, count(DISTINCT p) AS payloads FROM ident",
    "context_drift": f"WITH {_ID} SELECT s AS source_sha256, count(DISTINCT p) AS payloads FROM ident GROUP BY s HAVING count(DISTINCT p) > 1",
    "canonical_rows": f"WITH {_ID} SELECT min(doc_id) AS doc_id, s AS source_sha256 FROM ident GROUP BY s",
    "reconcile_prefix": f"""
      WITH {_ID}, listing AS (
        SELECT CASE WHEN quality = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id,
               left(CASE WHEN lang = 'fr' THEN p ELSE s END, 12) AS prefix FROM ident JOIN labels USING (doc_id))
      SELECT coalesce(i.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlisted' WHEN i.doc_id IS NULL THEN 'unknown'
             WHEN starts_with(s, prefix) THEN 'match' ELSE 'mismatch' END AS status
      FROM ident i FULL JOIN listing l ON i.doc_id = l.doc_id""",
    "reconcile_ranges": f"""
      WITH {_ID}, listing AS (
        SELECT doc_id, left(CASE WHEN quality = 0 THEN p ELSE s END, 12) AS prefix
        FROM ident LEFT JOIN (SELECT doc_id, quality FROM labels WHERE toxic = 1) USING (doc_id) WHERE quality IS NULL OR quality = 0)
      SELECT i.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlisted' WHEN starts_with(s, prefix) THEN 'match' ELSE 'mismatch' END AS status
      FROM ident i LEFT JOIN listing l ON i.doc_id = l.doc_id""",
    "exclusions": """
      SELECT doc_id, CASE WHEN lang <> 'en' THEN 'language ' || lang ELSE 'unstated' END AS reason
      FROM documents ANTI JOIN labels USING (doc_id)""",
    "provenance_fanout": """
      SELECT sha256(line) AS line_sha256, count(DISTINCT sha256(text)) AS payloads, count(*) AS uses
      FROM (SELECT text, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line HAVING count(DISTINCT sha256(text)) > 1""",
    "family_lookup": f"SELECT p_partkey, CASE {_family} END AS family FROM part",
    "check_coverage": """
      SELECT coalesce(CAST(quality AS VARCHAR), 'untested') AS result, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "redact_dual_hash": f"""
      SELECT doc_id, sha256(coalesce(text, '')) AS original_sha256, sha256(coalesce(r, '')) AS published_sha256,
             sha256(coalesce(text, '')) <> sha256(coalesce(r, '')) AS changed
      FROM (SELECT doc_id, text, regexp_replace(text, '{EMAIL}', '[mail]', 'g') AS r FROM documents)""",
    "publication_filter": " UNION ALL ".join(
        [f"SELECT '{n}' AS rule, count(*) FILTER ({e}) AS n FROM documents" for n, e in _rule.items()]
        + [f"SELECT 'publishable' AS rule, count(*) AS n FROM documents WHERE NOT ({' OR '.join(_rule.values())})"]
    ),
    "collection_rollup": """
      SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS collection, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes
      FROM pages GROUP BY ROLLUP (collection)""",
}
