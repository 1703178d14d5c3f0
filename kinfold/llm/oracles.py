"""DuckDB SQL for those queries that SQL can express."""

_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT a.doc_id, pos, line, coalesce(a.doc_id <> keeper, false) AS gone
  FROM keyed a LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ssize FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s
), w AS (
  SELECT *, (k % 3 + 1) * (CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END) AS w0,
            (k % 3 + 1) * (CASE WHEN k % 2 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END) AS w1,
            (k % 3 + 1)::DOUBLE AS w FROM r
), l AS (
  SELECT *, (CAST(sum(ssize) OVER () AS BIGINT)
             - 3 * coalesce(CAST(sum(ssize) OVER (ORDER BY ssize / w, w, source ASC NULLS LAST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))::DOUBLE
            / sum(w) OVER (ORDER BY ssize / w, w, source ASC NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w
), t AS (
  SELECT *, least((3 * ssize)::DOUBLE, w * max(CASE WHEN 3 * ssize >= lev * w THEN lev END) OVER ()) AS target
  FROM l
), x AS (
  SELECT d.*, ssize, target, w0, w1,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size
              ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS b,
         CASE WHEN ssize > 0 THEN CAST(least(floor(target / ssize), 3) AS BIGINT) ELSE 0 END AS q
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), y AS (
  SELECT *, q * size + greatest(0, least(size, CAST(round(target - q * ssize) AS BIGINT) - b)) AS taken,
         CASE WHEN target > 0 THEN least(b / target, 1.0::DOUBLE) * (w0 + w1) / 2 END AS f FROM x
)
SELECT doc_id, size, ssize AS source_size, target, taken,
       round(CASE WHEN taken > 0 THEN
         (sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * f, 0.0::DOUBLE)) - w0) / (w1 - w0) END, 9) + 0.0 AS position
FROM y
"""

SHARD = """
WITH d AS (
  SELECT doc_id, text, md5(coalesce(text, '')) AS o, strlen(coalesce(text, '')) + 1 AS size FROM documents
), r AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e,
         row_number() OVER (ORDER BY o, doc_id, size) - 1 AS n FROM d
), g AS (
  SELECT *, e - size AS b, min(e - size) OVER (PARTITION BY o) AS lo, max(e) OVER (PARTITION BY o) AS hi,
         CAST(sum(size) OVER () AS BIGINT) AS total FROM r
), t AS (
  SELECT k, (SELECT CAST(sum(size) AS BIGINT) FROM d) * k // 8 AS c FROM range(1, 8) x(k)
), cut AS (
  SELECT k, CASE WHEN hi - lo > 0.01 * total / 8
                 THEN CASE WHEN c - b <= e - c THEN b ELSE e END
                 ELSE CASE WHEN c - lo <= hi - c THEN lo ELSE hi END END AS place
  FROM t JOIN g ON b <= c AND e > c
), s AS (
  SELECT doc_id, size, n, (SELECT CAST(count(*) AS INTEGER) FROM cut WHERE place <= g.b) AS shard FROM g
)
SELECT doc_id, size, shard, 'bytes' AS law, n - min(n) OVER (PARTITION BY shard) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

BACKOFF = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), p AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM t
), u AS (SELECT word, count(*) AS n FROM t GROUP BY word
), c AS (SELECT prev, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY prev
), b AS (SELECT prev, word, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY prev, word
), s AS (
  SELECT doc_id, CASE WHEN p.prev IS NULL THEN ln(u.n / (SELECT count(*) FROM t))
                      WHEN b.n >= 2 THEN ln(b.n / c.n) ELSE ln(0.4::DOUBLE) + ln(u.n / (SELECT count(*) FROM t)) END AS v
  FROM p JOIN u USING (word) LEFT JOIN b ON b.prev = p.prev AND b.word = p.word LEFT JOIN c ON c.prev = p.prev
)
SELECT doc_id, len(w) AS n_words, round(coalesce(x, 0), 4) AS log_score, round(x / nullif(len(w), 0), 6) AS mean_log_score
FROM d LEFT JOIN (SELECT doc_id, sum(v) AS x FROM s GROUP BY doc_id) USING (doc_id)
"""

_A, _Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_leak_words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), {_A}, {_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LEAKS = f"""
WITH d AS (SELECT doc_id, {_leak_words('text')} AS w FROM documents
), i AS (SELECT item_id, {_leak_words('text')} AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM g
), p AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), f AS (SELECT doc_id, k, p.n, item_id FROM p JOIN g ON g.g = p.g AND g.n = p.n
), h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM f) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _clusters(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """Lloyd's rounds, written out one by one, with every distance computed."""
    square = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    assign = lambda r: f"""a{r} AS MATERIALIZED (
      SELECT vec_id, row, x, d, cluster FROM (
        SELECT v.vec_id, v.row, v.x, c.k AS cluster, {square} AS d,
               row_number() OVER (PARTITION BY v.row ORDER BY {square}, c.k) AS n FROM v, c{r} c) WHERE n = 1
    )"""  # noqa: E731
    parts = [
        f"""v AS MATERIALIZED (
      SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS x
      FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )""",
        f"""c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (
        SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT {k})
    )""",
    ]
    for r in range(rounds):
        parts += [
            assign(r),
            f"""c{r + 1} AS MATERIALIZED (
      SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
        SELECT cluster, list(m ORDER BY pos) AS x FROM (
          SELECT cluster, pos, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
          FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM a{r}) GROUP BY cluster, pos)
        GROUP BY cluster) m ON m.cluster = c.k
    )""",
        ]
    return f"""WITH {', '.join(parts)}, {assign(rounds)}
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON c.k = a.cluster"""


def _repair() -> str:
    """Faults by window functions, then the cheapest edits by dynamic programming from a conversation's end.

    A state is what came before: 0 nothing, 1 a system turn, 2 a user, 3 an assistant.
    The best way on from it is a string of six digits of cost and the audit, so that the
    smallest string is the smallest (cost, audit).
    """
    crc = """xor(list_reduce(list_transform(range(1, len(s) + 1), lambda i: CAST(ord(s[i]) AS BIGINT)),
      lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
        lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"""
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    add = lambda rest, cost, letter: f"(lpad(CAST(CAST({rest}[1:6] AS INTEGER) + {cost} AS VARCHAR), 6, '0') || '{letter}' || {rest}[7:])"
    never = "'999999'"
    after = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}

    def act(q: int) -> str:
        ways = [add(f"e{q}", 4, "D")]
        for x, to in after.items():
            if q in to:
                ways.append(f"CASE WHEN NOT bad AND r = '{x}' THEN {add(f'e{to[q]}', 'cut', 'K')} ELSE {never} END")
                if x != "s":
                    ways.append(f"CASE WHEN NOT bad THEN {add(f'e{to[q]}', '3 + cut', 'R')} ELSE {never} END")
        return f"least({', '.join(ways)})"

    ins = lambda x, n=1: add(x, 3, "I") if n == 1 else add(ins(x), 3, "I")
    best = {0: ["a0", ins("a2"), ins("a3", 2)], 1: ["a1", ins("a2"), ins("a3", 2)], 2: ["a2", ins("a3")], 3: ["a3", ins("a2")]}
    return f"""WITH RECURSIVE t0 AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations
    ), t1 AS (SELECT *, {crc} % 20 AS damage FROM t0
    ), t2 AS (
      SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN damage = 1 THEN '' WHEN damage = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy FROM t1 WHERE damage <> 0
    ), t3 AS (
      SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS total, left(role, 1) AS r, rtrim(text, {ws}) AS bare,
             lag(left(role, 1)) OVER o || left(role, 1) AS pair, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
      FROM t2 WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
    ), t4 AS MATERIALIZED (
      SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM t3
    ), facts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t4 GROUP BY conv_id
    ), dp AS (
      SELECT DISTINCT conv_id, total AS i, '000000' AS e0, '000006II' AS e1, '000003I' AS e2, '000000' AS e3 FROM t4
      UNION ALL
      SELECT conv_id, i - 1, least({', '.join(best[0])}), least({', '.join(best[1])}), least({', '.join(best[2])}), least({', '.join(best[3])})
      FROM (
        SELECT conv_id, i, {', '.join(f'{act(q)} AS a{q}' for q in range(4))} FROM (
          SELECT dp.*, t4.r, t4.fault IN ('blank', 'duplicate') AS bad, CASE WHEN t4.fault = 'truncated' THEN 3 ELSE 0 END AS cut
          FROM dp JOIN t4 ON t4.conv_id IS NOT DISTINCT FROM dp.conv_id AND t4.i = dp.i))
    ), won AS (SELECT conv_id, CAST(e0[1:6] AS BIGINT) AS cost, e0[7:] AS audit FROM dp WHERE i = 0
    ), letters AS (
      SELECT conv_id, k, audit[k] AS x, k - len(replace(audit[1:k], 'D', '')) AS gone, len(replace(audit[1:k], 'I', '')) AS i
      FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM won)
    ), placed AS (
      SELECT l.conv_id, k, x, k - gone AS place, role, text FROM letters l
      LEFT JOIN t4 ON x <> 'I' AND t4.conv_id IS NOT DISTINCT FROM l.conv_id AND t4.i = l.i WHERE x <> 'D'
    ), led AS (SELECT *, max(CASE WHEN place = 1 AND x = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM placed
    ), told AS (
      SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
             CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS h FROM led GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLES = {
    "op8_stupid_backoff": BACKOFF, "op10_line_dedup": LINE_DEDUP, "op4_mix_sources": MIX, "op11_decontaminate": LEAKS,
    "op12_bisector_clusters": _clusters(), "op13_repair_conversations": _repair(),
}
