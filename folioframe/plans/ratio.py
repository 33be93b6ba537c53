"""The sequence matcher's ratio in SQL, so that DuckDB can check the similarity joins.

Equal characters of two titles form runs along diagonals. Each step takes, inside
a range of both titles, the longest run (the first of equal ones), adds the equal
characters that touch it, and goes on with the ranges left and right of it. Of a
second title with 200 characters or more, characters that make up over a
hundredth do not start a run.
"""

from __future__ import annotations

KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
SQUASHED = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def key_of(column: str) -> str:
    return KEY.format(column)


def squashed_of(column: str) -> str:
    return SQUASHED.format(column)


def may_match(threshold: float, a: str = "a", b: str = "b") -> str:
    """A condition that every pair with that ratio meets: lengths, then edits (counted in bytes, hence the allowance for long letters)."""
    return (f"2 * least(length({a}), length({b})) >= {threshold} * (length({a}) + length({b})) - 1e-9 AND levenshtein({a}, {b}) <= "
            f"{1 - threshold} * (length({a}) + length({b})) + strlen({a}) - length({a}) + strlen({b}) - length({b}) + 1e-9")


def ratios(pairs: str) -> str:
    """Common table expressions that end with rt (a, b, ratio) for the distinct pairs (a, b) that the statement `pairs` gives."""
    runs = "SELECT pid, diag, min(i) AS i0, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY pid, diag ORDER BY i) AS g FROM eq{where}) GROUP BY pid, diag, g"
    return f"""
pq AS (SELECT row_number() OVER () AS pid, a, b, length(a) AS la, length(b) AS lb FROM (SELECT DISTINCT a, b FROM ({pairs}))),
ca AS (SELECT pid, unnest(range(la)) AS i, unnest(string_split(a, '')) AS c FROM pq),
cb AS (SELECT *, lb >= 200 AND count(*) OVER (PARTITION BY pid, c) > lb // 100 + 1 AS popular FROM (SELECT pid, lb, unnest(range(lb)) AS j, unnest(string_split(b, '')) AS c FROM pq)),
eq AS (SELECT pid, i, j - i AS diag, popular FROM ca JOIN cb USING (pid, c)),
fr AS ({runs.format(where='')}),
nr AS ({runs.format(where=' WHERE NOT popular')}),
rec AS (
  SELECT pid, 0::BIGINT AS alo, la AS ahi, 0::BIGINT AS blo, lb AS bhi, 0::BIGINT AS size FROM pq WHERE la > 0 AND lb > 0
  UNION ALL
  SELECT pid, x.alo, x.ahi, x.blo, x.bhi, x.size FROM (
    SELECT w.pid, unnest(CASE WHEN t > s THEN [{{'alo': w.alo, 'ahi': s, 'blo': w.blo, 'bhi': s + d, 'size': 0::BIGINT}}, {{'alo': t, 'ahi': w.ahi, 'blo': t + d, 'bhi': w.bhi, 'size': 0::BIGINT}}, {{'alo': 0::BIGINT, 'ahi': 0::BIGINT, 'blo': 0::BIGINT, 'bhi': 0::BIGINT, 'size': t - s}}] END) AS x
    FROM (
      SELECT z.*, CASE WHEN z.best[1] < 0 THEN greatest(f.i0, z.alo, z.blo - z.d) ELSE z.alo END AS s, CASE WHEN f.i0 IS NULL THEN z.alo ELSE least(f.i0 + f.n, z.ahi, z.bhi - z.d) END AS t
      FROM (SELECT y.*, y.best[3] - y.best[2] AS d FROM (
          SELECT r.pid, r.alo, r.ahi, r.blo, r.bhi, coalesce(min(CASE WHEN q.pid IS NOT NULL AND least(q.i0 + q.n, r.ahi, r.bhi - q.diag) > greatest(q.i0, r.alo, r.blo - q.diag)
              THEN [greatest(q.i0, r.alo, r.blo - q.diag) - least(q.i0 + q.n, r.ahi, r.bhi - q.diag), greatest(q.i0, r.alo, r.blo - q.diag), greatest(q.i0, r.alo, r.blo - q.diag) + q.diag] END), [0, r.alo, r.blo]) AS best
          FROM rec r LEFT JOIN nr q ON q.pid = r.pid WHERE r.alo < r.ahi AND r.blo < r.bhi GROUP BY r.pid, r.alo, r.ahi, r.blo, r.bhi) y) z
      LEFT JOIN fr f ON f.pid = z.pid AND f.diag = z.d AND z.best[2] >= f.i0 AND z.best[2] < f.i0 + f.n) w)),
rt AS (SELECT a, b, CASE WHEN la + lb = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(m, 0) / (la + lb) END AS ratio FROM pq LEFT JOIN (SELECT pid, sum(size) AS m FROM rec GROUP BY pid) USING (pid))"""
