"""Registering queries with their SQL, and the common tables of that SQL."""

from __future__ import annotations

from collections.abc import Callable

#: Common tables, in the order in which they use each other.
COMMON = """
ev AS (SELECT event_id, user_id, event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS pos, value FROM events),
bins AS (SELECT range AS bin_id, 3600 * range AS bs, 3600 * range + 3600 - (range % 7) * 300 AS be FROM range(720)),
bins6 AS (SELECT range AS bin_id, 21600 * range AS bs, 21600 * range + 21600 - (range % 7) * 1800 AS be FROM range(120)),
nxt AS (SELECT event_id AS pair_id, chrom AS chrom1, pos AS p1, lead(chrom, 1) OVER w AS chrom_a, lead(pos, 1) OVER w AS p_a, lead(chrom, 2) OVER w AS chrom_b, lead(pos, 2) OVER w AS p_b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id)),
ends AS (SELECT 'a' AS m, pair_id, chrom1 AS chrom, p1, p_a AS p2 FROM nxt WHERE chrom1 = chrom_a UNION ALL SELECT 'b', pair_id, chrom1, p1, p_b FROM nxt WHERE chrom1 = chrom_b),
cand AS (SELECT m, pair_id, chrom, x.bin_id AS b1, y.bin_id AS b2, least(p1 + 900, x.be) - greatest(p1, x.bs) + least(p2 + 900, y.be) - greatest(p2, y.bs) AS olp_sum FROM ends JOIN bins x ON p1 < x.be AND p1 + 900 > x.bs JOIN bins y ON p2 < y.be AND p2 + 900 > y.bs),
cand6 AS (SELECT m, pair_id, chrom, x.bin_id AS b1, y.bin_id AS b2, least(p1 + 5400, x.be) - greatest(p1, x.bs) + least(p2 + 5400, y.be) - greatest(p2, y.bs) AS olp_sum FROM ends JOIN bins6 x ON p1 < x.be AND p1 + 5400 > x.bs JOIN bins6 y ON p2 < y.be AND p2 + 5400 > y.bs),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, pair_id ORDER BY olp_sum DESC, b1, b2) AS rn FROM cand) WHERE rn = 1),
best6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, pair_id ORDER BY olp_sum DESC, b1, b2) AS rn FROM cand6) WHERE rn = 1),
maps AS (SELECT m, chrom, least(b1, b2) AS bin1_id, greatest(b1, b2) AS bin2_id, count(*) AS cnt FROM best GROUP BY ALL),
maps6 AS (SELECT m, chrom, least(b1, b2) AS bin1_id, greatest(b1, b2) AS bin2_id, count(*) AS cnt FROM best6 GROUP BY ALL),
map_a AS (SELECT chrom, bin1_id, bin2_id, cnt FROM maps WHERE m = 'a'),
map_b AS (SELECT chrom, bin1_id, bin2_id, cnt FROM maps WHERE m = 'b'),
map6_a AS (SELECT chrom, bin1_id, bin2_id, cnt FROM maps6 WHERE m = 'a'),
map6_b AS (SELECT chrom, bin1_id, bin2_id, cnt FROM maps6 WHERE m = 'b'),
full6 AS (SELECT chrom, bin1_id AS i, bin2_id AS j, cnt FROM map6_a UNION ALL SELECT chrom, bin2_id, bin1_id, cnt FROM map6_a WHERE bin1_id <> bin2_id),
marg6 AS (SELECT chrom, i AS bin_id, sum(cnt) AS marginal FROM full6 GROUP BY ALL),
sites AS (SELECT event_id, pos - 1 AS s, pos + 1 AS e FROM ev WHERE chrom = 'error'),
hours AS (SELECT c.chrom, h.range AS hour, count(event_id) AS n, avg(value) AS value FROM (SELECT DISTINCT chrom FROM ev) c CROSS JOIN range(720) h LEFT JOIN ev ON ev.chrom = c.chrom AND ev.pos // 3600 = h.range GROUP BY ALL)"""


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, plain: bool = False, recursive: bool = False) -> Callable:
        """A decorator: the function's name is the query's. sql may use COMMON; begin it with a comma to add common tables, or set plain. recursive: these tables may use themselves."""

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                text = sql.strip()
                self.sql[f.__name__] = text if plain else ("WITH RECURSIVE" if recursive else "WITH") + COMMON + ("" if text.startswith(",") else "\n") + text
            return f

        return add
