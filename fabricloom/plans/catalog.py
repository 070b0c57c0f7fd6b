"""Where query modules register their queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The gridded stand-in: 8 tiles of 32 x 32 cells; a missing cell is open ground.
CELLS_SQL = """
cells AS (SELECT CAST(l_suppkey % 8 AS INT) AS tile_id, CAST(l_orderkey % 32 AS INT) AS r, CAST(l_partkey % 32 AS INT) AS c,
  CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3),
classed AS (SELECT *, CASE WHEN v % 100 < 30 THEN 'street' WHEN v % 100 < 55 THEN 'building' WHEN v % 100 < 70 THEN 'green'
  ELSE 'open' END AS cls, 4 + v % 97 AS h FROM cells),
grid AS (SELECT t.i AS tile_id, r.i AS r, c.i AS c FROM range(8) t(i), range(32) r(i), range(32) c(i)),
full_cells AS (SELECT CAST(g.tile_id AS INT) AS tile_id, CAST(g.r AS INT) AS r, CAST(g.c AS INT) AS c, coalesce(k.cls, 'open') AS cls,
  CASE WHEN k.cls = 'building' THEN k.h ELSE 0 END AS h FROM grid g LEFT JOIN classed k USING (tile_id, r, c))
"""


def query(name: str, sql: str | None = None, cells: bool = False):
    """Registers (spark, sf_dir) -> DataFrame. cells: the SQL starts with the tables of CELLS_SQL."""

    def add(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            if cells:
                body = f"WITH {CELLS_SQL}, {body[5:]}" if body.startswith("WITH ") else f"WITH {CELLS_SQL} {body}"
            ORACLES[name] = body
        return f

    return add
