"""Pieces of DuckDB's SQL for what grows, thins or walks over pixels, as recursive tables of (image_id, y, x, ...)."""

from __future__ import annotations

_CODE = "bit_or(CASE (q.y - t.y) * 3 + q.x - t.x WHEN -3 THEN 1 WHEN -2 THEN 2 WHEN 1 THEN 4 WHEN 4 THEN 8 WHEN 3 THEN 16 WHEN 2 THEN 32 WHEN -1 THEN 64 WHEN -4 THEN 128 ELSE 0 END)"
_BESIDE = "q.image_id = t.image_id AND q.y BETWEEN t.y - 1 AND t.y + 1 AND q.x BETWEEN t.x - 1 AND t.x + 1"


def _peeled(name: str, source: str, goes: str, idle: int) -> str:
    """Pixels that a rule on the ring code takes away in turns, until nothing has gone in ``idle`` turns of an image; what is
    left then has idle = that number."""
    return f"""{name} AS (SELECT image_id, y, x, 0 AS step, 0 AS idle FROM ({source})
  UNION ALL SELECT image_id, y, x, step + 1, idle FROM (
    SELECT image_id, y, x, step, goes, CASE WHEN bool_or(goes) OVER (PARTITION BY image_id) THEN 0 ELSE idle + 1 END AS idle FROM (
      SELECT image_id, y, x, step, idle, {goes} AS goes FROM (
        SELECT t.image_id, t.y, t.x, any_value(t.step) AS step, any_value(t.idle) AS idle, {_CODE} AS code FROM {name} t JOIN {name} q ON {_BESIDE} WHERE t.idle < {idle} GROUP BY 1, 2, 3))) WHERE NOT goes)"""


def thinned(name: str, source: str) -> str:
    """Zhang and Suen's two turns; what is left has idle = 2."""
    steps = "bit_count(~code & (code // 2 + (code & 1) * 128) & 255)"
    free = "CASE WHEN step % 2 = 0 THEN (code & 21) <> 21 AND (code & 84) <> 84 ELSE (code & 69) <> 69 AND (code & 81) <> 81 END"
    return _peeled(name, source, f"(bit_count(code) BETWEEN 2 AND 6 AND {steps} = 1 AND {free})", 2)


def stairless(name: str, source: str) -> str:
    """Without stair pixels, one parity of both axes in a turn; what is left has idle = 4."""
    bit = lambda k: f"((code >> {k % 8}) & 1)"
    corner = " OR ".join(f"({bit(k)} = 1 AND {bit(k + 2)} = 1)" for k in (0, 2, 4, 6))
    arcs = " + ".join(f"(1 - {bit(k)}) * (1 - (1 - {bit(k + 1)}) * (1 - {bit(k + 2)}))" for k in (0, 2, 4, 6))
    return _peeled(name, source, f"(y % 2 = step // 2 % 2 AND x % 2 = step % 2 AND ({corner}) AND {arcs} = 1)", 4)


def parts(name: str, source: str, kind: str = "0", four: bool = False) -> str:
    """The connected parts of pixels of one ``kind``: the least place spreads to neighbours until an image rests; then NOT moving,
    and root is the part's first place in reading order."""
    near = "abs(q.y - t.y) + abs(q.x - t.x) <= 1" if four else "true"
    return f"""{name} AS (SELECT image_id, y, x, {kind} AS kind, y * 64 + x AS root, true AS moving FROM ({source})
  UNION ALL SELECT image_id, y, x, kind, root, bool_or(moved) OVER (PARTITION BY image_id) FROM (
    SELECT t.image_id, t.y, t.x, any_value(t.kind) AS kind, min(q.root) AS root, min(q.root) < any_value(t.root) AS moved
    FROM {name} t JOIN {name} q ON {_BESIDE} AND q.kind = t.kind AND {near} WHERE t.moving GROUP BY 1, 2, 3))"""


def walked(name: str, ink: str, starts: str) -> str:
    """Moore's walk about each part from its first place: a row for each move, with how many were made and how long they are."""
    return f"""ring AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k, unnest([-1, -1, 0, 1, 1, 1, 0, -1]) AS dy, unnest([0, 1, 1, 1, 0, -1, -1, -1]) AS dx),
  {name} AS (SELECT image_id, root, root // 64 AS y, root % 64 AS x, 6 AS back, -1 AS k0, 0 AS n, 0::DOUBLE AS length FROM {starts}
  UNION ALL SELECT image_id, root, m.y, m.x, CASE WHEN m.k % 2 = 1 THEN (m.k + 5) % 8 ELSE (m.k + 6) % 8 END, CASE WHEN k0 < 0 THEN m.k ELSE k0 END, n + 1, length + m.far FROM (
    SELECT w.image_id, w.root, any_value(w.y * 64 + w.x) AS here, any_value(w.k0) AS k0, any_value(w.n) AS n, any_value(w.length) AS length,
      arg_min({{'y': p.y, 'x': p.x, 'k': r.k, 'far': sqrt((r.dy * r.dy + r.dx * r.dx)::DOUBLE)}}, (r.k - w.back + 15) % 8) AS m
    FROM {name} w, ring r, {ink} p WHERE p.image_id = w.image_id AND p.y = w.y + r.dy AND p.x = w.x + r.dx GROUP BY 1, 2)
  WHERE NOT (n > 0 AND here = root AND m.k = k0))"""
