"""Fragments of the SQL that the queries must equal (common table expressions for DuckDB)."""

from __future__ import annotations

from collections.abc import Sequence


def _level(k: int) -> str:
    return f"least(255, greatest(0, CAST(floor(CAST(embedding[3 * j + {k}] AS DOUBLE) * 255 + 128) AS INTEGER)))"


EMB = f"emb AS (SELECT vec_id // 64 AS img, CAST(vec_id % 64 AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {_level(1)} AS r, {_level(2)} AS g, {_level(3)} AS b FROM embeddings, range(21) AS t(j))"
EVT = """evt0 AS (SELECT event_id // 4096 AS img, CAST((event_id % 4096) // 64 AS INTEGER) AS i, CAST(event_id % 64 AS INTEGER) AS j, CAST(CAST(floor(value) AS BIGINT) % 256 AS INTEGER) AS r, CAST(hour(ts) * 10 AS INTEGER) AS g,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 50 WHEN 'purchase' THEN 100 WHEN 'signup' THEN 150 ELSE 200 END AS b FROM events),
evt AS (SELECT img, i, j, r, g, b FROM evt0 UNION ALL SELECT img, i, CAST(j + k AS INTEGER), r, g, b FROM (SELECT *, max(j) OVER (PARTITION BY img, i) AS last FROM evt0), range(1, 64) t(k) WHERE j = last AND j + k < 64)"""
DOC = """doc0 AS (SELECT doc_id AS img, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS p, length(text) AS n FROM documents WHERE length(text) > 0),
doc AS (SELECT img, 0 AS ch, CAST(p // 64 AS INTEGER) AS i, CAST(p % 64 AS INTEGER) AS j, CAST(unicode(c) % 256 AS INTEGER) AS v FROM (SELECT img, p, c FROM doc0 UNION ALL SELECT img, p + k, c FROM doc0, range(1, 64) t(k) WHERE p = n - 1 AND p + k < (n + 63) // 64 * 64))"""


def ycocg(source: str = "emb") -> str:
    """yc: source with y, co, cg; pl: its planes."""
    return f"""yc AS (SELECT img, i, j, t + (cg >> 1) AS y, co, cg FROM (SELECT *, g - t AS cg FROM (SELECT *, b + (co >> 1) AS t FROM (SELECT *, r - b AS co FROM {source})))),
pl AS (SELECT img, 0 AS ch, i, j, y AS v FROM yc UNION ALL SELECT img, 1, i, j, co FROM yc UNION ALL SELECT img, 2, i, j, cg FROM yc)"""


def plain(source: str = "emb") -> str:
    return f"pl AS (SELECT img, 0 AS ch, i, j, r AS v FROM {source} UNION ALL SELECT img, 1, i, j, g FROM {source} UNION ALL SELECT img, 2, i, j, b FROM {source})"


def taps(planes: str = "pl", extra: str = "") -> str:
    """tp: raw taps, null outside; b4: copied borders; b17: left and top copied, corners 0."""
    return f"""w1 AS (SELECT *, lag(v, 1) OVER wc AS t, lag(v, 2) OVER wc AS t2, lag(v, 3) OVER wc AS t3 FROM {planes} WINDOW wc AS (PARTITION BY img, ch, j ORDER BY i)),
tp AS (SELECT *, lag(v, 1) OVER wr AS l, lag(v, 2) OVER wr AS l2, lag(v, 3) OVER wr AS l3, lag(t, 1) OVER wr AS tl, lead(t, 1) OVER wr AS tr, lag(t, 2) OVER wr AS tl2, lead(t, 2) OVER wr AS tr2 FROM w1 WINDOW wr AS (PARTITION BY img, ch, i ORDER BY j)),
b4 AS (SELECT img, ch, i, j, v, coalesce(l, t, 0) AS a, coalesce(t, l, 0) AS b, coalesce(tl, l, t, 0) AS c, coalesce(tr, CASE WHEN i = 0 THEN coalesce(l, t, 0) ELSE coalesce(t, l, 0) END) AS d, coalesce(l2, l, t, 0) AS ww, coalesce(t2, t, l, 0) AS nne FROM tp),
b17 AS (SELECT img, ch, i, j, v, coalesce(l, t, 0) AS a, coalesce(t, l, 0) AS b, coalesce(tl, 0) AS c, coalesce(tr, 0) AS d FROM tp)"""


def med(a: str = "a", b: str = "b", c: str = "c") -> str:
    return f"(CASE WHEN {c} >= greatest({a}, {b}) THEN least({a}, {b}) WHEN {c} <= least({a}, {b}) THEN greatest({a}, {b}) ELSE {a} + {b} - {c} END)"


def gap(t: int) -> str:
    step = "(abs(a - c) + abs(b - nne) + abs(d - b) - abs(a - ww) - abs(b - c) - abs(b - d))"
    return f"(CASE WHEN {step} > {t} THEN a WHEN {step} < -{t} THEN b ELSE ((a + b) >> 1) + ((d - c) >> 2) END)"


PAETH = "(CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END)"


def third(x: str) -> str:
    return f"(({x}) - ((({x}) % 3) + 3) % 3) // 3"


BANK = {
    "MED": med(), "TOP": "b", "LEFT": "a", "PAETH": PAETH, "GRAD": "((a + b) >> 1) + ((b - c) >> 2)", "GAP80": gap(80), "DG": "(c + d) >> 1", "AVG_AB": "(a + b) >> 1",
    "PLANE": "a + b - c", "GAP32": gap(32), "AC": "(a + c) >> 1", "C": "c", "BC": "(b + c) >> 1", "D": "d", "GAP16": gap(16), "AVG3": third("a + b + c"),
}


def experts(names: Sequence[str] = tuple(BANK), source: str = "b4", keep: str = "img, ch, i, j, v", bank: dict[str, str] | None = None) -> str:
    """ex: a row per sample and expert, with ord, expert and p."""
    bank = bank or BANK
    return "ex AS (" + " UNION ALL ".join(f"SELECT {keep}, {k} AS ord, '{n}' AS expert, CAST({bank[n]} AS INTEGER) AS p FROM {source}" for k, n in enumerate(names)) + ")"


def huffman(by: str, hist: str = "hist", name: str = "hf") -> str:
    """hf: by, n, alphabet, huff (bits of an optimal prefix code, by merging the two least counts)."""
    cols = ", ".join(f"h.{c.strip()}" for c in by.split(","))
    return f"""{name}0 AS (SELECT {by}, sum(cnt)::BIGINT AS n, count(*) AS alphabet, list_sort(list(cnt::BIGINT)) AS c FROM {hist} GROUP BY ALL),
{name}1 AS (SELECT {by}, n, alphabet, c, CAST(0 AS BIGINT) AS bits FROM {name}0 UNION ALL SELECT {cols}, h.n, h.alphabet, list_sort(list_append(h.c[3:], h.c[1] + h.c[2])), h.bits + h.c[1] + h.c[2] FROM {name}1 h WHERE len(h.c) > 1),
{name} AS (SELECT {by}, n, alphabet, CASE WHEN alphabet = 1 THEN n ELSE bits END AS huff FROM {name}1 WHERE len(c) = 1)"""


ZIGZAG = "(CASE WHEN sym >= 0 THEN 2 * sym ELSE -2 * sym - 1 END)"


def golomb(by: str, hist: str = "hist", name: str = "gk", mapped: str = ZIGZAG, most: int = 12) -> str:
    """gk: by, k, bits for every k."""
    return f"{name} AS (SELECT {by}, CAST(k AS INTEGER) AS k, CAST(sum(cnt * (({mapped} >> k) + 1 + k)) AS BIGINT) AS bits FROM {hist}, range({most + 1}) AS kk(k) GROUP BY ALL)"


def first(source: str, by: str, order: str, name: str, keep: str = "*") -> str:
    """name: of each group the first row in the order."""
    return f"{name} AS (SELECT {keep} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn__ FROM {source}) WHERE rn__ = 1)"


def q(*parts: str) -> str:
    """A query from its common table expressions and, last, its body."""
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


LEVEL = "(CASE WHEN {g} < 0 THEN -1 ELSE 1 END) * ((abs({g}) > 0)::INT + (abs({g}) > 2)::INT + (abs({g}) > 7)::INT + (abs({g}) > 21)::INT)"
LOCO = f"""lq AS (SELECT *, {LEVEL.format(g="(b - c)")} AS q1, {LEVEL.format(g="(c - a)")} AS q2, {LEVEL.format(g="(d - b)")} AS q3 FROM b4),
lk AS (SELECT *, sgn * (q1 * 81 + q2 * 9 + q3) AS key FROM (SELECT *, CASE WHEN q1 < 0 OR (q1 = 0 AND (q2 < 0 OR (q2 = 0 AND q3 < 0))) THEN -1 ELSE 1 END AS sgn FROM lq))"""
