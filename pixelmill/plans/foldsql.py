"""SQL of queries whose state runs along a plane: a fold over the list of its samples, in raster order.

A list element holds a sample's inputs and room for the state, so that a fold's result has the type of an element.
"""

from __future__ import annotations

from . import sql

#: rs: every sample with its copied-border neighbours, residual r, activity q and energy class e.
SAMPLES = (
    sql.EVT,
    sql.ycocg("evt"),
    sql.taps(),
    f"""sm AS (SELECT b4.*, b4.v - {sql.med("b4.a", "b4.b", "b4.c")} AS r, {sql.med("z.a", "z.b", "z.c")} AS med17,
  CAST((abs(z.a - z.c) + abs(z.b - z.c) >= 4) AS INTEGER) + CAST((abs(z.a - z.c) + abs(z.b - z.c) >= 12) AS INTEGER) + CAST((abs(z.a - z.c) + abs(z.b - z.c) >= 48) AS INTEGER) AS q,
  least(8, (abs(b4.a - b4.c) + abs(b4.b - b4.c)) >> 4) AS e
  FROM b4 JOIN b17 z ON z.img = b4.img AND z.ch = b4.ch AND z.i = b4.i AND z.j = b4.j),
rs AS (SELECT *, CAST(2 * abs(r) - (r > 0)::INT AS BIGINT) AS m, CAST(abs(r) AS BIGINT) AS g FROM sm)""",
)


def struct(fields: dict[str, str]) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def fold(name: str, inputs: dict[str, str], state: dict[str, str], step: dict[str, str], order: str = "i, j", source: str = "rs", let: dict[str, str] | None = None, by: str = "img, ch") -> str:
    """name: by and s, the last element: its state after all samples. In step, o_ is the state before, x the sample and y.* what let names."""
    start = struct({k: f"CAST(0 AS {t.split(' AS ')[1]})" if " AS " in t else "0" for k, t in inputs.items()} | state)
    element = struct({k: f"CAST({t})" if " AS " in t else t for k, t in inputs.items()} | state)
    after = struct({k: f"x.{k}" for k in inputs} | step)
    if let:
        after = f"list_transform([{struct(let)}], lambda y: {after})[1]"
    return f"{name} AS (SELECT {by}, list_reduce(list_prepend({start}, list({element} ORDER BY {order})), lambda o_, x: {after}) AS s FROM {source} GROUP BY {by})"


def put(items: str, at: str, value: str) -> str:
    """The list with another value at a place."""
    return f"list_transform({items}, lambda v_, i_: CASE WHEN i_ = {at} THEN {value} ELSE v_ END)"


def same(value: int, times: int) -> str:
    return "[" + ", ".join([f"{value}::BIGINT"] * times) + "]"


def parameter(total: str, count: str, most: int) -> str:
    return f"(CASE WHEN {total} > {count} THEN least({most}, length(bin(({total} - 1) // {count}))) ELSE 0 END)"


def rates(name: str, context: str, states: int, grow: str = "g", total: int = 4, count: int = 1, reset: int = 64, most: int = 60) -> str:
    """name: s.bits of adaptive Golomb codes with a state for each context."""
    at = "x.q + 1"
    let = {"k": parameter(f"o_.t[{at}]", f"o_.c[{at}]", most), "t": f"o_.t[{at}] + x.{grow}", "c": f"o_.c[{at}] + 1"}
    step = {
        "t": put("o_.t", at, f"CASE WHEN y.c >= {reset} THEN y.t // 2 ELSE y.t END"),
        "c": put("o_.c", at, f"CASE WHEN y.c >= {reset} THEN greatest(1, y.c // 2) ELSE y.c END"),
        "bits": "o_.bits + (x.m >> y.k) + 1 + y.k",
    }
    return fold(name, {"m": "m AS BIGINT", "g": "g AS BIGINT", "q": f"{context} AS BIGINT"}, {"t": same(total, states), "c": same(count, states), "bits": "0::BIGINT"}, step, let=let)


GOLOMB_ACTIVITY = sql.q(*SAMPLES, rates("fa", "q", 4), rates("fs", "0", 1), "SELECT img, ch, fa.s.bits AS bits, fs.s.bits AS single FROM fa JOIN fs USING (img, ch)")
_ENDLESS = 1 << 60
GOLOMB_GROUPS = sql.q(*SAMPLES, rates("fe", "e", 9, "m", 2, 2, _ENDLESS, 12), rates("fj", "e * 4 + q", 36), "SELECT img, ch, fe.s.bits AS by_group, fj.s.bits AS joint FROM fe JOIN fj USING (img, ch)")


def _runs() -> str:
    """A run goes on from a sample of least activity over zeros; what ends it is priced in the state of least activity, less one."""
    on = "(o_.inrun OR x.q = 0)"
    at = f"(CASE WHEN {on} THEN 0 ELSE x.q END + 1)"
    ends = f"({on} AND x.r <> 0)"
    size = "(CASE WHEN o_.inrun THEN o_.len ELSE 0 END)"
    let = {
        "covers": f"({on} AND x.r = 0)", "ends": ends, "len": size,
        "kr": parameter("o_.rt", "o_.rc", 60), "rt": f"o_.rt + {size}", "rc": "o_.rc + 1",
        "k": parameter(f"o_.t[{at}]", f"o_.c[{at}]", 60), "t": f"o_.t[{at}] + x.g", "c": f"o_.c[{at}] + 1", "at": at,
        "m": f"x.m - CASE WHEN {on} THEN 1 ELSE 0 END",
    }
    step = {
        "inrun": "y.covers", "len": "CASE WHEN y.covers THEN y.len + 1 ELSE 0 END",
        "rt": "CASE WHEN NOT y.ends THEN o_.rt WHEN y.rc >= 64 THEN y.rt // 2 ELSE y.rt END",
        "rc": "CASE WHEN NOT y.ends THEN o_.rc WHEN y.rc >= 64 THEN greatest(1, y.rc // 2) ELSE y.rc END",
        "t": f"CASE WHEN y.covers THEN o_.t ELSE {put('o_.t', 'y.at', 'CASE WHEN y.c >= 64 THEN y.t // 2 ELSE y.t END')} END",
        "c": f"CASE WHEN y.covers THEN o_.c ELSE {put('o_.c', 'y.at', 'CASE WHEN y.c >= 64 THEN greatest(1, y.c // 2) ELSE y.c END')} END",
        "bits": "o_.bits + CASE WHEN y.ends THEN (y.len >> y.kr) + 1 + y.kr ELSE 0 END + CASE WHEN y.covers THEN 0 ELSE (y.m >> y.k) + 1 + y.k END",
    }
    state = {"inrun": "false", "len": "0::BIGINT", "rt": "4::BIGINT", "rc": "1::BIGINT", "t": same(4, 4), "c": same(1, 4), "bits": "0::BIGINT"}
    return fold("fr", {"r": "r AS BIGINT", "m": "m AS BIGINT", "g": "g AS BIGINT", "q": "q AS BIGINT"}, state, step, let=let)


RUNS = sql.q(*SAMPLES, _runs(), f"SELECT img, ch, s.bits + CASE WHEN s.inrun THEN (s.len >> {parameter('s.rt', 's.rc', 60)}) + 1 + {parameter('s.rt', 's.rc', 60)} ELSE 0 END AS bits FROM fr")

MIXED = sql.q(
    *SAMPLES,
    fold(
        "fm",
        {"p": "abs(r) AS BIGINT", "o": "abs(v - ((a + b) >> 1)) AS BIGINT"},
        {"e0": "0::BIGINT", "e1": "0::BIGINT", "l1": "0::BIGINT"},
        {
            "e0": "CASE WHEN y.second THEN o_.e0 + ((y.err - o_.e0) >> 8) ELSE o_.e0 + (y.gap >> 6) + CASE WHEN y.gap > 0 AND y.gap % 64 >= 32 THEN 1 ELSE 0 END END",
            "e1": "CASE WHEN y.second THEN o_.e1 + (y.gap >> 6) + CASE WHEN y.gap > 0 AND y.gap % 64 >= 32 THEN 1 ELSE 0 END ELSE o_.e1 + ((y.err - o_.e1) >> 8) END",
            "l1": "o_.l1 + y.err",
        },
        let={"second": "o_.e0 > o_.e1", "err": "CASE WHEN o_.e0 > o_.e1 THEN x.o ELSE x.p END", "gap": "CASE WHEN o_.e0 > o_.e1 THEN x.o - o_.e1 ELSE x.p - o_.e0 END"},
    ),
    "SELECT img, ch, s.l1 AS l1 FROM fm",
)

_AT = "x.e + 1"
GAP_BIAS = sql.q(
    *SAMPLES,
    f"gp AS (SELECT *, {sql.gap(80)} AS p FROM rs)",
    fold(
        "fg",
        {"d": "v - p AS BIGINT", "e": "e AS BIGINT"},
        {"s": same(0, 9), "c": same(0, 9), "l1": "0::BIGINT", "plain": "0::BIGINT"},
        {
            "s": put("o_.s", _AT, "CASE WHEN y.c >= 64 THEN y.s >> 1 ELSE y.s END"),
            "c": put("o_.c", _AT, "CASE WHEN y.c >= 64 THEN y.c // 2 ELSE y.c END"),
            "l1": "o_.l1 + abs(y.d)",
            "plain": "o_.plain + abs(x.d)",
        },
        source="gp",
        # the guess goes down by one, up by one or stays; the sum of errors learns the corrected error
        let={
            "d": f"x.d + CASE WHEN o_.c[{_AT}] > 0 AND o_.s[{_AT}] <= -o_.c[{_AT}] THEN 1 WHEN o_.c[{_AT}] > 0 AND o_.s[{_AT}] > 0 THEN -1 ELSE 0 END",
            "s": f"CASE WHEN o_.c[{_AT}] > 0 AND o_.s[{_AT}] <= -o_.c[{_AT}] THEN o_.s[{_AT}] + o_.c[{_AT}] + x.d + 1 WHEN o_.c[{_AT}] > 0 AND o_.s[{_AT}] > 0 THEN o_.s[{_AT}] - o_.c[{_AT}] + x.d - 1 ELSE o_.s[{_AT}] + x.d END",
            "c": f"o_.c[{_AT}] + 1",
        },
    ),
    "SELECT img, ch, s.l1 AS l1, s.plain AS plain FROM fg",
)

_MIDDLE = "((list_sum(x.t) + 2) - (((list_sum(x.t) + 2) % 5) + 5) % 5) // 5"


def _taps_fold(name: str, weights: str, error: str, let: dict[str, str], moved: str) -> str:
    """A fold over five taps: y.e is the error, y.m the middle of the taps."""
    state = {"w": weights, "l1": "0::BIGINT"}
    after = struct({"v": "x.v", "t": "x.t", "w": moved, "l1": "o_.l1 + abs(y.e)"})
    start = struct({"v": "0::BIGINT", "t": same(0, 5)} | state)
    element = struct({"v": "CAST(v AS BIGINT)", "t": "[a::BIGINT, b::BIGINT, c::BIGINT, d::BIGINT, med17::BIGINT]"} | state)
    named = struct({"e": error, "m": f"CAST({_MIDDLE} AS BIGINT)"} | let)
    return f"{name} AS (SELECT img, ch, list_reduce(list_prepend({start}, list({element} ORDER BY i, j)), lambda o_, x: list_transform([{named}], lambda y: {after})[1]) AS s FROM rs GROUP BY img, ch)"


_DOT = "CAST(list_sum(list_transform(x.t, lambda u, i: u * o_.w[i])) AS BIGINT)"


def _sign(least: int) -> str:
    """Weights follow the signs of errors, are clipped, and then return to a sum of 16 one unit at a time."""
    turned = "list_transform(o_.w, lambda u, i: least(20, greatest(-8, u + CASE WHEN y.e > 0 THEN 1 ELSE -1 END * (CASE WHEN x.t[i] > y.m THEN 1 WHEN x.t[i] < y.m THEN -1 ELSE 0 END))))"
    unit = "CASE WHEN list_sum(p) < 16 THEN list_transform(p, lambda u, i: u + CASE WHEN i = list_position(p, list_min(p)) THEN 1 ELSE 0 END) WHEN list_sum(p) > 16 THEN list_transform(p, lambda u, i: u - CASE WHEN i = list_position(p, list_max(p)) THEN 1 ELSE 0 END) ELSE p END"
    back = f"list_reduce([{', '.join([turned] + [same(0, 5)] * 5)}], lambda p, z: {unit})"
    return _taps_fold(f"s{least}", "[3::BIGINT, 3::BIGINT, 3::BIGINT, 3::BIGINT, 4::BIGINT]", f"x.v - (({_DOT} + 8) >> 4)", {}, f"CASE WHEN abs(y.e) > {least} THEN {back} ELSE o_.w END")


SIGN_LMS = sql.q(*SAMPLES, _sign(0), _sign(3), "SELECT img, ch, s0.s.l1 AS l1_0, s3.s.l1 AS l1_3 FROM s0 JOIN s3 USING (img, ch)")

_STEP = f"(abs(x.v - ({_DOT} >> 4)) * 16 // (((CAST(list_sum(list_transform(x.t, lambda u: u * u)) AS BIGINT) >> 8) + 1) << 3) + 1)"
_MOVED = "CASE WHEN y.e = 0 THEN o_.w ELSE list_transform(o_.w, lambda u, i: CASE WHEN x.t[i] = y.m THEN u ELSE least(64, greatest(-64, u + CASE WHEN (y.e > 0) = (x.t[i] > y.m) THEN 1 ELSE -1 END * (y.step * abs(x.t[i] - y.m) // 256 + 1))) END) END"
MAGNITUDE_LMS = sql.q(*SAMPLES, _taps_fold("fn", f"{same(0, 4)[:-1]}, 16::BIGINT]", f"x.v - ({_DOT} >> 4)", {"step": _STEP}, _MOVED), "SELECT img, ch, s.l1 AS l1 FROM fn")

_HIST = "hist AS (SELECT img, ch, r AS sym, count(*) AS cnt FROM rs GROUP BY ALL)"

#: Codes of an optimal prefix code: of equal weights the older node goes first, leaves by symbol.
CODES = sql.q(
    *SAMPLES,
    _HIST,
    """c0 AS (SELECT img, ch, list_sort(list({'n': cnt::BIGINT, 'k': k, 'l': [{'s': sym, 'd': 0}]})) AS h, count(*) AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY img, ch ORDER BY sym) - 1 AS k FROM hist) GROUP BY img, ch),
c1 AS (SELECT img, ch, h, fresh FROM c0 UNION ALL SELECT img, ch, list_sort(list_append(h[3:], {'n': h[1].n + h[2].n, 'k': fresh, 'l': list_transform(list_concat(h[1].l, h[2].l), lambda z: {'s': z.s, 'd': z.d + 1})})), fresh + 1 FROM c1 WHERE len(h) > 1),
c2 AS (SELECT img, ch, unnest(h[1].l) AS z FROM c1 WHERE len(h) = 1),
c3 AS (SELECT img, ch, z.s AS sym, CAST(greatest(1, z.d) AS INTEGER) AS len, max(greatest(1, z.d)) OVER (PARTITION BY img, ch) AS most FROM c2)""",
    "SELECT img, ch, sym, len, CAST(CAST(coalesce(sum(1::BIGINT << (most - len)) OVER (PARTITION BY img, ch ORDER BY len, sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> (most - len) AS BIGINT) AS code FROM c3",
)

_SENT = "(CASE WHEN o_.z >= 16384 * x.f THEN 1 ELSE 0 END + CASE WHEN (o_.z >> 8) >= 16384 * x.f THEN 1 ELSE 0 END + CASE WHEN (o_.z >> 16) >= 16384 * x.f THEN 1 ELSE 0 END + CASE WHEN (o_.z >> 24) >= 16384 * x.f THEN 1 ELSE 0 END)"


def _ranged(by: str) -> str:
    """fz: s.n whole bytes that the range coder sends, from the last symbol to the first, for the histograms hist (by, sym, cnt)."""
    same_group = " AND ".join(f"f3.{c} = rs.{c}" for c in by.split(", "))
    own = ", ".join(f"rs.{c}" for c in by.split(", "))
    tables = f"""f0 AS (SELECT *, greatest(1, (cnt * 16384 + sum(cnt) OVER w // 2) // sum(cnt) OVER w) AS f FROM hist WINDOW w AS (PARTITION BY {by})),
f1 AS (SELECT *, 16384 - sum(f) OVER (PARTITION BY {by}) AS rest, row_number() OVER (PARTITION BY {by} ORDER BY cnt DESC, sym) AS nth FROM f0),
f2 AS (SELECT {by}, sym, CAST(f + CASE WHEN nth = 1 THEN rest ELSE 0 END AS BIGINT) AS f FROM f1),
f3 AS (SELECT *, CAST(coalesce(sum(f) OVER (PARTITION BY {by} ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo FROM f2),
sy AS (SELECT {own}, i, j, f, lo FROM rs JOIN f3 ON {same_group} AND f3.sym = r)"""
    coded = fold("fz", {"f": "f AS BIGINT", "lo": "lo AS BIGINT"}, {"z": "(1 << 20)::BIGINT", "n": "0::BIGINT"}, {"z": "((y.z // x.f) << 14) + y.z % x.f + x.lo", "n": "o_.n + y.sent"}, order="i DESC, j DESC", source="sy", let={"sent": _SENT, "z": f"o_.z >> (8 * {_SENT})"}, by=by)
    return tables + ",\n" + coded


RANGE = sql.q(
    *SAMPLES,
    _HIST,
    _ranged("img, ch"),
    "al AS (SELECT img, ch, count(*) AS alphabet FROM hist GROUP BY ALL)",
    "SELECT img, ch, s.n + 4 AS n_bytes, 16 + 32 * alphabet + 64 + 8 * (s.n + 4) AS bits, CAST(0 AS BIGINT) AS mismatches FROM fz JOIN al USING (img, ch)",
)

THREE_WAY = sql.q(
    *SAMPLES,
    "hist AS (SELECT img, ch, e, r AS sym, count(*) AS cnt FROM rs GROUP BY ALL)",
    _ranged("img, ch, e"),
    sql.huffman("img, ch, e"),
    sql.golomb("img, ch, e"),
    "ga AS (SELECT img, ch, e, min(bits) + 4 AS bits FROM gk GROUP BY ALL)",
    "ev_ AS (SELECT img, ch, e, 0 AS o, 'H' AS coder, huff + 16 + 24 * alphabet AS bits FROM hf UNION ALL SELECT img, ch, e, 1, 'G', bits FROM ga UNION ALL SELECT img, ch, e, 2, 'R', 16 + 32 * alphabet + 64 + 8 * (s.n + 4) FROM fz JOIN hf USING (img, ch, e))",
    sql.first("ev_", "img, ch, e", "bits, o", "best"),
    "SELECT img, ch, CAST(e AS INTEGER) AS e, coder, CAST(bits AS BIGINT) AS bits FROM best",
)

#: Prediction from reconstructed samples: the list has the last 65, the newest at its end, so that 2 is above in rows of 64.
_UNDER = "CASE WHEN x.i > 0 AND x.j > 0 THEN o_.back[1] WHEN x.j > 0 THEN o_.back[65] WHEN x.i > 0 THEN o_.back[2] ELSE 0 END"
_LEFT = "CASE WHEN x.j > 0 THEN o_.back[65] WHEN x.i > 0 THEN o_.back[2] ELSE 0 END"
_ABOVE = f"CASE WHEN x.i > 0 THEN o_.back[2] ELSE {_LEFT} END"


def _closed(tau: int) -> str:
    step = 2 * tau + 1
    p = sql.med("y.l", "y.t", "y.c")
    sym = f"CAST(round((x.v - {p}) / {step}::DOUBLE) AS BIGINT)"
    return fold(
        f"n{tau}",
        {"v": "v AS BIGINT", "i": "i AS BIGINT", "j": "j AS BIGINT"},
        {"back": same(0, 65), "worst": "0::BIGINT", "l1": "0::BIGINT", "size": "0::BIGINT"},
        {
            "back": f"list_append(o_.back[2:], {p} + {sym} * {step})",
            "worst": f"greatest(o_.worst, abs(x.v - {p} - {sym} * {step}))",
            "l1": f"o_.l1 + abs(x.v - {p} - {sym} * {step})",
            "size": f"o_.size + abs({sym})",
        },
        let={"l": _LEFT, "t": _ABOVE, "c": _UNDER},
    )


CLOSED_LOOP = sql.q(*SAMPLES, *map(_closed, range(3)), " UNION ALL ".join(f"SELECT img, ch, {t} AS tau, s.worst AS max_error, s.l1 AS l1, s.size AS symbols FROM n{t}" for t in range(3)))


def _rounds(tables: int, rounds: int) -> str:
    parts = [f"as0 AS (SELECT DISTINCT img, ch, CAST((((img * 3 + ch) % {tables}) + {tables}) % {tables} AS INTEGER) AS t FROM hist), al AS (SELECT img, ch, sum(cnt) AS n FROM hist GROUP BY ALL)"]
    for k in range(rounds):
        parts.append(
            f"""he{k} AS (SELECT t, sym, sum(cnt) AS c FROM hist JOIN as{k} USING (img, ch) GROUP BY ALL), to{k} AS (SELECT t, sum(c) AS n FROM he{k} GROUP BY ALL),
pr{k} AS (SELECT t, sym, -log2((c + 0.5::DOUBLE) / (n + 1024)) AS len FROM he{k} JOIN to{k} USING (t)), fl{k} AS (SELECT t, -log2(0.5::DOUBLE / (n + 1024)) AS none FROM to{k}),
me{k} AS (SELECT img, ch, t, sum(cnt * len) AS b, sum(cnt) AS m FROM hist JOIN pr{k} USING (sym) GROUP BY ALL),
co{k} AS (SELECT al.img, al.ch, f.t, round(coalesce(b, 0) + (n - coalesce(m, 0)) * none, 3) AS bits FROM al CROSS JOIN fl{k} f LEFT JOIN me{k} e ON e.img = al.img AND e.ch = al.ch AND e.t = f.t),
{sql.first(f"co{k}", "img, ch", "bits, t", f"be{k}")}, as{k + 1} AS (SELECT img, ch, t FROM be{k})"""
        )
    return ",\n".join(parts)


SHARED = sql.q(*SAMPLES, _HIST, _rounds(3, 3), "SELECT img, ch, t, bits FROM be2")

MIXTURES = sql.q(
    *SAMPLES,
    _HIST,
    "tb AS (SELECT s, w, q FROM (VALUES (0.5::DOUBLE), (1), (2), (4), (8), (16), (32)) a(s), (VALUES (0.5::DOUBLE), (0.75), (0.9)) b(w), (VALUES (3::DOUBLE), (6)) c(q))",
    "pr AS (SELECT img, ch, s, w, q, round(sum(cnt * least(64, -log2(greatest(w * exp(-abs(sym) / s) / (2 * s) + (1 - w) * exp(-abs(sym) / (s * q)) / (2 * s * q), 1e-19)))), 3) AS bits FROM hist, tb GROUP BY ALL)",
    sql.first("pr", "img, ch", "bits, s, w, q", "best"),
    "SELECT img, ch, s, w, q AS ratio, bits FROM best",
)

#: Gaussian windows of deviation 1.5 and 13 taps; borders are mirrored with the border sample twice.
_MIRROR = "CASE WHEN {p} < 0 THEN -1 - {p} WHEN {p} >= {n} THEN 2 * {n} - 1 - {p} ELSE {p} END"
SIMILARITY = sql.q(
    sql.EVT,
    sql.plain("evt"),
    "kn AS (SELECT k, exp(-(k * k) / 4.5) / sum(exp(-(k * k) / 4.5)) OVER () AS w FROM range(-6, 7) t(k))",
    "px AS (SELECT img, ch, i, j, v::DOUBLE AS x, greatest(0, least(255, round_even(v / 5.0, 0) * 5))::DOUBLE AS y, max(i) OVER (PARTITION BY img, ch) + 1 AS h FROM pl)",
    f"g1 AS (SELECT t.img, t.ch, t.i, t.j, t.h, sum(w * s.x) AS x, sum(w * s.y) AS y, sum(w * s.x * s.x) AS xx, sum(w * s.y * s.y) AS yy, sum(w * s.x * s.y) AS xy FROM px t, kn, px s WHERE s.img = t.img AND s.ch = t.ch AND s.j = t.j AND s.i = ({_MIRROR.format(p='(t.i + k)', n='t.h')}) GROUP BY ALL), "
    f"g2 AS (SELECT t.img, t.ch, t.i, t.j, sum(w * s.x) AS mx, sum(w * s.y) AS my, sum(w * s.xx) AS xx, sum(w * s.yy) AS yy, sum(w * s.xy) AS xy FROM g1 t, kn, g1 s WHERE s.img = t.img AND s.ch = t.ch AND s.i = t.i AND s.j = ({_MIRROR.format(p='(t.j + k)', n='64')}) GROUP BY ALL), "
    "si AS (SELECT img, ch, round(avg((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (xx - mx * mx + yy - my * my + 58.5225))), 6) AS s FROM g2 GROUP BY ALL)",
    "SELECT img, round(avg(s), 6) AS ssim FROM si GROUP BY img",
)
