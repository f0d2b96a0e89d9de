"""The SQL twin of boosted trees: cuts, codes, and each level of each round as one step of a chain."""

from __future__ import annotations

from collections.abc import Sequence

from shopgrain.ml.boosting import HIGHEST, SCALE, Boosting
from shopgrain.ml.forest import DRAWN_AT_MOST, ForestSettings


def _whole(value: str) -> str:
    return f"floor(({value}) * {SCALE} + 0.5)::bigint"


def _binned(numeric: Sequence[str], categorical: Sequence[str], bins: int, max_codes: int, key: str, carried: str) -> dict[str, str]:
    """Cuts, codes, and the bins of all rows of a table ``weighted`` over ``known``."""
    numbers = " union all ".join(f"select {i} as input, {n}::double as value from known where split = 'train'" for i, n in enumerate(numeric))
    values = " union all ".join(f"select {i} as input, {n}::varchar as value from known where split = 'train'" for i, n in enumerate(categorical))
    return {
        "cut_lists": f"""
            select {", ".join(f"coalesce(list(distinct value order by value) filter (input = {i}), []) as cut_{i}" for i in range(len(numeric)))}
            from (select *, row_number() over (partition by input order by value) as r, count(*) over (partition by input) as n
              from ({numbers}) where value is not null)
            join (select unnest(range(1, {bins})) as i) on r = greatest((i * n + {bins - 1}) // {bins}, 1)""",
        "code_lists": f"""
            select {", ".join(f"coalesce(list(value order by place) filter (input = {i}), []) as codes_{i}" for i in range(len(categorical))) or "0 as none"}
            from (select *, row_number() over (partition by input order by n desc, value) as place
              from (select input, value, count(*) as n from ({values or "select 0 as input, '' as value"}) where value is not null group by all))
            where place <= {max_codes}""",
        "binned": "select {key}, split, {carried}, [{bins}] as bins from weighted, cut_lists, code_lists".format(
            key=key, carried=carried, bins=", ".join([
                *[f"len(list_filter(cut_{i}, lambda c: c <= {n}::double))::int" for i, n in enumerate(numeric)],
                *[f"coalesce(list_position(codes_{i}, {n}::varchar), 0)::int" for i, n in enumerate(categorical)],
            ])),
    }


def forest_steps(
    rows: str, numeric: Sequence[str], categorical: Sequence[str], s: ForestSettings, levels: int, key: str = "order_id",
) -> dict[str, str]:
    """Steps over a table of rows with ``label`` and ``split``; the last, ``averaged``, has the predictions of all rows.

    Nodes are named by numbers that double with each level, so there can be at most 120 of these.
    """
    drawn = f"('0x' || substr(md5(md5(concat_ws(':', {key}, '{s.seed}')) || ':' || k), 1, 8))::bigint"
    weight = " + ".join(f"({drawn} >= {cut})::int" for cut in DRAWN_AT_MOST) if s.bootstrap else "1"
    steps = {
        "known": f"select * from {rows} where label is not null", "weighted": "select * from known",
        **_binned(numeric, categorical, s.bins, s.max_codes, key, "label"),
        "rows_0": f"""select *, case when split = 'train' then {weight} else 0 end as w from (select {key}, split, bins,
            floor(label::double * {SCALE} + 0.5)::bigint as y, unnest(range({s.trees})) as k, 1::hugeint as node, null::double as value, false as done from binned)""",
    }
    for level in range(levels + 1):
        limit = s.max_depth is None or level < s.max_depth
        steps[f"sums_{level}"] = f"""
            select k, node, f, bin, sum(g) over w as g, sum(h) over w as h,
              case when f < {len(numeric)} then sum(g) over w - sum(g) over u else g end as gr,
              case when f < {len(numeric)} then sum(h) over w - sum(h) over u else h end as hr
            from (select k, node, f, bin, sum(g)::hugeint as g, sum(w)::hugeint as h from (
                select k, node, y * w as g, w, unnest(range({len(numeric) + len(categorical)})) as f, unnest(bins) as bin
                from rows_{level} where w > 0 and not done) group by all)
            window w as (partition by k, node, f), u as (partition by k, node, f order by bin rows between unbounded preceding and current row)"""
        steps[f"best_{level}"] = f"""
            select k, node, any_value(g)::double / any_value(h)::double / {SCALE} as value, max(f) filter (first) as f, max(bin) filter (first) as bin
            from (select *, usable and row_number() over (partition by k, node order by usable desc, gain desc, f, bin) = 1 as first
              from (select *, {limit} and hr > 0 and hr < h and gain > 0 and h >= {s.least_rows} as usable from (select *,
                gr::double * gr::double / hr::double + (g - gr)::double * (g - gr)::double / (h - hr)::double
                  - g::double * g::double / h::double as gain from sums_{level})))
            group by k, node"""
        steps[f"rows_{level + 1}"] = f"""
            select r.* replace (coalesce(b.value, r.value) as value, r.done or b.f is null as done, case when b.f is null then r.node else
              2 * r.node + (case when b.f < {len(numeric)} then r.bins[b.f + 1] > b.bin else r.bins[b.f + 1] = b.bin end)::int end as node)
            from rows_{level} r left join best_{level} b on not r.done and r.k = b.k and r.node = b.node"""
    steps["averaged"] = f"select {key}, split, avg(value) as prediction from rows_{levels + 1} group by all"
    return steps


def boosted_steps(
    rows: str, numeric: Sequence[str], categorical: Sequence[str], objective: str, s: Boosting, classes: Sequence = (),
    weight: str = "1.0::double", key: str = "order_id",
) -> dict[str, str]:
    """Steps over a table of rows with ``label`` and ``split``; the last, ``scored``, has margins ``m`` and probabilities ``p``."""
    n_trees = len(classes) if objective == "softmax" else 1
    y = {"squared": "label::double", "logistic": "label::int", "softmax": f"list_position({list(classes)}, label) - 1"}[objective]
    steps = {
        "known": f"select *, {y} as y from {rows} where label is not null",
        "weighted": f"select *, {weight} as w from known",
        **_binned(numeric, categorical, s.bins, s.max_codes, key, "y, w"),
    }
    train = "(select * from binned where split = 'train')"
    if objective == "squared":
        base = f"select [sum({_whole('w * y')})::double / sum({_whole('w')})::double] as base from {train}"
    elif objective == "logistic":
        base = (f"select [ln(part / (1 - part))] as base from (select least(greatest(sum({_whole('w')}) filter (y = 1)::double / "
                f"sum({_whole('w')})::double, 1e-6), 1 - 1e-6) as part from {train})")
    else:
        parts = ", ".join(f"ln(greatest(coalesce(sum({_whole('w')}) filter (y = {k}), 0), 1)::double / sum({_whole('w')})::double)" for k in range(n_trees))
        base = f"select [{parts}] as base from {train}"
    steps["base"] = base
    steps["unit"] = (
        f"select pow(2.0, ceil(log2(max(abs(y - base[1]))))) as unit from {train}, base" if objective == "squared" else "select 1.0::double as unit"
    )
    steps["state_0"] = "select b.*, base as m from binned b, base"
    l2 = int(s.l2 * SCALE)
    n_inputs = len(numeric) + len(categorical)

    def share(part: float) -> str:
        return format(int(part * 2**32), "08x")

    def p_of(state: str) -> str:
        if objective == "squared":
            return f"select *, m as p from {state}"
        if objective == "logistic":
            return f"select * exclude (q), [1.0 - q, q] as p from (select *, 1.0 / (1.0 + exp(-m[1])) as q from {state})"
        total = "+".join(["0.0::double", *[f"e[{k + 1}]" for k in range(n_trees)]])
        return (f"select * exclude (e), list_transform(e, lambda x: x / ({total})) as p from "
                f"(select *, list_transform(m, lambda x: exp(x - list_max(m))) as e from {state})")

    def pair(k: int) -> str:
        if objective == "squared":
            return f"{{'k': 0, 'g': {_whole('w * (m[1] - y) / unit')}, 'h': {_whole('w')}}}"
        if objective == "logistic":
            return f"{{'k': 0, 'g': {_whole('w * (p[2] - y)')}, 'h': {_whole('w * (p[2] * (1.0 - p[2]))')}}}"
        q = f"p[{k + 1}]"
        return f"{{'k': {k}, 'g': {_whole(f'w * ({q} - case when y = {k} then 1.0 else 0.0 end)')}, 'h': {_whole(f'w * ({q} * (1.0 - {q}))')}}}"

    for r in range(s.rounds):
        steps[f"p_{r}"] = p_of(f"state_{r}")
        steps[f"grown_{r}_0"] = (
            f"select x.*, [{', '.join(map(pair, range(n_trees)))}] as t, [{', '.join(['0'] * n_trees)}] as nodes from p_{r} x, unit"
        )
        for level in range(s.depth):
            at, here = f"{r}_{level}", 2 ** level
            sampled = f" and substr(md5(concat_ws(':', {key}, '{s.seed + r}')), 1, 8) < '{share(s.rows)}'" if s.rows < 1 else ""
            drawn = f"where substr(md5('{s.seed}:{r}:' || k || ':' || f), 1, 8) < '{share(s.columns)}'" if s.columns < 1 else ""
            steps[f"cells_{at}"] = f"""
                select u.k as k, nodes[u.k + 1] as node, f, bin, sum(u.g)::hugeint as g, sum(u.h)::hugeint as h, count(*) as n
                from (select u, nodes, unnest(range({n_inputs})) as f, unnest(bins) as bin
                  from (select nodes, bins, unnest(t) as u from grown_{at} where split = 'train'{sampled}))
                {drawn.replace(" k ", " u.k ")} group by all"""
            steps[f"sums_{at}"] = f"""
                select k, node, f, bin, sum(g) over w as g, sum(h) over w as h, sum(n) over w as n,
                  case when f < {len(numeric)} then sum(g) over w - sum(g) over u else g end as gr,
                  case when f < {len(numeric)} then sum(h) over w - sum(h) over u else h end as hr,
                  case when f < {len(numeric)} then sum(n) over w - sum(n) over u else n end as nr
                from cells_{at} window w as (partition by k, node, f),
                  u as (partition by k, node, f order by bin rows between unbounded preceding and current row)"""
            steps[f"best_{at}"] = f"""
                select k, node, any_value(g) as g, any_value(h) as h, max(gr) filter (first) as gr, max(hr) filter (first) as hr,
                  max(f) filter (first) as f, max(bin) filter (first) as bin
                from (select *, usable and row_number() over (partition by k, node order by usable desc, gain desc, f, bin) = 1 as first
                  from (select *, nr > 0 and nr < n and gain > 0 as usable from (select *,
                    gr::double * gr::double / (hr + {l2})::double + (g - gr)::double * (g - gr)::double / (h - hr + {l2})::double
                    - g::double * g::double / (h + {l2})::double as gain from sums_{at})))
                group by k, node"""
            steps[f"cuts_{at}"] = f"""
                select list(coalesce(f, 0) order by i) as f,
                  list(case when f is null then 1 when f < {len(numeric)} then bin + 1 else bin end order by i) as lo,
                  list(case when f is null then 0 when f < {len(numeric)} then {HIGHEST} else bin end order by i) as hi
                from (select unnest(range({n_trees * here})) as i) left join best_{at} on k = i // {here} and node = {here - 1} + i % {here}"""
            place = f"k * {here} + nodes[k + 1] - {here - 1} + 1"
            steps[f"grown_{r}_{level + 1}"] = f"""
                select x.* replace (list_transform(range({n_trees}), lambda k: 2 * nodes[k + 1] + 1 +
                  (bins[c.f[{place}] + 1] between c.lo[{place}] and c.hi[{place}])::int) as nodes)
                from grown_{at} x, cuts_{at} c"""
        last, leaves = f"{r}_{s.depth - 1}", 2 ** s.depth
        steps[f"leaves_{r}"] = f"""
            select list(coalesce(-({s.rate}::double * (g::double / (h + {l2})::double * unit)), 0.0) order by i) as v
            from (select unnest(range({n_trees * leaves})) as i) left join (
              select k, 2 * node + 1 as node, g - coalesce(gr, 0) as g, h - coalesce(hr, 0) as h from best_{last}
              union all select k, 2 * node + 2, gr, hr from best_{last} where gr is not null)
            on k = i // {leaves} and node = {leaves - 1} + i % {leaves}, unit"""
        steps[f"state_{r + 1}"] = f"""
            select x.* exclude (p, t, nodes) replace (list_transform(range({n_trees}), lambda k:
              m[k + 1] + v[k * {leaves} + nodes[k + 1] - {leaves - 1} + 1]) as m) from grown_{r}_{s.depth} x, leaves_{r}"""
    steps["scored"] = p_of(f"state_{s.rounds}")
    return steps
