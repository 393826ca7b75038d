"""ANSI SQL twins of the registered queries (run by DuckDB on the same tables).

Written independently from the DataFrame code, from the algebra: products
and sums spelled out column by column, 2 x 2 ridge systems solved by Cramer's
rule. Every float is DOUBLE (no DECIMAL literals) and rounded as in
:mod:`twinfold.plans.catalog`.
"""

from __future__ import annotations

from twinfold.plans.catalog import COMMON, LAM, RANK, ROUND_LOSS, ROUND_MEAN, ROUND_SOLVE, ROUND_SUM

D = "DOUBLE"

# Fixed values, written out here so that a wrong constant in the code under test shows:
# the initialiser's recurrence and the rescale table (exclusive upper bound of the mode-1 index, factor).
LCG_IDX, LCG_COL, LCG_TENSOR, LCG_MODE, LCG_OFFSET, LCG_MOD = 7919, 104729, 15485863, 32452843, 17, 1000003
RESCALE = ((63, 301894.0), (360, 301895.0), (578, 230410.0), (719, 215337.0), (896, 299896.0), (1039, 116771.0),
           (1153, 301895.0), (1356, 299898.0), (1473, 301895.0), (1542, 299897.0), (1852, 301897.0))
RESCALE_ELSE = 100532.0


def dim(table: str) -> str:
    return f"(SELECT count(*) FROM {table})"


X1_DIMS = [dim("customer"), dim("part"), "12"]
X2_DIMS = [dim("supplier"), dim("part"), "12"]


def x1(three: bool = False) -> str:
    month = ", CAST(month(l.l_shipdate) - 1 AS BIGINT) AS i2" if three else ""
    group = "1, 2, 3" if three else "1, 2"
    return (f"SELECT o.o_custkey AS i0, l.l_partkey AS i1{month}, CAST(sum(l.l_quantity) AS {D}) AS y "
            f"FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY {group}")


def x2(three: bool = False) -> str:
    month = ", CAST(month(l_shipdate) - 1 AS BIGINT) AS i2" if three else ""
    group = "1, 2, 3" if three else "1, 2"
    return (f"SELECT l_suppkey AS i0, l_partkey AS i1{month}, max(l_extendedprice) / CAST(1000 AS {D}) AS y "
            f"FROM lineitem GROUP BY {group}")


def x3() -> str:
    return (f"SELECT l_partkey AS i0, CAST(month(l_shipdate) - 1 AS BIGINT) AS i1, CAST(count(*) AS {D}) AS y "
            f"FROM lineitem GROUP BY 1, 2")


HOLDOUT = "((i0 * 7 + i1 * 13) % 10) = 0"


def lcg(dim_sql: str, rank: int, t: int, m: int) -> str:
    cols = []
    for c in range(rank):
        base = c * LCG_COL + t * LCG_TENSOR + m * LCG_MODE + LCG_OFFSET
        cols.append(f"CAST((idx * {LCG_IDX} + {base}) % {LCG_MOD} AS {D}) / CAST({LCG_MOD} AS {D}) AS v{c}")
    return f"SELECT idx, {', '.join(cols)} FROM (SELECT unnest(range(0, {dim_sql})) AS idx)"


def rng(dim_sql: str) -> str:
    return f"SELECT unnest(range(0, {dim_sql})) AS idx"


def r(expr: str, digits: int) -> str:
    return f"round({expr}, {digits})"


def cramer2(s00, s01, s11, b0, b1) -> tuple[str, str]:
    det = f"(({s00}) * ({s11}) - ({s01}) * ({s01}))"
    return (f"((({b0}) * ({s11}) - ({b1}) * ({s01})) / {det})",
            f"((({s00}) * ({b1}) - ({s01}) * ({b0})) / {det})")


def q_tensor_x1():
    return x1()


def q_tensor_x2():
    return x2()


def q_tensor_x1_3mode():
    return x1(True)


def q_validation_x1():
    return f"SELECT * FROM ({x1()}) WHERE {HOLDOUT}"


def q_text_roundtrip_x2():
    return x2()


INDEX_EVENT_TYPE = ("SELECT event_type AS value, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS idx "
                    "FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)")


def q_index_event_type():
    return INDEX_EVENT_TYPE


def q_tensor_events():
    return (f"SELECT CAST(e.user_id AS BIGINT) AS i0, t.idx AS i1, CAST(count(*) AS {D}) AS y "
            f"FROM events e JOIN ({INDEX_EVENT_TYPE}) t ON e.event_type = t.value GROUP BY 1, 2")


def q_entry_counts():
    parts = []
    for ti, src in enumerate((x1(), x2())):
        parts.append(f"SELECT {ti} AS tensor, 'train' AS part, count(*) AS n FROM ({src}) WHERE NOT ({HOLDOUT})")
        parts.append(f"SELECT {ti} AS tensor, 'valid' AS part, count(*) AS n FROM ({src}) WHERE {HOLDOUT}")
    return " UNION ALL ".join(parts)


def q_slices_x1_part():
    return f"SELECT i1 AS key, count(*) AS n, sum(y) AS sum_y FROM ({x1()}) GROUP BY i1"


def q_coupled_slices():
    return (f"SELECT a.key, a.n_a, b.n_b FROM "
            f"(SELECT i1 AS key, count(*) AS n_a FROM ({x1()}) GROUP BY i1) a JOIN "
            f"(SELECT i1 AS key, count(*) AS n_b FROM ({x2()}) GROUP BY i1) b ON a.key = b.key")


def q_validate_x2_raw():
    raw = f"SELECT l_suppkey AS i0, l_partkey AS i1, l_extendedprice / CAST(1000 AS {D}) AS y FROM lineitem"
    issue = (f"CASE WHEN i0 IS NULL OR i1 IS NULL THEN 'null_index' "
             f"WHEN i0 < 0 OR i0 >= {dim('supplier')} OR i1 < 0 OR i1 >= {dim('part')} THEN 'out_of_range' "
             f"WHEN y IS NULL OR isnan(y) OR isinf(y) THEN 'bad_value' END")
    flagged = f"SELECT * FROM (SELECT i0, i1, y, {issue} AS issue FROM ({raw})) WHERE issue IS NOT NULL"
    dups = (f"SELECT r.i0, r.i1, r.y, 'duplicate' AS issue FROM ({raw}) r JOIN "
            f"(SELECT i0, i1 FROM ({raw}) GROUP BY i0, i1 HAVING count(*) > 1) d "
            f"ON r.i0 = d.i0 AND r.i1 = d.i1")
    return f"{flagged} UNION ALL {dups}"


def q_mode_key_x1():
    return f"SELECT i1 AS key, i0, i1, y FROM ({x1()})"


def q_slice_pages_x1():
    return q_mode_key_x1()


def q_validate_mixed():
    raw = (f"SELECT l_suppkey - 3 AS i0, CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END AS i1, "
           f"CASE l_linenumber WHEN 2 THEN 'nan'::{D} WHEN 3 THEN 'inf'::{D} WHEN 4 THEN NULL ELSE l_quantity::{D} END AS y "
           f"FROM lineitem")
    issue = (f"CASE WHEN i0 IS NULL OR i1 IS NULL THEN 'null_index' "
             f"WHEN i0 < 0 OR i0 >= {dim('supplier')} - 5 OR i1 < 0 OR i1 >= {dim('part')} - 7 THEN 'out_of_range' "
             f"WHEN y IS NULL OR isnan(y) OR isinf(y) THEN 'bad_value' END")
    flagged = f"SELECT * FROM (SELECT i0, i1, y, {issue} AS issue FROM ({raw})) WHERE issue IS NOT NULL"
    dups = (f"SELECT r.i0, r.i1, r.y, 'duplicate' AS issue FROM ({raw}) r JOIN "
            f"(SELECT i0, i1 FROM ({raw}) GROUP BY i0, i1 HAVING count(*) > 1) d ON r.i0 = d.i0 AND r.i1 = d.i1")
    return f"{flagged} UNION ALL {dups}"


def _lcg_over(column: str, table: str, rank: int, t: int, m: int) -> str:
    cells = ", ".join(f"CAST(({column} * {LCG_IDX} + {c * LCG_COL + t * LCG_TENSOR + m * LCG_MODE + LCG_OFFSET}) % {LCG_MOD} AS {D}) "
                      f"/ CAST({LCG_MOD} AS {D}) AS v{c}" for c in range(rank))
    return f"SELECT {column} AS idx, {cells} FROM {table}"


def _random(column: str, seed: int, t: int, m: int, c: int) -> str:
    return (f"(('0x' || substr(md5('{seed}:{t}:{m}:' || {column} || ':{c}'), 1, 13))::BIGINT)::{D} / CAST(4503599627370496 AS {D})")


def q_init_lcg():
    return _lcg_over("c_custkey", "customer", RANK, 0, 0)


def q_init_const():
    return f"SELECT p_partkey AS idx, {', '.join(f'CAST(1 AS {D}) AS v{c}' for c in range(RANK))} FROM part"


def q_init_diagonal():
    cols = ", ".join(f"CASE WHEN s_suppkey = {c} THEN CAST(1 AS {D}) ELSE CAST(0 AS {D}) END AS v{c}" for c in range(RANK))
    return f"SELECT s_suppkey AS idx, {cols} FROM supplier"


def q_init_diagonal_random():
    cols = ", ".join(f"CASE WHEN p_partkey >= 4 THEN {_random('p_partkey', 3, 1, 1, c)} WHEN p_partkey = {c} THEN CAST(2 AS {D}) "
                     f"ELSE CAST(0 AS {D}) END AS v{c}" for c in range(RANK))
    return f"SELECT p_partkey AS idx, {cols} FROM part"


def q_init_random():
    return f"SELECT c_custkey AS idx, {', '.join(f'{_random("c_custkey", 7, 0, 0, c)} AS v{c}' for c in range(RANK))} FROM customer"


def _updated(t: int, wls: bool = False) -> str:
    """``idx, v0, v1`` of mode 0 of tensor t after one update at rank 2 with the mean pull."""
    src, dims, other = ((x1(), X1_DIMS, X2_DIMS), (x2(), X2_DIMS, X1_DIMS))[t]
    length = f"CAST({dims[0]} AS {D})"
    joins = f"JOIN ({lcg(dims[1], 2, t, 1)}) f1 ON e.i1 = f1.idx"
    ne = _ne(src, "i0", ["f1.v0", "f1.v1"], "e.y", joins, 2)
    w, w2 = "1", "1"
    if wls:
        w, w2 = f"(CAST(1 AS {D}) / (SELECT count(*) FROM ({src})))", f"(CAST(1 AS {D}) / 2)"
    own = f"SELECT avg(v0) AS m0, avg(v1) AS m1 FROM ({lcg(dims[0], 2, t, 0)})"
    oth = f"SELECT avg(v0) AS m0, avg(v1) AS m1 FROM ({lcg(other[0], 2, 1 - t, 0)})"
    pull = f"{w2} * CAST(1 AS {D}) / ({length} * {length})"
    diag = [_lam(f"{w} * ne.ata_{c}_{c}") + f" + {pull}" for c in range(2)]
    b = [f"{w} * ne.atb_{c} + {w2} * (oth.m{c} - (own.m{c} - old.v{c} / {length})) / {length}" for c in range(2)]
    x0, x1_ = cramer2(diag[0], f"{w} * ne.ata_0_1", diag[1], b[0], b[1])
    solved = (f"SELECT old.idx, {x0} AS x0, {x1_} AS x1 FROM ({lcg(dims[0], 2, t, 0)}) old "
              f"JOIN ({ne}) ne ON old.idx = ne.key, ({own}) own, ({oth}) oth")
    return (f"SELECT old.idx, coalesce(s.x0, old.v0) AS v0, coalesce(s.x1, old.v1) AS v1 "
            f"FROM ({lcg(dims[0], 2, t, 0)}) old LEFT JOIN ({solved}) s ON old.idx = s.idx")


def _solved(inner: str, lead: str = "") -> str:
    return f"SELECT {lead}idx, {r('v0', ROUND_SOLVE)} AS v0, {r('v1', ROUND_SOLVE)} AS v1 FROM ({inner})"


def q_copy_factor():
    return _solved(_updated(0), "1 AS tensor, 1 AS mode, ")


def q_column_means():
    return f"SELECT {r('avg(v0)', ROUND_SOLVE)} AS m_0, {r('avg(v1)', ROUND_SOLVE)} AS m_1 FROM ({_updated(0)})"


def _updated_mean_loss() -> tuple[str, str]:
    mean = "SELECT avg(v0) AS m0, avg(v1) AS m1"
    return ("(a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1)",
            f"({mean} FROM ({_updated(0)})) a, ({mean} FROM ({_updated(1)})) b")


def q_mean_loss():
    se, src = _updated_mean_loss()
    return f"SELECT {r(se, ROUND_SOLVE)} AS mean_loss FROM {src}"


def q_mean_loss_wls():
    se, src = _updated_mean_loss()
    return f"SELECT {r(f'({se}) / 2', ROUND_SOLVE)} AS mean_loss FROM {src}"


def q_upsert_rows():
    old = _lcg_over("c_custkey", "customer", 2, 0, 0)
    return _solved(f"SELECT o.idx, CASE WHEN o.idx % 3 = 0 THEN n.v0 ELSE o.v0 END AS v0, "
                   f"CASE WHEN o.idx % 3 = 0 THEN n.v1 ELSE o.v1 END AS v1 FROM ({old}) o JOIN ({_updated(0)}) n ON o.idx = n.idx")


def q_upsert_block():
    old = _lcg_over("c_custkey", "customer", 2, 0, 0)
    return _solved(f"SELECT o.idx, o.v0, n.v1 FROM ({old}) o JOIN ({_updated(0)}) n ON o.idx = n.idx")


def q_factor_sink():
    return f"{_solved(_updated(0), '0 AS tensor, 0 AS mode, ')} UNION ALL {_solved(_updated(1), '1 AS tensor, 0 AS mode, ')}"


def _mean_loss_expr():
    a = ", ".join(f"avg(v{c}) AS a{c}" for c in range(RANK))
    b = ", ".join(f"avg(v{c}) AS b{c}" for c in range(RANK))
    se = " + ".join(f"(a{c} - b{c}) * (a{c} - b{c})" for c in range(RANK))
    src = (f"(SELECT {a} FROM ({lcg(dim('customer'), RANK, 0, 0)})) ma, "
           f"(SELECT {b} FROM ({lcg(dim('supplier'), RANK, 1, 0)})) mb")
    return se, src


def q_design_x1_3mode():
    a = ", ".join(f"{r(f'f1.v{c} * f2.v{c}', ROUND_MEAN)} AS a{c}" for c in range(RANK))
    return (f"SELECT e.i0, e.i1, e.i2, e.y, {a} FROM ({x1(True)}) e "
            f"JOIN ({lcg(X1_DIMS[1], RANK, 0, 1)}) f1 ON e.i1 = f1.idx "
            f"JOIN ({lcg(X1_DIMS[2], RANK, 0, 2)}) f2 ON e.i2 = f2.idx")


def _cp(a: str, b: str, cols) -> str:
    return " + ".join(f"{a}.v{c} * {b}.v{c}" for c in cols)


def _pred(src: str, dims, t: int, rank: int = RANK) -> str:
    return (f"SELECT e.i0, e.i1, e.y, ({_cp('f0', 'f1', range(rank))}) AS yhat FROM ({src}) e "
            f"JOIN ({lcg(dims[0], rank, t, 0)}) f0 ON e.i0 = f0.idx "
            f"JOIN ({lcg(dims[1], rank, t, 1)}) f1 ON e.i1 = f1.idx")


def q_predict_x1():
    return f"SELECT i0, i1, y, {r('yhat', ROUND_MEAN)} AS yhat FROM ({_pred(x1(), X1_DIMS, 0)})"


def q_prediction_sink():
    return f"SELECT i0, i1, {r('yhat', ROUND_MEAN)} AS yhat FROM ({_pred(x1(), X1_DIMS, 0)})"


def _sse(where: str | None):
    parts = []
    for ti, (src, dims) in enumerate(((x1(), X1_DIMS), (x2(), X2_DIMS))):
        s = src if where is None else f"SELECT * FROM ({src}) WHERE {where}"
        parts.append(f"SELECT {ti} AS tensor, sum((y - yhat) * (y - yhat)) AS sse, count(*) AS n "
                     f"FROM ({_pred(s, dims, ti)})")
    return " UNION ALL ".join(parts)


def q_training_loss():
    return f"SELECT tensor, {r('sse', ROUND_LOSS)} AS sse, n FROM ({_sse(f'NOT ({HOLDOUT})')})"


def q_validation_rmse():
    return f"SELECT tensor, {r('sqrt(sse / n)', ROUND_SUM)} AS rmse, n FROM ({_sse(HOLDOUT)})"


def q_total_loss():
    se, src = _mean_loss_expr()
    return (f"SELECT {r('sum(x)', ROUND_LOSS)} AS total_loss FROM ("
            f"SELECT sse AS x FROM ({_sse(None)}) UNION ALL SELECT {se} AS x FROM {src})")


def q_denormalise_x1():
    case = "CASE " + " ".join(f"WHEN i1 < {u} THEN CAST({s} AS {D})" for u, s in RESCALE)
    case += f" ELSE CAST({RESCALE_ELSE} AS {D}) END"
    return f"SELECT i0, i1, {r(f'yhat * ({case})', 4)} AS yhat_scaled FROM ({_pred(x1(), X1_DIMS, 0)})"


def _ne(src: str, key: str, design: list[str], target: str, joins: str, k: int) -> str:
    cells = []
    for p in range(k):
        for q in range(p, k):
            cells.append(f"sum(({design[p]}) * ({design[q]})) AS ata_{p}_{q}")
    rhs = [f"sum(({target}) * ({design[p]})) AS atb_{p}" for p in range(k)]
    return (f"SELECT e.{key} AS key, count(*) AS n, {', '.join(cells + rhs)} "
            f"FROM ({src}) e {joins} GROUP BY e.{key}")


def _round_ne(inner: str, k: int) -> str:
    names = [f"ata_{p}_{q}" for p in range(k) for q in range(p, k)] + [f"atb_{p}" for p in range(k)]
    return f"SELECT key, n, {', '.join(f'{r(n, ROUND_SUM)} AS {n}' for n in names)} FROM ({inner})"


def q_normal_equations_x1():
    joins = f"JOIN ({lcg(X1_DIMS[1], RANK, 0, 1)}) f1 ON e.i1 = f1.idx"
    inner = _ne(x1(), "i0", [f"f1.v{c}" for c in range(RANK)], "e.y", joins, RANK)
    return _round_ne(inner, RANK)


def _common_ne(src: str, dims, t: int, rank: int, common: int) -> str:
    joins = (f"JOIN ({lcg(dims[0], rank, t, 0)}) f0 ON e.i0 = f0.idx "
             f"JOIN ({lcg(dims[1], rank, t, 1)}) f1 ON e.i1 = f1.idx")
    target = f"e.y - ({_cp('f0', 'f1', range(common, rank))})" if common < rank else "e.y"
    return _ne(src, "i1", [f"f0.v{c}" for c in range(common)], target, joins, common)


def _merged(rank: int, common: int) -> str:
    a = _common_ne(x1(), X1_DIMS, 0, rank, common)
    b = _common_ne(x2(), X2_DIMS, 1, rank, common)
    names = [f"ata_{p}_{q}" for p in range(common) for q in range(p, common)] + [f"atb_{p}" for p in range(common)]
    sums = ", ".join(f"a.{n} + b.{n} AS {n}" for n in names)
    return f"SELECT a.key, a.n + b.n AS n, {sums} FROM ({a}) a JOIN ({b}) b ON a.key = b.key"


def q_normal_merge():
    return _round_ne(_merged(RANK, COMMON), COMMON)


def _lam(x: str) -> str:
    return f"{x} + CAST({LAM} AS {D})"


def q_ridge_solve():
    joins = f"JOIN ({lcg(X1_DIMS[1], 2, 0, 1)}) f1 ON e.i1 = f1.idx"
    ne = _ne(x1(), "i0", ["f1.v0", "f1.v1"], "e.y", joins, 2)
    x0, x1_ = cramer2(_lam("ata_0_0"), "ata_0_1", _lam("ata_1_1"), "atb_0", "atb_1")
    return f"SELECT key, {r(x0, ROUND_SOLVE)} AS x0, {r(x1_, ROUND_SOLVE)} AS x1 FROM ({ne})"


def q_update_uncoupled():
    return _solved(_updated(0))


def q_update_uncoupled_wls():
    return _solved(_updated(0, wls=True))


def q_update_specific_all():
    joins = f"JOIN ({lcg(X1_DIMS[0], 2, 0, 0)}) f0 ON e.i0 = f0.idx"
    ne = _ne(x1(), "i1", ["f0.v0", "f0.v1"], "e.y", joins, 2)
    x0, x1_ = cramer2(_lam("ata_0_0"), "ata_0_1", _lam("ata_1_1"), "atb_0", "atb_1")
    return _solved(f"SELECT old.idx, coalesce(s.x0, old.v0) AS v0, coalesce(s.x1, old.v1) AS v1 "
                   f"FROM ({lcg(X1_DIMS[1], 2, 0, 1)}) old LEFT JOIN (SELECT key, {x0} AS x0, {x1_} AS x1 FROM ({ne})) s "
                   f"ON old.idx = s.key")


def q_update_common_all():
    x0, x1_ = cramer2(_lam("ata_0_0"), "ata_0_1", _lam("ata_1_1"), "atb_0", "atb_1")
    solved = f"SELECT key, {x0} AS x0, {x1_} AS x1 FROM ({_merged(2, 2)})"
    return " UNION ALL ".join(
        f"SELECT old.idx, {r('coalesce(s.x0, old.v0)', ROUND_SOLVE)} AS v0, {r('coalesce(s.x1, old.v1)', ROUND_SOLVE)} AS v1, "
        f"{t} AS tensor FROM ({lcg(dims[1], 2, t, 1)}) old LEFT JOIN ({solved}) s ON old.idx = s.key"
        for t, dims in ((0, X1_DIMS), (1, X2_DIMS)))


def q_update_x1_3mode():
    joins = (f"JOIN ({lcg(X1_DIMS[1], 2, 0, 1)}) f1 ON e.i1 = f1.idx JOIN ({lcg(X1_DIMS[2], 2, 0, 2)}) f2 ON e.i2 = f2.idx")
    ne = _ne(x1(True), "i0", ["f1.v0 * f2.v0", "f1.v1 * f2.v1"], "e.y", joins, 2)
    x0, x1_ = cramer2(_lam("ata_0_0"), "ata_0_1", _lam("ata_1_1"), "atb_0", "atb_1")
    return _solved(f"SELECT old.idx, coalesce(s.x0, old.v0) AS v0, coalesce(s.x1, old.v1) AS v1 "
                   f"FROM ({lcg(X1_DIMS[0], 2, 0, 0)}) old LEFT JOIN (SELECT key, {x0} AS x0, {x1_} AS x1 FROM ({ne})) s "
                   f"ON old.idx = s.key")


def q_update_specific():
    rank = 3
    joins = (f"JOIN ({lcg(X1_DIMS[0], rank, 0, 0)}) f0 ON e.i0 = f0.idx "
             f"JOIN ({lcg(X1_DIMS[1], rank, 0, 1)}) f1 ON e.i1 = f1.idx")
    ne = _ne(x1(), "i1", ["f0.v1", "f0.v2"], "e.y - f0.v0 * f1.v0", joins, 2)
    x0, x1_ = cramer2(_lam("ata_0_0"), "ata_0_1", _lam("ata_1_1"), "atb_0", "atb_1")
    solved = f"SELECT key, {x0} AS x0, {x1_} AS x1 FROM ({ne})"
    return (f"SELECT old.idx, {r('old.v0', ROUND_SOLVE)} AS v0, "
            f"{r('coalesce(s.x0, old.v1)', ROUND_SOLVE)} AS v1, {r('coalesce(s.x1, old.v2)', ROUND_SOLVE)} AS v2 "
            f"FROM ({lcg(X1_DIMS[1], rank, 0, 1)}) old LEFT JOIN ({solved}) s ON old.idx = s.key")


def q_update_common():
    rank, common = 3, 2
    x0, x1_ = cramer2(_lam("ata_0_0"), "ata_0_1", _lam("ata_1_1"), "atb_0", "atb_1")
    solved = f"SELECT key, {x0} AS x0, {x1_} AS x1 FROM ({_merged(rank, common)})"
    parts = []
    for t, dims in ((0, X1_DIMS), (1, X2_DIMS)):
        parts.append(
            f"SELECT old.idx, {r('coalesce(s.x0, old.v0)', ROUND_SOLVE)} AS v0, "
            f"{r('coalesce(s.x1, old.v1)', ROUND_SOLVE)} AS v1, {r('old.v2', ROUND_SOLVE)} AS v2, {t} AS tensor "
            f"FROM ({lcg(dims[1], rank, t, 1)}) old LEFT JOIN ({solved}) s ON old.idx = s.key")
    return " UNION ALL ".join(parts)


def q_gradient_x1():
    resid = f"(({_cp('f0', 'f1', range(RANK))}) - e.y)"
    g = ", ".join(f"{r(f'sum(CAST(2 AS {D}) * {resid} * f1.v{c})', 4)} AS g_{c}" for c in range(RANK))
    return (f"SELECT e.i0 AS key, {g} FROM ({x1()}) e "
            f"JOIN ({lcg(X1_DIMS[0], RANK, 0, 0)}) f0 ON e.i0 = f0.idx "
            f"JOIN ({lcg(X1_DIMS[1], RANK, 0, 1)}) f1 ON e.i1 = f1.idx GROUP BY e.i0")


def _sweeps(n: int, holdout: bool) -> list[tuple[str, str]]:
    """CTEs of n Gauss-Seidel sweeps at rank 2, common 1 (M4, M6, M5, M4, M5 each).

    ``x1, x2`` are the training cells (``v1, v2`` the held-out ones), ``f{t}{m}_{i}`` the factors after sweep i.
    """
    lam = f"CAST({LAM} AS {D})"
    lengths = [f"CAST({dim('customer')} AS {D})", f"CAST({dim('supplier')} AS {D})"]

    def m4(entries: str, other_factor: str, own: str, own_mean: str, other_mean: str, length: str) -> str:
        ne = (f"SELECT e.i0 AS key, sum(f.v0 * f.v0) AS a00, sum(f.v0 * f.v1) AS a01, sum(f.v1 * f.v1) AS a11, "
              f"sum(e.y * f.v0) AS b0, sum(e.y * f.v1) AS b1 FROM {entries} e JOIN {other_factor} f ON e.i1 = f.idx "
              f"GROUP BY e.i0")
        pull = f"CAST(1 AS {D}) / ({length} * {length})"
        b = [f"ne.b{c} + ({other_mean}.m{c} - ({own_mean}.m{c} - o.v{c} / {length})) / {length}" for c in range(2)]
        x0, x1_ = cramer2(f"ne.a00 + {lam} + {pull}", "ne.a01", f"ne.a11 + {lam} + {pull}", b[0], b[1])
        solved = (f"SELECT o.idx, {x0} AS x0, {x1_} AS x1 FROM {own} o JOIN ({ne}) ne ON o.idx = ne.key, "
                  f"{own_mean}, {other_mean}")
        return (f"SELECT o.idx, coalesce(s.x0, o.v0) AS v0, coalesce(s.x1, o.v1) AS v1 "
                f"FROM {own} o LEFT JOIN ({solved}) s ON o.idx = s.idx")

    def side(entries: str, f0: str, f1: str, col: int) -> str:
        # design f0[col]; target y - f0[other] * f1[other]; keyed by the coupled index i1
        return (f"SELECT e.i1 AS key, sum(g.v{col} * g.v{col}) AS aa, "
                f"sum((e.y - g.v{1 - col} * h.v{1 - col}) * g.v{col}) AS ab FROM {entries} e "
                f"JOIN {f0} g ON e.i0 = g.idx JOIN {f1} h ON e.i1 = h.idx GROUP BY e.i1")

    def specific(common: str, sums: str) -> str:
        return (f"SELECT o.idx, o.v0, coalesce(s.ab / (s.aa + {lam}), o.v1) AS v1 FROM {common} o "
                f"LEFT JOIN {sums} s ON o.idx = s.key")

    both = [("x1", x1()), ("x2", x2())]
    ctes = both
    if holdout:
        ctes = [(f"{n}_all", q) for n, q in both]
        ctes += [(n, f"SELECT * FROM {n}_all WHERE NOT ({HOLDOUT})") for n, _ in both]
        ctes += [(n.replace("x", "v"), f"SELECT * FROM {n}_all WHERE {HOLDOUT}") for n, _ in both]
    for t, dims in ((0, X1_DIMS), (1, X2_DIMS)):
        ctes += [(f"f{t}{m}_0", lcg(dims[m], 2, t, m)) for m in range(2)]
    for i in range(1, n + 1):
        p = i - 1
        ctes += [
            (f"m00_{p}", f"SELECT avg(v0) AS m0, avg(v1) AS m1 FROM f00_{p}"),
            (f"m10_{p}", f"SELECT avg(v0) AS m0, avg(v1) AS m1 FROM f10_{p}"),
            (f"f00_{i}", m4("x1", f"f01_{p}", f"f00_{p}", f"m00_{p}", f"m10_{p}", lengths[0])),
            (f"ca_{i}", side("x1", f"f00_{i}", f"f01_{p}", 0)),
            (f"cb_{i}", side("x2", f"f10_{p}", f"f11_{p}", 0)),
            (f"sc_{i}", f"SELECT ca_{i}.key, (ca_{i}.ab + cb_{i}.ab) / (ca_{i}.aa + cb_{i}.aa + {lam}) AS x "
                        f"FROM ca_{i} JOIN cb_{i} ON ca_{i}.key = cb_{i}.key"),
        ]
        ctes += [(f"h{t}1_{i}", f"SELECT o.idx, coalesce(s.x, o.v0) AS v0, o.v1 FROM f{t}1_{p} o LEFT JOIN sc_{i} s "
                                f"ON o.idx = s.key") for t in range(2)]
        ctes += [
            (f"sa_{i}", side("x1", f"f00_{i}", f"h01_{i}", 1)),
            (f"f01_{i}", specific(f"h01_{i}", f"sa_{i}")),
            (f"f10_{i}", m4("x2", f"h11_{i}", f"f10_{p}", f"m10_{p}", f"m00_{p}", lengths[1])),
            (f"sb_{i}", side("x2", f"f10_{i}", f"h11_{i}", 1)),
            (f"f11_{i}", specific(f"h11_{i}", f"sb_{i}")),
        ]
    return ctes


def _with(ctes: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes) + " " + body


def _factors_after(i: int, tensors=(0, 1), where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {t} AS tensor, {m} AS mode, idx, {r('v0', ROUND_SOLVE)} AS v0, {r('v1', ROUND_SOLVE)} AS v1 "
        f"FROM f{t}{m}_{i}{where}" for t in tensors for m in range(2))


def q_fit_one_sweep():
    """One Gauss-Seidel sweep over whole X1 and X2."""
    return _with(_sweeps(1, False), _factors_after(1))


def q_fit_three_tensors():
    """One sweep over X1, X2 and X3 at rank 2, common 1; parts are mode 1, 1 and 0, every other mode is pulled by the two others."""
    lam = f"CAST({LAM} AS {D})"
    length = {"00": dim("customer"), "10": dim("supplier"), "21": "12"}

    def pulled(entries: str, key: str, other: str, other_factor: str, own: str) -> str:
        o = f"f{own}_0"
        n = f"CAST({length[own]} AS {D})"
        others = [f"m{k}" for k in length if k != own]
        ne = (f"SELECT e.{key} AS key, sum(f.v0 * f.v0) AS a00, sum(f.v0 * f.v1) AS a01, sum(f.v1 * f.v1) AS a11, "
              f"sum(e.y * f.v0) AS b0, sum(e.y * f.v1) AS b1 FROM {entries} e JOIN {other_factor} f ON e.{other} = f.idx GROUP BY 1")
        b = [f"ne.b{c} + " + " + ".join(f"(p{j}.c{c} - (p.c{c} - o.v{c} / {n})) / {n}" for j in range(2)) for c in range(2)]
        pull = f"CAST(2 AS {D}) / ({n} * {n})"
        x = cramer2(f"ne.a00 + {lam} + {pull}", "ne.a01", f"ne.a11 + {lam} + {pull}", *b)
        return (f"SELECT o.idx, " + ", ".join(f"CASE WHEN ne.key IS NULL THEN o.v{c} ELSE {x[c]} END AS v{c}" for c in range(2))
                + f" FROM {o} o LEFT JOIN ({ne}) ne ON o.idx = ne.key, m{own} p, {others[0]} p0, {others[1]} p1")

    def side(entries: str, key: str, own: str, other: str, other_factor: str, col: int) -> str:
        return (f"SELECT e.{key} AS key, sum(g.v{col} * g.v{col}) AS aa, sum((e.y - g.v{1 - col} * h.v{1 - col}) * g.v{col}) AS ab "
                f"FROM {entries} e JOIN {other_factor} g ON e.{other} = g.idx JOIN {own} h ON e.{key} = h.idx GROUP BY 1")

    def specific(own: str, sums: str) -> str:
        return f"SELECT o.idx, o.v0, coalesce(s.ab / (s.aa + {lam}), o.v1) AS v1 FROM {own} o LEFT JOIN {sums} s ON o.idx = s.key"

    ctes = [("x1", x1()), ("x2", x2()), ("x3", x3())]
    for t, dims in enumerate(([dim("customer"), dim("part")], [dim("supplier"), dim("part")], [dim("part"), "12"])):
        ctes += [(f"f{t}{m}_0", lcg(d, 2, t, m)) for m, d in enumerate(dims)]
    ctes += [(f"m{k}", f"SELECT avg(v0) AS c0, avg(v1) AS c1 FROM f{k}_0") for k in length]
    ctes += [("f00_1", pulled("x1", "i0", "i1", "f01_0", "00")),
             ("c0", side("x1", "i1", "f01_0", "i0", "f00_1", 0)), ("c1", side("x2", "i1", "f11_0", "i0", "f10_0", 0)),
             ("c2", side("x3", "i0", "f20_0", "i1", "f21_0", 0)),
             ("sc", "SELECT key, sum(ab) / (sum(aa) + " + lam + ") AS x FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2) "
                    "GROUP BY key HAVING count(*) > 1")]
    ctes += [(f"h{t}", f"SELECT o.idx, CASE WHEN c.key IS NULL THEN o.v0 ELSE coalesce(s.x, o.v0) END AS v0, o.v1 FROM f{k}_0 o "
                       f"LEFT JOIN c{t} c ON o.idx = c.key LEFT JOIN sc s ON o.idx = s.key") for t, k in enumerate(("01", "11", "20"))]
    ctes += [("s0", side("x1", "i1", "h0", "i0", "f00_1", 1)), ("f01_1", specific("h0", "s0")),
             ("f10_1", pulled("x2", "i0", "i1", "h1", "10")),
             ("s1", side("x2", "i1", "h1", "i0", "f10_1", 1)), ("f11_1", specific("h1", "s1")),
             ("s2", side("x3", "i0", "h2", "i1", "f21_0", 1)), ("f20_1", specific("h2", "s2")),
             ("f21_1", pulled("x3", "i1", "i0", "f20_1", "21"))]
    return _with(ctes, _factors_after(1, (0, 1, 2)))


def q_coupled_entries():
    shared = "key IN (SELECT i1 FROM a) AND key IN (SELECT i1 FROM b)"
    return _with([("a", x1()), ("b", x2())], f"SELECT * FROM (SELECT i1 AS key, 0 AS side, i0, i1, y FROM a UNION ALL "
                 f"SELECT i1 AS key, 1 AS side, i0, i1, y FROM b) WHERE {shared}")


def q_rescale_ranges():
    families = " UNION ALL ".join(
        f"SELECT min(p_partkey) + {low} AS lo, max(p_partkey) + {high} AS hi, round(avg(p_retailprice) / CAST(100 AS {D}), 6) AS scale "
        f"FROM part GROUP BY p_partkey // {size}" for size, low, high in ((157, 0, -20), (400, 5, 31)))
    return _with([("ranges", families), ("p", _pred(x1(), X1_DIMS, 0))],
                 f"SELECT p.i0, p.i1, {r('p.yhat * coalesce((SELECT g.scale FROM ranges g WHERE g.lo <= p.i1 AND p.i1 < g.hi ORDER BY g.hi, g.lo, g.scale LIMIT 1), 1)', 4)}"
                 f" AS yhat_scaled FROM p")


LOSS_LOG = (f"SELECT run, i - 1 AS iter, (i - 1) * CAST(90 AS {D}) + run AS seconds, CASE WHEN k % 61 = 0 THEN 'NaN'::{D} "
            f"WHEN k % 67 = 0 THEN 'Infinity'::{D} ELSE floor(price / CAST(50000 AS {D})) + CAST(400000 AS {D}) / i END AS loss "
            f"FROM (SELECT o_orderkey AS k, o_custkey % 40 AS run, CAST(o_totalprice AS {D}) AS price, "
            f"row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS i FROM orders)")


def q_stopping_verdicts():
    big = f"CAST(1e80 AS {D})"
    ctes = [("log", LOSS_LOG),
            ("steps", f"SELECT *, lag(loss, 1, {big}) OVER (PARTITION BY run ORDER BY iter) AS prev, "
                      f"lag(iter) OVER (PARTITION BY run ORDER BY iter) AS prior FROM log"),
            ("rated", "SELECT *, CASE WHEN isfinite(loss) AND isfinite(prev) AND prev <> 0 THEN (prev - loss) / prev END AS rel FROM steps"),
            ("judged", f"SELECT *, CASE WHEN rel IS NULL OR rel < CAST(0.001 AS {D}) THEN 'decrease' "
                       f"WHEN seconds > 3600 THEN 'hours' WHEN iter >= 60 THEN 'iterations' END AS reason FROM rated")]
    return _with(ctes, f"SELECT run, iter, {r('rel', ROUND_MEAN)} AS rel, reason, "
                       f"iter >= coalesce(min(iter) FILTER (reason IS NOT NULL) OVER (PARTITION BY run), 1000000) AS stopped, "
                       f"CASE WHEN rel > 0 THEN iter ELSE coalesce(prior, iter) END AS final FROM judged")


def q_best_iterations():
    return _with([("log", LOSS_LOG)],
                 "SELECT run, iter, best, iter - best AS lag FROM (SELECT a.run, a.iter, (SELECT b.iter FROM log b WHERE b.run = a.run "
                 "AND b.iter <= a.iter AND NOT isnan(b.loss) ORDER BY b.loss, b.iter LIMIT 1) AS best FROM log a)")


def q_validation_scan():
    return " UNION ALL ".join(f"SELECT *, {t} AS tensor FROM ({src}) WHERE {HOLDOUT}" for t, src in enumerate((x1(), x2())))


def q_coupling_lookup():
    pairs = ("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS pair, n_nationkey::INTEGER AS t, n_regionkey::INTEGER AS m, "
             "(n_nationkey + 1)::INTEGER AS partner_t, (n_nationkey % 3)::INTEGER AS partner_m FROM nation")
    return _with([("p", pairs)], "SELECT * FROM p UNION ALL SELECT pair, partner_t, partner_m, t, m FROM p")


def q_fit_resumed():
    """Two sweeps in one go."""
    return _with(_sweeps(2, False), _factors_after(2))


def q_update_shared_modes():
    """Equations of every tensor on its part mode, summed over the tensors that see the part (two of them at least)."""
    rank, common = 3, 2
    tensors = [(x1(True), X1_DIMS, 1), (x2(), X2_DIMS[:2], 1), (x3(), [dim("part"), "12"], 0)]
    sides = []
    for t, (src, dims, mode) in enumerate(tensors):
        joins = " ".join(f"JOIN ({lcg(d, rank, t, m)}) f{m} ON e.i{m} = f{m}.idx" for m, d in enumerate(dims))
        others = [m for m in range(len(dims)) if m != mode]
        design = [" * ".join(f"f{m}.v{c}" for m in others) for c in range(common)]
        own = " * ".join(f"f{m}.v2" for m in range(len(dims)))
        sides.append(_ne(src, f"i{mode}", design, f"e.y - {own}", joins, common))
    names = ["ata_0_0", "ata_0_1", "ata_1_1", "atb_0", "atb_1"]
    merged = (f"SELECT key, {', '.join(f'sum({n}) AS {n}' for n in names)} FROM ("
              + " UNION ALL ".join(f"SELECT * FROM s{t}" for t in range(3)) + ") GROUP BY key HAVING count(*) > 1")
    x0, x1_ = cramer2(_lam("ata_0_0"), "ata_0_1", _lam("ata_1_1"), "atb_0", "atb_1")
    ctes = [(f"s{t}", q) for t, q in enumerate(sides)] + [("x", f"SELECT key, {x0} AS x0, {x1_} AS x1 FROM ({merged})")]
    return _with(ctes, " UNION ALL ".join(
        f"SELECT {t} AS tensor, {mode} AS mode, o.idx, {r('coalesce(x.x0, o.v0)', ROUND_SOLVE)} AS v0, "
        f"{r('coalesce(x.x1, o.v1)', ROUND_SOLVE)} AS v1, {r('o.v2', ROUND_SOLVE)} AS v2 FROM ({lcg(dims[mode], rank, t, mode)}) o "
        f"LEFT JOIN s{t} s ON o.idx = s.key LEFT JOIN x ON s.key = x.key" for t, (_, dims, mode) in enumerate(tensors)))


def _errors(cells: str, t: int, i: int) -> str:
    """Sum and number of squared errors of tensor t's cells after sweep i."""
    return (f"SELECT sum((e.y - a.v0 * b.v0 - a.v1 * b.v1) * (e.y - a.v0 * b.v0 - a.v1 * b.v1)) AS sse, count(*) AS n "
            f"FROM {cells}{t + 1} e JOIN f{t}0_{i} a ON e.i0 = a.idx JOIN f{t}1_{i} b ON e.i1 = b.idx")


def _fit_ctes() -> list[tuple[str, str]]:
    """Two sweeps over the training cells, and ``log``: one row of losses per iteration."""
    rows = []
    for i in range(3):
        rows.append(
            f"SELECT {i} AS iter, t0.sse AS se_0, t1.sse AS se_1, "
            f"(a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1) AS mean, "
            f"sqrt(v0.sse / v0.n) AS val_rmse_0, sqrt(v1.sse / v1.n) AS val_rmse_1 "
            f"FROM ({_errors('x', 0, i)}) t0, ({_errors('x', 1, i)}) t1, ({_errors('v', 0, i)}) v0, ({_errors('v', 1, i)}) v1, "
            f"(SELECT avg(v0) AS m0, avg(v1) AS m1 FROM f00_{i}) a, (SELECT avg(v0) AS m0, avg(v1) AS m1 FROM f10_{i}) b")
    return _sweeps(2, True) + [("log", "SELECT *, se_0 + se_1 + mean AS total FROM (" + " UNION ALL ".join(rows) + ")")]


_TERMS = {"se_0": ROUND_LOSS, "se_1": ROUND_LOSS, "mean": ROUND_SOLVE, "total": ROUND_LOSS, "val_rmse_0": ROUND_SOLVE,
          "val_rmse_1": ROUND_SOLVE}


def q_fit_metrics():
    return _with(_fit_ctes(), " UNION ALL ".join(
        f"SELECT iter, '{t}' AS term, {r(t, digits)} AS loss FROM log" for t, digits in _TERMS.items()))


def q_training_log():
    cols = ", ".join(f"{r(t, _TERMS[t])} AS {t}" for t in ("se_0", "se_1", "mean", "total"))
    return _with(_fit_ctes(), f"SELECT iter, {cols} FROM log")


def q_validation_log():
    cols = ", ".join(f"{r(t, _TERMS[t])} AS {t}" for t in ("val_rmse_0", "val_rmse_1"))
    return _with(_fit_ctes(), f"SELECT iter, {cols} FROM log")


def q_fit_checkpoint():
    """The first sweep is a checkpoint (every iteration that does not stop is one)."""
    return _with(_sweeps(1, True), _factors_after(1))


def q_fit_predict_validation():
    """Predictions of the last iteration if its loss fell, else of the one before."""
    parts = []
    fell = "(SELECT a.total < b.total FROM log a, log b WHERE a.iter = 2 AND b.iter = 1)"
    for i, cond in ((2, fell), (1, f"NOT {fell}")):
        for t in range(2):
            parts.append(f"SELECT {t} AS tensor, e.i0, e.i1, e.y, {r('a.v0 * b.v0 + a.v1 * b.v1', ROUND_SOLVE)} AS yhat "
                         f"FROM v{t + 1} e JOIN f{t}0_{i} a ON e.i0 = a.idx JOIN f{t}1_{i} b ON e.i1 = b.idx WHERE {cond}")
    return _with(_fit_ctes(), " UNION ALL ".join(parts))


def q_fit_best_factors():
    """Every tensor's factors after its iteration of least validation error (the first of equals)."""
    parts = [_factors_after(i, (t,), f" WHERE {i} = (SELECT iter FROM log ORDER BY val_rmse_{t}, iter LIMIT 1)")
             for t in range(2) for i in range(3)]
    return _with(_fit_ctes(), " UNION ALL ".join(parts))


ORACLE = {
    "tensor_x1": q_tensor_x1,
    "tensor_x2": q_tensor_x2,
    "tensor_x1_3mode": q_tensor_x1_3mode,
    "validation_x1": q_validation_x1,
    "text_roundtrip_x2": q_text_roundtrip_x2,
    "index_event_type": q_index_event_type,
    "tensor_events": q_tensor_events,
    "entry_counts": q_entry_counts,
    "slices_x1_part": q_slices_x1_part,
    "coupled_slices": q_coupled_slices,
    "validate_x2_raw": q_validate_x2_raw,
    "init_lcg": q_init_lcg,
    "init_const": q_init_const,
    "init_diagonal": q_init_diagonal,
    "copy_factor": q_copy_factor,
    "column_means": q_column_means,
    "mean_loss": q_mean_loss,
    "design_x1_3mode": q_design_x1_3mode,
    "predict_x1": q_predict_x1,
    "training_loss": q_training_loss,
    "validation_rmse": q_validation_rmse,
    "total_loss": q_total_loss,
    "denormalise_x1": q_denormalise_x1,
    "normal_equations_x1": q_normal_equations_x1,
    "normal_merge": q_normal_merge,
    "ridge_solve": q_ridge_solve,
    "update_uncoupled": q_update_uncoupled,
    "update_specific": q_update_specific,
    "update_common": q_update_common,
    "gradient_x1": q_gradient_x1,
    "fit_one_sweep": q_fit_one_sweep,
    "mode_key_x1": q_mode_key_x1,
    "slice_pages_x1": q_slice_pages_x1,
    "validate_mixed": q_validate_mixed,
    "init_random": q_init_random,
    "init_diagonal_random": q_init_diagonal_random,
    "mean_loss_wls": q_mean_loss_wls,
    "upsert_rows": q_upsert_rows,
    "upsert_block": q_upsert_block,
    "factor_sink": q_factor_sink,
    "prediction_sink": q_prediction_sink,
    "update_uncoupled_gram": q_update_uncoupled,
    "update_uncoupled_shuffle": q_update_uncoupled,
    "update_uncoupled_wls": q_update_uncoupled_wls,
    "update_specific_gram": q_update_specific,
    "update_specific_shuffle": q_update_specific,
    "update_specific_all": q_update_specific_all,
    "update_common_gram": q_update_common,
    "update_common_shuffle": q_update_common,
    "update_common_all": q_update_common_all,
    "update_x1_3mode": q_update_x1_3mode,
    "fit_metrics": q_fit_metrics,
    "training_log": q_training_log,
    "validation_log": q_validation_log,
    "fit_checkpoint": q_fit_checkpoint,
    "fit_predict_validation": q_fit_predict_validation,
    "fit_best_factors": q_fit_best_factors,
    "fit_three_tensors": q_fit_three_tensors,
    "coupled_entries": q_coupled_entries,
    "rescale_ranges": q_rescale_ranges,
    "update_specific_pieces": q_update_specific,
    "update_shared_pieces": q_update_common,
    "stopping_verdicts": q_stopping_verdicts,
    "best_iterations": q_best_iterations,
    "validation_scan": q_validation_scan,
    "coupling_lookup": q_coupling_lookup,
    "job_factors": q_fit_one_sweep,
    "fit_resumed": q_fit_resumed,
    "update_stored": q_update_uncoupled,
    "update_shared_modes": q_update_shared_modes,
}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLE.items()}
