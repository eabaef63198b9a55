"""DuckDB/ANSI oracles of the tensor catalogue: one statement per query, same column names."""

from __future__ import annotations

PRELUDE = """\
with A as (select l_orderkey as i, l_partkey as j, sum(l_quantity) as v from lineitem group by l_orderkey, l_partkey),
B as (select l_partkey as j, l_suppkey as k, sum(l_quantity) as v from lineitem group by l_partkey, l_suppkey),
T as (select l_orderkey as i, l_partkey as j, l_suppkey as k, sum(l_quantity) as v from lineitem group by l_orderkey, l_partkey, l_suppkey),
D as (select p_partkey as j, cast(0 as bigint) as f, cast(p_size as double) as v from part union all select p_partkey, cast(1 as bigint), cast(p_partkey % 7 as double) from part union all select p_partkey, cast(2 as bigint), cast(1 as double) from part),
K as (select s_suppkey as k, cast(0 as bigint) as f, cast(s_nationkey as double) as v from supplier union all select s_suppkey, cast(1 as bigint), cast(s_suppkey % 5 as double) from supplier union all select s_suppkey, cast(2 as bigint), cast(2 as double) from supplier),
N as (select count(*) as n from supplier),
G as (select distinct l_suppkey as s, l_partkey as d from lineitem cross join N where l_partkey < n and l_partkey <> l_suppkey),
U as (select s, d from G union select d, s from G),
P as (select l_orderkey as i, l_partkey as j, sum(l_quantity) as v from lineitem where l_returnflag = 'A' group by l_orderkey, l_partkey),
Q as (select l_orderkey as i, l_partkey as j, sum(l_quantity) as v from lineitem where l_linestatus = 'O' group by l_orderkey, l_partkey)
"""

# (inventory rows covered, statement)
STATEMENTS: dict[str, tuple[str, str]] = {
    "q_coalesce": (
        "S2 S8",
        """select i, j, v from A""",
    ),
    "q_spmv": (
        "C3",
        """select a.i as i, sum(a.v * p.p_size) as v from A a join part p on a.j = p.p_partkey group by a.i""",
    ),
    "q_spmv_float": (
        "C3",
        """select a.i as i, round(sum(a.v * p.p_retailprice), 4) as v from A a join part p on a.j = p.p_partkey group by a.i""",
    ),
    "q_spmm": (
        "C4",
        """select a.i as i, x.f as f, sum(a.v * x.v) as v from A a join D x on a.j = x.j group by a.i, x.f""",
    ),
    "q_spmm_bias_relu": (
        "F4 E9 E11",
        """select a.i as i, x.f as f, greatest(sum(a.v * x.v) - 1000 * (x.f + 1), cast(0 as double)) as v from A a join D x on a.j = x.j group by a.i, x.f""",
    ),
    "q_spmm_bias": (
        "F4 E9",
        """select a.i as i, x.f as f, sum(a.v * x.v) + 10 * x.f as v from A a join D x on a.j = x.j group by a.i, x.f""",
    ),
    "q_spmm_scale": (
        "E10",
        """select a.i as i, x.f as f, sum(a.v * x.v) * (x.f + 1) as v from A a join D x on a.j = x.j group by a.i, x.f""",
    ),
    "q_spgemm": (
        "C5 C6",
        """select a.i as i, b.k as k, sum(a.v * b.v) as v from A a join B b on a.j = b.j group by a.i, b.k""",
    ),
    "q_self_spgemm": (
        "A14",
        """select x.k as k1, y.k as k2, sum(x.v * y.v) as v from B x join B y on x.j = y.j group by x.k, y.k""",
    ),
    "q_sddmm": (
        "C7",
        """select b.j as j, b.k as k, b.v * sum(x.v * y.v) as v from B b join D x on b.j = x.j join K y on b.k = y.k and x.f = y.f group by b.j, b.k, b.v""",
    ),
    "q_matmul_dense": (
        "C8",
        """select x.j as j, y.k as k, sum(x.v * y.v) as v from D x join K y on x.f = y.f group by x.j, y.k""",
    ),
    "q_private_index": (
        "C16",
        """select n.n_nationkey as i, b.k as k, (n.n_nationkey + 1) * b.v as v from (select cast(n_nationkey as bigint) as n_nationkey from nation) n cross join (select k, sum(v) as v from B group by k) b""",
    ),
    "q_vector_matrix": (
        "C2",
        """select b.k as k, sum(p.p_size * b.v) as v from B b join part p on b.j = p.p_partkey group by b.k""",
    ),
    "q_dot": (
        "C2",
        """select cast(sum(p_size * (p_partkey % 7)) as double) as v from part""",
    ),
    "q_metrics": (
        "A23",
        """select round(avg(case when l_partkey % 3 = l_suppkey % 3 then 1e0 else 0e0 end), 9) as accuracy, round(avg(-ln(l_quantity / 51)), 9) as nll from lineitem""",
    ),
    "q_hadamard": (
        "C9",
        """select p.i as i, p.j as j, p.v * q.v as v from P p join Q q on p.i = q.i and p.j = q.j""",
    ),
    "q_hadamard3": (
        "C9",
        """select t.i as i, t.j as j, t.k as k, t.v * u.v as v from T t join T u on t.i = u.i and t.j = u.j and t.k = u.k""",
    ),
    "q_hadamard4": (
        "C9",
        """select a.l_orderkey as i, a.l_partkey as j, a.l_suppkey as k, cast(a.l_linenumber as bigint) as l, a.l_quantity * b.l_quantity as v from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey and a.l_linenumber = b.l_linenumber""",
    ),
    "q_outer": (
        "C10",
        """select n.n_nationkey as i, r.r_regionkey as j, cast((n.n_nationkey + 1) * (r.r_regionkey + 1) as double) as v from nation n cross join region r""",
    ),
    "q_matvec_broadcast": (
        "C11",
        """select a.i as i, a.j as j, a.v * p.p_size as v from A a join part p on a.j = p.p_partkey""",
    ),
    "q_ttm": (
        "C12",
        """select t.i as i, t.j as j, y.f as m, sum(t.v * y.v) as v from T t join K y on t.k = y.k group by t.i, t.j, y.f""",
    ),
    "q_mttkrp": (
        "C13",
        """select t.i as i, x.f as m, sum(t.v * x.v * y.v) as v from T t join D x on t.j = x.j join K y on t.k = y.k and x.f = y.f group by t.i, x.f""",
    ),
    "q_batched_matmul": (
        "C14",
        """select a.b as b, a.i as i, c.k as k, sum(a.v * c.v) as v from (select l_linenumber as b, l_orderkey as i, l_partkey as j, sum(l_quantity) as v from lineitem group by l_linenumber, l_orderkey, l_partkey) a join (select l_linenumber as b, l_partkey as j, l_suppkey as k, sum(l_quantity) as v from lineitem group by l_linenumber, l_partkey, l_suppkey) c on a.b = c.b and a.j = c.j group by a.b, a.i, c.k""",
    ),
    "q_broadcast_output": (
        "C16",
        """select y.j as j, r.r_regionkey as k, y.v as v from (select b.j as j, sum(b.v * s.s_nationkey) as v from B b join supplier s on b.k = s.s_suppkey group by b.j) y cross join region r""",
    ),
    "q_chain": (
        "C1 planner",
        """select a.i as i, sum(a.v * b.v * s.s_nationkey) as v from A a join B b on a.j = b.j join supplier s on b.k = s.s_suppkey group by a.i""",
    ),
    "q_scalar_out": (
        "D7",
        """select sum(p.v * q.v) as v from P p join Q q on p.i = q.i and p.j = q.j""",
    ),
    "q_diag": (
        "D8",
        """select l_partkey as i, sum(l_quantity) as v from lineitem where l_partkey = l_suppkey group by l_partkey""",
    ),
    "q_add": (
        "E1",
        """select i, j, sum(v) as v from (select i, j, v from P union all select i, j, v from Q) u group by i, j""",
    ),
    "q_add3": (
        "E2",
        """select i, j, sum(v) as v from (select i, j, v from P union all select i, j, v from Q union all select i, j, v from A) u group by i, j""",
    ),
    "q_sub": (
        "E5",
        """select i, j, sum(v) as v from (select i, j, v from A union all select i, j, -v as v from P) u group by i, j""",
    ),
    "q_div": (
        "E6",
        """select p.i as i, p.j as j, round(p.v / a.v, 6) as v from P p join A a on p.i = a.i and p.j = a.j""",
    ),
    "q_compound": (
        "E7",
        """select l.i as i, l.j as j, l.v * r.v as v from (select i, j, sum(v) as v from (select i, j, v from P union all select i, j, v from Q) u group by i, j) l join (select i, j, sum(v) as v from (select i, j, v from A union all select i, j, v from Q) w group by i, j) r on l.i = r.i and l.j = r.j""",
    ),
    "q_mul_add": (
        "E8",
        """select i, j, sum(v) as v from (select p.i as i, p.j as j, p.v * q.v as v from P p join Q q on p.i = q.i and p.j = q.j union all select i, j, v from A) u group by i, j""",
    ),
    "q_activations": (
        "E12 E13 E14",
        """select i, j, round(1 / (1 + exp(-(v / 50))), 6) as sig, round(tanh(v / 50), 6) as th, round((v / 50) * 0.5e0 * (1 + tanh(0.7978845608e0 * ((v / 50) + 0.044715e0 * (v / 50) * (v / 50) * (v / 50)))), 6) as gelu from A""",
    ),
    "q_transpose": (
        "S7",
        """select j as i, i as j, v from A""",
    ),
    "q_to_dense": (
        "S5",
        """select n.n_nationkey as i, r.r_regionkey as j, coalesce(m.v, cast(0 as double)) as v from nation n cross join region r left join (select n_nationkey as i, n_regionkey as j, cast(n_nationkey + 1 as double) as v from nation) m on m.i = n.n_nationkey and m.j = r.r_regionkey""",
    ),
    "q_to_sparse": (
        "S6",
        """select i, j, v from (select i, j, sum(v) as v from (select i, j, v from A union all select i, j, -v as v from P) u group by i, j) w where v <> 0""",
    ),
    "q_csr_pos": (
        "S9",
        """select s.s_suppkey as r, cast(sum(coalesce(c.n, 0)) over (order by s.s_suppkey rows between unbounded preceding and current row) as bigint) as pos_end from supplier s left join (select k, count(*) as n from B group by k) c on c.k = s.s_suppkey""",
    ),
    "q_nnz_row": (
        "S11 A5",
        """select i, count(*) as nnz from A group by i""",
    ),
    "q_undirect": (
        "A4",
        """select s, d from U""",
    ),
    "q_gcn_norm": (
        "A1",
        """select e.s as s, e.d as d, round(1 / sqrt(cast(x.n as double)) / sqrt(cast(y.n as double)), 6) as w from (select s, d from U union all select s_suppkey, s_suppkey from supplier) e join (select s, count(*) as n from (select s, d from U union all select s_suppkey, s_suppkey from supplier) z group by s) x on e.s = x.s join (select s, count(*) as n from (select s, d from U union all select s_suppkey, s_suppkey from supplier) z group by s) y on e.d = y.s""",
    ),
    "q_message_passing": (
        "A3",
        """select e.d as i, y.f as f, sum(y.v) as v from U e join K y on e.s = y.k group by e.d, y.f""",
    ),
    "q_log_softmax": (
        "A2",
        """select k, f, round(v - m - ln(sum(exp(v - m)) over (partition by k)), 6) + cast(0 as double) as lp from (select k, f, v, max(v) over (partition by k) as m from K) z""",
    ),
    "q_row_softmax": (
        "A9",
        """select j, k, round(e / sum(e) over (partition by j), 6) as p from (select j, k, exp((v - max(v) over (partition by j)) / 10) as e from B) z""",
    ),
    "q_argmax": (
        "A6",
        """select j, k from (select j, k, row_number() over (partition by j order by v desc, k) as rn from B) z where rn = 1""",
    ),
    "q_subgraph": (
        "A7",
        """select u.s as s, u.d as d from U u where u.s in (select s_suppkey from supplier where s_suppkey % 2 = 0) and u.d in (select s_suppkey from supplier where s_suppkey % 2 = 0)""",
    ),
    "q_longformer_mask": (
        "A8",
        """select a.s_suppkey as i, b.s_suppkey as j from supplier a join supplier b on b.s_suppkey between a.s_suppkey - 4 and a.s_suppkey + 4 union select a.s_suppkey, b.s_suppkey from supplier a join supplier b on a.s_suppkey = 0 or b.s_suppkey = 0""",
    ),
    "q_block_mask": (
        "A11",
        """select a.s_suppkey as i, b.s_suppkey as j from supplier a join supplier b on b.s_suppkey between a.s_suppkey - 8 and a.s_suppkey + 8 where a.s_suppkey % 4 = 0 and b.s_suppkey % 4 = 0""",
    ),
    "q_attention": (
        "A10",
        """select w.i as i, y.f as f, round(sum(w.p * y.v), 5) as v from (select i, j, e / sum(e) over (partition by i) as p from (select i, j, exp(z - max(z) over (partition by i)) as e from (select m.i as i, m.j as j, sum(q.v * c.v) / 100 as z from (select a.s_suppkey as i, b.s_suppkey as j from supplier a join supplier b on b.s_suppkey between a.s_suppkey - 4 and a.s_suppkey + 4) m join K q on m.i = q.k join K c on m.j = c.k and q.f = c.f group by m.i, m.j) s1) s2) w join K y on w.j = y.k group by w.i, y.f""",
    ),
    "q_prune": (
        "A12",
        """select i, j, v from A where v >= (select v from (select v, row_number() over (order by v, i, j) as rn, count(*) over () as n from A) z where rn = cast(floor(n * 0.9e0) as bigint))""",
    ),
    "q_timing_summary": (
        "A15",
        """select event_type, min(value) as mn, round(avg(value), 6) as av, round(stddev_samp(value), 6) as sd, round(median(value), 6) as md from events group by event_type""",
    ),
    "q_completed": (
        "A16",
        """select user_id from (select distinct user_id, event_type from events where event_type in ('click', 'error')) z group by user_id having count(*) = 2""",
    ),
}


#: Statements that stand alone.
EXTRA = {
    "q_vocabulary": """with w as (select unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) as token from documents),
c as (select token, count(*) as n from w group by token),
r as (select token, n, row_number() over (order by n desc, token) as rn from c)
select token, n, cast(rn + 1 as integer) as id from r where rn <= 1000""",
    "q_embedding_sddmm": """select a.vec_id as i, b.vec_id as j, round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 5) + cast(0 as double) as v
from embeddings a join embeddings b on b.vec_id between a.vec_id - 4 and a.vec_id + 4""",
}
#: Statements over the prelude's operands.
LAYERED = {
    "q_attention4": """select p.b as b, p.h as h, p.i as i, w.d as d, sum(p.v * w.v) as v from
(select cast(l_linenumber % 2 as bigint) as b, l_orderkey % 3 as h, l_partkey % 40 as i, l_suppkey % 30 as j, sum(l_quantity) as v from lineitem group by 1, 2, 3, 4) p join
(select cast(l_linenumber % 2 as bigint) as b, l_orderkey % 3 as h, l_suppkey % 30 as j, l_partkey % 8 as d, sum(l_quantity) as v from lineitem group by 1, 2, 3, 4) w
on p.b = w.b and p.h = w.h and p.j = w.j group by p.b, p.h, p.i, w.d""",
    "q_gcn_forward": """, E as (select s, d from U union all select s_suppkey, s_suppkey from supplier),
NE as (select s, count(*) as n from E group by s),
AD as (select e.s as s, e.d as d, 1 / sqrt(cast(x.n as double)) / sqrt(cast(y.n as double)) as w from E e join NE x on e.s = x.s join NE y on e.d = y.s),
W1 as (select * from (values (0, 0, 0.1e0), (0, 1, -0.2e0), (0, 2, 0.3e0), (1, 0, 0.05e0), (1, 1, 0.1e0), (1, 2, -0.1e0)) t(h, f, w)),
W2 as (select * from (values (0, 0, 0.2e0), (0, 1, -0.4e0), (1, 0, -0.3e0), (1, 1, 0.6e0)) t(o, h, w)),
XW as (select K.k as k, W1.h as h, sum(K.v * W1.w) as v from K join W1 on K.f = W1.f group by 1, 2),
H as (select AD.s as i, XW.h as h, greatest(sum(AD.w * XW.v) + case when XW.h = 0 then 0.5e0 else -0.25e0 end, 0e0) as v from AD join XW on AD.d = XW.k group by 1, 2),
HW as (select H.i as k, W2.o as o, sum(H.v * W2.w) as v from H join W2 on H.h = W2.h group by 1, 2),
O as (select AD.s as i, HW.o as o, sum(AD.w * HW.v) + case when HW.o = 0 then 0.1e0 else 0e0 end as v from AD join HW on AD.d = HW.k group by 1, 2)
select i, cast(o as bigint) as o, round(v - m - ln(sum(exp(v - m)) over (partition by i)), 6) + 0e0 as lp from (select i, o, v, max(v) over (partition by i) as m from O) z""",
    "q_autoencoder": """, W1 as (select * from (values (0, 0, 0.1e0), (0, 1, -0.2e0), (0, 2, 0.3e0), (1, 0, 0.05e0), (1, 1, 0.1e0), (1, 2, -0.1e0)) t(h, f, w)),
W2 as (select * from (values (0, 0, 0.2e0), (0, 1, -0.4e0), (1, 0, -0.3e0), (1, 1, 0.6e0)) t(o, h, w)),
H as (select W1.h as h, K.k as k, greatest(sum(W1.w * K.v) + case when W1.h = 0 then 0.5e0 else -0.25e0 end, 0e0) as v from W1 join K on W1.f = K.f group by 1, 2)
select cast(W2.o as bigint) as o, H.k as k, round(1 / (1 + exp(-(sum(W2.w * H.v) + case when W2.o = 0 then 0.1e0 else 0e0 end))), 6) as y from W2 join H on W2.h = H.h group by W2.o, H.k""",
    "q_positional": """select s_suppkey as i, f, round(case when f % 2 = 0 then sin(s_suppkey / pow(10000e0, (f - f % 2) / 4e0)) else cos(s_suppkey / pow(10000e0, (f - f % 2) / 4e0)) end, 6) + 0e0 as pe from supplier cross join (select unnest(range(4)) as f) g""",
    "q_layer_norm": """select k, f, round((v - avg(v) over (partition by k)) / sqrt(var_pop(v) over (partition by k) + 0.00001e0), 6) + 0e0 as normed from K""",
    "q_csr_round_trip": "select k, j, v from B",
    "q_accuracy": """select round(avg(case when z.k % 2 = p.p_size % 2 then 1e0 else 0e0 end), 9) as accuracy from (select j, k, row_number() over (partition by j order by v desc, k) as rn from B) z join part p on z.j = p.p_partkey where rn = 1 and p.p_partkey % 3 = 0""",
    "q_relabel": "select s_suppkey, row_number() over (order by s_suppkey) - 1 as rank from supplier where s_suppkey % 3 = 1",
    "q_runtime": "select event_type, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from events group by event_type",
    "q_mse": "select round(avg((l_discount - l_tax) * (l_discount - l_tax)), 9) as mse from lineitem",
}
EXTRA["q_encode"] = """with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) as token, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9'']+'), 1) as pos from documents),
c as (select token, count(*) as n from w group by token),
r as (select token, row_number() over (order by n desc, token) + 1 as id, row_number() over (order by n desc, token) as rn from c),
e as (select w.doc_id, w.pos, coalesce(case when r.rn <= 1000 then r.id end, 0) as id from w left join r on r.token = w.token where w.pos <= 8192),
l as (select doc_id, list(id order by pos) as ids from e group by doc_id)
select doc_id, array_to_string(list_concat(ids, list_transform(range(8192 - len(ids)), lambda x: 1)), ',') as ids from l"""
EXTRA["q_read_mtx"] = EXTRA["q_to_host"] = "select cast(n_nationkey as bigint) as i, cast(n_regionkey as bigint) as j, n_nationkey + 1e0 as v from nation"
EXTRA["q_results_sink"] = "select event_type, count(*) as n from events cross join range(3) group by event_type, range"
EXTRA["q_labelled_csv"] = "select cast(l_linenumber - 1 as integer) as label, l_returnflag || ' ' || l_linestatus as text from lineitem"
EXTRA["q_labelled_text"] = "select string_agg(n_name, ' ' order by n_nationkey) || chr(10) as text, cast(n_regionkey as integer) as label from nation group by n_regionkey"
EXTRA["q_random_exact"] = "select cast(5000 as bigint) as n, cast(5000 as bigint) as places, true as inside"
#: Other ways to the same result.
SAME = {"q_transposed_rhs": "q_spmm", "q_spmm_long": "q_spmm", "q_matmul_vector": "q_spmv", "q_sddmm_kj": "q_sddmm", "q_mode_order": "q_coalesce", "q_compiled": "q_spmm_scale", "q_graph_source": "q_undirect"}


def oracle_sql() -> dict[str, str]:
    out = {name: f"{PRELUDE} {sql}" for name, (_, sql) in STATEMENTS.items()}
    out |= {name: f"{PRELUDE.rstrip()}{sql}" if sql.startswith(",") else f"{PRELUDE} {sql}" for name, sql in LAYERED.items()}
    return out | EXTRA | {name: out[other] for name, other in SAME.items()}
