"""DuckDB SQL for the queries of the catalogue that SQL can express."""

from __future__ import annotations

DIM = 64
P = "p AS (SELECT vec_id, vec_id // 25 AS image_idx, vec_id % 25 AS patch_pos, (vec_id % 25) // 5 AS r, vec_id % 5 AS c, label, embedding::DOUBLE[] AS f FROM embeddings)"


def _bank(name: str, group: str) -> str:
    return f"{name} AS (SELECT bank_id, list(v ORDER BY i) AS f FROM (SELECT ({group})::BIGINT AS bank_id, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, {DIM + 1}) t(i) GROUP BY ALL) GROUP BY bank_id)"


BANK = _bank("bank", "vec_id // 25")
KN = "kn AS (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY d, bank_id))::INTEGER AS rank FROM (SELECT vec_id, image_idx, patch_pos, p.f AS x, bank.bank_id, list_distance(p.f, bank.f) ** 2 AS d FROM p, bank))"
FIRST = "k1 AS (SELECT *, row_number() OVER (PARTITION BY image_idx ORDER BY d DESC, patch_pos) AS o FROM kn WHERE rank = 1)"
NEAR = f"WITH {P}, {BANK}, {KN}, {FIRST}"


def _eq7(b: int) -> str:
    return f"""sup AS (SELECT anchor, nbr, f FROM (SELECT a.bank_id AS anchor, b.bank_id AS nbr, b.f, row_number() OVER (PARTITION BY a.bank_id ORDER BY list_distance(a.f, b.f), b.bank_id) AS o FROM bank a, bank b) WHERE o <= {b}),
sd AS (SELECT vec_id, image_idx, patch_pos, o, d AS s, list_distance(k1.x, sup.f) ** 2 AS sd FROM k1 JOIN sup ON anchor = bank_id),
sm AS (SELECT *, max(sd) OVER (PARTITION BY vec_id) AS m FROM sd),
e7 AS (SELECT vec_id, image_idx, patch_pos, o, any_value(s) AS s, greatest(0, least(1, 1 - exp(any_value(s) - any_value(m)) / sum(exp(sd - m)))) * any_value(s) AS e FROM sm GROUP BY ALL)"""


_SOFT = "w AS (SELECT *, exp((s - max(s) OVER (PARTITION BY image_idx)) / 0.5) AS ex FROM {src} WHERE o <= 5)"
_TOPP = "tp AS (SELECT *, coalesce(sum(greatest(s, 0)) OVER (PARTITION BY image_idx ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(greatest(s, 0)) OVER (PARTITION BY image_idx) AS before FROM {src})"
_K1S = "k1s AS (SELECT *, d AS s FROM k1)"

COV = f"""xs AS (SELECT {{key}} AS g, embedding::DOUBLE[] AS f FROM embeddings),
cv AS (SELECT g, i, j, avg(f[i]) AS mean_i, covar_samp(f[i], f[j]) AS cov, count(*) AS n FROM xs, range(1, {DIM + 1}) a(i), range(1, {DIM + 1}) b(j) WHERE i <= j GROUP BY ALL)"""
TRACES = f"WITH {COV.format(key='0')}, t AS (SELECT sum(cov * cov * CASE WHEN i = j THEN 1 ELSE 2 END) AS t2, sum(CASE WHEN i = j THEN cov ELSE 0 END) AS t, any_value(n)::DOUBLE AS n, {DIM}.0::DOUBLE AS d FROM cv)"

LP = f"""comp AS (SELECT label::BIGINT AS component_id, count(*)::DOUBLE AS w, [{", ".join(f"avg(f[{i}])" for i in range(1, DIM + 1))}] AS m, [{", ".join(f"var_pop(f[{i}])" for i in range(1, DIM + 1))}] AS v FROM p GROUP BY label),
cl AS (SELECT *, ln(w / sum(w) OVER ()) AS lw FROM comp),
lp AS (SELECT vec_id, image_idx, patch_pos, component_id, -0.5 * (list_sum(list_transform(range(1, {DIM + 1}), lambda i: (f[i] - m[i]) ** 2 / v[i])) + list_sum(list_transform(v, lambda y: ln(y))) + {DIM} * ln(2 * pi())) + lw AS lp FROM p, cl)"""

_SCORED = "s AS (SELECT doc_id, lang, n_chars::DOUBLE AS score, toxic AS label FROM documents JOIN labels USING (doc_id))"
_MAPS = "mp AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS m, list_transform(coalesce(b.embedding::DOUBLE[], list_transform(a.embedding, lambda y: 0.0::DOUBLE)), lambda y: (y > 0.15)::INTEGER) AS k FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_CELLS = f"cell AS (SELECT vec_id, i, m[i + 1] AS val, k[i + 1] AS y FROM mp, range(0, {DIM}) t(i))"
_REGIONS = """reg(vec_id, i, l) AS (
  SELECT vec_id, i, i FROM cell WHERE y = 1
  UNION SELECT c.vec_id, c.i, reg.l FROM reg JOIN cell c ON c.vec_id = reg.vec_id AND c.y = 1 AND (abs(c.i // 8 - reg.i // 8) + abs(c.i % 8 - reg.i % 8)) = 1 WHERE reg.l < c.i),
rl AS (SELECT vec_id, i, min(l) AS l0 FROM reg GROUP BY ALL)"""


def _sweep(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""c AS (SELECT {k}score, sum((label > 0)::INT)::DOUBLE AS pos, sum((label <= 0)::INT)::DOUBLE AS neg FROM s GROUP BY {k}score),
w AS (SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp, sum(pos) OVER ({part}) AS np, sum(neg) OVER ({part}) AS nn FROM c)"""


_AUROC = "CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(neg * (tp - pos / 2)) / (max(np) * max(nn)) ELSE 'nan'::DOUBLE END"
_AP = "CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(pos * tp / (tp + fp)) / max(np) ELSE 'nan'::DOUBLE END"
_F1 = "CASE WHEN tp + fp + np > 0 THEN 2 * tp / (tp + fp + np) ELSE 0 END"


def _confusion(group: str, at: str = "1500") -> str:
    return f"""cf AS (SELECT {group}sum((label > 0 AND score >= {at})::INT)::BIGINT AS tp, sum((label <= 0 AND score >= {at})::INT)::BIGINT AS fp, sum((label > 0 AND score < {at})::INT)::BIGINT AS fn, sum((label <= 0 AND score < {at})::INT)::BIGINT AS tn FROM s {"GROUP BY ALL" if group else ""})"""


_CONF = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy"""

_AUPRO = """st AS (SELECT max(val) AS hi, min(val) AS lo, sum(wt) AS regions, sum(normal) AS normals FROM px),
th AS (SELECT i, CASE WHEN i = 255 THEN lo ELSE hi + i * ((lo - hi) / 255) END AS t FROM st, range(0, 256) r(i)),
cu AS (SELECT i, sum(CASE WHEN val >= t THEN wt ELSE 0 END) / any_value(regions) AS pro, sum(CASE WHEN val >= t THEN normal ELSE 0 END) / any_value(normals) AS fpr FROM th, px, st GROUP BY i),
va AS (SELECT i, fpr, max(pro) OVER (ORDER BY fpr, i) AS pro FROM cu WHERE fpr <= 0.3),
lg AS (SELECT *, lag(pro) OVER (ORDER BY fpr, i) AS p0, lag(fpr) OVER (ORDER BY fpr, i) AS f0 FROM va)
SELECT round((sum(CASE WHEN f0 IS NULL THEN pro * fpr ELSE (fpr - f0) * (pro + p0) / 2 END) + arg_max(pro, struct_pack(a := fpr, b := i)) * (0.3 - max(fpr))) / 0.3, 6) AS aupro FROM lg"""


def _whiten(d: int) -> str:
    """Cholesky by rows and forward substitution, unrolled."""
    out = [f"xs AS (SELECT vec_id, embedding::DOUBLE[] AS f FROM embeddings)", "s0 AS (SELECT " + ", ".join([f"avg(f[{i}]) AS m{i}" for i in range(1, d + 1)] + [f"covar_samp(f[{i}], f[{j}]) AS s{i}_{j}" for i in range(1, d + 1) for j in range(1, i + 1)]) + " FROM xs)"]
    prev = "s0"
    for j in range(1, d + 1):
        out.append(f"c{j} AS (SELECT *, sqrt(s{j}_{j} - ({' + '.join([f'l{j}_{k} ** 2' for k in range(1, j)] or ['0'])})) AS l{j}_{j} FROM {prev})")
        cols = [f"(s{i}_{j} - ({' + '.join([f'l{i}_{k} * l{j}_{k}' for k in range(1, j)] or ['0'])})) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, d + 1)]
        if cols:
            out.append(f"e{j} AS (SELECT *, {', '.join(cols)} FROM c{j})")
            prev = f"e{j}"
        else:
            prev = f"c{j}"
    zp = f"xs, {prev}"
    for i in range(1, d + 1):
        out.append(f"z{i}t AS (SELECT *, (f[{i}] - m{i} - ({' + '.join([f'l{i}_{k} * z{k}' for k in range(1, i)] or ['0'])})) / l{i}_{i} AS z{i} FROM {zp})")
        zp = f"z{i}t"
    return f"WITH {', '.join(out)} SELECT vec_id, round({' + '.join(f'z{i} ** 2' for i in range(1, d + 1))}, 6) AS norm FROM {zp}"


def _picks(start: str, k: int | str) -> str:
    """Recursive selection of k rows: start is the first row's order; then always the row farthest from the chosen."""
    return f"""WITH RECURSIVE x AS (SELECT vec_id, embedding::DOUBLE[] AS f FROM embeddings),
mu AS (SELECT list(v ORDER BY i) AS m FROM (SELECT i, avg(f[i]) AS v FROM x, range(1, {DIM + 1}) t(i) GROUP BY i)),
s(n, vec_id, f) AS (
  (SELECT 0, vec_id, f FROM ({start}) ORDER BY a DESC, vec_id LIMIT 1)
  UNION ALL
  (SELECT n, vec_id, f FROM (SELECT (SELECT max(n) FROM recurring.s) + 1 AS n, x.vec_id, any_value(x.f) AS f, min(list_distance(x.f, r.f)) AS near FROM x, recurring.s r GROUP BY x.vec_id ORDER BY near DESC, x.vec_id LIMIT 1) WHERE n < {k}))
"""


#: so many of n rows as their share 0.02 holds whole ones
_SHARE = "(SELECT floor(count(*) * 0.02) FROM embeddings)"
_GREEDY = _picks("SELECT a.vec_id, any_value(a.f) AS f, sum(list_distance(a.f, b.f) ** 2) AS a FROM x a, x b GROUP BY a.vec_id", _SHARE) + f"SELECT n::BIGINT AS bank_id, round(f[1], 6) + 0.0 AS x0, round(f[2], 6) + 0.0 AS x1, round(f[3], 6) + 0.0 AS x2 FROM s WHERE n < {_SHARE}"


def _farthest(name: str, source: str, k: int) -> str:
    """CTEs for farthest-first in every group of source (grp, ord, f) at once: ``name`` (grp, n, f), n from 0; groups of k rows
    or fewer stay in their order."""
    return f"""{name}_m AS (SELECT grp, list(v ORDER BY i) AS m, any_value(c) AS c FROM (SELECT grp, i, avg(f[i]) AS v, count(*) AS c FROM {source}, range(1, {DIM + 1}) t(i) GROUP BY grp, i) GROUP BY grp),
{name}_s(n, grp, ord, f) AS (
  (SELECT 0, grp, ord, f FROM {source} JOIN {name}_m USING (grp) WHERE c > {k} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY list_distance(f, m) DESC, ord) = 1)
  UNION ALL
  (SELECT n, grp, ord, f FROM (SELECT (SELECT max(n) FROM recurring.{name}_s) + 1 AS n, x.grp, x.ord, any_value(x.f) AS f, min(list_distance(x.f, r.f)) AS near FROM {source} x JOIN recurring.{name}_s r ON x.grp = r.grp GROUP BY x.grp, x.ord)
   WHERE n < {k} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY near DESC, ord) = 1)),
{name} AS (SELECT grp, n::BIGINT AS n, f FROM {name}_s UNION ALL SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY ord) - 1, f FROM {source} JOIN {name}_m USING (grp) WHERE c <= {k})"""


LEVELS = 14  # of merging: 16,384 batches


def _merge_reduce(name: str, source: str, k: int, chunk: int) -> str:
    """CTEs for merge-reduce k-center of source (b, ord, f), batches b from 0 without gaps: ``name`` (n, f)."""
    cap = min(k, chunk)
    out = [f"{name}_i0 AS (SELECT b AS grp, ord, f FROM {source})", _farthest(f"{name}_0", f"{name}_i0", cap), f"{name}_n0 AS (SELECT count(DISTINCT grp) AS nodes FROM {name}_0)"]
    for j in range(1, LEVELS + 1):
        old = f"{name}_{j - 1}"
        out.append(f"{name}_i{j} AS (SELECT grp // 2 AS grp, (grp % 2) * {cap} + n AS ord, f FROM {old}, {name}_n{j - 1} WHERE nodes > 1 AND grp < nodes // 2 * 2)")
        out.append(_farthest(f"{name}_{j}", f"{name}_i{j}", cap))
        out.append(f"{name}_n{j} AS (SELECT nodes // 2 AS nodes FROM {name}_n{j - 1})")
    rest = " UNION ALL ".join(f"SELECT {j} * {cap} + n AS ord, f FROM {name}_{j}, {name}_n{j} WHERE nodes % 2 = 1 AND grp = nodes - 1" for j in range(LEVELS + 1))
    out += [f"{name}_rest AS (SELECT 0 AS grp, ord, f FROM ({rest}))", _farthest(f"{name}_z", f"{name}_rest", k), f"{name} AS (SELECT n, f FROM {name}_z)"]
    return ",\n".join(out)


_BANK_NORMS = "SELECT n AS bank_id, round(sqrt(list_inner_product(f, f)), 6) AS norm, round(f[1], 6) + 0.0 AS \"first\" FROM"
_BLOCKS = "x AS (SELECT vec_id // 64 AS b, vec_id AS ord, embedding::DOUBLE[] AS f FROM embeddings)"


def _tail_aware(k: int, main: int, pool: int, chunk: int) -> str:
    """Main centers from the full ones, the pool of largest residuals, and of its new rows those farthest from all chosen."""
    return f"""WITH RECURSIVE {_BLOCKS}, {_merge_reduce("full_", "x", k, chunk)}, fi AS (SELECT 0 AS grp, n AS ord, f FROM full_), {_farthest("main", "fi", main)},
re AS (SELECT x.ord, x.f, min(list_distance(x.f, c.f)) AS d FROM x, full_ c GROUP BY ALL),
top AS (SELECT min(ord) AS ord, f, arg_min(d, ord) AS d FROM re GROUP BY f ORDER BY d DESC, min(ord) LIMIT {pool}),
fresh AS (SELECT row_number() OVER (ORDER BY d DESC, ord) AS o, f FROM top WHERE f NOT IN (SELECT f FROM main)),
pick(n, o, f) AS (
  (SELECT 0, o, f FROM (SELECT o, fresh.f, min(list_distance(fresh.f, main.f)) AS near FROM fresh, main GROUP BY ALL) ORDER BY near DESC, o LIMIT 1)
  UNION ALL
  (SELECT n, o, f FROM (SELECT (SELECT max(n) FROM recurring.pick) + 1 AS n, fresh.o, fresh.f, min(list_distance(fresh.f, c.f)) AS near FROM fresh, (SELECT f FROM main UNION ALL SELECT f FROM recurring.pick) c WHERE fresh.o NOT IN (SELECT o FROM recurring.pick) GROUP BY fresh.o, fresh.f ORDER BY near DESC, fresh.o LIMIT 1) WHERE n < {k - main}))
{_BANK_NORMS} (SELECT n, f FROM main UNION ALL SELECT n + (SELECT count(*) FROM main), f FROM pick)"""


def _sigma(rho: float) -> str:
    """CTEs for the regularised covariance as a list of rows with the unit matrix behind: m0 (m), and the mean mu (m)."""
    return f"""{COV.format(key="0")}, tr AS (SELECT sum(cov) AS t FROM cv WHERE i = j), mu AS (SELECT list(mean_i ORDER BY i) AS m FROM cv WHERE i = j AND i = j),
sym AS (SELECT i, j, {1 - rho} * cov + CASE WHEN i = j THEN {rho} * t / {DIM} ELSE 0 END AS v FROM (SELECT i, j, cov FROM cv UNION ALL SELECT j, i, cov FROM cv WHERE i < j), tr),
m0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list_concat(list(v ORDER BY j), list_transform(range(1, {DIM + 1}), lambda y: (y = i)::DOUBLE)) AS r FROM sym GROUP BY i))"""


_INVERSE = f"""g(k, m) AS (SELECT 0, m FROM m0 UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN p ELSE list_transform(r, lambda y, j: y - r[k + 1] * p[j]) END) FROM (SELECT k, m, list_transform(m[k + 1], lambda y: y / m[k + 1][k + 1]) AS p FROM g WHERE k < {DIM})),
inv AS (SELECT list_transform(m, lambda r: r[{DIM + 1}:{2 * DIM}]) AS w FROM g WHERE k = {DIM})"""
#: rows of the inverse Cholesky factor: elimination below the pivots only, divided by the pivots' roots
_FACTOR = f"""g(k, m) AS (SELECT 0, m FROM m0 UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i <= k + 1 THEN r ELSE list_transform(r, lambda y, j: y - r[k + 1] / p[k + 1] * p[j]) END) FROM (SELECT k, m, m[k + 1] AS p FROM g WHERE k < {DIM})),
inv AS (SELECT list_transform(m, lambda r, i: list_transform(r[{DIM + 1}:{2 * DIM}], lambda y: y / sqrt(r[i]))) AS w FROM g WHERE k = {DIM})"""
_ANOMALY = f"""WITH RECURSIVE {_sigma(0.07)}, {_FACTOR},
z AS (SELECT vec_id, list_transform(w, lambda r: list_inner_product(r, d)) AS f FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda y, i: y - m[i]) AS d FROM embeddings, mu), inv),
zb AS (SELECT vec_id // 64 AS b, vec_id AS ord, f FROM z), {_merge_reduce("mr", "zb", 100, 64)},
bank AS (SELECT n AS bank_id, f FROM mr), p AS (SELECT vec_id, vec_id // 25 AS image_idx, vec_id % 25 AS patch_pos, f FROM z), {KN}, {FIRST}, {_eq7(5)}
SELECT image_idx, round(e, 6) AS score FROM e7 WHERE o = 1"""
_TOLERANCE = """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, {f} AS f FROM embeddings),
g(n, kept, ids) AS (SELECT 1::BIGINT, [f], [vec_id] FROM o WHERE n = 1 UNION ALL
  SELECT o.n, CASE WHEN near THEN kept ELSE list_append(kept, f) END, CASE WHEN near THEN ids ELSE list_append(ids, vec_id) END
  FROM (SELECT g.n + 1 AS n, kept, ids, vec_id, f, list_min(list_transform(kept, lambda k: list_distance(k, f))) <= {eps} AS near FROM g JOIN o ON o.n = g.n + 1) o)
SELECT unnest(ids) AS vec_id FROM (SELECT ids FROM g ORDER BY n DESC LIMIT 1)"""
_BUDGETED = """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, embedding::DOUBLE[] AS f FROM embeddings),
g(n, c) AS (SELECT 0::BIGINT, []::DOUBLE[][] UNION ALL
  SELECT n, CASE WHEN len(c) < {k} THEN list_append(c, f) WHEN list_min(list_transform(c, lambda a: list_distance(a, f))) > list_min(near) THEN list_transform(c, lambda a, i: CASE WHEN i = list_position(near, list_min(near)) THEN f ELSE a END) ELSE c END
  FROM (SELECT o.n, o.f, c, list_transform(c, lambda a, i: list_min(list_transform(c, lambda b, j: CASE WHEN i = j THEN 'inf'::DOUBLE ELSE list_distance(a, b) END))) AS near FROM g JOIN o ON o.n = g.n + 1))
SELECT (i - 1)::BIGINT AS bank_id, round(sqrt(list_inner_product(f, f)), 6) AS norm, round(f[1], 6) + 0.0 AS "first" FROM (SELECT unnest(range(1, len(c) + 1)) AS i, unnest(c) AS f FROM (SELECT c FROM g ORDER BY n DESC LIMIT 1))"""


def _pool(out: int) -> str:
    return f"SELECT vec_id, (b)::INTEGER AS bin, round(list_avg((embedding::DOUBLE[])[b * {DIM} // {out} + 1 : ((b + 1) * {DIM} + {out} - 1) // {out}]), 6) + 0.0 AS value FROM embeddings, range(0, {out}) t(b)"


def _linear(weights, out: int) -> str:
    """Cells of W M W^T for a weight matrix W (out x 8)."""
    vals = ", ".join(f"({i}, {j}, {float(weights[i, j])!r}::DOUBLE)" for i in range(out) for j in range(8) if weights[i, j])
    return f"""WITH w(o, i, v) AS (VALUES {vals}), e AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(0, 64) t(i)),
h AS (SELECT vec_id, r, o AS oc, sum(x * v) AS x FROM e JOIN w ON c = w.i GROUP BY ALL)
SELECT vec_id, (o * {out} + oc)::INTEGER AS cell, round(sum(x * v), 6) + 0.0 AS value FROM h JOIN w ON r = w.i GROUP BY vec_id, o, oc"""


_Q2 = "[round_even((embedding[1])::DOUBLE, 1) + 0.0, round_even((embedding[2])::DOUBLE, 1) + 0.0]"
_PAIR = _bank("bank", "vec_id // 25") + ", pool AS (SELECT DISTINCT [round_even(f[1], 1) + 0.0, round_even(f[2], 1) + 0.0] AS k FROM bank)"

_RUNS = """r AS (SELECT l_returnflag AS experiment, l_suppkey AS run_dir, l_linestatus AS dataset, avg(l_discount) AS a, avg(l_tax) AS b, max(l_shipdate) AS ts FROM lineitem GROUP BY ALL),
su AS (SELECT experiment, run_dir, avg(a) AS image_auroc, avg(b) AS image_ap, max(ts) AS ts FROM r GROUP BY ALL)"""


def oracle() -> dict[str, str]:
    from ..functions.kernels import bilinear_weights, gaussian_weights

    names = ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "balanced_accuracy"]
    row = ["num_images", "num_anomalous_images", "image_auroc", "image_average_precision", "image_threshold", "image_best_f1", *(f"image_{c}" for c in names)]
    return {
        "knn_top3": f"WITH {P}, {BANK}, {KN} SELECT vec_id, rank, bank_id, round(d, 6) AS sq_dist FROM kn WHERE rank <= 3",
        "patch_score_meank": f"WITH {P}, {BANK}, {KN} SELECT vec_id, round(avg(d), 6) AS score FROM kn WHERE rank <= 3 GROUP BY vec_id",
        "image_score_max": f"{NEAR} SELECT image_idx, round(max(d), 6) AS score FROM k1 GROUP BY image_idx",
        "unpatch_scores": f"{NEAR} SELECT image_idx, count(*)::INTEGER AS n, round(arg_min(d, patch_pos), 6) AS first_score, round(arg_max(d, patch_pos), 6) AS last_score FROM k1 GROUP BY image_idx",
        "eq7_image_score": f"{NEAR}, {_eq7(5)} SELECT image_idx, patch_pos, round(e, 6) AS score FROM e7 WHERE o = 1",
        "topk_soft_score": f"{NEAR}, {_K1S}, {_SOFT.format(src='k1s')} SELECT image_idx, round(sum(ex * s) / sum(ex), 6) AS score FROM w GROUP BY image_idx",
        "eq7_topk_soft": f"{NEAR}, {_eq7(5)}, {_SOFT.format(src='e7')} SELECT image_idx, round(sum(ex * e) / sum(ex), 6) AS score FROM w GROUP BY image_idx",
        "topp_mean_score": f"{NEAR}, {_K1S}, {_TOPP.format(src='k1s')} SELECT image_idx, round(avg(s), 6) AS score FROM tp WHERE before < 0.55 AND o <= 8 GROUP BY image_idx",
        "eq7_topp_mean": f"{NEAR}, {_eq7(5)}, {_TOPP.format(src='e7')} SELECT image_idx, round(avg(e), 6) AS score FROM tp WHERE before < 0.25 AND o <= 8 GROUP BY image_idx",
        "pni_gate_score": f"""{NEAR}, lb AS (SELECT image_idx, patch_pos, patch_pos // 5 AS r, patch_pos % 5 AS c, bank_id FROM k1),
pos AS (SELECT r, c, bank_id, count(*) / sum(count(*)) OVER (PARTITION BY r, c) AS q FROM lb GROUP BY r, c, bank_id),
hd AS (SELECT a.image_idx, a.patch_pos, b.bank_id, count(*) / sum(count(*)) OVER (PARTITION BY a.image_idx, a.patch_pos) AS q FROM lb a JOIN lb b ON a.image_idx = b.image_idx AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.patch_pos <> b.patch_pos GROUP BY a.image_idx, a.patch_pos, b.bank_id),
mx AS (SELECT kn.image_idx, kn.patch_pos, kn.d, 0.4 * coalesce(pos.q, 0) + 0.6 * coalesce(hd.q, 0) AS q FROM kn LEFT JOIN pos ON pos.r = kn.patch_pos // 5 AND pos.c = kn.patch_pos % 5 AND pos.bank_id = kn.bank_id LEFT JOIN hd ON hd.image_idx = kn.image_idx AND hd.patch_pos = kn.patch_pos AND hd.bank_id = kn.bank_id)
SELECT image_idx, patch_pos, round(2 * coalesce(min(d) FILTER (q >= 0.12), min(d)), 6) AS score FROM mx GROUP BY ALL""",
        "density_log_prob": f"WITH {P}, {LP} SELECT vec_id, component_id, round(lp, 4) AS log_prob FROM lp",
        "density_eq7": f"""WITH {P}, {LP}, an AS (SELECT image_idx, patch_pos, min(-lp) AS s, arg_min(component_id, -lp) AS anchor FROM lp GROUP BY ALL),
top AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY image_idx ORDER BY s DESC, patch_pos) = 1),
bh AS (SELECT a.component_id AS anchor, b.component_id, CASE WHEN a.component_id = b.component_id THEN -1 ELSE
  list_sum(list_transform(range(1, {DIM + 1}), lambda i: (a.m[i] - b.m[i]) ** 2 / ((a.v[i] + b.v[i]) / 2))) / 8 + list_sum(list_transform(range(1, {DIM + 1}), lambda i: ln((a.v[i] + b.v[i]) / 2) - 0.5 * (ln(a.v[i]) + ln(b.v[i])))) / 2 END AS d FROM cl a, cl b),
nb AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY d, component_id) AS o FROM bh QUALIFY o <= 5),
sc AS (SELECT top.image_idx, top.patch_pos, s, o, -lp AS ds FROM top JOIN nb USING (anchor) JOIN lp ON lp.image_idx = top.image_idx AND lp.patch_pos = top.patch_pos AND lp.component_id = nb.component_id),
mm AS (SELECT *, max(ds) OVER (PARTITION BY image_idx) AS m FROM sc)
SELECT image_idx, patch_pos, round(greatest(0, least(1, 1 - exp(max(ds) FILTER (o = 1) - any_value(m)) / sum(exp(ds - m)))) * any_value(s), 4) AS score FROM mm GROUP BY ALL""",
        "local_position_knn": f"WITH {P} SELECT vec_id, rank, bank_id, round(d, 6) AS sq_dist FROM (SELECT a.vec_id, b.vec_id AS bank_id, list_distance(a.f, b.f) ** 2 AS d, (row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.f, b.f) ** 2, b.vec_id))::INTEGER AS rank FROM p a JOIN p b ON a.patch_pos = b.patch_pos) WHERE rank <= 3",
        "bank_support": f"WITH {BANK} SELECT anchor_id, rank, nbr_id FROM (SELECT a.bank_id AS anchor_id, b.bank_id AS nbr_id, (row_number() OVER (PARTITION BY a.bank_id ORDER BY list_distance(a.f, b.f), b.bank_id))::INTEGER AS rank FROM bank a, bank b) WHERE rank <= 4",
        "bank_self_distance": f"WITH {BANK} SELECT a.bank_id, round(min(list_distance(a.f, b.f)), 6) AS self_distance FROM bank a JOIN bank b ON a.bank_id <> b.bank_id GROUP BY a.bank_id",
        "min_distance_to_pool": f"WITH {P}, {_bank('bank', 'label')} SELECT vec_id, round(min(list_distance(p.f, bank.f)), 6) AS distance FROM p, bank GROUP BY vec_id",
        "grid_neighbourhood": 'SELECT a.r AS "row", a.c AS "col", b.r AS nrow, b.c AS ncol FROM (SELECT DISTINCT (vec_id % 25) // 5 AS r, vec_id % 5 AS c FROM embeddings) a JOIN (SELECT DISTINCT (vec_id % 25) // 5 AS r, vec_id % 5 AS c FROM embeddings) b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r, a.c) <> (b.r, b.c)',
        "feature_mean_cov": f"WITH {COV.format(key='0')} SELECT i::INTEGER AS i, j::INTEGER AS j, round(mean_i, 8) AS mean_i, round(cov, 8) + 0.0 AS cov FROM cv",
        "cov_per_label": f"WITH {COV.format(key='label')} SELECT g AS label, n, i::INTEGER AS i, j::INTEGER AS j, round(cov, 8) + 0.0 AS cov FROM cv",
        "oas_shrinkage": f"{TRACES} SELECT round(greatest(0, least(1, ((1 - 2 / d) * t2 + t * t) / ((n + 1 - 2 / d) * (t2 - t * t / d)))), 6) AS rho FROM t",
        "rblw_shrinkage": f"{TRACES} SELECT round(greatest(0, least(1, ((n - 2) / n * t2 + t * t) / ((n + 2) * (t2 - t * t / d)))), 6) AS rho FROM t",
        "ledoit_wolf": f"""{TRACES}, mu AS (SELECT list(mean_i ORDER BY i) AS m FROM cv WHERE i = j), fo AS (SELECT sum(list_distance(f, m) ** 4) AS q FROM xs, mu),
b AS (SELECT t2 * ((n - 1) / n) ** 2 AS t2, t * (n - 1) / n AS t, n, d, q FROM t, fo) SELECT round(least((q / n - t2) / n, t2 - t * t / d) / (t2 - t * t / d), 6) AS rho FROM b""",
        "regularized_cov": f"{TRACES} SELECT i::INTEGER AS i, j::INTEGER AS j, round(0.93 * cov + CASE WHEN i = j THEN 0.07 * t / d ELSE 0 END, 8) + 0.0 AS value FROM cv, t",
        "whitened_norm_2d": _whiten(2),
        "whitened_norm_6d": _whiten(6),
        "whitened_norm_64d": f"""WITH RECURSIVE {_sigma(0.07)}, {_INVERSE}
SELECT vec_id, round(list_inner_product(list_transform(w, lambda r: list_inner_product(r, d)), d), 6) AS norm FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda y, i: y - m[i]) AS d FROM embeddings, mu), inv""",
        "pca_power_sums": f"""WITH {COV.format(key="0")}, tr AS (SELECT sum(cov) / {DIM} AS t FROM cv WHERE i = j), c AS (SELECT i, j, cov / t AS v FROM (SELECT i, j, cov FROM cv UNION ALL SELECT j, i, cov FROM cv WHERE i < j), tr),
c2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.i GROUP BY a.i, b.j)
SELECT 1 AS power, round(sum(v), 5) AS total FROM c WHERE i = j UNION ALL SELECT 2, round(sum(v * v), 5) FROM c UNION ALL SELECT 3, round(sum(c.v * c2.v), 5) FROM c JOIN c2 USING (i, j) UNION ALL SELECT 4, round(sum(v * v), 5) FROM c2""",
        "merge_reduce_bank": f"WITH RECURSIVE {_BLOCKS}, {_merge_reduce('mr', 'x', 100, 32)} {_BANK_NORMS} mr",
        "stream_bank": f"WITH RECURSIVE {_BLOCKS}, {_merge_reduce('mr', 'x', 50, 32)} {_BANK_NORMS} mr",
        "tail_aware_bank": _tail_aware(40, 34, 60, 32),
        "budgeted_kcenter": _BUDGETED.replace("{k}", "20"),
        "anomaly_scores": _ANOMALY,
        "staged_scores": _ANOMALY,
        "finite_rows": "SELECT label, count(*) AS n, count(*) FILTER (WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0) AS n_finite FROM embeddings GROUP BY label",
        "best_component": f"WITH {P}, {LP} SELECT vec_id, arg_min(component_id, -lp) AS component_id, round(min(-lp), 4) AS distance FROM lp GROUP BY vec_id",
        "knn_by_balls": """WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS f FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS bank_id, list_distance(a.f, b.f) ** 2 AS d FROM x a, x b),
            r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, bank_id) AS rank FROM d) SELECT vec_id, rank::INTEGER AS rank, bank_id, round(d, 6) + 0.0 AS sq_dist FROM r WHERE rank <= 3""",
        "bank_invariants": """SELECT * FROM (VALUES ('greedy_approx', (SELECT floor(count(*) * 0.02)::BIGINT FROM embeddings), true, true), ('kmeans', 10, true, true), ('minibatch_kmeans', 10, true, true)) t(bank, n_rows, from_table, closer_than_mean)""",
        "whitened_total": f"SELECT count(*) AS n, round((count(*) - 1) * {DIM}.0::DOUBLE, 4) AS total FROM embeddings",
        "pca_total_variance": f"{TRACES} SELECT round(t, 8) AS total FROM t",
        "pca_reduced": f"WITH {_bank('b', '0')}, {P} SELECT vec_id, round(list_distance(p.f, b.f) ** 2, 6) AS norm FROM p, b",
        "online_moments": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type",
        "stream_moments": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type",
        "farthest_first": _picks("SELECT vec_id, f, list_distance(f, m) AS a FROM x, mu", 20) + "SELECT n::BIGINT AS bank_id, round(f[1], 6) + 0.0 AS x0, round(f[2], 6) + 0.0 AS x1, round(f[3], 6) + 0.0 AS x2 FROM s",
        "greedy_exact": _GREEDY,
        "farthest_first_passes": _picks("SELECT vec_id, f, list_distance(f, m) AS a FROM x, mu", 20) + "SELECT n::BIGINT AS bank_id, round(f[1], 6) + 0.0 AS x0, round(f[2], 6) + 0.0 AS x1, round(f[3], 6) + 0.0 AS x2 FROM s",
        "greedy_passes": _GREEDY,
        "tail_residual_topk": f"WITH {P}, {BANK}, {KN} SELECT vec_id, round(sqrt(d), 6) AS tail_score FROM kn WHERE rank = 1 ORDER BY d DESC, vec_id LIMIT 50",
        "tail_pruning_gap": f"WITH {P}, {BANK}, {_bank('mn', 'label')}, a AS (SELECT vec_id, min(list_distance(p.f, bank.f)) AS d FROM p, bank GROUP BY vec_id), b AS (SELECT vec_id, min(list_distance(p.f, mn.f)) AS d FROM p, mn GROUP BY vec_id) SELECT vec_id, round(greatest(0, b.d - a.d), 6) AS tail_score FROM a JOIN b USING (vec_id)",
        "chi2_tail_band": f"""WITH {P}, st AS (SELECT [{", ".join(f"avg(f[{i}])" for i in range(1, DIM + 1))}] AS m, [{", ".join(f"stddev_samp(f[{i}])" for i in range(1, DIM + 1))}] AS s FROM p),
q AS (SELECT vec_id, list_sum(list_transform(range(1, {DIM + 1}), lambda i: ((f[i] - m[i]) / s[i]) ** 2)) / 2 AS h FROM p, st),
c AS (SELECT vec_id, exp(-h) * sum(exp(i * ln(h) - lgamma(i + 1))) AS tail_p FROM q, range(0, {DIM // 2}) t(i) GROUP BY vec_id, h)
SELECT vec_id, round(tail_p, 6) AS tail_p FROM c WHERE tail_p BETWEEN 0.45 AND 0.55""",
        "dedup_exact": f"SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY {_Q2}",
        "dedup_quantized": f"SELECT min(vec_id) AS vec_id, round(arg_min(embedding[1]::DOUBLE, vec_id), 6) + 0.0 AS x0 FROM embeddings GROUP BY {_Q2}",
        "dedup_tolerance": _TOLERANCE.replace("{f}", "(embedding::DOUBLE[])[1:2]").replace("{eps}", "0.04"),
        "dedup_tolerance_whole": _TOLERANCE.replace("{f}", "embedding::DOUBLE[]").replace("{eps}", "1.2"),
        "dedup_whole": "SELECT 'exact' AS key, min(vec_id) AS vec_id FROM embeddings GROUP BY embedding UNION ALL SELECT 'quantized', min(vec_id) FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda y: round_even(y, 1) + 0.0) AS q FROM embeddings) GROUP BY q",
        "pool_whole": f"""WITH {P}, {BANK}, e AS (SELECT embedding FROM embeddings WHERE vec_id % 2 = 0) SELECT 'in' AS side, vec_id FROM embeddings WHERE embedding IN (SELECT embedding FROM e) UNION ALL SELECT 'out', vec_id FROM embeddings WHERE embedding NOT IN (SELECT embedding FROM e)
UNION ALL SELECT 'near', vec_id FROM p, bank GROUP BY vec_id HAVING min(list_distance(p.f, bank.f)) <= 0.95""",
        "pool_semi_join": f"WITH {_PAIR} SELECT vec_id FROM embeddings WHERE {_Q2} IN (SELECT k FROM pool)",
        "pool_anti_join": f"WITH {_PAIR} SELECT vec_id FROM embeddings WHERE {_Q2} NOT IN (SELECT k FROM pool)",
        "adaptive_pool_16": _pool(16),
        "adaptive_pool_10": _pool(10),
        "merge_average": "SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: ((embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2) ** 2)), 6) AS norm FROM embeddings",
        "patchify_3x3": 'WITH e AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(0, 64) t(i)) SELECT a.vec_id, a.r::INTEGER AS "row", a.c::INTEGER AS "col", round(sum(b.x), 6) + 0.0 AS total FROM e a JOIN e b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.vec_id, a.r, a.c',
        "bilinear_upsample": _linear(bilinear_weights(8, 12), 12),
        "gaussian_smooth": _linear(gaussian_weights(8, 1.0), 8),
        "grid_regions": f"WITH RECURSIVE {_MAPS}, {_CELLS}, {_REGIONS} SELECT vec_id, l0::INTEGER AS first_cell, count(*) AS size FROM rl GROUP BY vec_id, l0",
        "pixel_aupro": f"WITH RECURSIVE {_MAPS}, {_CELLS}, {_REGIONS}, sz AS (SELECT vec_id, l0, count(*) AS n FROM rl GROUP BY ALL), px AS (SELECT c.val, coalesce(1.0::DOUBLE / sz.n, 0) AS wt, (c.y = 0)::INT AS normal FROM cell c LEFT JOIN rl ON rl.vec_id = c.vec_id AND rl.i = c.i LEFT JOIN sz ON sz.vec_id = c.vec_id AND sz.l0 = rl.l0), {_AUPRO}",
        "image_aupro": f"WITH {_SCORED}, px AS (SELECT score AS val, (label > 0)::INT::DOUBLE AS wt, (label <= 0)::INT AS normal FROM s), {_AUPRO}",
        "pixel_auroc": f"WITH {_MAPS}, s AS (SELECT unnest(m) AS score, unnest(k) AS label FROM mp), {_sweep()} SELECT round({_AUROC}, 6) AS auroc FROM w",
        "zscore_calibration": f"WITH {_SCORED}, t AS (SELECT avg(score) AS m, greatest(stddev_pop(score), 1e-12) AS d FROM s WHERE label = 0) SELECT doc_id, round((score - m) / d, 6) + 0.0 AS calibrated FROM s, t",
        "ecdf_calibration": f"WITH {_SCORED}, t AS (SELECT score FROM s WHERE label = 0) SELECT doc_id, round((SELECT count(*) FROM t WHERE t.score <= s.score) / (SELECT count(*) FROM t), 6) AS calibrated FROM s",
        "self_ecdf_by_type": "SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS calibrated FROM events",
        "confusion_metrics": f"WITH {_SCORED}, {_confusion('')}, m AS (SELECT tp, fp, fn, tn, {_CONF} FROM cf) SELECT tp, fp, fn, tn, {', '.join(f'round({c}, 6) AS {c}' for c in names[4:])} FROM m",
        "best_f1_threshold": f"WITH {_SCORED}, {_sweep()}, f AS (SELECT score, {_F1} AS f1 FROM w) SELECT max(score) AS threshold, round(arg_max(f1, score), 6) AS f1 FROM f WHERE f1 >= (SELECT max(f1) FROM f) - 1e-12",
        "auroc": f"WITH {_SCORED}, {_sweep()} SELECT round({_AUROC}, 6) AS auroc FROM w",
        "average_precision": f"WITH {_SCORED}, {_sweep()} SELECT round({_AP}, 6) AS average_precision FROM w",
        "per_dataset_metrics_with_mean": f"""WITH {_SCORED}, {_sweep('lang')}, {_confusion('lang, ')}, f AS (SELECT lang, score, {_F1} AS f1, max({_F1}) OVER (PARTITION BY lang) AS top FROM w),
b AS (SELECT lang, max(score) AS image_threshold, arg_max(f1, score) AS image_best_f1 FROM f WHERE f1 >= top - 1e-12 GROUP BY lang),
u AS (SELECT lang, {_AUROC} AS image_auroc, {_AP} AS image_average_precision FROM w GROUP BY lang),
n AS (SELECT lang, count(*)::DOUBLE AS num_images, sum((label > 0)::INT)::DOUBLE AS num_anomalous_images FROM s GROUP BY lang),
c2 AS (SELECT lang, tp::DOUBLE AS image_tp, fp::DOUBLE AS image_fp, fn::DOUBLE AS image_fn, tn::DOUBLE AS image_tn, {', '.join(f'{c} AS image_{c}' for c in names[4:])} FROM (SELECT lang, tp, fp, fn, tn, {_CONF} FROM cf)),
a AS (SELECT lang, {', '.join(row)} FROM n JOIN u USING (lang) JOIN b USING (lang) JOIN c2 USING (lang)),
m AS (SELECT * FROM a UNION ALL SELECT 'MEAN', {', '.join(f'avg(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)' for c in row)} FROM a)
SELECT lang, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in row)} FROM m""",
        "per_image_rows": f"WITH {_MAPS} SELECT vec_id, round(list_sum(k) / 64, 6) AS pixel_gt_positive_ratio, round(len(list_filter(m, lambda y: y >= 0.1)) / 64, 6) AS pixel_pred_positive_ratio, round(list_max(m), 6) + 0.0 AS pixel_map_max, round(list_avg(m), 6) + 0.0 AS pixel_map_mean FROM mp",
        "artifact_top_k": f"WITH {_SCORED} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20",
        "phase_timing_pivot": """SELECT user_id AS run, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 6) + 0.0 AS time_fit_s, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 6) + 0.0 AS time_calibration_s,
  round(coalesce(sum(value) FILTER (event_type = 'scroll'), 0), 6) + 0.0 AS time_infer_s, round(coalesce(sum(value) FILTER (event_type = 'purchase'), -1), 6) + 0.0 AS time_total_s FROM events GROUP BY user_id""",
        "resource_aggregates": "SELECT event_type, round(max(value), 6) AS max_ram_mb, round(avg(value), 6) AS mean_ram_mb, round(max(user_id), 6)::DOUBLE AS max_cpu_pct, round(avg(user_id), 6) AS mean_cpu_pct FROM events GROUP BY event_type",
        "run_summary": f"WITH {_RUNS} SELECT experiment, run_dir, strftime(ts, '%Y-%m-%d') AS day, round(image_auroc, 6) AS image_auroc, round(image_ap, 6) AS image_ap, false AS from_mean FROM su",
        "leaderboard_top10": f"WITH {_RUNS}, l AS (SELECT 'image_auroc' AS metric, experiment, run_dir, round(image_auroc, 6) AS value FROM su UNION ALL SELECT 'image_ap', experiment, run_dir, round(image_ap, 6) FROM su) SELECT metric, (row_number() OVER (PARTITION BY metric ORDER BY value DESC, experiment, run_dir))::INTEGER AS rank, experiment, run_dir, value FROM l QUALIFY rank <= 10",
        "fastest_slowest": f"WITH {_RUNS}, l AS (SELECT experiment, run_dir, round(image_auroc, 6) AS value FROM su), a AS (SELECT 'fastest' AS kind, (row_number() OVER (ORDER BY value, experiment, run_dir))::INTEGER AS rank, * FROM l), b AS (SELECT 'slowest' AS kind, (row_number() OVER (ORDER BY value DESC, experiment, run_dir))::INTEGER AS rank, * FROM l) SELECT * FROM a WHERE rank <= 5 UNION ALL SELECT * FROM b WHERE rank <= 5",
        "pricing_summary": "WITH g AS (SELECT l_returnflag, sum(l_quantity)::DOUBLE AS sum_qty, avg(l_extendedprice) AS avg_price, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag), m AS (SELECT * FROM g UNION ALL SELECT 'MEAN', avg(sum_qty), avg(avg_price), avg(n) FROM g) SELECT l_returnflag, round(sum_qty, 4) AS sum_qty, round(avg_price, 4) AS avg_price, round(n, 4) AS n FROM m",
        "order_priority_top": "SELECT o_orderpriority, rank, o_orderkey, o_totalprice FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS rank FROM orders) WHERE rank <= 5",
    }
