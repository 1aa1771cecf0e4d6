"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

SAMPLES = """ids AS (SELECT vec_id AS ord, embedding::DOUBLE[] AS e, ['normal','dry','lean','loose','screwdrop'][label % 5 + 1] AS fault,
  ['heavy','med','light'][vec_id % 3 + 1] || '_vel' || ['80','90','100','120'][(vec_id // 3) % 4 + 1] || '_' || ['clean','noiseA','noiseB'][(vec_id // 12) % 3 + 1] || '_' || printf('%04d', vec_id) AS tail,
  ['heavy','med','light'][vec_id % 3 + 1] AS load, ['80','90','100','120'][(vec_id // 3) % 4 + 1] AS vel, CASE WHEN (vec_id // 12) % 3 = 0 THEN 'clean' ELSE 'noise' END AS noise_cls FROM embeddings),
 s AS (SELECT *, CASE WHEN fault = 'normal' THEN 'normal/' || tail ELSE 'abnormal/' || fault || '/' || tail END AS id FROM ids)"""
PADDED = "list_concat(e, list_transform(range(6), lambda i: 0::DOUBLE))"
FEATURES = f"f AS (SELECT ord, c.range::INT AS channel, list_slice({PADDED}, 1 + 10 * c.range, 10 + 10 * c.range) AS vec FROM s, range(7) c)"
LISTS = "f AS (SELECT ord, c.range::INT AS channel, CASE WHEN c.range = 0 THEN list_slice(e, 1, 10) ELSE list_slice(e, 2 + 9 * c.range, 10 + 9 * c.range) END AS vec FROM s, range(7) c)"


def fd_part(spec: str) -> str:
    chosen = {"all": "true", "none": "false"}.get(spec, "noise_cls = 'clean'")
    return f"CASE WHEN fault <> 'normal' THEN 'test_abnormal' WHEN vel <> '100' OR {chosen} THEN 'train' ELSE 'test_normal' END"


FD_SPLIT = f"p AS (SELECT *, {fd_part('clean')} AS part FROM s)"
SCALED = """tr AS (SELECT f.* FROM f JOIN p USING (ord) WHERE part = 'train'), te AS (SELECT f.* FROM f JOIN p USING (ord) WHERE part <> 'train'),
 flat AS (SELECT ord, channel, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM f),
 stats AS (SELECT channel, pos, avg(x) AS mu, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd FROM flat JOIN p USING (ord) WHERE part = 'train' GROUP BY ALL),
 z AS (SELECT ord, channel, list((x - mu) / sd ORDER BY pos) AS vec FROM flat JOIN stats USING (channel, pos) GROUP BY ALL),
 ztr AS (SELECT z.* FROM z JOIN p USING (ord) WHERE part = 'train'), zte AS (SELECT z.* FROM z JOIN p USING (ord) WHERE part <> 'train')"""


def ranked(name: str, left: str, right: str, d: str = "list_distance(a.vec, b.vec)") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY channel, ord ORDER BY dist, train_ord) AS rank FROM (SELECT a.channel, a.ord, b.ord AS train_ord, {d} AS dist FROM {left} a JOIN {right} b USING (channel)))"


COSINE = "1 - list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec))"
RAW = f"""{ranked('own', 'ztr', 'ztr')}, {ranked('hit', 'zte', 'ztr')},
 sc AS (SELECT channel, ord, true AS is_train, avg(dist) AS raw FROM own WHERE rank BETWEEN 2 AND 12 GROUP BY ALL UNION ALL SELECT channel, ord, false, avg(dist) FROM hit WHERE rank <= 11 GROUP BY ALL)"""
QUANTILE = """q AS (SELECT *, sum(is_train::INT) OVER (PARTITION BY channel ORDER BY raw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, sum(is_train::INT) OVER (PARTITION BY channel) AS n FROM sc),
 norm AS (SELECT channel, ord, raw, greatest(least((k + 0.5::DOUBLE) / (n + 1), 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS score FROM q WHERE NOT is_train)"""
ZSCORE = """t AS (SELECT channel, avg(raw) AS mu, stddev_samp(raw) + 1e-12 AS sd FROM sc WHERE is_train GROUP BY ALL),
 zz AS (SELECT channel, ord, raw, (raw - mu) / sd AS z FROM sc JOIN t USING (channel) WHERE NOT is_train),
 norm AS (SELECT channel, ord, raw, (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w) AS score FROM zz WINDOW w AS (PARTITION BY channel))"""
VIEW = "v AS (SELECT 'audio' AS view, unnest([0,1,2]) AS channel, 3 AS nc UNION ALL SELECT 'vibration', unnest([3,4,5,6]), 4 UNION ALL SELECT 'fused', unnest([0,1,2,3,4,5,6]), 7)"
FUSED = f"{VIEW}, fu AS (SELECT view, ord, round(avg(score), 12) AS score FROM norm JOIN v USING (channel) GROUP BY ALL), sd AS (SELECT view, ord, id, (fault <> 'normal')::INT AS y_true, score FROM fu JOIN s USING (ord))"
CURVE = """g AS (SELECT view, score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM sd GROUP BY ALL),
 cum AS (SELECT view, score AS thr, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (PARTITION BY view ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 bend AS (SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS a, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS b FROM cum WINDOW w AS (PARTITION BY view ORDER BY thr DESC)),
 pts AS (SELECT view, thr, tp, fp FROM bend WHERE a IS NULL OR b IS NULL OR a <> 0 OR b <> 0 UNION ALL SELECT DISTINCT view, 'infinity'::DOUBLE, 0, 0 FROM cum),
 roc AS (SELECT view, row_number() OVER (PARTITION BY view ORDER BY thr DESC) AS place, fp / max(fp) OVER (PARTITION BY view) AS fpr, tp / max(tp) OVER (PARTITION BY view) AS tpr, thr FROM pts)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n ".join(parts) + "\n"


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


FD = (SAMPLES, FEATURES, FD_SPLIT, SCALED)
FD_SCORED = (*FD, RAW, QUANTILE, FUSED)
AUROC = f"""g AS (SELECT view, score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM sd GROUP BY ALL),
 w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY view ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
 SELECT view, {r('sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))', 'auroc')}, (sum(pos) + sum(neg))::BIGINT AS n_test, sum(pos)::BIGINT AS n_pos FROM w GROUP BY view"""


def threshold(pick: str) -> str:
    return (
        with_(*FD_SCORED, CURVE, f"th AS ({pick})", "c AS (SELECT view, thr, count_if(y_true = 0 AND score < thr) AS tn, count_if(y_true = 0 AND score >= thr) AS fp, count_if(y_true = 1 AND score < thr) AS fn, count_if(y_true = 1 AND score >= thr) AS tp FROM sd JOIN th USING (view) GROUP BY ALL)")
        + f"SELECT view, {r('thr', 'thr')}, {r('(tp + tn) / (tp + tn + fp + fn)', 'acc')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}, tn, fp, fn, tp FROM c"
    )


def fc_split(base: str = "true", hard: str = "false") -> str:
    return f"""b AS (SELECT * FROM s WHERE vel <> '100' AND {base}),
 conds AS (SELECT DISTINCT load, noise_cls, vel FROM b),
 rk AS (SELECT *, row_number() OVER (PARTITION BY load, noise_cls ORDER BY md5('0|' || load || '|' || noise_cls || '|' || vel), vel) AS place, count(*) OVER (PARTITION BY load, noise_cls) AS n FROM conds),
 p AS (SELECT b.*, CASE WHEN place > floor(n * 0.5) THEN 'test_base' WHEN {hard} THEN 'test_hard' ELSE 'train' END AS part FROM b JOIN rk USING (load, noise_cls, vel)
   UNION ALL SELECT *, 'test_leave' FROM s WHERE vel = '100')"""


FC = (SAMPLES, FEATURES, fc_split(), SCALED, ranked("hit", "zte", "ztr"), "nb AS (SELECT hit.*, s.id AS train_id, s.fault AS train_label FROM hit JOIN s ON s.ord = train_ord WHERE rank <= 11)")


def probs(weight: str) -> str:
    return f"vt AS (SELECT channel, ord, train_label, sum({weight}) AS w FROM nb GROUP BY ALL), pr AS (SELECT channel, ord, train_label, w / sum(w) OVER (PARTITION BY channel, ord) AS p FROM vt)"


WEIGHTED = probs("1 / (dist + 1e-12::DOUBLE)")
PREDS = f"""{VIEW}, vp AS (SELECT view, ord, train_label AS label, round(sum(p) / max(nc), 12) AS p FROM pr JOIN v USING (channel) GROUP BY ALL),
 best AS (SELECT *, row_number() OVER (PARTITION BY view, ord ORDER BY p DESC, label) AS k FROM vp),
 pd AS (SELECT view, ord, s.id, s.fault AS y_true, label AS y_pred, p FROM best JOIN s USING (ord) WHERE k = 1)"""
CM = "cl AS (SELECT DISTINCT fault AS label FROM p WHERE part = 'train'), grid AS (SELECT v.view, t.label AS y_true, q.label AS y_pred FROM (SELECT DISTINCT view FROM pd) v, cl t, cl q), cm AS (SELECT grid.*, count(pd.ord) AS n FROM grid LEFT JOIN pd USING (view, y_true, y_pred) GROUP BY ALL)"
REPORT = "rp AS (SELECT a.view, a.label, support, predicted, tp FROM (SELECT view, y_true AS label, sum(n) AS support, sum(n) FILTER (y_true = y_pred) AS tp FROM cm GROUP BY ALL) a JOIN (SELECT view, y_pred AS label, sum(n) AS predicted FROM cm GROUP BY ALL) b USING (view, label)), sc2 AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM rp)"
INSPECT = "ins AS (SELECT 'fused' AS inspect_view, 'wrong' AS inspect_mode, pd.id AS test_id, y_true AS test_label, y_true AS test_true, y_pred AS test_pred, channel, rank, dist, train_id, train_label FROM pd JOIN nb USING (ord) WHERE view = 'fused' AND y_true <> y_pred AND y_true IN ('dry', 'lean') AND rank <= 3)"
SERIES = "e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS x FROM events)"
PARSED = "SELECT id, lower(regexp_extract(id, '{load}', 1)) AS load, regexp_extract(id, '(?i)vel([0-9]+)', 1) AS vel, coalesce(nullif(lower(regexp_extract(id, '{noise}', 1)), ''), 'clean') AS noise FROM (SELECT id FROM s UNION ALL SELECT url FROM pages)"
MATCHED = """two AS (SELECT ord, id, e, 1 AS f FROM s UNION ALL SELECT ord + 1000000, id, e, -1 FROM s WHERE load = 'heavy'),
 last_ AS (SELECT two.* FROM two JOIN (SELECT id, max(ord) AS ord FROM two GROUP BY id) USING (id, ord)),
 lst AS (SELECT ord * 3 AS ord, id FROM s UNION ALL SELECT ord * 3 + 1, id FROM s WHERE vel = '80' UNION ALL SELECT ord * 3 + 2, 'gone/' || id FROM s)"""
WINDOWS = "t AS (SELECT *, count(*) OVER (PARTITION BY key) AS t FROM e), w AS (SELECT key, pos // 8 AS win, x FROM t WHERE pos < t // 8 * 8 UNION ALL SELECT key, t // 8, x FROM t WHERE t % 8 > 0 AND pos >= greatest(t - 8, 0))"
# Two phases of three samples: a Hann-windowed sinc of six zero crossings at .99 of the lower rate, so ten samples look back.
RESAMPLED = """made AS (SELECT key, unnest(range((2 * (max(pos) + 1) + 2) // 3)) AS pos FROM e GROUP BY key),
 near AS (SELECT m.key, m.pos, e.x, greatest(least(((e.pos - m.pos // 2 * 3) / 3::DOUBLE - (m.pos % 2) / 2::DOUBLE) * 1.98, 6), -6) AS t FROM made m JOIN e ON e.key = m.key AND e.pos BETWEEN m.pos // 2 * 3 - 10 AND m.pos // 2 * 3 + 12),
 taps AS (SELECT key, pos, x, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t) / (pi() * t) END * cos(t * pi() / 12) ** 2 * 1.98 / 3 AS w FROM near)"""
CLASSES = ("dry", "lean", "loose", "normal", "screwdrop")
TREE = "full_ AS (SELECT *, regexp_extract(id, '^(.*)_([0-9]+)$', 1) AS folder, regexp_extract(id, '^(.*)_([0-9]+)$', 2) AS i FROM s)"
PARTS = "parts AS (SELECT id, list_filter(string_split(id, '/'), lambda x: x <> '' AND x <> '.') AS q, starts_with(id, '/') AS root FROM (SELECT '/data//./' || id AS id FROM s UNION ALL SELECT url FROM pages)), full_ AS (SELECT id, CASE WHEN root THEN list_prepend('/', q) ELSE q END AS q FROM parts), low AS (SELECT *, list_transform(q, lambda x: lower(x)) AS l FROM full_), pos AS (SELECT *, coalesce(list_position(l, 'abnormal'), 0) AS a, coalesce(list_position(l, 'normal'), 0) AS n FROM low)"


def parsed(load: str, noise: str) -> str:
    return with_(SAMPLES, f"x AS ({PARSED.format(load=load, noise=noise)})") + "SELECT *, CASE WHEN starts_with(noise, 'noise') THEN 'noise' ELSE 'clean' END AS noise_cls FROM x"


def split_fd(spec: str) -> str:
    return with_(SAMPLES) + f"SELECT id, {fd_part(spec)} AS part FROM s"


def split_fc(**options: str) -> str:
    return with_(SAMPLES, fc_split(**options)) + "SELECT id, part FROM p"


def combined(select: str) -> str:
    return with_(SAMPLES, FEATURES) + select


def oracle_sql() -> dict[str, str]:
    listed = with_(SAMPLES, LISTS) + f"SELECT ord, channel, len(vec)::INT AS dim, {r('list_sum(vec)', 'total')} FROM f"
    counts, areas = AUROC.rsplit("\n SELECT", 1)
    unnested = "SELECT ord, generate_subscripts(vec, 1) - 1 AS pos, round(unnest(vec), 6) + 0.0 AS x FROM"
    knn = lambda n, low, high, shift: f"SELECT channel, ord, rank - {shift} AS rank, train_ord, {r('dist', 'dist')} FROM {n} WHERE rank BETWEEN {low} AND {high}"
    return {
        "parse_ids_fd": parsed("(?i)/(heavy|med|light)_vel", r"(?i)_(clean|noise\w*)"),
        "parse_ids_fc": parsed("(?i)/(heavy|med|light)[-_]vel", "(?i)[_/](clean|noise[^_/]*)"),
        "fault_condition_from_path": with_(SAMPLES, PARTS) + "SELECT id, CASE WHEN a > 0 THEN l[a + 1] WHEN n > 0 THEN 'normal' END AS fault, CASE WHEN a > 0 THEN q[a + 2] WHEN n > 0 THEN coalesce(q[n + 1], 'normal') WHEN len(q) >= 2 THEN q[len(q) - 1] END AS condition FROM pos",
        "id_suffix_normalize": "SELECT page_id, array_to_string(list_slice(string_split(url, '/'), greatest(len(string_split(url, '/')) - 2, 1), len(string_split(url, '/'))), '/') AS suffix FROM pages",
        "index_build": with_(SAMPLES, TREE) + "SELECT id, CASE WHEN fault = 'normal' THEN 'Normal' ELSE 'Anomalous' END AS split, (fault <> 'normal')::BIGINT AS label, 100000 AS vibration_sr, '[\"' || array_to_string(list_transform(['audio.wav','ios.mp4','android.mp4','vibration.csv::col=1','vibration.csv::col=2','vibration.csv::col=3','vibration.csv::col=4'], lambda x: '/data/' || folder || '/' || split_part(x, '.', 1) || '/' || split_part(x, '.', 1) || '_part_' || i || '.' || split_part(x, '.', 2)), '\",\"') || '\"]' AS paths FROM full_",
        "index_paths_decode": with_(SAMPLES, TREE, "m AS (SELECT * FROM (VALUES (0, 'audio', 'wav', NULL), (1, 'ios', 'mp4', NULL), (2, 'android', 'mp4', NULL), (3, 'vibration', 'csv', 1), (4, 'vibration', 'csv', 2), (5, 'vibration', 'csv', 3), (6, 'vibration', 'csv', 4)) t(channel, k, kind, col))") + "SELECT id, channel, '/data/' || folder || '/' || k || '/' || k || '_part_' || i || '.' || kind AS path, col, '.' || kind AS ext FROM full_, m",
        "channel_blocks_concat": with_(SAMPLES, FEATURES) + f"SELECT ord, channel, len(vec)::INT AS dim, {r('list_sum(vec)', 'total')} FROM f",
        "channel_dims_check": with_(SAMPLES, LISTS) + "SELECT channel, count(*) AS n, min(len(vec))::INT AS min_dim, max(len(vec))::INT AS max_dim FROM f GROUP BY channel",
        "split_fd_all": split_fd("all"),
        "split_fd_none": split_fd("none"),
        "split_fd_subset": split_fd("clean"),
        "split_fd_missing_combos": with_(SAMPLES) + "SELECT load, noise_cls FROM (SELECT unnest(['heavy','med','light']) AS load), (SELECT unnest(['clean','noise']) AS noise_cls) EXCEPT SELECT load, noise_cls FROM s WHERE fault = 'normal' AND vel = '110'",
        "split_fd_counts": with_(SAMPLES, FD_SPLIT, "c AS (SELECT CASE WHEN part = 'train' THEN 'train' ELSE 'test' END AS side, *, fault = 'normal' AS normal FROM p)") + "SELECT side, count(DISTINCT (normal, load, vel, noise_cls)) AS n_combos, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT id) FILTER (normal) AS n_normal, count(DISTINCT id) FILTER (NOT normal) AS n_abnormal, count(*) FILTER (normal AND vel = '100') AS n_held_normal FROM c GROUP BY side",
        "split_fc_base": split_fc(),
        "split_fc_exclude_noise": split_fc(base="noise_cls = 'clean'"),
        "split_fc_exclude_load": split_fc(base="load <> 'heavy'"),
        "split_fc_hard": split_fc(hard="fault IN ('dry', 'lean') AND vel IN ('80', '90')"),
        "split_fc_dist": with_(SAMPLES, fc_split()) + "SELECT CASE WHEN part = 'train' THEN 'train' ELSE 'test' END AS side, fault AS label, vel, load, noise_cls, count(*) AS n FROM p GROUP BY ALL",
        "split_fc_meta_counts": with_(SAMPLES, fc_split()) + "SELECT part, count(*) AS n_samples, count(DISTINCT (vel, load, noise_cls)) AS n_conditions FROM p GROUP BY ALL",
        "scaler_stats": with_(*FD) + f"SELECT channel, pos::INT AS pos, {r('mu', 'mu')}, {r('sd', 'sd')} FROM stats",
        "standardized_features": with_(*FD) + f"SELECT ord, channel, pos::INT AS pos, {r('(x - mu) / sd', 'x')} FROM flat JOIN stats USING (channel, pos) JOIN p USING (ord) WHERE part <> 'train'",
        "knn_l2": with_(*FD, ranked("hit", "te", "tr")) + knn("hit", 1, 11, 0),
        "knn_cosine": with_(*FD, ranked("hit", "te", "tr", COSINE)) + knn("hit", 1, 11, 0),
        "knn_pruned_l2": with_(*FD, ranked("hit", "te", "tr")) + knn("hit", 1, 11, 0),
        "knn_pruned_cosine": with_(*FD, ranked("hit", "te", "tr", COSINE)) + knn("hit", 1, 11, 0),
        "knn_pruned_self_excluded": with_(*FD, ranked("hit", "tr", "tr")) + knn("hit", 2, 12, 1),
        "knn_self_excluded": with_(*FD, ranked("hit", "tr", "tr")) + knn("hit", 2, 12, 1),
        "fd_channel_scores_quantile": with_(*FD, RAW, QUANTILE) + f"SELECT channel, ord, {r('raw', 'raw')}, {r('score', 'score')} FROM norm",
        "fd_channel_scores_zscore": with_(*FD, RAW, ZSCORE) + f"SELECT channel, ord, {r('raw', 'raw')}, {r('score', 'score')} FROM norm",
        "fd_fused_scores": with_(*FD_SCORED) + f"SELECT view, id, y_true, {r('score', 'score')} FROM sd",
        "fd_per_channel_pivot": with_(*FD, RAW, QUANTILE) + "SELECT ord, " + ", ".join(r(f"max(score) FILTER (channel = {c + 2})", f"ch{c}") for c in range(1, 5)) + f", {r('round(avg(score), 12)', 'score_mean')} FROM norm WHERE channel >= 3 GROUP BY ord",
        "fd_auroc_views": with_(*FD_SCORED) + ", " + AUROC,
        "fd_auroc_views_lists": with_(SAMPLES, LISTS, FD_SPLIT, SCALED, RAW, QUANTILE, FUSED) + ", " + AUROC,
        "fd_roc_curve": with_(*FD_SCORED, CURVE) + f"SELECT view, place, {r('fpr', 'fpr')}, {r('tpr', 'tpr')}, CASE WHEN thr < 'infinity'::DOUBLE THEN round(thr, 6) + 0.0 END AS thr FROM roc",
        "fd_threshold_youden": threshold("SELECT view, thr FROM (SELECT *, row_number() OVER (PARTITION BY view ORDER BY tpr - fpr DESC, place) AS k FROM roc) WHERE k = 1"),
        "fd_threshold_fpr_at": threshold("SELECT view, thr FROM (SELECT *, row_number() OVER (PARTITION BY view ORDER BY fpr <= 0.1 DESC, CASE WHEN fpr <= 0.1 THEN place ELSE -place END DESC) AS k FROM roc) WHERE k = 1"),
        "fd_threshold_percentile": threshold("SELECT view, quantile_cont(score, 0.5) AS thr FROM sd GROUP BY view"),
        "fd_threshold_score": threshold("SELECT DISTINCT view, 0.6::DOUBLE AS thr FROM sd"),
        "fc_probs_hard": with_(*FC, probs("1::DOUBLE")) + f"SELECT channel, ord, train_label, {r('p', 'p')} FROM pr",
        "fc_probs_weighted": with_(*FC, WEIGHTED) + f"SELECT channel, ord, train_label, {r('p', 'p')} FROM pr",
        "fc_preds_views": with_(*FC, WEIGHTED, PREDS) + f"SELECT view, pd.id, tail AS condition, y_true, y_pred, {r('p', 'p')} FROM pd JOIN s USING (ord)",
        "fc_confusion": with_(*FC, WEIGHTED, PREDS, CM) + "SELECT view, y_true, y_pred, n FROM cm",
        "fc_metrics_views": with_(*FC, WEIGHTED, PREDS, CM, REPORT) + f"SELECT view, {r('sum(tp) / sum(support)', 'raw_acc')}, {r('avg(recall) FILTER (support > 0)', 'balanced_acc')}, {r('avg(f1) FILTER (support > 0 OR predicted > 0)', 'macro_f1')}, sum(support)::BIGINT AS n_test_eval FROM sc2 GROUP BY view",
        "fc_per_class_f1": with_(*FC, WEIGHTED, PREDS, CM, REPORT) + f"SELECT view, label, support::BIGINT AS support, predicted::BIGINT AS predicted, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')} FROM sc2",
        "fc_unseen_samples": with_(SAMPLES, fc_split()) + "SELECT id, 'UNSEEN:' || fault || '/' || vel AS y_true FROM p WHERE part <> 'train' AND fault || '/' || vel NOT IN (SELECT fault || '/' || vel FROM p WHERE part = 'train')",
        "fc_inspect_neighbors": with_(*FC, WEIGHTED, PREDS, INSPECT) + f"SELECT inspect_view, inspect_mode, test_id, test_label, test_true, test_pred, channel, rank, {r('dist', 'distance')}, train_id, train_label FROM ins",
        "fc_hit_counts": with_(*FC, WEIGHTED, PREDS, INSPECT) + "SELECT train_id, train_label, count(*) AS hit_count FROM ins GROUP BY ALL",
        "signal_dc_removed": with_(SERIES) + f"SELECT key, pos, {r('x - avg(x) OVER (PARTITION BY key)', 'x', 10)} FROM e",
        "signal_window_pool": with_(SERIES, "t AS (SELECT *, count(*) OVER (PARTITION BY key) AS t FROM e)", "w AS (SELECT key, pos // 8 AS win, x FROM t WHERE pos < t // 8 * 8 UNION ALL SELECT key, t // 8, x FROM t WHERE t % 8 > 0 AND pos >= greatest(t - 8, 0))") + f"SELECT key, win, count(*) AS n, {r('avg(x)', 'mean')}, {r('sqrt(avg(x * x))', 'rms')} FROM w GROUP BY ALL",
        "signal_framed": with_(SERIES, "t AS (SELECT *, max(pos) OVER (PARTITION BY key) AS top FROM e)") + "SELECT key, f.range AS frame, (pos - 4 * f.range)::INT AS at, round(x, 6) + 0.0 AS x FROM t, range(100000) f WHERE f.range BETWEEN (pos - 5 + 3) // 4 AND pos // 4 AND pos >= 4 * f.range AND pos < 4 * f.range + 6 AND 4 * f.range + 5 <= top",
        "signal_resampled": with_(SERIES, RESAMPLED) + "SELECT key, pos, round(sum(x * w), 6) + 0.0 AS x FROM taps GROUP BY key, pos",
        "multichannel_concatenate": combined(f"{unnested} (SELECT ord, {PADDED} AS vec FROM s)"),
        "multichannel_average": combined("SELECT ord, pos, round(avg(x), 6) + 0.0 AS x FROM (SELECT ord, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x FROM f) GROUP BY ALL"),
        "multichannel_first": combined(f"{unnested} (SELECT ord, vec FROM f WHERE channel = 0)"),
        "multichannel_last": combined(f"{unnested} (SELECT ord, vec FROM f WHERE channel = 6)"),
        "encoder_host": with_(SERIES, WINDOWS, "m AS (SELECT key, win, avg(x) AS a, sqrt(avg(x * x)) AS b, max(x) AS c, min(x) AS d FROM w GROUP BY ALL)", "g AS (SELECT key, [avg(a), avg(b), avg(c), avg(d)] AS v FROM m GROUP BY key)") + "SELECT key, unnest([0, 1, 2, 3])::INT AS pos, round(unnest(v), 6) + 0.0 AS x, NULL::VARCHAR AS error FROM g",
        "ids_match": with_(SAMPLES, MATCHED) + f"SELECT lst.ord, lst.id, last_.ord AS source_ord, c.range::INT AS channel, {r(f'f * list_sum(list_slice({PADDED}, 1 + 10 * c.range, 10 + 10 * c.range))', 'total')} FROM lst JOIN last_ USING (id), range(7) c",
        "ids_missing": with_(SAMPLES, MATCHED) + "SELECT ord, id FROM lst WHERE id NOT IN (SELECT id FROM s)",
        "ids_missing_report": with_(SAMPLES, MATCHED) + "SELECT count(*) AS n_missing, array_to_string(list_slice(list(id ORDER BY ord), 1, 5), ',') AS first_ids FROM lst WHERE id NOT IN (SELECT id FROM s)",
        "labels_dropped": with_(SAMPLES, PARTS.replace("'/data//./' || id", "id")) + "SELECT count(*) FILTER (CASE WHEN a > 0 THEN l[a + 1] WHEN n > 0 THEN 'normal' END IS NULL) AS n_dropped FROM pos",
        "channels_of_columns": listed,
        "channels_of_cells": listed,
        "monotone_events": with_(SERIES, "d AS (SELECT key, x - lag(x) OVER (PARTITION BY key ORDER BY pos) AS d FROM e)") + "SELECT key, coalesce(min(d) >= 0, true) OR coalesce(max(d) <= 0, true) AS monotone FROM d GROUP BY key",
        "first_events": "SELECT event_id AS ord, event_type FROM events ORDER BY event_id LIMIT 100",
        "channel_defaults": "SELECT page_id, c.range::INT AS channel, '/d/' || (page_id % 7) || '/' || CASE WHEN c.range < 3 THEN 'audio/s' || page_id || '_' || ['recorder', 'ios', 'android'][c.range + 1] || '.wav' ELSE 'vibration/s' || page_id || '_vibration.csv::col=' || (c.range - 2) END AS path FROM pages, range(7) c",
        "fd_compare_views": with_(*FD_SCORED) + f", {counts}, au AS (SELECT{areas}) " + "SELECT au.view, auroc AS \"AUROC\", (SELECT count(*) FROM p WHERE part = 'train') AS \"N_train_norm\", n_test AS \"N_test\", n_pos AS \"N_test_pos\", 'l2' AS metric, 'quantile' AS fusion_norm, true AS standardize, 11 AS knn_k, CASE au.view WHEN 'audio' THEN 3 WHEN 'vibration' THEN 4 ELSE 7 END AS num_channels_used, false AS per_channel FROM au",
        "fc_compare_views": with_(*FC, WEIGHTED, PREDS, CM, REPORT, "nt AS (SELECT count(*) AS n FROM p WHERE part = 'train')") + f"SELECT view, {r('sum(tp) / sum(support)', 'raw_acc')}, {r('avg(recall) FILTER (support > 0)', 'balanced_acc')}, {r('avg(f1) FILTER (support > 0 OR predicted > 0)', 'macro_f1')}, max(nt.n) AS \"N_train\", sum(support)::BIGINT AS \"N_test_eval\", 11 AS knn_k, 'l2' AS metric, 'weighted' AS vote, true AS standardize, false AS per_channel, " + ", ".join(r(f"max(f1) FILTER (label = '{c}')", f'"F1_{c}"') for c in CLASSES) + " FROM sc2, nt GROUP BY view",
        "fc_class_probabilities": with_(*FC, WEIGHTED, PREDS) + "SELECT view, ord, max(y_pred) AS y_pred, " + ", ".join(r(f"coalesce(max(vp.p) FILTER (label = '{c}'), 0)", f"p_{c}") for c in CLASSES) + " FROM vp JOIN pd USING (view, ord) GROUP BY ALL",
        "fc_confusion_matrix": with_(*FC, WEIGHTED, PREDS, CM) + "SELECT view, 'true_' || y_true AS \"true\", " + ", ".join(f"coalesce(sum(n) FILTER (y_pred = '{c}'), 0)::BIGINT AS pred_{c}" for c in CLASSES) + " FROM cm GROUP BY ALL",
        "split_fc_meta": with_(SAMPLES, fc_split(hard="fault IN ('dry', 'lean') AND vel IN ('80', '90')")) + """SELECT 'combo_condition_balanced_fc' AS split_name, '100' AS leave_vel, 0 AS seed, 'fault_classification' AS task, 'condition_level' AS partition_level, '(vel, load, noise_cls)' AS condition_def, 0.5::DOUBLE AS train_frac_per_stratum, false AS exclude_noise_from_base, '' AS exclude_load_from_base, 'dry,lean' AS hard_labels, '80,90' AS hard_vels,
  count(*) FILTER (part = 'test_hard') AS "N_extra_test_from_base_train_moved", count(*) FILTER (part = 'train') AS "N_train", count(*) FILTER (part <> 'train') AS "N_test",
  count(DISTINCT (vel, load, noise_cls)) FILTER (part = 'train') AS "N_train_conditions", count(DISTINCT (vel, load, noise_cls)) FILTER (part <> 'train') AS "N_test_conditions",
  array_to_string(list_sort(list_distinct(list(fault) FILTER (part = 'train'))), ',') AS train_labels, array_to_string(list_sort(list_distinct(list(fault) FILTER (part <> 'train'))), ',') AS test_labels, array_to_string(list_sort(list_distinct(list(fault))), ',') AS all_labels FROM p""",
        "score_arrivals": with_(*FD_SCORED) + f"SELECT view, ord, {r('score', 'score')} FROM fu",
        "score_arrivals_grown": with_(SAMPLES, FEATURES, FD_SPLIT, SCALED.replace("WHERE part = 'train' GROUP BY ALL)", "WHERE part = 'train' AND vel IN ('80', '90') GROUP BY ALL)"), RAW, QUANTILE, FUSED) + f"SELECT view, ord, {r('score', 'score')} FROM fu",
        "stored_ranks": "SELECT c_custkey, count(*) FILTER (s_acctbal <= c_acctbal) AS n_upto, count(*) AS n_stored FROM customer JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey",
        "scaler_drift": with_(SAMPLES, FEATURES, FD_SPLIT, "flat AS (SELECT channel, vel, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM f JOIN p USING (ord) WHERE part = 'train')", "m AS (SELECT channel, pos, avg(x) AS mu, stddev_pop(x) AS sd, avg(x) FILTER (vel IN ('80', '90')) AS mu0, stddev_pop(x) FILTER (vel IN ('80', '90')) AS sd0 FROM flat GROUP BY ALL)", "n AS (SELECT channel, mu, mu0, CASE WHEN sd > 0 THEN sd ELSE 1 END AS sd, CASE WHEN sd0 > 0 THEN sd0 ELSE 1 END AS sd0 FROM m)") + f"SELECT channel, {r('max(abs(mu - mu0) / sd0)', 'shift')}, {r('max(greatest(sd / sd0, sd0 / sd))', 'stretch')} FROM n GROUP BY channel",
        "views": with_(SAMPLES, FEATURES, "v AS (SELECT 'audio' AS view, unnest([0,1,2]) AS channel, unnest([1,2,3]) AS place, 3 AS n_channels UNION ALL SELECT 'vibration', unnest([3,4,5,6]), unnest([1,2,3,4]), 4 UNION ALL SELECT 'fused', unnest([0,1,2,3,4,5,6]), unnest([1,2,3,4,5,6,7]), 7)") + f"SELECT view, channel, place, n_channels, count(*) AS n_vectors, {r('avg(list_sum(vec))', 'mean_total')} FROM v JOIN f USING (channel) GROUP BY ALL",
    }
