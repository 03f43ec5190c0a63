"""DuckDB views that the SQL of the queries is written over."""

from __future__ import annotations

VIEWS = {
    "image_cells": """SELECT l_partkey % 4 AS well_id, l_partkey // 4 AS depth_idx, (l_partkey // 4) * 0.5::DOUBLE AS depth, CAST(l_orderkey % 12 AS INT) AS
      az_idx, MAX(l_quantity) / 5 AS zc FROM lineitem GROUP BY 1, 2, 3, 4""",
    "cells": """SELECT s.well_id, s.depth_idx, s.depth_idx * 0.5::DOUBLE AS depth, s.az_idx, zc FROM (SELECT well_id, depth_idx, unnest(range(12))::INT AS
      az_idx FROM (SELECT well_id, unnest(range(max(depth_idx) + 1)) AS depth_idx FROM image_cells GROUP BY well_id)) s LEFT JOIN image_cells c USING (well_id,
      depth_idx, az_idx)""",
    "pose": """SELECT p_partkey % 4 AS well_id, p_partkey // 4 AS sample_idx, (p_partkey // 4) * 0.5::DOUBLE + 0.2::DOUBLE AS depth, p_size / 5.0::DOUBLE AS
      inc_deg, CAST((p_partkey * 7 + p_size) % 360 AS DOUBLE) AS rb_deg FROM part""",
    "waveforms": """SELECT 0::BIGINT AS well_id, vec_id // 16 AS xsi_idx, CAST((vec_id // 8) % 2 AS INT) + 1 AS receiver, CAST(vec_id % 8 AS INT) AS side,
      (vec_id // 16) * 8.0::DOUBLE + 0.1::DOUBLE * ((vec_id // 8) % 2) AS depth, embedding::DOUBLE[] AS samples FROM embeddings""",
    "event_series": "SELECT user_id AS well_id, event_type AS series_id, event_id AS sample_idx, epoch_us(ts) / 1e6::DOUBLE AS depth, value FROM events",
    # gap-filled cells, padded edges, rolling baseline and the candidate rule
    "filled": """SELECT *, CASE WHEN p IS NULL AND n IS NULL THEN 0 WHEN p IS NULL THEN n.z WHEN n IS NULL THEN p.z WHEN n.d = p.d THEN p.z ELSE p.z + (n.z -
      p.z) * (depth - p.d) / (n.d - p.d) END AS zf FROM (SELECT *, last_value(CASE WHEN zc IS NOT NULL THEN {'d': depth, 'z': zc} END IGNORE NULLS) OVER (w
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first_value(CASE WHEN zc IS NOT NULL THEN {'d': depth, 'z': zc} END IGNORE NULLS) OVER (w ROWS
      BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM cells WINDOW w AS (PARTITION BY well_id, az_idx ORDER BY depth_idx))""",
    "padded": """SELECT well_id, az_idx, depth_idx, zc, zf, 0 AS pad FROM filled UNION ALL SELECT well_id, az_idx, -k, zc, zf, 1 FROM filled, range(1, 11) t(k)
      WHERE depth_idx = 0 UNION ALL SELECT f.well_id, az_idx, depth_idx + k, zc, zf, 1 FROM filled f JOIN (SELECT well_id, max(depth_idx) AS last FROM filled
      GROUP BY 1) m ON f.well_id = m.well_id AND depth_idx = last, range(1, 11) t(k)""",
    "rolled": """SELECT * FROM (SELECT *, quantile_disc(zf, 0.9) OVER w AS zc_base, avg((zc IS NOT NULL)::INT) OVER w AS finite_fraction FROM padded WINDOW w
      AS (PARTITION BY well_id, az_idx ORDER BY depth_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) WHERE pad = 0""",
    "based": """SELECT well_id, depth_idx, depth_idx * 0.5::DOUBLE AS depth, az_idx, zc, zc_base, finite_fraction, zc IS NOT NULL AND zc_base > 0 AND
      finite_fraction >= 0.7 AS baseline_valid, CASE WHEN zc IS NOT NULL AND zc_base > 0 AND finite_fraction >= 0.7 THEN zc / zc_base END AS zc_ratio, CASE
      WHEN zc IS NOT NULL AND zc_base > 0 AND finite_fraction >= 0.7 THEN (zc_base - zc) / zc_base END AS relative_drop FROM rolled""",
    "ruled": """SELECT *, CASE WHEN NOT valid THEN -1 WHEN candidate THEN 1 ELSE 0 END AS presence, CASE WHEN NOT valid THEN -1 WHEN NOT candidate THEN 0 WHEN
      relative_drop >= 0.60 THEN 3 WHEN relative_drop >= 0.45 THEN 2 ELSE 1 END AS severity FROM (SELECT *, baseline_valid AND NOT bad AS valid, baseline_valid
      AND NOT bad AND (by_drop OR by_limit) AS candidate FROM (SELECT *, zc IS NULL OR zc <= 0 OR coalesce(relative_drop > 0.95, false) AS bad,
      coalesce(relative_drop > 0.95, false) AS outlier, coalesce(zc < zc_base * (1 - 0.35::DOUBLE), false) AS by_drop, coalesce(zc < 2.5::DOUBLE, false) AS
      by_limit FROM based))""",
    # pose on image depth: inclination linear, bearing by sine and cosine
    "posed": """SELECT d.well_id, d.depth_idx, d.depth, CASE WHEN a.depth IS NULL OR b.depth IS NULL THEN NULL WHEN b.depth = a.depth THEN a.inc_deg ELSE
      a.inc_deg + (b.inc_deg - a.inc_deg) * (d.depth - a.depth) / (b.depth - a.depth) END AS inc_deg, CASE WHEN a.depth IS NULL OR b.depth IS NULL THEN NULL
      ELSE wrap(degrees(atan2(sin(radians(a.rb_deg)) + (sin(radians(b.rb_deg)) - sin(radians(a.rb_deg))) * f, cos(radians(a.rb_deg)) + (cos(radians(b.rb_deg))
      - cos(radians(a.rb_deg))) * f))) END AS rb_deg FROM (SELECT d.*, a, b, CASE WHEN b.depth = a.depth THEN 0 ELSE (d.depth - a.depth) / (b.depth - a.depth)
      END AS f FROM (SELECT DISTINCT well_id, depth_idx, depth FROM cells) d ASOF LEFT JOIN pose a ON d.well_id = a.well_id AND d.depth >= a.depth ASOF LEFT
      JOIN pose b ON d.well_id = b.well_id AND d.depth <= b.depth) d""",
    "confident": """SELECT *, CASE WHEN valid THEN greatest(0, least(1, CASE WHEN candidate THEN greatest(coalesce(greatest(0, least(1, relative_drop / 0.7)),
      0), 0.25) ELSE coalesce(greatest(0, least(1, relative_drop / 0.7)), 0) * 0.25 END * CASE WHEN baseline_valid THEN finite_fraction ELSE 0 END * orient *
      (rb_deg IS NOT NULL)::INT * CASE WHEN bad THEN 0 WHEN zc IS NULL OR zc < 0 OR zc > 20 THEN 0.5 ELSE 1 END)) ELSE 0 END AS confidence FROM (SELECT r.*,
      inc_deg, rb_deg, CASE WHEN inc_deg IS NULL OR inc_deg <= 1 THEN least(0.05, coalesce(greatest(0, least(1, (inc_deg - 1) / 4.0)), 0)) ELSE greatest(0,
      least(1, (inc_deg - 1) / 4.0)) END AS orient FROM ruled r JOIN posed p USING (well_id, depth_idx))""",
    "labels": "SELECT c.*, convention, ((az_idx + k * round_even(coalesce(rb_deg, 0) / 30.0, 0)::INT) % 12 + 12) % 12 AS az_rot FROM confident c, (VALUES ('plus', 1), ('minus', -1)) t(convention, k)",
    "features_rcv": """SELECT well_id, xsi_idx, receiver, side, depth, sqrt(list_avg(q)) AS rms, list_max(list_transform(samples, lambda x: abs(x))) AS
      peak_abs, list_avg(list_transform(samples, lambda x: abs(x))) AS mean_abs, list_avg(q[1:23]) AS early_energy, list_avg(q[23:64]) AS late_energy,
      list_avg(q[23:64]) / greatest(list_avg(q[1:23]), 1e-12) AS late_ratio FROM (SELECT *, list_transform(samples, lambda x: x * x) AS q FROM waveforms)""",
    "features_side": """SELECT well_id, xsi_idx, side, avg(rms) AS rms, avg(peak_abs) AS peak_abs, avg(mean_abs) AS mean_abs, avg(early_energy) AS
      early_energy, avg(late_energy) AS late_energy, avg(late_ratio) AS late_ratio, quantile_cont(rms, 0.5) AS rms_median FROM features_rcv GROUP BY ALL""",
    "side_of": "SELECT az_idx, arg_min(side, apart(az_idx * 30.0, side * 45.0) * 100 + side) AS side FROM (SELECT DISTINCT az_idx FROM cells), (SELECT unnest(range(8))::INT AS side) GROUP BY az_idx",
    "side_labels": """SELECT well_id, depth_idx, side, convention, max(presence) AS presence, CASE max(presence) WHEN 1 THEN greatest(1, max(CASE WHEN presence
      = 1 THEN severity END)) WHEN 0 THEN 0 ELSE -1 END AS severity, coalesce(CASE WHEN max(presence) = 1 THEN max(CASE WHEN presence = 1 THEN confidence END)
      ELSE max(CASE WHEN presence >= 0 THEN confidence END) END, 0) AS confidence FROM labels l JOIN side_of s ON s.az_idx = l.az_rot GROUP BY well_id,
      depth_idx, side, convention""",
    "axis": "SELECT well_id, xsi_idx, min(depth) AS depth FROM waveforms WHERE receiver = 1 GROUP BY ALL",
    "samples": """SELECT x.well_id, x.xsi_idx, x.depth, x.depth_idx, x.mismatch, coalesce(o.orientation, 0) AS orientation, side, p.presence AS presence_plus,
      p.severity AS severity_plus, p.confidence AS confidence_plus, m.presence AS presence_minus, m.severity AS severity_minus, m.confidence AS
      confidence_minus, p.presence <> m.presence AS disagreement, p.presence >= 0 AND coalesce(o.orientation, 0) >= 0.5 AND (p.presence = 0 OR p.confidence >=
      0.5) AS azimuthal, p.presence >= 0 AS non_azimuthal FROM (SELECT a.well_id, a.xsi_idx, a.depth, CASE WHEN n.depth IS NULL OR a.depth - b.depth <= n.depth
      - a.depth THEN b.depth_idx ELSE n.depth_idx END AS depth_idx, CASE WHEN n.depth IS NULL OR a.depth - b.depth <= n.depth - a.depth THEN abs(a.depth -
      b.depth) ELSE abs(n.depth - a.depth) END AS mismatch FROM axis a ASOF LEFT JOIN (SELECT DISTINCT well_id, depth_idx, depth FROM cells) b ON a.well_id =
      b.well_id AND a.depth >= b.depth ASOF LEFT JOIN (SELECT DISTINCT well_id, depth_idx, depth FROM cells) n ON a.well_id = n.well_id AND a.depth <= n.depth)
      x LEFT JOIN (SELECT a.well_id, a.xsi_idx, CASE WHEN b.depth = n.depth THEN b.c ELSE b.c + (n.c - b.c) * (a.depth - b.depth) / (n.depth - b.depth) END AS
      orientation FROM axis a ASOF LEFT JOIN (SELECT well_id, depth, coalesce(greatest(0, least(1, (inc_deg - 1) / 4.0)), 0) AS c FROM pose) b ON a.well_id =
      b.well_id AND a.depth >= b.depth ASOF LEFT JOIN (SELECT well_id, depth, coalesce(greatest(0, least(1, (inc_deg - 1) / 4.0)), 0) AS c FROM pose) n ON
      a.well_id = n.well_id AND a.depth <= n.depth) o USING (well_id, xsi_idx) JOIN (SELECT * FROM side_labels WHERE convention = 'plus') p USING (well_id,
      depth_idx) JOIN (SELECT * FROM side_labels WHERE convention = 'minus') m USING (well_id, depth_idx, side)""",
    "in_subsets": """SELECT s.*, subset, conv, CASE conv WHEN 'plus' THEN presence_plus ELSE presence_minus END AS presence, CASE conv WHEN 'plus' THEN
      confidence_plus ELSE confidence_minus END AS confidence FROM samples s, (VALUES ('all_known', 'plus'), ('high_confidence', 'plus'), ('low_confidence',
      'plus'), ('plus_minus_disagreement', 'plus'), ('all_known_minus_audit', 'minus'), ('high_confidence_minus_audit', 'minus')) t(subset, conv) WHERE CASE
      subset WHEN 'all_known' THEN presence_plus >= 0 WHEN 'high_confidence' THEN azimuthal AND presence_plus >= 0 WHEN 'low_confidence' THEN non_azimuthal AND
      NOT azimuthal AND presence_plus >= 0 WHEN 'plus_minus_disagreement' THEN disagreement AND presence_plus >= 0 WHEN 'all_known_minus_audit' THEN
      presence_minus >= 0 ELSE azimuthal AND presence_minus >= 0 END""",
    "long_features": """UNPIVOT (SELECT i.subset, i.conv, i.presence, i.confidence, i.severity_plus, f.rms, f.peak_abs, f.mean_abs, f.early_energy,
      f.late_energy, f.late_ratio FROM in_subsets i JOIN features_side f USING (well_id, xsi_idx, side)) ON rms, peak_abs, mean_abs, early_energy, late_energy,
      late_ratio INTO NAME feature VALUE v""",
    "table6": """SELECT s.*, f.rms, f.peak_abs, f.mean_abs, f.early_energy, f.late_energy, f.late_ratio, xsi_idx * 8 + side AS sample_id, mismatch > 0.5 AS
      large_error, greatest(0, least(1, CASE WHEN azimuthal AND NOT mismatch > 0.5 THEN confidence_plus * CASE WHEN disagreement THEN 0.5 ELSE 1 END ELSE 0
      END)) AS weight FROM samples s JOIN features_side f USING (well_id, xsi_idx, side)""",
    "logged": """UNPIVOT (SELECT sample_id, well_id, presence_plus, azimuthal, disagreement, ln(1 + greatest(rms, 0)) AS rms, ln(1 + greatest(peak_abs, 0)) AS
      peak_abs, ln(1 + greatest(late_ratio, 0)) AS late_ratio FROM table6) ON rms, peak_abs, late_ratio INTO NAME feature VALUE x""",
    "scaled": """SELECT *, (c - quantile_cont(c, 0.5) OVER w) / CASE WHEN quantile_cont(c, 0.75) OVER w > quantile_cont(c, 0.25) OVER w THEN quantile_cont(c,
      0.75) OVER w - quantile_cont(c, 0.25) OVER w ELSE 1 END AS s FROM (SELECT *, greatest(least(x, quantile_cont(x, 0.999) OVER w), quantile_cont(x, 0.001)
      OVER w) AS c FROM logged WINDOW w AS (PARTITION BY feature)) WINDOW w AS (PARTITION BY feature)""",
}
_NEEDS = {"cells": ["image_cells"], "filled": ["cells"], "padded": ["filled"], "rolled": ["padded"], "based": ["rolled"], "ruled": ["based"], "posed": ["cells",
    "pose"], "confident": ["ruled", "posed"], "labels": ["confident"], "features_rcv": ["waveforms"], "features_side": ["features_rcv"], "side_of": ["cells"],
    "side_labels": ["labels", "side_of"], "axis": ["waveforms"], "samples": ["axis", "cells", "pose", "side_labels"], "in_subsets": ["samples"],
    "long_features": ["in_subsets", "features_side"], "table6": ["samples", "features_side"], "logged": ["table6"], "scaled": ["logged"]}


def over(body: str, *views: str) -> str:
    """``body`` after the views that it reads."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    text = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    joined = f"WITH {text}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}" if order else body
    return _angles(joined)


def _angles(text: str) -> str:
    """Write wrap(x), apart(a, b) and delta(a, b) out."""
    for name, made in (
        ("wrap", lambda x: f"((({x}) - floor(({x}) / 360.0) * 360.0))"),
        ("apart", lambda a, b: f"abs((({a}) - ({b}) + 180.0) - floor((({a}) - ({b}) + 180.0) / 360.0) * 360.0 - 180.0)"),
        ("delta", lambda a, b: f"((({a}) - ({b}) + 180.0) - floor((({a}) - ({b}) + 180.0) / 360.0) * 360.0 - 180.0)"),
    ):
        while (at := text.find(name + "(")) >= 0:
            depth, args, start = 1, [], at + len(name) + 1
            k = start
            while depth:
                c = text[k]
                depth += (c == "(") - (c == ")")
                if depth == 1 and c == "," or depth == 0:
                    args.append(text[start:k].strip())
                    start = k + 1
                k += 1
            text = text[:at] + made(*args) + text[k:]
    return text
