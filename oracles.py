"""DuckDB SQL for every query whose result SQL can express, written independently of the engine.

The statements are assembled from shared CTEs: machine logs, survival table, features, curves.
"""

from __future__ import annotations

import re

ORACLES: dict[str, str] = {}

# Report texts the results must hold.
BAND_RECOMMENDATIONS = (
    (30, ("🔴 ARRÊT IMMÉDIAT recommandé", "🔧 Intervention maintenance urgente nécessaire",
          "📞 Contacter le responsable maintenance")),
    (60, ("🟠 Planifier maintenance sous 7 jours", "🔍 Vérifier capteurs vibration et pression",
          "📊 Analyser historique des erreurs")),
    (None, ("🟢 Maintenance préventive standard", "👁️ Surveillance continue recommandée", "📈 Vérifier dans 30 jours")),
)
STRATEGIC_RECOMMENDATIONS = (
    "Déployer le système d'alertes sur l'ensemble du parc critique",
    "Former les équipes maintenance à l'utilisation des prédictions RUL",
    "Réallouer 15% du budget maintenance curative vers la maintenance prédictive",
    "Mettre en place un tableau de bord temps réel pour le suivi des KPIs",
    "Étendre l'analyse prédictive aux nouveaux modèles de machines",
)
HIGH_ROI_RECOMMENDATION = "Augmenter l'investissement ML de 20% pour étendre la couverture"
STANDING_INSTRUCTIONS = (
    "Mettre à jour le stock de pièces détachées basé sur le calendrier",
    "Documenter toutes les interventions pour amélioration des modèles",
)
EXECUTIVE_PROMPT = """Génère un rapport exécutif en français pour la direction.

CONTEXTE:
{context}

DONNÉES:
- Machines analysées: {total_machines}
- Machines critiques: {critical_machines}
- Santé moyenne: {avg_health}/100
- ROI estimé: {roi_percent}%

STRUCTURE DEMANDÉE:
1. Titre percutant
2. Résumé exécutif (3-4 lignes max)
3. Points clés (chiffrés)
4. Risques principaux
5. Recommandations stratégiques
6. Impact financier

Ton: Professionnel, concis, orienté décision."""


def dbl(value) -> str:
    return f"CAST({value} AS DOUBLE)"


def even(expression: str, digits: int = 6) -> str:
    return f"(round_even(CAST(({expression}) AS DOUBLE) * 1e{digits}, 0) / 1e{digits})"


def cols(names: str, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(f"{even(prefix + n.strip(), digits)} AS {n.strip()}" for n in names.split(","))


def shown(expression: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', {even(expression, digits)})"


def whole(expression: str) -> str:
    return f"format('{{:,}}', CAST({even(expression, 0)} AS BIGINT))"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CTES = {
    "ev": "SELECT *, make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) * 4) AS dt FROM events",
    "machines": "SELECT c_custkey AS machineID, 'model' || CAST(1 + c_nationkey % 4 AS VARCHAR) AS model, "
                "CAST((c_custkey * 7) % 21 AS INT) AS age FROM customer",
    "telemetry": "SELECT dt AS datetime, user_id AS machineID, 150 + value / 5 AS volt, "
                 "CAST(430 + event_id % 40 AS DOUBLE) AS rotate, 90 + CAST(event_id % 41 AS DOUBLE) / 2 AS pressure, "
                 "35 + value / 10 AS vibration FROM ev",
    "errors": "SELECT dt AS datetime, user_id AS machineID FROM ev WHERE event_type IN ('error', 'click')",
    "maint": "SELECT dt AS datetime, user_id AS machineID FROM ev WHERE event_type = 'purchase'",
    "failures": "SELECT dt AS datetime, user_id AS machineID FROM ev WHERE event_type = 'signup' AND value > 90",
    "survival": f"""
        SELECT b.machineID, m.model, m.age,
               (epoch_us(coalesce(f.failed, b.last_time)) - epoch_us(b.start_time)) / {dbl(86400000000)} AS time,
               CASE WHEN f.failed IS NULL THEN 0 ELSE 1 END AS event, b.volt, b.rotate, b.pressure, b.vibration,
               coalesce(e.n, 0) AS error_count, coalesce(x.n, 0) AS maint_count
        FROM (SELECT machineID, min(datetime) AS start_time, max(datetime) AS last_time, avg(volt) AS volt,
                     avg(rotate) AS rotate, avg(pressure) AS pressure, avg(vibration) AS vibration
              FROM telemetry GROUP BY machineID) b
        LEFT JOIN (SELECT machineID, min(datetime) AS failed FROM failures GROUP BY machineID) f USING (machineID)
        LEFT JOIN machines m USING (machineID)
        LEFT JOIN (SELECT machineID, count(*) AS n FROM errors GROUP BY machineID) e USING (machineID)
        LEFT JOIN (SELECT machineID, count(*) AS n FROM maint GROUP BY machineID) x USING (machineID)""",
    "scores": f"""
        SELECT *, greatest({dbl(0)}, 100 - (vibration - 35) * 2) AS vibration_score,
               greatest({dbl(0)}, 100 - abs(pressure - 100) * 2) AS pressure_score,
               greatest({dbl(0)}, {dbl('100 - error_count * 2')}) AS error_score,
               least({dbl('maint_count * 3')}, {dbl(100)}) AS maintenance_score,
               greatest({dbl(0)}, {dbl('100 - age * 5')}) AS age_score FROM survival""",
    "rawhealth": f"""
        SELECT *, least({dbl(100)}, greatest({dbl(0)}, vibration_score * {dbl(0.30)} + pressure_score * {dbl(0.25)}
               + error_score * {dbl(0.20)} + maintenance_score * {dbl(0.15)} + age_score * {dbl(0.10)})) AS raw_health,
               vibration / (age + 1) AS raw_degradation FROM scores""",
    "rated": f"""
        SELECT * EXCLUDE (raw_health, raw_degradation), {even('raw_health', 2)} AS global_health_score,
               {even('raw_degradation', 4)} AS degradation_rate FROM rawhealth""",
    "health": f"""
        SELECT *, {even('(100 - global_health_score) * degradation_rate', 2)} AS risk_factor,
               vibration / pressure AS vibration_pressure_ratio,
               {even('error_count / ' + dbl('maint_count + 1'), 2)} AS error_maintenance_ratio,
               CASE WHEN global_health_score < 30 OR vibration > 45 OR error_count > 40 THEN 'CRITIQUE'
                    WHEN global_health_score < 50 OR vibration > 40 OR error_count > 30 THEN 'ÉLEVÉ'
                    WHEN global_health_score < 70 THEN 'MODÉRÉ' ELSE 'FAIBLE' END AS risk_level,
               CASE model WHEN 'model2' THEN 'A' WHEN 'model1' THEN 'B' ELSE 'C' END AS model_label FROM rated""",
    "grid": """
        SELECT model AS grp, time, sum(event) AS d, count(*) AS m FROM survival
        WHERE model IN (SELECT model FROM survival GROUP BY model HAVING count(*) > 1) GROUP BY model, time""",
    "risk": "SELECT grp, time, d, sum(m) OVER (PARTITION BY grp ORDER BY time DESC) AS n FROM grid",
    "steps": f"""
        SELECT grp, time, n, d, product(1 - d / {dbl('n')}) OVER (PARTITION BY grp ORDER BY time) AS survival,
               sum(CASE WHEN n > d THEN d / {dbl('n * (n - d)')} ELSE 0 END)
                   OVER (PARTITION BY grp ORDER BY time) AS variance FROM risk""",
    "curve": """
        SELECT * FROM steps UNION ALL
        SELECT grp, 0, max(n), 0, 1, 0 FROM steps GROUP BY grp HAVING min(time) > 0""",
    "pooledgrid": "SELECT 'fleet' AS grp, time, sum(event) AS d, count(*) AS m FROM survival GROUP BY time",
    "pooledsteps": f"""
        SELECT grp, time, n, d, product(1 - d / {dbl('n')}) OVER (ORDER BY time) AS survival
        FROM (SELECT *, sum(m) OVER (ORDER BY time DESC) AS n FROM pooledgrid)""",
    "pooled": """
        SELECT * FROM pooledsteps UNION ALL
        SELECT grp, 0, max(n), 0, 1 FROM pooledsteps GROUP BY grp HAVING min(time) > 0""",
    "horizons": """
        SELECT grp, max_by(survival, time) FILTER (time <= 30) AS survival_at_30,
               max_by(survival, time) FILTER (time <= 90) AS survival_at_90,
               max_by(survival, time) FILTER (time <= 180) AS survival_at_180 FROM curve GROUP BY grp""",
    "rul": f"""
        SELECT {even('min(time) FILTER (survival <= 0.5 + 1e-12)', 1)} AS rul_median,
               {even('max_by(survival, time) FILTER (time <= 30)', 3)} AS survival_30d,
               {even('max_by(survival, time) FILTER (time <= 90)', 3)} AS survival_90d FROM pooled""",
    "factors": f"""
        SELECT *, greatest(0, least(1, (100 - global_health_score) / 100)) AS health_risk,
               least(1, degradation_rate / 10) AS degradation_risk, least(1, age / {dbl(20)}) AS age_risk,
               least(1, error_count / {dbl(50)}) AS error_risk,
               greatest(0, least(1, (100 - global_health_score) / 100)) AS prob
        FROM health WHERE machineID IS NOT NULL AND age IS NOT NULL AND time IS NOT NULL""",
    "scored": f"""
        SELECT *, least(1, health_risk * {dbl(0.4)} + degradation_risk * {dbl(0.3)} + age_risk * {dbl(0.2)}
               + error_risk * {dbl(0.1)}) AS total_risk,
               CASE WHEN time <= 7 THEN 'CRITIQUE' WHEN time <= 14 THEN 'HAUTE' WHEN time <= 30 THEN 'MOYENNE'
                    ELSE 'BASSE' END AS base_level FROM factors""",
    "levels": """
        SELECT *, CASE WHEN prob > 0.8 OR total_risk > 0.8 THEN 'CRITIQUE'
               WHEN prob > 0.6 OR total_risk > 0.6 THEN
                    CASE WHEN base_level IN ('BASSE', 'MOYENNE') THEN 'HAUTE' ELSE base_level END
               WHEN prob > 0.4 AND base_level = 'BASSE' THEN 'MOYENNE' ELSE base_level END AS alert_level FROM scored""",
    "alerts": f"""
        SELECT machineID AS machine_id, coalesce(model, 'Unknown') AS model, alert_level, {even('time', 1)} AS rul_days,
               {even('prob', 3)} AS prob_failure, {even('total_risk', 3)} AS risk_score,
               CASE alert_level WHEN 'CRITIQUE' THEN 'IMMÉDIAT' WHEN 'HAUTE' THEN 'CETTE_SEMAINE' ELSE 'CE_MOIS' END
                   AS recommended_action,
               strftime(make_timestamp(epoch_us(TIMESTAMP '2024-06-01 00:00:00')
                        + CAST(floor((time - 2) * {dbl(86400000000)}) AS BIGINT)), '%Y-%m-%d') AS maintenance_deadline,
               CASE alert_level WHEN 'CRITIQUE' THEN 0 WHEN 'HAUTE' THEN 1 ELSE 2 END AS priority,
               {even('global_health_score', 1)} AS health_score, age, '2024-06-01 00:00:00' AS timestamp
        FROM levels WHERE alert_level <> 'BASSE'""",
    "due": """
        SELECT *, CAST(least(3, floor((rul_days - 2) / 7)) + 1 AS INT) AS week FROM alerts
        WHERE rul_days - 2 > 0 AND rul_days - 2 <= 28""",
    "placed": """
        SELECT *, row_number() OVER (PARTITION BY week ORDER BY priority, prob_failure DESC, machine_id) AS position
        FROM due""",
    "weeks": "SELECT CAST(range AS INT) AS week FROM range(1, 5)",
    "values4": f"""
        SELECT model, count(*) AS machines,
               2 * greatest(0, 500 * CASE model WHEN 'model1' THEN {dbl(4)} WHEN 'model2' THEN {dbl(6)}
                   WHEN 'model3' THEN {dbl(5)} WHEN 'model4' THEN {dbl(3.5)} ELSE {dbl(5)} END + 1500 - 200) AS annual
        FROM survival GROUP BY model""",
    "money": """
        SELECT sum(annual * machines) AS total_fleet_savings, CAST(sum(100 * machines) AS DOUBLE) AS total_ml_investment,
               sum(annual * machines) - sum(100 * machines) AS total_net_benefit, sum(machines) AS fleet_size FROM values4""",
    "fleetmoney": f"""
        SELECT {even('total_fleet_savings', 2)} AS total_fleet_savings, total_ml_investment,
               {even('total_net_benefit', 2)} AS total_net_benefit,
               {even('total_net_benefit / total_ml_investment * 100', 1)} AS total_roi_percent,
               CAST(fleet_size AS BIGINT) AS fleet_size FROM money""",
    "dropouts": """
        SELECT * REPLACE (CASE WHEN age >= 3 THEN vibration END AS vibration,
                          CASE WHEN maint_count >= 10 THEN pressure END AS pressure,
                          CASE WHEN event = 1 THEN volt END AS volt,
                          CASE WHEN age <= 18 THEN error_count END AS error_count) FROM survival""",
    "labels4": """
        SELECT machineID, time, event AS label, (100 - global_health_score) / 100 AS score,
               CASE WHEN (100 - global_health_score) / 100 > CAST(0.27 AS DOUBLE) THEN 1 ELSE 0 END AS prediction,
               90 - 100 * ((100 - global_health_score) / 100) AS expected_life FROM health""",
    "analysis": """
        SELECT h.*, CASE WHEN raw_health < 30 THEN 'CRITIQUE' WHEN raw_health < 50 THEN 'ÉLEVÉ'
                         WHEN raw_health < 70 THEN 'MODÉRÉ' ELSE 'FAIBLE' END AS level, r.*
        FROM rawhealth h, rul r""",
    "advice": """
        SELECT machineID, CASE level
                 WHEN 'CRITIQUE' THEN ['Maintenance immédiate requise', 'Inspection complète des composants',
                                       'Arrêt recommandé si possible']
                 WHEN 'ÉLEVÉ' THEN ['Maintenance sous 7 jours', 'Surveillance renforcée', 'Analyse des causes']
                 WHEN 'MODÉRÉ' THEN ['Maintenance dans 30 jours', 'Monitoring des tendances', 'Contrôle des paramètres']
                 ELSE ['Maintenance à 60 jours', 'Surveillance normale', 'Opérations standards'] END
               || CASE WHEN vibration > 45 THEN ['Vérifier équilibrage'] ELSE [] END
               || CASE WHEN pressure < 95 OR pressure > 105 THEN ['Contrôler régulateur'] ELSE [] END
               || CASE WHEN error_count > 40 THEN ['Analyser logs'] ELSE [] END
               || CASE WHEN rul_median < 30 THEN ['RUL faible - Intervention urgente'] ELSE [] END AS advice,
               CAST(vibration > 45 AS INT) + CAST(pressure < 95 OR pressure > 105 AS INT)
               + CAST(error_count > 40 AS INT) AS anomalies FROM analysis""",
}

# Each CTE with the CTEs it reads, in definition order.
ORDER = list(CTES)

# Whole numbers that DuckDB widens (sums) or narrows (positions) compared with the engine's types.
TYPES = {
    "event_counts": {"error_count": "BIGINT", "maint_count": "BIGINT"},
    "km_curve": {"n_at_risk": "BIGINT", "d": "BIGINT"},
    "km_pooled": {"n_at_risk": "BIGINT", "d": "BIGINT"},
    "km_summary": {"total_events": "BIGINT", "total_observations": "BIGINT"},
    "survival_consistency": {"total_events": "BIGINT"},
    "data_quality_summary": {"columns": "BIGINT"},
    "describe_string": {"count": "BIGINT"},
    "calendar_top5": {"position": "INTEGER"},
    "critical_risks": {"position": "INTEGER"},
    "recommendations": {"position": "INTEGER"},
    "band_recommendations": {"position": "INTEGER"},
    "instructions": {"position": "INTEGER"},
    "maintenance_report": {"minor": "INTEGER"},
    "decision_pack": {"position": "INTEGER"},
    "classification_report": {"support": "BIGINT"},
}


def _needed(sql: str) -> list[str]:
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        body = todo.pop()
        for name in ORDER:
            if name not in wanted and re.search(rf"(\bFROM|\bJOIN|,)\s+{name}\b", body):
                wanted.add(name)
                todo.append(CTES[name])
    return [name for name in ORDER if name in wanted]


def oracle(name: str, sql: str, extra: dict[str, str] | None = None) -> None:
    extra = extra or {}
    chain = [(n, CTES[n]) for n in _needed(" ".join([*extra.values(), sql]))] + list(extra.items())
    ctes = ",\n".join(f"{n} AS ({body})" for n, body in chain)
    if name in TYPES:
        casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in TYPES[name].items())
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql})"
    ORACLES[name] = f"WITH {ctes}\n{sql}" if chain else sql


SURVIVAL_OUT = "machineID, model, age, event, error_count, maint_count, " + cols("time, volt, rotate, pressure, vibration")

# sources
oracle("scan_survival_table", f"SELECT {SURVIVAL_OUT} FROM survival")
oracle("scan_raw_logs", " UNION ALL ".join(
    f"SELECT '{t}' AS log, count(*) AS rows, count(DISTINCT machineID) AS machines, "
    + ("strftime(min(datetime), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(datetime), '%Y-%m-%d %H:%M:%S') AS last"
       if t != "machines" else "NULL AS first, NULL AS last") + f" FROM {t}"
    for t in ("telemetry", "errors", "failures", "maint", "machines")))
oracle("parse_datetime", "SELECT event_id, CASE WHEN event_type = 'view' THEN NULL "
       "ELSE CAST(floor(epoch_us(dt) / 1000000) AS BIGINT) END AS seconds FROM ev")

# cleaning
oracle("normalize_columns", "SELECT machineID, epoch_us(datetime) AS micros, volt, rotate, pressure, vibration FROM telemetry")
oracle("convert_types", """SELECT event_id, value, CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 1000 AS INT) WHEN event_id % 6 = 1 THEN 3
    WHEN event_id % 6 = 2 THEN -7 END AS code FROM events""")
oracle("fill_median", "SELECT machineID, " + ", ".join(
    f"{even(f'coalesce({c}, (SELECT median({dbl(c)}) FROM dropouts))')} AS {c}"
    for c in ("vibration", "pressure", "volt", "rotate", "error_count")) + " FROM dropouts")
oracle("fill_mean", "SELECT machineID, " + ", ".join(
    f"{even(f'coalesce({c}, (SELECT avg({c}) FROM dropouts))')} AS {c}"
    for c in ("vibration", "pressure", "volt", "error_count")) + " FROM dropouts")
oracle("fill_zero", f"SELECT machineID, {even('coalesce(vibration, 0)')} AS vibration, "
       "coalesce(error_count, 0) AS error_count FROM dropouts")
oracle("fill_forward", """
    SELECT machineID, epoch_us(datetime) AS micros,
           coalesce(last_value(vibration IGNORE NULLS) OVER past, first_value(vibration IGNORE NULLS) OVER future) AS vibration,
           coalesce(last_value(volt IGNORE NULLS) OVER past, first_value(volt IGNORE NULLS) OVER future) AS volt
    FROM (SELECT machineID, datetime, CASE WHEN pressure >= 95 THEN vibration END AS vibration,
                 CASE WHEN rotate < 455 THEN volt END AS volt FROM telemetry)
    WINDOW past AS (PARTITION BY machineID ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           future AS (PARTITION BY machineID ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
oracle("model_label", "SELECT machineID, model, CASE model WHEN 'model2' THEN 'A' WHEN 'model1' THEN 'B' ELSE 'C' END "
       "AS model_label FROM machines")

# ETL
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
oracle("telemetry_bounds", f"SELECT machineID, {STAMP.format('min(datetime)')} AS start_time, "
       f"{STAMP.format('max(datetime)')} AS last_telemetry_time FROM telemetry GROUP BY machineID")
oracle("first_failure", f"SELECT machineID, {STAMP.format('min(datetime)')} AS failure_time FROM failures GROUP BY machineID")
oracle("telemetry_means", "SELECT machineID, " + ", ".join(
    f"{even(f'avg({c})')} AS {c}" for c in ("volt", "rotate", "pressure", "vibration")) + " FROM telemetry GROUP BY machineID")
oracle("event_counts", "SELECT machineID, sum(e) AS error_count, sum(m) AS maint_count FROM ("
       "SELECT machineID, 1 AS e, 0 AS m FROM errors UNION ALL SELECT machineID, 0, 1 FROM maint) GROUP BY machineID")
oracle("survival_table", f"SELECT {SURVIVAL_OUT} FROM survival")

# features
oracle("component_scores", "SELECT machineID, " + cols(
    "vibration_score, pressure_score, error_score, maintenance_score, age_score") + " FROM scores")
oracle("global_health", "SELECT machineID, global_health_score FROM health")
oracle("global_health_raw", f"SELECT machineID, {even('raw_health')} AS global_health_score, "
       f"{even('raw_degradation')} AS degradation_rate FROM rawhealth")
oracle("degradation_rate", "SELECT machineID, degradation_rate FROM health")
oracle("risk_factor", "SELECT machineID, risk_factor FROM health")
oracle("interaction_features", "SELECT machineID, " + cols("vibration_pressure_ratio, error_maintenance_ratio") + " FROM health")
oracle("risk_level", "SELECT machineID, risk_level FROM health")
oracle("health_band", "SELECT machineID, CASE WHEN global_health_score < 30 THEN 'Critique' WHEN global_health_score < 60 "
       "THEN 'Élevé' WHEN global_health_score < 80 THEN 'Modéré' ELSE 'Faible' END AS band FROM health")
oracle("health_band_cut", "SELECT machineID, CASE WHEN global_health_score <= 0 OR global_health_score > 100 THEN NULL "
       "WHEN global_health_score <= 30 THEN 'Critique' WHEN global_health_score <= 60 THEN 'Élevé' "
       "WHEN global_health_score <= 80 THEN 'Modéré' ELSE 'Faible' END AS band FROM health")
oracle("risk_from_health", f"SELECT machineID, level AS risk_level, {dbl(0.8)} AS confidence FROM analysis")
ESCALATED = ("CASE WHEN survival_at_30 < 0.3 THEN 'CRITIQUE' WHEN survival_at_30 < 0.6 AND risk_level NOT IN "
             "('CRITIQUE', 'ÉLEVÉ') THEN 'ÉLEVÉ' ELSE risk_level END AS combined_risk")
HORIZON_COLUMNS = "survival_at_30, survival_at_90, survival_at_180"
oracle("enriched_fleet", f"""
    SELECT h.machineID, h.model, h.model_label, h.event, h.risk_level, {ESCALATED},
           {cols('time, global_health_score, degradation_rate, risk_factor, vibration_pressure_ratio, error_maintenance_ratio', prefix='h.')},
           {cols(HORIZON_COLUMNS)}, {even('c.survival')} AS survival_at_time
    FROM health h LEFT JOIN horizons z ON z.grp = h.model LEFT JOIN curve c ON c.grp = h.model AND c.time = h.time""")
oracle("combined_risk", f"SELECT machineID, risk_level, {ESCALATED} FROM health h LEFT JOIN horizons z ON z.grp = h.model")

# survival analysis
oracle("km_curve", f'SELECT grp AS "group", {cols("time, survival")}, n AS n_at_risk, d FROM curve')
oracle("km_pooled", f'SELECT grp AS "group", {cols("time, survival")}, n AS n_at_risk, d FROM pooled')
oracle("km_confidence", f"""
    SELECT grp AS "group", {cols('time, survival')},
           {even('CASE WHEN survival > 0 AND survival < 1 THEN pow(survival, exp(-1.96e0 * sqrt(variance) / ln(survival))) ELSE survival END')} AS lower,
           {even('CASE WHEN survival > 0 AND survival < 1 THEN pow(survival, exp(1.96e0 * sqrt(variance) / ln(survival))) ELSE survival END')} AS upper
    FROM curve""")


def at(h):
    return f"CASE WHEN max(time) >= {h} THEN max_by(survival, time) FILTER (time <= {h}) END"


oracle("km_summary", f"""
    SELECT grp AS "group", {even('min(time) FILTER (survival <= 0.5 + 1e-12)')} AS median_survival_time,
           {even(at(30))} AS survival_at_30, {even(at(90))} AS survival_at_90, {even(at(180))} AS survival_at_180,
           sum(d) AS total_events, max(n) AS total_observations, {even('sum(d) / ' + dbl('max(n)'))} AS event_rate
    FROM curve GROUP BY grp""")
oracle("survival_at_horizons", f"SELECT machineID, {cols(HORIZON_COLUMNS)} FROM survival s LEFT JOIN horizons z ON z.grp = s.model")
oracle("survival_at_time", f"SELECT machineID, {even('c.survival')} AS survival_at_time FROM survival s "
       "LEFT JOIN curve c ON c.grp = s.model AND c.time = s.time")
oracle("survival_as_of", f"""
    SELECT machineID, {even('asked')} AS asked, {even('c.survival')} AS survival_as_of
    FROM (SELECT machineID, model, age * 5.3e0 + time / 7 - 4 AS asked FROM survival) s
    ASOF LEFT JOIN (SELECT grp, {dbl('time')} AS time, survival FROM curve) c ON s.model = c.grp AND s.asked >= c.time""")
oracle("logrank_pairs", f"""
    SELECT a AS group_a, b AS group_b, {even('power(sum(d_a - e), 2) / sum(v)')} AS statistic,
           power(sum(d_a - e), 2) / sum(v) > 3.841458820694124 AS significant
    FROM (SELECT a, b, d_a, n_a * d / n AS e,
                 CASE WHEN n > 1 THEN n_a * (n - n_a) * d * (n - d) / (n * n * (n - 1)) ELSE 0 END AS v
          FROM pairrisk) GROUP BY a, b""", {
    "pairtimes": f"""
        SELECT p.a, p.b, t.time, coalesce(x.d, 0) AS d_a, coalesce(x.m, 0) AS m_a,
               coalesce(x.d, 0) + coalesce(y.d, 0) AS d, coalesce(x.m, 0) + coalesce(y.m, 0) AS m
        FROM (SELECT g1.model AS a, g2.model AS b FROM (SELECT DISTINCT model FROM survival) g1
              JOIN (SELECT DISTINCT model FROM survival) g2 ON g1.model < g2.model) p
        JOIN (SELECT DISTINCT model, time FROM survival) t ON t.model = p.a OR t.model = p.b
        LEFT JOIN lone x ON x.model = p.a AND x.time = t.time LEFT JOIN lone y ON y.model = p.b AND y.time = t.time""",
    "pairrisk": f"""
        SELECT a, b, {dbl('d_a')} AS d_a, {dbl('d')} AS d, {dbl('sum(m_a) OVER w')} AS n_a, {dbl('sum(m) OVER w')} AS n
        FROM (SELECT DISTINCT * FROM pairtimes) WINDOW w AS (PARTITION BY a, b ORDER BY time DESC)"""})
ORACLES["logrank_pairs"] = ORACLES["logrank_pairs"].replace(
    "pairtimes AS (", "lone AS (SELECT model, time, sum(event) AS d, count(*) AS m FROM survival GROUP BY model, time),\npairtimes AS (", 1)
oracle("rul_estimates", f"SELECT machineID, rul_median, survival_30d, survival_90d, {even('time')} AS current_survival_time "
       "FROM survival, rul")

# quality and profile
ALL = ("machineID", "model", "age", "time", "event", "volt", "rotate", "pressure", "vibration", "error_count", "maint_count")
KINDS = dict(machineID="bigint", model="string", age="int", time="double", event="int", volt="double", rotate="double",
             pressure="double", vibration="double", error_count="bigint", maint_count="bigint")


def stacked(names, row) -> str:
    return " UNION ALL ".join(row(n) for n in names)


oracle("missing_values", stacked(ALL, lambda c: f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM dropouts"))
oracle("data_types", stacked(ALL, lambda c: f"SELECT '{c}' AS \"column\", '{KINDS[c]}' AS data_type, count({c}) AS present FROM dropouts"))
IN_TELEMETRY = ("machineID", "volt", "rotate", "pressure", "vibration")
oracle("validate_schema", stacked(ALL, lambda c: (
    f"SELECT '{c}' AS \"column\", true AS \"exists\", count({c}) AS present FROM telemetry" if c in IN_TELEMETRY
    else f"SELECT '{c}' AS \"column\", false AS \"exists\", 0 AS present")))
CONSISTENCY = {"total_events": "sum(event)", "total_censored": "count(*) FILTER (event = 0)",
               "avg_time_failure": "coalesce(avg(time) FILTER (event = 1), 0)",
               "avg_time_censored": "coalesce(avg(time) FILTER (event = 0), 0)"}
oracle("survival_consistency", "SELECT sum(event) AS total_events, count(*) FILTER (event = 0) AS total_censored, "
       + ", ".join(f"{even(CONSISTENCY[n])} AS {n}" for n in ("avg_time_failure", "avg_time_censored")) + " FROM survival")
oracle("validation_report", " UNION ALL ".join(
    [f"SELECT 'rows' AS \"check\", NULL AS \"column\", {dbl('count(*)')} AS value FROM dropouts",
     f"SELECT 'columns', NULL, {dbl(10)}", f"SELECT 'missing_column', 'rotate', {dbl(1)}"]
    + [f"SELECT 'missing_values', '{c}', {dbl(f'count(*) - count({c})')} FROM dropouts" for c in ALL if c != "rotate"]
    + [f"SELECT 'survival_{n}', NULL, {even(e)} FROM dropouts" for n, e in CONSISTENCY.items()]))
oracle("data_quality_summary", "SELECT " + " + ".join(f"count(*) - count({c})" for c in ALL)
       + f" AS total_missing, {len(ALL)} AS columns FROM dropouts")
oracle("describe_numeric", stacked([c for c in ALL if c != "model"], lambda c: (
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {even(f'avg({c})')} AS mean, {even(f'stddev_samp({c})')} AS std, "
    f"{even(f'min({c})')} AS min, {even(f'quantile_cont({dbl(c)}, 0.25)')} AS q25, {even(f'quantile_cont({dbl(c)}, 0.5)')} AS q50, "
    f"{even(f'quantile_cont({dbl(c)}, 0.75)')} AS q75, {even(f'max({c})')} AS max FROM survival")))
oracle("describe_string", stacked(("model", "risk_level", "model_label"), lambda c: (
    f"SELECT '{c}' AS \"column\", sum(n) AS count, count(*) AS \"unique\", "
    f"(SELECT {c} FROM health GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top, max(n) AS freq "
    f"FROM (SELECT {c}, count(*) AS n FROM health GROUP BY {c})")))
oracle("fleet_statistics", f"SELECT count(*) AS total_machines, count(DISTINCT model) AS unique_models, {even('avg(age)')} AS avg_age, "
       f"{even('avg(global_health_score)')} AS avg_health, {even('avg(event) * 100')} AS failure_rate FROM health")
STATED = (*[c for c in ALL if c != "model"], "global_health_score")
PROFILE = {"count": "count({0})", "mean": "avg({0})", "std": "stddev_samp({0})", "min": "min({0})", "q25": "quantile_cont(CAST({0} AS DOUBLE), 0.25)",
           "q50": "quantile_cont(CAST({0} AS DOUBLE), 0.5)", "q75": "quantile_cont(CAST({0} AS DOUBLE), 0.75)", "max": "max({0})"}
TEXT_PROFILE = {"count": ("count({0})", None), "unique": ("count(DISTINCT {0})", None), "freq": ("(SELECT max(n) FROM (SELECT count(*) AS n FROM health GROUP BY {0}))", None),
                "top": (None, "(SELECT {0} FROM health GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)")}
FIGURES = {"total_machines": "count(*)", "unique_models": "count(DISTINCT model)", "avg_age": "avg(age)",
           "avg_health": "avg(global_health_score)", "failure_rate": "avg(event) * 100"}


def figure(part, key, metric, value=None, text=None, source="health"):
    return (f"SELECT '{part}' AS part, {key} AS key, '{metric}' AS metric, {even(value) if value else 'CAST(NULL AS DOUBLE)'} AS value, "
            f"{f'CAST({text} AS VARCHAR)' if text else 'NULL'} AS text FROM {source}")


oracle("statistics_bundle", " UNION ALL ".join(
    [figure("numeric", f"'{c}'", m, e.format(c)) for c in STATED for m, e in PROFILE.items()]
    + [figure("text", f"'{c}'", m, e and e.format(c), t and t.format(c), "(SELECT 1)" if "(SELECT" in (e or t) else "health")
       for c in ("model", "risk_level", "model_label") for m, (e, t) in TEXT_PROFILE.items()]
    + [figure("missing", f"'{c}'", "missing", f"count(*) - count({c})") for c in (*STATED, "model", "risk_level", "model_label")]
    + [figure("types", f"'{c}'", "data_type", None, f"'{ {**KINDS, 'global_health_score': 'double'}.get(c, 'string')}'", "(SELECT 1)") for c in (*STATED, "model", "risk_level", "model_label")]
    + [figure("types", f"'{c}'", "present", f"count({c})") for c in (*STATED, "model", "risk_level", "model_label")]
    + [figure("fleet", "NULL", m, e) for m, e in FIGURES.items()]
    + [figure("by_model", "model", "machines", "count(*)") + " GROUP BY model"]))
oracle("replaced_dataset", "SELECT reader, count(*) AS machines, CAST(sum(event) AS BIGINT) AS failures FROM survival "
       "JOIN (VALUES ('before', 0), ('after', 10), ('restored', 0)) r(reader, least) ON age >= least GROUP BY reader")
oracle("machines_by_model", "SELECT model, count(*) AS machines FROM survival GROUP BY model")
oracle("distinct_models", "SELECT DISTINCT model FROM survival")

# fleet overview
oracle("fleet_kpis", f"""
    SELECT count(DISTINCT machineID) AS machines, {even('avg(global_health_score)')} AS avg_health,
           count(DISTINCT machineID) FILTER (global_health_score < 70) AS critical_machines,
           count(*) FILTER (global_health_score < 75) AS high_risk_machines,
           {even('avg(event) * 100')} AS failure_rate, {even('avg(survival_at_30)')} AS avg_survival_30
    FROM health h LEFT JOIN horizons z ON z.grp = h.model""")
BETWEEN = "global_health_score BETWEEN 70 AND 80"
oracle("health_range", f"SELECT machineID, global_health_score FROM health WHERE {BETWEEN}")
oracle("health_range_stats", f"""
    SELECT count(*) FILTER ({BETWEEN}) AS machines, count(*) AS fleet, {even(f'avg(global_health_score) FILTER ({BETWEEN})')} AS mean,
           {even(f'stddev_samp(global_health_score) FILTER ({BETWEEN})')} AS std,
           min(global_health_score) FILTER ({BETWEEN}) AS min, max(global_health_score) FILTER ({BETWEEN}) AS max FROM health""")
BIN = f"CAST(least(15, floor(global_health_score / {dbl(100)} * 15) + 1) AS INT)"
for key, group, out in (("health_histogram", "", ""), ("health_histogram_by_group", ", risk_level", 'risk_level AS "group", ')):
    oracle(key, f"SELECT {out}bin, machines, {even('(bin - 1) * (100e0 / 15)')} AS low, {even('bin * (100e0 / 15)')} AS high FROM "
           f"(SELECT {BIN} AS bin{group}, count(*) AS machines FROM health GROUP BY ALL)")
oracle("health_quartiles", f"""
    SELECT model_label AS "group", count(*) AS machines, min(global_health_score) AS min,
           {even('quantile_cont(global_health_score, 0.25)')} AS q25, {even('quantile_cont(global_health_score, 0.5)')} AS q50,
           {even('quantile_cont(global_health_score, 0.75)')} AS q75, max(global_health_score) AS max
    FROM health GROUP BY model_label""")
oracle("health_stats_grouping_sets", f"""
    SELECT CASE WHEN grouping(model_label) = 0 THEN 'model_label' WHEN grouping(risk_level) = 0 THEN 'risk_level'
                WHEN grouping(model) = 0 THEN 'model' ELSE 'fleet' END AS dimension,
           coalesce(model_label, risk_level, model) AS value, count(*) AS machines, {even('avg(global_health_score)')} AS mean,
           min(global_health_score) AS min, max(global_health_score) AS max
    FROM health GROUP BY GROUPING SETS ((model_label), (risk_level), (model), ())""")
oracle("risk_distribution", "SELECT risk_level, count(*) AS machines FROM health GROUP BY risk_level")
HEAT = ", ".join(f"{even(f'avg({c})', 2)} AS {c}" for c in ("global_health_score", "vibration", "error_count"))
oracle("risk_heatmap", f"SELECT model_label, {HEAT} FROM health GROUP BY model_label")
oracle("risk_heatmap_t", stacked(("global_health_score", "vibration", "error_count"), lambda c: (
    f"SELECT model, '{c}' AS metric, {even(f'avg({c})', 2)} AS value FROM health WHERE model IS NOT NULL GROUP BY model")))
HIGH = "risk_level IN ('CRITIQUE', 'ÉLEVÉ')"
DOSSIERS = ", ".join(f"count(*) FILTER (a.level = '{level}') AS dossiers_{name}" for name, level in (
    ("critical", "CRITIQUE"), ("high", "ÉLEVÉ"), ("moderate", "MODÉRÉ"), ("low", "FAIBLE")))
oracle("fleet_risk_distribution", f"""
    SELECT h.risk_level, count(*) AS machines, {DOSSIERS}
    FROM health h JOIN analysis a ON a.machineID IS NOT DISTINCT FROM h.machineID GROUP BY h.risk_level""")
oracle("critical_machines", f"SELECT machineID, risk_level FROM health WHERE {HIGH}")
oracle("machine_lookup", "SELECT machineID, model, global_health_score FROM health WHERE age >= 15")
oracle("machine_metrics", "SELECT machineID, " + ", ".join(f"{even(c)} AS {n}" for c, n in (
    ("vibration", "vibration"), ("pressure", "pressure"), ("error_count", "errors"), ("rotate", "rotation"))) + " FROM survival")
oracle("machine_detail", f"SELECT machineID, model, model_label, global_health_score, risk_level, {even('vibration')} AS vibration, "
       "error_count FROM health")
oracle("alert_center", f"""
    SELECT machineID, model, global_health_score, {even('vibration')} AS vibration, error_count,
           CASE WHEN global_health_score < 30 THEN 'ARRÊT IMMÉDIAT' WHEN global_health_score < 50 THEN 'MAINTENANCE URGENTE'
                ELSE 'SURVEILLANCE' END AS action FROM health WHERE global_health_score <= 75""")
oracle("top5_at_risk", "SELECT machineID, model, global_health_score FROM health ORDER BY global_health_score, machineID LIMIT 5")
oracle("recent_alerts", f"""
    SELECT 'Machine ' || machineID AS machine, model || ' (Label: ' || model_label || ')' AS model,
           {shown('global_health_score')} AS health, CASE WHEN global_health_score < 30 THEN 'Critique' ELSE 'Élevé' END AS risk,
           'N/A' AS failure_probability, 'N/A' AS predicted_rul,
           CASE WHEN global_health_score < 30 THEN 'Maintenance Immédiate' ELSE 'Planifier' END AS action
    FROM health WHERE global_health_score < 72 ORDER BY machineID LIMIT 10""")
WEEK = "make_timestamp(CAST(floor(epoch_us(datetime) / 604800e6) AS BIGINT) * 604800000000)"
oracle("health_trend", f"""
    SELECT machineID, {STAMP.format('w')} AS timestamp, {even(f'''least({dbl(100)}, greatest({dbl(0)},
               greatest({dbl(0)}, 100 - (v - 35) * 2) * {dbl(0.30)} + greatest({dbl(0)}, 100 - abs(p - 100) * 2) * {dbl(0.25)}
               + greatest({dbl(0)}, {dbl('100 - age * 5')}) * {dbl(0.10)}))''')} AS global_health_score
    FROM (SELECT machineID, {WEEK} AS w, avg(vibration) AS v, avg(pressure) AS p FROM telemetry GROUP BY ALL)
    LEFT JOIN machines USING (machineID)""")

# alerts and calendar
oracle("risk_score", "SELECT machineID, " + cols("health_risk, degradation_risk, age_risk, error_risk, total_risk") + " FROM scored")
oracle("alert_level_base", "SELECT machineID, CASE WHEN time <= 7 THEN 'CRITIQUE' WHEN time <= 14 THEN 'HAUTE' "
       "WHEN time <= 30 THEN 'MOYENNE' ELSE 'BASSE' END AS level FROM survival")
oracle("prob_failure", f"SELECT machineID, {even('prob')} AS prob_failure FROM scored")
oracle("alert_level", "SELECT machineID, base_level, alert_level FROM levels")
oracle("alerts", "SELECT * FROM alerts")
oracle("maintenance_calendar", """
    SELECT 'Semaine_' || week AS week_label, position, machine_id, model, alert_level, rul_days, maintenance_deadline
    FROM weeks LEFT JOIN placed USING (week)""")
oracle("calendar_week_counts", "SELECT 'Semaine_' || week AS week_label, count(machine_id) AS alerts "
       "FROM weeks LEFT JOIN placed USING (week) GROUP BY week")
oracle("calendar_top5", "SELECT 'Semaine_' || week AS week_label, position, machine_id, rul_days FROM placed WHERE position <= 5")
LEVELS = "(VALUES ('CRITIQUE', 0), ('HAUTE', 1), ('MOYENNE', 2), ('BASSE', 3)) l(alert_level, priority)"
oracle("alert_stats_by_level", f"SELECT l.alert_level, l.priority, count(a.machine_id) AS alerts FROM {LEVELS} "
       "LEFT JOIN alerts a ON a.alert_level = l.alert_level GROUP BY l.alert_level, l.priority")
oracle("alert_stats_by_model", "SELECT model, count(*) AS alerts FROM alerts GROUP BY model")
oracle("alert_levels_nonzero", "SELECT alert_level, count(*) AS alerts FROM alerts GROUP BY alert_level")
RANK = "row_number() OVER (ORDER BY priority, prob_failure DESC, machine_id)"
oracle("critical_risks", f"""
    SELECT {RANK} AS position, 'Machine ' || machine_id || ' (' || model || ') - RUL: ' || {shown('rul_days')}
           || 'j - Risque: ÉLEVÉ' AS line FROM alerts WHERE alert_level = 'CRITIQUE' QUALIFY position <= 10""")

# economics
HOURS = (f"CASE model WHEN 'model1' THEN {dbl(4)} WHEN 'model2' THEN {dbl(6)} WHEN 'model3' THEN {dbl(5)} "
         f"WHEN 'model4' THEN {dbl(3.5)} ELSE {dbl(5)} END")
oracle("machine_economics", f"""
    SELECT machineID, model, cost AS cost_unplanned_downtime, {dbl(200)} AS cost_planned_maintenance,
           greatest(0, cost - 200) AS potential_savings, {even('greatest(0, cost - 200) / cost * 100', 1)} AS savings_percent,
           {even('global_health_score', 1)} AS health_score,
           CASE WHEN cost - 200 > 2000 THEN 'HAUTE' WHEN cost - 200 > 1000 THEN 'MOYENNE' ELSE 'BASSE' END AS priority
    FROM (SELECT *, {HOURS} * 500 + 1500 AS cost FROM health)""")
oracle("roi_by_model", f"""
    SELECT model, machines, annual AS annual_savings, {dbl(100)} AS annual_investment, annual - 100 AS annual_net_benefit,
           {even('(annual - 100) / 100 * 100', 1)} AS roi_percent, {even('12 * 100 / annual', 1)} AS payback_months FROM values4""")
oracle("fleet_economics", "SELECT * FROM fleetmoney")

OTHER_HOURS = f"CASE model WHEN 'model1' THEN {dbl(8)} WHEN 'model3' THEN {dbl(2.5)} ELSE {dbl(1)} END"
oracle("machine_economics_override", f"""
    SELECT machineID, cost AS cost_unplanned_downtime, greatest(0, cost - 200) AS potential_savings,
           {even('greatest(0, cost - 200) / cost * 100', 1)} AS savings_percent,
           CASE WHEN cost - 200 > 3000 THEN 'HAUTE' WHEN cost - 200 > 1400 THEN 'MOYENNE' ELSE 'BASSE' END AS priority
    FROM (SELECT *, {OTHER_HOURS} * 350 + 900 AS cost FROM health)""")

# dossiers
oracle("anomalies", f"""
    SELECT machineID, 'VIBRATION_ÉLEVÉE' AS type, 'HAUTE' AS severity, 'Vibration élevée: ' || {shown('vibration')} AS message,
           'Vérifier équilibrage' AS recommendation FROM survival WHERE vibration > 40
    UNION ALL SELECT machineID, 'PRESSION_ANORMALE', 'MOYENNE', 'Pression anormale: ' || {shown('pressure')},
           'Contrôler régulateur' FROM survival WHERE pressure < 99 OR pressure > 101
    UNION ALL SELECT machineID, 'ERREURS_EXCESSIVES', 'HAUTE', 'Erreurs excessives: ' || error_count, 'Analyser logs'
    FROM survival WHERE error_count > 30""")
oracle("recommendations", "SELECT machineID, i - 1 AS position, advice[i] AS recommendation "
       "FROM (SELECT machineID, advice, unnest(range(1, len(advice) + 1)) AS i FROM advice)")
oracle("band_recommendations", "SELECT machineID, i - 1 AS position, advice[i] AS recommendation FROM ("
       "SELECT machineID, advice, unnest(range(1, 4)) AS i FROM (SELECT machineID, CASE "
       + " ".join((f"WHEN global_health_score < {limit} THEN " if limit else "ELSE ")
                  + "[" + ", ".join(text(t) for t in texts) + "]" for limit, texts in BAND_RECOMMENDATIONS)
       + " END AS advice FROM health))")
oracle("machine_dossier", f"""
    SELECT machineID, model, age, 0 AS pattern_failure, {even('raw_health', 1)} AS score_global,
           {even('vibration_score', 1)} AS sante_mecanique, {even('pressure_score', 1)} AS sante_pression, level AS risk_level,
           {dbl(0.8)} AS confidence, rul_median, survival_30d, survival_90d, {even('time')} AS current_survival_time,
           anomalies, array_to_string(advice, ' / ') AS recommendations, {even('vibration', 1)} AS vibration,
           {even('pressure', 1)} AS pression, {even('rotate', 1)} AS rotation, error_count AS erreurs_cumulees,
           maint_count AS maintenances_realisees
    FROM analysis JOIN advice USING (machineID)
    UNION ALL
    SELECT machineID, 'INCONNU', 0, 0, 50, 50, 50, 'MODÉRÉ', 0.5, 100, 0.8, 0.6, NULL, 0, 'Analyse indisponible', 0, 0, 0, 0, 0
    FROM (SELECT machineID FROM machines UNION ALL SELECT range FROM range(-2, 0))
    WHERE machineID NOT IN (SELECT machineID FROM survival)""")
CONTEXT = (f"'Machine: ' || machineID || ' - Modèle: ' || model || ' | Score santé: ' || {shown('raw_health')} || '/100 | "
           f"Niveau risque: ' || level || ' (confiance: 80.0%) | RUL médian: ' || coalesce({shown('rul_median')}, 'N/A') || ' jours'")
oracle("context_string", f"SELECT machineID, {CONTEXT} AS context FROM analysis")

# reports


def keyed(rows, source: str, section: str) -> str:
    return " UNION ALL ".join(f"SELECT {text(section)} AS section, {i} AS position, {text(k)} AS key, {v} AS value FROM {source}"
                              for i, (k, v) in enumerate(rows, 1))


oracle("executive_kpis", keyed([
    ("Parc total", "machines || ' machines'"), ("Santé moyenne", f"{shown('health')} || '/100'"),
    ("Machines critiques", f"critical || ' (' || {shown('critical / ' + dbl('machines') + ' * 100')} || '%)'"),
    ("Économies annuelles", f"{whole('total_fleet_savings')} || ' €'"),
    ("ROI maintenance prédictive", f"{shown('total_roi_percent')} || '%'"),
    ("Temps d'arrêt évité", "'0 h/an'"), ("Coût maintenance moyen", "'0 €/machine'")], "figures", "kpi"), {
    "figures": "SELECT * FROM (SELECT count(DISTINCT machineID) AS machines, avg(global_health_score) AS health FROM health), "
               "(SELECT count(*) AS critical FROM alerts WHERE alert_level = 'CRITIQUE'), fleetmoney"})
oracle("roi_analysis", keyed([
    ("Investissement ML", f"{whole('total_ml_investment')} || ' €'"), ("Économies annuelles", f"{whole('total_fleet_savings')} || ' €'"),
    ("Période de retour", f"{shown('total_ml_investment / total_fleet_savings * 12')} || ' mois'"),
    ("Bénéfice net 3 ans", f"{whole('total_fleet_savings * 3 - total_ml_investment')} || ' €'"),
    ("ROI annuel", f"{shown('total_fleet_savings / total_ml_investment * 100')} || '%'")], "fleetmoney", "roi"))
oracle("projections", keyed([
    ("Économies projetées (M+6)", f"{whole('total_fleet_savings * 1.5e0')} || ' €'"),
    ("Économies projetées (M+12)", f"{whole('total_fleet_savings * 1.15e0')} || ' €'"),
    ("Réduction temps d'arrêt", "'-45% vs année précédente'"), ("Amélioration santé parc", "'+12% vs baseline actuelle'")],
    "fleetmoney", "projection"))
STRATEGY = " UNION ALL ".join(f"SELECT 'strategy' AS section, {i} AS position, {text(t)} AS line"
                              for i, t in enumerate(STRATEGIC_RECOMMENDATIONS, 1))
oracle("instructions", f"""
    {STRATEGY} UNION ALL SELECT 'strategy', 6, {text(HIGH_ROI_RECOMMENDATION)} FROM fleetmoney WHERE total_roi_percent > 200
    UNION ALL SELECT 'instruction', row_number() OVER (ORDER BY place), line FROM orders""", {
    "tally": "SELECT count(*) FILTER (alert_level = 'CRITIQUE') AS c, count(*) FILTER (alert_level = 'HAUTE') AS h FROM alerts",
    "orders": f"""
        SELECT 1 AS place, 'Intervenir sur les ' || c || ' machines CRITIQUES dans les 48h' AS line FROM tally WHERE c > 0
        UNION ALL SELECT 2, 'Préparer équipe d''intervention rapide avec pièces critiques' FROM tally WHERE c > 0
        UNION ALL SELECT 3, 'Planifier maintenance des ' || h || ' machines HAUTE priorité cette semaine' FROM tally WHERE h > 0
        UNION ALL SELECT 4, {text(STANDING_INSTRUCTIONS[0])} UNION ALL SELECT 5, {text(STANDING_INSTRUCTIONS[1])}"""})
oracle("maintenance_report", f"""
    SELECT 'levels' AS section, priority AS major, 0 AS minor, '  ' || alert_level || ': ' || count(*) || ' machines' AS line
    FROM alerts GROUP BY alert_level, priority
    UNION ALL
    SELECT 'critical', 0, {RANK} AS place, '  🚨 Machine ' || machine_id || ' (' || model || ')' || chr(10)
           || '     • RUL: ' || {shown('rul_days')} || ' jours' || chr(10) || '     • Santé: ' || {shown('health_score')} || '/100'
           || chr(10) || '     • Risque: N/A' || chr(10) || '     • Deadline: ' || maintenance_deadline || chr(10)
           || '     • Action: ' || recommended_action
    FROM alerts WHERE alert_level = 'CRITIQUE' QUALIFY place <= 15
    UNION ALL
    SELECT 'calendar', week, position, '  • Machine ' || machine_id || ' - ' || model || chr(10) || '    RUL: ' || {shown('rul_days')}
           || 'j | Deadline: ' || maintenance_deadline FROM placed WHERE position <= 5
    UNION ALL
    SELECT 'instruction', 0, row_number() OVER (ORDER BY place), '  ' || row_number() OVER (ORDER BY place) || '. ' || line FROM orders
    UNION ALL
    SELECT 'parts', 0, p_partkey, '  ' || p_name || ': ' || p_size || ' unités - ' || CASE WHEN p_size < 10 THEN 'HAUTE' ELSE 'BASSE' END
    FROM part""", {
    "tally": "SELECT count(*) FILTER (alert_level = 'CRITIQUE') AS c, count(*) FILTER (alert_level = 'HAUTE') AS h FROM alerts",
    "orders": f"""
        SELECT 1 AS place, 'Intervenir sur les ' || c || ' machines CRITIQUES dans les 48h' AS line FROM tally WHERE c > 0
        UNION ALL SELECT 2, 'Préparer équipe d''intervention rapide avec pièces critiques' FROM tally WHERE c > 0
        UNION ALL SELECT 3, 'Planifier maintenance des ' || h || ' machines HAUTE priorité cette semaine' FROM tally WHERE h > 0
        UNION ALL SELECT 4, {text(STANDING_INSTRUCTIONS[0])} UNION ALL SELECT 5, {text(STANDING_INSTRUCTIONS[1])}"""})
# Titles of the executive report.
EXECUTIVE = ("RAPPORT EXÉCUTIF - MAINTENANCE PRÉDICTIVE", "Entreprise Industrielle", "Date: 2024-06-01 00:00:00")
EXECUTIVE_PARTS = (("📊 TABLEAU DE BORD STRATÉGIQUE", "SELECT position, '  ' || key || ': ' || value AS line", ORACLES["executive_kpis"], "true"),
                   ("💰 ANALYSE FINANCIÈRE", "SELECT position, '  ' || key || ': ' || value AS line", ORACLES["roi_analysis"], "true"),
                   ("🔴 RISQUES CRITIQUES", "SELECT position, '  ' || position || '. ' || line AS line", ORACLES["critical_risks"], "position <= 5"),
                   ("✅ RECOMMANDATIONS STRATÉGIQUES", "SELECT position, '  ' || position || '. ' || line AS line", ORACLES["instructions"], "section = 'strategy'"),
                   ("📈 PROJECTIONS 12 MOIS", "SELECT position, '  ' || key || ': ' || value AS line", ORACLES["projections"], "true"))
ORACLES["executive_report"] = " UNION ALL ".join(
    [f"SELECT 0 AS block, CAST({i} AS INTEGER) AS position, {line} AS line" for i, line in enumerate(
        ("repeat('=', 80)", *map(text, EXECUTIVE), "repeat('=', 80)"), 1)]
    + [f"SELECT {block}, -2, chr(10) || {text(title)} UNION ALL SELECT {block}, -1, repeat('=', 80) "
       f"UNION ALL SELECT {block}, CAST(position AS INTEGER), line FROM ({lines} FROM ({source}) WHERE {where})"
       for block, (title, lines, source, where) in enumerate(EXECUTIVE_PARTS, 1)])
oracle("decision_pack", f"""
    SELECT 'top5' AS section, row_number() OVER (ORDER BY global_health_score, machineID) AS position,
           '- Machine ' || machineID || ' | Modèle: ' || model || ' | Santé: ' || {shown('global_health_score', 2)} || ' | ProbFail: N/A' AS line
    FROM health QUALIFY position <= 5
    UNION ALL SELECT 'economics', 1, '- total_fleet_savings: ' || {shown('total_fleet_savings', 2)} FROM fleetmoney
    UNION ALL SELECT 'economics', 2, '- total_ml_investment: ' || {shown('total_ml_investment', 2)} FROM fleetmoney
    UNION ALL SELECT 'economics', 3, '- total_net_benefit: ' || {shown('total_net_benefit', 2)} FROM fleetmoney
    UNION ALL SELECT 'economics', 4, '- total_roi_percent: ' || {shown('total_roi_percent', 1)} FROM fleetmoney
    UNION ALL SELECT 'economics', 5, '- fleet_size: ' || fleet_size FROM fleetmoney""")
PROMPT = text(EXECUTIVE_PROMPT)
for slot, value in (("context", CONTEXT), ("total_machines", "CAST(machines AS VARCHAR)"), ("critical_machines", "CAST(critical AS VARCHAR)"),
                    ("avg_health", shown("health")), ("roi_percent", shown("total_roi_percent"))):
    PROMPT = f"replace({PROMPT}, '{{{slot}}}', {value})"
oracle("report_prompts", f"SELECT machineID, {PROMPT} AS prompt FROM analysis, figures", {
    "figures": "SELECT * FROM (SELECT count(DISTINCT machineID) AS machines, avg(raw_health) AS health, "
               "count(DISTINCT machineID) FILTER (raw_health < 30) AS critical FROM rawhealth), fleetmoney"})

# splits and metrics
HASH = "substr(md5(CAST(machineID AS VARCHAR) || ':42'), 1, 8)"
oracle("random_split", f"SELECT machineID, {HASH} < '33333333' AS is_test FROM survival")
oracle("stratified_split", f"""
    SELECT machineID, event, row_number() OVER (PARTITION BY event ORDER BY {HASH}, machineID)
           <= round_even(count(*) OVER (PARTITION BY event) * {dbl(0.2)}, 0) AS is_test FROM survival""")
oracle("classification_report", f"""
    SELECT scope, {cols('precision, recall, f1')}, support FROM (
        SELECT CAST(class AS VARCHAR) AS scope, precision, recall, f1, support FROM scored_classes
        UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM scored_classes
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scored_classes
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                         sum(f1 * support) / sum(support), sum(support) FROM scored_classes)""", {
    "classes": """
        SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (prediction = class) AS predicted,
               count(*) FILTER (label = class AND prediction = class) AS hits
        FROM labels4, (SELECT label AS class FROM labels4 UNION SELECT prediction FROM labels4) GROUP BY class""",
    "ratios": f"""
        SELECT *, coalesce(hits / {dbl('nullif(predicted, 0)')}, 0) AS precision,
               coalesce(hits / {dbl('nullif(support, 0)')}, 0) AS recall FROM classes""",
    "scored_classes": "SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM ratios"})
oracle("roc_auc", f"""
    SELECT {even('(sum(r) FILTER (label = 1) - p * (p + 1) / 2) / (p * n)')} AS auc_roc FROM (
        SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / {dbl(2)} AS r,
               {dbl('count(*) FILTER (label = 1) OVER ()')} AS p, {dbl('count(*) FILTER (label = 0) OVER ()')} AS n FROM labels4)
    GROUP BY p, n""")
oracle("regression_metrics", f"""
    SELECT {even('avg(abs(time - expected_life))')} AS mae, {even('sqrt(avg(power(time - expected_life, 2)))')} AS rmse,
           {even('1 - avg(power(time - expected_life, 2)) / var_pop(time)')} AS r2 FROM labels4""")
oracle("standardize", "SELECT machineID, " + ", ".join(
    f"{even(f'({c} - (SELECT avg({c}) FROM survival)) / (SELECT stddev_pop({c}) FROM survival)')} AS {c}_z"
    for c in ("vibration", "pressure", "error_count")) + " FROM survival")

# forests and clusters: what must hold of any fit
LEARNED = ("global_health_score", "vibration", "error_count", "degradation_rate", "pressure", "volt", "rotate", "age", "maint_count", "risk_factor")
oracle("forest_nodes", "SELECT model, kind, 0 AS unsound FROM (VALUES ('classifier'), ('regressor')) m(model), (VALUES ('inner'), ('leaf')) k(kind)")
oracle("forest_predictions", f"SELECT machineID, {dbl(0)} AS proba_off, {dbl(0)} AS rul_off FROM survival")
oracle("risk_prediction_walked", f"SELECT machineID, {dbl(0)} AS off, true AS is_level FROM survival")
oracle("importance_walked", f"SELECT model, unnest({list(LEARNED)}) AS feature, {dbl(0)} AS off FROM (VALUES ('classifier'), ('regressor')) m(model)")
oracle("pattern_certificate", f"SELECT count(*) AS machines, count(*) AS nearest, {dbl(0)} AS off_centre FROM survival")

# windowed telemetry
DAY = "make_timestamp(CAST(floor(epoch_us(datetime) / 86400e6) AS BIGINT) * 86400000000)"
oracle("telemetry_tumbling", f"""
    SELECT machineID, {STAMP.format('w')} AS window_start, {even('avg(volt)')} AS volt_mean, {even('avg(pressure)')} AS pressure_mean,
           {even('avg(vibration)')} AS vibration_mean, {even('stddev_samp(vibration)')} AS vibration_std,
           {even('stddev_samp(rotate)')} AS rotate_std, count(*) AS readings
    FROM (SELECT *, {DAY} AS w FROM telemetry) GROUP BY machineID, w""")
oracle("telemetry_sliding", f"""
    SELECT machineID, {STAMP.format('w')} AS window_start, {even('avg(rotate)')} AS rotate_mean,
           {even('stddev_samp(pressure)')} AS pressure_std, count(*) AS readings
    FROM (SELECT *, {WEEK} AS w FROM telemetry UNION ALL SELECT *, {WEEK} - INTERVAL 7 DAY AS w FROM telemetry)
    GROUP BY machineID, w""")
oracle("error_windows", f"""
    SELECT machineID, {STAMP.format('w')} AS window_start, count(*) FILTER (kind = 'e') AS error_count,
           count(*) FILTER (kind = 'm') AS maint_count
    FROM (SELECT *, {WEEK} AS w, 'e' AS kind FROM errors UNION ALL SELECT *, {WEEK}, 'm' FROM maint) GROUP BY machineID, w""")
oracle("error_sessions", f"""
    SELECT machineID, {STAMP.format('min(datetime)')} AS window_start, {STAMP.format('max(datetime) + INTERVAL 12 HOUR')} AS window_end,
           count(*) AS errors
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY machineID ORDER BY datetime) AS burst FROM (
              SELECT *, CASE WHEN datetime - lag(datetime) OVER (PARTITION BY machineID ORDER BY datetime) <= INTERVAL 12 HOUR
                             THEN 0 ELSE 1 END AS fresh FROM errors)) GROUP BY machineID, burst""")
oracle("alerts_total", "SELECT model, count(*) AS alerts FROM alerts GROUP BY ROLLUP (model)")
oracle("alert_history", "SELECT day, alert_level, count(*) AS alerts FROM alerts, (VALUES ('2024-06-01'), ('2024-06-02')) d(day) "
       "GROUP BY day, alert_level")
# Upper tail of chi-square with one degree of freedom: 1 - erf(sqrt(x / 2)), the error function by its series of positive terms.
CHI_TAIL = ("1 - list_sum(list_transform(range(0, 400), lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln(sqrt(statistic / 2)) + lgamma(k + 1) "
            "- lgamma(2 * k + 2) - statistic / 2))) * 2 / sqrt(pi())")
ORACLES["logrank_p_value"] = f"""SELECT group_a, group_b, {even(CHI_TAIL)} AS p_value, CASE WHEN statistic > 10.827566170662733 THEN '<0.001'
    WHEN statistic > 6.6348966010212145 THEN '<0.01' WHEN statistic > 3.841458820694124 THEN '<0.05'
    WHEN statistic > 2.705543454095404 THEN '<0.1' ELSE '>=0.1' END AS p_band
    FROM ({ORACLES['logrank_pairs'].replace(even('power(sum(d_a - e), 2) / sum(v)'), 'power(sum(d_a - e), 2) / sum(v)')})"""
ORACLES["split_sizes"] = f"""SELECT 'classifier' AS model, event AS label, is_test, count(*) AS machines
    FROM ({ORACLES['stratified_split']}) GROUP BY event, is_test
    UNION ALL SELECT 'regressor', NULL, is_test, count(*) FROM ({ORACLES['random_split']}) GROUP BY is_test"""


oracle("cox_gradient", f"""
    SELECT feature, aliased, CASE WHEN NOT aliased THEN {dbl(0)} END AS gradient FROM (
        SELECT unnest(['age', 'volt', 'rotate', 'pressure', 'error_count', 'maint_count']) AS feature, false AS aliased
        UNION ALL SELECT 'vibration', abs(corr(vibration, volt)) > 1 - 1e-9 FROM survival)""")
COVARIATES = ("age", "volt", "rotate", "pressure", "vibration", "error_count", "maint_count")
PAIRS = [(a, b) for i, a in enumerate(COVARIATES) for b in COVARIATES[i:]]
MOMENTS = {"0": "w", **{a: f"w * {a}" for a in COVARIATES}, **{f"{a}_{b}": f"w * {a} * {b}" for a, b in PAIRS}}
oracle("cox_score", f"""
    SELECT 'likelihood' AS quantity, NULL AS first, NULL AS second, {even('(SELECT sum(eta) FROM coxtimes WHERE d > 0) - sum(ln(m_0))', 3)} AS value FROM coxterms
    UNION ALL {" UNION ALL ".join(f"SELECT 'gradient', '{a}', NULL, {even(f'(SELECT sum(x_{a}) FROM coxtimes WHERE d > 0) - sum(m_{a} / m_0)', 3)} FROM coxterms" for a in COVARIATES)}
    UNION ALL {" UNION ALL ".join(f"SELECT 'information', '{a}', '{b}', {even(f'sum(m_{a}_{b} / m_0 - m_{a} / m_0 * m_{b} / m_0)', 3)} FROM coxterms" for a, b in PAIRS)}""", {
    "coxrows": f"SELECT time, event, {', '.join(f'{dbl(c)} AS {c}' for c in COVARIATES)}, ({' + '.join(f'{dbl(c)} * 0.01e0' for c in COVARIATES)}) AS eta, exp(eta) AS w FROM survival",
    "coxtimes": "SELECT time, count(*) FILTER (event = 1) AS d, sum(eta) FILTER (event = 1) AS eta, "
                + ", ".join(f"sum({a}) FILTER (event = 1) AS x_{a}" for a in COVARIATES) + ", "
                + ", ".join(f"sum({e}) AS r_{k}, sum({e}) FILTER (event = 1) AS f_{k}" for k, e in MOMENTS.items()) + " FROM coxrows GROUP BY time",
    "coxrisk": "SELECT *, " + ", ".join(f"sum(r_{k}) OVER (ORDER BY time DESC) AS s_{k}" for k in MOMENTS) + " FROM coxtimes",
    "coxterms": "SELECT " + ", ".join(f"s_{k} - k / d * f_{k} AS m_{k}" for k in MOMENTS)
                + " FROM (SELECT *, CAST(unnest(range(0, d)) AS DOUBLE) AS k FROM coxrisk WHERE d > 0)"})

# what is written and read again
ORACLES["training_report_file"] = f"SELECT 'scored' AS model, 'f1' AS metric, scope AS label, f1 AS value FROM ({ORACLES['classification_report']})"
oracle("saved_models", "SELECT count(*) AS machines, 0 AS differ, 2 AS models FROM survival")
oracle("load_and_validate", """
    SELECT upload, CASE WHEN upload = 'short' THEN 'missing columns: age, volt' END AS problem, count(machineID) AS machines, count(machineID) AS enriched
    FROM (VALUES ('whole', 0), ('old', 10), ('short', 1000)) u(upload, least) LEFT JOIN survival ON age >= least GROUP BY upload""")
ORACLES["training_job"] = f"""SELECT model, CASE WHEN is_test THEN 'n_samples_test' ELSE 'n_samples_train' END AS metric, CAST(sum(machines) AS BIGINT) AS rows, 2 AS models
    FROM ({ORACLES['split_sizes']}) GROUP BY model, is_test"""
ORACLES["alert_stream"] = f"SELECT machine_id, alert_level, rul_days, prob_failure, risk_score FROM ({ORACLES['alerts']})"
ORACLES["telemetry_stream"] = f"""SELECT * FROM ({ORACLES['telemetry_sliding']})
    WHERE strptime(window_start, '%Y-%m-%d %H:%M:%S') + INTERVAL 29 DAY <= (SELECT make_timestamp(1704067200000000 + (max(epoch_us(ts)) - 1704067200000000) * 4) FROM events)"""
oracle("optimal_features", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(
    ("global_health_score", "vibration", "error_count", "degradation_rate", "volt", "rotate", "age", "maint_count", "risk_factor"), 1)) + ") f(position, feature)")
oracle("top_features_certificate", "SELECT model, 5 AS top, 5 AS last, 0 AS above, 5 AS others FROM (VALUES ('classifier'), ('regressor')) m(model)")
oracle("grid_certificate", "SELECT * FROM (VALUES ('classifier', 24, 0), ('regressor', 12, 0)) g(model, combinations, better)")
# Headings of the decision pack.
PACK = ((0, "Decision Pack - Maintenance Prédictive"), (1, "Date: 2024-06-01 00:00:00"), (3, "Top 5 Machines à Risque:"), (10, "Résumé Economique:"))
ORACLES["decision_pack_file"] = " UNION ALL ".join(
    [f"SELECT CASE WHEN section = 'top5' THEN 3 ELSE 10 END + position AS place, line FROM ({ORACLES['decision_pack']})"]
    + [f"SELECT {place}, {text(line)}" for place, line in PACK])
