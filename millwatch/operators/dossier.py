"""Per-machine analysis: anomalies, recommendations and the nested dossier."""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from millwatch.config import ANOMALIES, AnomalyLimits, CRITIQUE, ELEVE, HAUTE, MODERE, MOYENNE
from millwatch.functions import risk
from millwatch.functions.numeric import half_even

# Texts of the anomaly and recommendation lists.

ANOMALY_TEXTS = {
    "vibration": ("VIBRATION_ÉLEVÉE", HAUTE, "Vibration élevée: ", "Vérifier équilibrage"),
    "pressure": ("PRESSION_ANORMALE", MOYENNE, "Pression anormale: ", "Contrôler régulateur"),
    "errors": ("ERREURS_EXCESSIVES", HAUTE, "Erreurs excessives: ", "Analyser logs"),
}

RISK_RECOMMENDATIONS = {
    CRITIQUE: ("Maintenance immédiate requise", "Inspection complète des composants",
               "Arrêt recommandé si possible"),
    ELEVE: ("Maintenance sous 7 jours", "Surveillance renforcée", "Analyse des causes"),
    MODERE: ("Maintenance dans 30 jours", "Monitoring des tendances", "Contrôle des paramètres"),
    "other": ("Maintenance à 60 jours", "Surveillance normale", "Opérations standards"),
}

LOW_RUL_RECOMMENDATION = "RUL faible - Intervention urgente"
LOW_RUL_DAYS = 30

BAND_RECOMMENDATIONS = (
    (30, ("🔴 ARRÊT IMMÉDIAT recommandé", "🔧 Intervention maintenance urgente nécessaire",
          "📞 Contacter le responsable maintenance")),
    (60, ("🟠 Planifier maintenance sous 7 jours", "🔍 Vérifier capteurs vibration et pression",
          "📊 Analyser historique des erreurs")),
    (None, ("🟢 Maintenance préventive standard", "👁️ Surveillance continue recommandée",
            "📈 Vérifier dans 30 jours")),
)

UNTRAINED = {"risk_level": "INCONNU", "confidence": 0.0, "rul_median": 100.0, "survival_30d": 0.8,
             "survival_90d": 0.6, "current_survival_time": 0.0}

UNKNOWN_MACHINE = {
    "model": "INCONNU", "risk_level": MODERE, "confidence": 0.5, "score": 50.0, "rul_median": 100.0,
    "survival_30d": 0.8, "survival_90d": 0.6, "recommendation": "Analyse indisponible",
}


def anomaly_list(limits: AnomalyLimits = ANOMALIES) -> Column:
    """Array of anomaly structs of a machine row; empty when nothing is out of range."""
    def entry(kind: str, when: Column, shown: Column) -> Column:
        name, severity, message, advice = ANOMALY_TEXTS[kind]
        return F.when(when, F.struct(
            F.lit(name).alias("type"), F.lit(severity).alias("severity"),
            F.concat(F.lit(message), shown).alias("message"), F.lit(advice).alias("recommendation")))

    vibration, pressure, errors = F.col("vibration"), F.col("pressure"), F.col("error_count")
    return F.array_compact(F.array(
        entry("vibration", vibration > limits.max_vibration, _one_decimal(vibration)),
        entry("pressure", (pressure < limits.min_pressure) | (pressure > limits.max_pressure), _one_decimal(pressure)),
        entry("errors", errors > limits.max_errors, errors.cast("string"))))


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", half_even(value, 1))


def anomalies(df: DataFrame, limits: AnomalyLimits = ANOMALIES) -> DataFrame:
    return df.select("machineID", F.explode(anomaly_list(limits)).alias("anomaly")).select("machineID", "anomaly.*")


def _texts(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def recommendation_list(level: Column, found: Column, rul_median: Column) -> Column:
    by_risk = (F.when(level == CRITIQUE, _texts(RISK_RECOMMENDATIONS[CRITIQUE]))
               .when(level == ELEVE, _texts(RISK_RECOMMENDATIONS[ELEVE]))
               .when(level == MODERE, _texts(RISK_RECOMMENDATIONS[MODERE]))
               .otherwise(_texts(RISK_RECOMMENDATIONS["other"])))
    urgent = F.when(rul_median < LOW_RUL_DAYS, _texts([LOW_RUL_RECOMMENDATION])).otherwise(
        F.array().cast("array<string>"))
    return F.concat(by_risk, F.transform(found, lambda a: a["recommendation"]), urgent)


def analysed(df: DataFrame, rul: DataFrame | Mapping[str, Column] | None, limits: AnomalyLimits = ANOMALIES) -> DataFrame:
    """Fleet rows with remaining-life figures, anomalies and recommendations attached.

    ``df`` holds the unrounded health features and may hold ``risk_level``, ``confidence``,
    ``probabilities`` (from a classifier) and ``failure_pattern`` (from clustering); without
    a classifier the level follows from the health score with confidence 0.8. ``rul`` is a table by
    machine or, for figures that hold for the whole fleet, columns to project. Without ``rul``
    nothing has been trained yet and risk and remaining life are the fixed "unknown" figures.
    """
    predicted = "confidence" in df.columns
    if rul is None:
        level, confidence = F.lit(UNTRAINED["risk_level"]), F.lit(UNTRAINED["confidence"])
    elif predicted:
        level, confidence = F.col("risk_level"), F.col("confidence")
    else:
        level, confidence = risk.risk_from_health(F.col("global_health_score")), F.lit(0.8)
    out = df.withColumns({
        "risk_level": level, "confidence": confidence,
        "probabilities": F.col("probabilities") if "probabilities" in df.columns and rul is not None
        else F.lit(None).cast("map<string,double>"),
        "failure_pattern": F.col("failure_pattern") if "failure_pattern" in df.columns else F.lit(0),
        "anomalies": anomaly_list(limits)})
    if rul is None:
        out = out.withColumns({c: F.lit(UNTRAINED[c]) for c in (
            "rul_median", "survival_30d", "survival_90d", "current_survival_time")})
    elif isinstance(rul, DataFrame):
        out = out.join(rul, "machineID", "left")
    else:
        out = out.withColumns(dict(rul))
    return out.withColumn("recommendations", recommendation_list(
        F.col("risk_level"), F.col("anomalies"), F.col("rul_median")))


def recommendations(analysis: DataFrame) -> DataFrame:
    return analysis.select("machineID", F.posexplode("recommendations").alias("position", "recommendation"))


def band_recommendations(df: DataFrame) -> DataFrame:
    health = F.col("global_health_score")
    chosen = None
    for limit, texts in BAND_RECOMMENDATIONS:
        if limit is None:
            chosen = chosen.otherwise(_texts(texts))
        else:
            chosen = F.when(health < limit, _texts(texts)) if chosen is None else chosen.when(health < limit, _texts(texts))
    return df.select("machineID", F.posexplode(chosen).alias("position", "recommendation"))


def dossier(analysis: DataFrame, machine_ids: DataFrame | None = None) -> DataFrame:
    """Nested dossier per machine; requested ids that the fleet does not know get defaults."""
    rows = analysis
    if machine_ids is not None:
        known = analysis.withColumn("_known", F.lit(True))
        rows = machine_ids.select("machineID").distinct().join(known, "machineID", "left")
    else:
        rows = rows.withColumn("_known", F.lit(True))
    known = F.col("_known").isNotNull()

    def value(column: Column, default, digits: int | None = None) -> Column:
        column = column if digits is None else half_even(column, digits)
        return F.when(known, column).otherwise(F.lit(default))

    col, unknown = F.col, UNKNOWN_MACHINE
    no_anomalies = F.array().cast(dict(analysis.dtypes)["anomalies"])
    return rows.select(
        "machineID",
        F.struct(col("machineID").alias("machine_id"), value(col("model"), unknown["model"]).alias("model"),
                 value(col("age").cast("int"), 0).alias("age"),
                 value(col("failure_pattern").cast("int"), 0).alias("pattern_failure")).alias("identification"),
        F.struct(value(col("global_health_score"), unknown["score"], 1).alias("score_global"),
                 value(col("vibration_score"), unknown["score"], 1).alias("sante_mecanique"),
                 value(col("pressure_score"), unknown["score"], 1).alias("sante_pression")).alias("sante_globale"),
        F.struct(value(col("risk_level"), unknown["risk_level"]).alias("risk_level"),
                 value(col("confidence"), unknown["confidence"]).alias("confidence"),
                 col("probabilities")).alias("prediction_risque"),
        F.struct(value(col("rul_median"), unknown["rul_median"]).alias("rul_median"),
                 value(col("survival_30d"), unknown["survival_30d"]).alias("survival_30d"),
                 value(col("survival_90d"), unknown["survival_90d"]).alias("survival_90d"),
                 col("current_survival_time")).alias("estimation_rul"),
        F.when(known, col("anomalies")).otherwise(no_anomalies).alias("anomalies_detectees"),
        F.when(known, col("recommendations")).otherwise(_texts([unknown["recommendation"]]))
        .alias("recommandations_maintenance"),
        F.struct(value(col("vibration"), 0.0, 1).alias("vibration"), value(col("pressure"), 0.0, 1).alias("pression"),
                 value(col("rotate"), 0.0, 1).alias("rotation"),
                 value(col("error_count").cast("long"), 0).alias("erreurs_cumulees"),
                 value(col("maint_count").cast("long"), 0).alias("maintenances_realisees"))
        .alias("indicateurs_techniques"))


def context_string() -> Column:
    """One-line summary of a dossier row; sections without a value are skipped."""
    risk_part = F.format_string(
        "Niveau risque: %s (confiance: %.1f%%)", F.col("prediction_risque.risk_level"),
        half_even(F.coalesce(F.col("prediction_risque.confidence"), F.lit(0.0)) * 100, 1))
    rul = F.coalesce(F.format_string("%.1f", F.col("estimation_rul.rul_median")), F.lit("N/A"))
    health = F.coalesce(F.format_string("%.1f", F.col("sante_globale.score_global")), F.lit("N/A"))
    return F.concat_ws(
        " | ",
        F.when(F.col("identification").isNotNull(), F.format_string(
            "Machine: %s - Modèle: %s", F.col("identification.machine_id").cast("string"),
            F.coalesce(F.col("identification.model"), F.lit("N/A")))),
        F.when(F.col("sante_globale").isNotNull(), F.concat(F.lit("Score santé: "), health, F.lit("/100"))),
        F.when(F.col("prediction_risque").isNotNull(), risk_part),
        F.when(F.col("estimation_rul").isNotNull(), F.concat(F.lit("RUL médian: "), rul, F.lit(" jours"))))
