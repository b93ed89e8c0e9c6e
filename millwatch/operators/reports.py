"""Report datasets: every report is a table of ordered text lines with its source figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from millwatch.functions.numeric import half_even
from millwatch.operators import alerts as alerting, fleet
from millwatch.operators.dossier import context_string

# Titles, texts and figures of the reports.

RULE = "=" * 80
THIN_RULE = "-" * 40
COMPANY = "Entreprise Industrielle"

EXECUTIVE_TITLE = "RAPPORT EXÉCUTIF - MAINTENANCE PRÉDICTIVE"
MAINTENANCE_TITLE = "RAPPORT MAINTENANCE OPÉRATIONNEL"
TECHNICAL_TITLE = "RAPPORT TECHNIQUE - PERFORMANCE MODÈLES"

STRATEGIC_RECOMMENDATIONS = (
    "Déployer le système d'alertes sur l'ensemble du parc critique",
    "Former les équipes maintenance à l'utilisation des prédictions RUL",
    "Réallouer 15% du budget maintenance curative vers la maintenance prédictive",
    "Mettre en place un tableau de bord temps réel pour le suivi des KPIs",
    "Étendre l'analyse prédictive aux nouveaux modèles de machines",
)
HIGH_ROI_RECOMMENDATION = "Augmenter l'investissement ML de 20% pour étendre la couverture"
HIGH_ROI_PERCENT = 200

TECHNICAL_RECOMMENDATIONS = (
    "Implémenter la validation croisée imbriquée pour une meilleure estimation des performances",
    "Ajouter des features temporelles (moyennes mobiles, tendances) pour capturer l'évolution",
    "Tester XGBoost et LightGBM en benchmark contre Random Forest",
    "Implémenter l'optimisation bayésienne des hyperparamètres",
    "Ajouter l'analyse de incertitude des prédictions RUL",
)
LOW_AUC_RECOMMENDATION = ("Améliorer le classifieur avec des techniques de ré-échantillonnage "
                          "pour les classes déséquilibrées")
LOW_AUC = 0.85

CRITICAL_INSTRUCTIONS = ("Intervenir sur les %d machines CRITIQUES dans les 48h",
                         "Préparer équipe d'intervention rapide avec pièces critiques")
HIGH_INSTRUCTION = "Planifier maintenance des %d machines HAUTE priorité cette semaine"
STANDING_INSTRUCTIONS = ("Mettre à jour le stock de pièces détachées basé sur le calendrier",
                         "Documenter toutes les interventions pour amélioration des modèles")

PROJECTION_M6, PROJECTION_M12 = 1.5, 1.15
FIXED_PROJECTIONS = (("Réduction temps d'arrêt", "-45% vs année précédente"),
                     ("Amélioration santé parc", "+12% vs baseline actuelle"))

KPI_LABELS = {
    "fleet": "Parc total", "health": "Santé moyenne", "critical": "Machines critiques",
    "savings": "Économies annuelles", "roi": "ROI maintenance prédictive",
    "downtime": "Temps d'arrêt évité", "maintenance": "Coût maintenance moyen",
}
ROI_LABELS = {
    "investment": "Investissement ML", "savings": "Économies annuelles", "payback": "Période de retour",
    "three_years": "Bénéfice net 3 ans", "annual": "ROI annuel",
}
PROJECTION_LABELS = ("Économies projetées (M+6)", "Économies projetées (M+12)")
RISK_LINE = "Machine %s (%s) - RUL: %sj - Risque: ÉLEVÉ"
ALERT_CARD = ("  🚨 Machine %s (%s)", "     • RUL: %s jours", "     • Santé: %s/100", "     • Risque: N/A",
              "     • Deadline: %s", "     • Action: %s")
LEVEL_LINE = "  %s: %d machines"
CALENDAR_LINE = "  • Machine %s - %s\n    RUL: %sj | Deadline: %s"
PART_LINE = "  %s: %s unités - %s"
QUALITY_LINES = ("  Valeurs manquantes: %d", "  Types de données: %d colonnes")
PACK_LINE = "- Machine %s | Modèle: %s | Santé: %s | ProbFail: %s"
PACK_TITLE, PACK_TOP, PACK_ECONOMICS = "Decision Pack - Maintenance Prédictive", "Top 5 Machines à Risque:", "Résumé Economique:"

EXECUTIVE_SECTIONS = {
    "kpi": "📊 TABLEAU DE BORD STRATÉGIQUE", "roi": "💰 ANALYSE FINANCIÈRE", "risk": "🔴 RISQUES CRITIQUES",
    "strategy": "✅ RECOMMANDATIONS STRATÉGIQUES", "projection": "📈 PROJECTIONS 12 MOIS",
}
MAINTENANCE_SECTIONS = {
    "levels": "🚨 ALERTES ACTIVES PAR NIVEAU DE PRIORITÉ", "critical": "🔴 ALERTES CRITIQUES - ACTION IMMÉDIATE",
    "calendar": "📅 CALENDRIER MAINTENANCE - 4 SEMAINES", "parts": "🔧 BESOINS EN PIÈCES DÉTACHÉES",
    "instruction": "⚡ INSTRUCTIONS OPÉRATIONNELLES",
}
TECHNICAL_SECTIONS = {
    "models": "🤖 PERFORMANCE MODÈLES ML", "classifier": "📊 CLASSIFICATEUR (Prédiction Panne)",
    "regressor": "📈 RÉGRESSEUR RUL (Durée de Vie Restante)", "features": "🎯 IMPORTANCE DES VARIABLES",
    "quality": "📋 QUALITÉ DES DONNÉES", "recommendation": "💡 RECOMMANDATIONS TECHNIQUES",
}

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

TECHNICAL_PROMPT = """Génère un rapport technique détaillé en français.

ANALYSE EFFECTUÉE:
{analysis_details}

PERFORMANCE MODÈLES:
{model_performance}

STATISTIQUES:
{statistics}

STRUCTURE:
1. Méthodologie d'analyse
2. Performance des modèles ML
3. Insights techniques
4. Limitations
5. Améliorations recommandées

Public: Data Scientists et ingénieurs ML"""

NO_METRICS = "Aucune métrique disponible"


def _decimals(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", half_even(value, digits))


def _whole(value: Column) -> Column:
    return F.format_number(half_even(value, 0), 0)


def _rows(df: DataFrame, section: str, entries: list[tuple[str, Column]]) -> DataFrame:
    """One-row figures to ``(section, position, key, value)`` rows."""
    return df.select(F.posexplode(F.array(*[
        F.struct(F.lit(key).alias("key"), value.alias("value")) for key, value in entries])).alias("position", "e")
    ).select(F.lit(section).alias("section"), (F.col("position") + 1).alias("position"), "e.key", "e.value")


def _attach(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row aggregates side by side without joining them."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def executive_kpis(fleet_rows: DataFrame, economics: DataFrame, alert_rows: DataFrame,
                   downtime_hours_saved: float = 0, average_maintenance_cost: float = 0) -> DataFrame:
    size = fleet_rows.agg(F.count_distinct("machineID").alias("machines"),
                          F.avg("global_health_score").alias("health"))
    critical = alert_rows.agg(F.count_if(F.col("alert_level") == "CRITIQUE").alias("critical"))
    all_ = _attach(_attach(size, critical), economics)
    share = F.coalesce(F.try_divide(F.col("critical"), F.col("machines")) * 100, F.lit(0.0))
    return _rows(all_, "kpi", [
        (KPI_LABELS["fleet"], F.format_string("%d machines", "machines")),
        (KPI_LABELS["health"], F.concat(_decimals(F.col("health")), F.lit("/100"))),
        (KPI_LABELS["critical"], F.format_string("%d (%s%%)", F.col("critical"), _decimals(share))),
        (KPI_LABELS["savings"], F.concat(_whole(F.col("total_fleet_savings")), F.lit(" €"))),
        (KPI_LABELS["roi"], F.concat(_decimals(F.col("total_roi_percent")), F.lit("%"))),
        (KPI_LABELS["downtime"], F.lit(f"{downtime_hours_saved:.0f} h/an")),
        (KPI_LABELS["maintenance"], F.lit(f"{average_maintenance_cost:,.0f} €/machine"))])


def roi_analysis(economics: DataFrame) -> DataFrame:
    savings, invested = F.col("total_fleet_savings"), F.col("total_ml_investment")
    payback = F.when(savings > 0, invested / savings * 12).otherwise(0.0)
    annual = F.when(invested > 0, savings / invested * 100).otherwise(0.0)
    return _rows(economics, "roi", [
        (ROI_LABELS["investment"], F.concat(_whole(invested), F.lit(" €"))),
        (ROI_LABELS["savings"], F.concat(_whole(savings), F.lit(" €"))),
        (ROI_LABELS["payback"], F.concat(_decimals(payback), F.lit(" mois"))),
        (ROI_LABELS["three_years"], F.concat(_whole(savings * 3 - invested), F.lit(" €"))),
        (ROI_LABELS["annual"], F.concat(_decimals(annual), F.lit("%")))])


def projections(economics: DataFrame) -> DataFrame:
    savings = F.col("total_fleet_savings")
    return _rows(economics, "projection", [
        (PROJECTION_LABELS[0], F.concat(_whole(savings * PROJECTION_M6), F.lit(" €"))),
        (PROJECTION_LABELS[1], F.concat(_whole(savings * PROJECTION_M12), F.lit(" €"))),
        *[(key, F.lit(text)) for key, text in FIXED_PROJECTIONS]])


def critical_risks(alert_rows: DataFrame, limit: int = 10) -> DataFrame:
    """The first critical machines as numbered lines."""
    first = alerting.critical(alert_rows, limit)
    packed = first.agg(F.sort_array(F.collect_list(F.struct(
        "priority", (-F.col("prob_failure")).alias("order"), "machine_id", "model", "rul_days"))).alias("risks"))
    numbered = packed.select(F.posexplode("risks").alias("position", "r"))
    line = F.format_string(RISK_LINE, F.col("r.machine_id").cast("string"),
                           F.col("r.model"), _decimals(F.col("r.rul_days")))
    return numbered.select(F.lit("risk").alias("section"), (F.col("position") + 1).alias("position"),
                           F.col("r.machine_id").alias("machine_id"), line.alias("line"))


def _numbered(df: DataFrame, section: str, texts: list[Column]) -> DataFrame:
    """Texts of a one-row table as numbered rows, those that do not apply left out."""
    return df.select(F.posexplode(F.array_compact(F.array(*texts))).alias("position", "line")).select(
        F.lit(section).alias("section"), (F.col("position") + 1).alias("position"), "line")


def strategic_recommendations(economics: DataFrame) -> DataFrame:
    return _numbered(economics, "strategy", [
        *[F.lit(t) for t in STRATEGIC_RECOMMENDATIONS],
        F.when(F.col("total_roi_percent") > HIGH_ROI_PERCENT, F.lit(HIGH_ROI_RECOMMENDATION))])


def instructions(alert_rows: DataFrame) -> DataFrame:
    """Operational instructions that depend on the number of critical and high alerts."""
    counts = alert_rows.agg(F.count_if(F.col("alert_level") == "CRITIQUE").alias("critical"),
                            F.count_if(F.col("alert_level") == "HAUTE").alias("high"))
    critical, high = F.col("critical"), F.col("high")
    return _numbered(counts, "instruction", [
        F.when(critical > 0, F.format_string(CRITICAL_INSTRUCTIONS[0], critical)),
        F.when(critical > 0, F.lit(CRITICAL_INSTRUCTIONS[1])),
        F.when(high > 0, F.format_string(HIGH_INSTRUCTION, high)),
        *[F.lit(t) for t in STANDING_INSTRUCTIONS]])


def technical_recommendations(metrics: DataFrame) -> DataFrame:
    classifier = F.col("model") == "classifier"
    auc = metrics.agg(F.max(F.when(classifier & (F.col("metric") == "auc_roc"), F.col("value"))).alias("auc"),
                      F.count_if(classifier).alias("n"))
    weak = (F.col("n") > 0) & (F.coalesce("auc", F.lit(0.0)) < LOW_AUC)
    return _numbered(auc, "recommendation", [
        *[F.lit(t) for t in TECHNICAL_RECOMMENDATIONS], F.when(weak, F.lit(LOW_AUC_RECOMMENDATION))])


def header(df: DataFrame, title: str, as_of: datetime | str, company: str = COMPANY) -> DataFrame:
    spark = df.sparkSession
    lines = [RULE, title, company, f"Date: {str(as_of)[:19]}", RULE]
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(lines)], "position int, line string")


class _Report:
    """Collects sections into one table ``(block, position, line)``; order by both to read it."""

    def __init__(self, first: DataFrame):
        self.rows = first.select(F.lit(0).alias("block"), "position", "line")
        self.block = 0

    def add(self, title: str, lines: DataFrame, rule: str = RULE) -> None:
        self.block += 1
        heads = lines.sparkSession.createDataFrame(
            [(self.block, -2, "\n" + title), (self.block, -1, rule)], "block int, position int, line string")
        body = lines.select(F.lit(self.block).alias("block"), F.col("position").cast("int").alias("position"), "line")
        self.rows = self.rows.unionByName(heads).unionByName(body)


def _key_lines(rows: DataFrame) -> DataFrame:
    return rows.select("position", F.format_string("  %s: %s", "key", "value").alias("line"))


def _numbered_lines(rows: DataFrame) -> DataFrame:
    return rows.select("position", F.format_string("  %d. %s", "position", "line").alias("line"))


def executive_report(fleet_rows: DataFrame, economics: DataFrame, alert_rows: DataFrame,
                     as_of: datetime | str, company: str = COMPANY) -> DataFrame:
    report = _Report(header(fleet_rows, EXECUTIVE_TITLE, as_of, company))
    report.add(EXECUTIVE_SECTIONS["kpi"], _key_lines(executive_kpis(fleet_rows, economics, alert_rows)))
    report.add(EXECUTIVE_SECTIONS["roi"], _key_lines(roi_analysis(economics)))
    report.add(EXECUTIVE_SECTIONS["risk"], _numbered_lines(critical_risks(alert_rows, 5)))
    report.add(EXECUTIVE_SECTIONS["strategy"], _numbered_lines(strategic_recommendations(economics)))
    report.add(EXECUTIVE_SECTIONS["projection"], _key_lines(projections(economics)))
    return report.rows


def _alert_card() -> Column:
    return F.concat_ws(
        "\n",
        F.format_string(ALERT_CARD[0], F.col("machine_id").cast("string"), F.col("model")),
        F.format_string(ALERT_CARD[1], _decimals(F.col("rul_days"))),
        F.format_string(ALERT_CARD[2], _decimals(F.col("health_score"))),
        F.lit(ALERT_CARD[3]),
        F.format_string(ALERT_CARD[4], "maintenance_deadline"),
        F.format_string(ALERT_CARD[5], "recommended_action"))


def maintenance_sections(alert_rows: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Rows ``(section, major, minor, line)`` of the operational report, section by section.

    ``parts`` is an optional inventory ``(position, part, quantity, urgency)``, reported by position.
    """
    levels = alerting.nonzero_levels(alert_rows).select(
        F.lit("levels").alias("section"), F.col("priority").alias("major"), F.lit(0).alias("minor"),
        F.format_string(LEVEL_LINE, "alert_level", "alerts").alias("line"))
    cards = alerting.critical(alert_rows, 15).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("prob_failure")).alias("order"), "machine_id", _alert_card().alias("line")))).alias("cards"))
    critical = cards.select(F.posexplode("cards").alias("minor", "card")).select(
        F.lit("critical").alias("section"), F.lit(0).alias("major"), (F.col("minor") + 1).alias("minor"),
        F.col("card.line").alias("line"))
    calendar = alerting.calendar_top(alert_rows).select(
        F.lit("calendar").alias("section"), F.col("week").alias("major"), F.col("position").alias("minor"),
        F.format_string(CALENDAR_LINE, F.col("machine_id").cast("string"),
                        F.col("model"), _decimals(F.col("rul_days")), F.col("maintenance_deadline")).alias("line"))
    orders = instructions(alert_rows).select(
        F.lit("instruction").alias("section"), F.lit(0).alias("major"), F.col("position").alias("minor"),
        F.format_string("  %d. %s", "position", "line").alias("line"))
    out = levels.unionByName(critical).unionByName(calendar).unionByName(orders)
    if parts is not None:
        out = out.unionByName(parts.select(
            F.lit("parts").alias("section"), F.lit(0).alias("major"), F.col("position").cast("int").alias("minor"),
            F.format_string(PART_LINE, "part", F.col("quantity").cast("string"), "urgency").alias("line")))
    return out


def maintenance_report(alert_rows: DataFrame, as_of: datetime | str, parts: DataFrame | None = None,
                       company: str = COMPANY) -> DataFrame:
    rows = maintenance_sections(alert_rows, parts)
    weeks = rows.where("section = 'calendar' AND minor = 1").select(
        F.lit("calendar").alias("section"), "major", F.lit(0).alias("minor"),
        F.concat(F.lit("\nSEMAINE_"), F.col("major").cast("string"), F.lit(":")).alias("line"))
    rows = rows.unionByName(weeks)
    report = _Report(header(alert_rows, MAINTENANCE_TITLE, as_of, company))
    for section, title in MAINTENANCE_SECTIONS.items():
        if section == "parts" and parts is None:
            continue
        report.add(title, rows.where(F.col("section") == section).select(
            (F.col("major") * 100 + F.col("minor")).alias("position"), "line"))
    return report.rows


def technical_sections(metrics: DataFrame, importance_top: DataFrame, quality: DataFrame) -> DataFrame:
    """Rows ``(section, major, minor, line)`` from metrics, top features and the quality summary.

    Per-class figures of the classifier are reported as the weighted average.
    """
    shown = (("accuracy", "precision", "accuracy", 1), ("precision", "precision", "weighted avg", 2),
             ("recall", "recall", "weighted avg", 3), ("f1_score", "f1", "weighted avg", 4))
    number = _decimals(F.col("value"), 3)
    title = F.initcap(F.replace(F.col("name"), F.lit("_"), F.lit(" ")))
    picked = None
    for name, metric, scope, place in shown:
        part = metrics.where((F.col("model") == "classifier") & (F.col("metric") == metric) & (F.col("label") == scope)
                             ).select(F.lit(name).alias("name"), F.lit(place).alias("minor"), "value")
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.unionByName(metrics.where("model = 'classifier' AND metric = 'auc_roc'").select(
        F.lit("auc_roc").alias("name"), F.lit(5).alias("minor"), "value"))
    classifier = picked.select(F.lit("classifier").alias("section"), F.lit(0).alias("major"), "minor",
                               F.format_string("  %s: %s", title, number).alias("line"))
    order = F.when(F.col("metric") == "mae", 1).when(F.col("metric") == "rmse", 2).otherwise(3)
    regressor = metrics.where((F.col("model") == "regressor") & F.col("metric").isin("mae", "rmse", "r2")).select(
        F.lit("regressor").alias("section"), F.lit(0).alias("major"), order.alias("minor"),
        F.format_string("  %s: %s", F.upper("metric"), number).alias("line"))
    features = importance_top.select(
        F.lit("features").alias("section"), F.when(F.col("model") == "classifier", 0).otherwise(1).alias("major"),
        F.col("position").alias("minor"),
        F.format_string("  %s: %s", F.col("feature"), _decimals(F.col("importance"), 3)).alias("line"))
    data = quality.select(F.posexplode(F.array(
        F.format_string(QUALITY_LINES[0], "total_missing"),
        F.format_string(QUALITY_LINES[1], "columns"))).alias("minor", "line")).select(
        F.lit("quality").alias("section"), F.lit(0).alias("major"), (F.col("minor") + 1).alias("minor"), "line")
    advice = technical_recommendations(metrics).select(
        "section", F.lit(0).alias("major"), F.col("position").alias("minor"),
        F.format_string("  %d. %s", "position", "line").alias("line"))
    return classifier.unionByName(regressor).unionByName(features).unionByName(data).unionByName(advice)


def technical_report(metrics: DataFrame, importance_top: DataFrame, quality: DataFrame,
                     as_of: datetime | str, company: str = COMPANY) -> DataFrame:
    rows = technical_sections(metrics, importance_top, quality)
    heads = importance_top.where("position = 1").select(
        F.lit("features").alias("section"), F.when(F.col("model") == "classifier", 0).otherwise(1).alias("major"),
        F.lit(0).alias("minor"), F.concat(F.lit("\n"), F.upper("model"), F.lit(":")).alias("line"))
    rows = rows.unionByName(heads)
    report = _Report(header(metrics, TECHNICAL_TITLE, as_of, company))
    for section, title in TECHNICAL_SECTIONS.items():
        if section == "models":
            continue
        if section == "classifier":
            title = f"{TECHNICAL_SECTIONS['models']}\n{RULE}\n\n{title}"
        rule = THIN_RULE if section in ("classifier", "regressor") else RULE
        report.add(title, rows.where(F.col("section") == section).select(
            (F.col("major") * 100 + F.col("minor")).alias("position"), "line"), rule)
    return report.rows


def decision_pack(fleet_rows: DataFrame, economics: DataFrame, probability: str | None = None) -> DataFrame:
    """Lines of the decision pack: the five machines in worst health, then the economic totals."""
    shown = (F.format_string("%.2f", half_even(F.col(probability), 2)) if probability else F.lit("N/A"))
    worst = fleet.lowest_health(fleet_rows, 5).select(
        "global_health_score", "machineID", F.format_string(
            PACK_LINE, F.col("machineID").cast("string"),
            F.coalesce("model", F.lit("?")), _decimals(F.col("global_health_score"), 2), shown).alias("line"))
    machines = worst.agg(F.sort_array(F.collect_list(F.struct("global_health_score", "machineID", "line"))).alias("w"))
    top = machines.select(F.posexplode("w").alias("position", "w")).select(
        F.lit("top5").alias("section"), (F.col("position") + 1).alias("position"), F.col("w.line").alias("line"))
    entries = [("total_fleet_savings", 2), ("total_ml_investment", 2), ("total_net_benefit", 2), ("total_roi_percent", 1)]
    totals = _rows(economics, "economics", [
        *[(name, _decimals(F.col(name), digits)) for name, digits in entries],
        ("fleet_size", F.col("fleet_size").cast("string"))]).select(
        "section", "position", F.format_string("- %s: %s", "key", "value").alias("line"))
    return top.unionByName(totals)


def decision_pack_lines(pack: DataFrame, as_of: datetime | str) -> DataFrame:
    """The pack as ordered text lines, ready for ``sinks.write_lines``."""
    spark = pack.sparkSession
    fixed = spark.createDataFrame(
        [(0, 0, PACK_TITLE), (0, 1, f"Date: {as_of}"), (0, 2, ""),
         (1, 0, PACK_TOP), (2, -1, ""), (2, 0, PACK_ECONOMICS)],
        "block int, position int, line string")
    block = F.when(F.col("section") == "top5", 1).otherwise(2)
    return fixed.unionByName(pack.select(block.alias("block"), "position", "line"))


def _fill(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def machine_prompts(dossiers: DataFrame, economics: DataFrame, kpis: DataFrame) -> DataFrame:
    """Executive prompt per machine: its context line and the figures of the whole fleet.

    ``kpis`` is the one-row result of ``fleet_kpis``.
    """
    figures = _attach(kpis, economics).first()
    health = F.lit(None if figures["avg_health"] is None else float(figures["avg_health"]))
    return dossiers.select("machineID", _fill(EXECUTIVE_PROMPT, {
        "context": context_string(), "total_machines": F.lit(str(figures["machines"])),
        "critical_machines": F.lit(str(figures["critical_machines"])),
        "avg_health": F.coalesce(_decimals(health), F.lit("0")),
        "roi_percent": _decimals(F.lit(float(figures["total_roi_percent"])))}).alias("prompt"))


def technical_prompt(metrics: DataFrame, statistics: DataFrame) -> DataFrame:
    """Technical prompt of the fleet as one row, from the long metrics and ``fleet_statistics``."""
    def one(model, metric, label=None):
        rule = (F.col("model") == model) & (F.col("metric") == metric)
        return F.max(F.when(rule & (F.col("label") == label) if label else rule, F.col("value")))

    figures = metrics.agg(
        one("classifier", "precision", "accuracy").alias("accuracy"),
        one("classifier", "precision", "weighted avg").alias("precision"),
        one("classifier", "recall", "weighted avg").alias("recall"),
        one("regressor", "mae").alias("mae"), one("regressor", "r2").alias("r2"))
    both = _attach(figures, statistics)

    def percent(name):
        return F.concat(_decimals(F.coalesce(name, F.lit(0.0)) * 100, 2), F.lit("%"))

    details = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), percent(name)) for label, name in (
        ("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"))])
    performance = F.coalesce(F.concat(F.lit("regressor: MAE="), _decimals(F.col("mae"), 2), F.lit(", R²="),
                                      _decimals(F.col("r2"), 2)), F.lit(NO_METRICS))
    rate = F.coalesce("failure_rate", F.lit(0.0))
    stats = F.concat(
        F.lit("\n        Machines totales: "), F.col("total_machines").cast("string"),
        F.lit("\n        Pannes détectées: "),
        half_even(rate * F.col("total_machines") / 100, 0).cast("long").cast("string"),
        F.lit("\n        Taux de défaillance: "), _decimals(rate, 2), F.lit("%"),
        F.lit("\n        Santé moyenne: "), _decimals(F.coalesce("avg_health", F.lit(0.0))), F.lit("/100\n        "))
    return both.select(_fill(TECHNICAL_PROMPT, {
        "analysis_details": details, "model_performance": performance, "statistics": stats}).alias("prompt"))


PROMPTS = {"executive": EXECUTIVE_PROMPT, "technical": TECHNICAL_PROMPT}


def prompt_template(report_type: str) -> str:
    """Template of a report type; an unknown type reads as executive."""
    return PROMPTS.get(report_type, EXECUTIVE_PROMPT)
