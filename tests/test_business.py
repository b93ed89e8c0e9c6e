"""Economics, fleet overview, dossiers and report texts."""

import pytest
from pyspark.sql import functions as F

from millwatch.config import Economics
from millwatch.functions import risk
from millwatch.operators import alerts, dossier, economics, features, fleet, reports, survival
from millwatch.plans import catalogue
from millwatch.sources import sinks

AS_OF = "2024-06-01 00:00:00"
FLEET = "machineID long, model string, age int, time double, event int, volt double, rotate double, " \
        "pressure double, vibration double, error_count long, maint_count long"
ROWS = [
    (1, "model1", 2, 5.0, 1, 170.0, 450.04, 100.0, 38.0, 10, 20), (2, "model2", 18, 40.0, 1, 170.0, 450.0, 90.0, 46.26, 45, 2),
    (3, "model3", 10, 12.0, 1, 170.0, 450.0, 108.0, 41.0, 31, 10), (4, "other", 1, 25.0, 0, 170.0, 450.0, 100.0, 36.0, 1, 30),
    (5, None, 3, 100.0, 1, 170.0, 450.0, 101.0, 37.0, 3, 30), (6, "model2", 20, 3.0, 1, 170.0, 450.0, 60.0, 90.0, 50, 0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, FLEET).cache()


@pytest.fixture(scope="module")
def health(rows):
    return features.health_features(rows)


def test_machine_economics(health):
    got = {r.machineID: r for r in economics.machine_economics(health).collect()}
    assert (got[2].cost_unplanned_downtime, got[2].potential_savings, got[2].savings_percent, got[2].priority) == (
        4500, 4300, 95.6, "HAUTE")
    assert got[4].cost_unplanned_downtime == got[5].cost_unplanned_downtime == 4000


def test_fleet_risk_counts_levels_told_from_all_readings(spark, rows, health, monkeypatch):
    """Vibration and errors raise a machine's level, not its health alone."""
    monkeypatch.setattr(catalogue, "_fleet", lambda *_: rows)
    got = {r.risk_level: r.machines for r in catalogue.QUERIES["fleet_risk_distribution"](spark, "").collect()}
    count = lambda level: {r[0]: r[1] for r in health.groupBy(level).count().collect()}
    assert got == count(F.col("risk_level")) != count(risk.risk_from_health(F.col("global_health_score")))


def test_fleet_risk_counts_the_levels_of_dossiers_too(spark, rows, monkeypatch):
    """Every machine counts at the level of its readings and at that of its dossier, machines with equal or no ids too."""
    more = [(7, "model1", 5, 9.0, 1, 170.0, 450.0, 100.0, 46.0, 0, 3), (None, "model1", 5, 9.0, 0, None, None, None, None, None, None)]
    known = rows.unionByName(spark.createDataFrame([*more, *more], FLEET))
    monkeypatch.setattr(catalogue, "_fleet", lambda *_: known)
    got = {r.risk_level: r for r in catalogue.QUERIES["fleet_risk_distribution"](spark, "").collect()}
    told = {r[0]: r[1] for r in features.health_features(known).groupBy("risk_level").count().collect()}
    assert {k: r.machines for k, r in got.items()} == told and sum(told.values()) == 10
    health = features.raw_health_features(known).select(risk.risk_from_health(F.col("global_health_score")).alias("level"))
    analysed = {r[0]: r[1] for r in health.groupBy("level").count().collect()}
    levels = {name: sum(r[f"dossiers_{short}"] for r in got.values()) for short, name in fleet.LEVELS.items()}
    assert {k: v for k, v in levels.items() if v} == analysed != told
    assert all(r.machines == sum(r[f"dossiers_{short}"] for short in fleet.LEVELS) for r in got.values())


def test_economics_settings(spark):
    df = spark.createDataFrame([("a",), ("b",)], "model string")
    cheap = Economics(hourly_downtime_cost=100, emergency_repair_cost=0, downtime_hours={"a": 1.0}, default_downtime_hours=15)
    savings = {r.model: r for r in economics.roi_by_model(df, cheap).collect()}
    assert (savings["a"].annual_savings, savings["a"].payback_months, savings["a"].roi_percent) == (0, 12, -100)
    assert savings["b"].annual_savings == 2600
    free = economics.roi_by_model(df, Economics(investment_per_machine=0)).first()
    assert free.roi_percent == 0 and free.payback_months == 0
    profile = df.withColumns({"machineID": F.lit(1), "global_health_score": F.lit(50.0)})
    levels = [economics.machine_economics(profile, Economics(
        hourly_downtime_cost=0, emergency_repair_cost=200.0 + s)).first().priority for s in (1000, 1001, 2000, 2001)]
    assert levels == ["BASSE", "MOYENNE", "MOYENNE", "HAUTE"]


def test_fleet_economics(rows):
    r = economics.fleet_economics(rows).first()
    # the machine without a model counts in the fleet size only
    assert (r.total_fleet_savings, r.total_ml_investment, r.total_net_benefit, r.total_roi_percent, r.fleet_size) == (
        6600 + 2 * 8600 + 7600 + 7600, 500, 38500, 7700.0, 6)
    nothing = economics.fleet_economics(rows.where(F.lit(False))).first()
    assert (nothing.total_fleet_savings, nothing.total_roi_percent, nothing.fleet_size) == (0, 0, 0)


def test_kpis_and_ranges(health):
    r = fleet.fleet_kpis(health).first()
    assert r.machines == 6 and r.avg_survival_30 is None and r.failure_rate == pytest.approx(500 / 6)
    stats = fleet.health_range_stats(health, 80, 100).first()
    inside = [x.global_health_score for x in health.collect() if x.global_health_score >= 80]
    assert (stats.machines, stats.fleet, stats.min) == (len(inside), 6, min(inside))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (99.99,), (100 / 15,), (None,)], "global_health_score double")
    assert {r.bin: r.machines for r in fleet.health_histogram(df).collect()} == {1: 1, 2: 1, 15: 2}


def test_quartiles_by_group(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 7.0), (None, 5.0)], "g string, global_health_score double")
    got = {r.group: (r.machines, r.min, r.q25, r.q50, r.q75, r.max) for r in fleet.health_quartiles(df, "g").collect()}
    assert got == {"a": (4, 1, 1.75, 2.5, 3.25, 4), "b": (1, 7, 7, 7, 7, 7), None: (1, 5, 5, 5, 5, 5)}


def test_rankings_and_lookups(spark, health):
    worst = [r.machineID for r in fleet.lowest_health(health, 2).collect()]
    assert worst == [r.machineID for r in health.orderBy("global_health_score", "machineID").limit(2).collect()]
    assert {r.machineID for r in fleet.machine_lookup(health, [1, 99]).collect()} == {1}
    assert fleet.machine_lookup(health, spark.createDataFrame([(2,), (2,)], "machineID long")).count() == 1
    detail = fleet.machine_detail(health).collect()
    assert [r.global_health_score for r in detail] == sorted((r.global_health_score for r in detail), reverse=True)
    shown = fleet.recent_alerts(health, below=60).collect()
    assert shown[0].machine == "Machine 2" and shown[0].model == "model2 (Label: A)" and shown[0].predicted_rul == "N/A"
    with pytest.raises(ValueError):
        fleet.health_trend(health)
    assert fleet.machine_metrics(spark.createDataFrame([(1, 4.0), (1, 6.0)], "machineID long, vibration double")).first().vibration == 5


def test_transposed_heatmap(health):
    flat = {r.model: r for r in fleet.risk_heatmap(health, "model").collect()}
    for r in fleet.risk_heatmap_transposed(health, "model").collect():
        assert r["model2"] == flat["model2"][r.metric]


def test_anomalies(rows):
    found = {}
    for r in dossier.anomalies(rows).orderBy("machineID").collect():
        found.setdefault(r.machineID, []).append((r.type, r.severity, r.message))
    assert found == {
        2: [("VIBRATION_ÉLEVÉE", "HAUTE", "Vibration élevée: 46.3"), ("PRESSION_ANORMALE", "MOYENNE", "Pression anormale: 90.0"),
            ("ERREURS_EXCESSIVES", "HAUTE", "Erreurs excessives: 45")],
        3: [("PRESSION_ANORMALE", "MOYENNE", "Pression anormale: 108.0")],
        6: [("VIBRATION_ÉLEVÉE", "HAUTE", "Vibration élevée: 90.0"), ("PRESSION_ANORMALE", "MOYENNE", "Pression anormale: 60.0"),
            ("ERREURS_EXCESSIVES", "HAUTE", "Erreurs excessives: 50")]}


@pytest.mark.parametrize("pressure, vibration, errors, count", [(95.0, 45.0, 40, 0), (105.0, 45.01, 40, 1), (94.99, 45.0, 41, 2), (None, None, None, 0)])
def test_anomaly_limits(spark, pressure, vibration, errors, count):
    df = spark.createDataFrame([(1, pressure, vibration, errors)], "machineID long, pressure double, vibration double, error_count long")
    assert dossier.anomalies(df).count() == count


@pytest.fixture(scope="module")
def analysis(rows):
    return dossier.analysed(features.raw_health_features(rows), survival.rul_estimates(rows))


def test_recommendations(analysis):
    lists = {r.machineID: r.recommendations for r in analysis.collect()}
    assert lists[1] == ["Maintenance à 60 jours", "Surveillance normale", "Opérations standards", "RUL faible - Intervention urgente"]
    assert lists[6][:3] == ["Maintenance immédiate requise", "Inspection complète des composants", "Arrêt recommandé si possible"]
    assert lists[6][3:6] == ["Vérifier équilibrage", "Contrôler régulateur", "Analyser logs"]


def test_dossier(spark, analysis):
    wanted = spark.createDataFrame([(2,), (77,)], "machineID long")
    known, unknown = dossier.dossier(analysis, wanted).orderBy("machineID").collect()
    assert known.identification.model == "model2" and known.indicateurs_techniques.vibration == 46.3
    assert len(known.anomalies_detectees) == 3 and known.prediction_risque.confidence == 0.8
    assert unknown.identification.model == "INCONNU" and unknown.prediction_risque.risk_level == "MODÉRÉ"
    assert unknown.recommandations_maintenance == ["Analyse indisponible"] and unknown.anomalies_detectees == []
    assert unknown.estimation_rul.rul_median == 100
    text = dossier.dossier(analysis, wanted).select(F.to_json(F.struct("*")).alias("j")).collect()
    assert all("identification" in r.j for r in text)


def test_untrained_analysis(rows):
    blank = dossier.analysed(features.raw_health_features(rows), None)
    r = dossier.dossier(blank).where("machineID = 1").first()
    assert (r.prediction_risque.risk_level, r.prediction_risque.confidence) == ("INCONNU", 0.0)
    assert (r.estimation_rul.rul_median, r.estimation_rul.current_survival_time) == (100, 0)
    assert r.recommandations_maintenance == ["Maintenance à 60 jours", "Surveillance normale", "Opérations standards"]


def test_context_skips_absent_sections(analysis):
    full = dossier.dossier(analysis).where("machineID = 1").select(dossier.context_string().alias("c")).first().c
    assert full.startswith("Machine: 1 - Modèle: model1 | Score santé: ") and full.endswith(" jours")
    partial = dossier.dossier(analysis).where("machineID = 1").withColumn("sante_globale", F.lit(None).cast(
        "struct<score_global: double, sante_mecanique: double, sante_pression: double>"))
    assert "Score" not in partial.select(dossier.context_string().alias("c")).first().c


def test_band_recommendations(spark):
    df = spark.createDataFrame([(1, 29.9), (2, 30.0), (3, 60.0)], "machineID long, global_health_score double")
    first = {r.machineID: r.recommendation for r in dossier.band_recommendations(df).where("position = 0").collect()}
    assert first == {1: "🔴 ARRÊT IMMÉDIAT recommandé", 2: "🟠 Planifier maintenance sous 7 jours", 3: "🟢 Maintenance préventive standard"}


def text_of(df):
    return [r.line for r in df.orderBy("block", "position").collect()]


def test_executive_report(spark, rows, health, tmp_path):
    report = reports.executive_report(health, economics.fleet_economics(rows), alerts.alerts(health, AS_OF), AS_OF)
    lines = text_of(report)
    assert lines[:5] == ["=" * 80, "RAPPORT EXÉCUTIF - MAINTENANCE PRÉDICTIVE", "Entreprise Industrielle", f"Date: {AS_OF}", "=" * 80]
    assert "  Parc total: 6 machines" in lines and "  Économies annuelles: 39,000 €" in lines
    assert any(line.startswith("  1. Machine ") and line.endswith("Risque: ÉLEVÉ") for line in lines)
    assert "  6. Augmenter l'investissement ML de 20% pour étendre la couverture" in lines
    assert "  Économies projetées (M+6): 58,500 €" in lines
    sinks.write_lines(report, str(tmp_path / "report"))
    written = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert written == "\n".join(lines)


def test_maintenance_report(spark, health):
    rows = alerts.alerts(health, AS_OF)
    parts = spark.createDataFrame([(1, "courroie", 3, "HAUTE")], "position int, part string, quantity int, urgency string")
    lines = text_of(reports.maintenance_report(rows, AS_OF, parts))
    assert "  courroie: 3 unités - HAUTE" in lines
    assert any(line.startswith("\nSEMAINE_1") for line in lines)
    assert any("machines CRITIQUES dans les 48h" in line for line in lines)
    quiet = reports.instructions(rows.where(F.lit(False))).collect()
    assert [r.position for r in quiet] == [1, 2]


def test_decision_pack(health, rows):
    pack = reports.decision_pack(health, economics.fleet_economics(rows))
    lines = text_of(reports.decision_pack_lines(pack, AS_OF))
    assert lines[0] == "Decision Pack - Maintenance Prédictive" and lines[3] == "Top 5 Machines à Risque:"
    assert lines[4].startswith("- Machine 6 | Modèle: model2 | Santé: ") and lines[-1] == "- fleet_size: 6"


def test_prompts(analysis, rows, health):
    prompt = reports.machine_prompts(dossier.dossier(analysis), economics.fleet_economics(rows), fleet.fleet_kpis(health)).where(
        "machineID = 1").first().prompt
    assert "- Machines analysées: 6" in prompt and "{" not in prompt and "Machine: 1 - Modèle: model1" in prompt
    assert reports.prompt_template("unknown") == reports.EXECUTIVE_PROMPT
    assert reports.prompt_template("technical") == reports.TECHNICAL_PROMPT
