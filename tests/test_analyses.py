"""Analyses against pandas and known values, and their edge cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondage.functions import personal as P
from sondage.operators import advice, cleaning, correlation, importance, normality, personal, profile, questionnaire
from sondage.operators.types import UnknownColumn, WrongKind


@pytest.fixture(scope="module")
def people():
    rng = np.random.RandomState(42)
    n = 200
    pdf = pd.DataFrame({"age": rng.normal(40, 8, n).round(1), "revenu": rng.lognormal(10, 0.6, n).round(0)})
    pdf["revenu_double"] = pdf.revenu * 2 + rng.normal(0, 50, n)
    pdf["categorie"] = rng.choice(["A", "B", "C"], n)
    pdf["ville"] = rng.choice(["Paris", "Lyon", "Marseille", "Nantes"], n).astype(object)
    pdf.loc[rng.choice(n, 16, replace=False), "age"] = np.nan
    pdf.loc[rng.choice(n, 50, replace=False), "ville"] = None
    return pd.concat([pdf, pdf.head(5)], ignore_index=True)


@pytest.fixture(scope="module")
def table(spark, people):
    return spark.createDataFrame(people).cache()


def test_table_profile(table, people):
    r = profile.table_profile(table).first()
    assert (r.n_rows, r.n_columns, r.n_duplicates, r.n_numeric, r.n_text) == (205, 5, 5, 3, 2)
    assert r.n_missing == people.isna().sum().sum()
    assert r.completeness == pytest.approx(100 * (1 - r.n_missing / (205 * 5)), abs=0.006)


def test_numeric_profile_is_that_of_pandas(table, people):
    for r in profile.numeric_profile(table).collect():
        x = people[r["column"]]
        assert r.n == x.count() and r.n_missing == x.isna().sum()
        for name, want in (("mean", x.mean()), ("median", x.median()), ("std", x.std()), ("skewness", x.skew()), ("kurtosis", x.kurt()), ("min", x.min()), ("max", x.max())):
            assert r[name] == pytest.approx(want, abs=1e-3, rel=1e-6), (r["column"], name)


def test_edge_numbers(spark):
    inf = float("inf")
    pdf = {"none": [None] * 5, "constant": [3.0] * 5, "one": [1.0, None, None, None, None], "two": [1.0, 2.0, None, None, None], "three": [1.0, 2.0, 4.0, None, None], "nan": [1.0, float("nan"), 2.0, 3.0, 9.0], "inf": [1.0, inf, -inf, 2.0, 3.0]}
    df = spark.createDataFrame([tuple(pdf[c][i] for c in pdf) + (bool(i % 2),) for i in range(5)], ", ".join(f"{c} double" for c in pdf) + ", flag boolean")
    rows = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert (rows["none"].n, rows["none"].mean, rows["none"].skewness) == (0, None, None)
    assert (rows["constant"].std, rows["constant"].skewness, rows["constant"].kurtosis) == (0.0, 0.0, 0.0)
    assert rows["one"].std is None and rows["two"].skewness is None
    assert rows["three"].skewness == pytest.approx(pd.Series([1, 2, 4.0]).skew(), abs=1e-4) and rows["three"].kurtosis is None
    assert rows["nan"].n == 4 and rows["flag"].mean == 0.4
    found = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert found["none"].mode is None and found["none"].n_distinct == 0 and found["constant"].mode == "3.0"
    assert {r["column"]: r.status for r in profile.missing_report(df).collect()}["none"] == "critical"
    pairs = {(r.a, r.b): r.r for r in correlation.correlations(df, ["none", "constant", "three", "nan"]).collect()}
    assert pairs["constant", "nan"] is None and pairs["none", "three"] is None
    assert importance.importance(df).count() == 8
    assert profile.table_profile(df.limit(0)).first().n_rows == 0


def test_histogram_and_boxes(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]], "x double")
    bins = profile.histogram(df, "x").orderBy("bin").collect()
    assert sum(b.times for b in bins) == 5 and len(bins) == 5 and bins[-1].hi == 100
    assert sum(b.density * (b.hi - b.lo) for b in bins) == pytest.approx(1)
    assert [r.x for r in profile.outliers(df, "x").collect()] == [100.0]
    assert profile.box_plot(df, "x").first().n_outliers == 1
    flat = profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").orderBy("bin").collect()
    assert (flat[0].lo, flat[-1].hi, sum(b.times for b in flat)) == (1.5, 2.5, 2)
    assert profile.histogram(df.limit(0), "x").collect() == []
    with pytest.raises(UnknownColumn):
        profile.histogram(df, "y")
    with pytest.raises(WrongKind):
        profile.histogram(spark.createDataFrame([("a",)], "x string"), "x")


def test_ranks(spark):
    rng = np.random.RandomState(1)
    x = np.concatenate([rng.normal(0, 1, 300), np.repeat(0.5, 40), [1e6]])
    got = sorted((r.i, r.x) for r in profile.numbered(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").collect())
    assert [i for i, _ in got] == list(range(1, len(x) + 1)) and [v for _, v in got] == sorted(x)


def test_correlation_and_importance(table, people):
    pairs = {frozenset((r.a, r.b)): r.strength for r in correlation.ranked_pairs(correlation.correlations(table)).collect()}
    want = people[["age", "revenu", "revenu_double"]].corr()
    assert pairs[frozenset(("revenu", "revenu_double"))] == pytest.approx(abs(want.loc["revenu", "revenu_double"]), abs=1e-4)
    assert pairs[frozenset(("age", "revenu"))] == pytest.approx(abs(want.loc["age", "revenu"]), abs=1e-4)
    rows = importance.importance(table).orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    city = next(r for r in rows if r["column"] == "ville")
    p = people.ville.value_counts(normalize=True)
    assert city.variability == pytest.approx(100 * -(p * np.log2(p)).sum() / 2, abs=0.06)
    assert city.corr_max == 0 and city.completeness == pytest.approx(100 * people.ville.count() / 205, abs=0.06)
    assert len(importance.narrative(importance.importance(table))) >= 4
    with pytest.raises(ValueError):
        importance.top_importance(importance.importance(table), 0)


def test_normality(spark, table, people):
    k2 = {r["column"]: r for r in normality.dagostino(table).collect()}
    assert not k2["revenu"].normal
    rng = np.random.RandomState(3)
    normal = spark.createDataFrame([(float(v), float(v**3)) for v in rng.normal(5, 2, 400)], "a double, b double")
    got = {r["column"]: r.verdict for r in normality.verdicts(normal).collect()}
    assert got == {"a": "normal", "b": "not normal"}
    w, p = normality.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.001)
    line = normality.qq_line(normality.qq_points(normal, "a")).first()
    assert line.slope == pytest.approx(2, abs=0.2) and line.intercept == pytest.approx(5, abs=0.3) and line.r > 0.99
    small = normality.verdicts(normal.limit(2)).first()
    assert small.verdict == "insufficient"
    assert {r["column"]: r.suggestion for r in normality.suggestions(table, ["revenu"]).collect()} == {"revenu": "log1p"}
    curve = normality.normal_curve(normal, "a").collect()
    assert len(curve) == 200 and sum(r.density for r in curve) * (curve[1].x - curve[0].x) == pytest.approx(1, abs=0.02)


def test_k2_of_known_samples(spark):
    """The tests' published examples: skewness of eight values, kurtosis of 0 to 19."""
    from sondage.functions.stats import with_k2

    def of(values, **fixed):
        df = spark.createDataFrame([(float(x),) for x in values], "x double")
        one = df.agg(F.count("x").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))
        return with_k2(one.withColumns({k: F.lit(v) for k, v in fixed.items()})).first()

    # With other kurtosis held the same, the difference of two squares is that of the skewness parts.
    skewed = of([2, 8, 0, 4, 1, 9, 9, 0])
    other = of(range(1, 9), g2=skewed.g2)
    assert skewed.k2 - other.k2 == pytest.approx(0.44626**2 - 1.01080**2, abs=1e-3)
    twenty = of(range(20))
    same = of(range(20), g2=twenty.g2, g1=0.0)
    assert twenty.k2 == same.k2 and twenty.k2 > 1.70581**2
    assert of([1, 2, 3]).k2 is None


def test_personal_types_and_treatment(spark):
    rows = [
        (f"c{i}", "Jean Dupont", f"u{i}@x.fr", "06 12 34 56 78", "12 rue Haute 75001 Paris centre nord" if i % 2 else "rue sans code", 48.12345 + i, 2.12345, d, "voir Marie Durand au 06 12 34 56 78 ou a@b.com, 75002", 1000.5 + i)
        for i, d in enumerate(["2024-01-31 10:00:00", "2024-1-3 9:05", "31/01/2024 10:00:00", "31/01/2024 10:00", "2024-01-31", "31/01/2024", "31-01-2024", "2024/01/31", "12/31/2024", "n'importe quoi", "vers 2023-05-06 midi", "le 06/05/2023", None] * 2)
    ]
    df = spark.createDataFrame(rows, "id string, nom string, email string, telephone string, adresse string, latitude double, longitude double, date_naissance string, commentaire string, montant double")
    types = personal.detect_types(df)
    assert types == {"id": "id_direct", "nom": "name", "email": "email", "telephone": "phone", "adresse": "address", "latitude": "gps_lat", "longitude": "gps_lon", "date_naissance": "date_precise", "commentaire": "free_text", "montant": "numeric_id"}
    assert personal.detect_types(df, {"montant": "none"})["montant"] == "none"
    out = personal.anonymise(df, types, "salt").collect()
    import hashlib

    assert out[0].nom == "ID_" + hashlib.sha256(b"salt::Jean Dupont").hexdigest()[:10].upper()
    assert out[0].email == "[MASKED]" and out[0].latitude == 48.12
    assert out[1].adresse == "CP 75001 Paris centre" and out[0].adresse == "[ADDR_MASKED]"
    assert [r.date_naissance for r in out[:13]] == ["2024-01"] * 8 + ["2024-12", "[DATE_MASKED]", "2023-05", "2023-05", None]
    assert out[0].commentaire == "voir [NAME] au [PHONE] ou [EMAIL], [CP]"
    log = {r["column"]: r for r in personal.treatment_log(df, types, "salt").collect()}
    assert (log["date_naissance"].n_values, log["date_naissance"].n_treated) == (24, 24) and log["email"].n_treated == 26
    assert personal.log_totals(personal.treatment_log(df, types, "salt")).first().n_personal == 10
    assert personal.key_table(df, "nom", "salt").count() == 1
    blank = spark.createDataFrame([("",), ("  ",), (None,)], "v string").select(P.pseudonym(F.col("v"), "s").alias("v")).collect()
    assert [r.v for r in blank] == ["", "  ", None]
    assert personal.renamed(df)[1]["montant"] == "VAR_10"
    assert "| nom | name |" in personal.strategy_document(personal.treatment_log(df, types, "s"))


@pytest.fixture(scope="module")
def survey(spark):
    ranges = ['{"min": 1, "max": 5}', "{min: 2, max: 6, mid: 4,}", '{"debut": "07:00", "fin": "09:00"}', "min = 3; max: 9", '{"mid": 1}', None]
    rows = []
    for i in range(60):
        rows.append((["a|b|c", "a| b", "c", "a||a"][i % 4], ranges[i % 6], ["jamais", "rarement", "parfois", "souvent", "toujours"][i % 5], ["oui", "non"][i % 2], i % 5 + 1, "mot " * 6 if i % 3 else "rien", "x" if i % 10 == 0 else None, None if i % 2 else "texte libre", f"h{i}"))
    return spark.createDataFrame(rows, "q_multi string, q_range string, q_freq string, q_bin string, q_likert int, avis string, parent string, precisez_autre string, code string")


def test_questionnaire(spark, survey):
    types = questionnaire.field_types(survey)
    assert types == {"q_multi": "multi_response", "q_range": "json_range", "q_freq": "ordinal_scale", "q_bin": "binary", "q_likert": "ordinal_scale", "avis": "free_text", "parent": "categorical", "precisez_autre": "filter_question", "code": "categorical"}
    counts = {r.answer: r.times for r in questionnaire.answer_counts(survey, "q_multi").collect()}
    assert counts == {"a": 45, "b": 30, "c": 30}
    assert {(r.a, r.b): r.times for r in questionnaire.top_together(survey, "q_multi").collect()} == {("a", "b"): 30, ("a", "c"): 15, ("b", "c"): 15}
    hot = questionnaire.one_hot_answers(survey, "q_multi").columns
    assert hot[-3:] == ["q_multi|a", "q_multi|b", "q_multi|c"]
    r = questionnaire.json_range(survey, "q_range", []).collect()
    assert [(x.q_range_min, x.q_range_max, x.q_range_mid) for x in r[:6]] == [("1", "5", None), ("2", "6", "4"), ("07:00", "09:00", None), ("3", "9", None), (None, None, "1"), (None, None, None)]
    assert r[1].q_range_mid_num == 4.0 and r[2].q_range_min_num is None
    texts = questionnaire.text_features(survey, "avis", []).collect()
    assert (texts[0].has_response, texts[0].word_count) == (False, 0) and (texts[1].has_response, texts[1].word_count) == (True, 6)
    rates = {x["column"]: x for x in questionnaire.response_rates(survey).collect()}
    assert rates["avis"].n_refused == 20 and rates["q_bin"].n_refused == 30 and rates["parent"].level == "critical" and rates["precisez_autre"].is_filter
    assert [(x["column"], x.parent, x.n) for x in questionnaire.unparented(survey).collect()] == [("precisez_autre", "parent", 24)]
    s = questionnaire.ordinal_summary(survey, "q_likert").first()
    assert (s.n, s.n_values, s.entropy, s.median, s.mode, s.centrality) == (60, 5, 1.0, 3, 1, 40.0)
    found = questionnaire.report(survey)
    assert "2 ordinal_scale" in questionnaire.summary(found)
    assert questionnaire.report(spark.createDataFrame([(1, 2.0)], "a int, b double"))["types"] == {"a": "binary", "b": "ordinal_scale"}


def test_cleaning(spark, table, people):
    found = cleaning.context(table)
    assert found.n_duplicates == 5 and "revenu" in found.skewed and ("revenu", "revenu_double") in found.strong_pairs and found.moderate == ["ville"]
    same, journal = cleaning.apply_actions(table, ["nothing"], found)
    assert journal == [] and same is table
    out, journal = cleaning.apply_actions(table, ["drop_duplicates", "impute_moderate_missing", "transform_skewed", "encode_categorical"], found)
    kinds = [x.split(":")[0].split(" (")[0] for x in journal]
    assert kinds[:2] == ["duplicates dropped", "mode filled in"] and kinds[-1] == "one-hot encoded" and set(kinds[2:-1]) == {"ln(1 + x)"}
    after = profile.table_profile(out).first()
    assert after.n_rows == 200 and after.n_duplicates == 0 and after.n_missing == 16
    assert {"categorie_A", "categorie_B", "categorie_C", "ville_Paris"} <= set(out.columns) and "ville" not in out.columns
    steps = cleaning.detected_steps(table, out)
    assert any(s.startswith("deduplication") for s in steps) and any("dropped columns: categorie, ville" in s for s in steps)
    z = cleaning.standardise(table, ["age"]).agg(F.avg("age"), F.stddev_pop("age")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)
    shifted = cleaning.log1p(spark.createDataFrame([(-3.0,), (1.0,), (None,)], "x double"), ["x"]).collect()
    assert [r.x for r in shifted] == [pytest.approx(math.log(2)), pytest.approx(math.log(6)), None]
    power = cleaning.yeo_johnson_powers(table, ["revenu"])["revenu"]
    assert -0.5 < power < 0.5
    yj = cleaning.normalise_yeo(table, cleaning.Context(not_normal=["revenu"])).agg(F.skewness("revenu")).first()[0]
    assert abs(yj) < 0.2
    assert [a for a, _ in cleaning.catalog(found)] == ["drop_duplicates", "drop_critical_missing", "impute_moderate_missing", "normalize_yeo", "transform_skewed", "drop_low_importance", "encode_categorical", "standardize"]
    assert cleaning.fill_values(spark.createDataFrame([(None, None), (None, None)], "a string, b double"), ["a", "b"]) == {"a": "INCONNU"}
    row = cleaning.indicators(table).first()
    # 20 % of the cells aren't missing here: duplicates and skewed columns are the problems.
    assert (row.critical_problems, row.columns_to_treat) == (2, len(found.incomplete) + len(found.weak))
    assert (row.redundant_pairs, row.not_normal_columns) == (len(found.strong_pairs), len(found.not_normal))
    assert [x["id"] for x in cleaning.advice(found)] == [a for a, needed in cleaning.catalog(found) if needed]
    assert "5 duplicate" in cleaning.advice(found)[0]["label"] and len(cleaning.SUGGESTED_ORDER) == 8
    assert len(cleaning.preview(table)) == 10


def test_advice(spark, table):
    fit = advice.fitness(advice.fitness_measures(table)).first()
    assert (fit.status, fit.n_blockers, fit.n_warnings, fit.score) == ("ok", 0, 0, 100)
    assert [r.algorithm for r in advice.algorithm_ranking(advice.fitness_measures(table)).collect()][:2] == ["kmeans", "dbscan"]
    few = advice.fitness(advice.fitness_measures(spark.createDataFrame([("a",)], "x string"))).first()
    assert few.status == "bad" and few.n_blockers == 2
    plan = {r["column"]: (r.encoding, r.priority) for r in advice.encoding_plan(table).collect()}
    assert plan == {"categorie": ("one-hot", "high"), "ville": ("one-hot", "high")}
    scale = spark.createDataFrame([("Low",), ("HIGH",), ("medium",)], "s string")
    assert advice.encoding_plan(scale).first().encoding == "ordinal"
    assert advice.encoding_plan(spark.createDataFrame([(1,)], "x int")).collect() == []


def test_nested_columns_tell_rows_apart(spark):
    df = spark.sql("SELECT * FROM VALUES (1, array(1), map('a', 1)), (1, array(2), map('a', 1)), (1, array(2), map('a', 2)), (1, array(2), map('a', 2)) AS t(x, y, z)")
    assert profile.table_profile(df).first().n_duplicates == 1
    assert cleaning.drop_duplicates(df).count() == 3 and cleaning.drop_duplicates(df).columns == ["x", "y", "z"]


def test_personal_data_at_line_ends_and_without_blanks(spark):
    one = lambda f, text: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    for text in ("vu Jean Dupont ici", "vu Jean  Dupont ici", "vu Jean\nDupont ici"):
        assert one(P.scrub, text) == "vu [NAME] ici"
    for text, want in (("3 rue, 75001,Paris", "CP 75001 ,Paris"), ("75001  Paris 01 Nord", "CP 75001 Paris 01"), ("75001", "CP 75001"), ("rue", "[ADDR_MASKED]")):
        assert one(P.generalise_address, text) == want
    rows = spark.createDataFrame([(t,) for t in ("nan", "None", "", "rien", "bonne idée")], "t string")
    assert [r.has_response for r in questionnaire.text_features(rows, "t").collect()] == [False, False, False, False, True]
    assert questionnaire.response_rates(rows).first().n_refused == 2  # rien, None
    plan = advice.encoding_plan(spark.createDataFrame([(None, "a"), (None, "b")], "empty string, two string")).collect()
    assert {r["column"]: (r.n_distinct, r.encoding) for r in plan} == {"empty": (0, "one-hot"), "two": (2, "label")}


def test_exact_share_of_distinct_numbers(spark):
    df = spark.range(1000).selectExpr("id AS unique", "id % 940 AS often", "if(id < 960, id, null) AS most")
    assert personal.detect_types(df) == {"unique": "numeric_id", "often": "none", "most": "numeric_id"}


def test_anderson_darling_far_out(spark):
    """A heavy tail counts by the logarithm of its tail probability, not by a least value."""
    values = [float(i % 7) for i in range(200)] + [3000.0]
    x = np.sort(values)
    z = (x - x.mean()) / x.std(ddof=1)
    log = lambda t: math.log(0.5 * math.erfc(-t / 2**0.5)) if t > -37 else -t * t / 2 - math.log(-t * math.sqrt(2 * math.pi))
    n = len(x)
    want = -n - sum((2 * i - 1) * (log(z[i - 1]) + log(-z[n - i])) for i in range(1, n + 1)) / n
    got = normality.anderson_darling(spark.createDataFrame([(v,) for v in values], "v double"), "v").first().statistic
    assert got == pytest.approx(want, rel=1e-3)


def test_wide_table(spark):
    """360 columns: correlations are one pass of sums."""
    df = spark.range(300).select(*(F.xxhash64("id", F.lit(i)).cast("double").alias(f"c{i}") for i in range(359)), F.xxhash64("id", F.lit(7)).cast("double").alias("twin"))
    best = correlation.ranked_pairs(correlation.correlations(df)).first()
    assert (best.a, best.b, best.strength) == ("c7", "twin", 1.0)
