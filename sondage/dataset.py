"""One object for the analyses of a table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators import advice, cleaning, cluster_report, clustering, correlation, features, importance, jobs, normality, personal, profile, questionnaire
from sondage.operators.types import numeric_columns, scalar_columns, text_columns


class Dataset:
    """The analyses of ``df``. Each returns a DataFrame, or small values where the result is a few sentences or names."""

    def __init__(self, df: DataFrame, journal: list[str] = ()) -> None:
        self.df, self.journal = df, list(journal)

    @cached_property
    def context(self) -> cleaning.Context:
        return cleaning.context(self.df)

    def overview(self) -> DataFrame:
        return profile.table_profile(self.df)

    def columns(self) -> DataFrame:
        return importance.variables(profile.column_profile(self.df), importance.importance(self.df))

    def missing(self) -> DataFrame:
        return profile.missing_report(self.df)

    def column_lists(self) -> dict[str, list[str]]:
        return {"numeric": numeric_columns(self.df), "text": text_columns(self.df)}

    def numeric(self, column: str) -> dict[str, DataFrame]:
        found = profile.numeric_profile(self.df, [column])
        return {"statistics": found, "histogram": profile.histogram(self.df, column), "box": profile.box_plot(self.df, column), "outliers": profile.outliers(self.df, column).orderBy(column, F.xxhash64(*scalar_columns(self.df))).limit(profile.MOST_OUTLIERS), "alerts": profile.distribution_alerts(found)}

    def categorical(self, column: str) -> DataFrame:
        return profile.top_values(self.df, column)

    def normality(self, columns: list[str] | None = None) -> DataFrame:
        return normality.verdicts(self.df, columns)

    def normality_of(self, column: str) -> dict[str, DataFrame]:
        points = normality.qq_points(self.df, column)
        return {"tests": normality.verdicts(self.df, [column]), "points": points, "line": normality.qq_line(points), "histogram": profile.histogram(self.df, column), "curve": normality.normal_curve(self.df, column), "suggestion": normality.suggestions(self.df, [column])}

    def correlations(self) -> DataFrame:
        return correlation.ranked_pairs(correlation.correlations(self.df))

    def importance(self, n: int | None = None) -> DataFrame:
        found = importance.importance(self.df)
        return importance.top_importance(found, n) if n is not None else found

    def variable(self, column: str) -> DataFrame:
        return importance.decomposition(importance.importance(self.df)).where(f"column = '{column}'")

    def questionnaire(self) -> dict[str, object]:
        return questionnaire.report(self.df)

    def recommendations(self) -> list[tuple[str, bool]]:
        return cleaning.catalog(self.context)

    def advice(self) -> list[dict[str, str]]:
        """The actions that the table needs, with priority, category, label, justification and impact."""
        return cleaning.advice(self.context)

    def apply(self, actions: list[str]) -> Dataset:
        """A derived dataset; this one stays as it is."""
        rows, done = cleaning.apply_actions(self.df, actions, self.context)
        return Dataset(rows, [*self.journal, *done])

    def compare(self, other: Dataset) -> DataFrame:
        return cleaning.before_after(self.df, other.df)

    def anonymised(self, salt: str, forced: dict[str, str] | None = None) -> tuple[Dataset, DataFrame]:
        """The dataset with personal data hidden, and the log of the treatment."""
        types = personal.detect_types(self.df, forced)
        return Dataset(personal.anonymise(self.df, types, salt), [*self.journal, "anonymise"]), personal.treatment_log(self.df, types, salt)

    def fitness(self) -> DataFrame:
        return advice.fitness(advice.fitness_measures(self.df))

    def algorithms(self) -> DataFrame:
        return advice.algorithm_ranking(advice.fitness_measures(self.df))

    def encoding_plan(self) -> DataFrame:
        return advice.encoding_plan(self.df)

    def dendrogram(self, columns: list[str], categorical: list[str] = (), most: int = 300) -> DataFrame:
        return clustering.dendrogram(features.prepare(self.df, columns, categorical).rows, most)

    def best_k(self, algorithm: str, columns: list[str], categorical: list[str] = (), k_max: int = 8) -> tuple[int | None, list[dict]]:
        return cluster_report.best_k(features.prepare(self.df, columns, categorical).rows, algorithm, k_max)

    def cluster(self, algorithm: str, columns: list[str], categorical: list[str] = (), **options) -> dict[str, object]:
        return jobs.cluster(self.df, columns, list(categorical), algorithm, **options)

    def figures(self) -> dict[str, DataFrame]:
        return jobs.figures(self.df)

    def report(self, title: str = "Profile") -> str:
        return jobs.report(self.df, title)
