"""From a review table to the corrected prediction table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from reviewmill.operators.columns import find_roles
from reviewmill.operators.correction import correct_by_rating, with_prediction
from reviewmill.operators.routing import route_datasets
from reviewmill.operators.sentiment import SentimentModel, train_dataset, with_score


@dataclass(frozen=True)
class Analysis:
    predictions: DataFrame
    roles: dict[str, str]
    domain: str
    language: str
    model: SentimentModel
    scorecard: DataFrame | None


def predict(df: DataFrame, id_col: str, text_col: str, rating_col: str | None,
            model: SentimentModel) -> DataFrame:
    """Input rows with prediction and correction columns; each row has its own score, whatever
    its id."""
    return correct_by_rating(with_prediction(with_score(df, text_col, model), "probability"), rating_col)


def analyse(df: DataFrame, id_col: str, base: SentimentModel,
            roles: dict[str, str] | None = None, **options) -> Analysis:
    """Find the columns, route, train on the dataset's ratings if they allow it, and
    predict with that model or the base model."""
    roles = roles or find_roles(df.drop(id_col))
    if "text" not in roles:
        raise ValueError(f"no text column among {df.columns}")
    text_col, rating_col = roles["text"], roles.get("rating")
    routed = route_datasets(df, id_col, text_col).select("domain", "language").first()
    trained = train_dataset(df, id_col, text_col, rating_col, routed["domain"], **options)
    model, card = (trained[0], trained[2]) if trained else (base, None)
    return Analysis(predict(df, id_col, text_col, rating_col, model), roles, routed["domain"],
                    routed["language"], model, card)
