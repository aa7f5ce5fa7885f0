"""Append records, then refit every model on the whole table.

``plans.training`` does the same from stored counts, without the old rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from kerbside.operators.classify import SeverityModel, train_severity
from kerbside.operators.cleaning import append_records
from kerbside.operators.regression import CountFit, fit_negative_binomial, fit_poisson
from kerbside.plans.features import derive
from kerbside.plans.training import Models, store


class Retrained(NamedTuple):
    data: DataFrame
    severity: SeverityModel
    poisson: CountFit
    negative_binomial: CountFit


def retrain(
    table: DataFrame, new_records: DataFrame | None, key: str = "accident_id",
    model_folder: str | None = None,
) -> Retrained:
    """``table`` and ``new_records`` are standardised; features are derived after the append.

    With ``model_folder`` all three models are stored there.
    """
    whole = table if new_records is None else append_records(table, new_records)
    data = derive(whole)
    models = Models(train_severity(data, key), fit_poisson(data), fit_negative_binomial(data))
    if model_folder:
        store(models, model_folder)
    return Retrained(data, *models)
