"""User-supplied scorers and models over distributed rows.

Python runs only here, on Arrow batches inside the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.time import instant

PREDICT_METHODS = ("predict", "predict_proba")


@dataclass(frozen=True)
class Response:
    """What a scorer sees of one row."""

    text: str | None
    prompt: str | None = None
    llm: str | None = None
    var: Mapping[str, str] = field(default_factory=dict)
    meta: Mapping[str, str] = field(default_factory=dict)


def scorer(function: Callable[[Response], Any], return_type: str) -> Callable[..., Column]:
    """Column function of (text, prompt, llm, var, meta) applying a user function to each response.

    The function returns a boolean, a number or a string, as ``return_type`` says.
    """
    allowed = {"boolean", "string", "int", "long", "bigint", "float", "double"}
    if return_type not in allowed:
        raise ValueError(f"return_type must be one of {sorted(allowed)}")

    def run(text: pd.Series, prompt: pd.Series, llm: pd.Series, var: pd.Series, meta: pd.Series) -> pd.Series:
        rows = zip(text, prompt, llm, var, meta)
        return pd.Series([function(Response(t, p, m, dict(v or {}), dict(x or {}))) for t, p, m, v, x in rows])

    udf = F.pandas_udf(run, return_type)

    def apply(text: Column, prompt: Column | None = None, llm: Column | None = None,
              var: Column | None = None, meta: Column | None = None) -> Column:
        no_text = F.lit(None).cast("string")
        no_map = F.lit(None).cast("map<string,string>")
        return udf(
            text,
            no_text if prompt is None else prompt,
            no_text if llm is None else llm,
            no_map if var is None else var,
            no_map if meta is None else meta,
        )

    return apply


def predict(
    df: DataFrame,
    load_model: Callable[[], Any],
    features: Sequence[str],
    *,
    output: str = "prediction",
    output_type: str = "double",
    predict_method: str = "predict",
    preprocess: Callable[[pd.DataFrame], Any] | None = None,
    postprocess: Callable[[Any], Any] | None = None,
) -> DataFrame:
    """Add a model's output to every row, batch by batch.

    ``load_model`` runs once per task. The model sees the named feature columns,
    after ``preprocess``; ``postprocess`` shapes its output. Only the features
    travel to Python: all other columns stay as they are.
    """
    if predict_method not in PREDICT_METHODS:
        raise ValueError(f"invalid predict method: {predict_method}")
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    names = list(features)
    kind = T._parse_datatype_string(output_type)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load_model()
        for inputs in batches:
            inputs = inputs[names]
            if preprocess is not None:
                inputs = preprocess(inputs)
            values = getattr(model, predict_method)(inputs)
            if postprocess is not None:
                values = postprocess(values)
            yield pd.Series(list(values))

    model_output = F.pandas_udf(run, kind)
    return df.withColumn(output, model_output(F.struct(*[F.col(f"`{n}`") for n in names])))


def batch_inference(
    df: DataFrame,
    load_model: Callable[[], Any],
    features: Sequence[str],
    model_id: str,
    as_of: str | datetime | Column | None = None,
    **options: Any,
) -> DataFrame:
    """Predictions stamped with the model's id and the time of inference."""
    return predict(df, load_model, features, **options).withColumns(
        {"model_id": F.lit(model_id), "inference_timestamp": instant(as_of)}
    )
