"""Models that are no column expression: NumPy rows in, NumPy predictions out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.session import require_columns

PredictRows = Callable[[np.ndarray], np.ndarray]
_LOADED: dict[str, PredictRows] = {}


@dataclass(frozen=True)
class OpaqueModel:
    """``load`` gives the function that predicts a matrix of feature rows; a Python worker calls it once per ``name``."""

    name: str
    load: Callable[[], PredictRows]

    def loaded(self) -> PredictRows:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name]


def predict_opaque(df: DataFrame, models: Mapping[str, tuple[OpaqueModel, Sequence[str]]]) -> DataFrame:
    """Add a prediction per output name of ``models``, each from its own features; null where a feature is missing.

    All models run over one Arrow batch in one pass over the rows.
    """
    for _, features in models.values():
        require_columns(df, list(features))
    used = list(dict.fromkeys(f for _, features in models.values() for f in features))
    names = list(models)
    plan = [(model, [used.index(f) for f in features]) for model, features in models.values()]
    columns = df.columns
    fed = df.select(*columns, F.array(*[F.col(f).cast("double") for f in used]).alias("__x"))

    def work(batches):
        for b in batches:
            flat = b.column("__x").flatten().to_numpy(zero_copy_only=False).astype(float)
            x = flat.reshape(b.num_rows, len(used))
            out = []
            for model, at in plan:
                whole = ~np.isnan(x[:, at]).any(axis=1)
                value = np.full(b.num_rows, np.nan)
                if whole.any():
                    value[whole] = model.loaded()(x[whole][:, at])
                out.append(pa.array(value, mask=~whole))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *out], names=[*columns, *names])

    return fed.mapInArrow(work, T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]))
