"""A caller's own function over rows: scorers and embedders in bounded Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridlark.functions import vectors as V

#: What a set-up gave, per worker process; the newest few are kept.
_READY: dict[str, Callable] = {}
_KEPT = 8


def _ready(token: str, setup: Callable[[], Callable]) -> Callable:
    if token not in _READY:
        while len(_READY) >= _KEPT:
            _READY.pop(next(iter(_READY)))
        _READY[token] = setup()
    return _READY[token]


def _attempt(fn: Callable, rows: pa.RecordBatch, fields: list[pa.Field]) -> list[tuple[list[pa.Array], list[str | None]]]:
    """Results of a batch; one that fails is halved until only its bad rows are without."""
    if not rows.num_rows:
        return []
    try:
        made = fn({c: rows.column(c) for c in rows.schema.names})
        columns = [pa.array(made[f.name], f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in fields]
        if any(len(c) != rows.num_rows for c in columns):
            raise ValueError(f"a result has {[len(c) for c in columns]} values for {rows.num_rows} rows")
        return [(columns, [None] * rows.num_rows)]
    except Exception as exc:  # noqa: BLE001 - a bad row must not stop the others; it is reported
        if rows.num_rows == 1:
            return [([pa.nulls(1, f.type) for f in fields], [f"{type(exc).__name__}: {exc}"[:500]])]
        half = rows.num_rows // 2
        return _attempt(fn, rows.slice(0, half), fields) + _attempt(fn, rows.slice(half), fields)


def score_rows(
    df: DataFrame, setup: Callable[[], Callable], inputs: Sequence[str], returns: str, batch_rows: int = 1024, error: str = "error"
) -> DataFrame:
    """`df` with the columns `returns` that a caller's function gives, and an `error` column.

    ``setup()`` runs once per worker process and gives the function, so that a model is
    loaded once; the function takes a dict of Arrow arrays of `inputs`, at most
    `batch_rows` rows of them, and returns a dict of arrays, lists or numpy arrays by the
    names in the DDL `returns`. Where a batch raises, gives a wrong number of values or
    values of another type, it is halved until the rows at fault are alone: those get
    nulls and the message, all others their results. So the function should depend on each
    row alone. Null inputs reach the function as nulls. All other columns stay; a
    result or error column that `df` has already raises.
    """
    wanted = T.StructType.fromDDL(returns)
    names = [f.name for f in wanted] + [error]
    clash = {n.lower() for n in names} & {c.lower() for c in df.columns}
    if clash or len({n.lower() for n in names}) < len(names):
        raise ValueError(f"columns {sorted(clash) or names} are taken")
    if batch_rows < 1:
        raise ValueError("a batch has a row or more")
    fields = list(to_arrow_schema(wanted))
    token = uuid.uuid4().hex
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = _ready(token, setup)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                got = _attempt(fn, part.select(list(inputs)), fields)
                columns = [pa.concat_arrays([g[0][k] for g in got]) for k in range(len(fields))]
                errors = pa.array([e for g in got for e in g[1]], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *columns, errors], names=[*kept, *names])

    schema = T.StructType([*df.schema.fields, *wanted.fields, T.StructField(error, T.StringType())])
    return df.mapInArrow(run, schema)


def histogram_features(values: Column, bins: int, low: float, high: float) -> Column:
    """Share of the values in each of `bins` equal steps from `low` to `high`; the ends take what lies beyond, no values give zeros."""
    step = (high - low) / bins
    place = lambda v: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v.cast("double") - low) / step)))
    places = F.transform(F.filter(values, lambda v: v.isNotNull()), place)
    return V.let(
        places,
        lambda p: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.when(F.size(p) > 0, F.size(F.filter(p, lambda x: x == i)) / F.size(p)).otherwise(F.lit(0.0))),
    )


def embed_rows(
    df: DataFrame,
    setup: Callable[[], Callable],
    inputs: Sequence[str],
    fallback: Column,
    dim: int,
    name: str = "vector",
    own: str = "embedded",
    error: str = "embed_error",
    batch_rows: int = 1024,
) -> DataFrame:
    """`df` with a feature vector of `dim` numbers from a caller's embedder, or else `fallback`.

    The embedder works as in `score_rows` and gives ``{"vector": ...}``. A row for which
    it raises or gives null falls back alone, whatever else its batch holds; `own` tells
    whose vector it is and `error` why. Vectors are cut or padded with zeros to `dim`.
    """
    clash = {name.lower(), own.lower(), "_embedding"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")

    def renamed():
        fn = setup()
        return lambda given: {"_embedding": fn(given)["vector"]}

    made = score_rows(df, renamed, inputs, "_embedding array<double>", batch_rows, error)
    vector = V.fit(F.coalesce("_embedding", fallback), dim)
    return made.select(*df.columns, vector.alias(name), F.col("_embedding").isNotNull().alias(own), error)
