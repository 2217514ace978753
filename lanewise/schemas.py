"""Declared schemas of the feeds and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, REAL, INT, LONG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
CLOCK, DATE = T.TimestampNTZType(), T.DateType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


OBSERVATION = _table(DateTime=CLOCK, RouteId=TEXT, Vehicles=REAL)
OBSERVATION_PARTITIONED = _table(
    DateTime=CLOCK, RouteId=TEXT, Vehicles=REAL, City=TEXT, Zone=TEXT
)
LEVEL_OF_SERVICE_CSV = _table(
    _id=TEXT, segment_id=TEXT, date=TEXT, weekday=TEXT, period=TEXT, LOS=TEXT, street_name=TEXT,
    lat_snode=REAL, long_snode=REAL, lat_enode=REAL, long_enode=REAL,
)
ROUTE_GEO = _table(city=TEXT, zone=TEXT, route_id=TEXT, name=TEXT, lat=REAL, lon=REAL)
MODEL_SCORES = _table(
    mse=REAL, rmse=REAL, mae=REAL, mape=REAL, smape=REAL, r2=REAL, score=REAL
)
BACKTEST_SUMMARY = _table(
    city=TEXT, zone=TEXT, route_id=TEXT, family_name=TEXT, eval_start_date=TEXT,
    eval_end_date=TEXT, n_days_evaluated=INT, top_models=T.ArrayType(TEXT),
    metrics_avg=T.MapType(TEXT, MODEL_SCORES),
)
STREET_METRICS_CSV = _table(
    street_name=TEXT, slug=TEXT, timesteps=INT, n_train_seq=INT, n_test_seq=INT, acc=REAL,
    f1=REAL, status=TEXT, model_path=TEXT,
)
STREET_EVALUATION_CSV = _table(
    street_name=TEXT, slug=TEXT, model_type=TEXT, timesteps=LONG, n_seq_total=LONG,
    n_seq_test=LONG, MSE=REAL, RMSE=REAL, MAE=REAL, SMAPE=REAL, Accuracy=REAL,
)
PREDICTION_CSV = _table(
    DateTime=CLOCK, RouteId=TEXT, PredictedVehicles=REAL, BaseDate=DATE, ModelUsed=TEXT
)
