"""Declared schemas of the raw logs and of the survival table."""

from pyspark.sql import types as T


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_LONG, _INT, _DOUBLE, _TEXT, _TS = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType())

TELEMETRY = _schema(datetime=_TS, machineID=_LONG, volt=_DOUBLE, rotate=_DOUBLE,
                    pressure=_DOUBLE, vibration=_DOUBLE)
ERRORS = _schema(datetime=_TS, machineID=_LONG, errorID=_TEXT)
FAILURES = _schema(datetime=_TS, machineID=_LONG, failure=_TEXT)
MAINT = _schema(datetime=_TS, machineID=_LONG, comp=_TEXT)
MACHINES = _schema(machineID=_LONG, model=_TEXT, age=_INT)

RAW_LOGS = {"telemetry": TELEMETRY, "errors": ERRORS, "failures": FAILURES,
            "maint": MAINT, "machines": MACHINES}

SURVIVAL = _schema(machineID=_LONG, model=_TEXT, age=_INT, time=_DOUBLE, event=_INT,
                   volt=_DOUBLE, rotate=_DOUBLE, pressure=_DOUBLE, vibration=_DOUBLE,
                   error_count=_LONG, maint_count=_LONG)
