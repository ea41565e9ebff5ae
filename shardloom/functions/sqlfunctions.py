"""Session SQL functions for text queries: Catalyst inlines their bodies. (The engine writes SQRT, ASIN, ACOS and MOD by the argument's own type.)"""

from __future__ import annotations

from pyspark.sql import SparkSession

_NUM = "CASE WHEN x IS NOT NULL THEN coalesce(try_cast(x AS DOUBLE), 0D) END"
_DEC = "CASE WHEN x IS NOT NULL THEN coalesce(try_cast(x AS DECIMAL(38,10)), CAST(0 AS DECIMAL(38,10))) END"

#: name: (parameters, type, body)
BODIES = {
    "sl_sqrt": ("x STRING", "DOUBLE", f"CASE WHEN ({_NUM}) >= 0 THEN sqrt({_NUM}) END"),
    "sl_asin": ("x STRING", "DOUBLE", f"CASE WHEN abs({_NUM}) <= 1 THEN asin({_NUM}) END"),
    "sl_acos": ("x STRING", "DOUBLE", f"CASE WHEN abs({_NUM}) <= 1 THEN acos({_NUM}) END"),
    "sl_mod": ("x DECIMAL(38,10), y DECIMAL(38,10)", "DECIMAL(38,10)", "try_mod(x, y)"),
    "sl_pi": ("", "DECIMAL(7,6)", "3.141593"),
    "sl_truncate": ("x DOUBLE, d INT", "DOUBLE", "signum(x) * floor(round(abs(x) * pow(10D, d), 9)) / pow(10D, d)"),
    "sl_power": ("x DOUBLE, y DOUBLE", "DOUBLE", "CASE WHEN abs(power(x, y)) = double('infinity') THEN raise_error('DOUBLE value is out of range') ELSE power(x, y) END"),
    "sl_length": ("x STRING", "BIGINT", "CAST(octet_length(x) AS BIGINT)"),
    "sl_substring": ("x STRING, p INT, n INT DEFAULT 2147483647", "STRING", "CASE WHEN x IS NULL OR p IS NULL OR n IS NULL THEN NULL WHEN p = 0 OR abs(p) > char_length(x) OR n < 1 THEN '' ELSE substring(x, p, n) END"),
    "sl_lpad": ("x STRING, n INT, p STRING", "STRING", "CASE WHEN n >= 0 THEN CASE WHEN p = '' AND char_length(x) < n THEN '' ELSE lpad(x, n, p) END END"),
    "sl_rpad": ("x STRING, n INT, p STRING", "STRING", "CASE WHEN n >= 0 THEN CASE WHEN p = '' AND x IS NOT NULL THEN '' ELSE rpad(x, n, p) END END"),
    "sl_strcmp": ("a STRING, b STRING", "INT", "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END"),
    "sl_format_bytes": ("v DOUBLE", "STRING", "CASE WHEN v IS NULL THEN NULL WHEN abs(v) < 1024 THEN concat(CAST(CAST(v AS BIGINT) AS STRING), ' bytes') " + "".join(f"WHEN {'TRUE' if i == 7 else f'abs(v) < {1024.0 ** (i + 2)!r}D'} THEN concat(replace(format_number(v / {1024.0 ** (i + 1)!r}D, 2), ',', ''), ' {u}') " for i, u in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB"))) + "END"),
    "sl_cast_signed": ("x STRING", "BIGINT", f"CAST({_DEC} AS BIGINT)"),
    "sl_cast_unsigned": ("x STRING", "DECIMAL(20,0)", f"CAST(CASE WHEN ({_DEC}) <= -1 THEN ceil({_DEC}) + CAST('18446744073709551616' AS DECIMAL(28,0)) ELSE floor(abs({_DEC})) END AS DECIMAL(20,0))"),
}
ALIASES = {"sl_pow": "sl_power", "sl_substr": "sl_substring"}


def register(spark: SparkSession) -> None:
    """Define every function in the session; the date and time casts come as Column expressions."""
    from . import cast

    bodies = BODIES | {alias: BODIES[name] for alias, name in ALIASES.items()}
    for name, (params, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    for name, make, kind in (("sl_cast_date", cast.date, "DATE"), ("sl_cast_datetime", cast.datetime, "TIMESTAMP_NTZ"), ("sl_cast_time", cast.time_text, "STRING")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {_sql_of(spark, make)}")
    for name, codec in cast.CHARSETS.items():
        if codec.startswith("utf"):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sl_charset_{name}(x STRING) RETURNS BINARY RETURN {_sql_of(spark, lambda x, n=name: cast.charset(x, n))}")
        else:  # Spark's own encoder has few character sets
            spark.udf.register(f"sl_charset_{name}", cast.encoder(codec))


def _sql_of(spark: SparkSession, make) -> str:
    """SQL text of a Column expression of x."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([], "x string").select(make(F.col("x")).alias("y"))
    return frame._jdf.queryExecution().analyzed().expressions().head().child().sql()
